"""A small table with everything that can go wrong in one."""

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "one", "en", "b", 3),
    (5, "The the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "b", 90),
    (6, "The the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "b", 90),
    (7, LONG, "en", "c", len(LONG)),
    (8, "…—!!! 123 456", "de", "c", 13),
    (9, "naïve 😀 ΑΒΓ straße <|endoftext|> x", "de", "c", 40),
    (None, "no id but a text of some words", "en", "c", 30),
    (10, "repeated row", "en", "c", 12),
    (10, "repeated row", "en", "c", 12),
    (11, "a\n\nb\n \nc\r\nd", "en", "c", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def crowded(spark):
    """The same with extra columns named like what operators add."""
    from pyspark.sql import functions as F

    names = "score predicted lang_pred ambiguous shard slot tree spans n_words hit_ranges leaked_items record bucket place part guest sort_key key value h x own".split()
    return documents(spark).withColumns({n: F.lit("mine") for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
