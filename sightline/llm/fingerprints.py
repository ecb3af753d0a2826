"""Document fingerprints: Merkle trees over sections, paragraphs and spans.

A section ends before a blank line, a paragraph at each line end, and a span after
a word whose hash is 0 modulo SPAN_WORDS, so that spans fall in step again after
an insertion. What has no blanks for long (a line of Chinese, an address) is cut
likewise after pairs of characters. A span's node is its 64-bit hash; a
paragraph's is the SHA-256 of the hashes of its spans (two of each), a section's
that of its paragraphs' nodes, the root that of the sections' nodes. Equal texts
have equal roots.

Two trees are compared from the top: equal roots are alike in all, else equal
sections count as alike; of the others the paragraphs are compared, and of those
that differ the spans. So what is compared shrinks to the branches with edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private_name, shuffle_partitions

SPAN_WORDS = 4
#: Words in a span at most, and characters that count as one word.
LONGEST = 64
#: Words longer than this are cut, on average after so many characters.
LONG_WORD, PIECE = 32, 8
WORD = r"\S++\s*+|\s++"
SPAN = r"\s*+(?:\S{1,%d}+\s*+){1,%d}|\s++" % (LONGEST, LONGEST)
#: Put behind the last word of a span; in a text it ends a span as well.
END = "\x00"
SECTION_END = r"\n(?=[ \t]*\n)"
#: Characters of a node, in hex.
NODE = 32
#: Ranges of keys for each shuffle partition in `with_next`.
RANGES = 4


def _node(parts: Column) -> Column:
    return F.substring(F.sha2(parts, 256), 1, NODE)


def spans(paragraph: Column) -> Column:
    """The spans of a paragraph, in order; together they are the paragraph, but for END."""

    def cut(word: Column) -> Column:
        def after(c: Column, before: Column) -> Column:
            return F.when(c.isNull(), F.lit("")).when(F.pmod(F.xxhash64(before, c), F.lit(PIECE)) == 0, F.concat(c, F.lit(END))).otherwise(c)

        return F.array_join(F.zip_with(F.split(word, ""), F.split(F.concat(F.lit(" "), word), ""), after), "")

    def marked(word: Column) -> Column:
        ends = F.pmod(F.xxhash64(F.rtrim(word)), F.lit(SPAN_WORDS)) == 0
        return F.when(F.length(word) > LONG_WORD, cut(word)).when(ends, F.concat(word, F.lit(END))).otherwise(word)

    words = F.transform(F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0)), marked)
    return F.flatten(F.transform(F.split(F.array_join(words, ""), END), lambda piece: F.regexp_extract_all(piece, F.lit(SPAN), F.lit(0))))


def sections(text: Column) -> Column:
    """array<struct(node, n, paragraphs: array<struct(node, leaves)>)>: the tree below the root; leaves are 64-bit hashes, n counts them."""
    cut = F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.split(s, "\n"), lambda p: spans(p)))
    hashed = F.transform(
        cut, lambda s: F.transform(s, lambda p: F.struct(F.transform(p, lambda x: F.xxhash64(x)).alias("leaves"), F.transform(p, lambda x: F.xxhash64(F.lit(1), x)).alias("other")))
    )
    paragraphs = F.transform(
        hashed,
        lambda s: F.transform(s, lambda p: F.struct(_node(F.concat_ws(".", p["leaves"].cast("array<string>"), p["other"].cast("array<string>"))).alias("node"), p["leaves"].alias("leaves"))),
    )
    return F.transform(
        paragraphs,
        lambda s: F.struct(_node(F.array_join(s["node"], "")).alias("node"), F.aggregate(s, F.lit(0), lambda n, p: n + F.size(p["leaves"])).alias("n"), s.alias("paragraphs")),
    )


def root(tree: Column) -> Column:
    """The root over `sections`: 64 hex digits."""
    return F.sha2(F.array_join(tree["node"], ""), 256)


def printed(root_node: Column, tree: Column) -> Column:
    """A fingerprint as one string of bounded length: the root, then for sections and paragraphs the digests of their nodes by first hex digit.

    Of two texts the levels differ where some nodes with that first digit do, which tells what to look for in the trees.
    """

    def level(nodes: Column) -> Column:
        groups = F.transform(F.array(*[F.lit(c) for c in "0123456789abcdef"]), lambda c: F.struct(c.alias("digit"), F.filter(nodes, lambda n: F.startswith(n, c)).alias("nodes")))
        held = F.filter(groups, lambda g: F.size(g["nodes"]) > 0)
        return F.array_join(F.transform(held, lambda g: F.concat(g["digit"], F.substring(F.sha2(F.array_join(F.sort_array(g["nodes"]), ""), 256), 1, 8))), ".")

    return F.concat_ws(":", root_node, level(tree["node"]), level(F.flatten(tree["paragraphs"])["node"]))


def fingerprint(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add `tree` (the sections) and `root` to every row.

    A null text counts as empty, which is one section of one paragraph without
    spans. Very long texts are hashed whole. Columns of `documents` named tree or
    root are replaced, all others kept; repeated rows get equal trees, and an
    empty table gives no rows.
    """
    kept = [c for c in documents.columns if c.lower() not in ("tree", "root") or c == text]
    treed = documents.select(*kept, sections(F.coalesce(text, F.lit(""))).alias(private_name(documents, "made_tree")))
    made = F.col(treed.columns[-1])
    return treed.select(*[c for c in kept if c.lower() not in ("tree", "root")], made.alias("tree"), root(made).alias("root"))


def differing(a: Column, b: Column) -> Column:
    """(section, paragraph) positions, from 0, of the paragraphs of tree `a` that are nowhere in tree `b`; for two trees side by side."""
    unknown = F.array_except(F.flatten(a["paragraphs"])["node"], F.flatten(b["paragraphs"])["node"])
    positions = F.transform(
        a,
        lambda s, i: F.filter(
            F.transform(s["paragraphs"], lambda p, j: F.when(F.array_contains(unknown, p["node"]), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull()
        ),
    )
    return F.flatten(positions)


def _only(rows: DataFrame, left: Column, right: Column, kids: str, name: str) -> DataFrame:
    """Add `name`_all and `name`_only: the distinct nodes of both sides (node, side, n, kids), and those that the other side has not."""

    def sided(nodes: Column, side: int) -> Column:
        n = (lambda x: x["n"]) if kids == "paragraphs" else (lambda x: F.size(x["leaves"]))
        return F.transform(nodes, lambda x: F.struct(x["node"].alias("node"), F.lit(side).alias("side"), n(x).alias("n"), x[kids].alias("kids")))

    every = f"{name}_all"
    rows = rows.withColumn(every, F.sort_array(F.concat(sided(left, 0), sided(right, 1))))

    def before(i: Column) -> Column:
        return F.get(F.col(every), i - 1)

    first = F.filter(every, lambda x, i: F.coalesce((before(i)["node"] != x["node"]) | (before(i)["side"] != x["side"]), F.lit(True)))
    rows = rows.withColumn(every, first)
    alone = F.filter(every, lambda x, i: ~(F.coalesce(before(i)["node"] == x["node"], F.lit(False)) | F.coalesce(F.get(F.col(every), i + 1)["node"] == x["node"], F.lit(False))))
    return rows.withColumn(f"{name}_only", alone)


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add `name`, how alike two trees are (0 to 1), found by going down where their nodes differ.

    Twice the leaves that are alike over the leaves of both; each node of a level counts once. Two trees without leaves are alike.
    """

    def side(only: str, k: int) -> Column:
        return F.flatten(F.transform(F.filter(only, lambda x: x["side"] == k), lambda x: x["kids"]))

    def leaves(nodes: str) -> Column:
        return F.aggregate(nodes, F.lit(0).cast("long"), lambda n, x: n + x["n"])

    kept = rows.columns
    s, p = private_name(rows, "s"), private_name(rows, "p")
    rows = _only(rows, F.col(a), F.col(b), "paragraphs", s)
    rows = _only(rows, side(f"{s}_only", 0), side(f"{s}_only", 1), "leaves", p)
    mine, theirs = private_name(rows, "mine"), private_name(rows, "theirs")
    rows = rows.withColumns({mine: F.array_distinct(side(f"{p}_only", 0)), theirs: F.array_distinct(side(f"{p}_only", 1))})
    alike = leaves(f"{s}_all") - leaves(f"{s}_only") + leaves(f"{p}_all") - leaves(f"{p}_only")
    both = F.size(mine) + F.size(theirs)
    likeness = F.when(alike + both == 0, F.lit(1.0)).otherwise((alike + 2 * F.size(F.array_intersect(mine, theirs))) / (alike + both))
    return rows.select(*[c for c in kept if c != name], likeness.alias(name))


def with_next(rows: DataFrame, key: str, carried: dict[str, str]) -> DataFrame:
    """Add to each row values of the row that follows it by `key`; the first row follows the last.

    carried: new column -> column read from the following row. Null keys come
    first; equal keys are ordered by the carried values.

    Rows are dealt to ranges of the key between exact split points (keys of the
    table), and the row at each split point is also sent to the range before it, so
    that each range finds all its followers by itself. Only the split points,
    RANGES for each shuffle partition, visit the driver.
    """
    order, part, guest = (private_name(rows, n) for n in ("sort_key", "part", "guest"))
    keyed = rows.withColumn(order, F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    n = max(2, RANGES * shuffle_partitions(rows.sparkSession))
    # 1-based percentiles are keys that occur; the least key starts the first range.
    picked = keyed.agg(F.percentile_approx(order, [i / n for i in range(n)], 10_000).alias("at"), F.min(order).alias("least")).first()
    if picked["least"] is None:
        return rows.withColumns({new: F.col(old) for new, old in carried.items()})
    starts = sorted({picked["least"], *picked["at"]})
    at = F.array(*[F.lit(s) for s in starts])
    own = (F.size(F.filter(at, lambda s: s <= F.col(order))) - 1).alias(part)
    before = F.when(F.array_contains(at, F.col(order)), F.pmod(F.col(part) - 1, F.lit(len(starts))))
    dealt = keyed.withColumn(part, own).withColumn(
        guest, F.explode(F.array_compact(F.array(F.lit(False), F.when(before.isNotNull(), F.lit(True)))))
    )
    dealt = dealt.withColumn(part, F.when(F.col(guest), before).otherwise(F.col(part)))
    by = ", ".join(f"`{c}`" for c in [guest, order, *dict.fromkeys(carried.values())])
    following = {new: F.expr(f"lead(`{old}`) over (partition by `{part}` order by {by})") for new, old in carried.items()}
    return dealt.withColumns(following).where(~F.col(guest)).drop(order, part, guest)


def edited(text: Column, following: Column) -> Column:
    """`text` with its last floor(n/2) code points replaced by the first as many (or all) of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edit_report(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    A null text counts as empty. A table of one row is its own next document.
    Rows with one doc_id follow each other in the order of their texts.
    """
    marked = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tree", sections(F.col("text")))
    paired = with_next(marked, "doc_id", {"next_text": "text", "next_tree": "tree"})
    changed = paired.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_tree", sections(F.col("edited")))
    told = changed.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "tree", "next_tree", "edited_tree",
        root(F.col("tree")).alias("root"), root(F.col("edited_tree")).alias("edited_root"),
    )
    compared = with_likeness(with_likeness(told, "tree", "edited_tree", "near_edited"), "tree", "next_tree", "near_next")
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("root"), F.col("tree")).alias("fingerprint"), printed(F.col("edited_root"), F.col("edited_tree")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
