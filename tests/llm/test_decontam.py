import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sightline.llm import catalogue, decontam

from ..conftest import DATA
from . import awkward

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, window):
    """(doc_id, n_words, n_hit, items) by trying every window at every place."""
    windows = {}
    for ident, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).update([] if ident is None else [str(ident)])
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (owners := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= owners
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def got(rows):
    return [tuple(r)[:6] for r in decontam.leak_digest(rows).collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DATA}/{sf}/benchmark.parquet").collect()
    assert sorted(tuple(r)[:6] for r in catalogue.op9_decontam(spark, f"{DATA}/{sf}").collect()) == sorted(expected(docs, items, 10))


ITEMS = [(1, "Quick BROWN fox"), (2, "quick brown"), (3, None), (4, "?!"), (5, "brown fox jumps over the lazy dog"), (5, "wolf today"), (30, "ΑΒΓ straße"), (None, "one")]


@pytest.mark.parametrize("block_bytes", [1, 60, 1 << 20])
def test_awkward_rows_in_one_block_or_many(spark, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.find_leaks(awkward.crowded(spark).drop("n_words", "hit_ranges", "leaked_items"), items, window=3, block_bytes=block_bytes)
    assert sorted(map(str, got(rows))) == sorted(map(str, expected([r[:2] for r in awkward.ROWS], ITEMS, 3)))
    assert rows.first()["score"] == "mine"


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find_leaks(awkward.empty(spark), items).isEmpty()
    rows = decontam.find_leaks(awkward.crowded(spark), items.limit(0))
    assert rows.where(F.size("hit_ranges") > 0).isEmpty() and rows.where("n_words > 0").count() == 10


def test_hits_map_back_to_the_text(spark):
    text = "Well: the QUICK, brown\n fox — and a quick Brown Fox."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontam.find_leaks(docs, spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")).first()
    ranges = [tuple(r) for r in row["hit_ranges"]]
    assert [text[a:b] for a, b in decontam.char_ranges(text, ranges)] == ["QUICK, brown\n fox", "quick Brown Fox"]
    assert [text[a:b] for a, b in row["hit_chars"]] == ["QUICK, brown\n fox", "quick Brown Fox"]


def test_clashing_columns_in_any_case(spark):
    docs = awkward.documents(spark).withColumns({n: F.lit("mine") for n in ("N_Words", "HIT_RANGES", "Leaked_Items", "hit_CHARS", "window")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.find_leaks(docs, items, window=3)
    assert sorted(map(str, got(rows))) == sorted(map(str, expected([r[:2] for r in awkward.ROWS], ITEMS, 3)))
    assert {r["window"] for r in rows.collect()} == {"mine"}
