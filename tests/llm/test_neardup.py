from collections import defaultdict

import numpy as np
import pytest

from sightline.llm import neardup as n

from ..conftest import DATA
from . import awkward


def words(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if text else []


def shingles(text, width):
    w = [x for x in words(text) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width, percent):
    """doc_id -> (size, least linked doc_id), by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(spark, rows, width, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.near_duplicates(docs, width, percent).collect()}
    assert got == components(rows, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_documents_by_brute_force(spark, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, width, percent)


def test_large_groups_and_common_passages_by_brute_force(spark):
    """More near copies than a block holds, around the threshold, among documents that share a passage."""
    draw = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = list(draw.choice(vocabulary, 60))
    base = list(draw.choice(vocabulary, 140))
    rows = []
    for i in range(700):
        if i % 2:
            copy = list(base)
            for at in draw.choice(len(copy), draw.integers(1, 14), replace=False):
                copy[at] = f"edit{draw.integers(0, 40)}"
            rows.append((i, " ".join(copy)))
        else:
            rows.append((i, " ".join([*draw.choice(vocabulary, draw.integers(5, 150)), *passage])))
    check(spark, rows, 3, 85)


def test_awkward_rows(spark):
    for docs in (awkward.documents(spark), awkward.crowded(spark)):
        rows = n.near_duplicates(docs, 3, 85).collect()
        assert len(rows) == len(awkward.ROWS)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
        assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
        assert got[4] == (1, 4, True) and got[5][1:] == (5, True) and got[6][1:] == (5, False)
        assert got[None][1:] == (None, True) and got[10] == (1, 10, True)
        assert got[7][0] == len(shingles(awkward.LONG, 3))
    assert n.near_duplicates(awkward.empty(spark)).isEmpty()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(i, i + 1) for i in range(1000, 1010)] + [(5, 5), (1005, 1003)]
    got = {r["node"]: r["component"] for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1011), 1000)}
    assert n.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_overlaps_and_estimates():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    exact = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    got = n.overlaps(sets)
    np.fill_diagonal(got, 0)
    assert (got == exact).all()
    assert all((n.overlaps(sets[k : k + 3]) * (1 - np.eye(3)) == exact[k : k + 3, k : k + 3]).all() for k in range(30))
    close = []
    for _ in range(200):
        union = np.unique(draw.integers(0, 2**63, 1200).astype(np.uint64))
        draw.shuffle(union)
        a, b = np.sort(union[:1080]), np.sort(union[120:])
        close.append(n.estimate(a[: n.SKETCH], b[: n.SKETCH]))
    assert abs(np.mean(close) - 960 / 1200) < 0.02 and min(close) > 0.8 - n.SLACK


def test_two_kinds_of_copies_stay_two_groups(spark):
    by = defaultdict(set)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in range(50))) for i in range(600)]
    for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect():
        by[r["component_id"]].add(r["doc_id"])
    assert {k: len(v) for k, v in by.items()} == {0: 300, 1: 300}


def templated(count, shared, own, edits=0, seed=1):
    """Pages of a template, each with words of its own; some with edits in the template."""
    draw = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(count):
        page = list(template)
        for at in draw.choice(shared, edits, replace=False) if edits else ():
            page[at] = f"e{draw.integers(0, 1000)}"
        rows.append((i, " ".join([*page, *[f"p{i}w{k}" for k in range(own)]])))
    return rows


@pytest.mark.parametrize(("block", "rounds"), [(20, 1), (30, 4), (64, 2)])
def test_pivots_by_brute_force(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "ROUNDS", rounds)
    rows = templated(150, 100, 3) + [(i + 1000, t) for i, t in templated(150, 100, 12)] + [(i + 2000, t) for i, t in templated(200, 90, 2, 7)]
    check(spark, rows, 3, 85)


def test_pivots_where_rows_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 10)
    rows = templated(60, 80, 2)
    other = " ".join(f"x{k}" for k in range(82))
    docs = spark.createDataFrame([*rows, (3, other), (100, other + " y"), (101, "alone in the world")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in n.near_duplicates(docs, 3, 85).collect()}
    assert {d: c for d, c in got.items() if c} == {101: 101} and got[100] == 0


def test_many_templated_pages_cost_as_much_as_there_are_pages(spark, monkeypatch):
    compared = []
    real = n.by_group

    def counted(rows, work, schema):
        rows = n.cut_lineage(rows)
        compared.append(rows.count())
        return real(rows, work, schema)

    monkeypatch.setattr(n, "by_group", counted)
    docs = spark.createDataFrame(templated(20_000, 60, 3), "doc_id long, text string").repartition(8)
    rows = n.near_duplicates(docs, 3, 85).groupBy("component_id").count().collect()
    assert [tuple(r) for r in rows] == [(0, 20_000)]
    assert sum(compared) < 6 * 20_000


def test_frequent_sets_and_stars_are_dealt_to_tasks(spark, monkeypatch):
    from sightline.llm import common

    monkeypatch.setattr(common, "OFTEN", 25)
    rows = [(i, "the same text again and again") for i in range(300)] + [(i + 300, "") for i in range(300)] + [(i + 600, t) for i, t in templated(100, 60, 2)]
    got = {r["doc_id"]: r["component_id"] for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **{i: i for i in range(300, 600)}, **dict.fromkeys(range(600, 700), 600)}


def test_few_blocks_take_one_pivot(spark, monkeypatch):
    """Pages about 0.8 alike, which no pivot settles, in six blocks: further pivots would be rounds of jobs for nothing."""
    calls = []
    real = n.by_group
    monkeypatch.setattr(n, "by_group", lambda *args: calls.append(args[2]) or real(*args))
    monkeypatch.setattr(n, "BLOCK", 20)
    check(spark, templated(115, 80, 8), 3, 85)
    assert len(calls) == 4


def test_stars_take_no_contraction(spark, monkeypatch):
    written = []
    real = n.cut_lineage
    monkeypatch.setattr(n, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    edges = [(i, 0) for i in range(1, 50)] + [(100, i) for i in (99,)] + [(200, 201), (200, 202), (203, 200)]
    got = {r["node"]: r["component"] for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 99: 99, 100: 99, **dict.fromkeys(range(200, 204), 200)}
    assert len(written) == 2


def test_trees_of_a_block_are_stars_at_the_least_id():
    sets = {d: np.arange(k, k + 100).astype(np.uint64) for k, d in enumerate([7, 3, 9, 1, 5, 8])}
    group = [(0, d, 100, s) for d, s in sets.items()]
    assert sorted(n.links(97)((0, 0, 0), group)) == [(d, 1) for d in (3, 5, 7, 8, 9)]


@pytest.mark.parametrize("few", [0, 1000])
def test_common_values_broadcast_or_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(n, "BROADCAST_IDS", few)
    monkeypatch.setattr(n, "COMMON", 8)
    check(spark, templated(40, 60, 30) + [(i + 100, t) for i, t in templated(30, 60, 2)], 3, 85)


@pytest.mark.parametrize("few", [0, 200_000])
def test_full_sets_shuffle_only_the_texts_compared(spark, monkeypatch, few):
    """Among long texts, a canopy of short ones that takes a pivot: the long ones are not shuffled for it."""
    monkeypatch.setattr(n, "BROADCAST_PLACES", few, raising=False)
    draw = np.random.default_rng(6)
    long = [(i + 1000, " ".join(map(str, draw.integers(0, 1 << 40, 3000)))) for i in range(200)]
    docs = spark.createDataFrame(templated(300, 60, 2) + long, "doc_id long, text string")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    docs = n.cut_lineage(docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        got = {r["doc_id"]: r["component_id"] for r in n.near_duplicates(docs, 3, 85).collect()}
        moved = written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {**dict.fromkeys(range(300), 0), **{d: d for d, _ in long}}
    assert 0 < moved < sum(len(t) for _, t in long) / 4


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_likely_in_keeps_all_that_are_named(spark, monkeypatch, most):
    from sightline.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", most)
    rows = spark.range(-50_000, 150_000).selectExpr("id as doc_id", "id % 7 as Bitmap").unionByName(spark.createDataFrame([(None, 1)], "doc_id long, Bitmap long"))
    for count in (0, 1, 20_000, 40_000):
        named = spark.range(count).selectExpr("id * 3 - 40000 as doc_id")
        kept = common.likely_in(rows, named, "doc_id")
        assert kept.columns == rows.columns and kept.distinct().count() == kept.count()
        assert kept.join(named, "doc_id").count() == count
        if most > 1 << 15:
            assert kept.count() <= count + 200_000 / 14


def test_few_places_are_broadcast_to_the_texts(spark, monkeypatch):
    picked = []
    real = n.likely_in
    monkeypatch.setattr(n, "likely_in", lambda rows, *args: picked.append(rows.columns) or real(rows, *args))
    monkeypatch.setattr(n, "BLOCK", 20)
    rows = templated(60, 80, 2)
    check(spark, rows, 3, 85)
    assert ["doc_id", "text"] not in picked
    monkeypatch.setattr(n, "BROADCAST_PLACES", 0)
    check(spark, rows, 3, 85)
    assert ["doc_id", "text"] in picked
