import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import catalogue, langid, quality

from ..conftest import DATA
from . import awkward


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("lang is not null")
    got = catalogue.op3_language(spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").isEmpty()


def test_languages_of_awkward_rows(spark):
    model = langid.train(awkward.documents(spark))
    rows = langid.identify(awkward.crowded(spark), model).collect()
    assert len(rows) == len(awkward.ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == langid.UNKNOWN and by_id[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert by_id[7]["lang_pred"] == "en" and by_id[7]["shard"] == "mine"
    assert langid.identify(awkward.empty(spark), model).isEmpty()


def test_without_languages_nothing_is_known(spark):
    model = langid.train(awkward.documents(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(awkward.documents(spark), model).collect()} == {langid.UNKNOWN}
    one = langid.train(awkward.documents(spark).withColumn("lang", F.lit("xx")))
    assert one.predict("some words") == ("xx", 1.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    apart = (code[:, None] != code[None]).sum(2) + 1000 * np.eye(n, dtype=int)
    assert apart.min() >= (1 if n < 3 else 2 if n == 3 else 4)


def test_an_error_in_one_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]))
    for k in range(5):
        for bit in range(code.shape[1]):
            said = code[k].copy()
            said[bit] *= -1
            assert model.decode(said * 3, 400)[0] == "abcde"[k]
    assert model.decode(np.zeros(code.shape[1]), 400)[1] < langid.CLEAR


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    got = catalogue.op10_quality(spark, f"{DATA}/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97
    order = got["score"].rank()
    good = got["quality"] == 1
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98


def by_hand(texts, good, fit):
    """Scores of all texts with numpy alone; good and fit tell which rows are positives and which unlabelled rows to fit to."""
    x = np.array([quality.features(t) for t in texts], np.float32).astype(float)
    mean, scale = x[good].mean(0), x[good].std(0) + 1e-2
    z = quality._inputs(x, mean, scale)
    sides = [(z[m], quality._halves(x[m])) for m in (good, fit)]
    apart = []
    for k in (0, 1):
        pk, uk = (rows[half == k] for rows, half in sides)
        apart.append(np.linalg.solve(pk.T @ pk / len(pk) + uk.T @ uk / len(uk) + 2 * quality._ridge(good.sum()), pk.mean(0) - uk.mean(0)))
    counts = []
    for rows, half in sides:
        other = np.where(half == 0, rows @ apart[1], rows @ apart[0])
        at = np.clip(np.floor((other + 1e-9 + quality.LIMIT) / (2 * quality.LIMIT) * quality.RANGES), 0, quality.RANGES - 1).astype(int)
        counts.append(np.bincount(at, minlength=quality.RANGES))
    prior = quality.estimate_prior(*counts)
    weights = quality.minimise(z[good].T @ z[good], z[fit].T @ z[fit], prior)
    return 1 / (1 + np.exp(-np.clip(quality.SLOPE * (z @ weights), -30, 30)))


@pytest.mark.parametrize(("partitions", "within"), [(1, 1e-6), (7, 0.02)])
def test_quality_query_by_hand(spark, tmp_path, partitions, within):
    import zlib

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    (docs.coalesce(1) if partitions == 1 else docs.repartition(partitions)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").where("quality = 1").collect()}
    fit = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in rows])
    want = by_hand([r["text"] for r in rows], fit & np.array([r["doc_id"] in good for r in rows]), fit)
    got = {r["doc_id"]: r for r in catalogue.op10_quality(spark, str(tmp_path)).collect()}
    assert [got[r["doc_id"]]["score"] for r in rows] == pytest.approx(list(want), abs=within)
    assert all(g["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and g["predicted"] == (g["score"] >= 0.3) for d, g in got.items())


def test_quality_of_awkward_rows(spark):
    docs = awkward.crowded(spark)
    made = quality.measured(docs.select("doc_id", "text", "slot"))
    model = quality.train(made.where("doc_id = 5"), made)
    rows = quality.judge(docs, model).collect()
    assert len(rows) == len(awkward.ROWS) and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["slot"] == "mine"
    same = [r["score"] for r in rows if r["doc_id"] in (5, 6)]
    assert same[0] == same[1]
    again = quality.judge_measured(made, model).collect()
    assert sorted(str((r["doc_id"], round(r["score"], 9))) for r in again) == sorted(str((r["doc_id"], round(r["score"], 9))) for r in rows)
    assert quality.judge(awkward.empty(spark), model).isEmpty()
    assert quality.train(made.limit(0), made) is None and quality.train(made, made.limit(0)) is None
    assert {r["score"] for r in quality.judge(docs, None).collect()} == {0.5}


def test_risk_is_least_and_does_not_fall_below_its_floor():
    draw = np.random.default_rng(3)
    for prior in (0.5, 0.8, 0.95):
        p, u = (np.c_[np.ones(400), draw.normal(m, 1, (400, quality.WIDTH)) / 4] for m in (0.5, 0.0))
        w = quality.minimise(p.T @ p, u.T @ u, prior)
        floor = -quality.TOLERANCE * prior / np.sqrt(400)

        def risk(w):
            negative = np.mean((u @ w + 1) ** 2) / 4 - prior * np.mean((p @ w + 1) ** 2) / 4
            return prior * np.mean((p @ w - 1) ** 2) / 4 + max(floor, negative) + w @ quality._ridge(400) @ w / 2, negative

        best, negative = risk(w)
        assert negative >= floor - 1e-6
        assert all(risk(w + draw.normal(0, size, len(w)))[0] >= best - 1e-6 for size in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_prior_from_score_ranges():
    draw = np.random.default_rng(3)
    edges = np.linspace(-8, 8, 401)
    for prior in (0.4, 0.8):
        good = draw.normal(2, 1, 3000)
        mixed = np.r_[draw.normal(2, 1, int(3000 * prior)), draw.normal(-2, 1, 3000 - int(3000 * prior))]
        assert abs(quality.estimate_prior(np.histogram(good, edges)[0], np.histogram(mixed, edges)[0]) - prior) < 0.06


def test_prior_of_a_corpus_with_one_very_common_text(spark):
    good = spark.range(3000).select(F.concat(F.lit("These are quiet words about number "), "id", F.lit(" and what became of it, in the end.")).alias("text"))
    for common in ("$$$ WIN WIN WIN $$$ 999", "### BUY BUY ### 777 ###", "%%% CLICK CLICK %%% 5"):
        docs = good.unionByName(spark.range(1500).select(F.lit(common).alias("text")))
        model = quality.train(*(quality.measured(side).cache() for side in (good, docs)))
        assert 0.6 < model.prior < 0.85


def test_language_of_few_texts_with_many_copies(spark):
    said = {"aa": "zorna pilek vudra", "bb": "mwithe kalono sibu", "cc": "xarra quexil ooft", "dd": "jentu bladdi grosk", "ee": "yipsa thunn carvo", "ff": "hylli debrak funst"}
    rows = spark.createDataFrame(list(said.items()), "lang string, text string")
    model = langid.train(rows.crossJoin(spark.range(5000).select("id")))
    assert {k: model.predict(v)[0] for k, v in said.items()} == {k: k for k in said}
    sure = {k: model.predict(v)[1] for k, v in said.items()}
    once = langid.train(rows)
    assert sure == pytest.approx({k: once.predict(v)[1] for k, v in said.items()}, abs=1e-3)
