import corpus_pipeline
from sightline.llm import common, decontam, neardup

from ..conftest import DATA
from . import awkward

SF = f"{DATA}/sf0.01"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_on_all_its_predecessor_kept(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.cut_lineage(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns
            assert docs.exceptAll(before).isEmpty()
            assert docs.count() < before.count() or name == "language"  # all of these have a language
        if name == "quality":
            labels = common.table(spark, SF, "labels").join(before, "doc_id")
            gone = before.join(docs, "doc_id", "left_anti").join(labels.select("doc_id", "quality"), "doc_id")
            assert gone.where("quality = 0").count() == labels.where("quality = 0").count()
            assert gone.where("quality = 1").count() <= 0.01 * labels.where("quality = 1").count()
        elif name == "language":
            assert before.count() - docs.count() <= 0.01 * before.count()
        elif name == "near_duplicates":
            judged = neardup.near_duplicates(before)
            assert ids(docs) == ids(judged.where("kept"))
        elif name == "decontamination":
            leaks = decontam.find_leaks(before, common.table(spark, SF, "benchmark"))
            assert ids(docs) == ids(leaks.where("size(hit_ranges) = 0"))
        else:
            assert sorted({r["doc_id"] for r in docs.select("doc_id").collect()}) == ids(before)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{DATA}/sf0.001")
    assert sorted({r[0] for r in got.select("doc_id").collect()}) == sorted({r[0] for r in docs.select("doc_id").collect()})


def test_awkward_documents_pass_through(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        crowded = awkward.crowded(spark)
        out = stage(spark, crowded, SF)
        assert out.columns == crowded.columns
        assert all(r["score"] == "mine" and r["n_words"] == "mine" for r in out.collect())
        assert stage(spark, awkward.empty(spark), SF).isEmpty()
    kept = corpus_pipeline.keep_distinct(spark, awkward.documents(spark), SF)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None, 10, 11]))
    assert corpus_pipeline.ORACLE_SQL is None


def test_dropped_ids_beyond_the_broadcast_bound_are_shuffled(spark, monkeypatch):
    docs = common.table(spark, f"{DATA}/sf0.001", "documents")
    broadcast = ids(corpus_pipeline.keep_distinct(spark, docs, SF))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert ids(corpus_pipeline.keep_distinct(spark, docs, SF)) == broadcast == ids(neardup.near_duplicates(docs).where("kept"))
