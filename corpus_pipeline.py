"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
their input and some of its rows; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontam, langid, neardup, packing, quality
from sightline.llm.common import cut_lineage, table

READ = ("doc_id", "text", "lang")


def kept_where(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: Column) -> DataFrame:
    """The rows of `docs` for which what `judge` adds meets a condition; columns of the same names as what it adds stay as they are."""
    renamed = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    judged = judge(docs.withColumnsRenamed(renamed)).where(condition)
    return judged.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])


#: Ids of documents to drop up to which these are broadcast (8 bytes each, about 32 MB once hashed).
BROADCAST_IDS = 1_000_000
#: A language decision scored lower than this is no decision.
LEAST_LANGUAGE_SCORE = 0.4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier, trained on the labels and these documents, predicts to be bad.

    Null texts are judged as empty ones. Without labelled positives every row stays.
    """
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    rows = cut_lineage(quality.measured(docs.select("doc_id", "text")))
    model = quality.train(quality.trusted(rows, good), rows)
    return kept_where(docs, lambda rows: quality.judge(rows, model), F.col("predicted") == 1) if model else docs


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: no text, no letter, or no codeword near.

    Without any row that names its language every row stays.
    """
    model = langid.train(docs)
    clear = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return kept_where(docs, lambda rows: langid.identify(rows, model), clear) if model.languages else docs


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least id.

    Documents without words are in no group. Rows that repeat a doc_id are one
    group, of which one row stays; rows without a doc_id all stay.
    """
    judged = cut_lineage(neardup.near_duplicates(docs, width=5, percent=80))
    named = judged.where("doc_id is not null")
    repeated = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    gone = cut_lineage(named.where("not kept").select("doc_id").distinct())
    # A hash table of that many longs is small; more of them are joined by a shuffle.
    few = gone.count() <= BROADCAST_IDS
    kept = docs.where("doc_id is not null").join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark text."""
    benchmark = table(spark, sf_dir, "benchmark")
    return kept_where(docs, lambda rows: decontam.find_leaks(rows, benchmark), F.size("hit_ranges") == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack; one row for each piece of a document."""
    return packing.pack_documents(docs, **packing.public_tokenizer())


STAGES = [
    ("quality", keep_good),
    ("language", keep_identified),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_clean_of_benchmark),
    ("packing", pack),
]

#: Trained models, string hashing in Python and tokenisation have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = cut_lineage(docs)
    return docs
