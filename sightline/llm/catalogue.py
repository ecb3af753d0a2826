"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprints, html, langid, neardup, packing, quality, shards, urls
from .common import cut_lineage, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = html.extract(pages, html.train(spark))
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = langid.bucket("doc_id", 3)
    model = langid.train(documents.where(fold != 1))
    judged = langid.identify(documents.select("doc_id", "text"), model)
    return judged.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


#: (host, path, verdict), as the contract states them.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
with parsed as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(r_host, r_path, r_verdict) as (values %s),
ruled as (
  select p.*, r_host || r_path as rule, r_verdict,
         row_number() over (partition by page_id order by length(r_host || r_path) desc nulls last) as place
  from parsed p left join rules
    on (host = r_host or host like '%%.' || r_host) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from ruled where place = 1
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal_conversations(table(spark, sf_dir, "conversations")))


SHARDS = 24


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("text")
    return shards.shuffle_into_shards(documents, SHARDS).select(
        "doc_id", shards.record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str, **tokenizer: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False, **(tokenizer or packing.public_tokenizer()))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leak_digest(decontam.find_leaks(documents, table(spark, sf_dir, "benchmark")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = langid.bucket("doc_id", 5)
    rows = cut_lineage(quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text")))
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (fold != 0))
    model = quality.train(quality.trusted(rows.where(fold != 0), good), rows.where(fold != 0))
    return quality.judge_measured(rows, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html": op2_html,
    "op3_language": op3_language,
    "op4_urls": op4_urls,
    "op5_chat": op5_chat,
    "op6_shards": op6_shards,
    "op7_neardup": op7_neardup,
    "op8_packing": op8_packing,
    "op9_decontam": op9_decontam,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op4_urls": OP4_SQL % ", ".join(map(str, URL_RULES)),
    "op5_chat": chat.ORACLE,
}
