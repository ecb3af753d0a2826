"""Helpers that several operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: A key with more rows than this, and than a ten-thousandth of all, is dealt to several tasks.
OFTEN = 1000
#: Bits for each key in the bitmap of `likely_in`, and bits it has at most (16 MB).
KEY_BITS = 16
FILTER_BITS = 1 << 27
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 1 << 15

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master only, a local default when that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that a lost executor costs no recomputation.

    What was written is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sightline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def join_spread(rows: DataFrame, found: DataFrame, keys: list[str], spread: Column, n_rows: str, how: str = "inner") -> DataFrame:
    """Join `rows` to `found`, which has each key once, without gathering the rows of a frequent key in one task.

    n_rows: a column of `found` with how many of `rows` have its key, left out of the result.
    Keys with more than OFTEN rows and more than a ten-thousandth of all
    (so at most 10,000 keys, which are broadcast) are salted: their rows by
    `spread`, and what was found is repeated for each salt. `found` is read several
    times and should be cheap to read. Null keys meet nothing.
    """
    salt, salts = (private_name(rows, n) for n in ("salt", "salts"))
    held = found.agg(F.sum(n_rows).alias("total"), F.max(n_rows).alias("most")).first()
    limit = max(OFTEN, (held["total"] or 0) // 10_000)
    if (held["most"] or 0) <= limit:
        return rows.join(found.drop(n_rows), keys, how)
    often = F.broadcast(found.where(F.col(n_rows) > limit).select(*keys, F.ceil(F.col(n_rows) / limit).cast("int").alias(salts)))
    dealt = rows.join(often, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), F.col(salts)).cast("int"), F.lit(0))).drop(salts)
    repeated = found.drop(n_rows).join(often, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(salts)
    return dealt.join(repeated, [*keys, salt], how).drop(salt)


def likely_in(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is among those of `named`, and a sixteenth of the others at most, without a shuffle of `rows`.

    For wide rows of which a join with `named`, which has to follow, needs few. What
    is broadcast is a bitmap of hashed keys, 2 to 4 bytes for each row of `named`; with
    more of these than FILTER_BITS is meant for, more of the others pass, in the end all.
    `named` is read twice.
    """
    held = named.count()
    bits = BITMAP
    while bits < min(KEY_BITS * held, FILTER_BITS):
        bits *= 2
    if held >= bits:
        return rows
    bitmap, seen = (private_name(rows, n) for n in ("bitmap", "seen"))
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    at = place.bitwiseAND(BITMAP - 1)
    bitmaps = named.groupBy(F.floor(place / BITMAP).alias(bitmap)).agg(F.bitmap_construct_agg(at).alias(seen))
    near = rows.withColumn(bitmap, F.floor(place / BITMAP)).join(F.broadcast(bitmaps), bitmap)
    byte = F.conv(F.hex(F.substring(seen, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return near.where(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def private_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
