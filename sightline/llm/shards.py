"""Sharding: a two-pass external shuffle.

Pass one scatters the records with a seeded hash into buckets small enough for
the memory of one task. Pass two draws a Fisher-Yates permutation of each
bucket (Spark's `shuffle` is one) and writes it. The buckets laid end to end
give every record a place in one global random order: place p is slot p div n
of shard p mod n, so shards differ by one record at most and slots have no gaps.

The order depends on the records and the seed alone. The number of buckets
follows from the bytes and the number of all records, and that of the partitions which gather
them from the number of buckets. In a partition, where the generator starts from
the seed plus the partition's number, buckets are drawn in order, and the records
of each are sorted first. Copies of one record that together are large beside a
bucket are numbered, and every number is hashed by itself, so that they spread
like different records; being equal, it does not matter which gets which number.

Beyond the tasks reach only the records counted per bucket, which turn a place
in a bucket into a global one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType, VariantType

SEED = 20_240_229
#: Bytes of records that one bucket should hold.
BUCKET_BYTES = 4 << 20
#: Overhead counted for each record besides its text.
ROW_BYTES = 8
#: Copies of a record are spread when they fill more than a bucket's part of so many.
PART = 16
#: Partitions of pass one; more buckets than this share them.
PARTITIONS = 20_000
#: Buckets up to which their offsets (16 bytes each), and repeated records up to which their hashes, are broadcast.
BROADCAST_ROWS = 500_000
#: Buckets whose offsets are summed as one run.
RUN = 4096
#: Copies made from one row at a time.
COPIES = 1024


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shuffle_into_shards(
    records: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED
) -> DataFrame:
    """Every record with its `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Null keys and texts hash like any other value; a text longer than a bucket
    fills one by itself. Repeated rows are kept; records that repeat through much
    of the table are spread over many buckets. Rows alike in all but columns
    that cannot be ordered (maps, variants) may change places from run to run.
    Columns of `records` named shard or slot are replaced, all others kept. An
    empty table gives no rows.
    """
    if n_shards < 1 or bucket_bytes < 1:
        raise ValueError("n_shards and bucket_bytes must be positive")
    columns = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    kept = records.select(*columns)
    size = kept.agg(F.sum(record_size(F.col(text))).alias("bytes"), F.count("*").alias("n")).first()
    n_buckets = max(1, min(size["n"], -(-(size["bytes"] or 0) // bucket_bytes)))
    scattered = _scattered(kept, key, text, bucket_bytes, n_buckets, seed)
    offsets = _offsets(scattered.groupBy("bucket").agg(F.count("*").alias("n")))
    # A stated number of partitions is not changed at run time: a bucket's partition follows from the two numbers.
    gathered = scattered.repartition(min(n_buckets, PARTITIONS), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("h", "record")).alias("rows"))
    # Sorted first, so that the order in which rows arrive has no part in the permutation.
    in_order = F.sort_array("rows") if all(map(_plain, kept.schema)) else F.array_sort("rows", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    buckets = gathered.select("bucket", in_order.alias("rows")).sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    placed = buckets.join(F.broadcast(offsets) if n_buckets <= BROADCAST_ROWS else offsets, "bucket")
    rows = placed.select("first_place", F.posexplode("rows").alias("place", "row"))
    place = F.col("first_place") + F.col("place")
    return rows.select(
        *[F.col("row.record")[c].alias(c) for c in columns],
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"({n_shards} + first_place + place) div {n_shards} - 1").alias("slot"),
    )


def _plain(column: StructField) -> bool:
    """Whether values of a column can be hashed, grouped and ordered."""

    def plain(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return all(plain(f.dataType) for f in kind)
        return plain(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))

    return plain(column.dataType)


def _scattered(records: DataFrame, key: str, text: str, bucket_bytes: int, n_buckets: int, seed: int) -> DataFrame:
    """(bucket, h, record): each record with the hash of its plain columns and its bucket."""
    plain = [f.name for f in records.schema if _plain(f)]
    rest = [c for c in plain if c not in (key, text)]
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(text), *map(F.col, rest))
    rows = records.select(hashed.alias("h"), F.struct(*records.columns).alias("record"))
    bytes_of = F.sum(record_size(F.col("record")[text]))
    often = rows.groupBy("h").agg(F.count("*").alias("n"), bytes_of.alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") * PART > bucket_bytes)).select("h")
    n_often = often.count() if n_buckets > 1 else 0
    once = F.pmod(F.xxhash64("h"), F.lit(n_buckets)).alias("bucket")
    if not n_often:
        return rows.select(once, "h", "record")
    often = F.broadcast(often) if n_often <= BROADCAST_ROWS else often
    hot = rows.join(often, "h", "left_semi")
    if len(plain) == len(records.columns):
        counted = hot.groupBy("h", "record").agg(F.count("*").alias("n"))
        runs = counted.select("h", "record", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES))).alias("first"))
        spread = runs.repartition("h", "first")
        copies = spread.select("h", "record", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("n")) - 1)).alias("copy"))
    else:
        copies = hot.withColumn("copy", F.monotonically_increasing_id())
    spread_out = copies.select(F.pmod(F.xxhash64("h", "copy"), F.lit(n_buckets)).alias("bucket"), "h", "record")
    return rows.join(often, "h", "left_anti").select(once, "h", "record").unionByName(spread_out)


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, first_place): how many records lie in the buckets before, summed in runs of RUN buckets."""
    runs = counts.withColumn("run", F.expr(f"bucket div {RUN}"))
    within = F.expr("sum(n) over (partition by run order by bucket) - n")
    # One row for RUN buckets each: few enough for one window.
    before = runs.groupBy("run").agg(F.sum("n").alias("run_n")).select("run", F.expr("sum(run_n) over (order by run) - run_n").alias("run_first"))
    return runs.withColumn("within", within).join(before, "run").select("bucket", (F.col("run_first") + F.col("within")).alias("first_place"))
