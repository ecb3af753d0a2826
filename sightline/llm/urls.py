"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed URLs are kept in canonical form: lower-case host, then the path. A listed
entry covers its host, every subdomain of it, and every path that starts with
its own path; the longest entry that covers a URL decides.

A listed entry has a shape: the labels of its host and the length of its path. A
URL is turned into the keys under which it could be listed, one for each shape of
the list that fits it: that many last labels of its host with that long a front of
its path. The keys are probed in the Bloom filter, and those that pass are joined
to the list itself. A URL is looked up once however many rows have it, and the
answer goes back to them by a join in which frequent URLs are dealt to several
tasks; rows without a host take no part.

The filter is a table of blocks of eight 32-bit words; a key sets one bit in
each word of one block. Blocks being rows, the probe is an equi-join on the
block number, which Spark broadcasts when the filter is under its own
threshold and shuffles when it is not, so the list may be of any size.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut_lineage, join_spread, private_name

WORDS = 8
#: Keys aimed at per block of 256 bits: about 0.1 % of absent keys pass.
KEYS_PER_BLOCK = 12
#: Columns that filter_urls adds.
ADDED = ("host", "path", "rule", "verdict")
#: A list up to this many rows is broadcast; its rows are short strings.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """For each word of a block, the mask of the one bit that a key sets."""
    mixed = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftright(mixed, 5 * w).bitwiseAND(F.lit(31)).cast("int") for w in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit) for bit in bits]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the distinct values of `key`; blocks without keys have no row."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(urls: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of `urls`.

    rules: (host, path, verdict); a null path counts as empty. Of several rows for one (host, path) the smallest verdict holds.
    A URL that no rule covers is not listed and gets `default` and a null rule.
    Null URLs, and those without `://`, have empty host and path and so meet no
    rule. Repeated rows are kept. Columns of `urls` named host, path, rule or
    verdict are replaced; all others are returned as they are. An empty list
    gives every row the default.
    """
    spark = urls.sparkSession
    listed = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .groupBy("r_host", "r_path")
        .agg(F.min("r_verdict").alias("r_verdict"))
        .withColumn("key", F.concat_ws("\u0000", "r_host", "r_path"))
    )
    columns = [c for c in urls.columns if c.lower() not in ADDED]
    parsed = urls.select(*columns, host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    nothing = {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    shapes = listed.groupBy(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("length")).agg(F.count("*").alias("n")).collect()
    n = sum(s["n"] for s in shapes)
    if not n:
        return parsed.withColumns(nothing)
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    small = n <= BROADCAST_ROWS

    # Nothing but host and path here, so that no column of `urls` can be in the way.
    with_host = parsed.where(F.col("host") != "")
    asked = with_host.select("host", "path").groupBy("host", "path").agg(F.count("*").alias("n_rows"))
    keys = asked.select("*", F.explode(_candidates([(s["labels"], s["length"]) for s in shapes])).alias("key"))
    probe = keys.withColumn("block", _block(F.col("key"), blocks))
    filter_rows = bloom_blocks(listed.select("key"), blocks)
    possible = probe.join(F.broadcast(filter_rows) if small else filter_rows, "block")
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(mask) != 0 for i, mask in enumerate(_masks(F.col("key")))])
    exact = possible.where(passed).select("host", "path", "n_rows", "key").join(F.broadcast(listed) if small else listed, "key")
    best = F.max(F.struct(F.length("r_host") + F.length("r_path"), "r_host", "r_path", "r_verdict")).alias("best")
    longest = exact.groupBy("host", "path").agg(best, F.first("n_rows").alias("n_rows"))
    rule, verdict, count = (private_name(parsed, name) for name in ("found_rule", "found_verdict", "found_rows"))
    found = cut_lineage(longest.select("host", "path", F.concat("best.r_host", "best.r_path").alias(rule), F.col("best.r_verdict").alias(verdict), F.col("n_rows").alias(count)))
    judged = join_spread(with_host, found, ["host", "path"], F.monotonically_increasing_id(), count, "left").select(
        *columns, "host", "path", F.col(rule).alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict")
    )
    return judged.unionByName(parsed.where(F.col("host") == "").withColumns(nothing))


def _candidates(shapes: list[tuple[int, int]]) -> Column:
    """The keys under which (host, path) could be listed, one for each shape that fits."""
    kinds = F.from_json(F.lit(json.dumps([{"labels": a, "length": b} for a, b in sorted(shapes)])), "array<struct<labels:int,length:int>>")
    has, long = F.size(F.split("host", r"\.")), F.length("path")

    def key(shape: Column) -> Column:
        return F.concat_ws("\u0000", F.call_function("substring_index", F.col("host"), F.lit("."), -shape["labels"]), F.substring(F.col("path"), F.lit(1), shape["length"]))

    return F.transform(F.filter(kinds, lambda s: (s["labels"] <= has) & (s["length"] <= long)), key)
