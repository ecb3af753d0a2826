"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs often hold a conversation again and again, each time with more turns. Every
turn gets a rolling hash of the conversation up to it. A conversation whose
hash over all turns is the hash of a proper prefix of another is a snapshot; an
anti-join removes it. Of equal conversations the one with the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns) of the conversations that are no prefix of another one.

    turns: (conv_id, turn, role, text); further columns are not read. Turns are
    ordered by turn, role and text; null turns come first, null roles and texts
    count as empty. Turn numbers only order: gaps and repeats change nothing.
    What a turn without a conv_id belongs to is unknown: it is a conversation by
    itself, of one turn, and goes like any other if it begins another one or
    equals one. Empty tables give no rows. A conversation that stays is one row of
    the result, so a task holds it whole.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = said.where("conv_id is not null")
    talk = W.partitionBy("conv_id")
    so_far = talk.orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    # A prefix hash is two 64-bit sums (by xor) of the hashes of its turns with their places.
    h1, h2 = F.xxhash64("place", "role", "text"), F.xxhash64("text", "role", "place", F.lit(1))
    placed = named.withColumns({"place": F.row_number().over(so_far), "n_turns": F.count("*").over(talk)})
    hashed = placed.withColumns({"h1": F.bit_xor(h1).over(so_far), "h2": F.bit_xor(h2).over(so_far)})
    alone = said.where("conv_id is null").groupBy("role", "text").agg(F.min("turn").alias("turn")).withColumn("place", F.lit(1)).withColumns({"h1": h1, "h2": h2})
    whole = hashed.where(F.col("place") == F.col("n_turns")).select("h1", "h2", "conv_id", "n_turns", F.lit(None).cast(said.select(F.struct("turn", "role", "text")).schema[0].dataType).alias("only"))
    whole = whole.unionByName(alone.select("h1", "h2", F.lit(None).cast(said.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), F.struct("turn", "role", "text").alias("only")))
    whole = whole.groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min("n_turns").alias("n_turns"), F.min("only").alias("only"))
    proper = hashed.where(F.col("place") < F.col("n_turns")).select("h1", "h2").distinct()
    kept = whole.join(proper, ["h1", "h2"], "left_anti")
    # Only turns of what stays are gathered.
    told = named.join(kept.where("conv_id is not null").select("conv_id"), "conv_id", "left_semi").groupBy("conv_id")
    told = told.agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return told.unionByName(kept.where("conv_id is null").select("conv_id", "n_turns", F.array("only").alias("turns")))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): each turn as a role marker, its text and a line end."""
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n")))
    return conversations.select("conv_id", "n_turns", F.array_join(line, "").alias("rendered"))


#: DuckDB SQL for the rows of render(maximal_conversations(...)).
ORACLE = """
with talks as (
  select conv_id, count(*) as n_turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as rendered,
         list(coalesce(role, '') || chr(0) || coalesce(text, '') order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as said
  from (select *, case when conv_id is null then row_number() over () end as own from conversations) group by conv_id, own),
prefixes as (select distinct said[:i] as prefix from talks, unnest(range(1, n_turns)) as r(i))
select min(conv_id) as conv_id, min(n_turns)::bigint as n_turns, min(rendered) as rendered
from talks where said not in (select prefix from prefixes) group by said
"""
