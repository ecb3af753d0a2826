"""Near-duplicate detection with bottom-k sketches from one hash function.

1. A document's set is the 64-bit hashes of its distinct word shingles; its
   sketch is the `SKETCH` smallest. Documents with equal sets form one class,
   which one member represents from here on.
2. Inverted lists: a class is listed under the `KEYS` first values of its sketch.
   Values listed for more than `COMMON` classes are common (passages that many
   documents share); they are taken only after all others, unless they make up
   most of a sketch. Two sets of similarity s have no key in common with
   probability (1 - s)^KEYS at most: about 1e-10 for 0.85.
3. Lists with the same first member merge into a canopy. Canopies larger than a
   block, in documents or in shingles, first lose what is settled: everyone is
   compared with one member, the pivot; those linked to it need not be compared
   among themselves, as they are in one component. The others go on to a next
   pivot, for ROUNDS rounds or till they fill FEW blocks, so that a group of many
   copies costs as much as it has members. Distance (1 less similarity) is a metric: who is farther from the pivot
   than twice the threshold's distance has no link to those settled with it; the
   nearer ones are compared with them.
4. What is left is compared in pairs of blocks, so that no task holds more than
   two. In each the union sketches estimate similarities. Classes with no estimate
   near the threshold leave.
5. The rest are compared exactly, on full sets, in the same blocks; only their texts
   are shuffled, picked by a bitmap of their ids that every task has. Of the links of
   a pair of blocks only a spanning forest is kept: links grow with the
   documents, not with their pairs.
6. Components come from alternating star contractions over the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_spread, likely_in

SKETCH = 48
KEYS = 12
COMMON = 64
BLOCK = 256
#: Shingles that a block should hold at most (8 bytes each); a larger set is a block by itself.
BLOCK_SHINGLES = 1 << 20
#: Pivots taken one after another in large canopies.
ROUNDS = 4
#: Blocks up to which a canopy takes one pivot only: in pairs of blocks a member is then read at most so many times.
FEW = 8
#: Common values, or ids of who holds them, up to which these are broadcast (8 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of PLACE up to which these are broadcast to the texts (about 80 bytes each); with more, the texts they name are shuffled.
BROADCAST_PLACES = 200_000
#: How far an estimate may fall short of the threshold: over four standard deviations.
SLACK = 0.28
#: Columns of a dense comparison that are multiplied at once.
CHUNK = 8192

Link = tuple[int, int]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words; of all words when there are fewer.

    Words are what white space (U+0020, U+0009 to U+000D) separates, A-Z in
    lower case. Null, empty and blank texts give an empty array.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=width)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    rolled = hashed[:n].copy()
    for i in range(1, width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        rolled += hashed[i : i + n]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(27)
    return np.unique(rolled)


def sketches(documents: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sketch): set_a and set_b name the set, 128 bits together."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(body.as_py(), width) for body in batch.column(1)]
            names = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
            )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>"
    return documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(made, schema)


def canopies(classes: DataFrame) -> DataFrame:
    """(leader, doc_id, n): who is in each canopy; n is the size of the set. The leader, the least doc_id, is one of them."""
    keyed = classes.select("doc_id", "n", "sketch", F.size("sketch").alias("held"))
    front = keyed.select("doc_id", F.explode(F.slice("sketch", 1, KEYS + 4)).alias("value"))
    common = _to_all(cut_lineage(front.groupBy("value").count().where(F.col("count") > COMMON).select("value")))
    touched = _to_all(cut_lineage(front.join(common, "value", "left_semi").select("doc_id").distinct()))
    plain = keyed.join(touched, "doc_id", "left_anti").select("doc_id", "n", F.explode(F.slice("sketch", 1, KEYS)).alias("value"))
    # Sketches that hold common values: take the others first.
    values = keyed.join(touched, "doc_id", "left_semi").select("doc_id", "n", "held", F.posexplode("sketch").alias("place", "value"))
    marked = values.join(_to_all(common.withColumn("common", F.lit(1))), "value", "left")
    ordered = marked.groupBy("doc_id").agg(
        F.first("n").alias("n"), F.first("held").alias("held"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("common").isNull(), F.struct("place", "value")))), 1, KEYS)["value"].alias("rare"),
        F.slice(F.sort_array(F.collect_list(F.struct("place", "value"))), 1, KEYS)["value"].alias("least"),
        F.count("common").alias("n_common"),
    )
    mostly = F.col("n_common") * 2 > F.col("held")
    chosen = ordered.select("doc_id", "n", F.explode(F.when(mostly, F.array_union("rare", "least")).otherwise(F.col("rare"))).alias("value"))
    postings = cut_lineage(plain.unionByName(chosen))
    leaders = postings.groupBy("value").agg(F.min("doc_id").alias("leader"), F.count("*").alias("listed")).where("listed > 1")
    return join_spread(postings, cut_lineage(leaders), ["value"], F.col("doc_id"), "listed").groupBy("leader", "doc_id").agg(F.max("n").alias("n"))


def _to_all(ids: DataFrame) -> DataFrame:
    """Broadcast `ids` while they are few, at all sizes of sketches; the join is by a shuffle otherwise."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def in_blocks(members: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """`members` with `blocks`, into how many blocks a group is dealt, `own`, which one a member is in, and `pivot`, the group's
    least doc_id; and the groups themselves with their blocks."""
    size = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sizes = cut_lineage(members.groupBy(*by).agg(F.ceil(size).cast("int").alias("blocks"), F.min("doc_id").alias("pivot"), F.count("*").alias("held")))
    dealt = join_spread(members, sizes, by, F.col("doc_id"), "held")
    return dealt.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), sizes.select(*by, "blocks")


PLACE = ("leader", "doc_id", "own", "i", "j")


def compared(members: DataFrame, documents: Callable[[DataFrame], DataFrame], sketched: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """What blocks to compare, as rows of PLACE, and the links (a, b) that pivots settled.

    documents: gives rows of PLACE with the full sets (n, values). sketched: (doc_id, n, values) of all.
    """
    least = percent / 100
    places: list[DataFrame] = []
    links: list[DataFrame] = []
    pairs: list[DataFrame] = []
    across: list[DataFrame] = []
    left = members
    for turn in range(1, ROUNDS + 2):
        left = cut_lineage(in_blocks(left, ["leader"])[0])
        # A canopy that fits a block needs no pivot, from the start or once others are settled.
        places.append(left.where("blocks = 1").select("leader", "doc_id", "own", F.lit(0).alias("i"), F.lit(0).alias("j")))
        few = 1 if turn == 1 else FEW
        pairs.append(left.where(F.col("blocks").between(2, few if turn <= ROUNDS else 1 << 30)))
        left = left.where(F.col("blocks") > few)
        if turn > ROUNDS or left.isEmpty():
            break
        leads = F.col("doc_id") == F.col("pivot")
        met = F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
        star = left.select("leader", "doc_id", F.when(leads, 0).otherwise(1).alias("own"), F.explode(met).alias("i"), F.lit(0).alias("j"))
        guessed = cut_lineage(by_group(likely_in(sketched, star, "doc_id").join(star, "doc_id"), _to_pivot, "leader long, doc_id long, own int, i int, j int, n long, guess double"))
        asked = guessed.where(F.col("guess") >= least - SLACK).select(*PLACE).unionByName(star.where("own = 0"))
        settled = by_group(documents(asked), _linked_to_pivot(percent), "leader long, doc_id long, pivot long, whole int")
        judged = cut_lineage(guessed.select("leader", "doc_id", "n", "guess").join(settled, ["leader", "doc_id"], "left"))
        links.append(judged.where("pivot is not null").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
        whole = F.coalesce(F.col("whole"), F.lit(0))
        # Across: the settled (side 1) with those not too far from the pivot (side 0).
        sides = judged.where((whole == 1) | (F.col("guess") >= 2 * least - 1 - SLACK))
        across.append(sides.select("leader", "doc_id", "n", F.lit(turn).alias("turn"), whole.alias("side")))
        left = judged.where(whole == 0).select("leader", "doc_id", "n")
    if across:
        places.append(_across(reduce(DataFrame.unionByName, across)))
        other = reduce(DataFrame.unionByName, pairs).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        places.append(other.select("leader", "doc_id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    return reduce(DataFrame.unionByName, places), links


def _across(members: DataFrame) -> DataFrame:
    """Rows of PLACE that bring each block of side 0 together with each of side 1; `turn` keeps them apart from other blocks."""
    dealt, sizes = in_blocks(members, ["leader", "turn", "side"])
    opposite = sizes.select("leader", "turn", (1 - F.col("side")).alias("side"), F.col("blocks").alias("opposite"))
    met = dealt.join(opposite, ["leader", "turn", "side"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("opposite") - 1)))
    mine, first = F.col("side") == 0, F.shiftleft("turn", 24)
    return met.select(
        "leader", "doc_id", F.col("side").alias("own"),
        (F.when(mine, F.col("own")).otherwise(F.col("other")) + first).alias("i"), (F.when(mine, F.col("other")).otherwise(F.col("own")) + 2 * first).alias("j"),
    )


def _sides(group: list[tuple]) -> tuple[list[tuple], dict[int, list[tuple[int, np.ndarray]]]]:
    """The pivot's rows of a group (own 0), and the sets (n, values) of each other document; an id that rows share may have several."""
    others: dict[int, list[tuple[int, np.ndarray]]] = {}
    for own, doc_id, n, values in group:
        if own:
            others.setdefault(doc_id, []).append((n, values))
    return [g for g in group if g[0] == 0], others


def _to_pivot(key: tuple, group: list[tuple]) -> Iterator[tuple]:
    """The estimated similarity of each of a group to its pivot."""
    pivot, others = _sides(group)
    for doc_id, sets in others.items() if pivot else ():
        yield key[0], doc_id, 1, key[1], key[2], max(n for n, _ in sets), max(estimate(values, p[3]) for _, values in sets for p in pivot)


def _linked_to_pivot(percent: int) -> Callable:
    """Who is linked to the pivot, and whether (1) all sets of that id are, so that it is settled."""

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def work(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        pivot, others = _sides(group)
        for doc_id, sets in others.items() if pivot else ():
            held = [any(linked(values, p[3]) for p in pivot) for _, values in sets]
            if any(held):
                yield key[0], doc_id, pivot[0][1], int(all(held))

    return work


def by_group(rows: DataFrame, work: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run `work` on the rows (own, doc_id, n, values) of each (leader, i, j); each task streams through its groups."""
    keys = ["leader", "i", "j"]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            values = batch.column(6)
            for row in range(batch.num_rows):
                key = tuple(c[row].as_py() for c in columns[:3])
                if key != at:
                    out += work(at, group) if len(group) > 1 else []
                    at, group = key, []
                group.append((*(c[row].as_py() for c in columns[3:]), np.frombuffer(values[row].as_py(), np.uint64)))
            if out:
                yield _batch(out, fields, kinds)
                out = []
        out += work(at, group) if len(group) > 1 else []
        if out:
            yield _batch(out, fields, kinds)

    rows = rows.select(*keys, "own", "doc_id", "n", "values")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(streamed, schema)


def _batch(rows: list[tuple], fields: list, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes of a list of sorted distinct arrays."""
    n = len(sets)
    if n <= 4:
        out = np.zeros((n, n), np.float32)
        for a in range(n):
            for b in range(a + 1, n):
                both = np.concatenate([sets[a], sets[b]])
                both.sort(kind="stable")
                out[a, b] = out[b, a] = np.count_nonzero(both[1:] == both[:-1])
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    many = np.diff(np.r_[starts, len(values)])
    shared = np.repeat(many > 1, many)  # what one set alone holds adds nothing
    column = np.cumsum(np.repeat(many > 1, many) & np.r_[True, values[1:] != values[:-1]])[shared] - 1
    owner = owner[shared]
    out = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, CHUNK):
        low, high = np.searchsorted(column, [start, start + CHUNK])
        dense = np.zeros((n, min(CHUNK, total - start)), np.float32)
        dense[owner[low:high], column[low:high] - start] = 1
        out += dense @ dense.T
    return out


def _apart(key: tuple, group: list[tuple]) -> np.ndarray:
    """Which pairs (a < b) a group compares: across its two blocks, or within one."""
    n = len(group)
    upper = np.triu(np.ones((n, n), bool), 1)
    if key[1] != key[2]:
        own = np.array([g[0] for g in group])
        upper &= own[:, None] != own[None, :]
    return upper


def promising(threshold: float) -> Callable:
    """Who in a group has an estimate near the threshold, from the union sketches of the pairs."""

    def work(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        sizes = np.array([g[2] for g in group], np.float64)
        kept = [g[3] for g in group]
        held = np.array([len(s) for s in kept], np.float32)
        common = overlaps(kept)
        least = np.minimum(held[:, None], held[None, :])
        # Common sketch values are no more than the common values of the union sketch need.
        pairs = _apart(key, group) & (common >= (threshold - SLACK) * least * 0.8)
        pairs &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes)
        seen: set[int] = set()
        for a, b in zip(*np.nonzero(pairs), strict=True):
            if (a not in seen or b not in seen) and estimate(kept[a], kept[b]) >= threshold - SLACK:
                seen |= {a, b}
        for k in seen:
            yield key[0], group[k][1], group[k][0], key[1], key[2]

    return work


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by the sketch of their union: the share of its values that both hold."""
    union = np.union1d(a, b)[:SKETCH]
    if len(a) == SKETCH or len(b) == SKETCH:
        top = min(x[-1] for x in (a, b) if len(x) == SKETCH)
        union = union[union <= top]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def links(percent: int) -> Callable:
    """A spanning forest, made of stars, of the graph of pairs whose exact similarity is at least `percent` in a hundred."""

    def work(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        group = sorted(group, key=lambda g: g[1])  # the least id of a tree is its root
        sizes = np.array([len(g[3]) for g in group], np.int64)
        common = overlaps([g[3] for g in group]).astype(np.int64)
        union = sizes[:, None] + sizes - common
        root = list(range(len(group)))
        for a, b in zip(*np.nonzero(_apart(key, group) & (100 * common >= percent * union)), strict=True):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
        for k, r in enumerate(root):
            root[k] = root[r]
            if k != r:
                yield group[k][1], group[root[k]][1]

    return work


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b) reaches.

    Alternates large-star and small-star steps until only stars are left, which
    may be so from the start; each step is written to the shared folder. The star
    of a large component is dealt to several tasks.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(both)
    while True:
        sides = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(sides.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
        # Stars: who has a lesser neighbour has no other one.
        if least.where("low < a and n > 1").isEmpty():
            return least.select(F.col("a").alias("node"), F.least("a", "low").alias("component"))
        least = least.select("a", F.least("a", "low").alias("low"), "n")
        large = join_spread(sides, least, ["a"], F.col("b"), "n").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
        small = join_spread(large, low, ["a"], F.col("b"), "n").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `documents`.

    component_id is the least doc_id that links of at least `percent` per cent
    similarity reach, kept says that it is the row's own. Texts that are null,
    empty or blank have no shingles and no links. Rows with one doc_id count as
    linked. Rows with a null doc_id stand alone: their component_id is null and
    they are kept. Other columns are not read; an empty table gives no rows.
    """
    made = cut_lineage(sketches(documents, width, doc_id, text))
    named = made.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    classes = cut_lineage(classes)
    # Written once: it is read in every round of pivots.
    sketched = cut_lineage(_as_bytes(classes.select("doc_id", "n", F.col("sketch").alias("values"))))
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def full(places: DataFrame) -> DataFrame:
        few = places.count() <= BROADCAST_PLACES
        named = texts.join(F.broadcast(places), "doc_id") if few else likely_in(texts, places, "doc_id").join(places, "doc_id")
        return _full_sets(named.select(*PLACE, "text"), width)

    places, settled = compared(cut_lineage(canopies(classes)), full, sketched, percent)
    near = cut_lineage(by_group(places.join(sketched, "doc_id"), promising(percent / 100), "leader long, doc_id long, own int, i int, j int"))
    found = by_group(full(near), links(percent), "a long, b long")
    edges = reduce(DataFrame.union, [found, *settled, *_same_id(named, classes)])
    reached = components(edges)
    reps = classes.join(reached, F.col("doc_id") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "doc_id").alias("component_id"), "copies")
    joined = join_spread(named.select("doc_id", "n_shingles", "set_a", "set_b"), cut_lineage(reps), ["set_a", "set_b"], F.col("doc_id"), "copies")
    alone = made.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = joined.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(named: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """(a, b): links between the classes that rows with one doc_id belong to; nothing where no such rows are."""
    one = F.struct("set_a", "set_b")
    several = named.groupBy("doc_id").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("n")).where("low <> high").select("doc_id", "low", "n")
    several = cut_lineage(several)
    if several.isEmpty():
        return []
    pairs = join_spread(named.select("doc_id", "set_a", "set_b"), several, ["doc_id"], F.xxhash64("set_a"), "n").select("set_a", "set_b", "low").distinct()
    of = classes.select("set_a", "set_b", F.col("doc_id").alias("rep"))
    first = pairs.join(of, ["set_a", "set_b"]).select(F.col("rep").alias("a"), F.col("low.set_a").alias("set_a"), F.col("low.set_b").alias("set_b"))
    return [first.join(of, ["set_a", "set_b"]).select("a", F.col("rep").alias("b"))]


def _as_bytes(rows: DataFrame) -> DataFrame:
    """`values` as little-endian bytes, the form in which groups are read."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array(v.as_py(), np.int64).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], names=["doc_id", "n", "values"])

    return rows.mapInArrow(packed, "doc_id long, n long, values binary")


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows of PLACE with n and values, the whole set of the text that stands last; made once for equal texts that follow each other."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, values = None, b""
        for batch in batches:
            sets = []
            for body in batch.column(len(PLACE)):
                text = body.as_py()
                if text != last:
                    last, values = text, shingle_set(text, width).tobytes()
                sets.append(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(PLACE)], pa.array([len(v) // 8 for v in sets], pa.int64()), pa.array(sets, pa.binary())], names=[*PLACE, "n", "values"]
            )

    return texts.mapInArrow(made, "leader long, doc_id long, own int, i int, j int, n long, values binary")
