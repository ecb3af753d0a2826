"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents of its own partition as they stream by; nothing
is shuffled. Whole windows are cut from a document's front. What is left over
is routed to a tier by length (a tier takes what fills more than half of it).
Each tier is packed longest first into its windows; the gaps of the windows of
a tier are filled from the shorter tiers, cutting the last piece to size. When
a pool has gathered enough it is packed; leftovers join the next pool, and the
partition's last sequences are cut into powers of two, which need no padding.

Step groups: all sequences, longest first, are dealt in turn to as many groups
as it takes to hold `step_tokens` tokens each. So any two groups differ by at most
one window, and hold as many sequences of every tier give or take one. Only the
numbers of sequences by task and length are shuffled for that.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Pieces that wait in a task until they are packed together.
POOL = 2048
#: Rows after which a task hands on a batch.
BATCH = 4096
#: Tokens of one step group.
STEP_TOKENS = 1 << 16
#: Sequences that a partition may number.
PER_PARTITION = 1 << 33

#: White space of this length goes the exact way: the fast encoder gives up on very long runs.
LONG_BLANK = 10_000
#: Rows (task, length, sequences before) up to which they are broadcast (24 bytes each).
BROADCAST_ROWS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens int, padding int"
SCHEMA = PIECES + ", step_group long, ids binary"
_long_blank = re.compile(r"(?<!\s)\s{%d}" % LONG_BLANK)


@dataclass(order=True)
class Piece:
    length: int
    doc_id: int | None = field(compare=False)
    start: int = field(compare=False)
    doc_tokens: int = field(compare=False)
    ids: np.ndarray = field(compare=False)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n tokens, and the rest."""
        return (
            Piece(n, self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Piece(self.length - n, self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


class Tokens:
    """Token ids of texts under a byte-level BPE file of the `tokenizers` library.

    Ordinary text goes through tiktoken on the same vocabulary when its ranks are
    given: the ids are the same (tested), and it is four times faster.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special) and not (len(text) >= LONG_BLANK and _long_blank.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def public_tokenizer() -> dict[str, str]:
    """Where the vocabulary of the contract lies, as a library's file and as tiktoken ranks."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


_tokens: dict[tuple, Tokens] = {}


def tokens_for(vocabulary: str, ranks: str | None, pattern: str | None) -> Tokens:
    """One tokenizer for each worker process."""
    if (key := (vocabulary, ranks, pattern)) not in _tokens:
        _tokens[key] = Tokens(*key)
    return _tokens[key]


class Packer:
    """Packs pieces into sequences of one of the tiers' lengths; each sequence is a list of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers = sorted(set(tiers), reverse=True)

    def tier_of(self, length: int) -> int:
        """The shortest tier that holds `length` tokens."""
        return next(t for t in reversed(self.tiers) if length <= t)

    def pack(self, pool: list[Piece]) -> tuple[list[list[Piece]], list[Piece]]:
        """Full sequences, and the pieces that fill none."""
        waiting = sorted(pool)
        done: list[list[Piece]] = []
        for tier in self.tiers:
            while waiting and self.tier_of(waiting[-1].length) == tier:
                sequence = [waiting.pop()]
                gap = tier - sequence[0].length
                while gap and waiting:
                    # The longest piece that fits; if all are longer, the shortest is cut.
                    at = bisect_right(waiting, gap, key=lambda p: p.length) - 1
                    piece = waiting.pop(max(at, 0))
                    if piece.length > gap:
                        piece, rest = piece.cut(gap)
                        waiting.insert(bisect_right(waiting, rest.length, key=lambda p: p.length), rest)
                    sequence.append(piece)
                    gap -= piece.length
                if gap:
                    return done, sequence
                done.append(sequence)
        return done, []

    def finish(self, left: list[Piece]) -> list[list[Piece]]:
        """The last pieces (less than one window in all) in sequences whose lengths are powers of two."""
        done: list[list[Piece]] = []
        total = sum(p.length for p in left)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            sequence: list[Piece] = []
            while room:
                piece = left.pop(0)
                if piece.length > room:
                    piece, rest = piece.cut(room)
                    left.insert(0, rest)
                sequence.append(piece)
                room -= piece.length
            done.append(sequence)
        return done


def pack_documents(
    documents: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    pool: int = POOL,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document, as in SCHEMA; `ids` (left out on request) holds its token ids as little-endian uint32.

    vocabulary: a tokenizer file. ranks and pattern: the same vocabulary for tiktoken.
    A document is its token ids and END_ID. Null texts are empty: one token.
    Null doc_ids are kept as null; repeated rows are packed each by themselves.
    Very long texts are cut into whole windows first. Other columns are not
    read. An empty table gives no pieces.
    """
    if step_tokens < 1:
        raise ValueError("step_tokens must be positive")
    ids_column = ", ids binary" if with_ids else ""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, rows = tokens_for(vocabulary, ranks, pattern), Packer(tiers), Rows(tiers, with_ids)
        longest, waiting = packer.tiers[0], []
        for batch in batches:
            for ident, body in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(tokens.ids(body.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                piece = Piece(len(ids), ident.as_py(), 0, len(ids), ids)
                while piece.length > longest:
                    window, piece = piece.cut(longest)
                    rows.add([window])
                    if len(rows) >= BATCH:
                        yield rows.flush()
                waiting.append(piece)
                if len(waiting) >= pool:
                    full, waiting = packer.pack(waiting)
                    for sequence in full:
                        rows.add(sequence)
                if len(rows) >= BATCH:
                    yield rows.flush()
        full, waiting = packer.pack(waiting)
        for sequence in [*full, *packer.finish(waiting)]:
            rows.add(sequence)
        if len(rows):
            yield rows.flush()

    pieces = documents.select(doc_id, text).mapInArrow(packed, f"{PIECES}, place long{ids_column}")
    return _in_steps(cut_lineage(pieces), step_tokens)


def _in_steps(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Replace `place`, a sequence's place among those of its task and length, by `step_group`."""
    task = F.expr(f"sequence_id div {PER_PARTITION}").alias("task")
    counts = pieces.where("offset = 0").groupBy(task, "sequence_tokens").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("sequence_tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("sequence_tokens")).collect()  # powers of two
    groups = max(1, -(-sum(r["sequence_tokens"] * r["n"] for r in lengths) // step_tokens))
    longer = F.lit(0).cast("long")
    for k, r in enumerate(lengths):
        longer = F.when(F.col("sequence_tokens") == r["sequence_tokens"], F.lit(sum(x["n"] for x in lengths[:k]))).otherwise(longer)
    before = counts.select(F.col("task"), F.col("sequence_tokens"), F.expr("sum(n) over (partition by sequence_tokens order by task) - n").alias("before"))
    small = counts.count() <= BROADCAST_ROWS
    joined = pieces.withColumn("task", task).join(F.broadcast(before) if small else before, ["task", "sequence_tokens"])
    dealt = joined.withColumn("step_group", F.pmod(longer + F.col("before") + F.col("place"), F.lit(groups)).cast("long"))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return dealt.select(*[n for n in names if n in dealt.columns])


class Rows:
    """Numbers sequences and turns their pieces into record batches."""

    def __init__(self, tiers: tuple[int, ...], with_ids: bool):
        self.tiers, self.with_ids = sorted(tiers), with_ids
        self.first = TaskContext.get().partitionId() * PER_PARTITION
        self.sequences = 0
        self.of_length: dict[int, int] = {}
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        fields = [f.split() for f in (PIECES + ", place long" + ", ids binary" * with_ids).split(", ")]
        self.schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        self.columns: list[list] = [[] for _ in self.schema]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, sequence: list[Piece]) -> None:
        total = sum(p.length for p in sequence)
        tier = next(t for t in self.tiers if total <= t)
        place = self.of_length.get(total, 0)
        self.of_length[total] = place + 1
        offset = 0
        for p in sequence:
            raw = p.ids.tobytes()
            row = [p.doc_id, p.start, p.length, zlib.crc32(raw), p.doc_tokens, self.first + self.sequences, offset, tier, total, 0, place]
            for column, value in zip(self.columns, [*row, raw] if self.with_ids else row, strict=True):
                column.append(value)
            offset += p.length
        self.sequences += 1

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return batch
