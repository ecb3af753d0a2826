"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words. A window is a run of `window`
consecutive words of a benchmark text; a shorter text is one window. Windows
are made and freed of repeats by Spark. All go into one automaton, which scans
the words of a document once and reports every occurrence. Hits are given as word
ranges and as ranges of characters of the original text.

The automaton is built from at most about `block_bytes` of windows. A larger
benchmark is dealt by hash into several blocks, each scanned in its own narrow
pass over the documents that adds to the ranges of the passes before. Nothing is
left out, and no pass shuffles documents.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

WINDOW = 10
#: Bytes of windows in one automaton; it takes about 40 times that in a worker.
BLOCK_BYTES = 4 << 20
#: Columns that find_leaks adds.
ADDED = ("n_words", "hit_ranges", "hit_chars", "leaked_items")

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_built: dict[str, Scanner] = {}


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text after lower-casing A-Z: runs of digits, letters and non-ASCII characters."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(window, items): each distinct window with the ids, as strings, of the items that have it; null ids name none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(key, ident) for ident, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for key in windows_of(body, window)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], names=["window", "item"])

    each = items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(made, "window binary, item string")
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _blocks(windows: DataFrame, block_bytes: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The windows in blocks of about `block_bytes`, one after another."""
    held = windows.agg(F.sum(F.octet_length("window") + 16 * (1 + F.size("items"))).alias("bytes"), F.count("*").alias("n")).first()
    blocks = min(held["n"], -(-(held["bytes"] or 0) // block_bytes))
    for k in range(blocks):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        yield [(bytes(r["window"]), r["items"]) for r in some.collect()]  # about block_bytes


class Scanner:
    """One automaton over the windows of a block, as bytes of their words with a blank about each."""

    def __init__(self, block: list[tuple[bytes, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        for key, owners in block:
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, len(key) + 2, owners))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The word ranges [from, to) of all occurrences, and the ids of the items that occur."""
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: list[int] = []
        ranges, owners = [], set()
        for end, (n, length, items) in self.automaton.iter(line):
            if not starts:
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            first = bisect_right(starts, end - length + 1) - 1
            ranges.append((first, first + n))
            owners.update(items)
        return merged(ranges), owners


def _scanner(block: Broadcast) -> Scanner | None:
    """Built once in each worker; None without windows."""
    name, found = block.value
    if found and name not in _built:
        _built.clear()
        _built[name] = Scanner(found)
    return _built.get(name)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_ranges(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character offsets [from, to) of the original text."""
    spans = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Every row of `documents` with n_words, hit_ranges and hit_chars (arrays of [from, to) in words and in characters of the text) and leaked_items (sorted).

    Null and wordless texts have no words and no hits; items without words are
    in no window. Windows of an item without an id are found like others, but
    name no item. Repeated documents and items count each by themselves; equal
    windows of several items report all of them. Columns of `documents` named
    like the new ones, in any case, are replaced. With an empty benchmark nothing is hit.
    """
    sc = documents.sparkSession.sparkContext
    columns = [c for c in documents.columns if c.lower() not in ADDED or c == text]
    ranges = F.array().cast("array<array<int>>")
    out = documents.select(*columns, F.lit(0).cast("long").alias("n_words"), ranges.alias("hit_ranges"), ranges.alias("hit_chars"), F.array().cast("array<string>").alias("leaked_items"))
    windows = cut_lineage(benchmark_windows(benchmark, item_id, item_text, window))
    place = out.columns.index(text)
    first = True
    for found in _blocks(windows, block_bytes):
        out = _pass(out, sc.broadcast((uuid.uuid4().hex, found)), place)
        first = False
    return _pass(out, sc.broadcast(("", [])), place) if first else out


def _pass(documents: DataFrame, block: Broadcast, text: int) -> DataFrame:
    """Add what a block's windows hit to the last four columns; `text` is the place of the text."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(block)
        for batch in batches:
            rows = []
            old = zip(batch.column(text), *batch.columns[-3:], strict=True)
            for body, had, chars, ids in old:
                body = body.as_py()
                words = words_of(body)
                ranges, owners = scanner.scan(words) if scanner and words else ([], ())
                if not ranges:
                    rows.append((len(words), had.as_py(), chars.as_py(), ids.as_py()))
                    continue
                ranges = merged([*map(tuple, had.as_py()), *ranges])
                rows.append((len(words), ranges, char_ranges(body, ranges), sorted({*ids.as_py(), *owners})))
            fields = list(batch.schema)[-4:]
            new = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *new], schema=batch.schema)

    return documents.mapInArrow(scanned, documents.schema)


def leak_digest(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_chars from the rows of `find_leaks`."""
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return leaks.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("leaked_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaked_items", ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"), "hit_chars",
    )
