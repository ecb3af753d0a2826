import random
import zlib

import numpy as np
import pytest

from sightline.llm import catalogue, packing

from ..conftest import DATA
from . import awkward


@pytest.fixture(scope="module")
def exact():
    return packing.Tokens(packing.public_tokenizer()["vocabulary"])


def verify(rows, texts, exact):
    """Whether pieces cover every document once and sequences are well formed; gives the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.append(exact.exact.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0).astype("<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_query_by_brute_force(spark, exact):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    assert verify(catalogue.op8_packing(spark, f"{DATA}/sf0.01").collect(), texts, exact) == 0


def test_awkward_rows(spark, exact):
    docs = awkward.crowded(spark).where("doc_id is null or doc_id <> 10")
    rows = packing.pack_documents(docs, **packing.public_tokenizer()).collect()
    assert verify(rows, {r[0]: r[1] for r in awkward.ROWS if r[0] != 10}, exact) == 0
    twice = packing.pack_documents(awkward.documents(spark).where("doc_id = 10"), **packing.public_tokenizer()).collect()
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    assert packing.pack_documents(awkward.empty(spark), **packing.public_tokenizer()).isEmpty()


def test_fast_tokens_are_the_exact_ones(exact):
    fast = packing.Tokens(**packing.public_tokenizer())
    draw = random.Random(1)
    alphabet = "abc XYZ 0129 .,!'s  \n\t é漢😀ß́_<|endoftext|> "
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 80))) for _ in range(1500)] + ["<|endoftext|>", "a<|endoftext|> b", "", " ", "don't  stop\r\n\r\n"]
    for t in texts:
        assert list(fast.ids(t)) == exact.exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_packer_fills_every_window(seed):
    draw = random.Random(seed)
    packer = packing.Packer((64, 32, 16))
    pool = []
    for d in range(draw.randint(0, 60)):
        n = draw.randint(1, 64)
        pool.append(packing.Piece(n, d, 0, n, np.full(n, d)))
    total = sum(p.length for p in pool)
    full, left = packer.pack(pool)
    assert all(sum(p.length for p in s) in (64, 32, 16) for s in full)
    assert sum(p.length for p in left) < 64
    last = packer.finish(list(left))
    sizes = [sum(p.length for p in s) for s in [*full, *last]]
    assert sum(sizes) == total and all(s & (s - 1) == 0 for s in sizes)


def test_tiers_are_checked():
    for bad in ((), (1000,), (0,)):
        with pytest.raises(ValueError):
            packing.Packer(bad)


@pytest.mark.parametrize("tasks", [1, 7])
def test_step_groups_are_balanced(spark, tasks):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").repartition(tasks, "doc_id")
    rows = packing.pack_documents(docs, step_tokens=8192, **packing.public_tokenizer()).toPandas()
    sequences = rows.drop_duplicates("sequence_id")
    total = sequences["sequence_tokens"].sum()
    sums = sequences.groupby("step_group")["sequence_tokens"].sum()
    assert list(sums.index) == list(range(-(-total // 8192)))
    assert sums.max() - sums.min() <= 1024 and sums.max() <= 8192 + 1024
    for _, one in sequences.groupby("sequence_tokens"):
        held = one["step_group"].value_counts().reindex(sums.index, fill_value=0)
        assert held.max() - held.min() <= 1


@pytest.mark.parametrize("blank", [" ", "\n", " \n", "\t", "\u3000"])
def test_very_long_blanks(spark, exact, blank):
    fast = packing.Tokens(**packing.public_tokenizer())
    for text in (blank * (2_000_000 // len(blank)), "a" + blank * 12_000 + "b. " + blank * 600_000, "x" * 30_000 + blank * 9_999 + "y"):
        assert list(fast.ids(text)) == exact.exact.encode(text, add_special_tokens=False).ids


def test_ids_on_request(spark):
    docs = awkward.documents(spark)
    whole, bare = (packing.pack_documents(docs, with_ids=on, **packing.public_tokenizer()) for on in (True, False))
    assert [f.name for f in whole.schema] == [*[f.name for f in bare.schema], "ids"]
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in whole.collect())
