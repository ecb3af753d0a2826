"""Quality classification from positive and unlabelled texts.

A linear score over measures of style and hashed n-grams is fitted to trusted
positives P and unlabelled web text U by minimising the non-negative unbiased risk

    prior * E_P[loss(+)] + max(-tolerance, E_U[loss(-)] - prior * E_P[loss(-)]).

With the squared loss every term is a quadratic in the weights whose coefficients
are mean products of features. So one pass over ALL positives and ALL unlabelled
rows gathers all there is to know: tasks hand on matrices of a fixed size, whatever
the number of rows, and no row is sampled. The minimum is then found on the driver:
in closed form, or where the second term would fall below the tolerance (the chance
error of the positives' means) at the multiplier that holds it there.

The class prior is estimated from P and U alone: it is at most U(A) / P(A) for
every set A. The sets are score ranges of two classifiers that tell P from U, each
fitted to one half of the rows and counted on all rows of the other half. (How rows
fall into batches has a little to do with which half copies of a text are in, and
so with the last digits of the prior and the scores.)
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

THRESHOLD = 0.3
N_MEASURES = 17
#: Buckets of hashed byte 3-grams, and of hashed words.
GRAMS = 32
#: Weights of the two kinds of features beside each other, ridge, and tolerance; chosen by cross-validation, see the README.
MEASURE_WEIGHT, GRAM_WEIGHT = 0.25, 0.5
RIDGE, RIDGE_PER_ROW, TOLERANCE = 3e-3, 1.0, 1.0
WIDTH = N_MEASURES + 2 * GRAMS
#: Slope from the fitted target (-1 to 1) to a score.
SLOPE = 2.1
#: Keys of positives up to which they are broadcast (8 bytes each).
BROADCAST_KEYS = 1_000_000
#: Tasks that add up the matrices of all others.
SUMMING = 32
#: Score ranges of the classifiers that the prior is read off, between -LIMIT and LIMIT.
RANGES, LIMIT = 2000, 4.0

_upper = bytes(range(65, 91))
_digits = bytes(range(48, 58))
_marks = b".,;:'\"-?()"
_symbols = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _marks)


def _share(raw: bytes, dropped: bytes) -> float:
    return 1 - len(raw.translate(None, dropped)) / len(raw)


def measures(text: str | None) -> list[float]:
    """Measures of style of a whole text; of an empty one they are all 0.

    In order: shares of capitals, symbols, marks, digits, white space and
    non-ASCII bytes; repeats of the word before; share of the commonest word;
    distinct words against all and against their root; length; mean word length;
    distinct words whose ASCII letters are all capitals; repeated lines; line length;
    distinct words once case and symbols are gone; words of marks and symbols only.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_MEASURES
    n = len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    size = len(raw)
    return [
        _share(raw, _upper), _share(raw, _symbols), _share(raw, _marks), _share(raw, _digits), _share(raw, b" \t\r\n"),
        1 - len(raw.decode("ascii", "ignore")) / size,
        repeats / n, counts.most_common(1)[0][1] / n, len(counts) / n, len(counts) / math.sqrt(n), math.log1p(n) / 10,
        (size - n) / n / 20, sum(map(bytes.isupper, counts)) / len(counts), 1 - len(set(lines)) / len(lines),
        math.log1p(size / len(lines)) / 10, len({w.strip(_marks + _symbols).lower() for w in counts}) / len(counts),
        sum(k for w, k in counts.items() if not w.strip(_marks + _symbols)) / n,
    ]


def features(text: str | None) -> np.ndarray:
    """The measures, then root frequencies of hashed byte 3-grams and of hashed words, of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    out[:N_MEASURES] = measures(text)
    for start, ids in ((N_MEASURES, _gram_buckets(raw)), (N_MEASURES + GRAMS, _word_buckets(raw))):
        if len(ids):
            out[start : start + GRAMS] = np.sqrt(np.bincount(ids, minlength=GRAMS) / len(ids))
    return out


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed * np.uint32(0x9E3779B1)) >> np.uint32(33 - GRAMS.bit_length())


def _gram_buckets(raw: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    return _bucket(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if raw else b[:0]


def _word_buckets(raw: bytes) -> np.ndarray:
    return _bucket(np.fromiter(map(zlib.crc32, raw.lower().split()), np.uint32))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """How likely rows of features are positive."""
        return 1 / (1 + np.exp(-np.clip(SLOPE * (_inputs(x, self.mean, self.scale) @ self.weights), -30, 30)))


def _inputs(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A one, measures in units of the positives' spread, and n-grams about the positives' mean."""
    z = x - mean
    styles = np.clip(z[:, :N_MEASURES] / scale[:N_MEASURES], -8, 8) * MEASURE_WEIGHT
    return np.concatenate([np.ones((len(x), 1)), styles, z[:, N_MEASURES:] * GRAM_WEIGHT], axis=1)


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """The features of each row's text as an array column `x`, in place of the text, beside its other columns."""
    others = [c for c in rows.columns if c.lower() != "x" and c != text]
    schema = rows.select(*others, F.array().cast("array<float>").alias("x")).schema

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(body.as_py()) for body in batch.column(len(others))], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], x], names=[*others, "x"])

    return rows.select(*others, text).mapInArrow(taken, schema)


def trusted(rows: DataFrame, positives: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is in `positives`."""
    ids = cut_lineage(positives.where(F.col(key).isNotNull()).select(key).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, key, "left_semi")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].values.to_numpy(zero_copy_only=False).reshape(len(batch), WIDTH).astype(float)


def _halves(x: np.ndarray) -> np.ndarray:
    """To which of two halves each row of a batch belongs: by a hash of its features, copies of a text in turn, so that both halves know a common text."""
    met: Counter[int] = Counter()
    half = np.empty(len(x), int)
    for k, row in enumerate(x):
        name = zlib.crc32(row.astype(np.float32).tobytes())
        half[k] = (name + met[name]) & 1
        met[name] += 1
    return half


def _added(rows: DataFrame, shape: tuple[int, ...], of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of arrays of one shape; each task adds up its own, SUMMING tasks those, the driver the last."""
    schema = "total binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = rows.mapInArrow(each, schema).repartition(SUMMING).mapInArrow(again, schema).collect()
    return sum((np.frombuffer(p["total"]).reshape(shape) for p in parts), np.zeros(shape))


def _moments(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """For each half the sum of products of inputs; the first of them is one, so the sums and the count are in it."""

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        half, z = _halves(x), _inputs(x, mean, scale)
        return np.stack([z[half == k].T @ z[half == k] for k in (0, 1)])

    return _added(rows, (2, WIDTH + 1, WIDTH + 1), products)


def _reached(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, classifiers: list[np.ndarray]) -> np.ndarray:
    """How many rows have a score in each range, by the classifier fitted to the half they are not in."""

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        half, z = _halves(x), _inputs(x, mean, scale)
        scores = np.where(half == 0, z @ classifiers[1], z @ classifiers[0])
        # A hair added, so that rows of one text fall together however they were batched.
        at = np.floor((scores + 1e-9 + LIMIT) / (2 * LIMIT) * RANGES)
        return np.bincount(np.clip(at, 0, RANGES - 1).astype(int), minlength=RANGES).astype(float)

    return _added(rows, (RANGES,), counted)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The least ratio of the shares of U and P above a score, from how many rows of each fall in ascending ranges; only where half of P is above."""
    above_p, above_u = (np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in (p, u))
    both = np.cumsum(p + u) / max(1, (p + u).sum())
    # Sixty levels, so that the least of them is not the luckiest of very many.
    levels = np.searchsorted(both, np.linspace(0, 0.95, 60))
    ratios = [above_u[t] / above_p[t] for t in levels if t < len(p) and above_p[t] > 0.5]
    return float(np.clip(min([*ratios, 0.99]), 0.05, 0.99))


def _ridge(n_positive: float) -> np.ndarray:
    ridge = np.full(WIDTH + 1, RIDGE + RIDGE_PER_ROW / n_positive)
    ridge[0] = 0
    return np.diag(ridge + 1e-9)


def minimise(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The weights of least non-negative risk, from sums of products of inputs over P and over U."""
    n = p[0, 0]
    p, u, ridge = p / n, u / u[0, 0], _ridge(n)

    def negative(w: np.ndarray) -> float:
        """E_U[loss(-)] - prior * E_P[loss(-)]; loss(-) is a quarter of (score + 1) squared."""
        return ((w @ u @ w + 2 * w @ u[0] + 1) - prior * (w @ p @ w + 2 * w @ p[0] + 1)) / 4

    def least(share: float) -> np.ndarray:
        """The minimum with the second term weighed by `share`: 1 is the unbiased risk."""
        return np.linalg.solve(share * u / 2 + (1 - share) * prior * p / 2 + ridge, prior * p[0] * (1 + share) / 2 - share * u[0] / 2)

    floor = -TOLERANCE * prior / math.sqrt(n)
    if negative(least(1.0)) >= floor:
        return least(1.0)
    low, high = 0.0, 1.0
    for _ in range(40):
        share = (low + high) / 2
        low, high = (low, share) if negative(least(share)) < floor else (share, high)
    return least(low)


def train(positives: DataFrame, unlabelled: DataFrame) -> Model | None:
    """Fit to the column `x` of two tables (see `measured`), which are read three times and should be cheap to read. None when either is empty."""

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.stack([np.r_[len(x), x.sum(0)], np.r_[len(x), (x * x).sum(0)]])

    first, second = _added(positives.select("x"), (2, WIDTH + 1), sums)
    if not first[0] or unlabelled.isEmpty():
        return None
    mean = first[1:] / first[0]
    scale = np.sqrt(np.maximum(second[1:] / first[0] - mean**2, 0)) + 1e-2
    p, u = (_moments(rows.select("x"), mean, scale) for rows in (positives, unlabelled))
    tell_apart = []
    for k in (0, 1):
        # All rows stand in where one half of the texts has none of a side.
        mine, theirs = (m[k] if m[k][0, 0] else m.sum(0) for m in (p, u))
        a, b = mine / mine[0, 0], theirs / theirs[0, 0]
        tell_apart.append(np.linalg.solve(a + b + 2 * _ridge(first[0]), a[0] - b[0]))
    prior = estimate_prior(*(_reached(rows.select("x"), mean, scale, tell_apart) for rows in (positives, unlabelled)))
    return Model(mean, scale, minimise(p.sum(0), u.sum(0), prior), prior)


def judge_measured(rows: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`judge` for rows that have their features in a last column `x`, which score takes the place of."""
    others = [c for c in rows.columns if c != "x"]
    kept = rows.select(*others, F.lit(0.0).alias("score"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if model else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], schema=batch.schema.remove(len(others)).append(pa.field("score", pa.float64())))

    return rows.select(*others, "x").mapInArrow(scored, kept.schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def judge(documents: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from `threshold` on) to every row.

    A null text is scored as an empty one. Without a model every score is 0.5.
    Columns of `documents` named score or predicted are replaced, all others pass
    through unread; repeated rows get equal scores. An empty table gives no rows.
    """
    kept = documents.select(*[c for c in documents.columns if c.lower() not in ("score", "predicted")], F.lit(0.0).alias("score"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(body.as_py()) for body in batch[text]]).reshape(-1, WIDTH)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], schema=batch.schema)

    return kept.mapInArrow(scored, kept.schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
