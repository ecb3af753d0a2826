"""Language identification with error-correcting output codes.

Each language has a codeword. For every bit of the code a binary classifier over
byte 3-grams (naive Bayes log odds, every language weighing the same) tells the
languages with a one from those with a zero. A text's margins are decoded to
the codeword with the least logistic loss, every bit weighed by how well it
told the training languages apart.

The counts behind the classifiers come from all labelled rows, each of the same
weight; a prediction reads the whole text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
GRAMS = 1 << 16
#: Bits of the code when there are too many languages for all splits.
LONG_CODE = 31
SMOOTHING = 0.5
#: Characters after which more text adds no more certainty.
ENOUGH = 120.0
#: A decision whose score is below this is flagged as ambiguous.
CLEAR = 0.6
PIECE = 1 << 18

_blank = bytes(32 if b < 128 and not chr(b).isalpha() else (b | 32 if 65 <= b <= 90 else b) for b in range(256))


def gram_ids(text: str) -> np.ndarray:
    """Hashed byte 3-grams of a text; ASCII other than letters counts as a blank, A-Z as a-z."""
    raw = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_blank).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages while these are few, else random ones far apart."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 6:
        splits = list(itertools.product([1, -1], repeat=n - 1))[1:]
        return np.array([[1] * len(splits), *zip(*splits, strict=True)], float)
    draw = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (n, LONG_CODE))
        code[0, np.abs(code.sum(0)) == n] *= -1
        nearest = ((LONG_CODE - code @ code.T) / 2 + LONG_CODE * np.eye(n)).min()
        if nearest > far:
            best, far = code, nearest
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        """The mean log odds of each bit over all 3-grams of the text, and their number."""
        ids = gram_ids(text)
        total = np.zeros(self.code.shape[1])
        for start in range(0, len(ids), PIECE):
            total += self.weights[ids[start : start + PIECE]].sum(0, dtype=np.float64)
        return total / max(1, len(ids)), len(ids)

    def decode(self, margins: np.ndarray, n: int) -> tuple[str, float]:
        """The language of the nearest codeword, and how likely it is against all others."""
        sure = margins * min(n, ENOUGH) ** 0.5 / 4
        loss = np.logaddexp(0, -self.code * sure) @ self.bit_weights
        likely = np.exp(-(loss - loss.min()) * 2 / self.code.shape[1])
        return self.languages[int(loss.argmin())], float(likely.max() / likely.sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        return self.decode(*self.margins(text))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit the code to labelled rows; those with a null text or language are left out. Without any the model knows no language."""
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((GRAMS, 1), np.float32), np.ones(1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for body, name in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                ids = gram_ids(body)
                # Long texts speak no louder than others.
                counts = seen.setdefault(name, np.zeros(GRAMS))
                if len(ids) < PIECE:
                    np.add.at(counts, ids, 1 / max(1, len(ids)))
                else:
                    counts += np.bincount(ids, minlength=GRAMS) / len(ids)
        for name, counts in seen.items():
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(held)), pa.array(held, pa.int32()), pa.array(counts[held])], names=["lang", "gram", "n"]
            )

    grams = known.mapInArrow(counted, "lang string, gram int, n double")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # GRAMS rows for each language at most
    counts = np.zeros((len(languages), GRAMS))
    np.add.at(counts, (table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(int), table["gram"].to_numpy(int)), table["n"].to_numpy())
    counts = np.round(counts, 6)  # the order of summing leaves no trace
    rates = (counts / np.maximum(counts.sum(1, keepdims=True), 1e-9) * 1e5 + SMOOTHING) / (1e5 + SMOOTHING * GRAMS)
    code = codewords(len(languages))
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    of = lambda side: (side.T @ rates) / np.maximum(side.sum(0)[:, None], 1)
    odds = np.log(np.maximum(of(ones), 1e-12)) - np.log(np.maximum(of(zeros), 1e-12)) if len(languages) > 1 else np.zeros((code.shape[1], GRAMS))
    apart = (rates @ odds.T) * code  # the mean margin of each language on each bit, in its own direction
    bit_weights = np.maximum(apart.min(0), 1e-3)
    return Model(languages, code, odds.T.astype(np.float32), bit_weights / bit_weights.mean())


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and ambiguous to every row.

    Null texts and texts without a letter are `und` with score 0, as is every
    text under a model without languages. Columns of `documents` with the new names
    are replaced, all others pass through unread; repeated rows get equal
    predictions. An empty table gives no rows.
    """
    new = ("lang_pred", "score", "ambiguous")
    kept = documents.select(*[c for c in documents.columns if c.lower() not in new])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # GRAMS x bits floats
    blank = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(body.as_py()) for body in batch[text]]
            columns = [*batch.columns[:-3], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            columns.append(pa.array([f[1] < CLEAR for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return blank.mapInArrow(predicted, blank.schema)


def bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))
