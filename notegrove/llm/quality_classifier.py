"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, written
from .quality_rules import STOP_WORDS

FEATURES = ("length", "word_length", "repetition", "symbols", "capitals", "digits", "exclamations", "repeated_lines", "stop_words")
#: Share of the pooled covariance in a class's own, and share of a round covariance in the result.
POOLED, ROUND = 0.2, 0.02
#: A score from here on predicts label 1.
CUT = 0.7
_STOPS = frozenset(STOP_WORDS)
_UPPER, _DIGIT, _SYMBOL = slice(65, 91), slice(48, 58), [ord(c) for c in "#*$%&|<>"]


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text. Logarithms of smoothed rates: a short text stays near what is usual."""
    raw = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, own = len(words), set(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    log = np.log
    return [
        log(n + 1.0),
        log((sum(map(len, own)) + 50.0) / (len(own) + 10.0)),
        log((n + 10.0) / (len(own) + 10.0)) / log(n + 20.0),
        log((byte[_SYMBOL].sum() + 0.5) / (n + 20.0)),
        log((byte[_UPPER].sum() + 2.0) / (len(raw) + 120.0)),
        log((byte[_DIGIT].sum() + 2.0) / (len(raw) + 500.0)),
        log((byte[33] + 0.5) / (n + 50.0)),
        log((len(lines) - len(set(lines)) + 0.2) / (len(lines) + 4.0)),
        log((len(own & _STOPS) + 2.0) / (min(len(own), 60) + 6.0)),
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and FEATURES of every whole text; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], names=["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, schema)


@dataclass
class Discriminant:
    """For classes 0 and 1: mean, inverse of the Cholesky factor, and the log density's constant."""

    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | None:
        """From the classes' row counts, sums and sums of products; None unless both have two rows."""
        if counts.min() < 2:
            return None
        means = sums / counts[:, None]
        own = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.tensordot(counts / counts.sum(), own, 1)
        d = pooled.shape[0]
        scale = np.sqrt(np.diag(pooled) + 1e-9)
        whiteners, constants = [], []
        for c in range(2):
            mixed = (1 - POOLED) * own[c] + POOLED * pooled
            near_round = (1 - ROUND) * mixed + ROUND * np.diag(scale**2)
            factor = np.linalg.cholesky(near_round)
            whiteners.append(np.linalg.solve(factor, np.eye(d)))
            constants.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(whiteners), np.array(constants))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        density = [k - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, k in zip(self.means, self.whiteners, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(found: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Over all rows of labels whose doc_id may be learned from: Spark sums counts, values and products by class, so
    only a fixed number of sums reaches the driver. Labels other than 0 and 1, and null ones, are left out; repeated rows of
    labels count once."""
    learn = labels.filter(~held_out() & F.col("quality").isin(0, 1)).selectExpr("cast(doc_id as bigint) as doc_id", "cast(quality as int) as quality").distinct()
    pairs = [*combinations_with_replacement(FEATURES, 2)]
    sums = [F.sum(f).alias(f) for f in FEATURES] + [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]
    by_class = {r["quality"]: r for r in found.join(learn, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *sums).collect()}
    if len(by_class) < 2:
        return None
    d = len(FEATURES)
    counts, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c, row in by_class.items():
        counts[c], first[c] = row["n"], [row[f] for f in FEATURES]
        for a, b in pairs:
            i, j = FEATURES.index(a), FEATURES.index(b)
            second[c, i, j] = second[c, j, i] = row[f"{a}*{b}"]
    return Discriminant.fit(counts, first, second)


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every whole text. Only statistics of
    the text enter a score. Null and empty texts have the statistics of an empty text. Without two learnable rows of
    each label every score is 0.5. Other columns are ignored; repeated rows of docs give repeated rows."""
    found = written(features(docs, text), "quality-features")
    model = fit(found, labels)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = found.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
