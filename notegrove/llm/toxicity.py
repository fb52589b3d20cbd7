"""Toxicity: a chain of linear classifiers over the words of a text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import small_batches

#: Labelled rows of each label that the chain is fitted on, and characters of their texts, at most: those first by a hash of
#: doc_id.
FIT_ROWS, FIT_CHARS = 3000, 24_000_000
#: Signs that a model looks at, and the share of texts (three at least) that must have a sign: the words of one text and
#: its near copies tell nothing.
VOCABULARY, LEAST_SHARE = 1000, 1 / 300
#: Lengths of the word beginnings that are signs beside whole words: stems with endings of their own.
STEMS = range(4, 9)
#: Words whose signs a worker remembers.
CACHED_WORDS = 400_000
FOLDS, STEPS, PENALTY = 3, 150, 0.5
#: From this probability of the last category on a text is toxic.
CUT = 0.35

# General English words that name the first categories. A labelled toxic text with such a word is an
# example of its category, which its model has to tell from the other words: those that define it are hidden from it. The
# last category is the label itself, and its model sees all words.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "scum", "fool", "jerk", "imbecile", "coward", "liar", "pig"),
    "contempt": ("stupid", "trash", "pathetic", "worthless", "disgusting", "garbage", "useless", "dumb", "vile", "filthy"),
}
CATEGORIES = (*SEEDS, "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def signs_of(words: set[str]) -> set[str]:
    """The words, each beginning of one of them (`x-`), and each beginning of two or more of them (`x--`)."""
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) >= n)
    return words | {f"{s}-" for s in stems} | {f"{s}--" for s, n in stems.items() if n > 1}


def defining(category: str) -> set[str]:
    """The signs that tell of a category's seeds."""
    return signs_of(set(SEEDS.get(category, ()))) | {f"{w[:n]}--" for w in SEEDS.get(category, ()) for n in STEMS}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Penalised logistic regressions by accelerated gradient steps, one for each column of weight (rows that a regression
    leaves out weigh 0), so that all read x together; the last column of x is constant and free."""
    weight, y, total = weight.astype(np.float32), y.astype(np.float32)[:, None], weight.sum(axis=0).astype(np.float32)
    penalty = np.repeat(PENALTY / total[None, :], x.shape[1], axis=0).astype(np.float32)
    penalty[-1] = 0.0
    steepest = np.ones((x.shape[1], len(total)), np.float32)
    for _ in range(15):  # power iteration for the largest curvature
        steepest = x.T @ (weight * (x @ steepest)) / total
        curvature = np.linalg.norm(steepest, axis=0)
        steepest /= curvature
    step = (1 / (0.3 * curvature + PENALTY / total)).astype(np.float32)
    w = v = np.zeros((x.shape[1], len(total)), np.float32)
    for k in range(STEPS):
        slope = x.T @ (weight * (_sigmoid(x @ v) - y)) / total + penalty * v
        after = v - step * slope
        w, v = after, after + np.float32(k / (k + 3)) * (after - w)
    return w


@dataclass
class Chain:
    """signs: column of a sign. models: for each category its weights on signs, on the categories before it, and 1."""

    signs: dict[str, int]
    models: list[np.ndarray]
    _known: dict[str, tuple] = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Chain | None:
        """None unless both labels occur. Equal texts count once."""
        first = {t: i for i, t in reversed([*enumerate(texts)])}
        rows = sorted(first.values())
        toxic, weight = toxic[rows].astype(float), weight[rows]
        if len({*toxic}) < 2:
            return None
        bags = [words_of(texts[i]) for i in rows]
        vocabulary = cls._telling(bags, toxic)
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, bag in enumerate(bags):
            x[i, [vocabulary[w] for w in signs_of(bag) & vocabulary.keys()]] = 1
        goals = [toxic * np.array([bool(bag.intersection(SEEDS[c])) for bag in bags]) for c in SEEDS] + [toxic]
        # by text, so that near equal sizes and no order of rows matter
        fold = np.argsort(np.argsort([hash_text(texts[i]) for i in rows])) % FOLDS
        before, models = np.zeros((len(rows), 0), np.float32), []
        one = np.ones((len(rows), 1), np.float32)
        for category, y in zip(CATEGORIES, goals, strict=True):
            hidden = defining(category)
            shown = np.array([s not in hidden for s in vocabulary], bool)
            full = np.hstack([x * shown, before, one])
            fits = _fit_linear(full, y, weight[:, None] * np.column_stack([*(fold != k for k in range(FOLDS)), np.ones(len(rows))]))
            apart = _sigmoid(np.einsum("ij,ij->i", full, fits.T[fold]))  # by the fit that left the row out
            models.append(fits[:, -1].copy())
            before = np.hstack([before, apart[:, None]])
        return cls(vocabulary, models)

    @staticmethod
    def _telling(bags: list[set[str]], toxic: np.ndarray) -> dict[str, int]:
        """The signs whose share of toxic texts differs most from the share among all, by a z score."""
        n, hits = Counter(), Counter()  # the signs of one text at a time: those of all don't fit in a driver
        for bag, y in zip(bags, toxic, strict=True):
            signs = signs_of(bag)
            n.update(signs)
            if y:
                hits.update(signs)
        p, least = toxic.mean(), max(3, LEAST_SHARE * len(bags))
        z = {w: abs(hits[w] - k * p) / np.sqrt(k * p * (1 - p)) for w, k in n.items() if k >= least}
        return {w: i for i, w in enumerate(sorted(z, key=lambda w: (-z[w], w))[:VOCABULARY])}

    def _columns(self, word: str) -> tuple[list[int], tuple[str, ...]] | tuple[()]:
        """A word's own columns, and its beginnings that are signs."""
        own = [self.signs[word]] if word in self.signs else []
        stems = tuple(s for n in STEMS if len(word) >= n and ((s := word[:n]) + "-" in self.signs or s + "--" in self.signs))
        if len(self._known) >= CACHED_WORDS:
            self._known.clear()
        entry = self._known[word] = (own, stems) if own or stems else ()
        return entry

    def probabilities(self, text: str) -> list[float]:
        known, at, stems = self._known, set(), Counter()
        for w in words_of(text):
            entry = known.get(w)
            if entry is None:
                entry = self._columns(w)
            if entry:
                at.update(entry[0])
                stems.update(entry[1])
        stem_signs = [s + "-" for s in stems] + [s + "--" for s, n in stems.items() if n > 1]
        at = sorted(at | {self.signs[s] for s in stem_signs if s in self.signs})
        n, found = len(self.signs), []
        for model in self.models:
            z = model[at].sum() + sum(p * w for p, w in zip(found, model[n:-1], strict=True)) + model[-1]
            found.append(float(_sigmoid(z)))
        return found


def hash_text(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Chain | None:
    """Fitted on at most fit_rows rows of each label, the first by a hash of doc_id, as far as they have FIT_CHARS characters
    together; each label weighs as it does among all labels. The rows' ids are broadcast: they are bounded by fit_rows.
    Repeated rows count once: of labels one, of documents that whose text has the least hash."""
    known = labels.filter(F.col("toxic").isin(0, 1)).selectExpr("cast(doc_id as bigint) as doc_id", "cast(toxic as int) as toxic").dropDuplicates(["doc_id"])
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in share:
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    if len(share) < 2:
        return None
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").dropna()
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # over fit_rows rows at most
    some = once.withColumn("chars", F.sum(F.length("text")).over(first)).filter(F.col("chars") <= FIT_CHARS)
    rows = sorted(some.collect(), key=lambda r: (r["doc_id"], r["text"]))
    toxic = np.array([r["toxic"] for r in rows])
    weight = np.array([share[y] / max(1, (toxic == y).sum()) for y in toxic], float)
    return Chain.fit([r["text"] for r in rows], toxic, weight / weight.mean() if len(weight) else weight)


def score(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, p_insult, p_contempt, p_toxic and toxic (p_toxic >= CUT) of every whole text. Other columns of docs are
    ignored. A null or empty text has no words: its probabilities are
    those of the intercepts. Texts of any length are read whole. Without examples of both labels every probability is 0. Repeated rows give repeated rows."""
    small_batches(docs.sparkSession)
    chain = fit(docs, labels, text)

    def run(batches):
        for batch in batches:
            found = np.array([chain.probabilities(t or "") if chain else [0.0] * 3 for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            toxic = pa.array(found[:, 2] >= CUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T), toxic], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text is toxic; every column and every other row stays as it is. The verdict of a row
    is worked out where the row is: nothing is shuffled."""
    small_batches(docs.sparkSession)
    chain = fit(docs, labels, text)
    column = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = [not (chain and t and chain.probabilities(t)[2] >= CUT) for t in batch.column(column).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
