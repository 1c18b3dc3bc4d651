"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model over the words and
word beginnings of a text and over the probabilities of the categories before it. While
training, the earlier probabilities come from models that did not see the document
(out-of-fold), so a later model meets the same kind of input as when it predicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import cut, small_batches, utf8

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``max_train_docs`` bounds the labelled rows of each combination of values that are fitted.

    Every feature of these rows is weighed; ``features`` of them, those that chi-square finds to tell
    most, are in each model, and one in fewer than ``least_docs`` documents is not, as it tells nothing
    of others.
    """

    max_train_docs: int = 3_000
    folds: int = 5
    features: int = 3_000
    least_docs: int = 4
    prefixes: tuple[int, ...] = (4, 5)
    penalty: float = 0.3
    steps: int = 300


def number(feature: str) -> int:
    """What stands for a feature while training: 63 bits of a hash, by which the features of a sample are told apart."""
    return xxhash.xxh3_64_intdigest(feature) >> 1


def features_of(raw: bytes | None, prefixes: Sequence[int]) -> set[str]:
    """Words of a text, in lower case, and their first letters marked with a star."""
    words = set(_WORD.findall((raw or b"").decode("utf-8", "replace").lower()))
    return words.union(*({f"{w[:n]}*" for w in words if len(w) >= n} for n in prefixes))


class Sparse:
    """Rows of feature numbers, all with the value 1."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.rows, self.width = rows, width
        self.column = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])

    def take(self, which: np.ndarray) -> Sparse:
        return Sparse([self.rows[k] for k in which], self.width)

    def only(self, columns: np.ndarray) -> Sparse:
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        return Sparse([(p := place[r])[p >= 0] for r in self.rows], len(columns))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], len(self.rows))

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.width)


@dataclass
class Linear:
    """Logistic regression over some of the features and the earlier probabilities."""

    columns: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, x: Sparse, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(x.only(self.columns).times(self.weights) + earlier @ self.dense + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: Sparse, earlier: np.ndarray, y: np.ndarray, settings: Settings) -> Linear:
    """The features that tell the classes apart best (chi-square), then Adam on the penalised log loss."""
    n, positive = len(y), y.sum()
    in_positive, in_all = x.back(y.astype(float)), x.back(np.ones(n))
    expected = in_all * positive / max(n, 1)
    chi = np.where(in_all >= settings.least_docs, (in_positive - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    columns = np.sort(np.argsort(-chi, kind="stable")[: settings.features])
    x = x.only(columns)
    theta = np.zeros(len(columns) + earlier.shape[1] + 1)
    theta[-1] = np.log((positive + 0.5) / (n - positive + 0.5))
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    k = len(columns)
    for step in range(1, settings.steps + 1):
        off = sigmoid(x.times(theta[:k]) + earlier @ theta[k:-1] + theta[-1]) - y
        grad = np.concatenate([x.back(off), earlier.T @ off, [off.sum()]])
        grad[:-1] += settings.penalty * theta[:-1]
        mean = 0.9 * mean + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        theta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Linear(columns, theta[:k], theta[k:-1], float(theta[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest cut that gives the best F1 on out-of-fold probabilities."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][np.diff(p[order]) == 0] = -1  # no cut inside a tie
    at = int(np.argmax(f1))
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(y) else 0.0)) / 2)


@dataclass
class Chain:
    """Fitted models in their order, with the vocabulary and the thresholds."""

    categories: list[str]
    vocabulary: dict
    models: list[Linear]
    thresholds: list[float]
    settings: Settings

    @classmethod
    def fit(cls, rows: list[np.ndarray], width: int, labels: np.ndarray, categories: Sequence[str], settings: Settings) -> Chain:
        """``rows`` has each text's features, as numbers below ``width``; ``labels`` a column of 0/1 for each category, in chain order.

        The vocabulary has the numbers, as long as nobody names the features.
        """
        x = Sparse(rows, width)
        fold = np.arange(len(rows)) % settings.folds
        earlier, models, thresholds = np.zeros((len(rows), 0)), [], []
        for k in range(len(categories)):
            y, p = labels[:, k].astype(float), np.zeros(len(rows))
            for f in range(settings.folds):
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(own) and len(rest):
                    p[own] = fit_linear(x.take(rest), earlier[rest], y[rest], settings).probability(x.take(own), earlier[own])
            models.append(fit_linear(x, earlier, y, settings))
            thresholds.append(best_threshold(p, y > 0))
            earlier = np.column_stack([earlier, p])
        used = sorted({int(c) for m in models for c in m.columns})
        renumber = {c: k for k, c in enumerate(used)}
        for m in models:
            m.columns = np.array([renumber[int(c)] for c in m.columns], np.int64)
        return cls(list(categories), renumber, models, thresholds, settings)

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        place, prefixes = self.vocabulary, self.settings.prefixes
        rows = [np.array([place[f] for f in features_of(t, prefixes) if f in place], np.int64) for t in texts]
        x, out = Sparse(rows, len(self.vocabulary)), np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(x, out)])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], settings: Settings = Settings()) -> Chain:
    """Fit a chain. ``categories`` maps names, in chain order, to SQL conditions on ``labels``.

    Fitted are, of each combination of values, the ``max_train_docs`` labelled rows whose doc_id
    has the smallest hash; a condition that is null counts as not met. Where a doc_id is
    labelled more than once, the greatest value holds. Null ids teach nothing, and rows of one id and
    text count once. The features of the sample come to the driver as numbers, and by name only
    those that a model uses.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(f"c{k}") for k, c in enumerate(categories.values()))
    )
    flags = [f"c{k}" for k in range(len(categories))]
    marked = cut(marked.where("doc_id is not null"))
    parts = []
    for values in marked.select(flags).distinct().collect():
        same = marked
        for flag, value in zip(flags, values):
            same = same.where(F.col(flag) == value)
        parts.append(same.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_train_docs))
    if not parts:
        return Chain.fit([], 0, np.zeros((0, len(categories))), list(categories), settings)
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), "text", *flags)
    sample = cut(sample.dropDuplicates(["doc_id", "hash"]))
    prefixes = settings.prefixes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sorted(map(number, features_of(t, prefixes))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int64())), *batch.columns[3:]],
                names=["doc_id", "hash", "features", *flags],
            )

    kinds = ", ".join(f"{f} int" for f in flags)
    table = sample.mapInArrow(find, f"doc_id long, hash long, features array<long>, {kinds}").toArrow()
    order = np.lexsort((table["hash"].to_numpy(), table["doc_id"].to_numpy()))  # folds don't depend on the order of rows
    lists = table["features"].combine_chunks()
    labels = np.column_stack([table[f].to_numpy()[order] for f in flags]).astype(float)
    ends = lists.offsets.to_numpy().astype(np.int64)
    numbers, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    del table, lists
    flat = flat.astype(np.int32)
    chain = Chain.fit([flat[ends[k] : ends[k + 1]] for k in order], len(numbers), labels, list(categories), settings)
    used = {int(numbers[c]): k for c, k in chain.vocabulary.items()}

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set().union(*(features_of(t, prefixes) for t in batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(f for f in seen if number(f) in used), pa.string())], names=["f"])

    names = sample.select("text").mapInArrow(name, "f string").distinct().collect()
    chain.vocabulary = {r["f"]: used[number(r["f"])] for r in names}
    return chain


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and, for each category, ``p_<name>`` and the boolean ``<name>`` of every row.

    A null or empty text has no features and gets the probabilities of such a text; it is in no
    category. A null doc_id stays null; repeated rows are judged each; other columns are
    ignored. One pass over whole texts, without a shuffle.
    """
    small_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            p = chain.probabilities(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bool(t) for t in raw], pa.bool_()), *(pa.array(c) for c in p.T)],
                names=["doc_id", "filled", *names],
            )

    out = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(
        run, "doc_id long, filled boolean, " + ", ".join(f"{n} double" for n in names)
    )
    judged = [
        (F.col("filled") & (F.col(n) >= t)).alias(c) for n, c, t in zip(names, chain.categories, chain.thresholds)
    ]
    return out.select("doc_id", *names, *judged)
