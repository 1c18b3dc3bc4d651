"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. A word that training
never showed falls back to its character n-grams, the longest first: if any
n-gram of that length is known the word scores by the mean of these, else the
next shorter length is tried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.llm.common import cut, small_batches, utf8

UNKNOWN = "und"
#: Columns lang, text and n.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample of labelled rows that is fitted (rows, bytes of text) and the longest n-gram.

    Every word and n-gram of the sample is in the model, so these two bound its size too: a
    text of b bytes has at most b / 2 words and b n-grams of each length.
    ``full_words``: from this many words on the evidence counts no further, so that the
    score of a long text is not always 1.
    """

    max_train_docs: int = 20_000
    max_train_bytes: int = 64 << 20
    longest_gram: int = 5
    smoothing: float = 0.5
    full_words: int = 12


def words_of(raw: bytes | None) -> list[str]:
    return _WORD.findall((raw or b"").decode("utf-8", "replace").lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by word and n-gram: the place of each in one table, whose rows are vectors over the languages."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray, settings: Settings):
        self.langs, self.words, self.grams, self.table, self.settings = langs, words, grams, table, settings

    def __reduce__(self):
        """Goes to workers as two long strings and a table, from which a task makes its dictionaries."""
        return _received, (self.langs, "\n".join(self.words), "\n".join(self.grams), self.table, self.settings)

    @classmethod
    def fit(cls, word_counts: Counts, gram_counts: Counts, settings: Settings) -> Model:
        """Counts are columns (lang, text, n); each n-gram length is a distribution of its own."""
        langs = sorted({*word_counts[0], *gram_counts[0]})
        lang_place = {lang: k for k, lang in enumerate(langs)}
        parts: list[np.ndarray] = [np.zeros((0, max(len(langs), 1)), np.float32)]

        def logs(counts: Counts, which: np.ndarray, first: int) -> dict[str, int]:
            """Places of the texts in the table, from ``first`` on; their rows go to ``parts``."""
            lang = np.fromiter(map(lang_place.__getitem__, counts[0][which]), np.int64, which.sum())
            texts, row = np.unique(counts[1][which], return_inverse=True)
            if len(texts):
                table = np.full((len(texts), len(langs)), settings.smoothing)
                np.add.at(table, (row, lang), counts[2][which])
                parts.append(np.log(table / table.sum(axis=0)).astype(np.float32))
            return dict(zip(texts.tolist(), range(first, first + len(texts))))

        words = logs(word_counts, np.ones(len(word_counts[1]), bool), 0)
        lengths = np.fromiter(map(len, gram_counts[1]), np.int64, len(gram_counts[1]))
        grams: dict[str, int] = {}
        for n in range(1, settings.longest_gram + 1):
            grams |= logs(gram_counts, lengths == n, len(words) + len(grams))
        return cls(langs, words, grams, np.concatenate(parts), settings)

    def backoff(self, word: str) -> np.ndarray:
        for n in range(self.settings.longest_gram, 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def scorer(self) -> Scorer:
        return Scorer(self)


def _received(langs: list[str], words: str, grams: str, table: np.ndarray, settings: Settings) -> Model:
    each = [text.split("\n") if text else [] for text in (words, grams)]
    places = dict(zip(each[0], range(len(each[0])))), dict(zip(each[1], range(len(each[0]), len(table))))
    return Model(langs, *places, table, settings)


class Scorer:
    """Predicts with a model; keeps the vectors of unseen words up to a bound."""

    KEPT = 100_000

    def __init__(self, model: Model):
        self.model = model
        self.unseen: dict[str, int] = {}
        self.table = np.zeros((self.KEPT, max(len(model.langs), 1)), np.float32)

    def add(self, word: str) -> int:
        k = self.unseen.get(word)
        if k is None:
            k = self.unseen[word] = len(self.unseen)
            self.table[k] = self.model.backoff(word)
        return -1 - k

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        words = words_of(raw)
        if not self.model.langs or not any(c.isalpha() for word in words for c in word):
            return UNKNOWN, 0.0
        sums = np.zeros(len(self.model.langs))
        for first in range(0, len(words), 50_000):
            part = words[first : first + 50_000]
            if len(self.unseen) + len(part) > self.KEPT:
                self.unseen.clear()
            get, add = self.model.words.get, self.add
            at = np.fromiter((k if (k := get(w)) is not None else add(w) for w in part), np.int64, len(part))
            sums += self.model.table[at[at >= 0]].sum(axis=0, dtype=np.float64) + self.table[-1 - at[at < 0]].sum(axis=0, dtype=np.float64)
        logits = sums / len(words) * min(len(words), self.model.settings.full_words)
        best = int(np.argmax(logits))
        return self.model.langs[best], float(1 / np.exp(logits - logits[best]).sum())


def train(docs: DataFrame, usable: Column, settings: Settings = Settings()) -> Model:
    """Fit on a sample of the rows where ``usable`` holds and lang is not null.

    The sample is the ``max_train_docs`` rows whose doc_id has the smallest hash, or as many of
    them as have ``max_train_bytes`` of text; a text longer than that is not in it. Null texts
    and ids teach nothing, and rows alike in id, text and lang count once. The ids (a megabyte at
    most) are broadcast. Word and n-gram counts are summed by Spark and all of them make the
    model. An empty sample gives a model without languages.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = settings.longest_gram
    text = F.col("text").cast("string")
    row = ["doc_id", "lang", "hash"]
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"),
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64(text).alias("hash"),
        F.octet_length(text).cast("long").alias("size"),
        utf8("text").alias("text"),
    )
    labelled = labelled.where(F.col("size") <= settings.max_train_bytes)
    order = [F.xxhash64("doc_id"), *row]
    first = labelled.select(*row, "size").distinct().orderBy(*order).limit(settings.max_train_docs)
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the limit's rows
    chosen = first.withColumn("upto", upto).where(F.col("upto") <= settings.max_train_bytes).select(*row)
    sample = labelled.join(F.broadcast(chosen), row, "left_semi").dropDuplicates(row)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(raw))
            for lang, found in words.items():
                grams: Counter = Counter()
                for word, times in found.items():
                    for k in range(1, n + 1):
                        for gram in grams_of(word, k):
                            grams[gram] += times
                for kind, counts in (("word", found), ("gram", grams)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(counts), pa.string()),
                            pa.array([kind] * len(counts), pa.string()),
                            pa.array(counts.keys(), pa.string()),
                            pa.array(counts.values(), pa.int64()),
                        ],
                        names=["lang", "kind", "token", "n"],
                    )

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, kind string, token string, n long")
    summed = cut(counts.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")), 100 * settings.max_train_docs)

    def columns(kind: str) -> Counts:
        table = summed.where(F.col("kind") == kind).select("lang", "token", "n").toArrow()
        return tuple(table[k].to_numpy() for k in range(3))

    return Model.fit(columns("word"), columns("gram"), settings)


def identify(docs: DataFrame, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row, from the text alone; ``carry`` names columns to return beside them.

    A null text or one without a letter is 'und' with score 0, as is every text if the
    model has learned no language. Ties go to the first language in code-point order. A
    null doc_id stays null; repeated rows are judged each; other columns are
    ignored. One pass, without a shuffle; the model's size is bounded by its settings.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            made = [scorer.predict(raw) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x for x, _ in made], pa.string()),
                    pa.array([x for _, x in made], pa.float64()),
                    *(batch.column(2 + k) for k in range(len(carry))),
                ],
                names=["doc_id", "lang_pred", "score", *carry],
            )

    kept = docs.select(*carry)
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double")
    schema = T.StructType([*schema, *kept.schema])
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("_utf8"), *carry).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id's digits modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
