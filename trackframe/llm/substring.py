"""Substring dedup with difference-cover anchors.

Positions p with p mod ``period`` in a difference cover are anchors: for any two
positions i and j there is a shift below the period that takes both to cover
positions. So wherever two documents share ``window`` words, both have an anchor at the
same place of the shared words, and the ``window - period + 1`` words from there are
the same. Only windows at anchors are hashed and shuffled first, about a fifth of all.
Where an anchor is found in two documents the match is extended: every whole
window around it is hashed, and the smallest doc_id with each window is found.

Nothing is ever paired: an anchor or window in a million documents is a million
rows at most, and one row for each Arrow batch that has it. The rows that a batch can
judge by itself leave it judged and are spread by document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.llm.common import small_batches, utf8

#: A perfect difference set modulo 31; every difference occurs once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

NO_ID = 2**63 - 1  # stands for a null doc_id: greater than all others

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2**64
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashed: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of each window of ``width`` words: a polynomial of its word hashes."""
    n = len(hashed) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _power(base, len(hashed)))])
    out = (sums[width:] - sums[:n]) * _power(pow(base, -1, 1 << 64), n)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchor_positions(n: int) -> np.ndarray:
    """Cover positions below n."""
    laps = np.arange(-(-n // PERIOD) if n > 0 else 0) * PERIOD
    at = (laps[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def anchors(hashed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors and the hashes of the words from there."""
    width = window - PERIOD + 1
    made = window_hashes(hashed, width)
    at = anchor_positions(len(made))
    return at, made[at]


def around(at: np.ndarray, n_windows: int, window: int) -> np.ndarray:
    """Which windows hold one of the anchors at these positions."""
    edge = np.zeros(n_windows + 1, np.int64)
    np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
    np.add.at(edge, np.minimum(at + 1, n_windows), -1)
    return np.cumsum(edge)[:-1] > 0


def _settle(keys: list[np.ndarray], rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document; which rows are a key's first, and how many rows its key has."""
    order = np.lexsort((rid, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return order, new, np.repeat(np.diff(np.append(start, len(order))), np.diff(np.append(start, len(order))))


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names
    )


#: Rows that go out have four columns: k by which they are shuffled, c, rid and kind. A row that others must judge
#: has its hash in k. One that its batch has judged (kind SETTLED) has the document in k and the hash in c.
SETTLED = 2
ROWS = "k long, c long, rid long, kind byte"


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (raw or b"").split()
                if len(words) >= window:
                    made = np.unique(anchors(word_hashes(words), window)[1])
                    keys.append(made)
                    owners.append(np.full(len(made), rid, np.int64))
            if not keys:
                continue
            h, rid = np.concatenate(keys), np.concatenate(owners)
            order, first, count = _settle([h], rid)
            h, rid = h[order], rid[order]
            known = count > 1  # in two documents of this batch already
            yield _batch(
                [
                    np.concatenate([h[first].view(np.int64), rid[known]]),
                    np.concatenate([np.zeros(first.sum(), np.int64), h[known].view(np.int64)]),
                    np.concatenate([rid[first], rid[known]]),
                    np.concatenate([known[first].astype(np.int8), np.full(known.sum(), SETTLED, np.int8)]),
                ],
                ["k", "c", "rid", "kind"],
            )

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, owners = [], [], []
            for rid, raw, hits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                hashed = word_hashes(raw.split())
                at, made = anchors(hashed, window)
                here = around(at[np.isin(made, np.array(hits, np.int64).view(np.uint64))], len(hashed) - window + 1, window)
                w1, which = np.unique(window_hashes(hashed, window)[here], return_index=True)
                one.append(w1)
                two.append(window_hashes(hashed, window, _BASES[1])[here][which] >> np.uint64(32))
                owners.append(np.full(len(w1), rid, np.int64))
            if not one:
                continue
            w1, w2, rid = np.concatenate(one), np.concatenate(two), np.concatenate(owners)
            order, first, _ = _settle([w1, w2], rid)
            w1, w2, rid = w1[order], w2[order], rid[order]
            least = rid[first][np.cumsum(first) - 1] if len(rid) else rid
            later = rid > least  # a smaller document of this batch has the window
            yield _batch(
                [
                    np.concatenate([w1[first].view(np.int64), rid[later]]),
                    np.concatenate([w2[first].view(np.int64), w1[later].view(np.int64)]),
                    np.concatenate([rid[first], rid[later]]),
                    np.concatenate([np.zeros(first.sum(), np.int8), np.full(later.sum(), SETTLED, np.int8)]),
                ],
                ["k", "c", "rid", "kind"],
            )

    return run


OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _removed(words: list[bytes], gone: list[int] | None, window: int) -> np.ndarray:
    """Which words are in one of the windows with these hashes."""
    out = np.zeros(len(words) + 1, np.int64)
    if gone:
        at = np.flatnonzero(np.isin(window_hashes(word_hashes(words), window), np.array(gone, np.int64).view(np.uint64)))
        np.add.at(out, at, 1)
        np.add.at(out, at + window, -1)
    return np.cumsum(out)[:-1] > 0


def _cut_rows(window: int, carry: Sequence[str], tidy: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, raw, gone in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = (raw or b"").split()
                cut = _removed(words, gone, window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
                if spans or tidy:
                    raw = b" ".join([w for w, c in zip(words, cut.tolist()) if not c] if spans else words)
                rows.append((None if rid == NO_ID else rid, len(words), int(cut.sum()), spans, raw))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, kinds)), *(batch.column(3 + k) for k in range(len(carry)))],
                names=["doc_id", "n_words", "n_removed", "spans", "kept", *carry],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, carry: Sequence[str] = (), tidy: bool = True) -> DataFrame:
    """Remove passages of ``window`` words or more that a document with a smaller doc_id has too.

    A word goes if a window of ``window`` consecutive words of its document covers it
    whose word sequence also starts in a document with a smaller doc_id. Windows are
    judged on the input. Returns a row per input row: doc_id, n_words, n_removed,
    ``spans`` (removed words as [start, end) word offsets) and ``kept`` (the words left,
    joined by one space, as UTF-8), and the columns that ``carry`` names. With ``tidy`` false a text
    that loses nothing is kept as it is, null or not.

    Null, empty and short texts lose nothing. A null doc_id counts as greater than
    every other, so such a row may lose words but costs others none. Rows with the same
    doc_id are no reason against each other; each is judged by its own text. Other
    columns are ignored, and an empty table gives an empty result. ``window`` must be
    greater than the cover's period (31).

    Windows are told apart by 96 bits of two hashes. Shuffled are the anchors, the windows
    around shared anchors, and the texts once, by doc_id, for both passes that read them.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be greater than {PERIOD}")
    small_batches(docs.sparkSession)
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_rid")
    base = docs.select(rid, utf8("text").alias("_utf8"), *carry)
    texts = base.select("_rid", "_utf8")

    found = texts.mapInArrow(_anchor_rows(window), ROWS)
    same = Window.partitionBy("k")
    shared = (
        found.withColumn("low", F.min("rid").over(same))
        .withColumn("high", F.max("rid").over(same))
        .withColumn("known", F.max("kind").over(same))
        .where((F.col("kind") == SETTLED) | (F.col("low") < F.col("high")) | (F.col("known") == 1))
    )
    hashed = F.when(F.col("kind") == SETTLED, F.col("c")).otherwise(F.col("k"))
    hits = shared.groupBy("rid").agg(F.collect_set(hashed).alias("hits"))

    # Both joins read the same columns of base, so that its exchange is used twice.
    wide = base.join(hits, base["_rid"] == hits["rid"]).select("_rid", "_utf8", "hits", *carry)
    seen = wide.mapInArrow(_window_rows(window), ROWS)
    alike = Window.partitionBy("k", "c", "kind")
    gone = seen.withColumn("low", F.min("rid").over(alike)).where((F.col("kind") == SETTLED) | (F.col("rid") > F.col("low")))
    marks = gone.groupBy("rid").agg(F.collect_set(hashed).alias("gone"))
    schema = T.StructType([*T.StructType.fromDDL(OUT), *docs.select(*carry).schema])
    rows = base.join(marks, base["_rid"] == marks["rid"], "left").select("_rid", "_utf8", "gone", *carry)
    return rows.mapInArrow(_cut_rows(window, carry, tidy), schema)
