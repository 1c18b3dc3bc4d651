"""Quality rules: base counts of a text and compression bands.

A text is repetitive if zstandard shrinks it much further than prose of its
length, and noise if it hardly shrinks at all. What is usual depends on the
length, as short texts have little to refer back to, so each length has a band of
its own. Long texts are judged by fixed chunks as well: a page of prose with
a long run of one line in it has an ordinary ratio as a whole. Every byte is in a chunk: the
last one is shorter and has the band of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import small_batches, utf8

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio (bytes before / after) by length in bytes.

    ``whole`` has (shortest length, least ratio, greatest ratio), by length.
    A text fails if its ratio is outside the band of its length, or if chunks with more
    than ``chunk_share`` of its bytes are outside theirs: ``chunk_band`` for a full chunk, and for the
    last one that of ``whole`` for its length.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = field(
        default=(
            (0, 0.30, 3.0),
            (64, 0.70, 3.0),
            (128, 0.90, 3.0),
            (256, 1.10, 3.2),
            (512, 1.20, 3.5),
            (1024, 1.30, 4.0),
            (4096, 1.40, 4.5),
            (16384, 1.45, 6.0),
        )
    )
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (1.3, 4.5)
    chunk_share: float = 0.4

    def limits(self, n: int) -> tuple[float, float]:
        """Least and greatest ratio of ``n`` bytes as a whole."""
        return next((low, high) for start, low, high in reversed(self.whole) if n >= start)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks long, n_bad_chunks long, band string"
)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    base = len(seen)
    window = ids[:n].copy()
    for k in range(1, width):
        if base ** (k + 1) >= 2**62:  # number the windows so far, so that the next product fits
            window = np.unique(window, return_inverse=True)[1]
        window = window * base + ids[k : n + k]
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= again
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return (
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
    )


def verdict(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, str]:
    """Ratio, chunks, chunks outside their band, and the band's judgement. A text of one chunk is judged as a whole alone."""
    n = len(raw)
    ratio = n / len(packer.compress(raw))
    low, high = bands.limits(n)
    n_chunks = -(-n // bands.chunk_bytes)
    n_bad = bytes_low = bytes_high = 0
    if n_chunks > 1:
        for start in range(0, n, bands.chunk_bytes):
            chunk = raw[start : start + bands.chunk_bytes]
            least, most = bands.chunk_band if len(chunk) == bands.chunk_bytes else bands.limits(len(chunk))
            r = len(chunk) / len(packer.compress(chunk))
            bytes_low += len(chunk) * (r < least)
            bytes_high += len(chunk) * (r > most)
            n_bad += not least <= r <= most
    limit = bands.chunk_share * n
    if ratio > high or bytes_high > limit:
        judged = "repetitive"
    elif ratio < low or bytes_low > limit:
        judged = "incompressible"
    elif bytes_low + bytes_high > limit:
        judged = "mixed"
    else:
        judged = "pass"
    return ratio, n_chunks, n_bad, judged


def quality_rules(
    docs: DataFrame, bands: Bands = Bands(), min_words: int = 50, max_repeat_percent: int = 50
) -> DataFrame:
    """Base counts, compression ratio and verdict of every document.

    Returns a row per input row: doc_id, the base counts, ``n_bytes``, ``ratio``
    (null where there are no bytes), ``n_chunks`` (the last, shorter one too), ``n_bad_chunks``, ``band``
    ('pass', 'repetitive', 'incompressible', 'mixed' or 'empty'), ``base_failed``
    and ``kept``. A null or empty text counts zero words, so it is base_failed and
    not kept; a null doc_id stays null; repeated rows are judged each on its own;
    other columns are ignored. One pass over the texts, without a shuffle.
    """
    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                words = raw.split()
                counts = base_counts(raw.decode("utf-8", "replace"), words)
                ratio, n_chunks, n_bad, judged = verdict(raw, bands, packer) if raw else (None, 0, 0, "empty")
                rows.append((len(words), *counts, len(raw), ratio, n_chunks, n_bad, judged))
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    out = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(judge, SCHEMA)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("band") == "pass"))
