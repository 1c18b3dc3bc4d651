"""Media columns: content-defined chunking, chunk digests deduplicated by joins, verified reconstruction.

A payload is stored as 8-bit mono WAV. Its samples are cut where a rolling gear hash of the last 32 bytes
has ``bits`` leading zeros, so equal passages give equal chunks wherever they stand. Two tables are what is stored:

* chunks: digest, data, and the media value that owns it, the first (key, place) that has the digest. Each digest is there once.
* media: key, true length and the ordered list of its chunks' digests and owners. No bytes.

Media values are rebuilt from these two alone: by a join with the chunks that a value owns itself, and by
another on the digest with those that are owned elsewhere. All are put in order, and every chunk and the whole are
checked against their digests. Equal payloads are one media value, however many rows have them.

The bytes are shuffled once by key, into the chunk table; that keeps an owner's chunks together, so a value's own
chunks reach it without another shuffle, and only chunks that several values share are shuffled again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import cut, small_batches, utf8

RATE = 8000
HEAD_BYTES = 56

#: One random word for each byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def padded(raw: bytes) -> bytes:
    """The payload: zeros up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def wav_head(n: int, size: int) -> bytes:
    """What stands before ``size`` samples, 8 bits and mono; the fact chunk has the true number of bytes, ``n``."""
    return b"".join(
        [
            struct.pack("<4sI4s", b"RIFF", HEAD_BYTES - 8 + size, b"WAVE"),
            struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8),
            struct.pack("<4sII", b"fact", 4, n),
            struct.pack("<4sI", b"data", size),
        ]
    )


def to_wav(raw: bytes) -> bytes:
    """Bytes as 8-bit mono samples."""
    samples = padded(raw)
    return wav_head(len(raw), len(samples)) + samples


def from_wav(media: bytes) -> tuple[int, bytes]:
    """True number of bytes, and the samples, of what ``to_wav`` made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, n, samples = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fact":
            (n,) = struct.unpack_from("<I", media, at + 8)
        elif name == b"data":
            samples = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if n is None or samples is None:
        raise ValueError("a chunk is missing")
    return n, samples


def cut_points(data: bytes, bits: int = 11, least: int = 512, most: int = 8192) -> list[int]:
    """Ends of the chunks: after a byte whose rolling hash has ``bits`` leading zeros, within the size limits."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:  # sums over 2, 4, 8, 16 and 32 bytes: an older byte is shifted out step by step
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    marks = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    ends, start = [], 0
    for mark in [*marks, len(data)]:
        while mark - start > most:
            start += most
            ends.append(start)
        if mark - start >= least:
            ends.append(mark)
            start = mark
    if start < len(data):
        ends.append(len(data))
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Level, loudness and crossings of the middle, from exact integers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def chunks_of(raw: bytes) -> list[bytes]:
    samples = padded(raw)
    ends = cut_points(samples)
    return [samples[a:b] for a, b in zip([0, *ends], ends)]


_LIST = pa.list_(pa.struct([("size", pa.int32()), ("digest", pa.binary())]))


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and chunk list of each payload."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        lists = [[{"size": len(c), "digest": digest(c)} for c in chunks_of(raw)] for raw in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(lists, _LIST)], names=["key", "n_bytes", "list"]
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each payload, in order and compressed."""
    packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for batch in batches:
        packed = [[packer.compress(c) for c in chunks_of(raw)] for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.list_(pa.binary()))], names=["key", "packed"])


REBUILT = "key binary, media binary, n_chunks int, n_fetched int, verified boolean"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for key, n, parts, own, fetched in zip(*(batch.column(k).to_pylist() for k in range(5))):
            held = {c["digest"]: c["data"] for c in [*(own or []), *(fetched or [])]}
            pieces, good = [], True
            for p in parts:
                data = held.get(p["digest"])
                piece = b"" if data is None else unpack.decompress(data)
                good &= len(piece) == p["size"] and digest(piece) == p["digest"]
                pieces.append(piece)
            samples = b"".join(pieces)
            good = good and key_of(samples[:n]) == key and not any(samples[n:])
            elsewhere = sum(p["owner"] != key for p in parts)
            rows.append((key, wav_head(n, len(samples)) + samples if good else None, len(parts), elsewhere, good))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in REBUILT.split(", ")]
        )


#: Bytes of a key, which are the first of the payload's sha256.
KEY_BYTES = 16


def key_of(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:KEY_BYTES]


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store the texts of ``docs`` as media: (references, media, chunks).

    references: doc_id and key (16 bytes of the sha256 of the UTF-8 text) of every input row. media: a row for
    each key with n_bytes and ``parts``, the ordered list of (idx, size, digest, owner). chunks: a row for each digest
    with owner, ``shared`` (other places have it too) and data (zstandard).

    A null text is an empty one, and an empty one is 64 zero samples. A null doc_id stays null; repeated rows are
    references to one media value; other columns are ignored; an empty table gives three empty ones. A chunk that very
    many values have is one row of chunks and a skewed join key, which Spark splits.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(utf8("text"), F.lit(b""))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    base = base.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 2 * KEY_BYTES)))
    texts = base.select("key", "text")
    lists = texts.mapInArrow(_list, "key binary, n_bytes long, list array<struct<size:int,digest:binary>>")
    lists = lists.groupBy("key").agg(F.first(F.struct("n_bytes", "list")).alias("m"))
    listed = cut(lists.select("key", "m.n_bytes", F.posexplode("m.list").alias("idx", "c")).select("key", "n_bytes", "idx", "c.size", "c.digest"))
    owners = listed.groupBy("digest").agg(F.min(F.struct("key", "idx")).alias("first"), (F.count("*") > 1).alias("shared"))
    placed = listed.join(owners, "digest")
    parts = F.sort_array(F.collect_list(F.struct("idx", "size", "digest", F.col("first.key").alias("owner"))))
    media = placed.groupBy("key").agg(F.first("n_bytes").alias("n_bytes"), parts.alias("parts"))
    kept = owners.groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("first.idx", "digest", "shared")).alias("kept"))
    packs = texts.mapInArrow(_pack, "key binary, packed array<binary>").groupBy("key").agg(F.first("packed").alias("packed"))
    chunk = F.transform("kept", lambda c: F.struct(c["digest"].alias("digest"), c["shared"].alias("shared"), F.get("packed", c["idx"]).alias("data")))
    chunks = packs.join(kept, "key").select(F.col("key").alias("owner"), F.explode(chunk).alias("c"))
    return base.select("doc_id", "key"), media, chunks.select("owner", "c.digest", "c.shared", "c.data")


def rebuild(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every media value again, from its chunk list and the chunk table alone.

    Returns key, ``media`` (the stored WAV), n_chunks, n_fetched (chunks that another value owns) and ``verified``: every
    chunk and the whole have their digests. Where a chunk is missing or damaged, media is null and verified false.
    """
    own = chunks.groupBy(F.col("owner").alias("key")).agg(F.collect_list(F.struct("digest", "data")).alias("own"))
    elsewhere = F.array_distinct(F.transform(F.filter("parts", lambda p: p["owner"] != F.col("key")), lambda p: p["digest"]))
    wanted = media.select("key", F.explode(elsewhere).alias("digest"))
    fetched = wanted.join(chunks.where("shared").select("digest", "data"), "digest")
    fetched = fetched.groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("fetched"))
    rows = media.join(own, "key", "left").join(fetched, "key", "left")
    return rows.select("key", "n_bytes", "parts", "own", "fetched").mapInArrow(_rebuild, REBUILT)


def media_facts(media: DataFrame) -> DataFrame:
    """Per media value: key, n_bytes, payload and stored sizes and digests, tail_crc32 and features, from the stored bytes.

    A value that could not be rebuilt has nulls.
    """
    kinds = {
        "n_bytes": pa.int64(),
        "payload_bytes": pa.int64(),
        "payload_sha256": pa.string(),
        "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(),
        "media_sha256": pa.string(),
        "feature": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(1).to_pylist():
                if stored is None:
                    rows.append((None,) * len(kinds))
                    continue
                n, samples = from_wav(stored)
                rows.append(
                    (
                        n,
                        len(samples),
                        hashlib.sha256(samples).hexdigest(),
                        zlib.crc32(samples[-64:]),
                        len(stored),
                        hashlib.sha256(stored).hexdigest(),
                        features(samples),
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays, batch.column(2), batch.column(3), batch.column(4)],
                names=["key", *kinds, "n_chunks", "n_fetched", "verified"],
            )

    schema = (
        "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, n_chunks int, n_fetched int, verified boolean"
    )
    return media.select("key", "media", "n_chunks", "n_fetched", "verified").mapInArrow(run, schema)
