"""Byte-level BPE: corpus-level merge replay, and decoding.

Texts are cut into pieces by the tokenizer's pattern, and each different piece of the corpus is encoded in one place. Three steps:

1. *split*: a block of documents becomes, for each document, an array of piece numbers, and a list of the block's
   different pieces. The list is dealt to buckets by a hash of the piece, so that equal pieces of all blocks meet.
2. *replay*: the different pieces of a bucket lie end to end in one array of tokens. An inverted index has the places of
   every adjacent pair inside a piece, by the rank of its merge; the merges are replayed over all pieces in rank
   order, and a merge updates the two pairs that touch each place and nothing else. That gives what merging each piece
   by itself gives: pieces don't touch, and inside a piece the lowest rank goes first, from the left. Should a merge make
   a pair of a lower rank than its own, that rank is replayed before the places that are left.
3. *assemble*: the ids of its pieces go back to each block, where the arrays of numbers become ids.

Arrays of numbers and lists of pieces go through one exchange, packed; a piece counts once for each block that has it, so a
piece that all texts have is no hot key. What a worker holds is bounded by a block.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import small_batches, utf8

#: Pieces whose ids a worker keeps from one replay to the next; beyond it the store is begun anew.
KEPT_PIECES = 200_000
#: Greater than every id: a pair of tokens is one number.
SIDE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, the merges they stand for, and each id's bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.forget()

    @cached_property
    def merges(self) -> dict[int, int]:
        """left * SIDE + right -> the token that the two make, for every way to cut a token in two tokens."""
        get, out = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left = get(token[:k])
                if left is not None and (right := get(token[k:])) is not None:
                    out[left * SIDE + right] = rank
        return out

    @cached_property
    def byte_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The token of each byte, and the rank of each pair of bytes (-1: none)."""
        token = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pair = [[self.merges.get(int(a) * SIDE + int(b), -1) for b in token] for a in token]
        return token, np.array(pair, np.int64)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All merges in rank order over all pieces at once: the ids of the pieces, end to end, and how many each has."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        single, pair = self.byte_tables
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        n = len(flat)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[ends > 0] - 1] = -1
        before[ends[ends < n]] = -1
        first = np.full(n, -1, np.int64)
        first[:-1] = np.where(after[:-1] >= 0, pair[flat[:-1], flat[1:]], -1)
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        found, start = np.unique(first[places], return_index=True)
        index = dict(zip(found.tolist(), map(np.ndarray.tolist, np.split(places, start[1:]))))  # rank -> places of the left token
        token, right, left, now = single[flat].tolist(), after.tolist(), before.tolist(), first.tolist()
        merged = self.merges.get
        queue = list(index)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank)
            places.sort()  # in a run of equal tokens the leftmost pair merges first
            lower = False
            for at, k in enumerate(places):
                if now[k] != rank:
                    continue  # a neighbour's merge took one of the two
                r = right[k]
                token[k] = rank
                token[r] = now[r] = -1
                then = right[k] = right[r]
                if then >= 0:
                    left[then] = k
                    new = now[k] = merged(rank * SIDE + token[then], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(k)
                        else:
                            index[new] = [k]
                            heappush(queue, new)
                            lower |= new < rank
                else:
                    now[k] = -1
                prior = left[k]
                if prior >= 0:
                    new = now[prior] = merged(token[prior] * SIDE + rank, -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(prior)
                        else:
                            index[new] = [prior]
                            heappush(queue, new)
                            lower |= new < rank
                if lower:
                    rest = places[at + 1 :]
                    if rest:
                        index[rank] = index.get(rank, []) + rest
                        if len(index[rank]) == len(rest):
                            heappush(queue, rank)
                    break
        ids = np.array(token, np.int32)
        kept = ids >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        return ids[kept], np.diff(upto)

    def forget(self) -> None:
        """Empty the store of known pieces: a number for each, and its ids in one long array."""
        self.place: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.first, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the pieces that have a number but no ids yet. A piece that is a token as a whole is that token."""
        new = list(islice(self.place, len(self.many), None))
        whole = np.fromiter((self.ranks.get(raw, -1) for raw in new), np.int32, len(new))
        cut, many = self.replay([raw for raw, w in zip(new, whole.tolist()) if w < 0])
        counts = np.ones(len(new), np.int64)
        counts[whole < 0] = many
        ids = np.empty(counts.sum(), np.int32)
        by_merge = np.repeat(whole < 0, counts)
        ids[by_merge], ids[~by_merge] = cut, whole[whole >= 0]
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.many = np.concatenate([self.ids, ids]), np.concatenate([self.many, counts])

    def encode_pieces(self, lists: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list how many ids every piece has, and the ids end to end. Pieces that are new are replayed together."""
        if len(self.place) > KEPT_PIECES:
            self.forget()
        at = [np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces)) for pieces in lists]
        self.learn()
        return [(n := self.many[k], self.ids[spread(self.first[k], n)]) for k in at]

    def split(self, texts: list[str], place: defaultdict[str, int]) -> list[np.ndarray]:
        """The numbers of the pieces of each text; ``place`` gives every different piece its number."""
        cut = map(self.pattern.findall, texts)
        return [np.fromiter(map(place.__getitem__, pieces), np.uint32, len(pieces)) for pieces in cut]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the place where each text's end: the three steps in one process."""
        place: defaultdict[str, int] = defaultdict(count().__next__)
        numbers = self.split(texts, place)
        ((many, ids),) = self.encode_pieces([[piece.encode() for piece in place]])
        return assembled(numbers, many, ids)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_open: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each file and process."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Vocabulary(read_ranks(path), pattern)
    return _open[path, pattern]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then first[1], ..."""
    upto = np.cumsum(n)
    return np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)


def assembled(numbers: list[np.ndarray], many: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and where each text's end, from the piece numbers and each piece's ids (``many`` of them)."""
    at = np.concatenate([*numbers, np.zeros(0, np.uint32)]).astype(np.int64)
    n = many[at]
    upto = np.concatenate([[0], np.cumsum(n)])
    flat = ids[spread((np.cumsum(many) - many)[at], n)]
    return flat, upto[np.cumsum([0, *map(len, numbers)])]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32, each in as few bytes as its greatest needs, compressed together."""
    parts = [np.array([len(arrays)], np.uint8).tobytes()]
    for x in arrays:
        width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
        parts += [np.array([width, len(x)], np.int64).tobytes(), x.astype(f"u{width}").tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 1, []
    for _ in range(raw[0]):
        width, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        out.append(np.frombuffer(raw, f"u{width}", n, at + 16))
        at += 16 + width * n
    return out


def pack_pieces(pieces: list[bytes]) -> bytes:
    return packed(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.frombuffer(b"".join(pieces), np.uint8))


def unpack_pieces(data: bytes) -> list[bytes]:
    n, flat = unpacked(data)
    ends, raw = np.cumsum(n, dtype=np.int64).tolist(), flat.tobytes()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


#: Characters of a block. A document stays whole, so one that is longer is a block by itself.
BLOCK_CHARS = 1 << 22
#: Packed bytes of piece lists that are replayed together.
REPLAY_BYTES = 1 << 17
#: Kinds of rows.
DOCUMENT, ORDER, PIECES = 0, 1, 2
#: ``doc_id`` of a row of pieces or of their order is a digest of the block's pieces.
SPLIT = "route long, kind byte, doc_id long, block long, data binary"


def block_digest(pieces: list[bytes]) -> int:
    """63 bits that tell a block's pieces in their order from others."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return xxhash.xxh3_64_intdigest(lengths.tobytes() + b"".join(pieces)) >> 1


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _split(path: str, pattern: str, buckets: int):
    """Blocks of documents as rows. A document or the order of the pieces goes to its block, a list of pieces to its bucket."""
    schema = pa.schema([("route", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def block_rows(block: int, ids: list, numbers: list[np.ndarray], place: dict[str, int]) -> Iterator[pa.RecordBatch]:
        pieces = [piece.encode() for piece in place]
        bucket = np.fromiter(map(zlib.crc32, pieces), np.uint32, len(pieces)) % buckets
        order = np.argsort(bucket, kind="stable")
        found, start = np.unique(bucket[order], return_index=True)
        digest = block_digest(pieces)
        rows = [(block, ORDER, digest, None, packed(order))]
        for b, part in zip(found.tolist(), np.split(order, start[1:])):
            rows.append((-1 - b, PIECES, digest, block, pack_pieces([pieces[k] for k in part.tolist()])))
        yield _rows(rows, schema)
        for k in range(0, len(ids), 1000):
            yield _rows([(block, DOCUMENT, i, None, packed(x)) for i, x in zip(ids[k : k + 1000], numbers[k : k + 1000])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = vocabulary(path, pattern), TaskContext.get().partitionId() << 32
        ids, numbers, chars = [], [], 0
        place: defaultdict[str, int] = defaultdict(count().__next__)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                if ids and chars + len(text) > BLOCK_CHARS:
                    yield from block_rows(block, ids, numbers, place)
                    ids, numbers, chars, block = [], [], 0, block + 1
                    place = defaultdict(count().__next__)
                ids.append(doc_id)
                numbers += words.split([text], place)
                chars += len(text)
        if ids:
            yield from block_rows(block, ids, numbers, place)

    return run


def _replay(path: str, pattern: str):
    """Lists of pieces, by bucket, to the ids of every piece, for the block that a list is from."""
    schema = pa.schema([("route", pa.int64()), ("bucket", pa.int64()), ("digest", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        held, size = [], 0

        def encoded() -> pa.RecordBatch:
            made = words.encode_pieces([unpack_pieces(data) for *_, data in held])
            return _rows([(block, bucket, digest, packed(*m)) for (bucket, digest, block, _), m in zip(held, made)], schema)

        for batch in batches:
            lists = batch.filter(pc.equal(batch.column(1), PIECES))
            for row in zip(*(lists.column(k).to_pylist() for k in (0, 2, 3, 4))):
                held.append(row)
                size += len(row[3])
                if size > REPLAY_BYTES:
                    yield encoded()
                    held, size = [], 0
        if held:
            yield encoded()

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with their ids; none for a bucket."""
    kind = left["kind"].to_numpy()
    if not (kind == ORDER).any():
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    made = sorted(zip(right["bucket"].to_pylist(), right["data"].to_pylist()), reverse=True)  # buckets count down from -1
    parts = [unpacked(data) for _, data in made]
    data = left["data"].to_pylist()
    orders = [unpacked(data[k])[0] for k in np.flatnonzero(kind == ORDER)]
    digests = {left["doc_id"][int(k)].as_py() for k in np.flatnonzero(kind == ORDER)} | set(right["digest"].to_pylist())
    many = np.concatenate([*(n for n, _ in parts), np.zeros(0, np.uint8)]).astype(np.int64)
    ids = np.concatenate([*(x for _, x in parts), np.zeros(0, np.uint8)]).astype(np.int32)
    if len(orders) != 1 or len(digests) != 1 or len(orders[0]) != len(many):
        raise ValueError("a block was split in two ways: its rows come in another order each time they are read")
    first, by_number = np.cumsum(many) - many, np.empty(len(many), np.int64)
    by_number[orders[0]] = np.arange(len(many))
    ids, many = ids[spread(first[by_number], many[by_number])], many[by_number]
    documents = np.flatnonzero(kind == DOCUMENT)
    flat, ends = assembled([unpacked(data[k])[0] for k in documents], many, ids)
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
    return pa.table([left["doc_id"].take(pa.array(documents)), lists], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row, as the tokenizer's own library gives them.

    ``path`` is the rank file, which every executor can open, and ``pattern`` cuts texts into
    pieces. No special tokens: their strings are ordinary text. Null and empty texts have
    no ids; a null doc_id stays null; repeated rows are encoded each; other columns are
    ignored; an empty table gives an empty one. The rows must be read again in the same order if a task is
    repeated, as those of files are; a block whose pieces come from two different readings is an error, told by a digest of them.

    Shuffled are, packed, the documents as piece numbers and the different pieces of each block, in one
    exchange that two steps read, and the ids of the latter. A bucket has pieces of all blocks, each once; there are
    four buckets for each shuffle partition, so their number goes with that of the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"))
    dealt = picked.mapInArrow(_split(path, pattern, buckets), SPLIT).repartition("route")
    # Each step takes the rows of its kinds in Python: Catalyst would move a filter below the exchange and so make two of it.
    made = dealt.sortWithinPartitions("route").mapInArrow(_replay(path, pattern), "route long, bucket long, digest long, data binary")
    return dealt.groupBy("route").cogroup(made.groupBy("route")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) with ``decoded``, the bytes that the ids stand for.

    Null ids decode to no bytes. An id that the rank file does not have is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            made = [words.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(made, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )
