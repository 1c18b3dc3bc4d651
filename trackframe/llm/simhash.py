"""SimHash near-duplicates, linked through anchor points of covering codes.

A 64-bit fingerprint is cut into blocks. Two fingerprints that differ in at
most ``distance`` bits differ in at most ``distance // blocks`` bits (``t``) of one
block at least. Over each block lies a linear covering code with covering radius
R: every block value has a codeword, its home anchor, within R. If x and y differ
in t bits there, y is within R + t of x's home anchor. So every fingerprint is
replicated to all anchors within R + t, and at each anchor those that are at home
there are compared with all that came. No link can be missed, whatever the data.

The codes are Hamming codes over 2**r - 1 bits (perfect, R = 1); what a block has
beyond that stays uncoded, so that it only adds anchors. All anchors within a
distance of a value follow from its syndrome alone: they are the value xor every
error pattern of that syndrome, and these patterns are a small table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.llm.common import cut, small_batches, utf8
from trackframe.llm.components import connected_components, stars

#: Runs up to this long are compared in bulk; in longer ones whatever is linked is taken out at once.
SHORT_RUN = 256
#: Pairs compared at once.
PAIRS = 1 << 18


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included; zero without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)
        )
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[k : k + (1 << 14)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row, and the columns that ``carry`` names."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            columns = [batch.column(0), pa.array(made.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *carry])

    picked = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"), *carry)
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, fp long"), *docs.select(*carry).schema])
    return picked.mapInArrow(run, schema)


@dataclass(frozen=True)
class Block:
    """``width`` bits of the fingerprint from bit ``shift`` on, covered by a Hamming code."""

    index: int
    shift: int
    width: int
    checks: int  # the Hamming code is over the lowest 2**checks - 1 bits of the block
    reach: int  # covering radius plus the threshold that holds in one block

    @property
    def coded(self) -> int:
        return (1 << self.checks) - 1

    def value(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def syndrome(self, value: np.ndarray) -> np.ndarray:
        """Bit k of the code has the column k + 1, so a single wrong bit k has the syndrome k + 1."""
        out = np.zeros(value.shape, np.int64)
        for c in range(self.checks):
            mask = sum(1 << k for k in range(self.coded) if (k + 1) >> c & 1)
            out |= (np.bitwise_count(value & np.uint64(mask)).astype(np.int64) & 1) << c
        return out

    def home(self, value: np.ndarray) -> np.ndarray:
        s = self.syndrome(value)
        flip = np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
        return value ^ flip

    def key(self, anchor: np.ndarray) -> np.ndarray:
        return anchor | np.uint64(self.index << 40)


@lru_cache(maxsize=None)
def patterns(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to the block's reach, by syndrome: masks, first index, count."""
    by: list[list[int]] = [[] for _ in range(1 << block.checks)]
    for weight in range(block.reach + 1):
        for bits in combinations(range(block.width), weight):
            s = 0
            for k in bits:
                s ^= k + 1 if k < block.coded else 0
            by[s].append(sum(1 << k for k in bits))
    counts = np.array([len(x) for x in by])
    return np.array([m for x in by for m in x], np.uint64), np.cumsum(counts) - counts, counts


#: (fewest distinct fingerprints, widths of the blocks, check bits). More fingerprints get more anchors,
#: so that an anchor keeps few of them; every choice is exact.
PLANS = (
    (0, (22, 21, 21), 4),
    (200_000_000, (32, 32), 5),
)


def plan_blocks(n: int, distance: int, plans: tuple = PLANS) -> list[Block]:
    widths, checks = next((w, c) for least, w, c in reversed(plans) if n >= least)
    shifts = np.cumsum([0, *widths]).tolist()
    return [Block(i, shifts[i], w, checks, 1 + distance // len(widths)) for i, w in enumerate(widths)]


def replicate(fp: np.ndarray, blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys within reach of each fingerprint, and the fingerprints beside them."""
    keys, owners = [], []
    for block in blocks:
        masks, first, counts = patterns(block)
        value = block.value(fp)
        s = block.syndrome(value)
        n = counts[s]
        at = np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys.append(block.key(np.repeat(value, n) ^ masks[at]))
        owners.append(np.repeat(fp, n))
    return np.concatenate(keys), np.concatenate(owners)


def at_home(key: np.ndarray, fp: np.ndarray, blocks: list[Block]) -> np.ndarray:
    index, out = (key >> np.uint64(40)).astype(np.int64), np.zeros(len(key), bool)
    for block in blocks:
        own = index == block.index
        out[own] = block.key(block.home(block.value(fp[own]))) == key[own]
    return out


def link_run(fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long run, as trees: what is reached leaves the rest at once.

    Each pair with a member at home is compared unless both are known to be together.
    In a dense group nearly all is reached from the first few members, so the work
    grows with the run and not with its square.
    """
    homes, others = fp[home], fp[~home]
    links_a, links_b = [], []
    while len(homes):
        queue, homes = [(homes[0], True)], homes[1:]
        while queue:
            here, is_home = queue.pop()
            near = np.bitwise_count(homes ^ here) <= distance
            found, homes = homes[near], homes[~near]
            queue += [(x, True) for x in found]
            if is_home:
                near = np.bitwise_count(others ^ here) <= distance
                more, others = others[near], others[~near]
                queue += [(x, False) for x in more]
                found = np.concatenate([found, more])
            links_a.append(found)
            links_b.append(np.full(len(found), here))
    return (np.concatenate(links_a), np.concatenate(links_b)) if links_a else (fp[:0], fp[:0])


def link_runs(key: np.ndarray, fp: np.ndarray, blocks: list[Block], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys (sorted), thinned to a tree for each group."""
    home = at_home(key, fp, blocks)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(start, len(key)))
    row_start, row_length = np.repeat(start, length), np.repeat(length, length)
    a, b = [], []
    mine = np.flatnonzero(home & (row_length <= SHORT_RUN) & (row_length > 1))
    cuts = np.flatnonzero(np.diff(np.cumsum(row_length[mine]) // PAIRS, prepend=0)) if len(mine) else []
    for part in np.split(mine, cuts):
        n = row_length[part]
        left = np.repeat(part, n)
        right = np.repeat(row_start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= distance) & (left != right)
        a.append(fp[left[near]])
        b.append(fp[right[near]])
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN]):
        x, y = link_run(fp[s : s + n], home[s : s + n], distance)
        a.append(x)
        b.append(y)
    return stars(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def fingerprint_links(nodes: DataFrame, distance: int = 4, plans: tuple = PLANS) -> DataFrame:
    """Links (a, b) between distinct fingerprints; within ``distance`` bits means connected by links."""
    blocks = plan_blocks(nodes.count(), distance, plans)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 4096):
                key, owner = replicate(fp[k : k + 4096], blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(owner.view(np.int64))], names=["anchor", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = [], []
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def take(key: np.ndarray, fp: np.ndarray) -> None:
            nonlocal a, b
            x, y = link_runs(key, fp, blocks, distance)
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a) > 1 << 20:
                a, b = stars(a, b)

        for batch in batches:
            key, fp = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])  # the last run may go on in the next batch
            if held_key and last == 0 and key[0] == held_key[-1][-1]:
                held_key.append(key)
                held_fp.append(fp)
                continue
            if held_key or last:
                take(np.concatenate([*held_key, key[:last]]), np.concatenate([*held_fp, fp[:last]]))
            held_key, held_fp = [key[last:]], [fp[last:]]
        if held_key:
            take(np.concatenate(held_key), np.concatenate(held_fp))
        a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    copies = nodes.select("fp").mapInArrow(spread, "anchor long, fp long")
    dealt = copies.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, plans: tuple = PLANS, carry: Sequence[str] = ()) -> DataFrame:
    """Fingerprint and component of every document.

    Returns a row per input row: doc_id, ``fp`` (long), ``fingerprint`` (16
    hex digits) and ``component_id``, the smallest doc_id reachable over links of at
    most ``distance`` differing bits, itself included. Null, empty and blank texts
    share the fingerprint zero. Equal fingerprints are one node, so copies cost
    nothing beyond the first. A row with a null doc_id takes part like any other
    but is never a component's smallest; a component of such rows alone has a
    null component_id. An empty table gives an empty result; other columns are ignored, but with ``carry`` the columns that it
    names are returned too, and ``root``, a fingerprint that names the component whether or not it has a doc_id.
    """
    prints = cut(fingerprints(docs, carry))
    rows = prints.count()
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), rows)
    member = connected_components(fingerprint_links(nodes, distance, plans))
    roots = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(roots.join(least, "root").select("fp", "component_id", *(["root"] if carry else [])), rows)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id", *([*carry, "root"] if carry else []))
