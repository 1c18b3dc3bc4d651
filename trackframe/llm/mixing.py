"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern, the set of sources they belong to. Token
capacity flows from patterns to sources: a pattern's first pass over its tokens is free, the
second costs 1, the third 2 and so on (convex costs of repetition), and a source takes up to
its quota. The network has a node for each pattern and source, so it is small however
many documents there are, and is solved on the driver. Then documents are
selected in a seeded order until each pattern's routed tokens are met.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import WORD, cut


def targets(total: int, sizes: Sequence[int], weights: Sequence[int], most: int = 3) -> list[Fraction]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared anew."""
    out: list[Fraction | None] = [None] * len(sizes)
    rest = Fraction(total)
    while free := [k for k, t in enumerate(out) if t is None]:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if rest * weights[k] / weight > most * sizes[k]]
        for k in over:
            out[k] = Fraction(most * sizes[k])
        if not over:
            for k in free:
                out[k] = max(rest, Fraction(0)) * weights[k] / weight
        rest -= sum(most * sizes[k] for k in over)
    return out


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], most: int = 3) -> list[list[int]]:
    """Tokens from each pattern to each of its sources: as much as the quotas take, at the least cost.

    Successive shortest paths: from a source whose quota is open, look for the cheapest way
    to more tokens, through patterns that can repeat once more and through sources that can
    take theirs from elsewhere instead (Bellman-Ford on the residual network). Ties go to
    the first pattern. Integers throughout.
    """
    n_p, n_s = len(capacity), len(quota)
    flow = [[0] * n_s for _ in range(n_p)]
    used = [0] * n_p
    while True:
        # Cost of one more token at each source, and the arc it comes by: from a pattern's own
        # capacity, or from a pattern that another source then gets replaced.
        best: list[tuple] = [(float("inf"),)] * n_s
        supply = [(used[p] // capacity[p] if capacity[p] else most, p) for p in range(n_p)]
        for cost, p in supply:
            if cost < most:
                for s in members[p]:
                    if (cost, p) < best[s][:2]:
                        best[s] = (cost, p, None)
        for _ in range(n_s):
            changed = False
            for p in range(n_p):
                for held in members[p]:
                    if flow[p][held] and best[held][0] < float("inf"):
                        for s in members[p]:
                            if s != held and best[held][0] < best[s][0]:
                                best[s] = (best[held][0], p, held)
                                changed = True
            if not changed:
                break
        gaps = [quota[s] - sum(flow[p][s] for p in range(n_p)) for s in range(n_s)]
        open_ = [s for s in range(n_s) if gaps[s] > 0 and best[s][0] < float("inf")]
        if not open_:
            return flow
        s = min(open_, key=lambda k: (best[k][0], k))
        path, at = [], s
        while at is not None:
            _, p, held = best[at]
            path.append((p, at, held))
            at = held
        p = path[-1][0]
        step = min(gaps[s], (used[p] // capacity[p] + 1) * capacity[p] - used[p], *(flow[q][h] for q, _, h in path if h is not None))
        for q, to, held in path:
            flow[q][to] += step
            if held is not None:
                flow[q][held] -= step
        used[p] += step


def size_of(text: str | Column = "text") -> Column:
    """Words of a text; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


#: First hex digits of the seeded order by which documents are summed up before any window.
BUCKET_DIGITS = 3


def select_seeded(sized: DataFrame, passes: DataFrame, key: str, seed: int, ties: Sequence[str] = ()) -> DataFrame:
    """``copies`` of every row: the full passes of its group, and one more for the first in the seeded order.

    ``passes`` has, for each value of ``key``, full passes and the tokens wanted beyond
    them (``rest``). The order is the md5 of seed and doc_id. Groups are summed up in 4096
    buckets of it first; only the bucket in which the rest runs out is put in order row by row, so no
    task sorts a whole source. The row at the border is taken if that is nearer.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = sized.withColumn("ord", digest).withColumn("bucket", F.substring("ord", 1, BUCKET_DIGITS))
    sums = rows.groupBy(key, "bucket").agg(F.sum("size").alias("tokens"))
    run = Window.partitionBy(key).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("tokens").over(run) - F.col("tokens"))
    sums = (
        sums.join(F.broadcast(passes), sums[key].eqNullSafe(passes[key]))
        .drop(passes[key])
        .withColumn(
            "place",
            F.when((F.col("rest") > 0) & (F.col("before") + F.col("tokens") <= F.col("rest")), "in").when(
                F.col("before") >= F.col("rest"), "out"
            ).otherwise("border"),
        )
    )
    right = sums.select(F.col(key).alias("k"), F.col("bucket").alias("b"), "before", "full", "rest", "place")
    placed = rows.join(right, rows[key].eqNullSafe(F.col("k")) & (rows["bucket"] == F.col("b"))).drop("k", "b")
    ordered = Window.partitionBy(key, "bucket").orderBy("ord", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    border = placed.where("place = 'border'").withColumn(
        "before", F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    )
    nearer = 2 * (F.col("rest") - F.col("before")) >= F.col("size")
    border = border.withColumn("more", (nearer & (F.col("before") < F.col("rest"))).cast("int"))
    sure = placed.where("place <> 'border'").withColumn("more", (F.col("place") == "in").cast("int"))
    return sure.unionByName(border).withColumn("copies", F.col("full") + F.col("more")).drop(
        "ord", "bucket", "before", "full", "rest", "place", "more"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: int = 42,
    sources: str = "source",
    max_patterns: int = 10_000,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How many words of every document the mix takes.

    ``sources`` is a source, or an array of sources for documents that belong to several. Sources
    in code-point order, null last, have ``weights`` in turn and share all words by them; a
    source's target stops at ``most`` times the words of its documents. Returns a
    row per input row: doc_id, ``sources`` as given, size, ``copies`` (0 to ``most``) and
    taken = copies * size, and with a plain source also source_size and target.

    A null text has size 0 and is taken 0 words; a null source is a source of its own; a null
    doc_id has its place in the order like any other; rows that are repeated in full are
    neighbours there, and whichever comes first is alike. The columns that ``carry`` names are returned too,
    and order rows of one doc_id and size. Other columns are ignored and an empty
    table gives an empty result. Patterns are collected to the driver: if there are more than
    ``max_patterns`` that is an error, never a cut.
    """
    many = dict(docs.dtypes)[sources].startswith("array")
    names = F.array_sort(F.array_distinct(F.col(sources).cast("array<string>"))) if many else F.array(F.col(sources).cast("string"))
    sized = cut(
        docs.select(F.col("doc_id").cast("long"), F.col(sources).alias("given"), names.alias("pattern"), size_of().alias("size"), *carry)
    )
    if many:  # an empty or null set of sources belongs to the null source
        none = F.col("pattern").isNull() | (F.size("pattern") < 1)
        sized = sized.withColumn("pattern", F.when(none, F.array(F.lit(None).cast("string"))).otherwise(F.col("pattern")))
    key = F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})
    sized = sized.withColumn("key", key)
    groups = sized.groupBy("key", "pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(groups) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    groups.sort(key=lambda g: g["key"])
    all_sources = sorted({s for g in groups for s in g["pattern"]}, key=lambda s: (s is None, s or ""))
    place = {s: k for k, s in enumerate(all_sources)}
    members = [[place[s] for s in g["pattern"]] for g in groups]
    capacity = [g["size"] for g in groups]
    held = [sum(c for c, m in zip(capacity, members) if k in m) for k in range(len(all_sources))]
    turn = [weights[k % len(weights)] for k in range(len(all_sources))]
    total = sum(capacity)
    wanted = targets(total, held, turn, most)
    flow = route(capacity, members, [int(t) for t in wanted], most)
    spark = docs.sparkSession
    passes = []
    for g, c, f in zip(groups, capacity, flow):
        routed = sum(f)
        passes.append((g["key"], routed // c if c else 0, routed % c if c else 0))
    table = spark.createDataFrame(passes, "key string, full long, rest long")
    out = select_seeded(sized, table, "key", seed, carry).withColumn("taken", F.col("copies") * F.col("size"))
    if many:
        return out.select("doc_id", F.col("given").alias(sources), "size", "copies", "taken", *carry)
    named = spark.createDataFrame(
        [(g["key"], int(held[m[0]]), float(wanted[m[0]])) for g, m in zip(groups, members)],
        "key string, source_size long, target double",
    )
    out = out.join(F.broadcast(named), "key")
    return out.select("doc_id", F.col("given").alias(sources), "size", "source_size", "target", "copies", "taken", *carry)
