"""Connected components of a graph given as links, without collecting it anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import cut


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same groups as the links (a, b), each as a star around its smallest member."""
    if not len(a):
        return a, b
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)  # hook the old roots, so that trees merge as wholes
        np.minimum.at(label, before[y], low)
        label = label[label]
        if (label == before).all():
            break
    kept = label != np.arange(len(names))
    return names[kept], names[label[kept]]


def connected_components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` has two long columns a and b. Alternates two steps until nothing
    changes: every node hands its greater neighbours to its smallest one, then every
    node and its smaller neighbours go to the smallest. The number of rounds grows
    with the logarithm of the longest path. Both steps are an aggregate and a join. The
    aggregate is written before it is joined: then both sides of the join are plain
    exchanges, and Spark can split the rows of a node with very many links. ``most`` bounds the
    number of links, if the caller knows one.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * seen[0])
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), 2 * seen[0])
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), 2 * seen[0])
        inner = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(inner.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), 2 * seen[0])
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
