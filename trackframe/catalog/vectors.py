"""Vectors: search, averages, losses, interpolation, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog.base import query, r6, read
from trackframe.functions import vectors as v
from trackframe.operators import aggregates, association, clustering, search


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("e"))


def _queries(df: DataFrame) -> DataFrame:
    return df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "e")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_dot_product(a.e, b.e) / (a.n * b.n) AS d FROM e a, e b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) - 1 AS rank FROM s)
SELECT query_id, rank, vec_id FROM r WHERE rank BETWEEN 1 AND 5"""
)
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    out = search.knn_join(_queries(df), df, 6, "query_id", "vec_id", "e").where("rank > 0")
    return out.select("query_id", F.col("rank").cast("long"), "vec_id")


L2 = "sqrt(list_sum(list_transform(list_zip(e, q), lambda z: power(z[1] - z[2], 2))))"
L2_PAIRS = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, a.e AS q, b.vec_id, b.e FROM e a, e b WHERE a.vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, {L2} AS d FROM p)"""


@query(f"WITH {L2_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) - 1 AS rank FROM s) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank < 10")
def knn_l2_join(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest rows of every query by Euclidean distance, itself included."""
    df = _vectors(spark, sf)
    out = search.knn_join(_queries(df), df, 10, "query_id", "vec_id", "e", "euclidean")
    return out.select("query_id", F.col("rank").cast("long"), "vec_id", r6("distance"))


@query(f"WITH {L2_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) - 1 AS rank FROM s WHERE d <= 1.2) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank < 50")
def knn_threshold_join(spark: SparkSession, sf: str) -> DataFrame:
    """The rows within a distance of every query, the fifty nearest at most."""
    df = _vectors(spark, sf)
    out = search.knn_join(_queries(df), df, 50, "query_id", "vec_id", "e", "euclidean", max_distance=1.2)
    return out.select("query_id", F.col("rank").cast("long"), "vec_id", r6("distance"))


@query(f"WITH {L2_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS i FROM s WHERE vec_id <> query_id) SELECT query_id, vec_id, round(d, 6) AS distance FROM r WHERE i = 1")
def nearest_style_join(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other row of every query: of its two nearest rows one at least is another."""
    df = _vectors(spark, sf)
    out = search.knn_join(_queries(df), df, 2, "query_id", "vec_id", "e", "euclidean").where("vec_id <> query_id")
    least = out.groupBy("query_id").agg(F.min(F.struct("distance", "vec_id")).alias("r"))
    return least.select("query_id", "r.vec_id", r6("r.distance", "distance"))


@query()
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest rows of every query, from three quarters of the cells."""
    df = _vectors(spark, sf)
    index = search.VectorIndex.build(df, "vec_id", "e", cells=search.VectorIndex.CELLS)
    out = index.search_join(_queries(df), "query_id", 10)
    return out.select("query_id", F.col("rank").cast("long"), "vec_id", r6("score"))


@query(
    """WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label)
SELECT c.label, i::BIGINT AS dim, round(x / n, 6) + 0.0 AS x FROM c JOIN n ON c.label = n.label"""
)
def label_centroid(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregates.mean_vectors(_vectors(spark, sf), ["label"], "e")
    return out.select("label", F.posexplode("e").alias("dim", "x")).select("label", F.col("dim").cast("long"), r6("x"))


BATCHES = """n AS (SELECT vec_id, label, vec_id // 128 AS batch, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT x.vec_id AS anchor, x.label = y.label AS same, list_dot_product(x.e, y.e) / (x.n * y.n) AS raw FROM n x JOIN n y ON x.batch = y.batch AND x.vec_id <> y.vec_id)
"""


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table as training batches of 128 ids each."""
    return _vectors(spark, sf).withColumn("batch", F.shiftright("vec_id", 7))


@query(
    f"""WITH {BATCHES}, t AS (SELECT anchor, max(raw / 0.07) AS top FROM p GROUP BY anchor),
l AS (SELECT p.anchor, any_value(top) + ln(sum(exp(raw / 0.07 - top))) - avg(raw / 0.07) FILTER (WHERE same) AS loss, count(*) FILTER (WHERE same) AS positives FROM p JOIN t ON p.anchor = t.anchor GROUP BY p.anchor)
SELECT anchor, positives, round(least(greatest(loss, 0), 100), 6) AS loss FROM l WHERE positives > 0"""
)
def nt_xent_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The contrastive loss of every row: each is an anchor within its own batch."""
    out = aggregates.contrastive(_batches(spark, sf), "vec_id", "label", "e", batch="batch")
    return out.where("positives > 0").select("anchor", "positives", r6("loss"))


@query(
    f"""WITH {BATCHES}, h AS (SELECT anchor, min(raw) FILTER (WHERE same) AS hp, max(raw) FILTER (WHERE NOT same) AS hn FROM p GROUP BY anchor)
SELECT anchor, round(hp, 6) AS hardest_positive, round(hn, 6) AS hardest_negative, round(greatest(hn - hp + 0.3, 0), 6) AS triplet FROM h WHERE hp IS NOT NULL AND hn IS NOT NULL"""
)
def hard_triplets_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The hardest positive and negative of every row, within its batch."""
    out = aggregates.triplet_loss(aggregates.contrastive(_batches(spark, sf), "vec_id", "label", "e", batch="batch"))
    return out.select("anchor", r6("hardest_positive"), r6("hardest_negative"), r6("triplet"))


@query("SELECT vec_id AS anchor, count(*) OVER (PARTITION BY label) - 1 AS positives, count(*) OVER () - count(*) OVER (PARTITION BY label) AS negatives FROM embeddings")
def pair_masks(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.pair_masks(_vectors(spark, sf), "vec_id", "label")


@query("SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 2")
def labels_with_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return association.with_at_least(_vectors(spark, sf), "label", 2).select("label").distinct()


PAIR = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    nxt = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    return df.select("vec_id", F.col("e").alias("a")).join(nxt, "vec_id")


def _cells(df: DataFrame, made: str = "m") -> DataFrame:
    out = df.select("vec_id", F.posexplode(made).alias("dim", "x"))
    return out.select("vec_id", F.col("dim").cast("long"), r6("x"))


def _unit_sql(mixed: str, extra: str = "") -> str:
    return f"""WITH {PAIR}{extra}, m AS (SELECT vec_id, {mixed} AS m FROM {'p' if not extra else 'g'}), n AS (SELECT vec_id, m, sqrt(list_dot_product(m, m)) AS n FROM m)
SELECT vec_id, unnest(range(64))::BIGINT AS dim, round(unnest(list_transform(m, lambda x: x / n)), 6) + 0.0 AS x FROM n"""


@query(_unit_sql("list_transform(list_zip(a, b), lambda z: z[1] * 0.7 + z[2] * 0.3)"))
def embed_lerp(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_pairs(spark, sf).withColumn("m", v.lerp(F.col("a"), F.col("b"), 0.3)))


@query(
    _unit_sql(
        "list_transform(list_zip(a, b), lambda z: wa * z[1] + wb * z[2])",
        """, t AS (SELECT *, acos(least(greatest(list_dot_product(a, b), -1), 1)) AS t FROM p), g AS (SELECT *, sin(0.7 * t) / sin(t) AS wa, sin(0.3 * t) / sin(t) AS wb FROM t)""",
    )
)
def embed_slerp(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_pairs(spark, sf).withColumn("m", v.slerp(F.col("a"), F.col("b"), 0.3)))


@query(_unit_sql("list_transform(list_zip(a, b), lambda z: z[1] * 0.75 + z[2] * 0.25)"))
def embed_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_pairs(spark, sf).withColumn("m", v.blend([F.col("a"), F.col("b")], [3.0, 1.0])))


def _kmeans_sql(k: int, rounds: int) -> str:
    parts = [
        "e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, e AS m FROM (SELECT * FROM e ORDER BY vec_id LIMIT {k}))",
    ]

    def own(i: int) -> str:
        return (
            f"a{i} AS (SELECT vec_id, any_value(e) AS e, arg_min(c, (d, c)) AS c FROM (SELECT vec_id, e, c, list_sum(list_transform(list_zip(e, m), lambda z: power(z[1] - z[2], 2))) AS d FROM e, c{i}) GROUP BY vec_id)"
        )

    for i in range(rounds):
        parts.append(own(i))
        parts.append(
            f"c{i + 1} AS (SELECT c, list(x ORDER BY i) AS m FROM (SELECT c, i, avg(x) AS x FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)"
        )
    parts.append(own(rounds))
    return f"WITH {', '.join(parts)} SELECT vec_id, c::BIGINT AS cluster FROM a{rounds}"


@query(_kmeans_sql(6, 3))
def kmeans_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    centroids = clustering.lloyd(df, "vec_id", "e", 6, iterations=3, tolerance=-1.0)
    return clustering.assigned(df, centroids, "e").select("vec_id", F.col("cluster").cast("long"))


@query()
def kmeans_spark(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.ml_kmeans(_vectors(spark, sf), "e", 8).select("vec_id", "cluster")


@query()
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.pca(_vectors(spark, sf), "e").select("vec_id", "projected")
