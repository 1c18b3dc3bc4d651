"""k-means: explicit iterations whose results are reproducible, Spark's own, and a projection to two numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackframe.functions import vectors as v
from trackframe.operators.aggregates import zscore
from trackframe.operators.windows import Names
from trackframe.session import written


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column as rows, and which of them are whole: neither null, nor with nulls, nor of another length."""
    n = len(column)
    if not column.null_count and len(flat := column.flatten()) == n * dims and not flat.null_count and (column.value_lengths().to_numpy() == dims).all():
        return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, dims), np.ones(n, bool)
    rows = column.to_pylist()
    whole = np.array([x is not None and len(x) == dims and None not in x for x in rows], bool)
    return np.array([x if w else [0.0] * dims for x, w in zip(rows, whole)], float).reshape(n, dims), whole


def summed(n: int, dims: int, term) -> np.ndarray:
    """``term(0) + term(1) + ...``, added up in this order as Spark's aggregate over an array does."""
    out = np.zeros(n)
    for d in range(dims):
        out += term(d)
    return out


def nearest_row(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of the nearest row of ``c`` for each row of ``x``, the first of equal ones.

    A matrix product finds those that may be nearest; where they are several, ``squared`` is computed for these, added up as in Spark.
    """
    dims = c.shape[1]
    with np.errstate(all="ignore"):
        xx, cc = (x * x).sum(1), (c * c).sum(1)
        rough = xx[:, None] - 2 * (x @ c.T) + cc
        most = 4e-15 * (dims + 8) * (xx + cc.max())
        near = ~(rough > (np.nanmin(np.where(np.isnan(rough), np.inf, rough), axis=1) + most)[:, None])
        out = near.argmax(1)
        several = np.flatnonzero(near.sum(1) > 1)
        i, j = np.nonzero(near[several])
        d = summed(len(i), dims, lambda k: np.square(x[several[i], k] - c[j, k]))
    order = np.lexsort((j, d, i))
    first = order[np.unique(i[order], return_index=True)[1]]
    out[several[i[first]]] = j[first]
    return out


def assigned(df: DataFrame, centroids: DataFrame, vector: str, out: str = "cluster") -> DataFrame:
    """Add the nearest centroid, the first of equal ones; the first also where a vector is null or not as long as they are. The k centroids (cluster, centroid) come to the driver."""
    return _assigned(df, {r["cluster"]: r["centroid"] for r in centroids.collect()}, vector, out)


def _assigned(df: DataFrame, centroids: dict[int, list[float]], vector: str, out: str = "cluster", at_once: int = 2_000_000) -> DataFrame:
    kept = df.drop(out) if out in df.columns else df
    if not centroids:
        return kept.withColumn(out, F.lit(None).cast("int"))
    ids = np.array(sorted(centroids), np.int32)
    c = np.array([centroids[k] for k in ids.tolist()], float).reshape(len(ids), -1)
    ready = kept.withColumn("_x", v.doubles(F.col(vector)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, at_once // len(c))
        for batch in batches:
            x, whole = matrix(batch.column("_x"), c.shape[1])
            places = [nearest_row(x[k : k + step], c) for k in range(0, len(x), step)]
            place = np.where(whole, np.concatenate(places), 0) if places else np.zeros(0, int)
            columns = [batch.column(n) for n in kept_names] + [pa.array(ids[place])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_names, out])

    kept_names = kept.columns
    return ready.mapInArrow(run, T.StructType([*kept.schema, T.StructField(out, T.IntegerType())]))


def lloyd(df: DataFrame, key: str, vector: str, k: int, iterations: int = 100, tolerance: float = 1e-4, start: DataFrame | None = None) -> DataFrame:
    """Centroids (cluster, centroid) after Lloyd's iterations from ``start``, or from the k rows with the smallest keys.

    A cluster that loses all its rows gets the zero vector. Stops when no centroid moves by more than ``tolerance`` (squared). The vectors are
    written once, and each round is a map-side aggregate over them; k centroids come to the driver.
    """
    spark = df.sparkSession
    rows = written(df.select(F.col(key).alias("_key"), v.doubles(F.col(vector)).alias("_v")), "vectors")
    if start is None:
        first = rows.orderBy("_key").limit(k).collect()
        now = {i: r["_v"] for i, r in enumerate(first)}
    else:
        now = {r["cluster"]: r["centroid"] for r in start.collect()}
    dims = len(next(iter(now.values()))) if now else 0
    for _ in range(iterations if now else 0):
        sums = [F.sum(F.get("_v", F.lit(d))) for d in range(dims)]
        moved = _assigned(rows, now, "_v").groupBy("cluster").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()
        new = {c: [0.0] * dims for c in now} | {r["cluster"]: [x / r["n"] for x in r["s"]] for r in moved}
        shift = max(sum((a - b) ** 2 for a, b in zip(now[c], new[c])) for c in now)
        now = new
        if shift < tolerance:
            break
    return spark.createDataFrame(list(now.items()), "cluster int, centroid array<double>")


def cluster(features: DataFrame, key: str, cols: Names, k: int = 8, iterations: int = 100) -> tuple[DataFrame, DataFrame]:
    """Standardise the columns and cluster: (key with cluster, clusters with members, label and mean of each column)."""
    features = written(features.select(key, *(F.col(c).cast("double").alias(c) for c in cols)), "features")
    scaled = zscore(features, cols).withColumn("_v", F.array(*cols))
    centroids = lloyd(scaled, key, "_v", k, iterations)
    members = assigned(scaled.select(key, "_v"), centroids, "_v").select(key, "cluster")
    joined = features.join(members, key)
    info = joined.groupBy("cluster").agg(F.count("*").alias("members"), *(F.avg(c).alias(c) for c in cols))
    label = F.concat(F.lit("cluster_"), F.lpad((F.col("cluster") + 1).cast("string"), 2, "0"))
    return members, info.withColumn("label", label)


def inertia(df: DataFrame, centroids: DataFrame, vector: str) -> DataFrame:
    """Summed squared distance to the own centroid, and members, per cluster."""
    own = assigned(df, centroids, vector).join(F.broadcast(centroids), "cluster")
    return own.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(squared(v.doubles(F.col(vector)), F.col("centroid"))).alias("inertia"))


def ml_kmeans(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Spark's k-means with its parallel seeding; adds ``cluster``."""
    from pyspark.ml.clustering import KMeans

    ready = df.withColumn("_f", array_to_vector(v.doubles(F.col(vector))))
    return KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(ready).transform(ready).drop("_f")


def pca(df: DataFrame, vector: str, n: int = 2, out: str = "projected") -> DataFrame:
    """Principal components, as an array of n numbers."""
    ready = df.withColumn("_f", array_to_vector(v.doubles(F.col(vector))))
    made = PCA(k=n, inputCol="_f", outputCol="_p").fit(ready).transform(ready)
    return made.withColumn(out, vector_to_array("_p")).drop("_f", "_p")
