"""Reports over clips and vectors: database statistics, standardising, averages, contrastive losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.functions import vectors as v
from trackframe.operators.windows import Names, whole
from trackframe.schema import motion_types


def database_stats(clips: DataFrame, player: str = "player_id") -> DataFrame:
    """One row: clips, frames, seconds, and players (ids from 0 on; others are unknown)."""
    return clips.agg(
        F.count("*").alias("total_clips"),
        F.coalesce(F.sum("n_frames"), F.lit(0)).cast("long").alias("total_frames"),
        F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("total_seconds"),
        F.countDistinct(F.when(F.col(player) >= 0, F.col(player))).alias("unique_players"),
    )


def type_counts(clips: DataFrame, label: str = "motion_type", all_types: DataFrame | None = None) -> DataFrame:
    """Clips of each type, most first; with the dimension of all types also those without any."""
    out = clips.groupBy(label).agg(F.count("*").alias("n"))
    if all_types is not None:
        out = all_types.join(out, label, "left").fillna(0, ["n"])
    return out.orderBy(F.desc("n"), label)


def counts_by_motion(spark: SparkSession, clips: DataFrame, label: str = "motion_type") -> DataFrame:
    return type_counts(clips, label, motion_types(spark).select(F.col("name").alias(label)))


def cube(clips: DataFrame, dims: Names, measure: str) -> DataFrame:
    """All subtotals over ``dims``, with the level as ``grouping_id``."""
    return clips.cube(*dims).agg(F.grouping_id().alias("grouping_id"), F.count("*").alias("n"), F.sum(measure).alias("total"))


def rollup(clips: DataFrame, dims: Names, measure: str) -> DataFrame:
    return clips.rollup(*dims).agg(F.grouping_id().alias("grouping_id"), F.count("*").alias("n"), F.sum(measure).alias("total"))


def grouping_sets(clips: DataFrame, sets: list[Names], dims: Names, measure: str) -> DataFrame:
    """Subtotals over the given sets of ``dims`` only."""
    cols = [[F.col(c) for c in s] for s in sets]
    return clips.groupingSets(cols, *dims).agg(F.grouping_id().alias("grouping_id"), F.count("*").alias("n"), F.sum(measure).alias("total"))


def approximate(clips: DataFrame, by: Names, player: str, measure: str) -> DataFrame:
    """Distinct players and quartiles from sketches of bounded size."""
    return clips.groupBy(*by).agg(
        F.approx_count_distinct(player, 0.02).alias("players"),
        F.percentile_approx(measure, [0.25, 0.5, 0.75], 10_000).alias("quartiles"),
    )


def zscore(df: DataFrame, cols: Names, by: Names = ()) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is below 1e-8).

    Statistics are one row, or one for each ``by``, that is joined to the rows; nothing is sorted.
    """
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = df.groupBy(*by).agg(*aggs)
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    made = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    return joined.withColumns(made).drop(*(c for c in joined.columns if c.startswith(("_m_", "_s_"))))


def sample_scale(df: DataFrame, by: Names, col: str) -> DataFrame:
    """Mean, sample variance and sqrt(variance + 1e-8) per group."""
    out = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.coalesce(F.var_samp(col), F.lit(0.0)).alias("variance"))
    return out.withColumn("scale", F.sqrt(F.col("variance") + 1e-8))


def mean_vectors(df: DataFrame, by: Names, col: str, unit: bool = True) -> DataFrame:
    """Mean of each group's vectors, by place, then unit length."""
    cells = df.select(*by, F.posexplode(v.doubles(F.col(col))).alias("_d", "_x")).groupBy(*by, "_d").agg(F.avg("_x").alias("_x"))
    packed = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("_m"))
    return packed.select(*by, (v.normalized(F.col("_m")) if unit else F.col("_m")).alias(col))


def _scores(df: DataFrame, key: str, label: str, vector: str, temperature: float, blocks: int, batch: str | None = None) -> DataFrame:
    """Scaled similarities of all ordered pairs of different rows: a batch's loss needs them all.

    The batch is what the loss is over and is small; its rows are dealt into ``blocks`` so that the pairs spread over tasks. With a
    column ``batch`` there are many of them, and pairs are made within each only.
    """
    rows = df.select(F.col(key).alias("k"), F.col(label).alias("l"), v.normalized(v.doubles(F.col(vector))).alias("e"), *([F.col(batch).alias("_b")] if batch else []))
    if batch:
        a = b = rows
    else:
        a = rows.withColumn("_b", F.pmod(F.xxhash64("k"), F.lit(blocks)))
        b = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = a.alias("a").join(b.alias("b"), "_b").where("a.k <> b.k")
    raw = v.dot(F.col("a.e"), F.col("b.e"))
    return pairs.select(F.col("a.k").alias("anchor"), (F.col("a.l") == F.col("b.l")).alias("same"), raw.alias("raw"), (raw / temperature).alias("sim"))


def contrastive(df: DataFrame, key: str, label: str, vector: str, temperature: float = 0.07, margin: float | None = None, smoothing: float = 0.0, clamp: tuple[float, float] = (0.0, 100.0), blocks: int = 8, batch: str | None = None) -> DataFrame:
    """Loss of each anchor in a batch: log of the summed exponentials of its similarities less the mean over its positives.

    With a ``margin`` only negatives within it of the most similar positive count, where there are any. Returns anchor, loss (null
    without a positive), positives, and the least similar positive and most similar negative. The rows are one batch, or those
    with one value of the column ``batch`` are; keys are unique over all batches.
    """
    s = _scores(df, key, label, vector, temperature, blocks, batch)
    if margin is not None:
        w = whole(["anchor"])
        s = s.withColumn("_p", F.max(F.when(F.col("same"), F.col("sim"))).over(w))
        hard = ~F.col("same") & (F.col("sim") > F.coalesce("_p", F.lit(-1e9)) - margin / temperature)
        s = s.withColumn("_h", hard).withColumn("_any", F.max("_h").over(w))
        s = s.withColumn("sim", F.when(F.col("same") | F.col("_h") | ~F.col("_any"), F.col("sim")).otherwise(-1e9))
    top = s.groupBy("anchor").agg(F.max("sim").alias("_top"))
    out = s.join(top, "anchor").groupBy("anchor").agg(
        (F.max("_top") + F.log(F.sum(F.exp(F.col("sim") - F.col("_top"))))).alias("_lse"),
        F.avg(F.when(F.col("same"), F.col("sim"))).alias("_pos"),
        F.sum(F.col("same").cast("int")).alias("positives"),
        F.min(F.when(F.col("same"), F.col("raw"))).alias("hardest_positive"),
        F.max(F.when(~F.col("same"), F.col("raw"))).alias("hardest_negative"),
        F.avg(F.when(F.col("same"), F.col("raw"))).alias("mean_positive"),
        F.avg(F.when(~F.col("same"), F.col("raw"))).alias("mean_negative"),
        F.count("*").alias("_n"),
    )
    loss = F.col("_lse") - F.col("_pos")
    if smoothing:
        loss = loss * (1 - smoothing) + smoothing * F.log(F.col("_n").cast("double"))
    loss = F.least(F.greatest(loss, F.lit(clamp[0])), F.lit(clamp[1]))
    return out.withColumn("loss", F.when(F.col("positives") > 0, loss)).drop("_lse", "_pos", "_n")


def batch_loss(anchors: DataFrame) -> DataFrame:
    """Mean loss over anchors with a positive (0 without one) and the batch's statistics."""
    return anchors.agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"),
        F.coalesce(F.sum("positives"), F.lit(0)).cast("long").alias("positive_pairs"),
        F.count("loss").alias("anchors_with_positives"),
        F.min("hardest_positive").alias("hardest_positive"),
        F.max("hardest_negative").alias("hardest_negative"),
    )


def triplet_loss(anchors: DataFrame, margin: float = 0.3) -> DataFrame:
    """Hardest-triplet loss on similarities: how much the hardest negative is nearer than the hardest positive less the margin."""
    gap = F.col("hardest_negative") - F.col("hardest_positive") + margin
    return anchors.where("hardest_positive is not null and hardest_negative is not null").withColumn("triplet", F.greatest(gap, F.lit(0.0)))


def pair_masks(df: DataFrame, key: str, label: str, blocks: int = 8) -> DataFrame:
    """Positives and negatives of each anchor, counted from label sizes: no pair is made."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    sizes = n.withColumn("_all", total)  # a row for each label
    return df.join(sizes, label).select(F.col(key).alias("anchor"), (F.col("_n") - 1).alias("positives"), (F.col("_all") - F.col("_n")).alias("negatives"))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))
