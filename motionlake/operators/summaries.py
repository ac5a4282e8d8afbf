"""Counts, shares, histograms and curves over corpus metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def export_summary(clips: DataFrame, by: list[str], frames: str = "n_frames", fps: int = 30) -> DataFrame:
    """Clips, frames, seconds and minutes, rounded half to even."""
    n = F.sum(frames)
    return clips.groupBy(*by).agg(F.count(F.lit(1)).alias("clips"), n.alias("frames"), F.bround(n / fps, 2).alias("seconds"), F.bround(n / (fps * 60), 2).alias("minutes"))


def corpus_stats(clips: DataFrame, rigs: DataFrame, fps: int = 30) -> DataFrame:
    """One row of totals: clips, frames, minutes, rigs, most joints, clips and joints per rig."""
    c = clips.agg(F.count(F.lit(1)).alias("clips"), F.sum("n_frames").alias("frames"), F.bround(F.sum("n_frames") / (fps * 60), 2).alias("minutes"), F.count_distinct("rig").alias("rigs_with_clips"))
    r = rigs.agg(F.count(F.lit(1)).alias("rigs"), F.max("n_joints").alias("max_joints"), F.bround(F.avg("n_joints"), 4).alias("joints_per_rig"))
    return c.join(r, F.lit(True)).withColumn("clips_per_rig", F.bround(F.col("clips") / F.col("rigs_with_clips"), 4))


def percentile_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Least, tenth, quarter, median, mean, ... greatest, between values by linear interpolation."""
    p = F.expr(f"percentile({value}, array(0.1, 0.25, 0.5, 0.75, 0.9, 0.99))")
    out = df.groupBy(*by).agg(F.min(value).alias("min"), p.alias("_p"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    names = ("p10", "p25", "median", "p75", "p90", "p99")
    return out.select(*by, "min", *(F.col("_p")[k].alias(n) for k, n in enumerate(names)), "mean", "max")


def threshold_shares(df: DataFrame, value: str, thresholds: list[int], at_least: bool = True) -> DataFrame:
    """Rows at or beyond each threshold, and their share: one pass, one row a threshold."""
    def past(t: int) -> Column:
        return F.col(value) >= t if at_least else F.col(value) <= t

    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(past(t)).alias(f"_{t}") for t in thresholds))
    return one.select("_n", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_{t}").alias("n")) for t in thresholds))).alias("t")).select("t.threshold", "t.n", (F.col("t.n") / F.col("_n")).alias("share"))


def integer_hist(df: DataFrame, value: str) -> DataFrame:
    """Whole-number bins from the least value on: one wide for a span up to 30, two up to 60, else three."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") - F.col("_lo") <= 30, 1).when(F.col("_hi") - F.col("_lo") <= 60, 2).otherwise(3)
    out = df.join(F.broadcast(ends), F.lit(True)).withColumn("_w", width)
    lo = F.col("_lo") + F.floor((F.col(value) - F.col("_lo")) / F.col("_w")) * F.col("_w")
    return out.groupBy(lo.alias("bin"), F.col("_w").alias("width")).agg(F.count(F.lit(1)).alias("n"))


def cdf_curve(df: DataFrame, value: str) -> DataFrame:
    """The share of rows at or below each distinct value, and the share at or above it (survival)."""
    counts = df.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    below = F.sum("n").over(w)
    return counts.select("x", (below / total).alias("cdf"), ((total - below + F.col("n")) / total).alias("survival"))


def kde_curve(df: DataFrame, value: str, grid: list[float], factor: float, scale: float = 1.0) -> DataFrame:
    """Gaussian density at the grid's points, bandwidth `factor` times the sample deviation; nothing for fewer than two distinct values."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    h = df.agg((F.stddev_samp(value) * factor).alias("h"), F.count(F.lit(1)).alias("total"), F.count_distinct(value).alias("kinds"))
    points = spark.createDataFrame([(float(x),) for x in grid], "x double")
    every = counts.join(F.broadcast(h), F.lit(True)).where("kinds >= 2").join(F.broadcast(points), F.lit(True))
    z = (F.col("x") - F.col("v")) / F.col("h")
    density = F.sum(F.exp(-0.5 * z * z) * F.col("n")) / (F.first("total") * F.first("h") * 2.5066282746310002)
    return every.groupBy("x").agg((density * scale).alias("density"))


def label_coverage(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per rig, and over all as a null rig: joints, those whose label is neither in the vocabulary nor Bone, and the clean share."""
    known = vocabulary.select(F.col("label").alias("_v")).distinct()
    odd = labels.join(known, labels["label"] == F.col("_v"), "left").withColumn("odd", F.col("_v").isNull() & (F.col("label") != "Bone"))
    out = odd.groupingSets([["rig"], []], "rig").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("n_odd"))
    return out.withColumn("clean_share", 1 - F.col("n_odd") / F.col("n"))


def category_inventory(rigs: DataFrame) -> DataFrame:
    """category to its sorted rigs; errors are left out."""
    return rigs.where(F.col("category").isNotNull() & ~F.col("category").startswith("ERROR")).groupBy("category").agg(F.array_sort(F.collect_set("rig")).alias("rigs"))


def pooled_and_per_dataset(df: DataFrame, value: str, dataset: str = "dataset") -> DataFrame:
    """The same figures for each dataset and, with a null dataset, for all."""
    return df.groupingSets([[dataset], []], dataset).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.expr(f"percentile({value}, 0.5)").alias("median"))


def max_shape(rigs: DataFrame, headroom: int = 0, depth_limit: int | None = None) -> DataFrame:
    depth = F.least(F.max("depth"), F.lit(depth_limit)) if depth_limit is not None else F.max("depth")
    return rigs.groupingSets([["dataset"], []], "dataset").agg((F.max("n_joints") + headroom).alias("max_joints"), depth.alias("max_depth"))


def joint_limits_audit(rigs: DataFrame, least: int, most: int, limit: int = 20) -> DataFrame:
    """The largest rigs outside the limits; a top-k report."""
    return rigs.where(~F.col("n_joints").between(least, most)).orderBy(F.desc("n_joints"), "rig").limit(limit)


def dropped_translation_audit(offsets: DataFrame) -> DataFrame:
    """offsets(rig, clip, j, away, extent): each rig's largest translation away from rest over its extent, with its clip and joint; the root doesn't count."""
    r = F.col("away") / F.col("extent")
    top = F.max(F.struct(r.alias("ratio"), F.col("clip"), F.col("j"))).alias("t")
    return offsets.where("j > 0").groupBy("rig").agg(top).select("rig", "t.ratio", "t.clip", "t.j")


def metadata_report(rejects: DataFrame, rigs: DataFrame, captions: DataFrame) -> DataFrame:
    """(section, key, value): rejects per rig, rigs per category, captions per version."""
    parts = [("rejected", rejects, "rig"), ("category", rigs, "category"), ("captions", captions, "version")]
    out = None
    for section, df, key in parts:
        one = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(section).alias("section"), "key", "value")
        out = one if out is None else out.unionByName(one)
    return out
