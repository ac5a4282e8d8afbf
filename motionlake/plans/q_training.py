"""Queries of statistics, splits and samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chance import seeded_order
from ..operators import training as t
from .views import load, with_views


def _features(spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    (p,) = load(spark, sf_dir, "positions", given=given)
    values = [F.col(a) * k for k in (1.0, 2.0, 0.5, -1.0) for a in ("px", "py", "pz")]
    return p.select((F.substring("rig", -1, 1)).alias("dataset"), "rig", "clip", "frame", "j", F.array(*values).alias("f"))


_CH = """, ch AS (SELECT right(rig, 1) AS dataset, rig, j = 0 AS is_root, unnest(range(0, 12)) AS channel, unnest([px, py, pz, 2 * px, 2 * py, 2 * pz, px / 2, py / 2, pz / 2, -px, -py, -pz]) AS v FROM positions)"""


def frame_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.tie_std(t.stats_frame_weighted(_features(spark, sf_dir)))
    return out.select("dataset", "is_root", "channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


FRAME_WEIGHTED = with_views(
    _CH
    + """, s AS (SELECT dataset, is_root, channel, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS s FROM ch GROUP BY ALL)
    SELECT dataset, is_root, CAST(channel AS INT) AS channel, round(m, 6) AS mean, round(avg(s) OVER (PARTITION BY dataset, is_root, CASE WHEN channel < 3 THEN 0 WHEN channel < 9 THEN 1 ELSE 2 END), 6) AS std FROM s""",
    "positions",
)


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    pool = t.broadcast_pool(t.stats_balanced(f, pooled=True), f, "balanced")
    return pool.select("dataset", "is_root", "channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "pool")


BALANCED = with_views(
    _CH
    + """, r AS (SELECT dataset, rig, is_root, channel, avg(v) AS m, var_pop(v) AS v FROM ch GROUP BY ALL), s AS (SELECT is_root, channel, avg(m) AS m, greatest(sqrt(avg(v) + var_pop(m)), 1e-8) AS s FROM r GROUP BY ALL)
    SELECT d.dataset, is_root, CAST(channel AS INT) AS channel, round(m, 6) AS mean, round(s, 6) AS std, 'balanced' AS pool FROM s, (SELECT DISTINCT dataset FROM ch) d""",
    "positions",
)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    n = t.normalize(f, t.stats_frame_weighted(f))
    return n.select("clip", "frame", "j", F.round(F.col("f")[0], 5).alias("x"), F.round(F.col("f")[4], 5).alias("y"))


NORMALIZED = with_views(
    """, s AS (SELECT right(rig, 1) AS dataset, j = 0 AS r, avg(px) AS mx, greatest(stddev_pop(px), 1e-8) AS sx, avg(2 * py) AS my, greatest(stddev_pop(2 * py), 1e-8) AS sy FROM positions GROUP BY ALL)
    SELECT clip, frame, j, round((px - mx) / sx, 5) AS x, round((2 * py - my) / sy, 5) AS y FROM positions p JOIN s ON s.dataset = right(p.rig, 1) AND s.r = (p.j = 0)""",
    "positions",
)


def stats_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    rigs = load(spark, sf_dir, "rigs")[0].select(F.substring("rig", -1, 1).alias("dataset"))
    return t.check_stats(t.stats_frame_weighted(f).where("NOT (dataset = '1' AND channel = 3)"), rigs)


STATS_PROBLEMS = with_views("SELECT DISTINCT right(g.rig, 1) AS dataset, CASE WHEN p.d IS NULL THEN 'no statistics' ELSE 'wrong width' END AS reason FROM rigs g LEFT JOIN (SELECT DISTINCT right(rig, 1) AS d FROM positions) p ON p.d = right(g.rig, 1) WHERE p.d IS NULL OR p.d = '1'", "positions", "rigs")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions, rigs = load(spark, sf_dir, "captions", "rigs")
    clips = captions.select("clip", "rig")
    a = t.split_by_rig(clips, 0.15).withColumnRenamed("split", "by_rig")
    b = t.split_by_clip(clips, 0.25).select("clip", F.col("split").alias("by_clip"))
    c, _ = t.split_explicit(clips, clips.where("rig LIKE '%3'").select("rig"))
    return a.join(b, "clip").join(c.select("clip", F.col("split").alias("listed")), "clip").withColumn("half", t.hash_half(F.col("rig")))


SPLITS = with_views(
    """, r AS (SELECT rig, row_number() OVER (ORDER BY md5('42|' || rig)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT rig FROM captions)),
    c AS (SELECT clip, rig, row_number() OVER (PARTITION BY rig ORDER BY md5('42|' || clip)) AS k, count(*) OVER (PARTITION BY rig) AS n FROM captions)
    SELECT c.clip, c.rig, CASE WHEN r.k <= least(round_even(r.n * 0.15, 0), r.n - 1) THEN 'test' ELSE 'train' END AS by_rig, CASE WHEN c.k <= least(round_even(c.n * 0.25, 0), c.n - 1) THEN 'test' ELSE 'train' END AS by_clip,
    CASE WHEN c.rig LIKE '%3' THEN 'test' ELSE 'train' END AS listed, CASE WHEN right(sha1(c.rig), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'dev' ELSE 'test' END AS half FROM c JOIN r ON r.rig = c.rig""",
    "captions",
)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    clips = captions.select(F.col("lang").alias("dataset"), "rig", "clip")
    one = t.sampling_weights(clips, 0.5).withColumnRenamed("weight", "one_level")
    two = t.sampling_weights(clips, 0.5, 0.3).select("clip", F.col("weight").alias("two_levels"))
    return one.join(two, "clip").select("clip", F.round("one_level", 9).alias("one_level"), F.round("two_levels", 9).alias("two_levels"))


WEIGHTS = with_views(
    """, c AS (SELECT clip, lang AS d, rig, count(*) OVER (PARTITION BY lang, rig) AS n FROM captions), g AS (SELECT d, rig, any_value(n) AS n FROM c GROUP BY d, rig),
    s AS (SELECT d, pow(sum(n), 0.7) AS share, sum(pow(n, 0.5)) AS r FROM g GROUP BY d), u AS (SELECT d, share / sum(share) OVER () / r AS u FROM s)
    SELECT clip, round(pow(n, -0.5) / sum(pow(n, -0.5)) OVER (), 9) AS one_level, round(u * pow(n, 0.5) / n, 9) AS two_levels FROM c JOIN u ON u.d = c.d""",
    "captions",
)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    w = t.sampling_weights(captions.select(F.col("lang").alias("dataset"), "rig", "clip"), 0.5)
    return t.weighted_draw(w.select("clip", "weight"), "clip", 2000, 42)


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    versions = captions.select("clip", F.explode(F.array(*(F.lit(v) for v in ("normal", "generic", "detail")))).alias("version"), "text").where("version <> 'detail' OR lang = 'en'")
    out = t.choose_caption(captions.select("clip"), versions, {"generic": 0.3, "detail": 0.3}, 42)
    return t.choose_augmentation(out, ["leaf_removal", "joint_addition", "pooling", "bone_scale"], 42).select("clip", "version", "augmentation")


def joint_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return t.weighted_joint_pick(joints.where("j > 0").select("rig", "j", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2).alias("length")), 2, 42).select("rig", "j")


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    out = t.pad(frames, 64, "s")
    return out.select("clip", "length", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("values").alias("n"), F.size(F.filter("mask", lambda m: m)).alias("masked"))


PADDED = with_views("SELECT clip, CAST(count(*) AS INT) AS length, round(sum(s), 6) AS total, 64 AS n, CAST(count(*) AS INT) AS masked FROM frames WHERE frame < 64 GROUP BY clip", "frames")


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return t.crop(frames, 50, 42).groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


CROPPED = with_views("SELECT clip, least(count(*), 50) AS n, 0 AS first, CAST(least(count(*), 50) - 1 AS INT) AS last FROM frames GROUP BY clip", "frames")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    short = captions.select("clip", "rig", "text")
    return t.test_cases(short, short)


CASES = with_views("SELECT rig, text, min(clip) AS clip FROM captions GROUP BY 1, 2", "captions")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    return t.pick_reference_clip(captions, 5, 42)


REFERENCES = with_views(
    """, r AS (SELECT rig, clip, row_number() OVER (PARTITION BY rig ORDER BY md5('42|' || clip)) - 1 AS k, count(*) OVER (PARTITION BY rig) AS n FROM captions)
    SELECT rig, CAST(slot AS INT) AS slot, clip FROM r, range(0, 5) AS s(slot) WHERE slot % least(n, 5) = k""",
    "captions",
)


def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    sizes = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"))
    return t.keep_frames(sizes, "0, 5, -1, -3, 70, 5, 500")


KEPT_FRAMES = with_views(
    """, n AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip) SELECT DISTINCT clip, CAST(least(greatest(CASE WHEN i < 0 THEN i + n ELSE i END, 0), n - 1) AS INT) AS frame FROM n, (SELECT unnest([0, 5, -1, -3, 70, 5, 500]) AS i)""",
    "frames",
)


def kept_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    labels = raw.select("rig", "j", F.regexp_replace("raw", "_[0-9]+$", "").alias("label"))
    met, absent = t.keep_joints(labels, spark.createDataFrame([("leftARM|RightArm",), ("spine",), ("Tail|Fin",)], "name string"))
    return met.groupBy("name").agg(F.count(F.lit(1)).alias("n")).unionByName(absent.select("name", F.lit(0).cast("long").alias("n")))


KEPT_JOINTS = with_views(
    """, l AS (SELECT lower(regexp_replace(raw, '_[0-9]+$', '')) AS l FROM labels_raw) SELECT 'leftARM|RightArm' AS name, count(*) AS n FROM l WHERE l IN ('leftarm', 'rightarm') UNION ALL SELECT 'spine', count(*) FROM l WHERE l = 'spine' UNION ALL SELECT 'Tail|Fin', 0""",
    "labels_raw",
)


def subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return t.uniform_subsample(frames.select("clip", "frame"), 10)


SUBSAMPLED = with_views(", n AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip) SELECT DISTINCT clip, CAST(round_even(i * (n - 1) / 9, 0) AS INT) AS frame FROM n, range(0, 10) AS g(i)", "frames")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    return t.export_batches(captions.select("clip"), 16, seeded_order(42, F.col("clip")))


BATCHES = with_views(
    """, r AS (SELECT clip, row_number() OVER (ORDER BY md5('42|' || clip)) - 1 AS k, count(*) OVER () AS n FROM captions)
    SELECT k // 16 AS batch, list(clip ORDER BY k) AS clips FROM r WHERE k // 16 < n // 16 GROUP BY 1""",
    "captions",
)

QUERIES = {
    "h1_h3_stats_frame_weighted": (frame_weighted, FRAME_WEIGHTED),
    "h2_h4_stats_balanced": (balanced, BALANCED),
    "h5_check_stats": (stats_problems, STATS_PROBLEMS),
    "h6_normalize": (normalized, NORMALIZED),
    "i1_i5_splits": (splits, SPLITS),
    "i6_sampling_weights": (weights, WEIGHTS),
    "i7_weighted_draw": (draws, None),
    "i8_i9_choices": (choices, None),
    "i10_weighted_joint_pick": (joint_picks, None),
    "i15_crop": (cropped, CROPPED),
    "i16_pad": (padded, PADDED),
    "i18_export_batches": (batches, BATCHES),
    "i19_test_cases": (cases, CASES),
    "i20_reference_clips": (references, REFERENCES),
    "i21_keep_frames": (kept_frames, KEPT_FRAMES),
    "i22_keep_joints": (kept_joints, KEPT_JOINTS),
    "i23_uniform_subsample": (subsampled, SUBSAMPLED),
}
