"""Queries of rig conditions and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chance import seeded_order
from ..operators import conditions as c
from ..operators import training
from ..sources.staging import staged
from .q_captions import _LABELS
from .q_review import _PAIRS, _lengths, _named, _pairs
from .q_training import _CH, _features
from .q_trees import _UP, PAIRS
from .views import load, with_views

LENGTH = 40


def _text(rows: str) -> Column:
    return F.array_join(F.transform(F.flatten(rows), lambda x: x.cast("string")), ",")


def rig_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joints = _lengths(spark, sf_dir).join(_named(spark, sf_dir).select("rig", "j", "name"), ["rig", "j"])
    out = c.rig_condition(joints, _pairs(spark, sf_dir))
    lists = (F.array_join(F.transform(a, lambda x: x.cast("string")), ",").alias(a) for a in ("parents", "depths"))
    return out.select("rig", "n_joints", *lists, _text("relations").alias("relations"), _text("distances").alias("distances"), _text("edges").alias("edges"), F.size("spectra").alias("n_spectra"), F.col("face.right").alias("right"), F.col("face.left").alias("left"))


_MATRICES = ", pr AS (" + PAIRS + """), mx AS (SELECT rig, string_agg(CAST(CASE relation WHEN 'self' THEN 0 WHEN 'parent' THEN 1 WHEN 'child' THEN 2 WHEN 'sibling' THEN 3 WHEN 'none' THEN 4 ELSE 5 END AS VARCHAR), ',' ORDER BY a, b) AS relations,
  string_agg(CAST(distance AS VARCHAR), ',' ORDER BY a, b) AS distances, sum(CASE relation WHEN 'self' THEN 0 WHEN 'parent' THEN 1 WHEN 'child' THEN 2 WHEN 'sibling' THEN 3 WHEN 'none' THEN 4 ELSE 5 END) AS rs, sum(distance) AS ds FROM pr GROUP BY rig)"""
RIG_CONDITIONS = with_views(
    _LABELS + _PAIRS + _UP + _MATRICES + """, js AS (SELECT joints.rig, count(*) AS n_joints, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY joints.j) AS parents, string_agg(CAST(depth AS VARCHAR), ',' ORDER BY joints.j) AS depths,
    concat_ws(',', string_agg(CAST(joints.j AS VARCHAR), ',' ORDER BY joints.j) FILTER (parent >= 0), string_agg(CAST(parent AS VARCHAR), ',' ORDER BY joints.j) FILTER (parent >= 0)) AS one,
    concat_ws(',', string_agg(CAST(parent AS VARCHAR), ',' ORDER BY joints.j) FILTER (parent >= 0), string_agg(CAST(joints.j AS VARCHAR), ',' ORDER BY joints.j) FILTER (parent >= 0)) AS other FROM joints JOIN dp ON dp.rig = joints.rig AND dp.j = joints.j GROUP BY joints.rig)
    SELECT js.rig, n_joints, parents, depths, relations, distances, concat_ws(',', nullif(one, ''), nullif(other, '')) AS edges, n_joints AS n_spectra, "right", "left" FROM js JOIN mx ON mx.rig = js.rig LEFT JOIN fp ON fp.rig = js.rig""",
    "labels_raw",
    "joints",
)


def _total(nested: Column) -> Column:
    return F.aggregate(nested, F.lit(0.0), lambda s, x: s + x)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole batch of 16 clips, by the sizes of its padded rows and sums of what they hold."""
    clips, joints = load(spark, sf_dir, "clips", "joints")
    # written: clips, and of all rigs' joints those that clips hang on, from which features, lengths and names are taken
    clips = staged(clips, "clips")
    given = {"clips": clips, "joints": staged(joints.join(clips.select("rig").distinct(), "rig", "left_semi").select(joints.columns), "clip-joints")}
    features = _features(spark, sf_dir, given)
    used = _lengths(spark, sf_dir, given).join(_named(spark, sf_dir, given).select("rig", "j", "name"), ["rig", "j"])
    own = clips.select("clip", "rig", F.substring("rig", -1, 1).alias("dataset"))
    out = c.padded_batches(
        training.export_batches(clips.select("clip"), 16, seeded_order(42, F.col("clip"))), own, features.select("clip", "frame", "j", "f"), c.rig_condition(used), training.stats_frame_weighted(features), LENGTH,
    )
    return out.select(
        "batch", "slot", "clip", "n_joints", "length", F.size("motion").alias("width"), F.size(F.get(F.get("motion", F.size("motion") - 1), F.lit(11))).alias("places"),
        F.round(_total(F.flatten(F.flatten("motion"))), 3).alias("motion"), F.round(_total(F.flatten("mean")), 3).alias("mean"), F.round(_total(F.flatten("std")), 3).alias("std"),
        F.aggregate(F.flatten("relations"), F.lit(0), lambda s, x: s + x).alias("relations"), F.size(F.flatten("distances")).alias("cells"), F.aggregate(F.flatten("distances"), F.lit(0), lambda s, x: s + x).alias("distances"),
        F.size(F.filter("joint_mask", lambda x: x)).alias("joints_marked"), F.size(F.filter("length_mask", lambda x: x)).alias("places_marked"), F.size("spectra").alias("spectra"),
    )


BATCHES = with_views(
    _UP + _MATRICES + _CH + """, k AS (SELECT clip, rig, n_joints, row_number() OVER (ORDER BY md5('42|' || clip)) - 1 AS k, count(*) OVER () AS n FROM clips),
    b AS (SELECT clip, rig, n_joints, k // 16 AS batch, k % 16 AS slot, max(n_joints) OVER (PARTITION BY k // 16) AS w FROM k WHERE k // 16 < n // 16),
    f AS (SELECT clip, least(max(frame) + 1, 40) AS length, sum(px + py + pz) FILTER (frame < 40) * 2.5 AS m FROM positions GROUP BY clip),
    s AS (SELECT dataset, is_root, sum(m) AS m, sum(s) AS s FROM (SELECT dataset, is_root, channel, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS s FROM ch GROUP BY ALL) GROUP BY ALL)
    SELECT batch, slot, b.clip, n_joints, length, w AS width, 40 AS places, round(f.m, 3) AS motion, round(r.m + (n_joints - 1) * coalesce(o.m, 0), 3) AS mean, round(r.s + (n_joints - 1) * coalesce(o.s, 0) + 12 * (w - n_joints), 3) AS std,
    rs AS relations, w * w AS cells, ds AS distances, n_joints AS joints_marked, length AS places_marked, w AS spectra
    FROM b JOIN f ON f.clip = b.clip JOIN mx ON mx.rig = b.rig JOIN s r ON r.dataset = right(b.rig, 1) AND r.is_root LEFT JOIN s o ON o.dataset = right(b.rig, 1) AND NOT o.is_root""",
    "positions",
)

QUERIES = {
    "j8_rig_condition": (rig_conditions, RIG_CONDITIONS),
    "i18_padded_batches": (batches, BATCHES),
}
