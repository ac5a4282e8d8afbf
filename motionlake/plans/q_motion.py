"""Queries of facing, placement and motion features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import qunit, quat, vec
from ..operators import motion as m
from ..sources.staging import staged
from .views import load, with_views


def _poses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames of the rigs with three joints or more, and those rigs with joints 1 and 2 for a facing pair."""
    positions, joints, clips = load(spark, sf_dir, "positions", "joints", "clips")
    turn = qunit(quat(F.lit(1.0), F.sin("px") * 0.3, F.sin("py") * 0.3, F.sin("pz") * 0.3))
    frames = positions.groupBy("clip", "rig", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", vec(F.col("px"), F.col("py"), F.col("pz")).alias("p"), turn.alias("q")))), lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q"))).alias("pose"))
    # written: of the rigs those that clips hang on, for each of the steps that look them up
    rigs = joints.groupBy("rig").agg(F.array_sort(F.collect_list(F.struct("j", "parent"))).alias("joints")).where(F.size("joints") >= 3)
    rigs = staged(rigs.join(clips.select("rig").distinct(), "rig", "left_semi"), "clip-rigs").withColumn("right", F.lit(1)).withColumn("left", F.lit(2))
    return frames.join(rigs.select("rig"), "rig", "left_semi").select("clip", "rig", "frame", "pose"), rigs


def facings(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, rigs = _poses(spark, sf_dir)
    return m.facing(frames, rigs).select("clip", "frame", F.round(F.abs(F.col("facing.w")), 6).alias("w"))


_FACING = """, a AS (SELECT p.clip, p.frame, r.px - l.px AS x, r.pz - l.pz AS z FROM positions p JOIN positions r ON r.clip = p.clip AND r.frame = p.frame AND r.j = 1 JOIN positions l ON l.clip = p.clip AND l.frame = p.frame AND l.j = 2 WHERE p.j = 0),
v AS (SELECT clip, frame, CASE WHEN sqrt(x * x + z * z) > 1e-6 THEN z / sqrt(x * x + z * z) END AS fx, CASE WHEN sqrt(x * x + z * z) > 1e-6 THEN -x / sqrt(x * x + z * z) END AS fz FROM a),
n AS (SELECT v.clip, v.frame, u.fx, u.fz, row_number() OVER (PARTITION BY v.clip, v.frame ORDER BY abs(u.frame - v.frame), u.frame) AS k FROM v LEFT JOIN v u ON u.clip = v.clip AND u.fx IS NOT NULL)"""
FACINGS = with_views(_FACING + " SELECT clip, frame, round(CASE WHEN fz < -1 + 1e-9 THEN 0 ELSE sqrt((1 + fz) / 2) END, 6) AS w FROM n WHERE k = 1", "positions")


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical clips' features and how far the places recovered from them are from the source."""
    frames, rigs = _poses(spark, sf_dir)
    placed = staged(m.canonicalize(m.facing(frames, rigs), rigs.select("rig", F.lit(0.5).alias("scale"))).where("facing IS NOT NULL"), "canonical")
    features = staged(m.motion_features(placed, rigs), "features")
    gate = m.feature_row_gate(features, placed)
    sizes = features.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(F.col("f")[1]), 6).alias("lowest"))
    return gate.join(sizes, "clip").select("clip", F.coalesce("reason", F.lit("ok")).alias("verdict"), "n", (F.col("lowest") >= 0).alias("grounded"))


RECOVERED = with_views(
    ", g AS (SELECT rig FROM joints GROUP BY rig HAVING count(*) >= 3) SELECT clip, 'ok' AS verdict, count(*) - count(DISTINCT j) AS n, true AS grounded FROM positions p JOIN g ON g.rig = p.rig GROUP BY clip",
    "positions",
)


def mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return m.name_pairs_by_mirror(joints.select("rig", "j", F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"), F.lit(5.0).alias("extent")))


_M = "SELECT a.rig, '{s}' AS axis, a.j AS a, b.j AS b, sqrt(pow(a.o{s} + b.o{s}, 2) + pow(a.oy - b.oy, 2) + pow(a.o{t} - b.o{t}, 2)) AS d FROM joints a JOIN joints b ON b.rig = a.rig AND b.j <> a.j AND a.o{s} > 0 AND b.o{s} < 0"
MIRRORS = with_views(
    f""", d AS ({_M.format(s="x", t="z")} UNION ALL {_M.format(s="z", t="x")}), e AS (SELECT *, row_number() OVER (PARTITION BY rig, axis, a ORDER BY d, b) AS k FROM d WHERE d <= 0.15),
    n AS (SELECT rig, axis, row_number() OVER (PARTITION BY rig ORDER BY count(*) DESC, axis) AS r FROM e WHERE k = 1 GROUP BY rig, axis)
    SELECT e.rig, e.axis, a, b FROM e JOIN n ON n.rig = e.rig AND n.axis = e.axis AND r = 1 WHERE k = 1""",
    "joints",
)


def upside_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    part = F.when(F.col("part") % 3 == 0, "Foot").when(F.col("part") % 3 == 1, "Head")
    return m.upside_down_audit(joints.select("rig", part.alias("part"), F.col("oy").alias("y"), F.lit(1.0).alias("extent")))


UPSIDE_DOWN = with_views("SELECT rig FROM joints GROUP BY rig HAVING avg(CASE WHEN part % 3 = 0 THEN oy END) - avg(CASE WHEN part % 3 = 1 THEN oy END) > 0.1", "joints")


def amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = _poses(spark, sf_dir)
    return m.rotation_amplitude(frames).select("clip", "j", F.round("amplitude", 3).alias("amplitude"))


AMPLITUDES = with_views(
    """, g AS (SELECT rig FROM joints GROUP BY rig HAVING count(*) >= 3), q AS (SELECT clip, frame, j, 1 / sqrt(1 + 0.09 * (pow(sin(px), 2) + pow(sin(py), 2) + pow(sin(pz), 2))) AS k, 0.3 * sin(px) AS x, 0.3 * sin(py) AS y, 0.3 * sin(pz) AS z FROM positions p JOIN g ON g.rig = p.rig)
    SELECT q.clip, q.j, round(max(degrees(2 * acos(least(1.0, abs(q.k * f.k * (1 + q.x * f.x + q.y * f.y + q.z * f.z)))))), 3) AS amplitude FROM q JOIN q f ON f.clip = q.clip AND f.j = q.j AND f.frame = 0 GROUP BY q.clip, q.j""",
    "positions",
)



def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, rigs = _poses(spark, sf_dir)
    pairs = rigs.select("rig", "right", "left", (F.size("joints") % 2 == 1).alias("body_axis"), F.lit(0.5).alias("height"))
    return m.travel_direction(frames, pairs).select("clip", F.round("net", 6).alias("net"), "direction")


DIRECTIONS = with_views(
    """, w AS (SELECT * FROM positions WHERE frame < 200), g AS (SELECT rig, count(*) % 2 = 1 AS axis FROM joints GROUP BY rig HAVING count(*) >= 3),
    e AS (SELECT clip, w.rig, any_value(axis) AS axis, count(*) AS n, arg_max(px, frame) - arg_min(px, frame) AS dx, arg_max(pz, frame) - arg_min(pz, frame) AS dz FROM w JOIN g ON g.rig = w.rig WHERE j = 0 GROUP BY clip, w.rig),
    a AS (SELECT e.clip, dx, dz, CASE WHEN axis THEN r.px - l.px ELSE r.pz - l.pz END AS fx, CASE WHEN axis THEN r.pz - l.pz ELSE l.px - r.px END AS fz FROM e JOIN w r ON r.clip = e.clip AND r.j = 1 JOIN w l ON l.clip = r.clip AND l.frame = r.frame AND l.j = 2 WHERE r.frame % greatest(n // 8, 1) = 0),
    c AS (SELECT clip, avg((dx * fx + dz * fz) / (sqrt(fx * fx + fz * fz) * sqrt(dx * dx + dz * dz))) AS c FROM a WHERE sqrt(fx * fx + fz * fz) > 1e-6 AND dx * dx + dz * dz > 0 GROUP BY clip)
    SELECT e.clip, round(sqrt(dx * dx + dz * dz) / 0.5, 6) AS net, CASE WHEN c > 0.8 THEN 'forward' WHEN c < -0.8 THEN 'backward' ELSE '' END AS direction FROM e LEFT JOIN c ON c.clip = e.clip""",
    "positions",
)

QUERIES = {
    "g14_travel_direction": (directions, DIRECTIONS),
    "g4_facing": (facings, FACINGS),
    "g5_g8_features_recovered": (recovered, RECOVERED),
    "g18_upside_down": (upside_down, UPSIDE_DOWN),
    "j11_mirror_pairs": (mirrors, MIRRORS),
    "m11_rotation_amplitude": (amplitudes, AMPLITUDES),
}
