"""Queries of joint trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import trees as t
from .views import load, with_views

_UP = """, up AS (WITH RECURSIVE a AS (SELECT rig, j, j AS anc, parent AS nxt, 0 AS d FROM joints UNION ALL SELECT a.rig, a.j, p.j, p.parent, a.d + 1 FROM a JOIN joints p ON p.rig = a.rig AND p.j = a.nxt) SELECT rig, j, anc, d FROM a),
dp AS (SELECT rig, j, max(d) AS depth FROM up GROUP BY rig, j)"""


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return t.joint_depths(joints).join(t.edges(joints).groupBy("rig", F.col("a").alias("j")).agg(F.count(F.lit(1)).alias("degree")), ["rig", "j"], "left").fillna(0, ["degree"])


DEPTHS = with_views(_UP + ", e AS (SELECT rig, j, parent AS b FROM joints WHERE parent >= 0 UNION ALL SELECT rig, parent, j FROM joints WHERE parent >= 0) SELECT dp.rig, dp.j, depth, (SELECT count(*) FROM e WHERE e.rig = dp.rig AND e.j = dp.j) AS degree FROM dp", "joints")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return t.joint_pairs(joints)


PAIRS = with_views(
    _UP
    + """, c AS (SELECT x.rig, x.j AS a, y.j AS b, max(dp.depth) AS m FROM up x JOIN up y ON y.rig = x.rig AND y.anc = x.anc JOIN dp ON dp.rig = x.rig AND dp.j = x.anc GROUP BY ALL)
    SELECT c.rig, a, b, CASE WHEN a = b THEN CASE WHEN EXISTS (SELECT 1 FROM joints k WHERE k.rig = c.rig AND k.parent = a) THEN 'self' ELSE 'end_effector' END WHEN ja.parent = b THEN 'parent' WHEN jb.parent = a THEN 'child' WHEN ja.parent = jb.parent THEN 'sibling' ELSE 'none' END AS relation,
    CAST(least(da.depth + db.depth - 2 * m, 5) AS INT) AS distance FROM c JOIN joints ja ON ja.rig = c.rig AND ja.j = a JOIN joints jb ON jb.rig = c.rig AND jb.j = b JOIN dp da ON da.rig = c.rig AND da.j = a JOIN dp db ON db.rig = c.rig AND db.j = b""",
    "joints",
)


def below(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return t.descendants(joints, joints.where("j = 1 OR j = 5").select("rig", "j"))


BELOW = with_views(_UP + " SELECT DISTINCT rig, j FROM up WHERE anc IN (1, 5)", "joints")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return t.kinematic_chains(joints).select("rig", "head", F.array_join(F.transform("joints", lambda j: j.cast("string")), ",").alias("joints"))


CHAINS = with_views(
    """, m AS (SELECT rig, j, parent, j = max(j) OVER (PARTITION BY rig, parent) AS f FROM joints),
    h AS (WITH RECURSIVE a AS (SELECT rig, j, j AS head FROM m WHERE parent < 0 UNION ALL SELECT a.rig, m.j, CASE WHEN m.f THEN a.head ELSE m.j END FROM a JOIN m ON m.rig = a.rig AND m.parent = a.j) SELECT * FROM a)
    SELECT rig, head, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS joints FROM (SELECT * FROM h UNION ALL SELECT h.rig, m.parent, h.head FROM h JOIN m ON m.rig = h.rig AND m.j = h.head WHERE h.j = h.head AND m.parent >= 0) GROUP BY rig, head""",
    "joints",
)


def diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return t.skeleton_diameter(joints.withColumn("length", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2))).select("rig", F.round("diameter", 7).alias("diameter"))


DIAMETERS = with_views(
    _UP
    + """, fr AS (SELECT up.rig, up.j, sum(CASE WHEN p.parent < 0 THEN 0 ELSE sqrt(ox * ox + oy * oy + oz * oz) END) AS f FROM up JOIN joints p ON p.rig = up.rig AND p.j = up.anc GROUP BY up.rig, up.j),
    c AS (SELECT x.rig, x.j AS a, y.j AS b, max(fr.f) AS m FROM up x JOIN up y ON y.rig = x.rig AND y.anc = x.anc JOIN fr ON fr.rig = x.rig AND fr.j = x.anc GROUP BY ALL)
    SELECT c.rig, round(CASE WHEN max(fa.f + fb.f - 2 * m) > 1e-8 THEN max(fa.f + fb.f - 2 * m) END, 7) AS diameter FROM c JOIN fr fa ON fa.rig = c.rig AND fa.j = a JOIN fr fb ON fb.rig = c.rig AND fb.j = b GROUP BY c.rig""",
    "joints",
)


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints' places from local offsets and turns, and the error against a slightly moved copy of them."""
    (joints,) = load(spark, sf_dir, "joints")
    rows = joints.select("rig", "j", "parent", *t.local_pose("ox", "oy", "oz"))
    world = t.forward_kinematics(t.to_rigs(rows, ["parent", "p", "q"]))
    stated = world.withColumn("stated", F.transform("world", lambda w: g.vadd(w["p"], g.vec(F.lit(0.0), F.lit(0.001), F.lit(0.0)))))
    error = t.rest_consistency(stated.drop("world"))
    places = world.select("rig", F.posexplode("world").alias("j", "w")).select("rig", "j", *(F.round(F.col("w.p")[k], 6).alias(f"p{k}") for k in "xyz"))
    return places.join(error.select("rig", F.round("error", 6).alias("error")), "rig")


KINEMATICS = with_views(
    """, l AS (SELECT rig, j, parent, ox, oy, oz, 1 / sqrt(1 + 0.01 * (ox * ox + oy * oy + oz * oz)) AS k FROM joints),
    q AS (SELECT rig, j, parent, ox, oy, oz, k AS w, ox * 0.1 * k AS x, oy * 0.1 * k AS y, oz * 0.1 * k AS z FROM l),
    f AS (WITH RECURSIVE a AS (SELECT rig, j, ox AS px, oy AS py, oz AS pz, w, x, y, z FROM q WHERE parent < 0 UNION ALL
      SELECT q.rig, q.j, a.px + (1 - 2 * (a.y * a.y + a.z * a.z)) * q.ox + 2 * (a.x * a.y - a.w * a.z) * q.oy + 2 * (a.x * a.z + a.w * a.y) * q.oz,
      a.py + 2 * (a.x * a.y + a.w * a.z) * q.ox + (1 - 2 * (a.x * a.x + a.z * a.z)) * q.oy + 2 * (a.y * a.z - a.w * a.x) * q.oz,
      a.pz + 2 * (a.x * a.z - a.w * a.y) * q.ox + 2 * (a.y * a.z + a.w * a.x) * q.oy + (1 - 2 * (a.x * a.x + a.y * a.y)) * q.oz,
      a.w * q.w - a.x * q.x - a.y * q.y - a.z * q.z, a.w * q.x + a.x * q.w + a.y * q.z - a.z * q.y, a.w * q.y - a.x * q.z + a.y * q.w + a.z * q.x, a.w * q.z + a.x * q.y - a.y * q.x + a.z * q.w
      FROM a JOIN q ON q.rig = a.rig AND q.parent = a.j) SELECT * FROM a)
    SELECT rig, j, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, 0.001 AS error FROM f""",
    "joints",
)


QUERIES = {
    "j1_j2_edges_and_depths": (depths, DEPTHS),
    "j3_j4_joint_pairs": (pairs, PAIRS),
    "j5_kinematic_chains": (chains, CHAINS),
    "j9_descendants": (below, BELOW),
    "g3_skeleton_diameter": (diameters, DIAMETERS),
    "g1_g15_forward_kinematics": (kinematics, KINEMATICS),
}
