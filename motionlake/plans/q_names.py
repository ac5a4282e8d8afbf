"""Queries of the name, scalar and geometry expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import names as n
from ..functions.chance import seeded_order
from .views import load, with_views


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    key = F.concat("clip", F.lit("-007"))
    return captions.select("clip", n.object_type_of(F.col("clip")).alias("rig_of"), n.export_stem(key).alias("stem"), n.sanitize_rig_name(F.col("text")).alias("rig_name"), n.slug(F.col("text")).alias("slug"))


NAME_KEYS = with_views(
    """, w AS (SELECT clip, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM captions),
    k AS (SELECT clip, unnest(range(1, len(w) + 1)) AS i, w FROM w),
    l AS (SELECT clip, w, max(i) AS m FROM k WHERE length(array_to_string(w[1:i], '_')) <= 48 GROUP BY clip, w)
    SELECT c.clip, split_part(c.clip, '-', 1) AS rig_of, c.clip AS stem, regexp_replace(c.text, '[-\\s]', '_', 'g') AS rig_name,
    coalesce(array_to_string(l.w[1:m], '_'), 'case') AS slug FROM captions c LEFT JOIN l ON l.clip = c.clip""",
    "captions",
)


def action_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = F.concat(F.lit("Armature|mixamo.com_"), F.replace("url", F.lit(":"), F.lit("/")), F.lit("_GLTF_created_0"))
    part = n.split_once(F.regexp_replace("url", "^https?://", ""))
    return pages.select(
        "page_id",
        n.sanitize_action_name(made).alias("action"),
        n.sanitize_action_name(F.regexp_replace("url", "^https?://", "")).alias("plain_action"),
        part["species"].alias("species"),
        part["action"].alias("species_action"),
        part["ok"].alias("ok"),
    )


_ACTION = "trim(regexp_replace(regexp_replace(regexp_replace(split_part({x}, ':', 1), '^mixamo\\.com_', ''), '_GLTF_created_\\d+$', ''), '[^0-9A-Za-z]+', '_', 'g'), '_')"
ACTION_NAMES = f"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u, 'mixamo.com_' || replace(url, ':', '/') || '_GLTF_created_0' AS m FROM pages)
SELECT page_id, {_ACTION.format(x="m")} AS action, {_ACTION.format(x="u")} AS plain_action, split_part(u, '-', 1) AS species,
CASE WHEN strpos(u, '-') > 0 THEN substr(u, strpos(u, '-') + 1) END AS species_action, strpos(u, '-') > 0 AS ok FROM p"""


def joint_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    label = F.regexp_replace(F.regexp_replace("raw", r"_\d+$", ""), "^(Left|Right)", "$1 ")
    return raw.select(
        "rig", "j", n.norm_bone_name(F.concat(F.lit("rig:"), "raw", F.lit("_12"))).alias("bone"), n.raw_side(F.col("raw")).alias("raw_side"), n.split_side(label)["side"].alias("side"), n.split_side(label)["part"].alias("part"),
        n.strip_end(F.concat(label, F.lit(" End"))).alias("label"), n.join_side(n.split_side(label)["side"], n.split_side(label)["part"]).alias("joined"),
    )


JOINT_NAME_PARTS = with_views(
    """, l AS (SELECT rig, j, raw, regexp_replace(regexp_replace(raw, '_\\d+$', ''), '^(Left|Right)', '\\1 ') AS label FROM labels_raw)
    SELECT rig, j, lower(regexp_replace(raw || '_12', '(?:[._]\\d+)+$', '')) AS bone, nullif(regexp_extract(raw, '^(Left|Right)', 1), '') AS raw_side, nullif(regexp_extract(label, '^(Left|Right) ', 1), '') AS side,
    regexp_replace(label, '^(?:Left|Right) ?', '') AS part, label, label AS joined FROM l""",
    "labels_raw",
)


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    # some rigs already hold a numbered name
    rows = raw.select("rig", "j", F.when((F.col("j") == 3), F.lit("Left_01")).otherwise(F.regexp_extract("raw", "^(Left|Right)?", 0)).alias("name")).withColumn("name", F.when(F.col("name") == "", "Mid").otherwise(F.col("name")))
    return n.unique_clip_names(rows, ["rig"], "name", "j").select("rig", "j", "name", "unique_name")


UNIQUE_NAMES = with_views(
    """, a AS (SELECT rig, j, CASE WHEN j = 3 THEN 'Left_01' ELSE regexp_extract(raw, '^(Left|Right)?') END AS name FROM labels_raw),
    r AS (SELECT rig, j, CASE WHEN name = '' THEN 'Mid' ELSE name END AS name FROM a),
    c AS (SELECT *, count(*) OVER (PARTITION BY rig, name) AS n, row_number() OVER (PARTITION BY rig, name ORDER BY j) AS k FROM r),
    t AS (SELECT DISTINCT c.rig, c.name, c.n, i, c.name || '_' || lpad(CAST(i AS VARCHAR), 2, '0') AS try FROM c, range(0, 20) AS s(i) WHERE n > 1 AND i <= n),
    f AS (SELECT t.*, row_number() OVER (PARTITION BY t.rig, t.name ORDER BY i) AS k FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rig = t.rig AND r.name = t.try))
    SELECT c.rig, c.j, c.name, coalesce(f.try, c.name) AS unique_name FROM c LEFT JOIN f ON f.rig = c.rig AND f.name = c.name AND f.k = c.k""",
    "labels_raw",
)


def clash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return n.name_clash_report(pages, n.sanitize_rig_name(F.regexp_extract("url", "//([^/]*)/", 1)), "url")


CLASH_REPORT = """SELECT regexp_replace(regexp_extract(url, '//([^/]*)/', 1), '[-\\s]', '_', 'g') AS asset, list_sort(list_distinct(list(url))) AS files
FROM pages GROUP BY 1 HAVING count(DISTINCT url) > 1"""


def _turns(joints: DataFrame) -> DataFrame:
    v = g.vec(F.col("ox"), F.col("oy"), F.col("oz"))
    p = g.qunit(g.quat(F.lit(1.0), F.col("ox"), F.col("oy"), F.col("oz")))
    q = g.qunit(g.quat(F.col("oy"), F.col("oz"), F.lit(0.5), F.col("ox")))
    return joints.select("rig", "j", v.alias("v"), p.alias("p"), q.alias("q"))


_TURNS = """, r AS (SELECT rig, j, ox, oy, oz, 1 / sqrt(1 + ox * ox + oy * oy + oz * oz) AS k, 1 / sqrt(oy * oy + oz * oz + 0.25 + ox * ox) AS l FROM joints),
t AS (SELECT rig, j, ox, oy, oz, k AS pw, ox * k AS px, oy * k AS py, oz * k AS pz, oy * l AS qw, oz * l AS qx, 0.5 * l AS qy, ox * l AS qz FROM r)"""


def quaternion_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    t = _turns(joints)
    product, turned = g.qmul(F.col("p"), g.qconj(F.col("q"))), g.qrot(F.col("p"), F.col("v"))
    return t.select("rig", "j", *(F.round(product[k], 6).alias(f"m{k}") for k in "wxyz"), *(F.round(turned[k], 6).alias(f"r{k}") for k in "xyz"), F.round(g.q_angle(F.col("p"), F.col("q")), 4).alias("angle"))


QUATERNION_ALGEBRA = with_views(
    _TURNS
    + """ SELECT rig, j, round(pw * qw + px * qx + py * qy + pz * qz, 6) AS mw, round(px * qw - pw * qx - py * qz + pz * qy, 6) AS mx, round(py * qw - pw * qy - pz * qx + px * qz, 6) AS my,
    round(pz * qw - pw * qz - px * qy + py * qx, 6) AS mz,
    round((1 - 2 * (py * py + pz * pz)) * ox + 2 * (px * py - pw * pz) * oy + 2 * (px * pz + pw * py) * oz, 6) AS rx,
    round(2 * (px * py + pw * pz) * ox + (1 - 2 * (px * px + pz * pz)) * oy + 2 * (py * pz - pw * px) * oz, 6) AS ry,
    round(2 * (px * pz - pw * py) * ox + 2 * (py * pz + pw * px) * oy + (1 - 2 * (px * px + py * py)) * oz, 6) AS rz,
    round(degrees(2 * acos(least(1.0, abs(pw * qw + px * qx + py * qy + pz * qz)))), 4) AS angle FROM t""",
    "joints",
)


def rotation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternion to six numbers, to a matrix, to a quaternion again; and the angle between two matrices."""
    (joints,) = load(spark, sf_dir, "joints")
    t = _turns(joints).withColumn("d", g.q_to_6d(F.col("p"))).withColumn("m", g.r6_to_matrix(F.col("d"))).withColumn("b", g.matrix_to_q(F.col("m")))
    return t.select(
        "rig", "j", *(F.round(F.col("d")[k], 6).alias(f"d{k}") for k in range(6)), *(F.round(F.col("m")[k], 6).alias(f"m{k}") for k in (2, 5, 8)), *(F.round(F.col("b")[k], 5).alias(f"b{k}") for k in "wxyz"),
        F.round(g.geodesic_error(g.q_to_matrix(F.col("p")), g.q_to_matrix(F.col("q"))), 4).alias("geodesic"),
    )


ROTATION_FORMS = with_views(
    _TURNS
    + """ SELECT rig, j, round(1 - 2 * (py * py + pz * pz), 6) AS d0, round(2 * (px * py + pw * pz), 6) AS d1, round(2 * (px * pz - pw * py), 6) AS d2, round(2 * (px * py - pw * pz), 6) AS d3,
    round(1 - 2 * (px * px + pz * pz), 6) AS d4, round(2 * (py * pz + pw * px), 6) AS d5, round(2 * (px * pz + pw * py), 6) AS m2, round(2 * (py * pz - pw * px), 6) AS m5, round(1 - 2 * (px * px + py * py), 6) AS m8,
    round(pw, 5) AS bw, round(px, 5) AS bx, round(py, 5) AS by, round(pz, 5) AS bz, round(2 * acos(least(1.0, abs(pw * qw + px * qx + py * qy + pz * qz))), 4) AS geodesic FROM t""",
    "joints",
)


def vector_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    up = g.vec(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    t = joints.select("rig", "j", g.vec(F.col("ox"), F.col("oy"), F.col("oz")).alias("v")).withColumn("u", g.vunit(F.col("v"))).withColumn("q", g.qbetween(up, F.col("u")))
    back = g.qrot(F.col("q"), up)
    return t.select("rig", "j", F.round(g.vnorm(F.col("v")), 6).alias("length"), F.round(F.col("q")["w"], 6).alias("qw"), *(F.round(back[k], 6).alias(f"u{k}") for k in "xyz"))


VECTOR_TURNS = with_views(
    """, l AS (SELECT rig, j, ox, oy, oz, sqrt(ox * ox + oy * oy + oz * oz) AS n FROM joints)
    SELECT rig, j, round(n, 6) AS length, round(sqrt((1 + oy / n) / 2), 6) AS qw, round(ox / n, 6) AS ux, round(oy / n, 6) AS uy, round(oz / n, 6) AS uz FROM l""",
    "joints",
)


def rig_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return joints.groupBy("rig").agg(F.round(g.bbox_extent(["ox", "oy", "oz"]), 9).alias("extent"), F.bround(F.count(F.lit(1)) * F.lit(0.5), 0).cast("long").alias("half"))


RIG_EXTENTS = with_views("SELECT rig, round(greatest(max(ox) - min(ox), max(oy) - min(oy), max(oz) - min(oz)), 9) AS extent, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS half FROM joints GROUP BY rig", "joints")


def seeded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rigs,) = load(spark, sf_dir, "rigs")
    return rigs.select("rig", seeded_order(42, F.col("rig")).alias("draw"))


SEEDED_KEYS = with_views("SELECT rig, md5('42|' || rig) AS draw FROM rigs", "rigs")

QUERIES = {
    "b1_b6_name_keys": (name_keys, NAME_KEYS),
    "b4_b5_action_names": (action_names, ACTION_NAMES),
    "b9_m8_m9_joint_name_parts": (joint_name_parts, JOINT_NAME_PARTS),
    "b7_unique_clip_names": (unique_names, UNIQUE_NAMES),
    "b8_name_clash_report": (clash_report, CLASH_REPORT),
    "m1_m3_quaternion_algebra": (quaternion_algebra, QUATERNION_ALGEBRA),
    "m4_g21_rotation_forms": (rotation_forms, ROTATION_FORMS),
    "m2_m5_vector_turns": (vector_turns, VECTOR_TURNS),
    "m6_m7_rig_extents": (rig_extents, RIG_EXTENTS),
    "m12_seeded_keys": (seeded_keys, SEEDED_KEYS),
}
