"""Queries of spectral features, pruning candidates, chain labels and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import captions as c
from ..operators import topology as t
from .views import load, with_views


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of unit length inside the eigenspaces, per rig: what is the same whichever basis the solver takes."""
    (joints,) = load(spark, sf_dir, "joints")
    audit = t.eigenbasis_audit(t.rig_spectra(joints, 4))
    return audit.groupBy("rig").agg(F.count_if(F.abs(F.col("length") - 1) < 1e-9).alias("columns"), F.bool_and(F.col("residual") < 1e-9).alias("solved"))


SPECTRA = with_views("SELECT rig, least(count(*) - 1, 4) AS columns, true AS solved FROM joints GROUP BY rig", "joints")


def prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    j, p = F.col("j"), F.col("part")
    rows = joints.select("rig", "j", "parent", F.when(p % 11 == 0, "hand_ctrl").otherwise("bone").alias("name"), (p % 2).cast("double").alias("skin"), F.when(p % 7 == 0, 0.0).otherwise(1.0).alias("length"))
    motion = joints.select("rig", F.lit("c").alias("clip"), "j", F.when(p % 3 == 0, 0.0).otherwise(0.5).alias("turn"), F.when(p % 5 < 2, 0.0).otherwise(0.2).alias("slide"), F.when(j % 4 == 3, 0.1).otherwise(0.0).alias("stretch"))
    return t.prune_candidates(rows, motion)


PRUNABLE = with_views(
    """, k AS (SELECT j.*, NOT EXISTS (SELECT 1 FROM joints c WHERE c.rig = j.rig AND c.parent = j.j) AS leaf, coalesce(u.part % 3 <> 0, false) AS up FROM joints j LEFT JOIN joints u ON u.rig = j.rig AND u.j = j.parent WHERE j.part % 2 = 0),
    r AS (SELECT rig, j, CASE WHEN part % 11 = 0 THEN 'control' WHEN part % 7 = 0 THEN 'no offset' WHEN part % 3 = 0 AND part % 5 < 2 THEN 'no motion' WHEN leaf AND j % 4 = 3 THEN 'length varies' WHEN part % 3 = 0 AND NOT (leaf AND up) THEN 'no rotation' END AS reason FROM k)
    SELECT * FROM r WHERE reason IS NOT NULL""",
    "joints",
)


def chain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    labels = joints.select("rig", "j", "parent", F.when(F.col("part") % 4 == 0, "Arm").otherwise("Leg").alias("label"))
    names = spark.createDataFrame([("Leg", ["Thigh", "Shin", "Foot"])], "label string, names array<string>")
    return t.relabel_chains(labels, names)


CHAIN_LABELS = with_views(
    """, l AS (SELECT rig, j, parent, CASE WHEN part % 4 = 0 THEN 'Arm' ELSE 'Leg' END AS label, count(*) OVER (PARTITION BY rig, parent) = 1 AS single FROM joints),
    c AS (WITH RECURSIVE a AS (SELECT rig, j, label, 1 AS k FROM l WHERE parent < 0 UNION ALL SELECT a.rig, l.j, l.label, CASE WHEN l.single AND a.label = l.label THEN a.k + 1 ELSE 1 END FROM a JOIN l ON l.rig = a.rig AND l.parent = a.j) SELECT * FROM a)
    SELECT rig, j, CASE WHEN label = 'Leg' THEN ['Thigh', 'Shin', 'Foot'][least(k, 3)] ELSE label END AS label FROM c""",
    "joints",
)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rigs,) = load(spark, sf_dir, "rigs")
    auto = rigs.where("r % 3 = 0").select("rig", F.lit("facing").alias("category"), F.lit("measured").alias("reason"))
    manual = rigs.where("r % 4 = 0").select("rig", F.when(F.col("r") % 8 == 0, "verified_ok").otherwise("scale").alias("category"), F.lit("seen").alias("reason"))
    return t.rig_flags(auto, manual)


FLAGS = with_views("SELECT rig, CASE WHEN r % 4 = 0 THEN 'scale' ELSE 'facing' END AS category, CASE WHEN r % 4 = 0 THEN 'seen' ELSE 'measured' END AS reason FROM rigs WHERE r % 8 <> 0 AND (r % 3 = 0 OR r % 4 = 0)", "rigs")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    x = F.when(F.col("j") == 0, 0.0).when(F.col("j") % 2 == 0, -1.0).otherwise(1.0)
    said = F.when(F.col("j") == 0, None).when((F.col("j") % 2 == 0) | ((F.col("part") % 5 == 0) & (F.col("j") < 2)), "Right").otherwise("Left")
    rows = joints.select("rig", "j", x.alias("x"), said.alias("raw_side"), F.when(F.col("j") % 3 == 0, "Spine").when(F.col("j") % 3 == 1, "Arm").otherwise("Left Leg").alias("label"))
    return c.side_from_x(rows, 0.01, ["Spine"]).select("rig", "j", "label")


SIDES = with_views(
    """, r AS (SELECT rig, count_if(j > 0) AS n, count_if(j > 0 AND NOT (j % 2 = 1 AND part % 5 = 0 AND j < 2)) AS ok FROM joints GROUP BY rig)
    SELECT j.rig, j, CASE WHEN j % 3 = 0 THEN 'Spine' WHEN j % 3 = 2 THEN 'Left Leg' WHEN n >= 6 AND ok >= n * 0.9 THEN CASE WHEN j % 2 = 0 THEN 'Right Arm' ELSE 'Left Arm' END ELSE 'Arm' END AS label FROM joints j JOIN r ON r.rig = j.rig""",
    "joints",
)


def label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(k == 0, F.lit('<think>["x"]</think>```json\n["Hips", "Left Leg"]\n```')).when(k == 1, F.lit('["Hips"]')).when(k == 2, F.lit('["Hips", " "]')).when(k == 3, F.lit("no list")).otherwise(F.lit('Here: ["A", "B"] done'))
    out = c.parse_label_answers(conversations.select("conv_id", "turn", text.alias("text"), F.lit(2).alias("n")), "n")
    return out.select("conv_id", "turn", F.array_join("labels", "|").alias("labels"), "reason")


LABEL_ANSWERS = """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Hips|Left Leg' WHEN 1 THEN 'Hips' WHEN 2 THEN 'Hips| ' WHEN 4 THEN 'A|B' END AS labels,
CASE (conv_id + turn) % 5 WHEN 1 THEN 'wrong length' WHEN 2 THEN 'empty label' WHEN 3 THEN 'no array' END AS reason FROM conversations"""

QUERIES = {
    "f14_prune_candidates": (prunable, PRUNABLE),
    "j6_j7_spectral_features": (spectra, SPECTRA),
    "k12_relabel_chains": (chain_labels, CHAIN_LABELS),
    "k13_side_from_x": (sides, SIDES),
    "k18_rig_flags": (flags, FLAGS),
    "k22_parse_label_answers": (label_answers, LABEL_ANSWERS),
}
