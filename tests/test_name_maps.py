"""Learned vocabularies and name maps on literal joints."""

from motionlake.operators import captions as c
from motionlake.operators import review as r
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_key_counts_its_rigs_whatever_their_buckets(spark):
    code = [x.rig for x in spark.range(2000).select(F.concat(F.lit("r"), "id").alias("rig")).where(F.pmod(F.xxhash64("rig"), F.lit(16)) == 3).limit(3).collect()]
    rows = [(rig, 0, "LeftOddBone_01", "Odd", 0) for rig in code] + [(rig, j, "Paw", "Paw", j) for rig in code[:2] for j in (1, 2)]
    rows += [(f"x{k}", 0, "Hip", "Hips", 0) for k in range(9)] + [("x9", 0, "Hip", "Leg", 0)] + [(None, 0, "Tail", "Tail", 0)] * 5
    rows += [(f"y{k}", 0, "Fin", "Fin" if k % 2 else "Tail", 0) for k in range(8)]
    vocab = c.learn_vocab(spark.createDataFrame(rows, "rig string, j int, raw string, part string, ord int"))
    assert {(x.key, x.part, round(x.purity, 3), x.rigs) for x in vocab.collect()} >= {("odd bone", "Odd", 1.0, 3), ("bone", "Odd", 1.0, 3)}
    assert {x.key for x in vocab.collect()} == {"odd bone", "bone", "hip"}
    joints = spark.createDataFrame([("a", 0, "RightOddBone", "Bone"), ("a", 1, "Bone_7", "Bone"), ("b", 0, "OddBone", "Hand"), ("b", 1, None, "Bone"), ("b", 2, "Paw", "Bone")], "rig string, j int, raw string, label string")
    out = c.apply_vocab(joints, vocab.withColumn("part", F.concat("part", F.lit("!"), "key")), F.col("label") == "Bone")
    assert {(x.rig, x.j): x.label for x in out.collect()} == {("a", 0): "Odd!odd bone", ("a", 1): "Odd!bone", ("b", 0): "Hand", ("b", 1): "Bone", ("b", 2): "Bone"}
    # names are looked up, not joints
    assert "hashpartitioning(rig" not in plan_of(out)


def test_majorities_are_found_without_a_join(spark):
    rows = [(f"r{k}", 0, -1, "hip", "Hip.01", label) for k, label in enumerate(["Hips", "Hips", "Root"])] + [(f"s{k}", 0, -1, "tail", "Tail", label) for k, label in enumerate(["Tail", "Spine"])]
    rows += [(f"r{k}", 1, 0, "leg", "leg_2", label) for k, label in enumerate([None, None, "Leg"])] + [(f"t{k}", 0, -1, "leg", "LEG", None if k else "Odd") for k in range(20)]
    placed = r.placed_joints(spark.createDataFrame(rows, "rig string, j int, parent int, name string, raw string, label string"))
    templates, names = r.learn_name_map(placed)
    assert "Join" not in plan_of(templates)
    assert sorted(x.label or "" for x in templates.collect()) == ["", "", "", "Hips"]
    out = {(x.rig, x.j): (x.label, x.source) for x in r.apply_name_map(placed, templates, names, F.col("label") == "Odd").collect()}
    assert out["r2", 0] == ("Hips", "template") and out["s0", 0] == ("Tail", "own") and out["s1", 0] == ("Spine", "own") and out["r2", 1] == ("Leg", "own") and out["t0", 0] == ("Odd", "own") and len(out) == len(rows)
