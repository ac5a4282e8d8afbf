"""Names, chains and captions on the literal cases of their rules."""

from motionlake.functions import names as n
from motionlake.operators import annotation, captions, review, trees
from pyspark.sql import functions as F

from tests.test_rig_geometry import person


def through(spark, f, cases):
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    return {r.x: r.y for r in df.select("x", f(F.col("x")).alias("y")).collect()}


def test_bone_names(spark):
    cases = {"mixamorig:LeftUpLeg": "leftupleg", "Foot.R_035_34": "foot.r", "Spine1": "spine1", "a|b:Hand_01.002": "hand", "_00": "", " Head ": "head", "arm-3": "arm-3"}
    assert through(spark, n.norm_bone_name, cases) == cases


def test_action_names(spark):
    cases = {"Armature|Walk": "Walk", "Armature|Run|Run:Base": "Run", "Idle": "Idle", "Armature|Big-Mouth Attack": "Big_Mouth_Attack", "mixamo.com_Walk": "Walk", "Armature|mixamo.com_Run:Base": "Run"}
    cases |= {"Run.001": "Run_001", "Walk_GLTF_created_0": "Walk", "Armature_Walk": "Armature_Walk", "__x  y__": "x_y"}
    assert through(spark, n.sanitize_action_name, cases) == cases


def test_side_chains_begin_at_the_fork(spark):
    joints = spark.createDataFrame([("a", j, p) for j, p in enumerate((-1, 0, 0, 2))] + [("b", j, p) for j, p in enumerate((-1, 0, 1, 1, 1, 3))], "rig string, j int, parent int")
    got = {(r.rig, r.head): r.joints for r in trees.kinematic_chains(joints).collect()}
    assert got == {("a", 0): [0, 2, 3], ("a", 1): [0, 1], ("b", 0): [0, 1, 4], ("b", 2): [1, 2], ("b", 3): [1, 3, 5]}


def test_limbs_take_neighbours_of_any_side(spark):
    joints = spark.createDataFrame([("a", 0, -1, "Thigh"), ("a", 1, 0, "Left Leg"), ("a", 2, 0, "Right Arm"), ("a", 3, 2, "Left Forearm")], "rig string, j int, parent int, label string")
    got = review.limb_context(joints, {("Leg", "Thigh"): "Shin"}, {("Arm", "Forearm"): "Upper Arm"}).orderBy("j").collect()
    assert [r.label for r in got] == ["Thigh", "Left Shin", "Right Upper Arm", "Left Forearm"]


def test_props(spark):
    cases = {"fires a rifle at a wall": True, "takes a bow": True, "bows deeply": False, "steps back": False, "holding glasses": False, "holding a glass": True, "swordsman": False, "Shot  puts": False, "a SHOT PUT": True, "falls to the ground": False, "lifting rocks": True}
    assert through(spark, captions.prop_word_flag, cases) == cases


def test_locomotion(spark):
    rows = [
        ("It walks slowly forward.", 0.0, None, "It walks slowly in place."),
        ("It raises an arm forward.", 0.0, None, "It raises an arm forward."),
        ("It runs in place and hops in place.", 0.9, "backward", "It runs backward and hops backward."),
        ("It runs in place.", 0.9, None, "It runs."),
        ("It runs in place.", 0.9, "", "It runs."),
        ("It runs in place.", 0.3, "forward", "It runs in place."),
        ("It walks forward.", None, None, "It walks forward."),
        ("It walks forwards.", 0.0, None, "It walks forwards."),
    ]
    df = spark.createDataFrame(rows, "text string, net double, direction string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", captions.normalize_locomotion(F.col("text"), F.col("net"), F.col("direction"))).collect())


def test_annotation_of_a_person_with_and_without_names(spark):
    rows, want = person()
    raw = {2: "spine", 3: "spine2"}
    joints = spark.createDataFrame([(rig, j, p, (raw.get(j) if rig == "named" else None) or f"bone_{j}", float(x), float(y), float(z)) for rig in ("named", "bare") for j, (p, x, y, z) in enumerate(rows)], "rig string, j int, parent int, raw string, x double, y double, z double")
    tables = [spark.createDataFrame([("spine", "Chest")], "bone string, label string"), spark.createDataFrame([("tail", "Tail")], "key string, part string"), spark.createDataFrame([("Thigh", 1)], "part string, rank int")]
    labels, pairs = annotation.annotate(joints, *tables)
    got = {rig: [r.label for r in labels.where(F.col("rig") == rig).orderBy("j").collect()] for rig in ("named", "bare")}
    assert got["bare"] == want
    assert got["named"] == ["Chest" if j == 2 else w for j, w in enumerate(want)]
    assert {(r.rig, want[r.right], want[r.left]) for r in pairs.collect()} == {(rig, "Right Thigh", "Left Thigh") for rig in ("named", "bare")}
    bare, _ = annotation.annotate(joints, *tables, skip=["fill_unnamed"])
    assert {r.label for r in bare.where("rig = 'bare'").collect()} == {"Bone"}
