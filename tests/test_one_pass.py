"""Steps that look at a rig's pairs inside its row, or by groups, instead of joining tables with themselves."""

import random
import re

from motionlake.operators import conditions, review, rig_context


def joins(df):
    return len(re.findall(r"^[ :+-]*Join ", df._jdf.queryExecution().optimizedPlan().toString(), re.MULTILINE))


def brute_pair(rows, ranks):
    """The pair by rank, part, how well the numbers match, and numbers of joints."""
    found = []
    split = [(j, *label.split(" ", 1), re.findall("[0-9]+", raw)) for j, raw, label in rows if label.startswith(("Right ", "Left "))]
    for r, side, part, d in split:
        for left, other, same, e in split:
            if (side, other) == ("Right", "Left") and part == same:
                found.append((ranks.get(part, 1 << 30), part, 0 if d == e else 1 if d[:-1] == e[:-1] else 2, r, left))
    return min(found)[1:2] + min(found)[3:] if found else None


def test_face_pairs_by_groups(spark):
    draw = random.Random(3)
    rigs = {f"r{k}": [(j, "".join(f"n_{draw.randint(0, 2)}" for _ in range(draw.randint(0, 2))), draw.choice(["Right Arm", "Left Arm", "Right Leg", "Left Leg", "Spine", "Left Ear"])) for j in range(draw.randint(1, 7))] for k in range(150)}
    joints = spark.createDataFrame([(rig, *x) for rig, rows in rigs.items() for x in rows], "rig string, j int, raw string, label string")
    found = review.select_face_pair(joints, spark.createDataFrame([("Leg", 1)], "part string, rank int"))
    want = {rig: pair for rig, rows in rigs.items() if (pair := brute_pair(rows, {"Leg": 1}))}
    assert {r.rig: (r.part, r.right, r.left) for r in found.collect()} == want
    # the ranks only
    assert joins(found) == 1


def test_rig_condition_in_the_rigs_row(spark):
    joints = spark.createDataFrame([("a", 0, -1, "hip", 0.0), ("a", 1, 0, "leg", 2.0), ("a", 2, 0, "arm", 3.0), ("a", 3, 2, "hand", 1.0), ("b", 0, -1, "hip", 0.0)], "rig string, j int, parent int, name string, length double")
    out = conditions.rig_condition(joints, k=2)
    a, b = out.orderBy("rig").collect()
    assert (a.n_joints, a.parents, a.depths, a.diameter, a.chains, a.edges) == (4, [-1, 0, 0, 2], [0, 1, 1, 2], 6.0, [[0, 1], [0, 2, 3]], [[1, 2, 3, 0, 0, 2], [0, 0, 2, 1, 2, 3]])
    assert a.distances == [[0, 1, 1, 2], [1, 0, 2, 3], [1, 2, 0, 1], [2, 3, 1, 0]] and a.relations[1] == [1, 5, 3, 4]
    assert (b.n_joints, b.diameter, b.chains, b.distances, b.spectra) == (1, None, [[0]], [[0]], [[0.0, 0.0]])
    # each rig's tree only
    assert joins(out) == 1


def test_names_are_looked_up_where_they_are(spark):
    raws = ["mixamorig:LeftUpLeg_001", "Leg.R_02", "Spine1", "spine_003", "", "123", "R_ForeArm", None]
    joints = spark.createDataFrame([("a", j, raw) for j, raw in enumerate(raws)], "rig string, j int, raw string")
    fixed = spark.createDataFrame([("spine", "Spine")], "bone string, label string")
    tokens = spark.createDataFrame([("up leg", "Thigh"), ("leg", "Leg"), ("arm", "Arm"), (None, "Odd")], "key string, part string")
    found = review.clean_joint_names(joints, fixed, tokens)
    assert [r.label for r in found.orderBy("j").collect()] == ["Left Thigh", "Right Leg", "Bone", "Spine", "Bone", "Bone", "Right Arm", "Bone"]
    assert {r.label for r in review.clean_joint_names(joints, fixed, tokens.where("false")).collect()} == {"Spine", "Bone"}
    # the two tables of rules; no row for each key of a name
    assert joins(found) == 2 and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_keep_their_size(spark, monkeypatch):
    joints = spark.range(200).selectExpr("'r' || (id div 4) AS rig", "CAST(id % 4 AS int) AS j", "CAST(id % 4 - 1 AS int) AS parent", "'Left Leg' AS label")
    want = sorted(tuple(r) for r in rig_context.limb_context(joints).collect())
    monkeypatch.setattr(rig_context, "EACH", 10)
    # one more than 200 / 10, whatever the session's number of shuffle partitions
    found = rig_context.with_ancestors(joints)
    assert found.rdd.getNumPartitions() == 21
    assert sorted(tuple(r) for r in rig_context.limb_context(joints).collect()) == want and len(want) == 200


def test_rule_labels_are_written_once(spark):
    joints = spark.createDataFrame([("a", 0, -1, "Spine"), ("a", 1, 0, "LeftArm_1"), ("a", 2, 1, "LeftForeArm_1"), ("a", 3, 0, "RightArm_1")], "rig string, j int, parent int, raw string")
    tables = spark.createDataFrame([("spine", "Spine")], "bone string, label string"), spark.createDataFrame([("arm", "Arm"), ("fore arm", "Forearm")], "key string, part string")
    labels, pairs = review.rule_annotation(joints, *tables, spark.createDataFrame([("Arm", 1)], "part string, rank int"), {}, {("Arm", "Forearm"): "Upper Arm"})
    assert [r.label for r in labels.orderBy("j").collect()][1:] == ["Left Upper Arm", "Left Forearm", "Right Arm"]
    assert pairs.count() == 0 and joins(labels) == 0
