"""Limbs that neighbours of their own side decide."""

from motionlake.operators import review


def test_limbs_of_the_same_side(spark):
    joints = spark.createDataFrame([("a", 0, -1, "Left Thigh"), ("a", 1, 0, "Left Leg"), ("a", 2, 0, "Right Leg"), ("a", 3, 0, "Right Arm"), ("a", 4, 3, "Left Forearm"), ("a", 5, 0, "Left Arm"), ("a", 6, 5, "Left Forearm")], "rig string, j int, parent int, label string")
    got = review.limb_context(joints, {("Leg", "Thigh"): "Shin"}, {("Arm", "Forearm"): "Upper Arm"}, same_side=True).orderBy("j").collect()
    assert [r.label for r in got] == ["Left Thigh", "Left Shin", "Right Leg", "Right Arm", "Left Forearm", "Left Upper Arm", "Left Forearm"]
