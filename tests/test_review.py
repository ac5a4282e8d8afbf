"""Mirror conflicts on literal rigs."""

from motionlake.operators import review

COLUMNS = "rig string, j int, parent int, label string, x double, y double, z double"


def legs(rig, right, left):
    """A root, thighs and feet at the given x, a clavicle that crosses inside an otherwise sided arm, a second pair of ears."""
    return [
        (rig, 0, -1, "Hips", 0.0, 1.0, 0.0),
        (rig, 1, 0, "Right Thigh", right, 0.9, 0.0), (rig, 2, 1, "Right Foot", right, 0.0, 0.1),
        (rig, 3, 0, "Left Thigh", left, 0.9, 0.0), (rig, 4, 3, "Left Foot", left, 0.0, 0.1),
        (rig, 5, 0, "Right Clavicle", -0.1, 1.5, 0.0), (rig, 6, 5, "Right Hand", 1.5, 1.4, 0.0),
        (rig, 7, 0, "Left Clavicle", 0.1, 1.5, 0.0), (rig, 8, 7, "Left Hand", -1.5, 1.4, 0.0),
        (rig, 9, 0, "Right Ear", 0.001, 2.0, 0.0), (rig, 10, 0, "Left Ear", 0.0, 2.0, 0.0),
        (rig, 11, 0, "Right Fin", -1.0, 1.0, 0.0), (rig, 12, 0, "Right Fin", -2.0, 1.0, 0.0), (rig, 13, 0, "Left Fin", 1.0, 1.0, 0.0),
        (rig, 14, 0, "Right Horn", 0.1, 2.0, 0.5), (rig, 15, 0, "Left Horn", 0.0, 2.0, -0.5),
    ]


def test_limb_pairs(spark):
    joints = spark.createDataFrame([*legs("good", 0.5, -0.5), *legs("axis", 0.5, -0.5), *legs("flat", 0.0, 0.0)], COLUMNS)
    pairs = spark.createDataFrame([("good", 1, 3, False), ("axis", 1, 3, True), ("flat", 1, 3, None)], "rig string, right int, left int, body_axis boolean")
    rows = {(r.rig, r.part): (r.right, r.left, r.conflict) for r in review.limb_pairs(joints, pairs).collect()}
    # thighs judge themselves; a limb's centre decides, not its crossing first joint; ears are too near, fins aren't single, horns lie along the facing
    assert rows == {("good", "Thigh"): (1, 3, False), ("good", "Clavicle"): (5, 7, False), ("good", "Horn"): (14, 15, False)}


def test_mirror_conflicts(spark):
    joints = spark.createDataFrame([*legs("swapped", 0.5, -0.5), *legs("once", 0.5, -0.5)], COLUMNS)
    pairs = spark.createDataFrame([("swapped", 3, 1), ("once", 1, 3)], "rig string, right int, left int")
    rows = {r.rig: (r.judged, r.conflicts, r.flagged) for r in review.mirror_conflicts(joints, pairs).collect()}
    assert rows == {"swapped": (3, 2, True), "once": (3, 0, False)}
    assert review.mirror_conflicts(joints.where("false"), pairs).count() == 0
