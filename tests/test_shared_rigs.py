"""Clips of several users on one rig."""

from motionlake.operators import frames


def test_scales_by_clip_of_a_shared_rig(spark):
    positions = spark.createDataFrame([(c, "r", f, 0, float(f), 1.0, 0.0) for c in "ab" for f in range(2)], "clip string, rig string, frame int, j int, px double, py double, pz double")
    out = frames.canonical_place(positions, spark.createDataFrame([], "rig string, right int, left int"), spark.createDataFrame([("a", 0.5)], "clip string, scale double"))
    assert {(r.clip, r.frame): r.py for r in out.collect()} == {("a", 0): 0.5, ("a", 1): 0.5, ("b", 0): 1.0, ("b", 1): 1.0}
