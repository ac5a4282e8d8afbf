"""Motion operators that keep a frame in one row and a clip's frames together."""

from math import sqrt

import pytest
from motionlake.operators import motion
from pyspark.sql import functions as F

from tests.test_one_pass import joins

POSES = "clip string, rig string, frame int, pose array<struct<p:struct<x:double,y:double,z:double>,q:struct<w:double,x:double,y:double,z:double>>>, facing struct<w:double,x:double,y:double,z:double>"


def frames_of(spark):
    still = (1.0, 0.0, 0.0, 0.0)
    return spark.createDataFrame([("c", "r", f, [((2.0 + f, 3.0, 1.0), still), ((2.0 + f, 5.0, 1.5), still)], still) for f in range(3)], POSES)


def test_clips_are_placed_by_windows(spark):
    out = motion.canonicalize(frames_of(spark), spark.createDataFrame([("r", 0.5)], "rig string, scale double"))
    assert [[tuple(s.p) for s in r.pose] for r in out.orderBy("frame").collect()] == [[(0.5 * f, 0.0, 0.0), (0.5 * f, 1.0, 0.25)] for f in range(3)]
    # the scale only
    assert joins(out) == 1


def test_the_gate_keeps_a_frame_in_one_row(spark):
    still = (1.0, 0.0, 0.0, 0.0)
    six = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [("r", "c", f, still, j, [0.0, y, z, *six, 1.0, 0.0, 0.0]) for f in range(2) for j, (y, z) in enumerate([(3.0, 0.0), (5.0, 0.5)])]
    features = spark.createDataFrame(rows, "rig string, clip string, frame int, facing struct<w:double,x:double,y:double,z:double>, j int, f array<double>")
    gate = motion.feature_row_gate(features, frames_of(spark))
    assert [tuple(r) for r in gate.collect()] == [("c", None, 0.0)]
    assert "Generate" not in gate._jdf.queryExecution().optimizedPlan().toString()


def test_mean_of_two_far_turns(spark):
    a, b = (1.0, 0.0, 0.0, 0.0), (0.05, sqrt(1 - 0.0025), 0.0, 0.0)
    (row,) = spark.createDataFrame([([a, b],)], "turns array<struct<w:double,x:double,y:double,z:double>>").select(motion.chordal_mean(F.col("turns")).alias("m")).collect()
    total = [x + y for x, y in zip(a, b)]
    assert tuple(row.m) == pytest.approx([x / sqrt(sum(y * y for y in total)) for x in total])
