"""Values that are used several times are worked out once."""

import re

from motionlake.operators import augment
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_new_joints_place_is_drawn_once(spark):
    rigs = spark.sql("SELECT 'a' AS rig, array(named_struct('j', 0, 'parent', -1, 'p', named_struct('x', 0D, 'y', 0D, 'z', 0D)), named_struct('j', 1, 'parent', 0, 'p', named_struct('x', 1D, 'y', 2D, 'z', 0D))) AS joints FROM range(1)")
    frames = spark.sql("SELECT 'c' AS clip, 'a' AS rig, 0 AS frame, named_struct('x', 0D, 'y', 0D, 'z', 0D) AS root, array(named_struct('w', 1D, 'x', 0D, 'y', 0D, 'z', 0D), named_struct('w', 1D, 'x', 0D, 'y', 0D, 'z', 0D)) AS turns FROM range(1)")
    shapes, _ = augment.joint_addition(rigs.withColumn("rig", F.concat("rig", F.lit("1"))), frames, 3)
    (row,) = shapes.collect()
    assert [(x.j, x.parent) for x in row.joints] == [(0, -1), (1, 0), (2, 1)] and abs(row.joints[1].p.y + row.joints[2].p.y - 2) < 1e-12
    rigs = spark.createDataFrame(rigs.collect(), rigs.schema)
    shapes, _ = augment.joint_addition(rigs, frames, 3)
    assert len(re.findall(r"concat_ws\(/, rig#\d+, z\)", plan_of(shapes))) == 1
