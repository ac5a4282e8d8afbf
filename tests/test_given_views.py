"""Corpus tables that a query has written stand in for their SQL."""

from motionlake.plans.q_batches import batches
from motionlake.plans.views import load


def test_later_tables_take_the_given_ones(spark, sf_dir):
    clips, joints, positions = load(spark, sf_dir, "clips", "joints", "positions")
    one = spark.createDataFrame(clips.orderBy("clip").limit(1).collect(), clips.schema)
    own = joints.join(one.select("rig"), "rig", "left_semi").select(joints.columns)
    want = positions.join(one.select("clip"), "clip", "left_semi").count()
    (few,) = load(spark, sf_dir, "positions", given={"clips": one, "joints": own})
    assert few.count() == want > 0


def test_batches_read_the_order_lines_before_the_last_job_only(spark, sf_dir):
    plan = batches(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
