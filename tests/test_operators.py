"""What SQL doesn't hold: draws, invariants and edge cases of the corpus operators, on literal rows."""

import math

import pytest
from motionlake.functions.chance import seeded_uniform
from motionlake.operators import captions, frames, tables, training
from motionlake.plans.steps import run_steps
from pyspark.sql import functions as F


def test_merge_caption_shards(spark):
    shards = spark.createDataFrame([("a", "ERROR: x", 1, 0), ("a", "fine", 2, 0), ("b", "old", 1, 1), ("b", "", 1, 2), ("c", "kept", 1, 0)], "clip string, text string, rank int, seq int")
    merged, failures = tables.merge_caption_shards(shards, spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "clip string"))
    assert {tuple(r) for r in merged.collect()} == {("a", "fine"), ("b", ""), ("c", "kept")}
    assert sorted(r.clip for r in failures.collect()) == ["b", "d"]


def test_weighted_draw_follows_weights(spark):
    w = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1), ("z", 0.0)], "clip string, weight double")
    rows = training.weighted_draw(w, "clip", 4000, 7).collect()
    assert len(rows) == 4000 == len({r.draw for r in rows})
    share = {k: sum(r.clip == k for r in rows) / 4000 for k in "abcz"}
    assert share["z"] == 0 and abs(share["a"] - 0.7) < 0.04 and abs(share["c"] - 0.1) < 0.03
    assert sorted(map(tuple, rows)) == sorted(map(tuple, training.weighted_draw(w, "clip", 4000, 7).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, training.weighted_draw(w, "clip", 4000, 7, epoch=1).collect()))


def test_seeded_uniform_is_even(spark):
    u = [r.u for r in spark.range(4000).select(seeded_uniform(3, F.col("id")).alias("u")).collect()]
    assert all(0 < x < 1 for x in u) and abs(sum(u) / 4000 - 0.5) < 0.02


def test_choices(spark):
    clips = spark.createDataFrame([(f"c{i}",) for i in range(900)], "clip string")
    versions = clips.withColumn("version", F.lit("normal")).union(clips.where("clip <> 'c1'").withColumn("version", F.lit("generic"))).withColumn("text", F.col("version"))
    rows = training.choose_caption(clips, versions, {"generic": 0.5}, 1).collect()
    assert len(rows) == 900 and all(r.text == r.version for r in rows) and 0.4 < sum(r.version == "generic" for r in rows) / 900 < 0.6
    with pytest.raises(ValueError):
        training.choose_caption(clips, versions, {"generic": 0.7, "detail": 0.4}, 1)
    ops = [r.augmentation for r in training.choose_augmentation(clips, ["a", "b"], 1).collect()]
    assert all(200 < ops.count(x) < 400 for x in (None, "a", "b"))


def test_joint_pick_is_without_replacement(spark):
    joints = spark.createDataFrame([(f"r{r}", j, 1.0 if j else 1e9) for r in range(300) for j in range(6)], "rig string, j int, length double")
    rows = training.weighted_joint_pick(joints, 3, 5).collect()
    assert len(rows) == 900 == len({(r.rig, r.j) for r in rows})
    assert sum(r.j == 0 for r in rows) < 10


@pytest.mark.parametrize(("length", "stride"), [(40, 30), (40, 20), (10, 10), (7, 3)])
def test_clip_windows_rules(spark, length, stride):
    clips = spark.createDataFrame([(f"c{t}", t) for t in range(1, 140)], "clip string, n_frames int")
    rows = {}
    for r in frames.clip_windows(clips, length, stride).orderBy("clip", "segment").collect():
        rows.setdefault(r.n_frames, []).append((r.start, r.end))
    for t, got in rows.items():
        want = [(0, t)]
        if t > length:
            want = [(s, s + length) for s in range(0, t - length + 1, stride)]
            tail = t - (want[-1][0] + stride)
            if want[-1][1] < t:
                if tail >= max(1, length - stride):
                    want.append((want[-1][0] + stride, t))
                elif len(want) > 1 and want[-2][1] >= t - length:
                    want[-1] = (t - length, t)
        assert got == want, t


def test_static_single_and_nan_clips(spark):
    nan = float("nan")
    rows = [("still", f, j, 0.0, 0.0, 0.0) for f in range(12) for j in range(2)] + [("one", 0, 0, 1.0, 1.0, 1.0)] + [("nan", f, 0, nan if f == 3 else float(f), 0.0, 0.0) for f in range(9)]
    p = spark.createDataFrame(rows, "clip string, frame int, j int, px double, py double, pz double")
    left = {r.clip: r.n for r in frames.trim_static_ends(p).groupBy("clip").agg(F.count_distinct("frame").alias("n")).collect()}
    assert "still" not in left and left["one"] == 1
    gate = {r.clip: r.reason for r in frames.discontinuity_gate(frames.discontinuity_metrics(p)).collect()}
    assert gate == {"nan": "not finite"}
    m = {r.clip: r for r in frames.activity_metrics(p.where("clip <> 'nan'")).collect()}
    assert m["one"].top is None and m["still"].top == 0


def test_votes(spark):
    def result(*votes, asked=3):
        rows = [("x", k, c, conf) for k, (c, conf) in enumerate(votes)]
        return tuple(captions.aggregate_votes(spark.createDataFrame(rows, "asset string, ord int, category string, confidence string"), asked).first())[1:]

    assert result(("a", "low"), asked=1) == ("a", "low")
    assert result(("a", "high"), ("a", "low"), ("a", "low")) == ("a", "high")
    assert result(("a", "low"), ("a", "low"), ("b", "high")) == ("uncertain", "low")
    assert result(("a", "high"), ("b", "high")) == ("uncertain", "low")


def test_weights_sum_to_one(spark):
    clips = spark.createDataFrame([("d1" if i % 3 else "d2", f"r{i % 7}", f"c{i}") for i in range(100)], "dataset string, rig string, clip string")
    for beta in (None, 0.0, 0.5):
        assert math.isclose(training.sampling_weights(clips, 0.5, beta).agg(F.sum("weight")).first()[0], 1.0, rel_tol=1e-9)


def test_steps(spark):
    steps = [("add", lambda df: df.withColumn("x", F.lit(1))), ("twice", lambda df: df.withColumn("x", F.col("x") * 2))]
    assert run_steps(spark.range(1), steps).first().x == 2
    assert run_steps(spark.range(1), steps, skip=["twice"]).first().x == 1
    with pytest.raises(ValueError):
        run_steps(spark.range(1), steps, only=["none"])
