"""Rig conditions and padded batches on literal rigs."""

from motionlake.operators import conditions as c
from motionlake.operators.training import stats_frame_weighted


def test_padded_batches(spark):
    joints = spark.createDataFrame([("a", 0, -1, "h", 0.0), ("a", 1, 0, "l", 1.0), ("a", 2, 0, "r", 1.0), ("b", 0, -1, "h", 0.0), ("c", 0, -1, "h", 0.0), ("c", 1, 0, "l", 2.0)], "rig string, j int, parent int, name string, length double")
    pairs = spark.createDataFrame([("a", 2, 1)], "rig string, right int, left int")
    told = c.rig_condition(joints, pairs, k=2)
    rigs = {r.rig: r for r in told.collect()}
    # rows look from the joint to the other: the root has two children, which are siblings and ends
    assert rigs["a"].relations == [[0, 2, 2], [1, 5, 3], [1, 3, 5]] and rigs["a"].distances == [[0, 1, 1], [1, 0, 2], [1, 2, 0]]
    assert rigs["a"].edges == [[1, 2, 0, 0], [0, 0, 1, 2]] and tuple(rigs["a"].face) == (2, 1) and rigs["b"].face is None and rigs["b"].edges == [[], []]
    batches = spark.createDataFrame([(0, ["x", "y"]), (1, ["z"])], "batch long, clips array<string>")
    clips = spark.createDataFrame([("x", "a", "d"), ("y", "b", "d"), ("z", "c", "d")], "clip string, rig string, dataset string")
    rows = [(clip, f, j, [float(10 * f + j), 1.0]) for clip, n, m in (("x", 3, 3), ("y", 1, 1), ("z", 2, 2)) for f in range(n) for j in range(m)]
    features = spark.createDataFrame(rows, "clip string, frame int, j int, f array<double>")
    stats = stats_frame_weighted(features.join(clips, "clip"))
    captions = spark.createDataFrame([("x", [[1.0, 2.0], [3.0, 4.0]])], "clip string, tokens array<array<double>>")
    out = {r.clip: r for r in c.padded_batches(batches, clips, features, told, stats, 2, 2, captions).collect()}
    assert out["x"].motion == [[[0.0, 10.0], [1.0, 1.0]], [[1.0, 11.0], [1.0, 1.0]], [[2.0, 12.0], [1.0, 1.0]]] and out["x"].length == 2
    # another rig of the batch: as wide, zeros where it has no joint or frame, a deviation of one there
    y = out["y"]
    assert y.motion == [[[0.0, 0.0], [1.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]
    assert y.joint_mask == [True, False, False] and y.length_mask == [True, False] and y.std[1:] == [[1.0, 1.0]] * 2 and y.mean[1:] == [[0.0, 0.0]] * 2
    assert y.relations == [[5, 0, 0], [0, 0, 0], [0, 0, 0]] and y.depths == [0, 0, 0] and [len(v) for v in y.spectra] == [2, 2, 2]
    # captions are as long as the batch's longest; one without has a token of zeros
    assert y.tokens == [[0.0, 0.0], [0.0, 0.0]] and y.caption_mask == [True, False] and out["x"].caption_mask == [True, True]
    assert len(out["z"].motion) == 2 and out["z"].tokens == [[]] and out["z"].caption_mask == [True]
    assert c.padded_batches(batches.where("false"), clips, features, told, stats, 2, 2).count() == 0
