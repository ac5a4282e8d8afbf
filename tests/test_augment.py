"""Tree changes, rebasing and recovery from rotations against numpy, on random rigs and poses."""

import numpy as np
import pytest
from motionlake.functions.geometry import quat, vec
from motionlake.operators import augment as a
from motionlake.operators import motion as m
from motionlake.sources.staging import staged
from pyspark.sql import functions as F

PARENTS = {"line": (-1, 0, 1, 2, 3), "tree": (-1, 0, 1, 1, 2, 4, 3, 0, 7, 5), "one": (-1,), "star": (-1, 0, 0, 0, 0, 0)}


def mul(p, q):
    (a1, b1, c1, d1), (a2, b2, c2, d2) = p, q
    return np.array([a1 * a2 - b1 * b2 - c1 * c2 - d1 * d2, a1 * b2 + b1 * a2 + c1 * d2 - d1 * c2, a1 * c2 - b1 * d2 + c1 * a2 + d1 * b2, a1 * d2 + b1 * c2 - c1 * b2 + d1 * a2])


def turned(q, v):
    return mul(mul(q, np.array([0.0, *v])), q * np.array([1, -1, -1, -1]))[1:]


def world(parents, offsets, root, turns):
    places, whole = [np.array(root)], [turns[0]]
    for j in range(1, len(parents)):
        p = parents[j]
        places.append(places[p] + turned(whole[p], offsets[j]))
        whole.append(mul(whole[p], turns[j]))
    return np.array(places), np.array(whole)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    rigs = {r: (p, rng.normal(size=(len(p), 3))) for r, p in PARENTS.items()}
    frames = {}
    for r, (p, _) in rigs.items():
        for f in range(3):
            q = rng.normal(size=(len(p), 4))
            frames[f"{r}-c", f] = r, rng.normal(size=3), q / np.linalg.norm(q, axis=1)[:, None]
    return rigs, frames


def tables(spark, made):
    rigs, frames = made
    rows = [(r, [(j, p, *map(float, o)) for j, (p, o) in enumerate(zip(parents, offsets, strict=True))]) for r, (parents, offsets) in rigs.items()]
    rigs = spark.createDataFrame(rows, "rig string, x array<struct<j:int,parent:int,x:double,y:double,z:double>>")
    rigs = rigs.select("rig", F.transform("x", lambda s: F.struct(s["j"].alias("j"), s["parent"].alias("parent"), vec(s["x"], s["y"], s["z"]).alias("p"))).alias("joints"))
    rows = [(c, r, f, [*map(float, root)], [[*map(float, q)] for q in turns]) for (c, f), (r, root, turns) in frames.items()]
    frames = spark.createDataFrame(rows, "clip string, rig string, frame int, r array<double>, t array<array<double>>")
    return rigs, frames.select("clip", "rig", "frame", vec(F.col("r")[0], F.col("r")[1], F.col("r")[2]).alias("root"), F.transform("t", lambda q: quat(q[0], q[1], q[2], q[3])).alias("turns"))


def after(rigs, frames):
    """By rig (parents, offsets, the row), by clip and frame the places and turns in the world that numpy works out from the tables, which `posed` has too."""
    shapes = {r.rig: ([x.parent for x in r.joints], np.array([tuple(x.p) for x in r.joints]), r) for r in rigs.collect()}
    out = {}
    for r in a.posed(rigs, frames).collect():
        parents, offsets, _ = shapes[r.rig]
        assert [x.j for x in shapes[r.rig][2].joints] == list(range(len(parents)))
        places, whole = world(parents, offsets, tuple(r.root), np.array([tuple(q) for q in r.turns]))
        assert np.allclose([tuple(x.p) for x in r.pose], places)
        assert np.allclose([tuple(x.world) for x in r.pose], whole)
        out[r.clip, r.frame] = r.rig, places, whole
    return shapes, out


def test_leaves_go_and_the_rest_stays(spark, made):
    rigs, frames = tables(spark, made)
    _, before = after(rigs, frames)
    shapes, now = after(*a.leaf_removal(rigs, frames, 0.7, 1))
    # of 3 leaves 2.1 rounds to 2, of one 0.7 to 1; of five no more than 3 go
    assert {r: len(s[0]) for r, s in shapes.items()} == {"line": 4, "tree": 8, "one": 1, "star": 3}
    for k, (rig, places, whole) in now.items():
        was = shapes[rig][2].was
        assert np.allclose(places, before[k][1][was])
        assert np.allclose(whole, before[k][2][was])
    kids = {r: {p for p in PARENTS[r]} for r in PARENTS}
    assert all(set(range(len(PARENTS[r]))) - set(s[2].was) <= set(range(len(PARENTS[r]))) - kids[r] for r, s in shapes.items())
    few, _ = after(*a.leaf_removal(rigs, frames, 0.1, 1))
    assert {r: len(s[0]) for r, s in few.items()} == {"line": 5, "tree": 10, "one": 1, "star": 6}


@pytest.mark.parametrize(("rate", "sizes"), [(0.01, {"line": 4, "tree": 9, "one": 1, "star": 6}), (0.7, {"line": 3, "tree": 7, "one": 1, "star": 6}), (1.0, {"line": 2, "tree": 5, "one": 1, "star": 6})])
def test_pooling_keeps_turns_in_the_world(spark, made, rate, sizes):
    rigs, frames = tables(spark, made)
    _, before = after(rigs, frames)
    shapes, now = after(*a.pooling(rigs, frames, rate, 5))
    assert {r: len(s[0]) for r, s in shapes.items()} == sizes
    for k, (rig, _, whole) in now.items():
        assert np.allclose(whole, before[k][2][shapes[rig][2].was])
    # where what goes doesn't turn, places stay too
    rigs_, still = made
    still = {k: (r, root, np.where(np.isin(np.arange(len(q)), shapes[r][2].was)[:, None], q, [1.0, 0, 0, 0])) for k, (r, root, q) in still.items()}
    rigs, frames = tables(spark, (rigs_, still))
    _, before = after(rigs, frames)
    shapes, now = after(*a.pooling(rigs, frames, rate, 5))
    for k, (rig, places, _) in now.items():
        assert np.allclose(places, before[k][1][shapes[rig][2].was])


def test_added_joints_leave_all_others_in_place(spark, made):
    rigs, frames = tables(spark, made)
    _, before = after(rigs, frames)
    seen = set()
    for seed in range(4):
        shapes, now = after(*a.joint_addition(rigs, frames, seed))
        for k, (rig, places, whole) in now.items():
            at = shapes[rig][2].added
            if rig == "one":
                assert at is None and len(places) == 1
                continue
            seen.add((rig, at))
            assert np.allclose(np.delete(places, at, 0), before[k][1])
            assert np.allclose(np.delete(whole, at, 0), before[k][2])
            bone, new = made[0][rig][1][at], shapes[rig][1][at]
            length = np.linalg.norm(bone)
            assert np.linalg.norm(new - bone * 0.5) <= 1.2 * length + 1e-9
            assert shapes[rig][0][at] == PARENTS[rig][at] and shapes[rig][0][at + 1] == at
    assert len(seen) > 3


def test_shifts_stay_in_the_ellipsoid(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("rig"), vec(F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("b"))
    got = np.array([tuple(r.s) for r in df.select(a.ellipsoid_shift(F.col("b"), F.col("rig"), 3).alias("s")).collect()])
    assert ((got / [1.0, 2.0, 1.0]) ** 2).sum(axis=1).max() <= 1 + 1e-9
    assert np.abs(got.mean(axis=0)).max() < 0.1
    # of a half-normal of sigma 0.5 cut at 1 about 71 per cent are within one sigma
    assert abs((((got / [1.0, 2.0, 1.0]) ** 2).sum(axis=1) <= 0.25).mean() - 0.715) < 0.04


def test_scaled_bones_keep_turns(spark, made):
    rigs, frames = tables(spark, made)
    shapes, _ = after(a.bone_scale(rigs, 2), frames)
    for r, (_, offsets, _) in shapes.items():
        ratio = offsets[1:] / made[0][r][1][1:]
        assert ((ratio >= 0.9) & (ratio <= 1.1)).all() and np.allclose(ratio, ratio[:, :1])
        assert np.allclose(offsets[0], made[0][r][1][0])


def test_rebase_to_rest(spark, made):
    _, frames = tables(spark, made)
    rng = np.random.default_rng(9)
    rests = {r: (q := rng.normal(size=(len(p), 4))) / np.linalg.norm(q, axis=1)[:, None] for r, p in PARENTS.items()}

    def rigs(turns):
        rows = [(r, [(j, p, *map(float, q)) for j, (p, q) in enumerate(zip(PARENTS[r], turns[r], strict=True))]) for r in PARENTS]
        df = spark.createDataFrame(rows, "rig string, x array<struct<j:int,parent:int,w:double,x:double,y:double,z:double>>")
        return df.select("rig", F.transform("x", lambda s: F.struct(s["j"].alias("j"), s["parent"].alias("parent"), quat(s["w"], s["x"], s["y"], s["z"]).alias("q"))).alias("joints"))

    inverse = lambda q: q * np.array([1, -1, -1, -1])
    for row in a.rebase_to_rest(rigs(rests), frames).collect():
        rest, turns = rests[row.rig], made[1][row.clip, row.frame][2]
        sums = [rest[0]]
        want = [mul(turns[0], inverse(rest[0]))]
        for j, p in enumerate(PARENTS[row.rig][1:], 1):
            sums.append(mul(sums[p], rest[j]))
            want.append(mul(mul(mul(sums[p], turns[j]), inverse(rest[j])), inverse(sums[p])))
        assert np.allclose([tuple(q) for q in row.turns], want)
    none = {r: np.tile([1.0, 0, 0, 0], (len(p), 1)) for r, p in PARENTS.items()}
    for row in a.rebase_to_rest(rigs(none), frames).collect():
        assert np.allclose([tuple(q) for q in row.turns], made[1][row.clip, row.frame][2])


def test_places_from_rotations(spark, made):
    rigs, frames = tables(spark, made)
    poses = a.posed(rigs, frames).withColumn("pose", F.transform("pose", lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q")))).where("rig <> 'one'")
    pair = rigs.withColumn("right", F.lit(1)).withColumn("left", F.lit(2))
    faced = staged(m.facing(poses.select("clip", "rig", "frame", "pose"), pair), "faced")
    features = staged(m.motion_features(faced, pair), "features")
    got = {(r.clip, r.frame, r.j): tuple(r.p) for r in m.recover_from_rotations(features, rigs).collect()}
    assert len(got) == 2 * (5 + 10 + 6)
    for (clip, frame, j), p in got.items():
        rig, root, turns = made[1][clip, frame]
        places, _ = world(*made[0][rig], root, turns)
        start = made[1][clip, 0][1]
        assert np.allclose(p, places[j] - [start[0], 0, start[2]], atol=1e-6)
    gate = m.feature_row_gate(features, faced, rigs=rigs).collect()
    assert [r.reason for r in gate] == [None] * 3
    # other offsets: only the second recovery tells
    assert {r.reason for r in m.feature_row_gate(features, faced, rigs=a.bone_scale(rigs, 2)).collect()} == {"recovery differs"}


def test_chordal_mean(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        q = np.array([1.0, 0, 0, 0]) + 0.3 * rng.normal(size=(4, 4))
        q /= np.linalg.norm(q, axis=1)[:, None]
        q[1] *= -1
        top = np.linalg.eigh(q.T @ q)[1][:, -1]
        df = spark.createDataFrame([([[*map(float, x)] for x in q],)], "t array<array<double>>").select(m.chordal_mean(F.transform("t", lambda x: quat(x[0], x[1], x[2], x[3]))).alias("m"))
        assert abs(abs(np.dot(top, tuple(df.first().m))) - 1) < 1e-6


def test_travel_direction(spark):
    def clip(name, rig, way, turn=0):
        """Two frames and more of a root and a pair 1 (right, at -x) and 2 (left), that face +Z or, turned, +X."""
        out = []
        for f in range(20):
            x, z = float(way[0] * f), float(way[1] * f)
            pair = ((x, z + 0.2), (x, z - 0.2)) if turn else ((x - 0.2, z), (x + 0.2, z))
            out.append((name, rig, f, [(x, 1.0, z), (pair[0][0], 1.0, pair[0][1]), (pair[1][0], 1.0, pair[1][1])]))
        return out

    rows = clip("on", "a", (0, 0.1)) + clip("back", "a", (0, -0.1)) + clip("aside", "a", (0.1, 0)) + clip("still", "a", (0, 0)) + clip("turned", "a", (0.1, 0), 1) + clip("none", "x", (0, 0.1)) + clip("axis", "b", (-0.1, 0))
    frames = spark.createDataFrame(rows, "clip string, rig string, frame int, p array<struct<x:double,y:double,z:double>>").select("clip", "rig", "frame", F.transform("p", lambda p: F.struct(p.alias("p"))).alias("pose"))
    pairs = spark.createDataFrame([("a", 1, 2, False, 2.0), ("b", 1, 2, True, 1.0)], "rig string, right int, left int, body_axis boolean, height double")
    got = {r.clip: (round(r.net, 6), r.direction) for r in m.travel_direction(frames, pairs).collect()}
    assert got == {"on": (0.95, "forward"), "back": (0.95, "backward"), "aside": (0.95, ""), "still": (0.0, ""), "turned": (0.95, "forward"), "none": (1.9, ""), "axis": (1.9, "forward")}
