"""Facing, canonical placement and motion features, one row a frame with its joints in an array.

frames(clip, rig, frame, pose array of struct(p, q)): p and q are a joint's world
place and local turn, in the rig's joint order; rigs(rig, joints array of
struct(j, parent), right, left: the facing pair's joint numbers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import let, matrix_to_q, q_to_6d, qbetween, qconj, qmul, qrot, quat, qunit, r6_to_matrix, vadd, vdot, vec, vnorm, vscale, vsub
from .frames import nearest_valid_fill
from .trees import forward_kinematics

EPSILON = 1e-6


def by_frame() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("frame")


def front() -> Column:
    return vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))


def lateral_to_forward(lateral: Column) -> Column:
    """up x lateral, of length one on the ground; null below the epsilon."""
    flat = vec(lateral["z"], F.lit(0.0), -lateral["x"])
    return let(flat, lambda f: F.when(vnorm(f) > EPSILON, vscale(f, 1 / vnorm(f))))


def facing(frames: DataFrame, rigs: DataFrame) -> DataFrame:
    """Adds facing, the turn that brings the frame's forward direction to +Z.

    Forward comes from the pair's right and left joint. Frames where they
    coincide take the nearest valid frame's, the earlier of two; a rig without a
    pair has the identity; a clip without any valid frame keeps null.
    """
    pair = rigs.select("rig", "right", "left")
    rows = frames.join(pair, "rig", "left")
    lateral = vsub(F.get("pose", F.col("right"))["p"], F.get("pose", F.col("left"))["p"])
    rows = rows.withColumn("facing", F.when(F.col("right").isNotNull(), let(lateral, lateral_to_forward)))
    turned = nearest_valid_fill(rows, "facing").withColumn("facing", F.when(F.col("facing").isNotNull(), qbetween(F.col("facing"), front())))
    identity = quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return turned.withColumn("facing", F.when(F.col("right").isNull(), identity).otherwise(F.col("facing"))).drop("right", "left")


def canonicalize(frames: DataFrame, scale: DataFrame) -> DataFrame:
    """frames with facing, scale(rig, scale): turned by the first frame's facing, the root's first place at the origin, scaled, the lowest joint on the ground."""
    # windows over the clip, not joins: frames are dealt out once and worked out once
    first = F.min_by(F.struct("facing", F.get("pose", F.lit(0))["p"].alias("root")), "frame").over(Window.partitionBy("clip"))
    rows = frames.join(scale, "rig").withColumn("f", first)
    origin = vec(F.col("f.root.x"), F.lit(0.0), F.col("f.root.z"))

    def place(s: Column) -> Column:
        return let(vsub(s["p"], origin), lambda v: let(qrot(F.col("f.facing"), v), lambda r: F.struct(vscale(r, F.col("scale")).alias("p"), s["q"].alias("q"))))

    rows = rows.withColumn("pose", F.transform("pose", place)).withColumn("facing", qmul(F.col("facing"), qconj(F.col("f.facing"))))
    rows = rows.withColumn("low", F.min(F.array_min(F.transform("pose", lambda s: s["p"]["y"]))).over(Window.partitionBy("clip")))
    down = F.transform("pose", lambda s: F.struct(vec(s["p"]["x"], s["p"]["y"] - F.col("low"), s["p"]["z"]).alias("p"), s["q"].alias("q")))
    return rows.withColumn("pose", down).select(*frames.columns)


def motion_features(frames: DataFrame, rigs: DataFrame) -> DataFrame:
    """Twelve values for each joint and frame but the last: place from the root's ground point in the facing frame, the parent's turn as six numbers (the root has the facing), velocity turned by the next frame's facing."""
    w = by_frame()
    # the join before the window, so that the frames of a clip stay together
    rows = frames.join(rigs.select("rig", F.transform("joints", lambda x: x["parent"]).alias("_parent")), "rig").withColumn("_next", F.lead(F.struct("pose", "facing")).over(w)).where("_next IS NOT NULL")

    def one(s: Column, j: Column) -> Column:
        # each value is bound before it is turned or written in numbers: what is named several times is worked out as often
        ground = let(F.get("pose", F.lit(0))["p"], lambda root: vec(s["p"]["x"] - root["x"], s["p"]["y"], s["p"]["z"] - root["z"]))
        step = let(F.get(F.col("_next.pose"), j)["p"], lambda after: vsub(after, s["p"]))
        turn = let(F.get("_parent", j), lambda up: F.when(up < 0, F.col("facing")).otherwise(F.get("pose", up)["q"]))
        place, speed = let(ground, lambda v: qrot(F.col("facing"), v)), let(step, lambda v: qrot(F.col("_next.facing"), v))
        return let(place, lambda p: let(speed, lambda v: let(turn, lambda q: F.concat(F.array(p["x"], p["y"], p["z"]), q_to_6d(q), F.array(v["x"], v["y"], v["z"])))))

    # outer: no filter is inferred, which would work the arrays out once more below each column that they come from
    return rows.select("rig", "clip", "frame", "facing", F.posexplode_outer(F.transform("pose", one)).alias("j", "f")).where("j IS NOT NULL")


def _by_frame(features: DataFrame) -> DataFrame:
    """One row a frame with its features in an array `slots` of struct(j, f)."""
    return features.groupBy("clip", "frame").agg(F.first("rig").alias("rig"), F.first("facing").alias("facing"), F.array_sort(F.collect_list(F.struct("j", "f"))).alias("slots")).where(F.exists("slots", lambda s: s["j"] == 0))


def _on_path(rows: DataFrame) -> DataFrame:
    """Rows of _by_frame with `path`, the root's place over the ground: the running sum of its velocities turned back."""
    own = F.get(F.filter("slots", lambda s: s["j"] == 0), F.lit(0))["f"]
    # velocity at t was turned by the facing at t + 1
    rows = rows.withColumn("_v", let(own, lambda f: vec(f[9], F.lit(0.0), f[11]))).withColumn("_v", F.lag("_v").over(by_frame())).withColumn("_v", let(F.col("_v"), lambda v: qrot(qconj(F.col("facing")), v)))
    # the first frame has no step: its fields are null
    w = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("path", vec(F.sum(F.coalesce("_v.x", F.lit(0.0))).over(w), F.lit(0.0), F.sum(F.coalesce("_v.z", F.lit(0.0))).over(w))).drop("_v")


def _placed_by_features() -> Column:
    """Of a row of _on_path, (j, p): each joint's place hangs on the root's path."""
    def place(s: Column) -> Column:
        return let(vec(*(s["f"][k] for k in range(3))), lambda v: let(qrot(qconj(F.col("facing")), v), lambda r: F.struct(s["j"].alias("j"), vadd(r, F.col("path")).alias("p"))))

    return F.transform("slots", place)


def recover_positions(features: DataFrame) -> DataFrame:
    """Joints' places from features: the root's path is the running sum of its velocities turned back, the others hang on it."""
    return _on_path(_by_frame(features)).select("clip", "frame", F.explode(_placed_by_features()).alias("s")).select("clip", "frame", "s.j", "s.p")


def chordal_mean(turns: Column, rounds: int = 16) -> Column:
    """The rotation nearest to several unit quaternions taken together: the first eigenvector of the sum of their outer squares, by power iteration."""

    def two(a: Column, b: Column) -> Column:
        # their sum is that eigenvector, or their difference if they point apart; one is its own mean
        return let(F.signum(a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]), lambda s: qunit(quat(*(a[k] + s * b[k] for k in "wxyz"))))

    def onward(v: Column) -> Column:
        total = F.aggregate(turns, quat(*(F.lit(0.0) for _ in range(4))), lambda a, q: let(q["w"] * v["w"] + q["x"] * v["x"] + q["y"] * v["y"] + q["z"] * v["z"], lambda d: quat(*(a[k] + q[k] * d for k in "wxyz"))))
        return qunit(total)

    few = let(F.get(turns, F.lit(0)), lambda a: let(F.get(turns, F.size(turns) - 1), lambda b: two(a, b)))
    return F.when(F.size(turns) <= 2, few).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.get(turns, F.lit(0)), lambda v, _: onward(v)))


def recover_from_rotations(features: DataFrame, rigs: DataFrame) -> DataFrame:
    """Joints' places from features by their turns; rigs(rig, joints array of struct(j, parent, p)) with p the rest offset.

    A joint's turn is in its children's rows, so it is the mean of theirs; one
    without children doesn't turn. The root's path is that of recover_positions,
    at the height that its row has; the places below follow down the tree.
    """
    rows = _placed_by_turns(_on_path(_by_frame(features).join(rigs.select("rig", "joints"), "rig")))
    return rows.select("clip", "frame", F.posexplode_outer("turned").alias("j", "p")).where("j IS NOT NULL")


def _placed_by_turns(rows: DataFrame) -> DataFrame:
    """Rows of _on_path with their rig's `joints` get `turned`, the places by turns in the order of joints."""
    turns = F.transform("slots", lambda s: let(F.slice(s["f"], 4, 6), lambda six: let(r6_to_matrix(six), matrix_to_q)))
    start = F.get(F.filter(_placed_by_features(), lambda s: s["j"] == 0), F.lit(0))["p"]
    none = quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def own(x: Column, told: Column) -> Column:
        below = F.transform(F.filter("joints", lambda y: y["parent"] == x["j"]), lambda y: F.get(told, y["j"]))
        return let(below, lambda b: F.when(F.size(b) > 0, chordal_mean(b)).otherwise(none))

    def local(told: Column, first: Column) -> Column:
        return F.transform("joints", lambda x: F.struct(x["j"].alias("j"), x["parent"].alias("parent"), F.when(x["parent"] < 0, first).otherwise(x["p"]).alias("p"), own(x, told).alias("q")))

    return forward_kinematics(rows.withColumn("joints", let(turns, lambda told: let(start, lambda first: local(told, first))))).withColumn("turned", F.transform("world", lambda w: w["p"])).drop("world")


def feature_row_gate(features: DataFrame, frames: DataFrame, tolerance: float = 1e-4, rigs: DataFrame | None = None) -> DataFrame:
    """(clip, reason, error) of clips with no features, values that aren't finite, or recovered places that leave the source (from the root's first ground point) by more than the tolerance. With rigs the error is the larger of the two recoveries'."""
    bad = F.exists("f", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    odd = features.groupBy("clip").agg(F.bool_or(bad).alias("odd"))
    start = frames.groupBy("clip").agg(F.min_by(F.get("pose", F.lit(0))["p"], "frame").alias("o"))
    # a frame is one row all the way: its source joins by clip and frame, after which rows are dealt out by clip once
    rows = _by_frame(features).join(frames.select("clip", "frame", "pose"), ["clip", "frame"], "left")
    if rigs is not None:
        rows = rows.join(rigs.select("rig", "joints"), "rig", "left")
    rows = _on_path(rows).join(start, "clip")

    def apart(j: Column, p: Column) -> Column:
        return let(F.get("pose", j)["p"], lambda w: let(vsub(p, vec(w["x"] - F.col("o.x"), w["y"], w["z"] - F.col("o.z"))), vnorm))

    errors = [F.array_max(F.transform(_placed_by_features(), lambda s: apart(s["j"], s["p"])))]
    if rigs is not None:
        rows = _placed_by_turns(rows)
        errors.append(F.array_max(F.transform("turned", lambda p, j: apart(j, p))))
    error = rows.groupBy("clip").agg(F.max(F.greatest(*errors, F.lit(None).cast("double"))).alias("error"))
    every = frames.select("clip").distinct().join(odd, "clip", "left").join(error, "clip", "left")
    reason = F.when(F.col("odd").isNull(), "no features").when(F.col("odd"), "not finite").when(F.col("error") > tolerance, "recovery differs")
    return every.select("clip", reason.alias("reason"), "error")


def travel_direction(frames: DataFrame, pairs: DataFrame, window: int = 200, samples: int = 8, least: float = 0.8) -> DataFrame:
    """frames(clip, rig, frame from 0, pose), pairs(rig, right, left, body_axis, height): clip, net (the root's way over the ground in heights, within the window) and direction.

    The direction is forward or backward if the mean cosine of the way with the
    facings of about `samples` frames is beyond `least`, else empty: also for rigs
    without a pair, clips that don't travel and frames in which the pair
    coincides. With a body axis the right joint is the head's and the left the
    tail's.
    """
    rows = frames.where(F.col("frame") < window)
    root = F.get("pose", F.lit(0))["p"]
    ends = rows.groupBy("clip", "rig").agg(F.count(F.lit(1)).alias("n"), F.min_by(root, "frame").alias("a"), F.max_by(root, "frame").alias("b"))
    ends = ends.join(pairs, "rig", "left").withColumn("way", vec(F.col("b.x") - F.col("a.x"), F.lit(0.0), F.col("b.z") - F.col("a.z")))
    ends = ends.select("clip", "right", "left", "body_axis", "way", vnorm(F.col("way")).alias("length"), F.coalesce("height", F.lit(1.0)).alias("height"), F.greatest(F.floor(F.col("n") / samples), F.lit(1)).alias("step"))
    seen = rows.join(ends.where("length > 0 AND right IS NOT NULL"), "clip").where(F.col("frame") % F.col("step") == 0)
    across = vsub(F.get("pose", F.col("left"))["p"], F.get("pose", F.col("right"))["p"])
    ahead = seen.withColumn("across", across).withColumn("ahead", F.when(F.col("body_axis"), vec(-F.col("across.x"), F.lit(0.0), -F.col("across.z"))).otherwise(vec(-F.col("across.z"), F.lit(0.0), F.col("across.x"))))
    cosine = vdot(F.col("ahead"), F.col("way")) / (vnorm(F.col("ahead")) * F.col("length"))
    mean = ahead.where(vnorm(F.col("ahead")) > EPSILON).groupBy("clip").agg(F.avg(cosine).alias("c"))
    word = F.when(F.col("c") > least, "forward").when(F.col("c") < -least, "backward").otherwise("")
    return ends.join(mean, "clip", "left").select("clip", (F.col("length") / F.col("height")).alias("net"), word.alias("direction"))


def upside_down_audit(joints: DataFrame, extent: float = 0.1) -> DataFrame:
    """joints(rig, part, y, extent): rigs whose feet are on average higher than their heads by more than a share of their extent."""
    per = joints.groupBy("rig").agg(F.avg(F.when(F.col("part") == "Foot", F.col("y"))).alias("feet"), F.avg(F.when(F.col("part") == "Head", F.col("y"))).alias("head"), F.max("extent").alias("extent"))
    return per.where(F.col("feet") - F.col("head") > F.col("extent") * extent).select("rig")


def name_pairs_by_mirror(joints: DataFrame, share: float = 0.03) -> DataFrame:
    """joints(rig, j, x, y, z, extent): for each rig's better lateral axis the joints that mirror each other within a share of its extent."""
    axes = F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("s"), F.col(other).alias("o")) for axis, other in (("x", "z"), ("z", "x"))))
    # both axes are rows of one table: a union of tables that are grouped by rig may be grouped wrongly after it
    rows = joints.select("rig", "extent", "j", "y", F.explode(axes).alias("at")).select("rig", "extent", "j", "y", "at.*")
    a = rows.where("s > 0").withColumnRenamed("j", "a")
    b = rows.where("s < 0").select("rig", "axis", F.col("j").alias("b"), F.col("s").alias("s2"), F.col("y").alias("y2"), F.col("o").alias("o2"))
    d = F.sqrt(F.pow(F.col("s") + F.col("s2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("o") - F.col("o2"), 2))
    met = a.join(b, ["rig", "axis"]).where(F.col("a") != F.col("b")).withColumn("d", d).where(F.col("d") <= F.col("extent") * share)
    best = met.groupBy("rig", "axis", "a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    best = best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rig", "axis")))
    most = F.min(F.struct((-F.col("n")).alias("n"), "axis")).over(Window.partitionBy("rig"))
    return best.withColumn("most", most).where("axis = most.axis").select("rig", "axis", "a", "b")


def rotation_amplitude(frames: DataFrame) -> DataFrame:
    """Per clip and joint the largest angle to the first frame, in degrees."""
    from ..functions.geometry import q_angle

    rows = frames.select("clip", "frame", F.posexplode("pose").alias("j", "s"))
    first = F.first("s.q").over(Window.partitionBy("clip", "j").orderBy("frame"))
    return rows.withColumn("_0", first).groupBy("clip", "j").agg(F.max(q_angle(F.col("s.q"), F.col("_0"))).alias("amplitude"))


def realign_clip(turns: DataFrame) -> DataFrame:
    """turns(clip, frame, j, parent, q): root turns are counted from the clip's first, which its children take over; other joints stay."""
    first = turns.where("parent < 0").groupBy("clip").agg(F.min_by("q", "frame").alias("_q"))
    q = F.when(F.col("parent") < 0, qmul(F.col("q"), qconj(F.col("_q")))).when(F.col("parent") == 0, qmul(F.col("_q"), F.col("q"))).otherwise(F.col("q"))
    return turns.join(first, "clip").withColumn("q", q).drop("_q")


def root_offset_patch(turns: DataFrame, patches: DataFrame) -> DataFrame:
    """turns(clip, frame, j, parent, q), patches(clip, offset): the root's turn times the patch. It starts from the raw table, so it can be run again, changed or left out; `applied` keeps the offset for audits."""
    out = turns.join(patches.select("clip", F.col("offset").alias("applied")), "clip", "left")
    return out.withColumn("q", F.when((F.col("parent") < 0) & F.col("applied").isNotNull(), qmul(F.col("q"), F.col("applied"))).otherwise(F.col("q")))


def rest_orientation_patch(rests: DataFrame, patches: DataFrame) -> DataFrame:
    """rests(rig, j, parent, p, q), patches(rig, turn, shift): the root's rest place and turn get `turn`, the place then `shift`."""
    out = rests.join(patches, "rig", "left")
    patched = (F.col("parent") < 0) & F.col("turn").isNotNull()
    p = F.when(patched, vadd(qrot(F.col("turn"), F.col("p")), F.col("shift"))).otherwise(F.col("p"))
    return out.withColumn("p", p).withColumn("q", F.when(patched, qmul(F.col("turn"), F.col("q"))).otherwise(F.col("q"))).drop("turn", "shift")
