"""Changes of a rig's tree that take its poses along.

rigs(rig, joints array of struct(j, parent, p)): p is a joint's rest offset from
its parent; joints are numbered from 0 and come after their parents. frames(clip,
rig, frame, root, turns): root is the root's place, turns the joints' local
turns. A rig's draws depend on the seed, its name and the joint alone, so every
run and every clip of the rig makes the same change. Work stays inside one row a
rig; only rigs are joined to frames.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chance import seeded_order
from ..functions.geometry import let, qconj, qmul, quat, vadd, vcross, vdot, vec, vnorm, vscale, vsub, vunit
from .trees import ancestors, down, forward_kinematics

#: At most as many leaves go.
MOST_LEAVES = 3
#: Where on its bone a new joint may be; spread and width of the ellipsoid that it is moved in, in bone lengths.
SPLIT, SIGMA, LATERAL = (0.3, 0.7), 0.5, 0.5
#: Draws of a radius of which the first within the ellipsoid counts; all miss it once in 10 ** 21.
TRIES = 16


def identity() -> Column:
    return quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


def draw(seed: int, *keys: Column) -> Column:
    """A number between 0 and 1 from the first six digits of the seeded order."""
    return (F.conv(F.substring(seeded_order(seed, F.concat_ws("/", *keys)), 1, 6), 16, 10).cast("double") + 0.5) / 16777216


def _kids(joints: Column, j: Column) -> Column:
    return F.size(F.filter(joints, lambda y: y["parent"] == j))


def short_bones(rigs: DataFrame, children: int, count: Column, seed: int) -> DataFrame:
    """rigs with `gone`: `count` (of n, the candidates) joints but the root with so many children, drawn without replacement, shorter bones likelier."""
    joints = F.col("joints")
    rows = rigs.withColumn("_able", F.filter(joints, lambda x: (x["parent"] >= 0) & (_kids(joints, x["j"]) == children)))
    # the least of exponential draws, at rates of length ** -0.5
    rank = F.transform("_able", lambda x: F.struct((-F.ln(draw(seed, F.col("rig"), x["j"])) * F.sqrt(F.greatest(vnorm(x["p"]), F.lit(1e-8)))).alias("k"), x["j"].alias("j")))
    rows = rows.withColumn("n", F.size("_able")).withColumn("_rank", F.array_sort(rank))
    return rows.withColumn("gone", F.transform(F.slice("_rank", 1, F.when(F.col("n") > 0, count.cast("int")).otherwise(0)), lambda r: r["j"])).drop("_able", "_rank", "n")


def without(rigs: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rigs with `gone`: (rigs, frames) without those joints. A joint below them takes their offsets and turns into its own and hangs on the nearest joint that is left; numbers close up."""
    gone = F.col("gone")
    rows = rigs.withColumn("_above", ancestors(F.col("joints"))).withColumn("_kept", F.filter(F.transform("joints", lambda x: x["j"]), lambda j: ~F.array_contains(gone, j)))

    def run(j: Column) -> Column:
        up = F.get("_above", j)
        return let(F.reverse(F.slice(up, 1, F.size(up) - 1)), lambda a: F.struct(F.slice(a, 1, F.array_position(F.concat(F.transform(a, lambda k: F.array_contains(gone, k)), F.array(F.lit(False))), False).cast("int") - 1).alias("gone"), a.alias("up")))

    rows = rows.withColumn("_runs", F.transform("_kept", lambda j: F.struct(j.alias("j"), run(j).alias("r"))))
    rows = rows.withColumn("plan", F.transform("_runs", lambda s: F.struct(s["j"].alias("j"), F.reverse(s["r"]["gone"]).alias("run"), F.coalesce(F.get(s["r"]["up"], F.size(s["r"]["gone"])), F.lit(-1)).alias("parent"))))
    offset = lambda s: F.aggregate(s["run"], F.get("joints", s["j"])["p"], lambda a, k: vadd(a, F.get("joints", k)["p"]))
    left = F.transform("plan", lambda s, i: F.struct(i.alias("j"), F.when(s["parent"] < 0, -1).otherwise(F.array_position("_kept", s["parent"]).cast("int") - 1).alias("parent"), offset(s).alias("p")))
    turn = lambda s: let(F.aggregate(s["run"], identity(), lambda a, k: qmul(a, F.get("turns", k))), lambda a: qmul(a, F.get("turns", s["j"])))
    turned = frames.join(rows.select("rig", "plan"), "rig").withColumn("turns", F.transform("plan", turn)).select(*frames.columns)
    others = [c for c in rigs.columns if c not in ("joints", "gone")]
    return rows.select(*others, left.alias("joints"), F.col("_kept").alias("was")), turned


def leaf_removal(rigs: DataFrame, frames: DataFrame, rate: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Up to MOST_LEAVES leaves, as many as the rate says, rounded half to even, go; `was` has the numbers of those that are left."""
    return without(short_bones(rigs, 0, F.least(F.bround(F.col("n") * F.lit(rate)), F.lit(MOST_LEAVES)), seed), frames)


def pooling(rigs: DataFrame, frames: DataFrame, rate: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """One joint with a single child at least, or as many as the rate says, go into that child; turns from there on stay in the world, places where what went didn't turn."""
    return without(short_bones(rigs, 1, F.greatest(F.floor(F.col("n") * F.lit(rate)), F.lit(1)), seed), frames)


def ellipsoid_shift(bone: Column, rig: Column, seed: int) -> Column:
    """A place in an ellipsoid along the bone: any direction, a half-normal radius cut off at the surface."""
    u = lambda name: draw(seed, rig, F.lit(name))
    radii = [F.abs(F.sqrt(-2 * F.ln(u(f"r{k}"))) * F.cos(2 * pi * u(f"a{k}"))) * SIGMA for k in range(TRIES)]
    radius = F.coalesce(*(F.when(r <= 1, r) for r in radii), F.lit(0.0))

    def unit(height: Column) -> Column:
        return let(F.struct(F.sqrt(1 - height * height).alias("flat"), (2 * pi * u("phi")).alias("phi")), lambda a: vec(height, a["flat"] * F.cos(a["phi"]), a["flat"] * F.sin(a["phi"])))

    # each draw is bound before it is used: whatever is named twice would be drawn twice
    drawn = let(2 * u("z") - 1, lambda height: let(radius, lambda r: let(unit(height), lambda e: vscale(e, r))))

    def along(e: Column, d: Column, length: Column) -> Column:
        up, side = vec(F.lit(0.0), F.lit(1.0), F.lit(0.0)), vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))
        other = F.when(F.abs(vdot(e, up)) > 0.9, vunit(vcross(e, side))).otherwise(vunit(vcross(e, up)))
        return let(other, lambda f: let(vcross(e, f), lambda g: vadd(vadd(vscale(e, d["x"] * length), vscale(f, d["y"] * length * LATERAL)), vscale(g, d["z"] * length * LATERAL))))

    nothing = vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return let(bone, lambda b: F.when(vnorm(b) < 1e-8, nothing).otherwise(let(vunit(b), lambda e: let(drawn, lambda d: along(e, d, vnorm(b))))))


def joint_addition(rigs: DataFrame, frames: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A joint on a drawn bone, between SPLIT of its length and moved within an ellipsoid; it doesn't turn, so all others stay where they are in every frame. It takes its child's number (`added`), later ones go up by one; a rig of one joint stays."""
    n = F.size("joints")
    rows = rigs.withColumn("added", F.when(n > 1, (1 + F.floor(draw(seed, F.col("rig"), F.lit("joint")) * (n - 1))).cast("int")))
    bone = F.get("joints", F.col("added"))["p"]
    share = SPLIT[0] + (SPLIT[1] - SPLIT[0]) * draw(seed, F.col("rig"), F.lit("share"))
    at = F.col("added")
    place = let(F.struct(bone.alias("b"), share.alias("share")), lambda s: let(ellipsoid_shift(s["b"], F.col("rig"), seed), lambda moved: vadd(vscale(s["b"], s["share"]), moved)))

    def shifted(x: Column, placed: Column) -> Column:
        new = x["j"] == at
        return F.struct(
            (x["j"] + F.when(x["j"] >= at, 1).otherwise(0)).alias("j"), F.when(new, at).otherwise(x["parent"] + F.when(x["parent"] >= at, 1).otherwise(0)).alias("parent"), F.when(new, vsub(x["p"], placed)).otherwise(x["p"]).alias("p")
        )

    def longer(placed: Column) -> Column:
        put = F.struct(at.alias("j"), F.get("joints", at)["parent"].alias("parent"), placed.alias("p"))
        return let(F.transform("joints", lambda x: shifted(x, placed)), lambda whole: F.concat(F.slice(whole, 1, at), F.array(put), F.slice(whole, at + 1, n)))

    # bound: as a column of its own the place would be put into each joint's number and drawn there again
    rows = rows.withColumn("joints", F.when(at.isNull(), F.col("joints")).otherwise(let(place, longer)))
    turns = F.concat(F.slice("turns", 1, at), F.array(identity()), F.slice("turns", at + 1, F.size("turns")))
    turned = frames.join(rows.select("rig", "added"), "rig").withColumn("turns", F.when(at.isNull(), F.col("turns")).otherwise(turns)).select(*frames.columns)
    return rows, turned


def bone_scale(rigs: DataFrame, seed: int, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Each bone's offset by a drawn factor; the root's stays. Turns stay as they are, `posed` gives the places anew."""
    scaled = lambda x: F.struct(x["j"].alias("j"), x["parent"].alias("parent"), F.when(x["parent"] < 0, x["p"]).otherwise(vscale(x["p"], low + (high - low) * draw(seed, F.col("rig"), x["j"]))).alias("p"))
    return rigs.withColumn("joints", F.transform("joints", scaled))


def posed(rigs: DataFrame, frames: DataFrame) -> DataFrame:
    """frames with `pose`, each joint's place and turn in the world (p, world) and its local turn (q), from which features and velocities are made."""
    local = F.transform("joints", lambda x: F.struct(x["j"].alias("j"), x["parent"].alias("parent"), F.when(x["parent"] < 0, F.col("root")).otherwise(x["p"]).alias("p"), F.get("turns", x["j"]).alias("q")))
    rows = forward_kinematics(frames.join(rigs.select("rig", "joints"), "rig").withColumn("joints", local))
    return rows.withColumn("pose", F.transform("world", lambda w, i: F.struct(w["p"].alias("p"), F.get("turns", i).alias("q"), w["q"].alias("world")))).select(*frames.columns, "pose")


def rebase_to_rest(rigs: DataFrame, frames: DataFrame) -> DataFrame:
    """rigs(rig, joints array of struct(j, parent, q)), q the rest turns: frames whose turns are counted from the rest pose, in the frame that the rest turns add up to at the parent."""
    rows = rigs.withColumn("_sum", down(F.col("joints"), lambda x: x["q"], lambda up, x: qmul(up, x["q"])))
    rows = rows.withColumn("rest", F.transform("joints", lambda x: F.struct(F.when(x["parent"] < 0, identity()).otherwise(F.get("_sum", F.greatest(x["parent"], F.lit(0)))).alias("up"), F.get("_sum", x["j"]).alias("own"))))
    turned = F.transform("turns", lambda q, i: let(F.get("rest", i), lambda r: qmul(qmul(r["up"], q), qconj(r["own"]))))
    return frames.join(rows.select("rig", "rest"), "rig").withColumn("turns", turned).select(*frames.columns)
