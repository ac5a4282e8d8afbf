"""What a model is told of a rig, and batches of clips in which every row has one shape.

A rig's condition is one row: its tree, matrices over pairs of joints, spectra and
facing pair. A batch is as many rows as clips, each padded to the widest rig of its
batch, so nothing larger than a padded clip is ever in one row; rows of a batch
meet only in an aggregate of two numbers a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .topology import tree_key, tree_spectra
from .trees import ancestors, condition_of, to_rigs

#: Numbers of the relations that trees.joint_pairs names.
RELATIONS = {"self": 0, "parent": 1, "child": 2, "sibling": 3, "none": 4, "end_effector": 5}


def _each(n: Column, value) -> Column:
    """value(0) to value(n - 1) as an array, empty for no n."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), value)


def joint_matrices(joints: DataFrame, clamp: int = 5) -> DataFrame:
    """joints(rig, j, parent): (rig, parents, relations, distances), the last two with a row and a column for each joint: numbers of RELATIONS, and steps along the tree, `clamp` at most."""
    rigs = to_rigs(joints, ["parent"]).select("rig", F.transform("joints", lambda x: x["parent"]).alias("parents"), ancestors(F.col("joints")).alias("up"))
    return rigs.select("rig", "parents", *matrices(clamp))


def matrices(clamp: int = 5) -> list[Column]:
    """relations and distances from a rig's columns `parents` and `up`, each joint's ancestors."""
    n = F.size("parents")

    def relation(a: Column, b: Column) -> Column:
        pa, pb = F.get("parents", a), F.get("parents", b)
        own = F.when(F.array_contains("parents", a), RELATIONS["self"]).otherwise(RELATIONS["end_effector"])
        return F.when(a == b, own).when(pa == b, RELATIONS["parent"]).when(pb == a, RELATIONS["child"]).when(pa == pb, RELATIONS["sibling"]).otherwise(RELATIONS["none"])

    def distance(a: Column, b: Column) -> Column:
        ua, ub = F.get("up", a), F.get("up", b)
        return F.least(F.size(ua) + F.size(ub) - 2 * F.size(F.array_intersect(ua, ub)), F.lit(clamp))

    return [_each(n, lambda a: _each(n, lambda b: relation(a, b))).alias("relations"), _each(n, lambda a: _each(n, lambda b: distance(a, b))).alias("distances")]


def rig_condition(joints: DataFrame, pairs: DataFrame | None = None, clamp: int = 5, k: int = 8) -> DataFrame:
    """joints(rig, j, parent, name, length), pairs(rig, right, left): one row a rig.

    The columns of trees.topology_condition, parents, relations, distances, depths, edges (both directions, as two arrays),
    spectra (k values a joint) and face (right, left), null for a rig without a pair.
    """
    rows = joints.select("rig", F.col("j").cast("int").alias("j"), F.col("parent").cast("int").alias("parent"), "name", "length")
    # written: the trees that are solved are distinct ones, and each rig takes its own
    rigs = staged(to_rigs(rows, ["parent", "name", "length"]), "condition-rigs").withColumn("parents", F.transform("joints", lambda x: x["parent"])).withColumn("tree", tree_key("parents"))
    out = condition_of(rigs).withColumnRenamed("anc", "up").withColumn("parents", F.transform("joints", lambda x: x["parent"])).withColumn("tree", tree_key("parents"))
    out = out.join(staged(tree_spectra(rigs, k).withColumnRenamed("values", "spectra"), "spectra"), "tree").drop("tree")
    out = out.select("rig", "n_joints", "joints", "template", "diameter", "chains", "parents", *matrices(clamp), "spectra")
    bones = F.filter(F.transform("parents", lambda p, j: F.struct(j.alias("j"), p.alias("p"))), lambda x: x["p"] >= 0)
    child, parent = F.transform(bones, lambda x: x["j"]), F.transform(bones, lambda x: x["p"])
    out = out.withColumn("depths", F.transform("joints", lambda x: x["depth"])).withColumn("edges", F.array(F.concat(child, parent), F.concat(parent, child)))
    if pairs is None:
        return out.withColumn("face", F.lit(None).cast("struct<right:int,left:int>"))
    return out.join(pairs.select("rig", F.struct(F.col("right").cast("int").alias("right"), F.col("left").cast("int").alias("left")).alias("face")), "rig", "left")


def _padded(values: str, n: Column, fill: Column) -> Column:
    """The column's array with `fill` up to n places."""
    return _each(n, lambda i: F.coalesce(F.get(F.col(values), i), fill))


def padded_batches(batches: DataFrame, clips: DataFrame, features: DataFrame, conditions: DataFrame, stats: DataFrame, length: int, channels: int = 12, captions: DataFrame | None = None) -> DataFrame:
    """One row a clip of a batch, all of a batch's rows in one shape.

    batches(batch, clips) as export_batches makes them, clips(clip, rig, dataset), features(clip, frame, j, f), conditions as rig_condition makes them,
    stats(dataset, is_root, channel, mean, std), captions(clip, tokens: one array of numbers a token).

    With w joints, those of the batch's largest rig: motion[w][channels][length], mean and std[w][channels], relations and distances[w][w], depths[w],
    spectra[w][k], joint_mask[w], length_mask[length]. Frames from `length` on are left out. What is padded is zero, but std is one there. A clip
    without a frame before `length` has length 0; one whose data set has no statistics (see check_stats) has no row. With captions, tokens and caption_mask have as many places as the batch's longest, one at
    least; the first is marked always, so that a clip without a caption has one token of zeros.
    """
    slots = batches.select("batch", F.posexplode("clips").alias("slot", "clip")).join(clips.select("clip", "rig", "dataset"), "clip")
    sizes = slots.join(conditions.select("rig", "n_joints"), "rig").groupBy("batch").agg(F.max("n_joints").alias("w"))
    # dealt out by clip once, for both groupings
    frames = features.where(F.col("frame") < length).select("clip", "j", "frame", "f").repartition("clip").groupBy("clip", "j").agg(F.sort_array(F.collect_list(F.struct("frame", "f"))).alias("v"))
    frames = frames.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("v"))

    def channel_values(name: str, root: bool) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("is_root") == root, F.struct("channel", name))))
        return F.transform(rows, lambda x: x[name]).alias(f"{name}_{'root' if root else 'other'}")

    moments = stats.groupBy("dataset").agg(*(channel_values(name, root) for name in ("mean", "std") for root in (True, False)))
    told = conditions.select("rig", "n_joints", "parents", "edges", "relations", "distances", "depths", "spectra")
    rows = slots.join(sizes, "batch").join(frames, "clip", "left").join(told, "rig").join(moments, "dataset")
    w, own = F.col("w"), F.col("n_joints")
    n_frames = F.coalesce(F.size(F.get("v", F.lit(0))["v"]), F.lit(0))
    zeros = F.array_repeat(F.lit(0.0), channels)

    def at(j: Column, d: Column, t: Column) -> Column:
        return F.coalesce(F.get(F.get(F.get(F.col("v"), j)["v"], t)["f"], d), F.lit(0.0))

    def moment(name: str, fill: Column) -> Column:
        return _each(w, lambda j: F.when(j >= own, fill).when(j == 0, F.col(f"{name}_root")).otherwise(F.col(f"{name}_other")))

    def square(name: str) -> Column:
        return _each(w, lambda a: _each(w, lambda b: F.coalesce(F.get(F.get(name, a), b), F.lit(0))))

    out = {
        "length": n_frames,
        "motion": _each(w, lambda j: _each(F.lit(channels), lambda d: _each(F.lit(length), lambda t: at(j, d, t)))),
        "mean": moment("mean", zeros),
        "std": moment("std", F.array_repeat(F.lit(1.0), channels)),
        "relations": square("relations"),
        "distances": square("distances"),
        "depths": _padded("depths", w, F.lit(0)),
        "spectra": _padded("spectra", w, F.transform(F.get("spectra", F.lit(0)), lambda _: F.lit(0.0))),
        "joint_mask": _each(w, lambda j: j < own),
        "length_mask": _each(F.lit(length), lambda t: t < n_frames),
    }
    kept = ["batch", "slot", "clip", "rig", "n_joints", "parents", "edges"]
    if captions is None:
        return rows.select(*kept, *(c.alias(name) for name, c in out.items()))
    told_of = slots.select("batch", "clip").join(captions.select("clip", "tokens"), "clip")
    widths = told_of.groupBy("batch").agg(F.max(F.size("tokens")).alias("n_tokens"), F.max(F.size(F.get("tokens", F.lit(0)))).alias("wide"))
    # under another name than the result's, which the mask would else be taken from
    rows = rows.join(captions.select("clip", F.col("tokens").alias("own_tokens")), "clip", "left").join(widths, "batch", "left")
    n = F.greatest(F.coalesce("n_tokens", F.lit(1)), F.lit(1))
    blank = F.array_repeat(F.lit(0.0), F.greatest(F.coalesce("wide", F.lit(0)), F.lit(0)))
    out["tokens"] = _padded("own_tokens", n, blank)
    out["caption_mask"] = _each(n, lambda i: (i == 0) | (i < F.coalesce(F.size("own_tokens"), F.lit(0))))
    return rows.select(*kept, *(c.alias(name) for name, c in out.items()))
