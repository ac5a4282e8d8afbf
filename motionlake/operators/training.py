"""Normalization statistics, splits, sampling and padding of the training mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import seeded_order, seeded_uniform

FLOOR = 1e-8


def channels(features: DataFrame) -> DataFrame:
    """features(dataset, rig, clip, frame, j, f array) to one row a channel: is_root, channel, value."""
    return features.select("dataset", "rig", (F.col("j") == 0).alias("is_root"), F.posexplode("f").alias("channel", "value"))


def stats_frame_weighted(features: DataFrame, pooled: bool = False) -> DataFrame:
    """Mean and population deviation of each channel, root and other joints apart; every row counts the same."""
    by = ([] if pooled else ["dataset"]) + ["is_root", "channel"]
    return channels(features).groupBy(*by).agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(FLOOR)).alias("std"))


def stats_balanced(features: DataFrame, pooled: bool = False) -> DataFrame:
    """As before with every rig counting the same: mean of means; variance within plus variance between rigs."""
    by = ([] if pooled else ["dataset"]) + ["is_root", "channel"]
    rig = channels(features).groupBy("dataset", "rig", "is_root", "channel").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return rig.groupBy(*by).agg(F.avg("m").alias("mean"), F.greatest(F.sqrt(F.avg("v") + F.var_pop("m")), F.lit(FLOOR)).alias("std"))


def tie_std(stats: DataFrame) -> DataFrame:
    """One deviation, the average, for positions (0-2), rotations (3-8) and velocities (9-11)."""
    group = F.when(F.col("channel") < 3, 0).when(F.col("channel") < 9, 1).otherwise(2)
    keys = [c for c in ("dataset", "is_root") if c in stats.columns]
    return stats.withColumn("std", F.avg("std").over(Window.partitionBy(*keys, group)))


def broadcast_pool(pool: DataFrame, datasets: DataFrame, made: str) -> DataFrame:
    """Pooled statistics under every data set's key, with how they were made. Both sides are one row a channel or data set."""
    return datasets.select("dataset").distinct().join(F.broadcast(pool), F.lit(True)).withColumn("pool", F.lit(made))


def check_stats(stats: DataFrame, datasets: DataFrame, width: int = 12) -> DataFrame:
    """(dataset, reason) for data sets whose statistics are missing or have another number of channels."""
    have = stats.groupBy("dataset").agg(F.count_distinct("channel").alias("n"), F.count_if(F.col("mean").isNull() | F.col("std").isNull()).alias("nulls"))
    reason = F.when(F.col("n").isNull(), "no statistics").when(F.col("n") != width, "wrong width").when(F.col("nulls") > 0, "missing values")
    return datasets.select("dataset").distinct().join(have, "dataset", "left").select("dataset", reason.alias("reason")).where("reason IS NOT NULL")


def normalize(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(value - mean) / std for each channel; NaN becomes zero. The statistics are two arrays a data set and root flag."""
    packed = stats.groupBy("dataset", "is_root").agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("_s"))
    out = features.withColumn("_root", F.col("j") == 0).join(packed, (features["dataset"] == packed["dataset"]) & (F.col("_root") == packed["is_root"])).drop(packed["dataset"])
    return out.withColumn("f", F.zip_with("f", "_s", lambda x, s: F.nanvl((x - s["mean"]) / s["std"], F.lit(0.0)))).select(*features.columns)


def split_explicit(clips: DataFrame, test_rigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips with their split, listed rigs that aren't there)."""
    t = test_rigs.select("rig", F.lit("test").alias("_s")).distinct()
    absent = t.select("rig").join(clips.select("rig").distinct(), "rig", "left_anti")
    return clips.join(t, "rig", "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s"), absent


def split_by_rig(clips: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Holds out round(n * ratio) rigs, half to even, never all of them.

    Those are the first in a seeded order. They are counted by its first three
    digits, and only the range in which the last of them lies is ranked.
    """
    rigs = clips.select("rig").distinct().withColumn("_o", seeded_order(seed, F.col("rig"))).withColumn("_b", F.substring("_o", 1, 3))
    counts = sorted((r["_b"], r["count"]) for r in rigs.groupBy("_b").count().collect())
    n = sum(c for _, c in counts)
    left, edge = max(0, min(round(n * ratio), n - 1)), ""
    for edge, c in counts:
        if left <= c:
            break
        left -= c
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_o", "rig"))
    inside = rigs.where(F.col("_b") == edge).select("rig", (rank <= left).alias("_held"))
    others = rigs.where(F.col("_b") != edge).select("rig", (F.col("_b") < edge).alias("_held"))
    return clips.join(inside.union(others).select("rig", F.when(F.col("_held"), "test").otherwise("train").alias("split")), "rig")


def split_by_clip(clips: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """The same inside every rig."""
    n = F.count(F.lit(1)).over(Window.partitionBy("rig"))
    k = F.row_number().over(Window.partitionBy("rig").orderBy(seeded_order(seed, F.col("clip"))))
    return clips.withColumn("_n", F.least(F.bround(n * F.lit(ratio), 0), n - 1)).withColumn("_k", k).withColumn("split", F.when(F.col("_k") <= F.col("_n"), "test").otherwise("train")).drop("_n", "_k")


def object_subset(rigs: DataFrame, category: str | None = None, first: int | None = None, excluded: DataFrame | None = None) -> DataFrame:
    out = rigs.where(F.col("category") == category) if category else rigs
    if excluded is not None:
        out = out.join(excluded.select("rig"), "rig", "left_anti")
    return out.orderBy("rig").limit(first) if first else out


def hash_half(rig: Column) -> Column:
    """dev or test by the parity of the SHA-1's last digit."""
    return F.when(F.conv(F.substring(F.sha1(rig), -1, 1), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


def sampling_weights(clips: DataFrame, alpha: float = 0.5, beta: float | None = None) -> DataFrame:
    """A weight for each clip, summing to one. One level: its rig counts n ** -alpha a clip. Two levels: data sets share N ** (1 - beta), rigs n ** (1 - alpha) of it, clips evenly."""
    rig = Window.partitionBy("dataset", "rig")
    out = clips.withColumn("_n", F.count(F.lit(1)).over(rig))
    if beta is None:
        total = clips.groupBy("dataset", "rig").agg(F.count(F.lit(1)).alias("_m")).agg(F.sum(F.pow("_m", F.lit(1 - alpha))).alias("_t"))
        return out.join(F.broadcast(total), F.lit(True)).withColumn("weight", F.pow("_n", F.lit(-alpha)) / F.col("_t")).drop("_n", "_t")
    per_rig = out.groupBy("dataset", "rig").agg(F.count(F.lit(1)).alias("_m"))
    data = per_rig.groupBy("dataset").agg(F.sum("_m").alias("_d"), F.sum(F.pow("_m", F.lit(1 - alpha))).alias("_r")).withColumn("_share", F.pow("_d", F.lit(1 - beta)))
    total = data.agg(F.sum("_share").alias("_t"))
    data = data.join(F.broadcast(total), F.lit(True)).select("dataset", (F.col("_share") / F.col("_t") / F.col("_r")).alias("_u"))
    return out.join(data, "dataset").withColumn("weight", F.col("_u") * F.pow("_n", F.lit(1 - alpha)) / F.col("_n")).drop("_n", "_u")


def weighted_draw(weights: DataFrame, key: str, n: int, seed: int, epoch: int = 0, cells: int = 1024) -> DataFrame:
    """n draws with replacement, the same for a seed and epoch: (draw, key).

    Weights are summed up into intervals of (0, 1); intervals and draws meet
    under equal cells of it, so the join has a key. Rows are ordered inside
    buckets of the key's hash, and only the buckets' sums in one place.
    """
    rows = weights.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(cells)))
    sums = rows.groupBy("_b").agg(F.sum("weight").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inside = F.sum("weight").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.withColumn("_in", inside).join(sums, "_b").withColumn("_to", F.col("_before") + F.col("_in")).withColumn("_from", F.col("_to") - F.col("weight"))
    ends = ends.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * cells).cast("int"), F.least(F.floor(F.col("_to") * cells), F.lit(cells - 1)).cast("int"))))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), seeded_uniform(seed, F.lit(epoch), F.col("id")).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
    return draws.join(ends, "_cell").where((F.col("_u") > F.col("_from")) & (F.col("_u") <= F.col("_to"))).select("draw", key)


def choose_caption(clips: DataFrame, versions: DataFrame, probabilities: dict[str, float], seed: int) -> DataFrame:
    """A caption version for each clip by probability; one that isn't there falls back to the normal one."""
    if sum(probabilities.values()) > 1 + 1e-9:
        raise ValueError("probabilities sum to more than one")
    pick, at = F.lit("normal"), 0.0
    cases = []
    for v, p in probabilities.items():
        at += p
        cases.append((at, v))
    for top, v in reversed(cases):
        pick = F.when(F.col("_u") < top, v).otherwise(pick)
    drawn = clips.withColumn("_u", seeded_uniform(seed, F.col("clip"))).withColumn("version", pick).drop("_u")
    own = versions.select("clip", "version", F.col("text").alias("_own"))
    normal = versions.where("version = 'normal'").select("clip", F.col("text").alias("_normal"))
    out = drawn.join(own, ["clip", "version"], "left").join(normal, "clip", "left")
    return out.withColumn("version", F.when(F.col("_own").isNull(), "normal").otherwise(F.col("version"))).withColumn("text", F.coalesce("_own", "_normal")).drop("_own", "_normal")


def choose_augmentation(clips: DataFrame, operations: list[str], seed: int) -> DataFrame:
    """None or one of the operations, all as likely."""
    ops = F.array(F.lit(None).cast("string"), *(F.lit(o) for o in operations))
    return clips.withColumn("augmentation", F.get(ops, F.floor(seeded_uniform(seed, F.col("clip")) * (len(operations) + 1)).cast("int")))


def weighted_joint_pick(joints: DataFrame, k: int, seed: int) -> DataFrame:
    """k joints of each rig without replacement, a bone of length l as likely as l ** -0.5 (Efraimidis-Spirakis keys)."""
    key = F.log(seeded_uniform(seed, F.col("rig"), F.col("j"))) / F.pow(F.greatest("length", F.lit(FLOOR)), F.lit(-0.5))
    w = Window.partitionBy("rig").orderBy(F.desc("_key"), "j")
    return joints.withColumn("_key", key).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_key", "_k")


def crop(frames: DataFrame, length: int, seed: int) -> DataFrame:
    """A window of `length` frames at a seeded start from each longer clip; shorter clips stay."""
    n = F.max("frame").over(Window.partitionBy("clip")) + 1
    start = F.floor(seeded_uniform(seed, F.col("clip")) * (F.col("_n") - length + 1))
    out = frames.withColumn("_n", n).withColumn("_s", F.when(F.col("_n") > length, start).otherwise(0).cast("int"))
    return out.where((F.col("frame") >= F.col("_s")) & (F.col("frame") < F.col("_s") + length)).withColumn("frame", F.col("frame") - F.col("_s")).drop("_n", "_s")


def pad(frames: DataFrame, length: int, value: str) -> DataFrame:
    """One row a clip: `length` values in frame order, zero past the end, the length before and the mask."""
    rows = frames.where(F.col("frame") < length).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", value))).alias("_v"))
    values = F.transform("_v", lambda x: x[value])
    out = rows.withColumn("length", F.size("_v")).withColumn("values", F.concat(values, F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_v"))))
    return out.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < F.col("length"))).drop("_v")


def test_cases(clips: DataFrame, captions: DataFrame) -> DataFrame:
    """Each rig's distinct captions with the first clip by name."""
    both = clips.select("clip", "rig").join(captions.select("clip", "text"), "clip")
    return both.groupBy("rig", "text").agg(F.min("clip").alias("clip"))


def pick_reference_clip(clips: DataFrame, k: int, seed: int) -> DataFrame:
    """k clips of each rig, again from the first where a rig has fewer: (rig, slot, clip)."""
    w = Window.partitionBy("rig")
    ranked = clips.select("rig", "clip").withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(seeded_order(seed, F.col("clip")))) - 1).where(F.col("_k") < k)
    slots = F.sequence(F.col("_k"), F.lit(k - 1), F.least("_n", F.lit(k)).cast("int"))
    return ranked.select("rig", F.explode(slots).alias("slot"), "clip")


def keep_frames(clips: DataFrame, spec: str) -> DataFrame:
    """clips(clip, n_frames): the frames that a list of signed indices names, clamped, distinct and sorted."""
    wanted = F.transform(F.split(F.lit(spec), ","), lambda s: F.btrim(s).cast("int"))
    at = F.transform(wanted, lambda i: F.least(F.greatest(F.when(i < 0, i + F.col("n_frames")).otherwise(i), F.lit(0)), F.col("n_frames") - 1).cast("int"))
    return clips.select("clip", F.explode(F.array_sort(F.array_distinct(at))).alias("frame"))


def keep_joints(joints: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(name): aliases parted by `|`, upper and lower case alike. (joints that match, names without a match)."""
    names = wanted.select("name", F.explode(F.transform(F.split("name", r"\|"), lambda a: F.lower(F.btrim(a)))).alias("_alias"))
    met = joints.withColumn("_alias", F.lower("label")).join(names, "_alias").drop("_alias")
    return met, wanted.join(met.select("name").distinct(), "name", "left_anti")


def uniform_subsample(frames: DataFrame, k: int) -> DataFrame:
    """k frames of each clip from first to last, at round(i (n - 1) / (k - 1)); all where there are no more."""
    n = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("_n"))
    at = F.when(F.col("_n") <= k, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(k - 1), 0).cast("long")))
    picks = n.select("clip", F.explode(F.array_distinct(at)).alias("frame"))
    return frames.join(picks, ["clip", "frame"], "left_semi")


def export_batches(clips: DataFrame, size: int, order: Column) -> DataFrame:
    """Whole batches of `size` clips in order; the last partial one is left out. Clips are numbered inside hash buckets first, so that one task only sums the buckets."""
    b = clips.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 3))
    per = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = per.agg(F.sum("_c").alias("_t"))
    per = per.withColumn("_before", before).drop("_c")
    out = b.join(per, "_b").join(F.broadcast(total), F.lit(True)).withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_o", "clip")) - 1)
    return out.withColumn("batch", F.expr(f"_k DIV {size}")).where(F.col("batch") < F.expr(f"_t DIV {size}")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), "clip"))).alias("_c")).select("batch", F.transform("_c", lambda x: x["clip"]).alias("clips"))


def _draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first six digits of the seeded order."""
    return F.conv(F.substring(seeded_order(seed, F.concat_ws("/", *keys)), 1, 6), 16, 10).cast("double") / 16777216


def _children(joints: DataFrame) -> DataFrame:
    return joints.where("parent >= 0").groupBy("rig", F.col("parent").alias("j")).agg(F.count(F.lit(1)).alias("_c"))


def aug_leaf_removal(joints: DataFrame, share: float, seed: int) -> DataFrame:
    """joints(rig, j, parent, ...) without a seeded share of each rig's leaves; roots stay."""
    rows = joints.join(_children(joints), ["rig", "j"], "left")
    leaf = F.col("_c").isNull() & (F.col("parent") >= 0)
    return rows.where(~leaf | (_draw(seed, F.col("rig"), F.col("j")) >= share)).select(*joints.columns)


def aug_joint_addition(joints: DataFrame, share: float, seed: int) -> DataFrame:
    """joints(rig, j, parent, ox, oy, oz): a seeded share of bones get a joint in their middle, numbered after the rig's others."""
    n = joints.groupBy("rig").agg((F.max("j") + 1).alias("_n"))
    rows = joints.join(n, "rig").withColumn("_pick", (F.col("parent") >= 0) & (_draw(seed, F.col("rig"), F.col("j")) < share))
    half = [(F.col(a) / F.when(F.col("_pick"), 2).otherwise(1)).alias(a) for a in ("ox", "oy", "oz")]
    own = rows.select("rig", "j", F.when(F.col("_pick"), F.col("_n") + F.col("j")).otherwise(F.col("parent")).alias("parent"), *half)
    return own.union(rows.where("_pick").select("rig", (F.col("_n") + F.col("j")).alias("j"), "parent", *half))


def aug_pooling(joints: DataFrame, depths: DataFrame) -> DataFrame:
    """joints(rig, j, parent, ox, oy, oz), depths(rig, j, depth): joints at odd depths with one child go, which takes over their parent and adds their offset."""
    odd = joints.join(_children(joints).where("_c = 1"), ["rig", "j"]).join(depths.where("depth % 2 = 1"), ["rig", "j"])
    gone = odd.select("rig", F.col("j").alias("parent"), F.col("parent").alias("_up"), *(F.col(a).alias(f"_{a}") for a in ("ox", "oy", "oz")))
    kept = joints.join(odd.select("rig", "j"), ["rig", "j"], "left_anti").join(gone, ["rig", "parent"], "left")
    return kept.select("rig", "j", F.coalesce("_up", "parent").alias("parent"), *((F.col(a) + F.coalesce(f"_{a}", F.lit(0.0))).alias(a) for a in ("ox", "oy", "oz")))


def aug_bone_scale(joints: DataFrame, low: float, high: float, seed: int) -> DataFrame:
    """joints(rig, j, parent, ox, oy, oz) with each bone's offset scaled by a seeded factor; roots keep theirs."""
    k = F.when(F.col("parent") < 0, 1.0).otherwise(low + (high - low) * _draw(seed, F.col("rig"), F.col("j")))
    return joints.select("rig", "j", "parent", *((F.col(a) * k).alias(a) for a in ("ox", "oy", "oz")))
