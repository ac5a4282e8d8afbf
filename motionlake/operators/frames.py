"""Frame-ordered operators, clip windows and quality gates.

Clips are told apart by `clip`; windows partition by clip (and joint), never by
rig or data set, so a rig that has most clips is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_frame() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("frame")


AXES = ("px", "py", "pz")


def joint_step(positions: DataFrame) -> DataFrame:
    """Adds step: each joint's displacement since the previous frame, null on a clip's first."""
    w = Window.partitionBy("clip", "j").orderBy("frame")
    return positions.withColumn("step", F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in AXES[1:]), F.pow(F.col(AXES[0]) - F.lag(AXES[0]).over(w), 2))))


def trim_static_ends(positions: DataFrame, threshold: float = 1e-5) -> DataFrame:
    """Frames from the first active one to the one after the last; stillness in between stays. A frame is active if a joint moves by more than the threshold to the next.

    A clip that is static throughout has no frames left; one of a single frame stays as it is.
    """
    moved = joint_step(positions).groupBy("clip", "frame").agg(F.max("step").alias("most"))
    active = F.col("most") > threshold
    ends = moved.groupBy("clip").agg(F.min(F.when(active, F.col("frame") - 1)).alias("_a"), F.max(F.when(active, F.col("frame"))).alias("_b"), F.max("frame").alias("_last"), F.min("frame").alias("_first"))
    keep = F.col("frame").between(F.col("_a"), F.col("_b")) | (F.col("_first") == F.col("_last"))
    return positions.join(ends, "clip").where(keep).select(*positions.columns)


def head_trim(frames: DataFrame, trims: DataFrame) -> DataFrame:
    """trims(clip, n): the first n frames go and the rest count from zero; a clip of n frames or fewer goes entirely."""
    t = trims.select("clip", F.col("n").alias("_n"))
    return frames.join(t, "clip", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where("frame >= _n").withColumn("frame", F.col("frame") - F.col("_n")).drop("_n")


def downsample_halving(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """clips(clip, fps, n_frames): every second frame goes and fps is halved until it is under 60 or one frame is left. Adds out_fps."""
    k = F.greatest(F.lit(0), F.ceil(F.log2((F.col("fps") + 1) / F.lit(60.0))))
    k = F.least(k, F.ceil(F.log2(F.col("n_frames").cast("double")))).cast("int")
    steps = clips.select("clip", k.alias("_k"), F.shiftright(F.lit(1 << 30), 30).alias("_one"), "fps").withColumn("_m", F.expr("shiftleft(1, _k)")).withColumn("out_fps", F.expr("shiftright(fps, _k)"))
    return frames.join(steps.select("clip", "_m", "out_fps"), "clip").where("frame % _m = 0").withColumn("frame", F.expr("CAST(frame DIV _m AS INT)")).drop("_m")


def nearest_valid_fill(frames: DataFrame, value: str) -> DataFrame:
    """Frames without a value take that of the nearest frame which has one, the earlier of two as near; a clip without any keeps nulls."""
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(value).alias("v")))
    before = F.last(pair, True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(pair, True).over(by_frame().rowsBetween(0, Window.unboundedFollowing))
    out = frames.withColumn("_b", before).withColumn("_a", after)
    filled = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (F.col("frame") - F.col("_b.f") <= F.col("_a.f") - F.col("frame")), F.col("_b.v")).otherwise(F.col("_a.v"))
    return out.withColumn(value, filled).drop("_a", "_b")


def integrate_root(frames: DataFrame) -> DataFrame:
    """frames(clip, frame, vx, vz, angle): the root's path. Each step is the previous frame's velocity turned back by this frame's facing; adds x and z."""
    vx, vz = F.coalesce(F.lag("vx").over(by_frame()), F.lit(0.0)), F.coalesce(F.lag("vz").over(by_frame()), F.lit(0.0))
    c, s = F.cos("angle"), F.sin("angle")
    step = frames.withColumn("_dx", vx * c + vz * s).withColumn("_dz", vz * c - vx * s)
    w = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("x", F.sum("_dx").over(w)).withColumn("z", F.sum("_dz").over(w)).drop("_dx", "_dz")


def runs(frames: DataFrame, mask: Column, min_len: int = 4) -> DataFrame:
    """clip, start, end (exclusive) of the longest runs of frames where the mask holds."""
    hit = frames.where(mask).withColumn("_g", F.col("frame") - F.row_number().over(by_frame()))
    return hit.groupBy("clip", "_g").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).where(F.col("end") - F.col("start") >= min_len).drop("_g")


def stance_windows(soles: DataFrame, height: float, speed: float, min_len: int = 4) -> DataFrame:
    """soles(clip, frame, h, v, leg_length): runs where the three-frame means of height and speed, ends repeated, stay under their shares of the leg's length."""
    def mean(c: str) -> Column:
        return (F.coalesce(F.lag(c).over(by_frame()), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(by_frame()), F.col(c))) / 3

    smooth = soles.withColumn("_h", mean("h")).withColumn("_v", mean("v"))
    return runs(smooth, (F.col("_h") <= F.col("leg_length") * height) & (F.col("_v") <= F.col("leg_length") * speed), min_len)


def contact_metrics(planted: DataFrame) -> DataFrame:
    """planted(clip, run, frame, x, z, error): per run of two frames or more the median and largest step, the largest anchor error and frames without one."""
    w = Window.partitionBy("clip", "run").orderBy("frame")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("z") - F.lag("z").over(w), 2))
    out = planted.withColumn("_s", step).groupBy("clip", "run").agg(
        F.count(F.lit(1)).alias("n"), F.expr("percentile(_s, 0.5)").alias("median_step"), F.max("_s").alias("max_step"), F.max("error").alias("max_error"), F.count_if(F.col("error").isNull()).alias("unresolved")
    )
    return out.where("n >= 2")


def validate_timeline(prompts: DataFrame) -> DataFrame:
    """prompts(timeline, ord, prompt, start, end): (timeline, reason) for each rule that is broken."""
    w = Window.partitionBy("timeline").orderBy("ord")
    rows = prompts.withColumn("_prev", F.lag("end").over(w))
    per = rows.groupBy("timeline").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(~(F.col("end") - F.col("start")).between(2, 600)).alias("length"), F.bool_or(F.col("start") != F.coalesce("_prev", "start")).alias("gap"),
        F.bool_or(F.btrim(F.coalesce("prompt", F.lit(""))) == "").alias("blank"), (F.max("end") - F.min("start")).alias("total"),
    )
    found = F.array_compact(F.array(F.when(F.col("n") > 32, "more than 32 clips"), F.when(F.col("length"), "a clip's length"), F.when(F.col("gap"), "clips apart or out of order"), F.when(F.col("blank"), "blank prompt"), F.when(F.col("total") > 10_000, "too long")))
    return per.select("timeline", F.explode(found).alias("reason"))


def plan_windows(prompts: DataFrame, window: int, overlap: int) -> DataFrame:
    """prompts(timeline, ord, start, end): each prompt's number of generation windows; the first has a whole window for a head, others a step."""
    step = window - overlap
    first = F.row_number().over(Window.partitionBy("timeline").orderBy("ord")) == 1
    head = F.when(first, window).otherwise(step)
    return prompts.withColumn("windows", F.greatest(F.lit(1), 1 + F.bround((F.col("end") - F.col("start") - head) / step, 0)).cast("int"))


def edit_window_count(frames: Column, window: int, step: int) -> Column:
    return (1 + F.greatest(F.lit(0), F.ceil((frames - window) / F.lit(step)))).cast("int")


def clip_windows(clips: DataFrame, length: int, stride: int) -> DataFrame:
    """clips(clip, n_frames) to one row a window: segment, start, end.

    A clip of `length` or fewer is one window. Else whole windows start every
    `stride`; a tail of max(1, length - stride) or more is a window of its own; a
    shorter one moves the last window to the end, if the window before still
    covers what that gives up; else the tail is left out.
    """
    t, overlap = F.col("n_frames"), max(1, length - stride)
    k = F.floor((t - length) / F.lit(stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), k), lambda i: (i * stride).cast("int"))
    covered = k * stride + length
    tail = t - covered
    own = F.struct((k * stride + stride).cast("int").alias("start"), t.cast("int").alias("end"))
    whole = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + length).cast("int").alias("end")))
    tail_from = k * stride + stride
    slid = F.concat(F.slice(whole, 1, k), F.array(F.struct((t - length).cast("int").alias("start"), t.cast("int").alias("end"))))
    can_slide = (k >= 1) & ((k - 1) * stride + length >= t - length)
    many = F.when((tail > 0) & (t - tail_from >= overlap), F.concat(whole, F.array(own))).when((tail > 0) & can_slide, slid).otherwise(whole)
    windows = F.when(t <= length, F.array(F.struct(F.lit(0).alias("start"), t.cast("int").alias("end")))).otherwise(many)
    return clips.select(*clips.columns, F.posexplode(windows).alias("segment", "_w")).select(*clips.columns, "segment", "_w.start", "_w.end")


def clip_key(clip: Column, segment: Column) -> Column:
    return F.format_string("%s-%03d", clip, segment)


def slice_frames(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Each frame once for every window that covers it, counted from the window's start. The clip is the join's key, so no nested loop."""
    w = windows.select("clip", "segment", "start", "end")
    out = frames.join(w, "clip").where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end")))
    return out.withColumn("frame", F.col("frame") - F.col("start")).withColumn("clip", clip_key(F.col("clip"), F.col("segment"))).drop("start", "end", "segment")


def select_clips(clips: DataFrame, skip_clips: DataFrame, skip_rigs: DataFrame) -> DataFrame:
    return clips.join(skip_clips, "clip", "left_anti").join(skip_rigs, "rig", "left_anti")


def joint_count_gate(rigs: DataFrame, least: int = 8, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """(rigs within the limits, rejects with a reason)."""
    ok = F.col("n_joints").between(least, most)
    reason = F.when(F.col("n_joints") < least, "too few joints").otherwise("too many joints")
    return rigs.where(ok), rigs.where(~ok).select("rig", reason.alias("reason"))


def activity_metrics(positions: DataFrame) -> DataFrame:
    """Per clip: the root's spread over time, and the mean and top-k mean of the other joints', taken relative to the root.

    A joint's spread is the norm of the axes' population deviations; k is a quarter of the joints, two at least.
    """
    root = positions.where("j = 0").select("clip", "frame", *(F.col(a).alias(f"_{a}") for a in AXES))
    rel = positions.join(root, ["clip", "frame"])
    own = [F.when(F.col("j") == 0, F.col(a)).otherwise(F.col(a) - F.col(f"_{a}")) for a in AXES]
    per = rel.groupBy("clip", "j").agg(F.sqrt(sum((F.pow(F.stddev_pop(x), 2) for x in own[1:]), F.pow(F.stddev_pop(own[0]), 2))).alias("spread"))
    w = Window.partitionBy("clip")
    ranked = per.where("j > 0").withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("spread"), "j")))
    most = F.least(F.greatest(F.lit(2), F.bround(F.col("_n") / 4, 0)), F.col("_n"))
    others = ranked.groupBy("clip").agg(F.avg("spread").alias("mean"), F.avg(F.when(F.col("_k") <= most, F.col("spread"))).alias("top"))
    return per.where("j = 0").select("clip", F.col("spread").alias("root")).join(others, "clip", "left")


def low_activity_gate(metrics: DataFrame, keep: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(clip, reason) of clips whose root and top joints hardly move; listed clips are exempt."""
    still = (F.coalesce("top", F.lit(0.0)) < threshold) & (F.col("root") < threshold)
    return metrics.where(still).join(keep, "clip", "left_anti").select("clip", F.lit("low activity").alias("reason"))


def discontinuity_metrics(positions: DataFrame) -> DataFrame:
    """Per clip: median and largest of the frames' mean joint step over the clip's largest extent, their ratio, steps that stand out, and whether all input is finite."""
    finite = sum((F.coalesce(F.col(a) - F.col(a) == 0, F.lit(False)).cast("int") for a in AXES[1:]), F.coalesce(F.col(AXES[0]) - F.col(AXES[0]) == 0, F.lit(False)).cast("int")) == 3
    box = positions.groupBy("clip").agg(F.greatest(*(F.max(a) - F.min(a) for a in AXES)).alias("extent"), F.bool_and(finite).alias("finite"))
    steps = joint_step(positions).groupBy("clip", "frame").agg(F.avg("step").alias("step")).where("step IS NOT NULL").join(box, "clip").withColumn("step", F.col("step") / F.greatest("extent", F.lit(1e-9)))
    mid = steps.groupBy("clip").agg(F.expr("percentile(step, 0.5)").alias("median"), F.max("step").alias("max"))
    odd = steps.join(mid.select("clip", F.greatest(F.col("median") * 6, F.lit(0.05)).alias("_t")), "clip").groupBy("clip").agg(F.count_if(F.col("step") > F.col("_t")).alias("n_jumps"))
    ratio = F.when(F.col("median") <= 1e-9, F.lit(float("inf"))).otherwise(F.col("max") / F.col("median"))
    return box.join(mid, "clip", "left").join(odd, "clip", "left").withColumn("ratio", ratio)


def discontinuity_gate(metrics: DataFrame, step: float = 0.2, ratio: float = 8.0) -> DataFrame:
    """(clip, reason): input that isn't finite always; jumps unless the step threshold is off."""
    jump = (F.lit(step) > 0) & (F.col("max") >= step) & (F.col("ratio") >= ratio)
    reason = F.when(~F.col("finite"), "not finite").when(jump, "discontinuity")
    return metrics.select("clip", reason.alias("reason")).where("reason IS NOT NULL")


def min_frames_gate(frames: DataFrame, least: int = 8) -> DataFrame:
    return frames.groupBy("clip").agg(F.count_distinct("frame").alias("n")).where(F.col("n") < least).select("clip", F.lit("too few frames").alias("reason"))


def remove_rest_frames(frames: DataFrame, angle: str = "angle", least: float = 1.0) -> DataFrame:
    """frames(clip, frame, angle: the largest of the joints' to rest, in degrees): frames at rest go, unless fewer than two would stay."""
    left = F.count_if(F.col(angle) >= least).over(Window.partitionBy("clip"))
    return frames.withColumn("_left", left).where((F.col("_left") < 2) | (F.col(angle) >= least)).drop("_left")


def reject_ledger(stages: dict[str, DataFrame]) -> DataFrame:
    """Every gate's rejects in one table: clip, stage, reason."""
    out = None
    for stage, df in stages.items():
        one = df.select("clip", F.lit(stage).alias("stage"), "reason")
        out = one if out is None else out.unionByName(one)
    return out


def caption_required(clips: DataFrame, captions: DataFrame) -> DataFrame:
    return clips.join(captions.select("clip").distinct(), "clip", "left_semi")


def fps_gate(clips: DataFrame, fps: int = 30) -> DataFrame:
    """(clip, status): a missing rate is taken for the right one with a warning; another is an error."""
    status = F.when(F.col("fps").isNull(), "assumed").when(F.col("fps") != fps, "error")
    return clips.select("clip", status.alias("status")).where("status IS NOT NULL")


def ground_clip(positions: DataFrame) -> DataFrame:
    """Heights counted from the clip's lowest."""
    low = positions.groupBy("clip").agg(F.min("py").alias("_low"))
    return positions.join(low, "clip").withColumn("py", F.col("py") - F.col("_low")).drop("_low")


def root_travel(positions: DataFrame, height: Column, frames: int = 200) -> DataFrame:
    """Per clip: net ground displacement of the root over its first frames, in body heights, to three decimals."""
    root = positions.where((F.col("j") == 0) & (F.col("frame") < frames))
    ends = root.groupBy("clip").agg(F.min_by(F.struct("px", "pz"), "frame").alias("a"), F.max_by(F.struct("px", "pz"), "frame").alias("b"))
    net = F.sqrt(F.pow(F.col("b.px") - F.col("a.px"), 2) + F.pow(F.col("b.pz") - F.col("a.pz"), 2))
    return ends.select("clip", F.bround(net / height, 3).alias("net"))


def truncate_window(clips: DataFrame, length: int) -> DataFrame:
    """clips(clip, n_frames): one window a clip, its first `length` frames."""
    return clips.select(*clips.columns, F.lit(0).alias("segment"), F.lit(0).alias("start"), F.least(F.col("n_frames"), F.lit(length)).cast("int").alias("end"))


def default_stride(longest: int, training: int) -> int:
    """The stride at which every training window lies in some clip; clips must be longer than the window."""
    if longest <= training:
        raise ValueError("clips must be longer than the training window")
    return longest - training


def canonical_place(positions: DataFrame, pairs: DataFrame, scales: DataFrame) -> DataFrame:
    """positions(clip, rig, frame, j, px, py, pz), pairs(rig, right, left), scales(rig or clip, scale): each clip turned so that its first frame faces +Z, with the root above the origin there, scaled.

    A rig without a pair, or whose pair has no lateral extent there, isn't turned; a rig, or clip, without a scale isn't scaled.
    """
    first = positions.groupBy("clip", "rig", "j").agg(F.min_by(F.struct(*AXES), "frame").alias("p"))
    root = first.where("j = 0").select("clip", "rig", F.col("p.px").alias("_rx"), F.col("p.pz").alias("_rz"))
    right = first.select("clip", F.col("j").alias("right"), F.col("p").alias("_r"))
    left = first.select("clip", F.col("j").alias("left"), F.col("p").alias("_l"))
    own = root.join(pairs, "rig", "left").join(right, ["clip", "right"], "left").join(left, ["clip", "left"], "left").join(scales, "clip" if "clip" in scales.columns else "rig", "left")
    # forward is up x lateral
    fx, fz = F.col("_r.pz") - F.col("_l.pz"), F.col("_l.px") - F.col("_r.px")
    norm = F.sqrt(fx * fx + fz * fz)
    turned = norm >= 1e-6
    own = own.select("clip", "_rx", "_rz", F.when(turned, fx / norm).otherwise(0.0).alias("_fx"), F.when(turned, fz / norm).otherwise(1.0).alias("_fz"), F.coalesce("scale", F.lit(1.0)).alias("_k"))
    dx, dz = F.col("px") - F.col("_rx"), F.col("pz") - F.col("_rz")
    placed = {"px": (dx * F.col("_fz") - dz * F.col("_fx")) * F.col("_k"), "py": F.col("py") * F.col("_k"), "pz": (dx * F.col("_fx") + dz * F.col("_fz")) * F.col("_k")}
    return positions.join(own, "clip").select(*(placed[c].alias(c) if c in placed else F.col(c) for c in positions.columns))
