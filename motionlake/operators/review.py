"""Facing pairs, learned name maps, curation lists and audits of annotated rigs.

Tables are told apart by rig; every join and window has the rig, or a learned
template or name, as its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox_extent
from ..functions.names import norm_bone_name, raw_side
from ..sources.staging import staged
from .captions import name_keys, unify_roots
from .trees import down, to_rigs, tree_positions

AXES = ("x", "y", "z")


def _side(label: str) -> Column:
    return F.when(F.col(label).startswith("Right "), "right").when(F.col(label).startswith("Left "), "left")


def _bare(label: str) -> Column:
    return F.regexp_replace(label, "^(?:Left|Right) ", "")


def select_face_pair(joints: DataFrame, ranks: DataFrame) -> DataFrame:
    """joints(rig, j, raw, label), ranks(part, rank): per rig the best-ranked part that has a joint on either side, then by name.

    Joints of one part go together by their names' numbers, else by all numbers but the last, else the first of each side.
    """
    rows = joints.select("rig", "j", _side("label").alias("side"), _bare("label").alias("part"), F.regexp_extract_all("raw", F.lit("[0-9]+"), F.lit(0)).alias("d")).where("side IS NOT NULL")
    rows = rows.withColumn("digits", F.array_join("d", ".")).withColumn("short", F.array_join(F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0))), "."))
    # the least of each side by all numbers, by all but the last and by part, so that no two joints are paired that don't come first; dealt out by rig once
    sides = [F.min(F.when(F.col("side") == side, F.col("j"))).alias(side) for side in ("right", "left")]
    least = [F.min(side).alias(side) for side in ("right", "left")]
    pair = F.when(F.col("right").isNotNull() & F.col("left").isNotNull(), F.struct("right", "left"))
    by_digits = rows.repartition("rig").groupBy("rig", "part", "short", "digits").agg(*sides)
    by_short = by_digits.groupBy("rig", "part", "short").agg(F.min(F.when(F.col("digits").isNotNull(), pair)).alias("same"), *least)
    by_part = by_short.groupBy("rig", "part").agg(F.min("same").alias("same"), F.min(F.when(F.col("short").isNotNull(), pair)).alias("like"), *least)
    match = F.when(F.col("same").isNotNull(), 0).when(F.col("like").isNotNull(), 1).otherwise(2)
    both = by_part.where("right IS NOT NULL AND left IS NOT NULL").withColumn("match", match).withColumn("pair", F.coalesce("same", "like", pair)).join(ranks, "part", "left")
    order = F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "part", "match", "pair.right", "pair.left")
    return both.groupBy("rig").agg(F.min(order).alias("best")).select("rig", "best.part", "best.right", "best.left")


def body_axis_pair(joints: DataFrame, heads: str = "Head|Neck|Jaw", tails: str = "Tail|Spine") -> DataFrame:
    """joints(rig, j, label): the last joint of the head and the last of the tail, for rigs that have both."""
    ends = joints.groupBy("rig").agg(F.max(F.when(F.col("label").rlike(heads), F.col("j"))).alias("head"), F.max(F.when(F.col("label").rlike(tails), F.col("j"))).alias("tail"))
    return ends.where("head IS NOT NULL AND tail IS NOT NULL").withColumn("body_axis", F.lit(True))


def patch_face_pairs(pairs: DataFrame, overrides: DataFrame, joints: DataFrame) -> DataFrame:
    """pairs(rig, right, left, source), overrides(rig, right, left): reviewed pairs first, with the labels that both joints have now."""
    o = overrides.select("rig", F.col("right").alias("_r"), F.col("left").alias("_l"))
    out = pairs.join(o, "rig", "left").select("rig", F.coalesce("_r", "right").alias("right"), F.coalesce("_l", "left").alias("left"), F.when(F.col("_r").isNotNull(), "override").otherwise(F.col("source")).alias("source"))
    for side in ("right", "left"):
        out = out.join(joints.select("rig", F.col("j").alias(side), F.col("label").alias(f"{side}_label")), ["rig", side], "left")
    return out.select("rig", "right", "left", "right_label", "left_label", "source")


def validate_face_answers(answers: DataFrame, joints: DataFrame) -> DataFrame:
    """answers(rig, right, left: raw names), joints(rig, raw, label): (rig, reason), null where the answer holds: both names exist, differ and aren't swapped."""
    names = joints.groupBy("rig", "raw").agg(F.min("label").alias("label"))
    out = answers
    for side in ("right", "left"):
        out = out.join(names.select("rig", F.col("raw").alias(side), F.col("label").alias(f"_{side}")), ["rig", side], "left")
    missing = F.col("_right").isNull() | F.col("_left").isNull()
    swapped = F.col("_right").startswith("Left ") & F.col("_left").startswith("Right ")
    return out.select("rig", F.when(missing, "unknown name").when(F.col("right") == F.col("left"), "same joint").when(swapped, "sides swapped").alias("reason"))


def annotation_coverage(pairs: DataFrame, joints: DataFrame, parts: list[str]) -> DataFrame:
    """(kind, name, n): rigs by source of their facing pair, and labels that the vocabulary doesn't have."""
    sources = pairs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("kind"), "name", "n")
    odd = joints.where(~_bare("label").isin(*parts)).groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return sources.unionByName(odd.select(F.lit("label").alias("kind"), "name", "n"))


def curation_lists(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """entries(key, n, line), clips(clip, n_frames): one row a key, the last line's, with a status.

    Unknown clips stay with a warning; a trim must leave frames; keys that repeat are told.
    """
    last = entries.groupBy("key").agg(F.max_by("n", "line").alias("n"), F.count(F.lit(1)).alias("times"))
    out = last.join(clips.select(F.col("clip").alias("key"), "n_frames"), "key", "left")
    status = F.when(F.col("n_frames").isNull(), "unknown").when(F.col("n") >= F.col("n_frames"), "leaves no frames").when(F.col("times") > 1, "repeated").otherwise("ok")
    return out.select("key", "n", status.alias("status"))


def limb_pairs(joints: DataFrame, pairs: DataFrame, tolerance: float = 0.02, cosine: float = 0.5) -> DataFrame:
    """joints(rig, j, parent, label, x, y, z), pairs(rig, right, left, and body_axis if there are such): (rig, part, right, left, conflict) of the mirrored limbs that can be judged.

    A limb is a connected run of joints of one side, named by its first joint's part; it counts if it is the only one of its part and side. Limbs are
    judged by their centres on the ground plane, unless those are nearer than `tolerance` of the rig's largest extent, and conflict if they lie the other
    way round than the pair by more than `cosine`. Head and tail axes and pairs without a distance on the ground judge nothing.
    """
    rows = joints.select("rig", "j", "parent", _side("label").alias("side"), _bare("label").alias("part"), *AXES)
    rigs = to_rigs(rows, ["parent", "side", "part", *AXES])
    heads = down(F.col("joints"), lambda x: F.struct(x["j"].alias("head"), x["side"].alias("side")), lambda up, x: F.struct(F.when(x["side"] == up["side"], up["head"]).otherwise(x["j"]).alias("head"), x["side"].alias("side")))
    members = rigs.withColumn("heads", heads).select("rig", F.explode_outer(F.zip_with("joints", "heads", lambda x, h: F.struct(*(x[c].alias(c) for c in ("j", "side", "part", *AXES)), h["head"].alias("head")))).alias("m")).select("rig", "m.*")
    centres = members.where("side IS NOT NULL").groupBy("rig", "side", "head").agg(F.max(F.when(F.col("j") == F.col("head"), F.col("part"))).alias("part"), F.avg("x").alias("x"), F.avg("z").alias("z"))
    both = centres.groupBy("rig", "part").agg(*(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("right", "left")), *(F.max(F.when(F.col("side") == s, F.struct("head", "x", "z"))).alias(s) for s in ("right", "left")))
    both = both.where("n_right = 1 AND n_left = 1").select("rig", "part", F.col("right.head").alias("right"), F.col("left.head").alias("left"), *((F.col(f"right.{a}") - F.col(f"left.{a}")).alias(f"g{a}") for a in "xz"))
    axis = pairs.where(~F.coalesce("body_axis", F.lit(False))) if "body_axis" in pairs.columns else pairs
    for side in ("right", "left"):
        axis = axis.join(joints.select("rig", F.col("j").alias(side), *(F.col(a).alias(f"{side[0]}{a}") for a in "xz")), ["rig", side])
    axis = axis.select("rig", *((F.col(f"r{a}") - F.col(f"l{a}")).alias(f"a{a}") for a in "xz")).withColumn("across", F.hypot("ax", "az")).where("across >= 1e-8")
    size = joints.groupBy("rig").agg(bbox_extent(list(AXES)).alias("extent"))
    size = size.withColumn("extent", F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0))
    judged = both.join(axis, "rig").join(size, "rig").withColumn("gap", F.hypot("gx", "gz")).where(F.col("gap") >= tolerance * F.col("extent")).where("gap > 0")
    along = (F.col("gx") * F.col("ax") + F.col("gz") * F.col("az")) / F.col("across") / F.col("gap")
    return judged.select("rig", "part", "right", "left", (along < -cosine).alias("conflict"))


def mirror_conflicts(joints: DataFrame, pairs: DataFrame, tolerance: float = 0.02, cosine: float = 0.5) -> DataFrame:
    """(rig, judged, conflicts, flagged) of rigs with limb_pairs: flagged if two or more are judged and most conflict."""
    per = limb_pairs(joints, pairs, tolerance, cosine).groupBy("rig").agg(F.count(F.lit(1)).alias("judged"), F.count_if("conflict").alias("conflicts"))
    return per.withColumn("flagged", (F.col("judged") >= 2) & (F.col("conflicts") * 2 > F.col("judged")))


def face_separation_audit(pairs: DataFrame, rest: DataFrame, first: DataFrame, least: float = 1e-6) -> DataFrame:
    """pairs(rig, right, left), rest and first(rig, j, x, y, z): how far apart a facing pair is at rest and in the first frame, and what is wrong with it."""
    out = pairs
    for name, table in (("rest", rest), ("first", first)):
        for side in ("right", "left"):
            out = out.join(table.select("rig", F.col("j").alias(side), F.struct(*AXES).alias(f"{name}_{side}")), ["rig", side], "left")
        out = out.withColumn(name, F.sqrt(sum((F.pow(F.col(f"{name}_right.{a}") - F.col(f"{name}_left.{a}"), 2) for a in AXES), F.lit(0.0))))
    flag = F.when(F.col("rest").isNull() | F.col("first").isNull(), "unresolved").when((F.col("rest") < least) & (F.col("first") < least), "coincident").when(F.col("rest") < least, "degenerate rest")
    return out.select("rig", "rest", "first", flag.alias("flag"))


def review_flags(joints: DataFrame, parts: list[str], conflicts: DataFrame, weak_pairs: DataFrame, exempt: DataFrame) -> DataFrame:
    """joints(rig, j, label): (rig, j, reasons) of joints to look at. Rigs in `exempt`, labelled by template, are spared the first two reasons."""
    spared = exempt.select("rig", F.lit(True).alias("_spared")).distinct()
    turned = conflicts.where("flagged").select("rig", F.lit(True).alias("_turned"))
    weak = weak_pairs.select("rig", F.lit(True).alias("_weak")).distinct()
    out = joints.join(spared, "rig", "left").join(turned, "rig", "left").join(weak, "rig", "left")
    free = F.col("_spared").isNull()
    reasons = F.array_compact(F.array(
        F.when(free & (F.col("label") == "Bone"), "placeholder"), F.when(free & (F.col("label") != "Bone") & ~_bare("label").isin(*parts), "not in the vocabulary"),
        F.when(F.col("_turned") & F.col("label").rlike("^(?:Left|Right) "), "mirror conflict"), F.when(F.col("_weak") & (F.col("j") == 0), "weak pair"),
    ))
    return out.select("rig", "j", reasons.alias("reasons")).where(F.size("reasons") > 0)


def placed_joints(joints: DataFrame) -> DataFrame:
    """joints(rig, j, parent, name, raw, label): (rig, j, label, position, bone), where in its rig's template each joint is and its name without counters, written once to learn from and to apply to."""
    placed = tree_positions(joints, ("raw", "label"))
    return staged(placed.select("rig", "j", "label", "position", norm_bone_name(F.col("raw")).alias("bone")), "placed-joints")


def learn_name_map(placed: DataFrame, min_purity: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """placed_joints to (position, label: the majority's, null where it is tied) and (bone, label) of names with a label in `min_purity` of their joints."""
    def majority(by: str) -> DataFrame:
        n = placed.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
        # of the labels with the largest count the last and the first by name, which are one unless they are tied
        top = n.groupBy(by).agg(F.max(F.struct("n", "label")).alias("top"), F.min(F.struct(-F.col("n"), "label")).alias("low"), F.sum("n").alias("all"))
        return top.select(by, F.col("top.label").alias("label"), (~F.col("top.label").eqNullSafe(F.col("low.label"))).alias("tied"), (F.col("top.n") / F.col("all")).alias("purity"))

    templates = majority("position").select("position", F.when(~F.col("tied"), F.col("label")).alias("label"))
    # written: broadcast if names are few, and Spark splits the hot ones otherwise
    return templates, staged(majority("bone").where(F.col("purity") >= min_purity).select("bone", "label"), "bone-labels")


def apply_name_map(placed: DataFrame, templates: DataFrame, names: DataFrame, weak: Column) -> DataFrame:
    """Labels of placed_joints by position, else by name in place of weak ones: (rig, j, label, source)."""
    out = placed.withColumn("_weak", weak).join(names.withColumnRenamed("label", "_n"), "bone", "left")
    out = out.join(templates.withColumnRenamed("label", "_t"), "position", "left")
    by_name = F.col("_weak") & F.col("_n").isNotNull()
    label = F.when(F.col("_t").isNotNull(), F.col("_t")).when(by_name, F.col("_n")).otherwise(F.col("label"))
    source = F.when(F.col("_t").isNotNull(), "template").when(by_name, "name").otherwise("own")
    return out.select("rig", "j", label.alias("label"), source.alias("source"))


def capsule_overlap_audit(capsules: DataFrame, pairs: DataFrame) -> DataFrame:
    """capsules(clip, rig, frame, j, ax..az, bx..bz, radius), pairs(rig, a, b), joints far enough apart in the tree: per frame the deepest overlap of two of them, and which.

    The nearest points of two segments by clamping either parameter in turn.
    """
    def one(k: str) -> DataFrame:
        return capsules.select("clip", "rig", "frame", F.col("j").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("ax", "ay", "az", "bx", "by", "bz", "radius")))

    both = one("a").join(pairs, ["rig", "a"]).join(one("b"), ["clip", "rig", "frame", "b"])
    for name, value in NEAREST:
        both = both.withColumn(name, F.expr(value))
    depth = F.col("a_radius") + F.col("b_radius") - F.col("apart")
    return both.where(depth > 0).groupBy("clip", "frame").agg(F.max(F.struct(depth.alias("depth"), "a", "b")).alias("m")).select("clip", "frame", "m.depth", "m.a", "m.b")


def _dot(p: str, q: str) -> str:
    return " + ".join(f"{p}{x} * {q}{x}" for x in AXES)


#: In order: (name, expression in the columns before it). Segments a and b; d: their directions, r: between their starts.
NEAREST = [
    *((f"d1{x}", f"a_b{x} - a_a{x}") for x in AXES), *((f"d2{x}", f"b_b{x} - b_a{x}") for x in AXES), *((f"r{x}", f"a_a{x} - b_a{x}") for x in AXES),
    ("aa", _dot("d1", "d1")), ("ee", _dot("d2", "d2")), ("ff", _dot("d2", "r")), ("cc", _dot("d1", "r")), ("bb", _dot("d1", "d2")),
    ("s0", "CASE WHEN aa * ee - bb * bb > 1e-12 THEN least(greatest((bb * ff - cc * ee) / (aa * ee - bb * bb), 0.0), 1.0) ELSE 0.0 END"),
    ("t0", "CASE WHEN ee > 1e-12 THEN (bb * s0 + ff) / ee ELSE 0.0 END"), ("t", "least(greatest(t0, 0.0), 1.0)"),
    ("s", "CASE WHEN t = t0 OR aa <= 1e-12 THEN s0 ELSE least(greatest((bb * t - cc) / aa, 0.0), 1.0) END"),
    ("apart", "sqrt(" + " + ".join(f"pow(r{x} + d1{x} * s - d2{x} * t, 2)" for x in AXES) + ")"),
]


def clean_joint_names(joints: DataFrame, fixed: DataFrame, tokens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """joints(rig, j, raw, and columns to keep), fixed(bone, label), tokens(key, part): labels by rule, in this order.

    A name in the fixed map, lower-cased and without namespace and counter, takes
    its label; else the part of its longest known key, with the side that its
    words name; else it is a Bone. The tables are data, so families of names are
    rows of them.
    """
    # the rules' keys in one row, so that names are looked up where they are
    known = tokens.where("key IS NOT NULL").groupBy("key").agg(F.min("part").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("key", "part"))).alias("_known"))
    rows = joints.withColumn("bone", norm_bone_name(F.col("raw"))).join(F.broadcast(fixed.withColumnRenamed("label", "_fixed")), "bone", "left").crossJoin(F.broadcast(known))
    parts = F.filter(F.transform(name_keys(F.col("raw")), lambda k: F.element_at("_known", k)), lambda p: p.isNotNull())
    rows = rows.withColumn("_part", F.get(parts, F.lit(0)))
    side = F.coalesce(F.concat(raw_side(F.col("raw")), F.lit(" ")), F.lit(""))
    return rows.select("rig", "j", "raw", *keep, F.coalesce("_fixed", F.concat(side, "_part"), F.lit("Bone")).alias("label"))


def limb_context(joints: DataFrame, under: dict[tuple[str, str], str], above: dict[tuple[str, str], str], same_side: bool = False) -> DataFrame:
    """joints(rig, j, parent, label): parts that a neighbour decides, of either side or, with same_side, of the joint's own. under: (part, its parent's part) to the new part; above: (part, a child's part) to the new part."""
    part, side = _bare("label"), F.regexp_extract("label", "^(?:Left |Right )?", 0)
    rows = joints.withColumn("_p", part).withColumn("_s", side)
    mark = F.col("_s") if same_side else F.lit("")
    up = rows.select("rig", F.col("j").alias("parent"), F.concat(mark, "_p").alias("_up"))
    down = rows.groupBy("rig", F.col("parent").alias("j")).agg(F.collect_set(F.concat(mark, "_p")).alias("_down"))
    out = rows.join(up, ["rig", "parent"], "left").join(down, ["rig", "j"], "left")
    new = F.lit(None).cast("string")
    for (a, b), name in under.items():
        new = F.coalesce(new, F.when((F.col("_p") == a) & (F.col("_up") == F.concat(mark, F.lit(b))), name))
    for (a, b), name in above.items():
        new = F.coalesce(new, F.when((F.col("_p") == a) & F.array_contains("_down", F.concat(mark, F.lit(b))), name))
    return out.withColumn("label", F.when(new.isNotNull(), F.concat("_s", new)).otherwise(F.col("label"))).select(*joints.columns)


def rule_annotation(joints: DataFrame, fixed: DataFrame, tokens: DataFrame, ranks: DataFrame, under: dict[tuple[str, str], str], above: dict[tuple[str, str], str], same_side: bool = False) -> tuple[DataFrame, DataFrame]:
    """joints(rig, j, parent, raw) to (labels, facing pairs): names by rule, limbs by their neighbours, roots made one, then the pair."""
    # written: neighbours' names are looked up by two joins, and the labels are read beside their pairs
    cleaned = staged(clean_joint_names(joints, fixed, tokens, ("parent",)), "clean-names")
    labelled = staged(unify_roots(limb_context(cleaned, under, above, same_side)), "rule-labels")
    return labelled, select_face_pair(labelled, ranks)


def compare_conditions(before: DataFrame, after: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """before and after(rig, j, name, parent_name, x, y, z, w: the real part of a turn, tx, ty, tz): (rig, verdict) of two versions of each rig, joint by joint under its name.

    Other orders of joints and turns of the opposite sign are equivalent; names that are gone, new or repeated, other parents or other values make rigs different.
    """
    values, turn = ("x", "y", "z"), ("w", "tx", "ty", "tz")
    old = before.select("rig", "name", F.struct("j", "parent_name", *values, *turn).alias("a"))
    new = after.select("rig", "name", F.struct("j", "parent_name", *values, *turn).alias("b"))
    repeated = before.groupBy("rig").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names")).select("rig", (F.col("n") != F.col("names")).alias("repeated"))
    both = old.join(new, ["rig", "name"], "full")

    def apart(names: tuple[str, ...], sign: int) -> Column:
        return F.greatest(*(F.abs(F.col(f"a.{v}") - sign * F.col(f"b.{v}")) for v in names))

    same, turned = apart(turn, 1) <= tolerance, apart(turn, -1) <= tolerance
    odd = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a.parent_name").eqNullSafe(F.col("b.parent_name")) | (apart(values, 1) > tolerance) | ~(same | turned)
    per = both.groupBy("rig").agg(F.bool_or(F.coalesce(odd, F.lit(True))).alias("odd"), F.bool_or((F.col("a.j") != F.col("b.j")) | ~same).alias("moved"))
    out = per.join(repeated, "rig", "left")
    return out.select("rig", F.when(F.col("odd") | F.coalesce("repeated", F.lit(True)), "different").when(F.col("moved"), "equivalent").otherwise("identical").alias("verdict"))
