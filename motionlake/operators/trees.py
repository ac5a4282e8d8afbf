"""Joint trees and geometry along them, worked out inside one row a rig: parents come before children, so one pass over the joints does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let, qmul, qrot, qunit, quat, vadd, vec, vnorm


def to_rigs(joints: DataFrame, columns: list[str]) -> DataFrame:
    """joints(rig, j, ...) to one row a rig with an array `joints` of (j, columns) in joint order."""
    return joints.groupBy("rig").agg(F.sort_array(F.collect_list(F.struct("j", *columns))).alias("joints"))


def down(joints: Column, start, step) -> Column:
    """An array with a value for each joint: start(joint) for roots, step(value of the parent, joint) for others."""
    first = F.transform(F.slice(joints, 1, 1), lambda x: start(x))
    rest = F.slice(joints, 2, F.greatest(F.size(joints) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda done, x: F.concat(done, F.array(F.when(x["parent"] < 0, start(x)).otherwise(step(F.get(done, x["parent"]), x)))))


def depths(joints: Column) -> Column:
    return down(joints, lambda x: F.lit(0), lambda up, x: up + 1)


def ancestors(joints: Column) -> Column:
    """For each joint the joints from the root to it."""
    return down(joints, lambda x: F.array(x["j"]), lambda up, x: F.concat(up, F.array(x["j"])))


def edges(joints: DataFrame) -> DataFrame:
    """Both directions of every bone."""
    one = joints.where("parent >= 0 AND parent <> j").select("rig", F.col("j").alias("a"), F.col("parent").alias("b"))
    return one.union(one.select("rig", "b", "a"))


def joint_depths(joints: DataFrame) -> DataFrame:
    rigs = to_rigs(joints, ["parent"]).withColumn("depth", depths(F.col("joints")))
    return rigs.select("rig", F.posexplode("depth").alias("j", "depth"))


def joint_pairs(joints: DataFrame, clamp: int = 5) -> DataFrame:
    """(rig, a, b, relation, distance): self, parent, child, sibling or none, a leaf's own cell is end-effector; steps along the tree, `clamp` at most."""
    rigs = to_rigs(joints, ["parent"]).withColumn("anc", ancestors(F.col("joints"))).withColumn("parents", F.transform("joints", lambda x: x["parent"]))
    one = rigs.select("rig", "anc", "parents", F.posexplode("anc").alias("a", "up_a"))
    both = one.select("rig", "parents", "a", "up_a", F.posexplode("anc").alias("b", "up_b"))
    pa, pb = F.get("parents", F.col("a")), F.get("parents", F.col("b"))
    leaf = ~F.array_contains("parents", F.col("a"))
    relation = F.when(F.col("a") == F.col("b"), F.when(leaf, "end_effector").otherwise("self")).when(pa == F.col("b"), "parent").when(pb == F.col("a"), "child").when(pa == pb, "sibling").otherwise("none")
    distance = F.size("up_a") + F.size("up_b") - 2 * F.size(F.array_intersect("up_a", "up_b"))
    return both.select("rig", "a", "b", relation.alias("relation"), F.least(distance, F.lit(clamp)).alias("distance"))


def descendants(joints: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(rig, j): all joints at or below one of them."""
    rigs = to_rigs(joints, ["parent"]).join(chosen.groupBy("rig").agg(F.collect_set("j").alias("chosen")), "rig").withColumn("anc", ancestors(F.col("joints")))
    return rigs.select("rig", "chosen", F.posexplode("anc").alias("j", "up")).where(F.arrays_overlap("up", "chosen")).select("rig", "j")


def kinematic_chains(joints: DataFrame) -> DataFrame:
    """(rig, chain head, joints of the chain): a joint's child with the highest index goes on with its chain, other children head their own, which begins with the joint that branches."""
    rigs = to_rigs(joints, ["parent"]).select("rig", "joints", chain_heads(F.col("joints")).alias("heads"))
    return rigs.select("rig", F.explode(chains_of("joints", "heads")).alias("c")).select("rig", "c.head", "c.joints")


def chain_heads(joints: Column) -> Column:
    """For each joint the head of the chain that it is on."""
    marked = F.transform(joints, lambda x: F.struct(x["j"].alias("j"), x["parent"].alias("parent"), (x["j"] == F.array_max(F.transform(F.filter(joints, lambda y: y["parent"] == x["parent"]), lambda y: y["j"]))).alias("first")))
    return down(marked, lambda x: x["j"], lambda up, x: F.when(x["first"], up).otherwise(x["j"]))


def chains_of(joints: str, heads: str) -> Column:
    """The rig's chains as (head, joints), from its columns of joints and of their heads."""
    def chain(h: Column) -> Column:
        fork = F.get(joints, h)["parent"]
        members = F.transform(F.filter(joints, lambda x: F.get(heads, x["j"]) == h), lambda x: x["j"])
        return F.struct(h.alias("head"), F.when(fork >= 0, F.concat(F.array(fork), members)).otherwise(members).alias("joints"))

    return F.transform(F.array_distinct(heads), chain)


def longest_path(n: Column, up: str, far: str) -> Column:
    """The longest path between two of n joints, from the rig's columns of ancestors and of distances from the root; null where it is 1e-8 or less."""
    def path(a: Column, b: Column) -> Column:
        meet = F.element_at(F.array_intersect(F.get(up, a), F.get(up, b)), -1)
        return F.get(far, a) + F.get(far, b) - 2 * F.get(far, meet)

    longest = F.array_max(F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.array_max(F.transform(F.sequence(F.lit(0), a), lambda b: path(a, b)))))
    return F.when(longest > 1e-8, longest)


def skeleton_diameter(joints: DataFrame) -> DataFrame:
    """Per rig the longest path of bone lengths between two joints; null where it is 1e-8 or less."""
    rigs = to_rigs(joints, ["parent", "length"]).withColumn("anc", ancestors(F.col("joints"))).withColumn("far", down(F.col("joints"), lambda x: F.lit(0.0), lambda up, x: up + x["length"]))
    return rigs.select("rig", longest_path(F.size("joints"), "anc", "far").alias("diameter"))


def forward_kinematics(rigs: DataFrame) -> DataFrame:
    """rigs(..., joints array of (j, parent, p, q)) gets `world`, an array of (p, q): each joint's place and turn down the tree."""
    def start(x: Column) -> Column:
        return F.struct(x["p"].alias("p"), x["q"].alias("q"))

    def step(up: Column, x: Column) -> Column:
        # bound: a turned place would be worked out again for each of its three numbers
        return let(up, lambda u: let(qrot(u["q"], x["p"]), lambda r: F.struct(vadd(u["p"], r).alias("p"), qmul(u["q"], x["q"]).alias("q"))))

    return rigs.withColumn("world", down(F.col("joints"), start, step))


def rest_consistency(rigs: DataFrame, stated: str = "stated") -> DataFrame:
    """Per rig the largest distance between stated joint places and those that local turns and offsets give."""
    out = forward_kinematics(rigs)
    apart = F.zip_with("world", stated, lambda w, s: vnorm(vec(w["p"]["x"] - s["x"], w["p"]["y"] - s["y"], w["p"]["z"] - s["z"])))
    return out.select("rig", F.array_max(apart).alias("error"))


def signatures(joints: Column) -> Column:
    """For each joint, from the last to the first, (j, parent, sig): SHA-1 of its name and its children's signatures, sorted."""
    def step(done: Column, x: Column) -> Column:
        below = F.sort_array(F.transform(F.filter(done, lambda d: d["parent"] == x["j"]), lambda d: d["sig"]))
        sig = F.sha1(F.concat(x["name"], F.lit("("), F.array_join(below, ","), F.lit(")")))
        return F.concat(done, F.array(F.struct(x["j"].alias("j"), x["parent"].alias("parent"), sig.alias("sig"))))

    return F.aggregate(F.reverse(joints), F.array().cast("array<struct<j:int,parent:int,sig:string>>"), step)


def tree_template_key(joints: DataFrame) -> DataFrame:
    """(rig, template): the root's signature, which names and the places of subtrees decide, whatever the order of siblings; of several roots all."""
    rigs = to_rigs(joints.select("rig", F.col("j").cast("int").alias("j"), F.col("parent").cast("int").alias("parent"), "name"), ["parent", "name"])
    return rigs.select("rig", template_of(F.col("joints")).alias("template"))


def template_of(joints: Column) -> Column:
    """The signatures of a rig's roots."""
    return F.array_join(F.array_sort(F.transform(F.filter(signatures(joints), lambda d: d["parent"] < 0), lambda d: d["sig"])), ",")


def tree_positions(joints: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rig, j, keep, template, position): a joint's position is the rig's template and the signatures from its root to it, which siblings with like subtrees share."""
    rigs = to_rigs(joints.select("rig", F.col("j").cast("int").alias("j"), F.col("parent").cast("int").alias("parent"), "name", *keep), ["parent", "name", *keep])
    # joints come in their order, signatures from the last to the first
    signed = rigs.select("rig", "joints", F.reverse(signatures(F.col("joints"))).alias("signed"))
    placed = signed.withColumn("path", down(F.col("signed"), lambda x: x["sig"], lambda up, x: F.concat(up, F.lit("/"), x["sig"])))
    roots = F.sort_array(F.transform(F.filter("signed", lambda d: d["parent"] < 0), lambda d: d["sig"]))
    rows = placed.select("rig", F.array_join(roots, ",").alias("template"), F.explode(F.arrays_zip("joints", "path")).alias("p"))
    return rows.select("rig", *(F.col(f"p.joints.{c}").alias(c) for c in ("j", *keep)), "template", F.sha1(F.concat("template", F.lit("/"), "p.path")).alias("position"))


def bfs_reorder(joints: DataFrame) -> DataFrame:
    """joints(rig, j, parent, length): (rig, j, new, new_parent), breadth-first; among siblings larger subtrees first, then shorter bones."""
    rigs = to_rigs(joints, ["parent", "length"]).withColumn("anc", ancestors(F.col("joints")))
    rows = rigs.select("rig", F.explode(F.arrays_zip("joints", "anc")).alias("x")).select("rig", "x.joints.*", "x.anc")
    size = rows.select("rig", F.explode("anc").alias("j")).groupBy("rig", "j").agg(F.count(F.lit(1)).alias("size"))
    ranked = rows.join(size, ["rig", "j"]).withColumn("place", F.row_number().over(Window.partitionBy("rig", "parent").orderBy(F.desc("size"), "length", "j")))
    places = ranked.groupBy("rig").agg(F.map_from_entries(F.collect_list(F.struct("j", "place"))).alias("places"))
    path = ranked.join(places, "rig").withColumn("path", F.transform("anc", lambda a: F.col("places")[a]))
    out = path.select("rig", "j", "parent", (F.row_number().over(Window.partitionBy("rig").orderBy(F.size("anc"), "path")) - 1).alias("new"))
    up = out.select("rig", F.col("j").alias("parent"), F.col("new").alias("new_parent"))
    return out.join(up, ["rig", "parent"], "left").select("rig", "j", "new", F.coalesce("new_parent", F.lit(-1)).alias("new_parent"))


def topology_condition(joints: DataFrame) -> DataFrame:
    """joints(rig, j, parent, name, length): one row a rig with the joints in order (parent, name, depth), its template, diameter and chains."""
    return condition_of(to_rigs(joints.withColumns({c: F.col(c).cast("int") for c in ("j", "parent")}), ["parent", "name", "length"])).drop("anc")


def condition_of(rigs: DataFrame) -> DataFrame:
    """rigs(rig, joints array of (j, parent, name, length)): the columns of topology_condition and anc, each joint's ancestors; everything is worked out inside the rig's row."""
    x = F.col("joints")
    far = down(x, lambda j: F.lit(0.0), lambda up, j: up + j["length"])
    rows = rigs.withColumns({"n_joints": F.size(x), "depth": depths(x), "anc": ancestors(x), "far": far, "heads": chain_heads(x)})
    told = F.transform(F.arrays_zip("joints", "depth"), lambda j: F.struct(j["joints"]["parent"].alias("parent"), j["joints"]["name"].alias("name"), j["depth"].alias("depth")))
    chains = F.array_sort(F.transform(chains_of("joints", "heads"), lambda c: c["joints"]))
    out = rows.select("rig", "n_joints", told.alias("told"), template_of(x).alias("template"), longest_path(F.col("n_joints"), "anc", "far").alias("diameter"), chains.alias("chains"), "anc")
    return out.withColumnRenamed("told", "joints")


def local_pose(ox: str, oy: str, oz: str) -> list[Column]:
    """A joint's offset as p, and a small turn about it as q."""
    q = qunit(quat(F.lit(1.0), F.col(ox) * 0.1, F.col(oy) * 0.1, F.col(oz) * 0.1))
    return [vec(F.col(ox), F.col(oy), F.col(oz)).alias("p"), q.alias("q")]
