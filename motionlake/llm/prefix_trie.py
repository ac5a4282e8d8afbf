"""Trie of conversation prefixes, with sums over subtrees by centroid decomposition.

A conversation is rebuilt from the beginning of the one that its hundred starts
with, and its own turns. Turns are numbered by range sorting, which splits
conversations of any length. A prefix is named by 128 bits: the exclusive or of
its turns' hashes, each taken with its depth, which adds up over chunks of a
long conversation.

Sums over subtrees come from centroid decomposition of the parent-edge forest.
In a component of s nodes those that have more than s / 2 nodes below them form
a chain from its top; its deepest node is the centroid. What the component has
in the centroid's subtree is added up and added to every node of the chain; the
centroid leaves, each of its children is the top of a component of its own, and
the rest stays one. Each round at least halves every component. Large components
are split by joins and aggregates with partial sums; those of at most BLOCK
nodes are finished in one task each. How many nodes a subtree has to begin with
follows from the prefixes: of the conversations that begin with it, each counts
the nodes that it is the smallest member of.

Cases: null turn numbers come first, equal ones are ordered by the hash of role
and text; null role or text is empty; rows without conv_id belong to no
conversation; negative ids are rounded towards zero to find the start of their
hundred; an empty table has no root and gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table
from .ordering import blocks, numbered

HUNDRED = 100
SHARES = 6
#: Nodes up to which a component is finished in one task; turns of a conversation that are scanned in one.
BLOCK = 16384
CHUNK = 4096
#: Ids that are joined into one string before a node's are brought together.
IDS = 1000


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lengths, turns): conv_id and length of each rebuilt conversation; and conv_id, depth (from 1), length, code and chars of its turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    own = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"), F.char_length(text).alias("chars"))
    turns = staged(numbered(own, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("code")], "turns"), "numbered-turns").drop("turn")
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES
    first = turns.where("pos = 0").select("conv_id", F.col("total").alias("n"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"), kept.alias("h"))
    bases = first.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = first.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    shared = staged(shared.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    tails = turns.where(F.col("pos") >= kept).join(shared, "conv_id").withColumn("depth", F.col("m") + F.col("pos") - F.col("h") + 1)
    heads = shared.join(turns.where(F.col("pos") < SHARES).withColumnRenamed("conv_id", "base"), "base").where("pos < m").withColumn("depth", F.col("pos") + 1)
    columns = ("conv_id", "depth", "length", "code", "chars")
    return shared.select("conv_id", "length"), tails.select(*columns).unionByName(heads.select(*columns))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, ends, (x, y) that name the prefix, (px, py) its parent's and chars of its last turn, for each conversation's prefixes from the empty one on."""
    lengths, turns = rebuilt(conversations)
    parts = {"x": F.xxhash64("depth", "code"), "y": F.xxhash64("code", "depth")}
    rows = turns.select("conv_id", "depth", "length", "chars", F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"), *(c.alias(f"_{k}") for k, c in parts.items()))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    rows = rows.withColumns({k: F.bit_xor(f"_{k}").over(so_far) for k in parts})
    chunks = rows.where(f"length > {CHUNK}").groupBy("conv_id", "chunk").agg(*(F.bit_xor(f"_{k}").alias(f"_{k}") for k in parts))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(chunks.select("conv_id", "chunk", *(F.bit_xor(f"_{k}").over(before).alias(f"{k}0") for k in parts)), "prefix-offsets")
    rows = rows.join(offsets, ["conv_id", "chunk"], "left")
    for k in parts:
        rows = rows.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(f"{k}0", F.lit(0))))
    rows = rows.select("conv_id", "depth", (F.col("depth") == F.col("length")).alias("ends"), "x", "y", *(F.col(k).bitwiseXOR(F.col(f"_{k}")).alias(f"p{k}") for k in parts), "chars")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), (F.col("length") == 0).alias("ends"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), F.lit(0).alias("chars"))
    return rows.unionByName(roots)


def decomposed(parents: list[int], weights: list[tuple[int, ...]]) -> list[list[int]]:
    """Sums over the subtrees of a tree whose nodes come after their parents (-1: the top), by centroid decomposition."""
    n, width = len(parents), len(weights[0])
    out = [[0] * width for _ in range(n)]
    home = [0] * n
    stack, label = [list(range(n))], 0
    while stack:
        nodes = stack.pop()
        label += 1
        for v in nodes:
            home[v] = label
        size = dict.fromkeys(nodes, 1)
        for v in reversed(nodes):
            p = parents[v]
            if p >= 0 and home[p] == label:
                size[p] += size[v]
        chain = [v for v in nodes if 2 * size[v] > len(nodes)]
        centroid = chain[-1]
        # which child's subtree a node is in; the centroid's own mark is itself
        child, below, rest = {centroid: centroid}, {}, []
        sums = list(weights[centroid])
        for v in nodes:
            if v == centroid:
                continue
            up = child.get(parents[v])
            if up is None:
                rest.append(v)
                continue
            child[v] = v if up == centroid else up
            below.setdefault(child[v], []).append(v)
            for k, w in enumerate(weights[v]):
                sums[k] += w
        for v in chain:
            for k in range(width):
                out[v][k] += sums[k]
        stack.extend(below.values())
        if rest:
            stack.append(rest)
    return out


def _finish(rows: DataFrame, weights: list[str]) -> DataFrame:
    """rows(comp, id, parent, depth, weights, sums of weights) of components of at most BLOCK nodes: id and sums."""
    sums = [f"sum_{w}" for w in weights]
    schema = ", ".join(["id long", *(f"{s} long" for s in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for comp in blocks(batches, ["comp"]):
            ids = comp["id"].to_pylist()
            place = {v: i for i, v in enumerate(ids)}
            own = decomposed([place.get(p, -1) for p in comp["parent"].to_pylist()], list(zip(*(comp[w].to_pylist() for w in weights), strict=True)))
            so_far = zip(*(comp[s].to_pylist() for s in sums), strict=True)
            total = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(own, so_far, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([t[k] for t in total], pa.int64()) for k in range(len(sums)))], names=["id", *sums])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("comp", "id", "parent", "depth", *weights, *sums).repartition(parts, "comp").sortWithinPartitions("comp", "depth")
    return dealt.mapInArrow(run, schema)


def subtree_sums(forest: DataFrame, paths: DataFrame, weights: list[str], block: int = BLOCK) -> DataFrame:
    """id and sum_<weight> over each node's subtree, itself included.

    forest: id, parent (null: a top), conv_id (a conversation through the node),
    depth, size (nodes of its subtree), weights. paths: conv_id, depth and id of
    the node that each conversation has at each depth.
    """
    sums = [f"sum_{w}" for w in weights]
    zero = F.lit(0).cast("long")
    tops = paths.where("depth = 0").select("conv_id", F.col("id").alias("comp"))
    state = staged(forest.join(tops, "conv_id").withColumns(dict.fromkeys(sums, zero)), "components")
    finished = []
    while True:
        totals = staged(state.groupBy("comp").agg(F.max("size").alias("s")).where(F.col("s") > block), "large-components")
        if totals.isEmpty():
            break
        finished.append(_finish(state.join(totals, "comp", "left_anti"), weights))
        large = state.join(totals, "comp")
        on_chain = 2 * F.col("size") > F.col("s")
        chain = large.where(on_chain).groupBy("comp", "s").agg(F.max_by(F.struct("id", "depth", "size"), "depth").alias("c"))
        chain = staged(chain.select("comp", "s", F.col("c.id").alias("c_id"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "centroids")
        nodes = state.join(chain, "comp")
        # each conversation's nodes at the centroid's depth and below it say whose subtree its nodes are in
        asked = nodes.where("depth >= c_depth").select("comp", "conv_id", "c_depth").distinct()
        asked = asked.select("comp", "conv_id", "c_depth", F.explode(F.array(F.col("c_depth"), F.col("c_depth") + 1)).alias("depth"))
        met = asked.join(paths.withColumnRenamed("id", "at"), ["conv_id", "depth"])
        met = met.groupBy("comp", "conv_id").agg(F.max(F.when(F.col("depth") == F.col("c_depth"), F.col("at"))).alias("above"), F.max(F.when(F.col("depth") > F.col("c_depth"), F.col("at"))).alias("child"))
        nodes = staged(nodes.join(met, ["comp", "conv_id"], "left").withColumn("below", (F.col("depth") >= F.col("c_depth")) & F.coalesce(F.col("above") == F.col("c_id"), F.lit(False))), "split-components")
        added = staged(nodes.where("below").groupBy("comp").agg(*(F.sum(w).alias(f"add_{w}") for w in weights)), "component-sums")
        nodes = nodes.join(added, "comp").withColumns({s: F.col(s) + F.when(on_chain, F.col(f"add_{w}")).otherwise(0) for s, w in zip(sums, weights, strict=True)})
        is_centroid = F.col("id") == F.col("c_id")
        finished.append(staged(nodes.where(is_centroid).select("id", *sums), "centroid-sums"))
        left = nodes.where(~is_centroid).withColumn("comp", F.when(F.col("below"), F.col("child")).otherwise(F.col("comp")))
        left = left.withColumn("size", F.when(on_chain, F.col("size") - F.col("c_size")).otherwise(F.col("size")))
        state = staged(left.select(*state.columns), "components")
    finished.append(_finish(state, weights))
    out = finished[0]
    for df in finished[1:]:
        out = out.unionByName(df)
    return out


def ends_hash(ends: DataFrame) -> DataFrame:
    """ends(id, conv_id) to id and ends_sha256, of the ids in order, joined by commas; a node's ids are joined piece by piece."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            pieces = [(k, min(k + IDS, b)) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True) for k in range(a, b, IDS)]
            if pieces:
                text = [",".join(map(str, convs[a:b])) for a, b in pieces]
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pieces], pa.int64()), pa.array([convs[a] for a, _ in pieces], pa.int64()), pa.array(text, pa.string())], names=["id", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != now:
                    done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            done = [x for x in done if x[0] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["id", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.select("id", "conv_id").repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(joined, "id long, first long, ids string")
    return pieces.repartition(parts, "id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = staged(prefixes(conversations), "prefixes")
    nodes = rows.groupBy("x", "y").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("px").alias("px"), F.max("py").alias("py"), F.max("chars").alias("chars"))
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("x", "y", "id", F.col("conv_id").alias("least"))
    paths = staged(rows.select("conv_id", "depth", "ends", "x", "y").join(named, ["x", "y"]).drop("x", "y"), "paths")
    owned = paths.where("least = conv_id").groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("last"))
    size = paths.join(owned, "conv_id").groupBy("id").agg(F.sum(F.col("last") - F.greatest("depth", "top") + 1).alias("size"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("px IS NOT NULL").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    forest = nodes.join(children, ["x", "y"], "left").join(parents, ["px", "py"], "left").join(size, "id")
    n = F.coalesce("n_children", F.lit(0))
    forest = forest.select("id", "parent", "conv_id", "parent_conv_id", "depth", "size", "n_convs", n.alias("n_children"), F.when(n == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    forest = staged(forest, "forest")
    sums = subtree_sums(forest.select("id", "parent", "conv_id", "depth", "size", "leaf", "saved"), paths.select("conv_id", "depth", "id"), ["leaf", "saved"], block)
    out = forest.join(sums, "id").join(ends_hash(paths.where("ends")), "id", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an id's decimal digits, bit by bit; the polynomial is a fixed value.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"

SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS p FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM o GROUP BY conv_id),
s AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT s.conv_id, p AS d, code, text FROM s JOIN o ON o.conv_id = s.base AND p <= m UNION ALL SELECT s.conv_id, m + p - h, code, text FROM s JOIN o ON o.conv_id = s.conv_id WHERE p > h),
k AS (SELECT conv_id, d, text, string_agg(code, ',') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r UNION ALL SELECT conv_id, 0, '', '' FROM s),
e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS n FROM k) WHERE d = n GROUP BY key),
v AS (SELECT key, d, substr(key, 1, greatest(33 * (d - 1) - 1, 0)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(text)) AS chars FROM k GROUP BY key, d),
kids AS (SELECT parent AS key, count(*) AS n FROM v WHERE d > 0 GROUP BY parent),
w AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN kids ON kids.key = v.key),
a AS (SELECT *, unnest(range(0, d + 1)) AS up FROM w),
b AS (SELECT substr(key, 1, greatest(33 * up - 1, 0)) AS key, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM a GROUP BY 1)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM w JOIN b ON b.key = w.key LEFT JOIN e ON e.key = w.key LEFT JOIN v q ON w.d > 0 AND q.key = w.parent
"""
