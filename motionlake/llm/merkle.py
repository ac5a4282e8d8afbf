"""Merkle manifest of a table: a hash tree for each language under one root, with proofs, and versions for tampered leaves.

Leaves are hashed by expressions where their texts are; only hashes are
shuffled. Leaves are numbered in each language, and dealt into aligned blocks of
FANOUT ** LEVELS; a block's levels are built in one task, and its top is a leaf
of the next, smaller round, until each language has one node. The languages'
roots form one more such tree.

The tree is persistent: a block's levels are lists of nodes that are never
changed. A tampered leaf makes a version that copies the nodes on its own path
and shares all others: within its block by the levels below the block's top,
and above it by the path of that top, which the rounds above hand down as one
list of shared siblings a block. The version's root is what `folded_root` says.

Cases: a null field is `-`; a null doc_id comes first and is never tampered
with; rows of a language that share a doc_id are ordered by their leaf, so
repeated rows are leaves of their own; a null text stays null; an empty table
gives an empty table; other columns are neither hashed nor returned, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .ordering import blocks, numbered

FANOUT = 8
#: Levels of the tree that are built in one task.
LEVELS = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(**fields: F.Column) -> F.Column:
    """SHA-256 of a row's fields in their order: `-` for null, else the length in bytes, a colon and the value."""
    shown = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown)), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(leaves: list[str], n: int, most: int) -> list[list[str]]:
    """A block's nodes level by level, from the leaves up: at most `most` levels above them, as far as a tree of n leaves goes."""
    out = [leaves]
    for _ in range(most):
        if n <= 1:
            break
        below = out[-1]
        out.append([_hash(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
        n = -(-n // FANOUT)
    return out


def shared_path(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    """A leaf's siblings by level: those left of its path and those right of it, which all versions share."""
    path = []
    for level in levels[:-1]:
        start = i - i % FANOUT
        path.append((level[start:i], level[i + 1 : start + FANOUT]))
        i //= FANOUT
    return path


def version_root(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The root of the version with another leaf: one copied node a level, between shared ones."""
    for left, right in path:
        leaf = _hash([*left, leaf, *right])
    return leaf


def _packed(path: list[tuple[list[str], list[str]]]) -> str:
    return "|".join(f"{''.join(a)}/{''.join(b)}" for a, b in path)


def _unpacked(path: str) -> list[tuple[list[str], list[str]]]:
    return [([a], [b]) for a, _, b in (level.partition("/") for level in path.split("|"))] if path else []


def _grouped(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _tops(nodes: DataFrame) -> DataFrame:
    """nodes(tree, pos, total, digest): the tops of their blocks, as nodes of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ["tree", "block"]):
            n = block["total"][0].as_py()
            top = levels_of(block["digest"].to_pylist(), n, LEVELS)[-1]
            row = [[block["tree"][0].as_py()], [block["block"][0].as_py()], [max(1, -(-n // FANOUT**LEVELS))], top]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["tree", "pos", "total", "digest"])

    blocked = nodes.select("tree", "pos", "total", "digest", _block().alias("block"))
    return _grouped(blocked).mapInArrow(run, "tree string, pos long, total long, digest string")


def _block() -> F.Column:
    return F.shiftright("pos", (FANOUT**LEVELS).bit_length() - 1)


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with `path`: the siblings from each up to the root, packed. above(tree, pos, path) has those of the blocks' tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ["tree", "block"]):
            # the row of the path above comes first
            upper, rows = _unpacked(block["path"][0].as_py()), block.slice(1)
            levels = levels_of(rows["digest"].to_pylist(), rows["total"][0].as_py(), LEVELS)
            paths = [_packed(shared_path(levels, i) + upper) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("tree", "pos")), pa.array(paths, pa.string())], names=["tree", "pos", "path"])

    return _grouped(_with_above(nodes, above)).mapInArrow(run, "tree string, pos long, path string")


def _with_above(nodes: DataFrame, above: DataFrame) -> DataFrame:
    blocked = nodes.withColumn("block", _block()).withColumn("path", F.lit(None).cast("string"))
    return blocked.unionByName(above.select("tree", F.lit(-1).cast("long").alias("pos"), F.col("pos").alias("block"), "path"), allowMissingColumns=True)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The given nodes and those of each further round; the last has one a tree."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(staged(_tops(out[-1]), "merkle-tops"))
    return out


def _all_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, path) of the tops of the first round's blocks, from `above`, that of the roots."""
    for nodes in reversed(rounds[1:]):
        above = staged(_paths(nodes, above), "merkle-paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf_hash(**fields | {"text": F.translate("text", UPPER, UPPER.lower())})
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), leaf_hash(**fields).alias("digest"), F.when(tampered & F.col("text").isNotNull(), changed).alias("other"))
    leaves = leaves.withColumn("doc_id", F.col("doc_id").cast("long"))
    leaves = staged(numbered(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], "merkle-leaves"), "merkle-numbers")
    rounds = _rounds(leaves)
    subroots = rounds[-1].select("tree", "digest") if len(rounds) > 1 else leaves.select("tree", "digest")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    tops = staged(numbered(tops, ["tree"], [F.col("lang").asc_nulls_first()], "merkle-subroots"), "merkle-languages")
    upper = _rounds(tops)
    end = upper[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.lit("").alias("path"))
    above = _all_paths(upper, end)
    if len(upper) > 1:
        above = staged(_paths(tops, above), "merkle-paths")
    above = above.select(F.col("pos").alias("_pos"), "path")
    root = upper[-1].select("tree", F.col("digest").alias("root"))
    ends = tops.join(above, F.col("pos") == F.col("_pos")).join(root, "tree")
    ends = staged(ends.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "merkle-ends")
    inner = _all_paths(rounds, ends.select("tree", "pos", "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ["tree", "block"]):
            upper_path, rows = _unpacked(block["path"][0].as_py()), block.slice(1)
            digests, others = rows["digest"].to_pylist(), rows["other"].to_pylist()
            levels = levels_of(digests, rows["total"][0].as_py(), LEVELS)
            proofs, folded = [], []
            for i, (own, other) in enumerate(zip(digests, others, strict=True)):
                path = shared_path(levels, i) + upper_path
                proofs.append(_hash([x for left, right in path for x in (*left, *right)]))
                folded.append(version_root(other or own, path))
            columns = [rows[c].combine_chunks() for c in ("tree", "doc_id", "digest")] + [pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

    out = _grouped(_with_above(leaves, inner)).mapInArrow(run, "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string")
    known = ends.select(F.col("tree").alias("_tree"), "subroot", "root")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return out.join(known, F.col("tree").eqNullSafe(F.col("_tree"))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: CRC-32 of an id's decimal digits, bit by bit; the polynomial is a fixed value.
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))"

SQL = rf"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text IS NOT NULL AND xor({_CRC.format(x="doc_id")}, 4294967295) % 3 = 0 AS tampered,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low FROM documents),
l AS (SELECT doc_id, lang, sha256(head || body) AS leaf, CASE WHEN tampered THEN sha256(head || low) ELSE sha256(head || body) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT 0 AS lv, lang, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lv + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lv, lang, n, pos // 8),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lv, pos, n, h FROM s
  UNION ALL
  SELECT lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lv, n, pos // 8),
steps AS (
  SELECT p.lang, p.pos, t.lv, string_agg(CASE WHEN t.pos < p.pos // CAST(8 ** t.lv AS BIGINT) THEN t.h END, '' ORDER BY t.pos) AS a, string_agg(CASE WHEN t.pos > p.pos // CAST(8 ** t.lv AS BIGINT) THEN t.h END, '' ORDER BY t.pos) AS b
  FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.pos // 8 = p.pos // CAST(8 ** t.lv AS BIGINT) // 8 GROUP BY p.lang, p.pos, t.lv),
tops AS (
  SELECT s.lang, 1000 + u.lv AS lv, string_agg(CASE WHEN u.pos < s.pos // CAST(8 ** u.lv AS BIGINT) THEN u.h END, '' ORDER BY u.pos) AS a, string_agg(CASE WHEN u.pos > s.pos // CAST(8 ** u.lv AS BIGINT) THEN u.h END, '' ORDER BY u.pos) AS b
  FROM s JOIN u ON u.n > 1 AND u.pos // 8 = s.pos // CAST(8 ** u.lv AS BIGINT) // 8 GROUP BY s.lang, u.lv),
path AS (
  SELECT lang, pos, coalesce(a, '') AS a, coalesce(b, '') AS b, row_number() OVER (PARTITION BY lang, pos ORDER BY lv) AS k
  FROM (SELECT * FROM steps UNION ALL SELECT p.lang, p.pos, tops.lv, a, b FROM p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang)),
fold AS (
  SELECT lang, pos, 0 AS k, other AS h FROM p
  UNION ALL
  SELECT fold.lang, fold.pos, path.k, sha256(path.a || fold.h || path.b) FROM fold JOIN path ON path.lang IS NOT DISTINCT FROM fold.lang AND path.pos = fold.pos AND path.k = fold.k + 1),
last AS (SELECT lang, pos, arg_max(h, k) AS h FROM fold GROUP BY lang, pos),
proof AS (SELECT lang, pos, sha256(string_agg(a || b, '' ORDER BY k)) AS h FROM path GROUP BY lang, pos)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof.h, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = r.h AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT h FROM u WHERE n = 1) r ON true JOIN last ON last.lang IS NOT DISTINCT FROM p.lang AND last.pos = p.pos
LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM p.lang AND proof.pos = p.pos
"""
