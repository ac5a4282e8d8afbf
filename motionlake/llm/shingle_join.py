"""Near-duplicates at a similarity of 0.8 or more of five-word shingles: SimHash by pigeonring filtering, completed by a prefix-filtered set join.

SimHash fingerprints of the shingles that are linked at three bits (see simhash)
give the closest copies; the shingles themselves then confirm each link. A
similarity of 0.8 is about ten bits of 64, beyond what pigeonring filtering can
select by, so a set join finds the other pairs, and none twice: candidates that
confirmed links connect already are left out.

All pairs at 0.8 or more are linked, none below. A text of n distinct shingles,
in any one order of all shingles, has one of its first n - ceil(0.8 n) + 1 in
common with the like of every text that similar, so pairs meet under those, and
only under the first that they share, whose place bounds what they have in common.
The parities of a text's shingles, of a bit for each of them or more, differ in no
more places than the shingles do, which rules out most other pairs without their
texts; the bytes of both texts' shingles then decide. The order puts shingles that a
bounded sample finds common last, and goes by XXH64 otherwise: it decides how
many pairs are compared, never which are linked.

A group of copies is paired about once a text: before that join, texts meet
under their LOWEST shingles by hash, each with the middle one in size of those it
meets, and from then on texts that are connected aren't paired again. Buckets of
up to SMALL texts then give all their pairs. In larger ones each text is first
compared with the bucket's first and the next, and then only texts that aren't
connected by then; the parities rule out pairs of those inside the bucket, before
there is a row for them.

Cases: a null doc_id comes before all others; null or blank text has one empty
shingle; fewer words than a shingle are one shingle; an empty table gives an
empty table; other columns are carried along. Equal texts are known by their
XXH64 (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, rest_of, small_batches, staged
from .components import components
from .simhash import _LOWER, NO_ID, one_of_each

WIDTH = 5
SMALL = 16
#: Texts in the sample that orders the shingles, and the common shingles it may name.
SAMPLE = 20_000
COMMON = 50_000
BLOCK = 256
#: Texts of a bucket up to which its pairs are made side by side with other buckets'.
ROWS = 64
#: Candidates, one long each, up to which their list is broadcast to pick their texts; a longer one is joined by a shuffle.
LISTED = 2_000_000
#: Longs of a text's parities, powers of two: as many as give each shingle a bit, within these.
MARKS, MOST_MARKS = 8, 128
#: Shingles, lowest by hash, under which groups of copies meet first.
LOWEST = 4
PREFIXES = "node long, n int, hs array<long>, low array<long>, marks array<long>"
SEED = 42


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The distinct runs of `width` words, ASCII-lowered and joined by blanks."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Jaccard similarity of at least 4/5, in whole numbers."""
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _prefixes(batches: Iterator[pa.RecordBatch], common: np.ndarray, weights: np.ndarray, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, n, hs, low, marks): the hashes of the prefix, or of all shingles, in order, the lowest and the parities; repeated nodes of a task only once."""
    seen: set[int] = set()
    for batch in batches:
        nodes, sizes, lists = [], [], ([], [], [])
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node in seen:
                continue
            seen.add(node)
            h = np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text.as_py())], np.uint64).view(np.int64))
            nodes.append(node)
            sizes.append(len(h))
            bits = 64 * min(MOST_MARKS, max(MARKS, 1 << ((len(h) - 1) // 64).bit_length()))
            odd = (np.bincount(h & (bits - 1), minlength=bits) & 1).astype(np.uint8)
            lists[1].append(h[:LOWEST])
            lists[2].append(np.packbits(odd, bitorder="little").view("<i8"))
            if not whole:
                n = len(h)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.lexsort((h, np.where(common[at] == h, weights[at], 0)))]
                h = h[: prefix_length(n)]
            lists[0].append(h)
        if nodes:
            ends = [np.cumsum([0, *map(len, x)]).astype(np.int32) for x in lists]
            listed = [pa.ListArray.from_arrays(pa.array(e), pa.array(np.concatenate(x))) for e, x in zip(ends, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *listed], names=["node", "n", "hs", "low", "marks"])


def _possible(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and places of the first common shingle allow a similarity of 0.8: all that is common is at that place or after it."""
    most = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * most >= 4 * (n[i] + n[j]))


def _apart(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places the parities of rows i and j differ; the longer ones are folded to the others' length, which keeps them parities."""
    out, least = np.zeros(len(i), np.int64), np.minimum(size[i], size[j])
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        for part in np.array_split(at, 1 + len(at) * width // (1 << 18)):
            differ = np.zeros((len(part), width), np.uint64)
            for row in (i[part], j[part]):
                for k in range(int(size[row].max(initial=0)) // width):
                    own = np.flatnonzero(size[row] > k * width)
                    differ[own] ^= flat[(start[row[own]] + k * width)[:, None] + np.arange(width)]
            out[part] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return out


def _of_rows(lists: pa.ListArray) -> np.ndarray:
    """An array of the rows' arrays of unsigned longs."""
    ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy().view(np.uint64)
    out = np.empty(len(lists), object)
    for k in range(len(out)):
        out[k] = flat[ends[k] : ends[k + 1]]
    return out


def _bucket_pairs(batches: Iterator[pa.RecordBatch], how: str) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, n, pos, root) sorted by h, n and node to candidate pairs (a < b) of unlike roots; a null root is the node. `middle`: each node with
    its bucket's middle one. `some`: all pairs of a small bucket, of a large one pairs with its first node and of neighbours, and itself as (h, null).
    `rest`: all pairs that are likely by the rows' sixth column, the parities. A bucket that spans batches is carried on."""
    few = {"middle": 1, "some": SMALL, "rest": ROWS}[how]

    def batch_of(a: list[np.ndarray], b: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        left = pa.array(np.concatenate((pairs[:, 0], np.array(keys, np.int64))))
        right = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(keys), pa.int64())])
        if len(left):
            yield pa.RecordBatch.from_arrays([left, right], names=["a", "b"])

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, node = rows[:2]
        if not len(h):
            return
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node, n, pos, root, *marks = (x[once] for x in rows)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        if marks:
            longs = np.fromiter(map(len, marks[0]), np.int64, len(marks[0]))
            flat, start = np.concatenate(marks[0]), np.cumsum(longs) - longs
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((new, [len(h)])))
        a, b, keys, held = [], [], [], 0

        def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = _possible(n, pos, i, j) & (root[i] != root[j])
            i, j = i[ok], j[ok]
            if not marks:
                return i, j
            ok = 9 * _apart(flat, start, longs, i, j) <= n[i] + n[j]
            return i[ok], j[ok]

        # buckets of few texts side by side: each row with the next, the one after it, and so on, as far as a bucket goes
        i, d = np.flatnonzero((h[1:] == h[:-1]) & (np.repeat(size, size) <= few)[:-1]), 1
        while len(i):
            x, y = fit(i, i + d)
            a.append(node[x])
            b.append(node[y])
            d += 1
            i = i[i + d < len(h)]
            i = i[h[i] == h[i + d]]
        for g in np.flatnonzero(size > few).tolist():
            s, m = int(new[g]), int(size[g])
            if (root[s : s + m] == root[s]).all():
                continue
            if how != "rest":
                i, j = np.full(m, s + m // 2 if how == "middle" else s), np.arange(s, s + m)
                if how == "some":
                    # chains of neighbours connect what the first doesn't reach
                    i, j = np.concatenate((i, j[:-1])), np.concatenate((j, j[1:]))
                    keys.append(int(h[s]))
                i, j = fit(i, j)
                a.append(node[i])
                b.append(node[j])
                held += len(i)
            else:
                for p in range(s, s + m, BLOCK):
                    for q in range(p, s + m, BLOCK):
                        if 4 * n[q] > 5 * n[min(p + BLOCK, s + m) - 1]:
                            break
                        i, j = (v.ravel() for v in np.meshgrid(np.arange(p, min(p + BLOCK, s + m)), np.arange(q, min(q + BLOCK, s + m)), indexing="ij"))
                        if p == q:
                            i, j = i[i < j], j[i < j]
                        i, j = fit(i, j)
                        a.append(node[i])
                        b.append(node[j])
                        held += len(i)
            if held > 1 << 18:
                yield from batch_of(a, b, keys)
                a, b, keys, held = [], [], [], 0
        yield from batch_of(a, b, keys)

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    # parts of the last bucket so far, put together once it ends
    held_back: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in [*batch.columns[:4], pc.coalesce(batch.column(4), batch.column(1))]]
        rows += [_of_rows(c) for c in batch.columns[5:]]
        if held_back and rows[0][-1] == held_back[0][0][0]:
            held_back.append(rows)
            continue
        rows = joined([*held_back, rows])
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from pairs([x[:last] for x in rows])
        held_back = [[x[last:] for x in rows]]
    if held_back:
        yield from pairs(joined(held_back))


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Candidates (a, b) without those whose parities differ in too many places for a similarity of 0.8; marks(node, n, marks)."""
    x, y = (marks.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("marks").alias(f"m{k}")) for k in "ab")
    # candidates' sizes are within a quarter, so the parities of one are at most twice as many, and folded to the other's
    folded = "CASE WHEN size(ma) > size(mb) THEN ma[k + size(mb)] WHEN size(mb) > size(ma) THEN mb[k + size(ma)] ELSE 0L END"
    apart = f"aggregate(sequence(0, least(size(ma), size(mb)) - 1), 0, (s, k) -> s + bit_count(ma[k] ^ mb[k] ^ {folded}))"
    return staged(pairs.join(x, "a").join(y, "b").where(f"9 * ({apart}) <= na + nb").select("a", "b"), "likely")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidates (a, b), those that are similar; texts(node, text) may repeat a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, mine = a, shingles(x.as_py())
                ok.append(similar(mine, shingles(y.as_py())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    nodes = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidate-nodes")
    # a list of numbers whose length is known spares all other texts the shuffle
    wanted = F.broadcast(nodes) if nodes.count() <= LISTED else nodes
    chosen = staged(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
    x, y = chosen.select(F.col("node").alias("a"), F.col("text").alias("x")), chosen.select(F.col("node").alias("b"), F.col("text").alias("y"))
    links = staged(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(chosen, nodes, pairs)
    return links


def _order(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a bounded sample, sorted by hash, and how many of its texts have each."""
    one_of = max(1, texts.count() // SAMPLE)
    none = np.zeros(0, np.int64)
    sample = texts.where(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(one_of)) == 0)
    counted = sample.mapInArrow(lambda b: _prefixes(b, none, none, True), PREFIXES).select(F.explode("hs").alias("h")).groupBy("h").count()
    rows = counted.where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toPandas().sort_values("h")
    return rows["h"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def closest(docs: DataFrame) -> DataFrame:
    """docs(node, text): links (a, b) between similar texts among those whose SimHash fingerprints are linked. Texts with one fingerprint are compared with the first of them."""
    prints = staged(simhash.fingerprints(docs.withColumnRenamed("node", "doc_id"), WIDTH).distinct(), "fingerprints")
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    shared = first.where("n > 1").select(F.col("fp").alias("_fp"), F.col("first").alias("a"))
    stars = prints.join(shared, F.col("fp") == F.col("_fp")).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    near = staged(simhash.links(first.select("fp")).distinct(), "fingerprint-links")
    x, y = first.select(F.col("fp").alias("a"), F.col("first").alias("p")), first.select(F.col("fp").alias("b"), F.col("first").alias("q"))
    return _verified(staged(stars.union(near.join(x, "a").join(y, "b").select("p", "q")), "close"), docs)


def groups(docs: DataFrame) -> DataFrame:
    """docs(node, text): (node, root) for nodes connected to others by similar pairs; root is the smallest of them."""
    small_batches(docs.sparkSession)
    close = closest(docs)
    near = components(close)
    common, weights = _order(docs)
    shared = docs.sparkSession.sparkContext.broadcast((common, weights))
    rows = staged(docs.mapInArrow(lambda b: _prefixes(b, *shared.value), PREFIXES), "prefixes")
    marks = staged(rows.select("node", "n", "marks").dropDuplicates(["node"]), "marks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(rows: DataFrame, roots: DataFrame, how: str) -> DataFrame:
        """Candidates of rows(node, n, hs, and marks for `rest`) by hash, and the large buckets, staged."""
        told = rows.columns[3:]
        opened = rows.join(roots, "node", "left").select(F.posexplode("hs").alias("pos", "h"), "node", "n", "root", *told).select("h", "node", "n", "pos", "root", *told)
        if how == "rest":
            opened = opened.join(large, "h", "left_semi")
        dealt = opened.repartition(parts, "h").sortWithinPartitions("h", "n", "node")
        return staged(dealt.mapInArrow(lambda b: _bucket_pairs(b, how), "a long, b long").distinct(), "candidates")

    def confirmed(found: DataFrame) -> DataFrame:
        likely = _likely(found.where("b IS NOT NULL"), marks)
        discard(found)
        return _verified(likely, docs)

    # by the lowest shingles any two places are possible, so each of them is the first of a list
    lowest = rows.select("node", "n", F.explode("low").alias("h")).select("node", "n", F.array("h").alias("hs"))
    links = close.union(confirmed(pairs(lowest, near, "middle")))
    roots = components(links)
    found = pairs(rows.select("node", "n", "hs"), roots, "some")
    large = staged(found.where("b IS NULL").select(F.col("a").alias("h")), "large-buckets")
    links = links.union(confirmed(found))
    roots = components(links)
    if large.isEmpty():
        discard(rows, marks)
        return roots
    # likely by their buckets' own parities already
    links = links.union(_verified(pairs(rows.select("node", "n", "hs", "marks"), roots, "rest"), docs))
    discard(rows, marks)
    return components(links)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of connected documents, one with the smallest doc_id, with all its columns. Of rows with that id, one whose text has the smallest XXH64."""
    code = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), code.alias("code"), rest_of(docs, "text").alias("row"), "text")
    roots = groups(own.select(F.col("code").alias("node"), "text"))
    first = own.groupBy("code").agg(F.min("id").alias("id"))
    named = first.join(roots, first["code"] == roots["node"], "left").select("id", "code", F.coalesce("root", "code").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct("id", "code")).alias("k"))
    kept = staged(best.select(F.col("k.id").alias("_id"), F.col("k.code").alias("_code")), "kept")
    return one_of_each(own.join(kept, (F.col("id") == F.col("_id")) & (F.col("code") == F.col("_code")), "left_semi"), docs.columns)
