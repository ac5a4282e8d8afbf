"""SimHash near-duplicates, with candidates found by pigeonring filtering.

Fingerprints have 64 bits in a ring of four 16-bit segments. If two differ in
at most k = 3 bits, some segment starts a chain in which every l consecutive
segments differ in at most l * k / 4 bits: 0, then 1, then 2. So the pair meets
under a 32-bit key of that segment and the next one, with at most one bit of
the next flipped. One side of the search lists its keys as they are, the other
with each flip; a bucket keeps chains within the third budget and then checks
all 64 bits. Distinct fingerprints only are compared, and a bucket returns the
links of a spanning forest, never all its pairs.

Cases: a null doc_id is no component's smallest unless all of its are null, and
comes first where one row of each is kept; null or blank text has no words and the fingerprint 0, linked like any
other; fewer words than a shingle are one shingle; repeated rows share a
fingerprint; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rest_of, small_batches, staged, table, whole
from .components import components

SEGMENTS = 4
BITS = 16
MAX_DIFFERENCE = 3
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Stands for a null doc_id, which comes first, where one row of each component is kept.
NO_ID = -(1 << 63)
#: Rows of a bucket that are compared with as many others at once; fingerprints from which a key is dealt out again.
BLOCK = 2048
LARGE = 2048
#: Rows up to which a bucket is compared side by side with others.
SMALL = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 values (seed 42) have it."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: as many components, at most one link a node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    out = np.array(kept, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _chained(x: np.ndarray, ring: np.ndarray, limit: int) -> np.ndarray:
    """Of differences x of pairs that met at segment `ring`: those whose chains stay within budget, up to the whole ring."""
    turned = np.where(ring == 0, x, (x >> (ring * BITS).astype(np.uint64)) | (x << ((64 - ring * BITS) % 64).astype(np.uint64)))
    keep = np.ones(len(x), bool)
    for length in range(1, SEGMENTS):
        part = turned & np.uint64((1 << (BITS * length)) - 1)
        keep &= np.bitwise_count(part) <= length * limit // SEGMENTS
    return keep & (np.bitwise_count(x) <= limit)


def _bucket_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, ring, exact, fp) sorted by (ring, key): links between exact rows and all rows of a bucket. A bucket that spans batches is carried on."""
    left: list[np.ndarray] = []

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ring, key, exact, fp = rows
        if not len(fp):
            return
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ring[1:] != ring[:-1]))))
        size = np.diff(np.concatenate((new, [len(fp)])))
        bases = np.add.reduceat(exact.astype(np.int64), new)
        found_a, found_b = [], []
        # small buckets side by side: each row with the next, the one after it, and so on, as far as a bucket goes
        same = (key[1:] == key[:-1]) & (ring[1:] == ring[:-1])
        i, d = np.flatnonzero(same & np.repeat((bases > 0) & (size <= SMALL), size)[:-1]), 1
        while len(i):
            j = i + d
            some = exact[i] | exact[j]
            apart = (fp[i] ^ fp[j]).view(np.uint64)
            some &= apart != 0
            p, q = i[some], j[some]
            ok = _chained(apart[some], ring[p] % SEGMENTS, limit)
            found_a.append(fp[p[ok]])
            found_b.append(fp[q[ok]])
            d += 1
            i = i[i + d < len(fp)]
            i = i[(key[i] == key[i + d]) & (ring[i] == ring[i + d])]
        for g in np.flatnonzero((bases > 0) & (size > SMALL)).tolist():
            s, e = new[g], new[g] + size[g]
            every = fp[s:e]
            base = every[exact[s:e]]
            for i in range(0, len(base), BLOCK):
                for j in range(0, len(every), BLOCK):
                    x, y = np.meshgrid(base[i : i + BLOCK], every[j : j + BLOCK], indexing="ij")
                    x, y = x.ravel(), y.ravel()
                    apart = (x ^ y).view(np.uint64)
                    ok = (apart != 0) & _chained(apart, np.full(len(x), ring[s] % SEGMENTS), limit)
                    if ok.any():
                        p, q = _forest(x[ok], y[ok])
                        found_a.append(p)
                        found_b.append(q)
        if found_a:
            p, q = _forest(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()]
        rows = [np.concatenate((x, y)) for x, y in zip(left, rows, strict=True)] if left else rows
        ring, key = rows[0], rows[1]
        last = int(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ring[1:] != ring[:-1]))))[-1]) if len(key) else 0
        yield from links([x[:last] for x in rows])
        left = [x[last:] for x in rows]
    if left:
        yield from links(left)


def links(distinct: DataFrame, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """Links (a, b) between fingerprints of distinct(fp) at `limit` or fewer differing bits: enough of them to connect what is connected."""
    if limit >= SEGMENTS:
        raise ValueError("the chains' budgets are laid out for fewer differences than segments")
    ring = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))
    turned = distinct.select("fp", ring.alias("ring")).select(
        "fp", "ring", F.expr(f"(shiftrightunsigned(fp, ring * {BITS}) | CASE WHEN ring = 0 THEN 0L ELSE shiftleft(fp, 64 - ring * {BITS}) END) & 4294967295L").alias("key")
    )
    flips = F.explode(F.sequence(F.lit(BITS - 1), F.lit(2 * BITS - 1)))
    rows = turned.select("fp", "ring", "key", flips.alias("bit")).select(
        "ring", F.expr(f"CASE WHEN bit < {BITS} THEN key ELSE key ^ shiftleft(1L, bit) END").alias("key"), (F.col("bit") < BITS).alias("exact"), "fp"
    )
    # counted without flips: one row a key and task at most, and of few keys; written, so that Spark knows the size
    large = turned.groupBy("ring", "key").count().where(F.col("count") > LARGE).select(F.col("ring").alias("_ring"), F.col("key").alias("_key"))
    large = staged(large, "large-keys")
    if not large.isEmpty():
        known = rows.join(large, (F.col("ring") == F.col("_ring")) & (F.col("key") == F.col("_key")), "left")
        rest = F.expr(f"shiftrightunsigned((shiftrightunsigned(fp, ring * {BITS}) | CASE WHEN ring = 0 THEN 0L ELSE shiftleft(fp, 64 - ring * {BITS}) END), 32)")
        again = F.explode(F.when(F.col("_key").isNull(), F.array(F.lit(-1))).otherwise(F.array(*(F.lit(k) for k in range(4)))))
        rows = known.select("ring", "key", "exact", "fp", again.alias("byte")).withColumn("rest", rest)
        part = F.when(F.col("byte") < 0, F.lit(0).cast("long")).otherwise((F.col("byte") + 1) * 256 + F.expr("shiftrightunsigned(rest, greatest(byte, 0) * 8) & 255L"))
        # the part joins the ring's number, which the buckets only tell apart
        rows = rows.select((F.col("ring") + part * SEGMENTS).cast("int").alias("ring"), "key", "exact", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "ring", "key").sortWithinPartitions("ring", "key")
    return dealt.mapInArrow(lambda batches: _bucket_links(batches, limit), "a long, b long")


def classes(prints: DataFrame, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """prints(doc_id, fp), written: fp, its component's root fingerprint and component_id, for the fingerprints that several rows have or that are linked; other rows are alone."""
    first = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    roots = components(links(first.select("fp"), limit))
    # roots are listed under others only, but belong to their components too
    roots = roots.union(roots.select("root", "root").distinct())
    linked = staged(first.join(roots, first["fp"] == roots["node"]).select("fp", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = first.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    found = linked.join(least, "root").select("fp", "root", "component_id").union(alone)
    return staged(found.withColumnRenamed("fp", "_fp"), "classes")


def near_duplicates(docs: DataFrame, width: int = 3, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for each row of docs. The classes are written before they are joined, so that they are broadcast if small, and otherwise Spark splits what many rows share."""
    prints = staged(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width), "fingerprints")
    found = classes(prints, limit)
    out = prints.join(found, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 3, limit: int = MAX_DIFFERENCE) -> DataFrame:
    """One row of each component, one with the smallest doc_id, with all columns. Of rows with that id, one whose text has the smallest XXH64."""
    code = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), code.alias("code"), rest_of(docs, "text").alias("row"), "text")
    # by text, so that rows that share an id keep their fingerprints
    prints = staged(fingerprints(own.select(F.col("code").alias("doc_id"), "text"), width).distinct().withColumnRenamed("doc_id", "code"), "fingerprints")
    places = staged(own.select("id", "code").join(prints, "code"), "places")
    found = classes(places.select(F.col("id").alias("doc_id"), "fp"), limit)
    best = places.join(found, F.col("fp") == F.col("_fp"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct("id", "code")).alias("k"))
    kept = staged(best.select(F.col("k.id").alias("_id"), F.col("k.code").alias("_code")), "kept")
    return one_of_each(own.join(kept, (F.col("id") == F.col("_id")) & (F.col("code") == F.col("_code")), "left_semi"), docs.columns)


def one_of_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows(id, code, row, text): one row for each (id, code). Only what repeats is shuffled with its text."""
    repeated = staged(rows.groupBy("id", "code").count().where("count > 1").select(F.col("id").alias("_id"), F.col("code").alias("_code")), "repeated-rows")
    alike = (F.col("id") == F.col("_id")) & (F.col("code") == F.col("_code"))
    single = rows.join(repeated, alike, "left_anti")
    again = rows.join(repeated, alike, "left_semi").dropDuplicates(["id", "code"])
    return single.union(again).select(*whole(columns, "text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
