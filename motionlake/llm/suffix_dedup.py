"""Removal of repeated byte strings with suffix arrays, shard by shard.

A byte is removed if a string of `width` (100) bytes that covers it also starts
earlier: in a document with a smaller doc_id, or before in the same document.
Strings never cross documents and are judged on the input.

1. Candidates. Every window of 100 bytes is filed under its minimizer, the
   smallest hash among its 24-byte grams; equal windows have equal minimizers.
   A run of windows with one minimizer is a segment, 176 bytes at most. Within a
   task, and then under each minimizer, byte-identical segments (equal
   minimizer and 64-bit hash) collapse into the earliest: the others' windows
   are repeats. So a passage that a third of all documents share sends one row
   a task.
2. Shards. Minimizers with one segment left are done. The texts of the others'
   segments are dealt out by minimizer into shards of bounded size, where a
   suffix array (Larsson-Sadakane) and Kasai's common prefixes show which
   windows are equal.
3. A minimizer with more segments than a shard holds is split over several
   shards. Their sorted windows are merged by binary search, one range of the
   windows' hashes after another.

Texts are shuffled once, by doc_id; both joins use that exchange.

Every row is judged by its own key (doc_id, and where ids repeat the XXH64 of
the text, which also orders rows of one id), so ranges never meet another row.
A text longer than PIECE is filed piece by piece, with overlaps of a window.

Cases: null text is empty; documents under `width` bytes lose nothing; a null
doc_id comes before all others; of rows with one doc_id and different texts one
comes first, and only the others lose what they share with it; equal rows with
one doc_id are one document, so they don't remove each other; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, table
from .suffix_array import common_prefixes, shard, suffix_array

WIDTH = 100
GRAM = 24
#: Bytes of text whose segments a task collapses at once; rows that a step of a stream takes in.
PIECE = 6 << 20
ROWS = 200_000
#: Segments of one minimizer in a shard, and bytes of text in a shard.
SPLIT = 8192
SHARD = 2 << 20
#: Ranges of hashes in which a task merges windows; it holds one range at a time.
RANGES = 4096
NO_ID = -(1 << 63)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the segments of all texts: minimizer, hash of the bytes, text, first byte in it, windows."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = b"".join(texts)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    h, size = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    factor = 0x100000001B3
    done, part = None, 0
    while True:
        if gram & size:
            if done is None:
                done, part = h, size
            else:
                done, part = done[: n - part - size + 1] * np.uint64(pow(factor, size, 1 << 64)) + h[part : part + n - part - size + 1], part + size
        if size * 2 > gram:
            break
        h = h[:-size] * np.uint64(pow(factor, size, 1 << 64)) + h[size:]
        size *= 2
    h = done ^ (done >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the hash above, the position below: the leftmost of equal hashes is the smallest
    h &= np.uint64(((1 << 40) - 1) << 24)
    h |= np.arange(len(h), dtype=np.uint64) & np.uint64((1 << 24) - 1)
    low = _sliding_minimum(h, width - gram + 1)
    ends = np.cumsum(lengths)
    stop = np.maximum(ends - width + 1, ends - lengths)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, ends - lengths, 1)
    np.add.at(valid, stop, -1)
    at = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    if not len(at):
        return none, none, none, none, none
    m = low[at]
    new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1))))
    count = np.diff(np.concatenate((new, [len(at)])))
    first = at[new]
    of = np.searchsorted(ends, first, side="right")
    digest = xxhash.xxh3_64_intdigest
    code = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)], np.uint64).view(np.int64)
    return (m[new] >> np.uint64(24)).astype(np.int64), code, of, first - (ends - lengths)[of], count


def _joined(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows, adjacent and overlapping ones made one."""
    if not len(doc):
        return doc, row, start, n
    order = np.lexsort((start, row, doc))
    doc, row, start, stop = doc[order], row[order], start[order], (start + n)[order]
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
    # running maximum of the ends within a document
    shift = (np.cumsum(first) - 1) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift) - shift
    new = np.flatnonzero(first | np.concatenate(([True], start[1:] > reach[:-1])))
    return doc[new], row[new], start[new], reach[np.concatenate((new[1:], [len(doc)])) - 1] - start[new]


SEGMENT = "key long, code long, doc long, row long, start long, n long"
#: code of a row of removed windows, whose key only spreads it.
_DONE = {"key": pa.int64(), "code": pa.int64(), "doc": pa.int64(), "row": pa.int64(), "start": pa.int64(), "n": pa.int64(), "kind": pa.int8()}


def _batch(kind: int, key, code, *place) -> pa.RecordBatch:
    """place: doc, row, start and n of each range of windows."""
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (key, code, *place, np.full(len(key), kind, np.int8))], names=list(_DONE))


def _removed(*place) -> pa.RecordBatch:
    doc, _, start, _ = place
    return _batch(REMOVED, (doc * 0x9E3779B1 + start) & ((1 << 40) - 1), np.zeros(len(doc), np.int64), *place)


REMOVED, SEGMENTS, HOT = 0, 1, 2


def _collapse(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """rows: key, code, doc, row, start, n. The earliest of identical segments; the others' windows are removed."""
    order = np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))
    key, code, doc, row, start, n = (v[order] for v in rows)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (code[1:] != code[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (doc == doc[head]) & (row == row[head]) & (start == start[head])
    if first.any():
        yield _batch(SEGMENTS, key[new], code[new], doc[new], row[new], start[new], n[new])
    lost = _joined(*(v[~first] for v in (doc, row, start, n)))
    if len(lost[0]):
        yield _removed(*lost)


def _candidates(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, row) to the segments of each task, collapsed, and the windows removed by that."""
    held: list[tuple[int, int, int, bytes]] = []  # doc, row, where the bytes begin in the text, bytes
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        docs, rows, first, texts = zip(*held, strict=True)
        key, code, of, start, n = segments(list(texts), width)
        if len(key):
            yield from _collapse(key, code, np.array(docs, np.int64)[of], np.array(rows, np.int64)[of], np.array(first, np.int64)[of] + start, n)

    for batch in batches:
        for doc, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            # pieces that have each window of the text once
            for at in range(0, len(raw) - width + 1, PIECE):
                part = raw[at : at + PIECE + width - 1]
                if size and size + len(part) > PIECE:
                    yield from flush()
                    held, size = [], 0
                held.append((doc, row, at, part))
                size += len(part)
    if held:
        yield from flush()


def _buffered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, code, doc, start): repeats of a segment are removed; of the rest, segments whose minimizer has others go on.

    A segment's code becomes its shard's number under the minimizer; a minimizer
    that fills more than one shard is named in a HOT row. One row is held back
    from step to step, so a minimizer may have any number of rows.
    """
    kept: tuple[int, ...] | None = None  # the last segment's key, code, doc, row, start, n, number under its key
    told = False  # whether it has gone on
    for batch in _buffered(batches, ROWS):
        key, code, doc, row, start, n, kind = (batch.column(k).to_numpy() for k in range(7))
        done = kind == REMOVED
        if done.any():
            yield _batch(REMOVED, *(v[done] for v in (key, code, doc, row, start, n)))
        key, code, doc, row, start, n = (v[~done] for v in (key, code, doc, row, start, n))
        if not len(key):
            continue
        if kept is not None:
            key, code, doc, row, start, n = (np.concatenate(([k], v)) for k, v in zip(kept, (key, code, doc, row, start, n), strict=False))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([True], code[1:] != code[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ((doc != doc[head]) | (row != row[head]) | (start != start[head]))
        if later.any():
            yield _removed(*_joined(*(v[later] for v in (doc, row, start, n))))
        at = np.flatnonzero(new)
        same = ~new_key[at]
        begins = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        number = np.arange(len(at)) - begins
        if kept is not None:
            number[begins == 0] += kept[6]
        shared = same | np.concatenate((same[1:], [False]))
        if kept is not None:
            shared[0] = not told and len(same) > 1 and bool(same[1])
        last = at[-1]
        kept = tuple(int(v[last]) for v in (key, code, doc, row, start, n)) + (int(number[-1]),)
        told = bool(shared[-1]) or (len(at) == 1 and told)
        go = at[shared]
        if len(go):
            yield _batch(SEGMENTS, key[go], number[shared] // SPLIT, doc[go], row[go], start[go], n[go])
            hot = go[number[shared] == SPLIT]
            if len(hot):
                yield _batch(HOT, key[hot], np.zeros(len(hot), np.int64), doc[hot], row[hot], start[hot], n[hot])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text, found array) to one row a segment with its bytes."""
    kinds = {"key": pa.int64(), "code": pa.int64(), "hot": pa.bool_(), "doc": pa.int64(), "row": pa.int64(), "start": pa.int64(), "bytes": pa.binary()}
    for batch in batches:
        for doc, row, text, found in zip(*(batch.column(k) for k in range(4)), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            rows = [(f["key"], f["code"], f["hot"], doc.as_py(), row.as_py(), f["start"], raw[f["start"] : f["start"] + f["n"] + width - 1]) for f in found.as_py()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


_WINDOWS = {"spread": pa.int64(), "shard": pa.int64(), "window": pa.binary(), "doc": pa.int64(), "row": pa.int64(), "start": pa.int64(), "n": pa.int64()}


def _windows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _WINDOWS.values(), strict=True)], names=list(_WINDOWS))


def _in_shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, code): the windows that repeat inside a shard; of split minimizers also each window's earliest place."""
    held: list[tuple] = []
    size = 0

    def solve() -> Iterator[pa.RecordBatch]:
        _, code, hot, doc, row, start, texts = zip(*held, strict=True)
        symbols, starts, ends = shard(list(texts))
        sa = suffix_array(symbols, ends)
        lcp = common_prefixes(symbols, starts, ends, sa)
        whole = ends[sa] - sa >= width
        group = np.cumsum(lcp < width)[whole]
        at = sa[whole]
        of = np.searchsorted(starts, at, side="right") - 1
        d, r, s = np.array(doc, np.int64)[of], np.array(row, np.int64)[of], np.array(start, np.int64)[of] + at - starts[of]
        order = np.lexsort((s, r, d, group))
        group, at, of, d, r, s = (v[order] for v in (group, at, of, d, r, s))
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (d != d[head]) | (r != r[head]) | (s != s[head])
        if later.any():
            p, o, q, m = _joined(d[later], r[later], s[later], np.ones(int(later.sum()), np.int64))
            yield _windows(p * 31 + q, np.zeros(len(p), np.int64), [b""] * len(p), p, o, q, m)
        split = np.flatnonzero(new & np.array(hot, bool)[of])
        for k in range(0, len(split), 50_000):
            some = split[k : k + 50_000]
            found = [texts[o][a : a + width] for o, a in zip(of[some].tolist(), (at - starts[of])[some].tolist(), strict=True)]
            digest = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64).view(np.int64)
            yield _windows(digest, np.array(code, np.int64)[of[some]] + 1, found, d[some], r[some], s[some], np.ones(len(some), np.int64))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if held and size >= SHARD and row[:2] != held[-1][:2]:
                yield from solve()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield from solve()


def _merged(of: np.ndarray, windows: np.ndarray, *place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of one range, by shard: each shard's sorted windows are looked up in those seen before, and the later of two equal ones is removed."""
    seen, *first = windows[:0], *(v[:0] for v in place)
    for one in np.unique(of).tolist():
        own = np.flatnonzero(of == one)
        own = own[np.argsort(windows[own], kind="stable")]
        w, now = windows[own], [v[own] for v in place]
        at = np.searchsorted(seen, w)
        met = np.zeros(len(w), bool)
        inside = at < len(seen)
        met[inside] = seen[at[inside]] == w[inside]
        old = at[met]
        (d, r, s), (p, o, q) = ([v[old] for v in first], [v[met] for v in now])
        earlier = (p < d) | (p == d) & ((o < r) | (o == r) & (q < s))
        equal = (p == d) & (o == r) & (q == s)
        lost = [np.where(earlier, x, y)[~equal] for x, y in zip((d, r, s), (p, o, q), strict=True)]
        if len(lost[0]):
            yield _ranges(*_joined(*lost, np.ones(len(lost[0]), np.int64)))
        for v, x in zip(first, (p, o, q), strict=True):
            v[old[earlier]] = x[earlier]
        seen, *first = (np.insert(a, at[~met], b[~met]) for a, b in zip((seen, *first), (w, *now), strict=True))


def _merge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, shard): passes removed windows on (shard 0) and merges the shards' windows, holding one range's at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    last = None
    for batch in _buffered(batches, ROWS):
        spread, of, doc, row, start, n = (batch.column(k).to_numpy() for k in (0, 1, 3, 4, 5, 6))
        done = of == 0
        if done.any():
            yield _ranges(*(v[done] for v in (doc, row, start, n)))
        if done.all():
            continue
        windows = np.array(batch.column(2).filter(pa.array(~done)).to_pylist(), f"S{width}")
        spread, *rest = (v[~done] for v in (spread, of, doc, row, start))
        cuts = np.flatnonzero(np.concatenate(([True], spread[1:] != spread[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and spread[a] != last:
                yield from _merged(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held = []
            last = spread[a]
            held.append((rest[0][a:b], windows[a:b], *(v[a:b] for v in rest[1:])))
    if held:
        yield from _merged(*(np.concatenate(v) for v in zip(*held, strict=True)))


def _ranges(*place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in place], names=["doc", "row", "start", "n"])


def removed_ranges(dealt: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, row, start, n: ranges of window starts that repeat, so bytes start to start + n + width - 1 go. dealt: docs(doc, text, row), partitioned by doc."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(lambda b: _candidates(b, width), f"{SEGMENT}, kind byte").repartition(parts, "key").sortWithinPartitions("key", "code", "doc", "row", "start")
    marks = staged(rows.mapInArrow(_sift, f"{SEGMENT}, kind byte"), "repeats")
    # one row for SPLIT segments at least; written, so that Spark knows the size and broadcasts it only if small
    hot = staged(marks.where(F.col("kind") == HOT).select(F.col("key").alias("_hot")).distinct(), "hot-minimizers")
    open_ = marks.where(F.col("kind") == SEGMENTS).drop("kind")
    open_ = open_.join(hot, open_["key"] == hot["_hot"], "left").select("doc", "row", F.struct("key", "code", F.col("_hot").isNotNull().alias("hot"), "start", "n").alias("f"))
    found = open_.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_own")).agg(F.collect_list("f").alias("found"))
    texts = dealt.join(found, (dealt["doc"] == found["_doc"]) & (dealt["row"] == found["_own"])).select("doc", "row", "text", "found")
    cut = texts.mapInArrow(lambda b: _cut(b, width), "key long, code long, hot boolean, doc long, row long, start long, bytes binary")
    shards = cut.repartition(parts, "key", "code").sortWithinPartitions("key", "code").mapInArrow(lambda b: _in_shards(b, width), "spread long, shard long, window binary, doc long, row long, start long, n long")
    ranges = shards.withColumn("spread", F.pmod("spread", F.lit(RANGES * parts)))
    merged = ranges.repartition(parts, "spread").sortWithinPartitions("spread", "shard").mapInArrow(lambda b: _merge(b, width), "doc long, row long, start long, n long")
    return marks.where(F.col("kind") == REMOVED).select("doc", "row", "start", "n").unionByName(merged)


def _apply(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for a, b in sorted((f["start"], min(f["start"] + f["n"] + width - 1, len(raw))) for f in found or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                elif a < b:
                    spans.append([a, b])
            at, kept = 0, hashlib.sha256()
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"first": a, "last": b} for a, b in spans]))
        if rows:
            n, lost, count, digest, spans = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, or NO_ID), text, and row: 0, or the text's hash where several rows have that doc_id. Finding those reads the ids alone."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    again = staged(own.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("_again")), "repeated-ids")
    if again.isEmpty():
        return own.withColumn("row", F.lit(0).cast("long"))
    row = F.when(F.col("_again").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(again, own["doc"] == again["_again"], "left").select("doc", "text", row.alias("row"))


def suffix_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed bytes, [first, last)) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _keyed(docs)
    dealt = own.repartition(parts, "doc", "row")
    ranges = removed_ranges(dealt, own, width).groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_own")).agg(F.collect_list(F.struct("start", "n")).alias("found"))
    out = dealt.join(ranges, (dealt["doc"] == ranges["_doc"]) & (dealt["row"] == ranges["_own"]), "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "found")
    return out.mapInArrow(lambda b: _apply(b, width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")
