"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the benchmark's windows of ten words (an item of fewer words is
one window). For each pattern length there is a shift table over blocks of up
to three words: the scan jumps ahead by the block's shift, and only where it is
zero looks into the bucket of patterns that end in that block and compares.

Benchmark items are the stated query set; they are broadcast in blocks of about
BLOCK_WORDS words, one pass over the documents each.

Cases: null or wordless texts and items have no words; an item with a null id
counts for hits but isn't listed; repeated items count once; repeated documents
are judged row by row; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rest_of, small_batches, staged, table, whole

WINDOW = 10
BLOCK = 3
BLOCK_WORDS = 400_000
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Patterns:
    """Shift tables and suffix buckets of one block of items, per pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str | None]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(len(w) - window, 0) + 1 if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.tables = []
        for m in sorted({len(p) for p in found}):
            b = min(BLOCK, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], frozenset]]] = {}
            for p, of in found.items():
                if len(p) == m:
                    for j in range(m - b + 1):
                        key, left = p[j : j + b], m - b - j
                        if shift.get(key, m) > left:
                            shift[key] = left
                    buckets.setdefault(p[m - b :], []).append((p, frozenset(of)))
            self.tables.append((m, b, shift, buckets))

    def scan(self, w: list[bytes], hit: bytearray, items: set) -> None:
        """Mark the words of w inside any pattern's occurrence, and gather the items of those patterns."""
        n = len(w)
        for m, b, shift, buckets in self.tables:
            i, default, get = m, m - b + 1, shift.get
            while i <= n:
                key = tuple(w[i - b : i])
                s = get(key, default)
                if s:
                    i += s
                    continue
                window = tuple(w[i - m : i])
                for p, of in buckets[key]:
                    if p == window:
                        hit[i - m : i] = b"\x01" * m
                        items |= of
                i += 1


def _items(bench: DataFrame) -> tuple[DataFrame, int]:
    """The distinct items with the block that each is in, and the number of blocks."""
    bench = bench.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = bench.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    parts = max(1, math.ceil(size / BLOCK_WORDS))
    return bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(parts))), parts


def search(rows: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows(row, text): row, text and hits, whose mask has a byte for each word, 1 where it is hit, and whose items are the sorted ids. One block is on the driver at a time."""
    spark = rows.sparkSession
    small_batches(spark)
    out = rows.select("row", "text", F.lit(None).cast("struct<mask:binary,items:array<string>>").alias("hits"))
    items, parts = _items(bench)
    for k in range(parts):
        shared = spark.sparkContext.broadcast(Patterns([tuple(r) for r in items.where(F.col("block") == k).select("item", "text").collect()], window))
        out = _pass(out, shared)
        if k + 1 < parts:
            out = staged(out, "decontaminate")
            shared.destroy()
    return out


def _pass(df: DataFrame, shared) -> DataFrame:
    kind = pa.struct([("mask", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            rows = []
            for text, before in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                w = words(text.as_py())
                hit, items = (bytearray(before["mask"]), set(before["items"])) if before else (bytearray(len(w)), set())
                patterns.scan(w, hit, items)
                items.discard(None)
                rows.append({"mask": bytes(hit), "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["row", "text", "hits"])

    return df.mapInArrow(run, df.schema)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of each row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(docs.select(F.struct("doc_id").alias("row"), "text"), bench, window)
    n = F.octet_length("hits.mask")
    hit = F.length(F.translate(F.hex("hits.mask"), "0", ""))
    return found.select(
        "row.doc_id",
        n.cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of any item occurs, with all their columns."""
    found = search(docs.select(rest_of(docs, "text").alias("row"), "text"), bench, window)
    return found.where(F.instr(F.hex("hits.mask"), "1") == 0).select(*whole(docs.columns, "text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT doc_id, i, p.m, item FROM g JOIN p ON p.g = g.g AND p.m = g.m),
h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
