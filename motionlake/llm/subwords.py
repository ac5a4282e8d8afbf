"""Hashed character n-grams of texts, as numpy arrays over a whole batch of texts.

A batch is one byte string: every text lower-cased, its words parted by single
spaces, texts parted by one space as well. An n-gram may begin or end with the
space at its word's edge, so word beginnings and endings have grams of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
#: Bytes of text for which grams are made at once.
PIECE = 1 << 19
_EDGES = b".,;:!?\"'()[]{}"


class Batch:
    """buf: the bytes; words: start of each word; of: the text of each word; n: texts."""

    def __init__(self, texts: list[str | None]):
        parts = [b" ".join((t or "").lower().encode("utf-8", "surrogatepass").split()) for t in texts]
        self.n = len(parts)
        self.buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, self.n)
        self.starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if self.n else np.zeros(0, np.int64)
        space = self.buf == 0x20
        self.words = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.of = np.searchsorted(self.starts, self.words, side="right") - 1

    def grams(self, buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> Iterator[tuple[int, np.ndarray]]:
        """For each gram size and each piece of the buffer: (first position, the bucket at each position); `buckets` where none starts."""
        for first in range(0, len(self.buf), PIECE):
            part = self.buf[first : first + PIECE + max(sizes) - 1]
            n = min(PIECE, len(self.buf) - first)
            space = (part == 0x20).astype(np.int32)
            inside = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
            h = np.zeros(len(part), np.uint32)
            for size in range(1, max(sizes) + 1):
                m = len(part) - size + 1
                if m <= 0:
                    break
                h = h[:m] * np.uint32(0x01000193) + part[size - 1 : size - 1 + m] + np.uint32(1)
                if size in sizes:
                    k = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
                    ids = ((k >> np.uint32(32 - 25)) % np.uint32(buckets)).astype(np.int32)
                    whole = inside[size - 1 : size - 1 + m] == inside[1 : m + 1]
                    ids[~whole] = buckets
                    yield first, ids[:n]

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.words):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.buf)) - np.repeat(np.concatenate(([0], self.words)), np.diff(np.concatenate(([0], self.words, [len(self.buf)]))))
        powers = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64))
        mixed = (self.buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * powers[place], self.words)

    def word_sums(self, values: np.ndarray, sizes: tuple[int, ...] = GRAMS, learned: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sum over each word's grams of values[bucket], number of its grams, or of those whose value isn't zero); values has a row of zeros at the end."""
        total = np.zeros((len(self.buf), *values.shape[1:]), np.float32)
        count = np.zeros(len(self.buf), np.float32)
        for first, ids in self.grams(len(values) - 1, sizes):
            total[first : first + len(ids)] += values[ids]
            count[first : first + len(ids)] += values[ids] != 0 if learned else ids != len(values) - 1
        at = np.maximum(self.words - 1, 0)
        if not len(at):
            return total[:0], count[:0]
        return np.add.reduceat(total, at), np.add.reduceat(count, at)


def map_texts(docs: DataFrame, columns: list[str], score, schema: str, limit: int = 1 << 20) -> DataFrame:
    """score(list of texts) to a dict of arrays, over batches of about `limit` characters; `columns` of docs are carried along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            lengths = [len(t or "") for t in batch.column(len(columns)).to_pylist()]
            while start < batch.num_rows:
                end, size = start, 0
                while end < batch.num_rows and (end == start or size + lengths[end] <= limit):
                    size += lengths[end]
                    end += 1
                part = batch.slice(start, end - start)
                found = score(part.column(len(columns)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(v) for v in found.values())], names=[*columns, *found])
                start = end

    return docs.select(*columns, "text").mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: F.Column, seed: int, bound: int) -> DataFrame:
    """At most `bound` texts of each label value: labels(doc_id, label), kept where `learn` holds, by seeded hash. The ids are few, so the join broadcasts them."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    # of each label, the rows whose hash falls into a share that has a few more than the bound, and then the first of those
    counts = staged(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    draw = F.xxhash64(F.lit(seed), "doc_id")
    some = known.join(counts, "label").where(F.pmod(draw, F.lit(1 << 30)) * F.col("n") <= F.lit((bound + 8 * bound**0.5 + 8) * (1 << 30)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(draw, "doc_id"))
    ids = staged(some.withColumn("rank", rank).where(F.col("rank") <= bound).select("doc_id", "label"), "label-sample")
    return docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")
