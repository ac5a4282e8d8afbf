"""Rows numbered within keys of any size, and sorted rows handed on block by block."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged


def numbered(rows: DataFrame, keys: list[str], order: list[F.Column], name: str) -> DataFrame:
    """rows with pos (from 0, in `order` within the keys, which may be null) and total (rows of the keys).

    Rows are dealt into ranges and sorted there, which splits keys of any size;
    each range's count of a key is then added up, a row a range and key. Equal
    rows are numbered in any order. The sorted rows are written, so that a
    number stays what it was if an executor is lost.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    dealt = staged(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("_range", F.shiftright("_seq", 33))
    counts = dealt.groupBy(*keys, "_range").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(key).alias("total"))
    runs = staged(runs, f"{name}-runs")
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.join(runs, same).select(*rows.columns, (F.col("_seq") + F.col("_shift")).alias("pos"), "total")


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of batches sorted by the keys, a table for each of their values, which must be of bounded size."""
    left: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    left.append(batch.slice(start, i - start))
                if left:
                    yield pa.Table.from_batches(left)
                left, start, last = [], i, value
        left.append(batch.slice(start))
    if left:
        yield pa.Table.from_batches(left)
