"""Incremental runs: files that have come in since the last run, each once, with Structured Streaming's available-now trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def run_new_files(spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], sink: str, progress: str) -> int:
    """Read the parquet files that `progress` doesn't know yet, transform each batch and append it to `sink`; the number of batches.

    transform sees a batch as a plain DataFrame, so the gates and joins of the
    batch jobs serve unchanged. A batch is written to a folder of its own number,
    so one that is run again after a failure replaces what it had left.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def first_seen(spark: SparkSession, source: str, schema: StructType | str, key: str, time: str, delay: str) -> DataFrame:
    """A stream of each key's first record; records later than the watermark's delay are left out, and their keys' state goes."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
