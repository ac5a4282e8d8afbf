"""Incremental runs take each file once."""

from motionlake.operators.frames import joint_count_gate
from motionlake.streaming.incremental import first_seen, run_new_files
from pyspark.sql import functions as F


def test_new_files_once(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "rig string, n_joints int"
    spark.createDataFrame([("a", 20), ("b", 3)], schema).write.parquet(f"{source}/1")
    files = f"{source}/*"
    assert run_new_files(spark, files, schema, lambda df: joint_count_gate(df)[0], sink, progress) == 1
    spark.createDataFrame([("c", 30)], schema).write.parquet(f"{source}/2")
    run_new_files(spark, files, schema, lambda df: joint_count_gate(df)[0], sink, progress)
    run_new_files(spark, files, schema, lambda df: joint_count_gate(df)[0], sink, progress)
    assert sorted(r.rig for r in spark.read.parquet(sink).collect()) == ["a", "c"]


def test_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "clip string, t long").withColumn("at", F.timestamp_seconds("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark, str(tmp_path / "in"), rows.schema, "clip", "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.clip for r in spark.table("first_seen").collect()) == ["a", "b"]
