"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there, for a table that several branches of a job use."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions under a path that were written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)


def write_atomic(df: DataFrame, path: str) -> None:
    """A new version of a table, which readers see once Spark has committed it; a failed write leaves the old version."""
    df.write.mode("overwrite").parquet(f"{path}/v{max(_versions(df.sparkSession, path), default=0) + 1:06d}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of a table that write_atomic writes."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no version of {path} was written whole")
    return spark.read.parquet(f"{path}/v{versions[-1]:06d}")


def write_vocab(vocab: DataFrame, path: str, **meta: str) -> None:
    """A learned map with how it was made, as columns that begin with `meta_`."""
    write_atomic(vocab.withColumns({f"meta_{k}": F.lit(v) for k, v in meta.items()}), path)


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(the map, how it was made)."""
    stored = read_current(spark, path)
    meta = [c for c in stored.columns if c.startswith("meta_")]
    first = stored.select(*meta).first() if meta else None
    return stored.drop(*meta), {c[5:]: first[c] for c in meta} if first else {}


def load_motions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Exported clips (clip, rig, fps, frames array of poses) as (clips with their number of frames, one row a frame)."""
    stored = spark.read.parquet(path)
    clips = stored.select("clip", "rig", F.coalesce("fps", F.lit(30)).alias("fps"), F.size("frames").alias("n_frames"))
    return clips, stored.select("clip", "rig", F.posexplode("frames").alias("frame", "pose"))
