"""What the operators share: the shared working folder, staged tables and word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.add(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()} & {_plain(p) for p in _tables})


def staged_paths() -> set[str]:
    """The folders of the tables that are staged now."""
    return set(_tables)


def release(docs: DataFrame, paths: set[str]) -> None:
    """Delete those staged tables that docs doesn't read."""
    _delete(docs.sparkSession, {_plain(p) for p in paths} - {f.rpartition("/")[0] for f in docs.inputFiles()})


#: Paths of staged tables.
_tables: set[str] = set()


def _plain(path: str) -> str:
    """A path as inputFiles() has it."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in [p for p in _tables if _plain(p) in paths]:
        _tables.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts fit a Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_of(text: F.Column) -> F.Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SEPARATORS))


def rest_of(docs: DataFrame, *own: str) -> F.Column:
    """All columns of docs but `own` as one struct, to be named `row`: so none of their names meets one of an operator's."""
    others = [c for c in docs.columns if c not in own]
    return F.struct(*(docs[f"`{c}`"] for c in others)) if others else F.struct(F.lit(0).alias("none"))


def whole(columns: list[str], *own: str) -> list[F.Column]:
    """The columns of a table from its own and from `row`."""
    return [F.col(c) if c in own else F.col("row").getField(c).alias(c) for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
