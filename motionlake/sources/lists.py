"""Readers of key-value JSON, curation lists, overrides and completion markers. All go through Spark's readers, so any store will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame | None:
    """Lines (or the whole text) of a file; None if there is no such file."""
    try:
        return spark.read.text(path, wholetext=whole)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_kv_json(spark: SparkSession, path: str) -> DataFrame:
    """A flat {key: value} file as rows (key, value); a missing file has none."""
    raw = _text(spark, path, whole=True)
    if raw is None:
        return spark.createDataFrame([], "key string, value string")
    return raw.select(F.explode(F.from_json("value", "map<string,string>")))


def read_patch_json(spark: SparkSession, path: str) -> DataFrame:
    """As before, without the keys that begin with an underscore, which are remarks."""
    return read_kv_json(spark, path).where(~F.col("key").startswith("_"))


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    raw = _text(spark, path, whole=True)
    return None if raw is None else raw.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """`key # reason` lines: (line_no, key, reason); blank lines and remarks are left out."""
    lines = _lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], "line_no int, key string, reason string")
    parts = F.split("line", "#", 2)
    return lines.select("line_no", F.btrim(parts[0]).alias("key"), F.btrim(F.get(parts, F.lit(1))).alias("reason")).where("key <> ''")


def read_trim_list(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """`clip N` lines with N of 1 or more: (clip, n) and the malformed lines; strict raises if there are any."""
    rows = read_key_list(spark, path)
    ok = F.col("key").rlike(r"^\S+\s+[1-9]\d*$")
    bad = rows.where(~ok).select("line_no", "key")
    if strict and (first := bad.orderBy("line_no").first()):
        raise ValueError(f"line {first.line_no + 1} isn't a clip and a number of frames: {first.key!r}")
    parts = F.split("key", r"\s+")
    return rows.where(ok).select(parts[0].alias("clip"), parts[1].cast("int").alias("n")), bad


def read_flag_list(spark: SparkSession, path: str, rigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rig # category: reason` lines: (rig, category, reason) by each rig's last line, and (rig, problem) for unknown and overridden ones."""
    rows = read_key_list(spark, path)
    parts = F.split(F.coalesce("reason", F.lit("")), ":", 2)
    two = F.size(parts) == 2
    flags = rows.select(F.col("key").alias("rig"), "line_no", F.when(two, F.btrim(parts[0])).otherwise("flagged").alias("category"), F.btrim(F.when(two, parts[1]).otherwise(parts[0])).alias("reason"))
    last = flags.groupBy("rig").agg(F.max_by(F.struct("category", "reason"), "line_no").alias("f"), F.count(F.lit(1)).alias("n"))
    unknown = last.join(rigs.select("rig"), "rig", "left_anti").select("rig", F.lit("unknown rig").alias("problem"))
    twice = last.where("n > 1").select("rig", F.lit("overridden").alias("problem"))
    return last.select("rig", "f.category", "f.reason"), unknown.unionByName(twice)


def read_exclude_csv(spark: SparkSession, path: str) -> DataFrame:
    """object_id, else the stem of file, of each row."""
    rows = spark.read.csv(path, header=True)
    have = [F.col("object_id")] if "object_id" in rows.columns else []
    if "file" in rows.columns:
        have.append(F.regexp_replace(F.regexp_replace("file", r"^.*[/\\]", ""), r"\.[^.]*$", ""))
    return rows.select(F.coalesce(*(F.when(c != "", c) for c in have)).alias("key")).where("key IS NOT NULL").distinct()


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """Values are texts or records with a description or prompt: (key, hint); keys lose their extension, `object_name` becomes `animal` with its article."""
    rows = read_kv_json(spark, path)
    hint = F.coalesce(F.get_json_object("value", "$.description"), F.get_json_object("value", "$.prompt"), F.when(~F.col("value").startswith("{"), F.col("value")))
    hint = F.regexp_replace(F.regexp_replace(hint, r"\b([Aa]) object_name\b", "$1n animal"), "object_name", "animal")
    return rows.select(F.regexp_replace("key", r"\.[^./]*$", "").alias("key"), hint.alias("hint")).where("hint IS NOT NULL")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Completion records with joint names; unreadable files are passed over."""
    schema = "asset string, n_frames long, joint_names array<string>"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=True).where("joint_names IS NOT NULL AND size(joint_names) > 0")


def write_change_report(changes: DataFrame, path: str) -> None:
    """Tab-separated kind, key, joint, old, new and note, in order."""
    columns = ["kind", "key", "joint", "old", "new", "note"]
    rows = changes.select(*(F.col(c) if c in changes.columns else F.lit(None).cast("string").alias(c) for c in columns))
    rows.orderBy("kind", "key", "joint").write.csv(path, sep="\t", header=True, nullValue="")


def write_version(df: DataFrame, root: str, version: str) -> None:
    """A whole new version of a table beside the older ones; readers find it only once its write has been committed."""
    df.write.parquet(f"{root}/version={version}")


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The largest version. Spark's commit moves a write's files into place at its end, so one that broke off has none."""
    rows = spark.read.parquet(root)
    latest = rows.agg(F.max(F.col("version").cast("string"))).first()[0]
    return rows.where(F.col("version").cast("string") == latest).drop("version")
