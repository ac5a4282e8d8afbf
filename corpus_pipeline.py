"""The training-data pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Each stage takes all rows that the one before it kept. The stages before the
last return the columns of documents: rows that a stage rejects are gone, and a
document that the mix takes twice is there twice. The last returns a row for
each row of the mix, from the files that it writes. A stage begins by deleting the
tables that earlier ones have staged and that its input doesn't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motionlake.llm import decontaminate, mixing, quality_rules, shingle_join, token_output
from motionlake.llm.common import release, staged, staged_paths, table


#: Tables that stages have staged for their results.
_left: set[str] = set()


def _stage(docs: DataFrame, job: Callable[[], DataFrame]) -> DataFrame:
    """The job's result, after what earlier stages needed for theirs has gone, as far as docs doesn't read it."""
    release(docs, _left)
    before = staged_paths()
    _left.intersection_update(before)
    out = job()
    _left.update(staged_paths() - before)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return _stage(docs, lambda: quality_rules.quality_filter(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity of five-word shingles of 0.8 or more. SimHash with pigeonring filtering links the closest; three of 64 bits don't reach that similarity, so an exact join finds the rest."""
    return _stage(docs, lambda: shingle_join.deduplicate(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return _stage(docs, lambda: decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _stage(docs, lambda: mixing.mixed(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place in the files of token ids, as read back from them."""
    return _stage(docs, lambda: token_output.token_output(docs))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mix),
    ("token ids", token_ids),
]

#: Stages two, four and five can't be said in SQL; tests/llm/test_pipeline.py holds the stages and their chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
