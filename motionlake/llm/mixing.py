"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code point order (null
last) weigh 3, 1, 2, repeating, and share 150% of all sizes; a target stops at
twice its source's size and the excess is shared anew by weight, which is the
water level at which min(2 * size, level * weight) sums to the total.

A source's target is met by whole copies: every document floor(target / size)
times, and a subset once more. The subset is chosen by counts of documents of
each exact size: an even share of every size's count, then the largest that
fit, then a bounded-knapsack dynamic program over the budget that remains, which
is below the target by less than the shortest document left out.
Which documents of a size are taken follows a seeded hash, by counting hash
ranges first, so that a size that a third of all documents have isn't ranked in
one task.

Cases: null or blank text has size 0 and is never taken; a null source is a
source of its own; equal documents are told apart by doc_id, repeated rows by
nothing, so each of them is counted but ties between them are broken in any
order; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rest_of, staged, table, whole, words_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 20240607
#: Ranges of the seeded hash in which a size's documents are counted.
RANGES = 4096
#: Words of a budget that the dynamic program fits exactly; larger ones are filled from the longest documents down and, where only longer ones are left, in steps of budget / KNAPSACK.
KNAPSACK = 1 << 16


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as near below the budget as can be; bounded counts, powers of two at a time."""
    items: list[tuple[int, int, int]] = []
    for k, (length, n) in enumerate(zip(lengths, counts, strict=True)):
        n = min(n, budget // length)
        size = 1
        while n > 0:
            items.append((k, min(size, n), length * min(size, n)))
            n -= min(size, n)
            size *= 2
    reach = [1]
    mask = (1 << (budget + 1)) - 1
    for _, _, weight in items:
        reach.append((reach[-1] | (reach[-1] << weight)) & mask)
        if reach[-1] >> budget:
            break
    total = reach[-1].bit_length() - 1
    out = [0] * len(lengths)
    for i in range(len(reach) - 2, -1, -1):
        if not reach[i] >> total & 1:
            k, n, weight = items[i]
            out[k] += n
            total -= weight
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(copies of every document, further copies to take of each length) for one source."""
    total = int((lengths * counts).sum())
    if total == 0:
        return 0, np.zeros(len(lengths), np.int64)
    whole = min(int(target // total), math.ceil(CAP))
    budget = min(round(target), int(CAP * total)) - whole * total
    if budget <= 0:
        return whole, np.zeros(len(lengths), np.int64)
    taken = (counts.astype(object) * budget // total).astype(np.int64)
    taken[lengths == 0] = 0
    budget -= int((lengths * taken).sum())
    # what has been left out goes first; copies beyond that, as far as the cap goes, only to come nearer
    most = (counts, counts * (math.ceil(CAP) - whole))
    order = np.argsort(-lengths, kind="stable")
    for limit in most:
        for k in order.tolist():
            if budget > KNAPSACK and lengths[k]:
                n = min(int(min(limit[k], most[1][k]) - taken[k]), budget // int(lengths[k]))
                taken[k] += n
                budget -= n * int(lengths[k])
    for limit in most:
        more = _fitted(lengths, np.minimum(limit, most[1]) - taken, budget)
        if limit is most[1] or int((lengths * more).sum()) == budget:
            return whole, taken + more
    return whole, taken


def _fitted(lengths: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, of those left, by the dynamic program. Budgets beyond KNAPSACK words, as remain where all that is left is longer, are fitted in coarser steps first."""
    out = np.zeros(len(lengths), np.int64)
    while budget > 0:
        step = -(-budget // KNAPSACK)
        ok = np.flatnonzero((lengths > 0) & (lengths <= budget) & (left > out))
        if not len(ok):
            break
        more = np.array(knapsack((-(-lengths[ok] // step)).tolist(), (left - out)[ok].tolist(), budget // step), np.int64)
        out[ok] += more
        budget -= int((lengths[ok] * more).sum())
        if step == 1 or not more.any():
            break
    return out


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes(source, size), one row a source, with each source's rank from 0 by code point, null last. Ranges of sources are ranked side by side, and one count a range goes to the driver."""
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "mix-sources")
    before, at = {}, 0
    for r in sorted(dealt.groupBy("part").count().collect()):
        before[r["part"]], at = at, at + r["count"]
    first = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.select("source", F.col("size").alias("source_size"), (own - 1 + first[F.col("part")]).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, size), one row a source, to source, source_size, target. The water level rises as sources fill up; each step is a sum over the sources."""
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "mix-weights")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        filled = F.col("most") <= F.lit(level) * F.col("weight")
        n, taken, free = ranked.agg(F.count_if(filled), F.sum(F.when(filled, F.col("most"))), F.sum(F.when(~filled, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total - (taken or 0.0)) / free
    return ranked.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """row (all columns of docs as a struct) and mix (size, source_size, target, copies)."""
    return mix_sizes(docs.select(rest_of(docs).alias("row"), "doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("_size")), seed)


def mix_sizes(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows(row, doc_id, source, _size): row and mix."""
    # a key that is never null, so that joins and windows deal rows out alike
    sized = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sized = sized.withColumn("_draw", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("_range", F.pmod(F.col("_draw"), F.lit(RANGES)))
    keys = staged(sized.groupBy("source", "_source", "_size", "_range").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    lengths = keys.groupBy("source", "_source", "_size").agg(F.sum("n").alias("n"))
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("_size") * F.col("n")).alias("size")))
    targets = staged(targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"), "source_size", "target"), "mix-targets")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_size", ignore_index=True)
        whole, more = fit(rows["_size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), float(rows["target"].iloc[0]))
        n = rows["n"].to_numpy(np.int64)
        return rows[["_source", "_size", "source_size", "target"]].assign(whole=whole + more // n, more=more % n)

    plans = lengths.drop("source").join(targets, "_source").groupBy("_source").applyInPandas(plan, "_source string, _size long, source_size long, target double, whole long, more long")
    before = Window.partitionBy("_source", "_size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0))
    ranges = keys.drop("source").join(plans, ["_source", "_size"]).withColumn("take", F.greatest(left, F.lit(0)))
    ranges = ranges.select("_source", "_size", "_range", "whole", "source_size", "target", "take")
    rank = F.row_number().over(Window.partitionBy("_source", "_size", "_range").orderBy("_draw", "doc_id"))
    out = sized.join(ranges.hint("merge"), ["_source", "_size", "_range"]).withColumn("_rank", rank)
    copies = F.when(F.col("_size") > 0, F.col("whole") + (F.col("_rank") <= F.col("take")).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select("row", F.struct(F.col("_size").alias("size"), "source_size", "target", copies.alias("copies")).alias("mix"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with all its columns."""
    taken = mix(docs, seed).where("mix.copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int"))).alias("copy")).select(*whole(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.struct("doc_id").alias("row"), "doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("_size"))
    return mix_sizes(rows).select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
