"""Host-level quality rules, in DataFrame expressions only.

Every document gets counts, a verdict by each rule and a base verdict (short or
repetitive). Failures are summed by host (`source`) and rule. For each rule the
hosts' rates are shrunk towards the corpus with a beta prior, whose weight comes
from the spread of the hosts' rates beyond what sampling explains. A host is
rejected if, by two standard deviations of its posterior, more of its documents
fail some rule than halfway between the corpus's share and all of them. The host
verdict joins back to the documents.

Cases: null or blank text has no words (base rule fails); a null host has no
host verdict, so only the base rule counts; repeated rows count as often as
they occur; an empty table gives an empty table; other columns are ignored by
`quality_rules` and kept by `quality_filter`, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, rest_of, staged, table, whole, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Standard deviations of its posterior by which a host's rate must be above the limit.
DEVIATIONS = 2.0
#: Bounds of a prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)
SYMBOLS = "#*$%&|<>"
#: By rule, whether a document with these counts fails it. The first two are the base rules.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}",
    "symbols": "n_symbols * 10 > n_words",
    "lines": "n_dup_lines * 10 > n_lines * 3",
}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_metrics(docs: DataFrame, into: str = "_rules") -> DataFrame:
    """Add one struct column with the counts; no shuffle.

    Windows of three words are compared by 64-bit hash inside one text. Most
    texts repeat none, which a distinct count tells; only the others sort
    their windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    w = f"{into}_w"
    h = f"{into}_h"
    s = f"{into}_s"
    out = docs.withColumn(w, words_of(F.col("text")))
    out = out.withColumn(
        h,
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))),
        ),
    )
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter(
        F.col(s),
        lambda x, j: F.coalesce(F.get(F.col(s), j + 1)["h"] == x["h"], F.lit(False)) | F.when(j > 0, F.get(F.col(s), F.greatest(j - 1, F.lit(0)))["h"] == x["h"]).otherwise(False),
    )
    repeated = F.when(F.col(s).isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn(f"{into}_r", repeated.cast("long")).withColumn(f"{into}_l", lines)
    r = F.col(f"{into}_r")
    n_lines = F.size(f"{into}_l").cast("long")
    out = out.withColumn(
        into,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            n_lines.alias("n_lines"),
            (n_lines - F.size(F.array_distinct(f"{into}_l"))).cast("long").alias("n_dup_lines"),
            r.alias("n_repeat_words"),
        ),
    )
    return out.drop(w, h, s, f"{into}_r", f"{into}_l")


def host_rates(failures: DataFrame) -> DataFrame:
    """failures(host, a boolean for each rule) to a row for each host that isn't null: n, for each rule its rate (shrunk), and host_failed.

    One row of sums comes to the driver, from which the priors follow.
    """
    rules = [c for c in failures.columns if c != "host"]
    hosts = failures.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(r).alias(r) for r in rules))
    hosts = staged(hosts, "host-counts")
    sums = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n") / F.lit(1.0)), *(x for r in rules for x in (F.sum(r), F.sum(F.col(r) * F.col(r) / F.col("n"))))).first()
    count, n, n2 = sums[:3]
    failed = F.lit(False)
    for r, k, k2 in zip(rules, sums[3::2], sums[4::2], strict=True):
        mean, weight = prior(count, n or 0, n2 or 0.0, k or 0, k2 or 0.0)
        a, b = F.col(r) + F.lit(mean * weight), F.col("n") - F.col(r) + F.lit((1 - mean) * weight)
        rate = a / (a + b)
        hosts = hosts.withColumn(f"{r}_rate", rate)
        failed = failed | (rate - F.lit(DEVIATIONS) * F.sqrt(rate * (1 - rate) / (a + b + 1)) > F.lit((1 + mean) / 2))
    return hosts.withColumn("host_failed", failed)


def prior(hosts: int, n: int, n2: float, k: int, k2: float) -> tuple[float, float]:
    """(mean, weight) of the beta prior by moments: from the number of hosts, the sums of their documents, of those squared, of failures, and of failures squared by documents."""
    if not n:
        return 0.0, PRIOR_WEIGHT[1]
    mean = k / n
    noise, room = hosts - 1, n - n2 / n - (hosts - 1)
    # how alike documents of one host are, beyond chance
    alike = ((k2 - n * mean * mean) / (mean * (1 - mean)) - noise) / room if 0 < mean < 1 and room > 0 else 0.0
    return mean, min(max(1 / alike - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if alike > 0 else PRIOR_WEIGHT[1]


def _judged(docs: DataFrame, carried: F.Column) -> DataFrame:
    """carried (as `row`), rules (the counts), base_failed, host_failed and kept for each row.

    The hosts' table is written first, so that Spark knows its size: a small one
    is broadcast without a shuffle of the rows, a large one is joined by sorting,
    with hot hosts split.
    """
    rows = with_metrics(docs.select(carried.alias("row"), F.col("source"), F.col("text")), "rules").select("row", "source", "rules")
    failed = {r: F.expr(re.sub(r"\bn_\w+", lambda m: f"rules.{m[0]}", rule)) for r, rule in RULES.items()}
    rows = staged(rows.select("*", F.struct(*(c.alias(r) for r, c in failed.items())).alias("failed")), "rules")
    hosts = staged(host_rates(rows.select(F.col("source").alias("host"), "failed.*")).select("host", "host_failed"), "hosts")
    base = F.col("failed.short") | F.col("failed.repetitive")
    out = rows.join(hosts, F.col("source") == F.col("host"), "left").select("row", "rules", base.alias("base_failed"), F.coalesce("host_failed", F.lit(False)).alias("host_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source, the five counts, base_failed, host_failed and kept for each row."""
    out = _judged(docs, F.struct("doc_id", "source"))
    return out.select("row.doc_id", "row.source", *(F.col(f"rules.{m}") for m in METRICS), "base_failed", "host_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return _judged(docs, rest_of(docs)).where("kept").select(*whole(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM s, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4 FROM m),
u AS (SELECT source, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS rule FROM b WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*) AS n, CAST(count_if(f) AS DOUBLE) AS f FROM u GROUP BY source, rule),
t AS (SELECT rule, sum(f) / sum(n) AS mu, sum(n) AS n, count(*) - 1 AS noise, sum(n) - sum(n * n / 1.0) / sum(n) - (count(*) - 1) AS room, sum(f * f / n) AS k2 FROM h GROUP BY rule),
a AS (SELECT rule, mu, CASE WHEN mu > 0 AND mu < 1 AND room > 0 THEN ((k2 - n * mu * mu) / (mu * (1 - mu)) - noise) / room ELSE 0 END AS alike FROM t),
p AS (SELECT rule, mu, CASE WHEN alike > 0 THEN least(greatest(1 / alike - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM a),
q AS (SELECT source, (f + mu * k) / (n + k) AS rate, n + k AS size, mu FROM h JOIN p ON p.rule = h.rule),
v AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) > (1 + mu) / 2) AS host_failed FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, coalesce(host_failed, false) AS host_failed, NOT (f1 OR f2) AND NOT coalesce(host_failed, false) AS kept
FROM b LEFT JOIN v ON v.source = b.source
"""
