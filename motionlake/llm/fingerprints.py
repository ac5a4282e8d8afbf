"""Document fingerprints by SimHash, in DataFrame expressions only.

A text's terms are its runs of five words, weighted by how often they occur
(a text of fewer words is one term). The terms' 64-bit hashes vote on signed
bits: a bit of the fingerprint is set if the terms that have it outweigh those
that don't. Terms are exploded into a hash aggregate of 32 sums, two votes each
in halves of 32 bits that an array's length can't overflow, so that what is
shuffled is one row a text and task. The likeness of two fingerprints is the
cosine of the angle that their differing bits estimate, 0 where it is obtuse.

All fingerprints within a Hamming radius r are found in permuted block tables:
with r + k blocks, at least k of them agree, so the pair meets in the table that
has those k in front. A pair that meets in several tables is returned by the
first. Only distinct fingerprints are joined, so copies are counted, not paired.

The next document of each is found without ordering all rows in one task:
documents are dealt into ranges of doc_id, and the first row of a range is also
given to the range before it.

Cases: a null doc_id comes after all others in descending order; rows that share
an id are ordered by their text's hash; a null text is empty, and a text without
words has no terms and the fingerprint zero; a single document is its own next
one; repeated rows each have a row; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table, words_of

WIDTH = 5
RADIUS = 3
BLOCKS = 6
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
#: Stands for a null doc_id, which comes last in descending order.
NO_ID = -(1 << 63)
#: A document is a query of the search for near fingerprints if its id is divisible by this.
EVERY = 100


def term_hashes(words: F.Column, width: int = WIDTH) -> F.Column:
    """The XXH64 hashes of an array's runs of `width` words, in order, repeats included."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def fingerprints(texts: DataFrame, *keys: str, width: int = WIDTH) -> DataFrame:
    """texts(keys, text): the keys and fp, a row for each distinct combination of keys; its terms are those of all texts with these keys."""
    # outer: a text without terms keeps its row, and Spark infers no filter that would split the text again for each word
    terms = texts.select(*keys, words_of(F.col("text")).alias("words")).select(*keys, F.explode_outer(term_hashes(F.col("words"), width)).alias("h"))
    halves = [F.sum(F.expr(f"(shiftrightunsigned(h, {b}) & 1L) | shiftleft(shiftrightunsigned(h, {b + 32}) & 1L, 32)")).alias(f"v{b}") for b in range(32)]
    votes = terms.groupBy(*keys).agg(F.count("h").alias("n"), *halves)
    low = [F.expr(f"CASE WHEN 2 * (v{b} & 4294967295L) > n THEN {1 << b}L ELSE 0L END") for b in range(32)]
    high = [F.expr(f"CASE WHEN 2 * shiftrightunsigned(v{b}, 32) > n THEN shiftleft(1L, {b + 32}) ELSE 0L END") for b in range(32)]
    bits = low[0]
    for x in low[1:] + high:
        bits = bits.bitwiseOR(x)
    return votes.select(*keys, bits.alias("fp"))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """0 to 1: the cosine that the differing bits of two fingerprints estimate."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def hexadecimal(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp): for each fingerprint of queries(fp) those of prints(fp) at `radius` or fewer differing bits, each pair once. Both hold distinct fingerprints."""
    if not (0 <= radius < blocks and 2 <= blocks <= 64):
        raise ValueError("there must be two blocks at least, and more than differing bits")
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    ends = list(zip(cuts, cuts[1:]))
    part = lambda name, k: f"(shiftrightunsigned({name}, {ends[k][0]}) & {(1 << (ends[k][1] - ends[k][0])) - 1}L)"
    tables = list(combinations(range(blocks), blocks - radius))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        rows = [f"struct({t} AS t, xxhash64({', '.join(part('fp', k) for k in kept)}) AS k)" for t, kept in enumerate(tables)]
        return df.select(F.col("fp").alias(name), F.explode(F.expr(f"array({', '.join(rows)})")).alias("x")).select(name, "x.t", "x.k")

    def first(t: int, kept: tuple[int, ...]) -> str:
        """Those of the table's blocks agree, and no earlier block outside them does."""
        others = [k for k in range(max(kept)) if k not in kept]
        return f"t = {t} AND {' AND '.join([f'{part("apart", k)} = 0' for k in kept] + [f'{part("apart", k)} <> 0' for k in others])}"

    met = dealt(prints, "fp").join(dealt(queries, "query"), ["t", "k"]).withColumn("apart", F.expr("fp ^ query"))
    alike = F.expr(" OR ".join(f"({first(t, kept)})" for t, kept in enumerate(tables)))
    return met.where((F.bit_count("apart") <= radius) & alike).select("query", "fp")


def _successors(docs: DataFrame) -> DataFrame:
    """docs(id long, text): key (one a row), id, text, next_key and next_text of the next row in descending order of id, which after the last is the first."""
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.lit([k / parts for k in range(1, parts)] or [1.0])
    # a sketch of the ids: as many numbers come to the driver as there are ranges; all of them are ids that occur
    found = docs.agg(F.percentile_approx("id", shares, F.lit(100 * parts)).alias("cuts"), F.max("id").alias("most")).first()
    starts = sorted({*(found["cuts"] or []), *([found["most"]] if found["most"] is not None else [])}, reverse=True)
    steps = 1 << max(len(starts) - 1, 0).bit_length()
    bounds = F.array(*(F.lit(x).cast("long") for x in starts)) if starts else F.array().cast("array<bigint>")
    # by halving steps, how many starts are at or above the id
    leaps = F.array(*(F.lit(steps >> k) for k in range(steps.bit_length())))
    place = F.aggregate(leaps, F.lit(0), lambda at, leap: F.when(F.coalesce(F.get(bounds, at + leap - 1) >= F.col("id"), F.lit(False)), at + leap).otherwise(at))
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "id", "text", F.xxhash64("text").alias("code"), place.alias("at"))
    own = F.struct(F.col("at").alias("range"), F.lit(False).alias("wrap"), F.lit(False).alias("guest"))
    before = F.when((F.col("at") > 1) & (F.get(bounds, F.col("at") - 1) == F.col("id")), F.struct((F.col("at") - 1).alias("range"), F.lit(False).alias("wrap"), F.lit(True).alias("guest")))
    around = F.when(F.col("at") == 1, F.when(F.get(bounds, F.lit(0)) == F.col("id"), F.struct(F.lit(len(starts)).alias("range"), F.lit(True).alias("wrap"), F.lit(True).alias("guest"))))
    copies = keyed.select("*", F.explode(F.filter(F.array(own, before, around), lambda x: x.isNotNull())).alias("to")).select("key", "id", "text", "code", "to.*")
    order = Window.partitionBy("range").orderBy("wrap", F.desc("id"), "code", "key")
    out = copies.withColumn("next", F.lead(F.struct("key", "text")).over(order))
    return out.where(~F.col("guest")).select("key", "id", "text", F.col("next.key").alias("next_key"), F.col("next.text").alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """key, id, text, next_key and edited: the text whose last half is replaced by as much of the next document's beginning."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    whole = F.concat(F.substr("text", F.lit(1), F.char_length("text") - half), F.substr("next_text", F.lit(1), half))
    return _successors(docs).select("key", "id", "text", "next_key", whole.alias("edited"))


def document_fingerprints(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near: of documents whose id EVERY divides, how many others have fingerprints within the radius."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = ("key", "id", "next_key", "n_chars", "sha", "is_edited")
    both = F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), "text"), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"))))
    rows = edited(own).select("key", "id", "next_key", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), both.alias("of"))
    prints = fingerprints(rows.select(*keys[:-1], "of.is_edited", "of.text"), *keys, width=width)
    pair = prints.groupBy(*keys[:-1]).agg(F.max(F.when(~F.col("is_edited"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("is_edited"), F.col("fp"))).alias("edited_fp"))
    pair = staged(pair, "fingerprints")
    asked = (F.col("id") != NO_ID) & (F.col("id") % EVERY == 0)
    counts = pair.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked"))
    counts = staged(counts, "fingerprint-counts")
    found = near(counts.select("fp"), counts.where("asked").select("fp"), radius)
    around = staged(found.join(counts, "fp").groupBy("query").agg((F.sum("n") - 1).alias("n_near")), "near-fingerprints")
    following = pair.select(F.col("key").alias("_key"), F.col("fp").alias("next_fp"))
    out = pair.join(following, F.col("next_key") == F.col("_key")).join(around, F.col("fp") == F.col("query"), "left")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.when(asked, F.col("n_near")).alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
