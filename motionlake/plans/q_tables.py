"""Queries of the joins, merges and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import object_type_of
from ..operators import summaries as s
from ..operators import tables as t
from .views import load, with_views


def lookup_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments, in another case for some, looked up in the parts' types by first word."""
    (part,) = load(spark, sf_dir, "part")
    meta = part.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("ord"))
    keys = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"))
    return t.lookup_ci(keys, meta, "name", "ord").select("id", "name", "meta_name", "meta_ord")


LOOKUP_CI = """WITH m AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS ord FROM part),
k AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM part WHERE p_partkey % 2 = 0),
j AS (SELECT k.id, k.name, m.name AS meta_name, m.ord AS meta_ord, row_number() OVER (PARTITION BY k.id ORDER BY m.name <> k.name, m.ord) AS n FROM k LEFT JOIN m ON lower(m.name) = lower(k.name))
SELECT id, name, meta_name, meta_ord FROM j WHERE n = 1"""


def rig_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of the rigs that clips belong to by name, and segments with their clips' captions."""
    (captions,) = load(spark, sf_dir, "captions")
    segments = captions.select(F.concat("clip", F.lit("-000")).alias("segment")).union(captions.where("lang = 'en'").select(F.concat("clip", F.lit("-001")).alias("segment")))
    segments = segments.union(captions.where("lang = 'de'").select(F.concat(F.lit("x"), F.col("clip"), F.lit("-000")).alias("segment")))
    out = t.rekey(segments, captions.select("clip", "text"), F.regexp_replace("segment", "^(.*)-[^-]*$", "$1"))
    return out.select("segment", "clip", object_type_of(F.col("clip")).alias("rig"), "text")


RIG_CAPTIONS = with_views(
    """, s AS (SELECT clip || '-000' AS segment FROM captions UNION ALL SELECT clip || '-001' FROM captions WHERE lang = 'en' UNION ALL SELECT 'x' || clip || '-000' FROM captions WHERE lang = 'de')
    SELECT segment, clip, split_part(clip, '-', 1) AS rig, text FROM s JOIN captions c ON c.clip || '-000' = segment OR c.clip || '-001' = segment""",
    "captions",
)


def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, marker and shard tables of asset categories; the last wins."""
    (votes,) = load(spark, sf_dir, "votes")
    parts = [votes.where(f"ord % 3 = {k}").select("asset", "category", "ord") for k in (2, 0, 1)]
    return t.merge_last_wins(parts, ["asset"], "ord")


MERGE_PARTS = with_views(
    """, r AS (SELECT asset, category, ord, row_number() OVER (PARTITION BY asset ORDER BY (ord + 1) % 3 DESC, ord DESC) AS n FROM votes) SELECT asset, category, ord FROM r WHERE n = 1""",
    "votes",
)


def shard_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions, votes = load(spark, sf_dir, "captions", "votes")
    shards = captions.select("rig", "clip", F.when(F.crc32("clip") % 5 == 0, F.lit("ERROR: no answer")).otherwise(F.col("text")).alias("text"), F.lit(1).alias("rank"), F.lit(0).alias("seq"))
    again = captions.where(F.crc32("clip") % 2 == 0).select("rig", "clip", "text", F.lit(2).alias("rank"), F.lit(0).alias("seq"))
    merged, failures = t.merge_caption_shards(shards.union(again).drop("rig"), captions.where(F.crc32("clip") % 3 == 0).select("clip"))
    return merged.withColumn("kind", F.lit("merged")).unionByName(failures.select("clip", F.lit(None).cast("string").alias("text"), F.lit("pending").alias("kind")))


SHARD_FAILURES = None


def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, clips = load(spark, sf_dir, "frames", "clips")
    return t.recover_missing_counts(frames, clips.where("user_id % 3 <> 0"))


MISSING_COUNTS = with_views("SELECT f.clip, count(*) AS n_frames FROM frames f JOIN clips c ON c.clip = f.clip WHERE c.user_id % 3 = 0 GROUP BY f.clip", "frames", "clips")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    items = votes.select("asset").distinct()
    return t.pending_work(items, votes.where("ord = 0 AND confidence = 'high'").select("asset", "category"), "asset", "category", ("uncertain",))


PENDING = with_views("SELECT DISTINCT asset FROM votes v WHERE NOT EXISTS (SELECT 1 FROM votes d WHERE d.asset = v.asset AND d.ord = 0 AND d.confidence = 'high' AND d.category <> 'uncertain')", "votes")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rigs,) = load(spark, sf_dir, "rigs")
    return rigs.select("rig", t.stable_digest(["n_joints", "rig"]).alias("digest"))


DIGESTS = with_views("""SELECT rig, substr(sha1('{"n_joints":' || n_joints || ',"rig":"' || rig || '"}'), 1, 16) AS digest FROM rigs""", "rigs")


def cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    tasks = part.select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("settings"), F.col("p_type").alias("digest"))
    k = F.col("p_partkey")
    old_size = F.when(k % 5 == 1, (F.col("p_size") + 1).cast("string")).otherwise(F.col("p_size").cast("string"))
    old = part.where("p_partkey % 7 <> 0").select("p_partkey", F.create_map(F.lit("size"), old_size, F.lit("brand"), F.when(k % 10 == 1, F.lit("none")).otherwise(F.col("p_brand"))).alias("settings"), F.when(k % 3 == 0, F.lit(None)).when(k % 4 == 0, F.lit("old")).otherwise(F.col("p_type")).alias("digest"))
    return t.cache_decision(tasks, old, "p_partkey").select("p_partkey", "action", F.array_join("changed", ",").alias("changed"))


CACHE_DECISIONS = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'new' WHEN p_partkey % 5 = 1 THEN 'settings' WHEN p_partkey % 3 = 0 THEN 'stamp' WHEN p_partkey % 4 = 0 AND p_type <> 'old' THEN 'export' ELSE 'reuse' END AS action,
CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'brand,size' WHEN p_partkey % 5 = 1 THEN 'size' ELSE '' END AS changed FROM part"""


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels, embeddings = load(spark, sf_dir, "documents", "labels", "embeddings")
    tables = {"documents": documents.select(F.col("doc_id").cast("string").alias("key")), "labels": labels.select(F.col("doc_id").cast("string").alias("key")), "embeddings": embeddings.select(F.col("vec_id").cast("string").alias("key"))}
    return t.check_key_sets(tables, "key")


KEY_SETS = """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS key, 'documents' AS has FROM documents UNION SELECT CAST(doc_id AS VARCHAR), 'labels' FROM labels UNION SELECT CAST(vec_id AS VARCHAR), 'embeddings' FROM embeddings)
SELECT k.key, n.has AS missing_in FROM (SELECT DISTINCT key FROM a) k CROSS JOIN (SELECT unnest(['documents', 'labels', 'embeddings']) AS has) n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = k.key AND a.has = n.has)"""


def joint_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose joints are the rig's turned round, with a name missing, repeated, or under another parent."""
    raw, rigs = load(spark, sf_dir, "labels_raw", "rigs")
    r = raw.join(rigs.select("rig", "r", "n_joints"), "rig")
    c = r.select(F.concat("rig", F.lit("-c")).alias("clip"), "rig", "r", "n_joints", "j", F.when((F.col("r") % 5 == 1) & (F.col("j") == 2), F.col("parent") + 1).otherwise(F.col("parent")).alias("parent"), F.when((F.col("r") % 5 == 2) & (F.col("j") == 1), F.lit("Other")).when((F.col("r") % 5 == 3) & (F.col("j") < 2), F.lit("Same")).otherwise(F.col("raw")).alias("raw"))
    turned = c.select("clip", "rig", (F.col("n_joints") - 1 - F.col("j")).alias("j"), F.when(F.col("parent") < 0, -1).otherwise(F.col("n_joints") - 1 - F.col("parent")).alias("parent"), "raw")
    return t.align_joints(turned, raw)


JOINT_ALIGNMENT = with_views(
    """SELECT rig || '-c' AS clip, rig, NOT coalesce(bad, false) AS ok, CASE WHEN bad THEN why END AS reason FROM (
    SELECT rig, CASE WHEN r % 5 = 1 THEN n_joints > 2 WHEN r % 5 = 2 THEN n_joints > 1 WHEN r % 5 = 3 THEN true ELSE false END AS bad,
    CASE WHEN r % 5 = 1 THEN 'parents differ' WHEN r % 5 = 2 OR n_joints = 1 THEN 'names differ' ELSE 'names repeat' END AS why FROM rigs) t""",
    "rigs",
)


def main_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    clips = orders.select(F.col("o_custkey").alias("rig"), F.col("o_orderkey").alias("clip"), F.col("o_orderpriority").alias("names"))
    return t.main_skeleton(clips, "names", "clip").select("rig", "clip", "is_main")


MAIN_SKELETONS = """WITH g AS (SELECT o_custkey AS rig, o_orderpriority AS names, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY n DESC, f) AS k FROM g) SELECT o_custkey AS rig, o_orderkey AS clip, o_orderpriority = m.names AS is_main FROM orders JOIN m ON m.rig = o_custkey AND m.k = 1"""


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, embeddings = load(spark, sf_dir, "documents", "embeddings")
    now = documents.select(F.col("doc_id").alias("key"), "text").where("key % 11 <> 0")
    cache = embeddings.select(F.col("vec_id").cast("long").alias("key"), F.when(F.col("vec_id") % 13 == 0, F.lit("t5-old")).otherwise(F.lit("t5")).alias("encoder")).join(documents.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 5 == 0, F.lit("was")).otherwise(F.col("text")).alias("text")), "key")
    judged, wanted = t.reconcile_embeddings(now, cache, "t5")
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).unionByName(wanted.agg(F.lit("encode").alias("verdict"), F.count(F.lit(1)).alias("n")))


EMBEDDING_CACHE = """WITH n AS (SELECT doc_id AS key, text FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT d.doc_id AS key, CASE WHEN vec_id % 13 = 0 THEN 't5-old' ELSE 't5' END AS encoder, CASE WHEN d.doc_id % 5 = 0 THEN 'was' ELSE d.text END AS text FROM embeddings JOIN documents d ON d.doc_id = vec_id),
j AS (SELECT c.key, CASE WHEN encoder <> 't5' THEN 'encoder' WHEN n.text IS NULL THEN 'orphan' WHEN n.text <> c.text THEN 'stale' ELSE 'keep' END AS verdict FROM c LEFT JOIN n ON n.key = c.key)
SELECT verdict, count(*) AS n FROM j GROUP BY verdict UNION ALL
SELECT 'encode', count(DISTINCT text) FROM n WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.key = n.key AND verdict = 'keep')"""


def stats_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = load(spark, sf_dir, "nation", "region")
    own = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("dataset"))
    return t.resolve_stats_key(nation.select(F.col("n_name").alias("dataset")), own.union(spark.createDataFrame([("ALL",)], "dataset string")), {"CANADA": "ALGERIA", "CHINA": "CANADA"}, "ALL")


STATS_KEYS = """SELECT n_name AS dataset, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_name = 'CANADA' AND EXISTS (SELECT 1 FROM nation WHERE n_name = 'ALGERIA' AND n_nationkey % 3 = 0) THEN 'ALGERIA'
WHEN n_name = 'CHINA' AND EXISTS (SELECT 1 FROM nation WHERE n_name = 'CANADA' AND n_nationkey % 3 = 0) THEN 'CANADA' ELSE 'ALL' END AS stats_key FROM nation"""


def clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return t.namespace_clash_report(orders.select(F.col("o_custkey").alias("rig"), F.col("o_orderstatus").alias("dataset")), "rig").select("rig", F.array_join("datasets", ",").alias("datasets"))


CLASHES = "SELECT o_custkey AS rig, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS datasets FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, rigs = load(spark, sf_dir, "clips", "rigs")
    samples = clips.select(F.col("clip").alias("sample"), F.col("rig").alias("asset"), (F.col("n_joints") + F.when(F.col("user_id") % 4 == 0, 1).otherwise(0)).alias("n_joints"))
    assets = rigs.where("r % 3 <> 0").select(F.col("rig").alias("asset"), "n_joints", F.when(F.col("r") % 2 == 0, F.lit("t")).alias("topology"))
    return t.manifest_jobs(samples, assets).select("sample", "asset", "ok", F.array_join("problems", ", ").alias("problems"))


JOBS = with_views(
    """SELECT clip AS sample, c.rig AS asset, r % 3 <> 0 AND r % 2 = 0 AND user_id % 4 <> 0 AS ok, CASE WHEN r % 3 = 0 THEN 'no asset' ELSE concat_ws(', ', CASE WHEN user_id % 4 = 0 THEN 'joint counts differ' END, CASE WHEN r % 2 <> 0 THEN 'no condition' END) END AS problems
    FROM clips c JOIN rigs g ON g.rig = c.rig""",
    "clips",
    "rigs",
)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, part = load(spark, sf_dir, "supplier", "part")
    old_a = supplier.select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("topology"))
    new_a = supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("asset"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)).alias("topology"))
    n = supplier.count()
    old_s = part.select(F.col("p_partkey").alias("sample"), (F.col("p_partkey") % n + 1).alias("asset"), F.lit("old").alias("made"))
    new_s = part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("sample"), (F.col("p_partkey") % n + 1).alias("asset"), F.lit("new").alias("made"))
    assets, samples = t.merge_manifest(old_a, new_a, old_s, new_s, "asset", ["topology"])
    return samples.join(assets, "asset", "left").select("sample", "asset", "made", "topology")


MANIFESTS = """WITH o AS (SELECT p_partkey AS sample, p_partkey % (SELECT count(*) FROM supplier) + 1 AS asset FROM part),
k AS (SELECT sample, asset, 'new' AS made FROM o WHERE sample % 5 = 0 UNION ALL SELECT sample, asset, 'old' FROM o WHERE sample % 5 <> 0 AND (asset % 4 <> 0 OR asset NOT IN (SELECT s_suppkey FROM supplier)))
SELECT sample, asset, made, s_nationkey + CASE WHEN asset % 4 = 0 THEN 1 ELSE 0 END AS topology FROM k LEFT JOIN supplier ON s_suppkey = asset"""


def clip_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    clips = captions.select("clip", "rig", F.when(F.crc32("clip") % 2 == 0, F.lit("train")).otherwise(F.lit("eval")).alias("split"))
    clips = clips.union(captions.select(F.regexp_replace("clip", "-", "_").alias("clip"), "rig", F.lit("eval").alias("split")))
    cases = captions.select(F.substring_index("clip", "-", -1).alias("case"), "rig").union(captions.where("lang = 'es'").select(F.col("clip").alias("case"), "rig"))
    return t.resolve_clip(cases, clips)


CLIP_CASES = with_views("SELECT split_part(clip, '-', 2) AS \"case\", rig, clip FROM captions UNION ALL SELECT clip, rig, clip FROM captions WHERE lang = 'es'", "captions")


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (supplier,) = load(spark, sf_dir, "supplier")
    after = supplier.where("s_suppkey % 7 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("s_acctbal"))).withColumn("s_name", F.when(F.col("s_suppkey") % 4 == 0, F.lit("x")).otherwise(F.col("s_name")))
    return t.table_diff(supplier, after, ["s_suppkey"], ["s_name", "s_nationkey"], "supplier")


DIFF = """SELECT 'supplier' AS kind, s_suppkey, 's_name' AS "column", s_name AS old, CASE WHEN s_suppkey % 7 <> 0 THEN 'x' END AS new, CASE WHEN s_suppkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS note FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 4 = 0
UNION ALL SELECT 'supplier', s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR), NULL, 'removed' FROM supplier WHERE s_suppkey % 7 = 0"""


def _clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return frames.groupBy("clip", "rig").agg(F.count(F.lit(1)).alias("n_frames"))


_CF = ", cf AS (SELECT clip, rig, count(*) AS n_frames FROM frames GROUP BY clip, rig)"


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.export_summary(_clip_frames(spark, sf_dir), ["rig"])


EXPORT_SUMMARY = with_views(_CF + " SELECT rig, count(*) AS clips, CAST(sum(n_frames) AS BIGINT) AS frames, round_even(sum(n_frames) / 30, 2) AS seconds, round_even(sum(n_frames) / 1800, 2) AS minutes FROM cf GROUP BY rig", "frames")


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rigs,) = load(spark, sf_dir, "rigs")
    return s.corpus_stats(_clip_frames(spark, sf_dir), rigs)


CORPUS_TOTALS = with_views(
    _CF
    + """ SELECT *, round_even(clips / rigs_with_clips, 4) AS clips_per_rig FROM (SELECT count(*) AS clips, CAST(sum(n_frames) AS BIGINT) AS frames, round_even(sum(n_frames) / 1800, 2) AS minutes, count(DISTINCT rig) AS rigs_with_clips FROM cf),
    (SELECT count(*) AS rigs, max(n_joints) AS max_joints, round_even(avg(n_joints), 4) AS joints_per_rig FROM rigs)""",
    "frames",
    "rigs",
)


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return s.percentile_stats(orders, "o_totalprice", ["o_orderpriority"])


PERCENTILES = """SELECT o_orderpriority, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS p75,
quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.99) AS p99, avg(o_totalprice) AS mean, max(o_totalprice) AS max FROM orders GROUP BY 1"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.threshold_shares(_clip_frames(spark, sf_dir), "n_frames", [60, 65, 70, 90])


SHARES = with_views(_CF + " SELECT t AS threshold, CAST(count_if(n_frames >= t) AS BIGINT) AS n, count_if(n_frames >= t) / count(*) AS share FROM cf, (SELECT unnest([60, 65, 70, 90]) AS t) GROUP BY t", "frames")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.integer_hist(_clip_frames(spark, sf_dir), "n_frames")


HISTOGRAM = with_views(
    _CF
    + """, e AS (SELECT min(n_frames) AS lo, CASE WHEN max(n_frames) - min(n_frames) <= 30 THEN 1 WHEN max(n_frames) - min(n_frames) <= 60 THEN 2 ELSE 3 END AS w FROM cf)
    SELECT lo + ((n_frames - lo) // w) * w AS bin, w AS width, count(*) AS n FROM cf, e GROUP BY 1, 2""",
    "frames",
)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.cdf_curve(_clip_frames(spark, sf_dir), "n_frames")


CURVES = with_views(_CF + " SELECT DISTINCT a.n_frames AS x, (SELECT count(*) FROM cf b WHERE b.n_frames <= a.n_frames) / (SELECT count(*) FROM cf) AS cdf, (SELECT count(*) FROM cf b WHERE b.n_frames >= a.n_frames) / (SELECT count(*) FROM cf) AS survival FROM cf a", "frames")


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.kde_curve(_clip_frames(spark, sf_dir), "n_frames", list(range(40, 101, 5)), 0.4).select("x", F.round("density", 9).alias("density"))


DENSITY = with_views(_CF + ", h AS (SELECT stddev_samp(n_frames) * 0.4 AS h, count(*) AS t FROM cf) SELECT CAST(x AS DOUBLE) AS x, round(sum(exp(-0.5 * pow((x - n_frames) / h, 2))) / (t * h * sqrt(2 * pi())), 9) AS density FROM cf, h, range(40, 101, 5) AS g(x) GROUP BY x, t, h", "frames")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    labels = raw.select("rig", F.regexp_replace("raw", "^(Left|Right)|_[0-9]+$", "").alias("label"))
    return s.label_coverage(labels, spark.createDataFrame([("UpLeg",), ("Leg",), ("Arm",)], "label string"))


COVERAGE = with_views(
    """SELECT rig, count(*) AS n, CAST(count_if(l IN ('ForeArm', 'Spine')) AS BIGINT) AS n_odd, 1 - count_if(l IN ('ForeArm', 'Spine')) / count(*) AS clean_share
    FROM (SELECT rig, regexp_replace(raw, '^(Left|Right)|_[0-9]+$', '', 'g') AS l FROM labels_raw) t GROUP BY GROUPING SETS ((rig), ())""",
    "labels_raw",
)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    return s.category_inventory(votes.where("ord = 0").select(F.col("asset").alias("rig"), F.when(F.col("category") == "avian", F.lit("ERROR: x")).otherwise(F.col("category")).alias("category")))


INVENTORY = with_views("SELECT category, list_sort(list_distinct(list(asset))) AS rigs FROM votes WHERE ord = 0 AND category <> 'avian' GROUP BY category", "votes")


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return s.pooled_and_per_dataset(orders.withColumnRenamed("o_orderstatus", "dataset"), "o_totalprice").withColumn("mean", F.round("mean", 4))


POOLED = "SELECT o_orderstatus AS dataset, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS max, quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    rigs = joints.groupBy("rig").agg(F.count(F.lit(1)).alias("n_joints"), (F.floor(F.log2(F.max("j") + 1.0))).alias("depth")).withColumn("dataset", F.substring("rig", -1, 1))
    return s.max_shape(rigs, 1, 2)


SHAPES = with_views("SELECT dataset, max(n) + 1 AS max_joints, least(max(d), 2) AS max_depth FROM (SELECT right(rig, 1) AS dataset, count(*) AS n, CAST(floor(log2(max(j) + 1.0)) AS BIGINT) AS d FROM joints GROUP BY rig) t GROUP BY GROUPING SETS ((dataset), ())", "joints")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rigs,) = load(spark, sf_dir, "rigs")
    return s.joint_limits_audit(rigs.select("rig", "n_joints"), 2, 9)


LIMITS = with_views("SELECT rig, n_joints FROM rigs WHERE n_joints NOT BETWEEN 2 AND 9 ORDER BY n_joints DESC, rig LIMIT 20", "rigs")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, joints = load(spark, sf_dir, "positions", "joints")
    away = positions.join(joints.select("rig", "j", "oy"), ["rig", "j"]).select("rig", "clip", "j", F.abs(F.col("py") - F.col("oy")).alias("away"), F.lit(2.0).alias("extent"))
    return s.dropped_translation_audit(away).select("rig", F.round("ratio", 9).alias("ratio"))


TRANSLATIONS = with_views("SELECT p.rig, round(max(abs(py - oy) / 2.0), 9) AS ratio FROM positions p JOIN joints j ON j.rig = p.rig AND j.j = p.j WHERE p.j > 0 GROUP BY p.rig", "positions", "joints")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions, votes, rigs = load(spark, sf_dir, "captions", "votes", "rigs")
    return s.metadata_report(rigs.where("n_joints < 3").select(F.col("n_joints").alias("rig")), votes, captions.select(F.col("lang").alias("version")))


REPORT = with_views("SELECT 'rejected' AS section, CAST(n_joints AS VARCHAR) AS key, count(*) AS value FROM rigs WHERE n_joints < 3 GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM votes GROUP BY 2 UNION ALL SELECT 'captions', lang, count(*) FROM captions GROUP BY 2", "captions", "votes", "rigs")

QUERIES = {
    "c1_lookup_ci": (lookup_ci, LOOKUP_CI),
    "c2_c3_rekey_captions": (rig_captions, RIG_CAPTIONS),
    "c4_c14_merge_last_wins": (merge_parts, MERGE_PARTS),
    "c5_merge_caption_shards": (shard_failures, SHARD_FAILURES),
    "c6_recover_missing_counts": (missing_counts, MISSING_COUNTS),
    "c7_pending_work": (pending, PENDING),
    "c8_cache_decision": (cache_decisions, CACHE_DECISIONS),
    "c9_stable_digest": (digests, DIGESTS),
    "c10_check_key_sets": (key_sets, KEY_SETS),
    "c11_align_joints": (joint_alignment, JOINT_ALIGNMENT),
    "c12_main_skeleton": (main_skeletons, MAIN_SKELETONS),
    "c13_reconcile_embeddings": (embedding_cache, EMBEDDING_CACHE),
    "c15_resolve_stats_key": (stats_keys, STATS_KEYS),
    "c16_namespace_clashes": (clashes, CLASHES),
    "c17_manifest_jobs": (jobs, JOBS),
    "c18_merge_manifest": (manifests, MANIFESTS),
    "c19_resolve_clip": (clip_cases, CLIP_CASES),
    "g9_a11_table_diff": (diff, DIFF),
    "d1_export_summary": (export_summary, EXPORT_SUMMARY),
    "d2_corpus_stats": (corpus_totals, CORPUS_TOTALS),
    "d3_metadata_report": (report, REPORT),
    "d4_percentile_stats": (percentiles, PERCENTILES),
    "d5_threshold_shares": (shares, SHARES),
    "d6_integer_hist": (histogram, HISTOGRAM),
    "d7_cdf_survival": (curves, CURVES),
    "d8_kde_curve": (density, DENSITY),
    "d9_label_coverage": (coverage, COVERAGE),
    "d10_category_inventory": (inventory, INVENTORY),
    "d11_pooled_and_per_dataset": (pooled, POOLED),
    "d12_max_shape": (shapes, SHAPES),
    "d13_joint_limits": (limits, LIMITS),
    "d14_dropped_translation": (translations, TRANSLATIONS),
}
