"""Queries of captions, categories and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import upper_by_letter
from ..operators import captions as c
from ..sources.staging import staged
from .views import load, with_views


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    text = F.when(k % 7 == 0, F.concat(F.lit("\"I'm sorry, "), "text")).when(k % 11 == 0, F.lit("  ")).when(k % 13 == 0, F.substring("text", 1, 5)).otherwise(F.col("text"))
    return documents.select("doc_id", c.caption_rejection(text, F.when(k % 5 == 0, "length").otherwise("stop")).alias("reason"), c.prop_word_flag(F.concat("text", F.when(k % 3 == 0, " Swords").otherwise(" swordsman"))).alias("prop"))


REJECTIONS = """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'truncated' WHEN doc_id % 7 = 0 THEN 'refusal' WHEN doc_id % 13 = 0 OR length(trim(text)) < 8 THEN 'too short' END AS reason,
doc_id % 3 = 0 OR regexp_matches(text, '@props') AS prop FROM documents""".replace("@props", c.PROPS)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.concat(F.lit("\n \nCaption: \"The animal "), F.regexp_replace("text", r"[.!?\"'\n]", ""), F.lit("\"\nmore"))
    clean = c.clean_answer(text)
    return conversations.select("conv_id", "turn", clean.alias("answer"), c.validate_rewrite(clean, "The animal").alias("reason"))


ANSWERS = """WITH a AS (SELECT conv_id, turn, 'The animal ' || regexp_replace(text, '[.!?"''\\n]', '', 'g') AS t FROM conversations), b AS (SELECT conv_id, turn, trim(t, ' ') AS t FROM a)
SELECT conv_id, turn, a.t || '.' AS answer, CASE WHEN regexp_matches(a.t, '@props') THEN 'prop' WHEN len(regexp_extract_all(a.t || '.', '\\S+')) > 18 THEN 'too long' WHEN regexp_matches(lower(a.t), '\\b(?:caption|rewrite|rewritten)\\b') THEN 'meta' END AS reason FROM a""".replace("@props", c.PROPS)


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    k = F.pmod(F.substring_index("clip", "-", -1).cast("int"), F.lit(6))
    r = captions.where(k > 0).select("clip", F.when(k == 1, F.lit("other")).otherwise(F.concat("text", F.lit("."))).alias("old"), F.when(k == 2, F.col("text")).otherwise(F.lit("New words.")).alias("new"), F.when(k == 3, F.lit("bad")).otherwise(F.lit("ok")).alias("status"))
    return c.apply_rewrites(captions.select("clip", "text"), r)


REWRITES = with_views(
    """, k AS (SELECT clip, text, CAST(split_part(clip, '-', 2) AS INT) % 6 AS k, regexp_replace(trim(text), '\\.$', '') AS b, regexp_replace(trim(text || '.'), '\\.$', '') AS o FROM captions)
    SELECT clip, CASE WHEN k > 3 AND o = b THEN 'New words.' ELSE text END AS text, CASE WHEN k IN (0, 3) THEN 'none' WHEN k = 2 THEN 'already' WHEN k = 1 OR o <> b THEN 'stale' ELSE 'applied' END AS change FROM k""",
    "captions",
)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    own = captions.select("clip", F.concat(F.lit("  the  "), F.col("text"), F.lit(" ")).alias("text"))
    return c.normalize_captions(own, captions.where("lang = 'fr'").select("clip", F.lit("An animal  runs").alias("text")), "animal", {"the": "an animal"}).select("clip", "text", "has_subject")


NORMALIZED = with_views(
    """, t AS (SELECT clip, trim(regexp_replace(regexp_replace(trim(CASE WHEN lang = 'fr' THEN 'An animal  runs' ELSE '  the  ' || text || ' ' END), 'the', 'an animal', 'g'), '\\s+', ' ', 'g')) AS t FROM captions)
    SELECT clip, CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS text, strpos(lower(t), 'animal') > 0 AS has_subject FROM t""",
    "captions",
)


def locomotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    k = F.substring_index("clip", "-", -1).cast("int")
    text = F.concat(F.lit("It walks"), F.when(k % 2 == 0, " forward").otherwise(" in place"), F.lit("."))
    return captions.select("clip", c.normalize_locomotion(text, (k % 10) / 10, F.when(k % 3 == 0, "backward")).alias("text"))


LOCOMOTION = with_views(
    """, k AS (SELECT clip, CAST(split_part(clip, '-', 2) AS INT) AS k FROM captions)
    SELECT clip, CASE WHEN k % 2 = 0 THEN CASE WHEN (k % 10) / 10 < 0.15 THEN 'It walks in place.' ELSE 'It walks forward.' END WHEN (k % 10) / 10 >= 0.5 THEN CASE WHEN k % 3 = 0 THEN 'It walks backward.' ELSE 'It walks.' END ELSE 'It walks in place.' END AS text FROM k""",
    "captions",
)


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    source = captions.where("lang <> 'de'").select("clip", F.when(F.col("lang") == "en", upper_by_letter(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return c.sync_captions(captions.select("clip", "text"), source)


SYNCED = with_views("SELECT clip, CASE WHEN lang = 'en' THEN upper(text) ELSE text END AS text, CASE WHEN lang = 'de' THEN 'orphan' WHEN lang = 'en' AND upper(text) <> text THEN 'changed' ELSE 'same' END AS change FROM captions", "captions")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    text = F.when(F.col("ord") % 3 == 0, F.concat(F.lit('Well: {"category": "'), F.initcap("category"), F.lit('"} so')))
    text = text.when(F.col("ord") % 3 == 1, F.concat(F.lit("not avian. Category: "), "category")).otherwise(F.concat(F.lit("perhaps "), "category", F.lit(" or avian or bipedal")))
    return votes.select("asset", "ord", c.parse_category_answer(text, ["bipedal", "quadrupedal", "avian", "uncertain"]).alias("category"))


CATEGORIES = with_views("SELECT asset, ord, category FROM votes", "votes")


def vote_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    return c.aggregate_votes(votes.where("ord < 3"), 3)


VOTE_RESULTS = with_views(
    """, p AS (SELECT asset, category, count(*) AS n, min(ord) AS f, bool_and(confidence = 'low') AS l, min_by(confidence, ord) AS o, sum(count(*)) OVER (PARTITION BY asset) AS v FROM votes WHERE ord < 3 GROUP BY asset, category),
    t AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY n DESC, f) AS k FROM p), u AS (SELECT *, category = 'uncertain' OR n * 2 <= 3 OR (v > 1 AND l) AS unsure FROM t WHERE k = 1)
    SELECT asset, CASE WHEN unsure THEN 'uncertain' ELSE category END AS category, CASE WHEN unsure THEN 'low' WHEN v = 1 THEN o WHEN n = 3 THEN 'high' ELSE 'medium' END AS confidence FROM u""",
    "votes",
)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    return c.caption_evidence(captions.select("clip", "rig", "text"), "clip")


EVIDENCE = with_views(
    """, s AS (SELECT rig, text, min(clip) AS f FROM captions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY f, text) AS k FROM s)
    SELECT rig, list(text ORDER BY k) AS texts FROM r WHERE k <= 6 GROUP BY rig""",
    "captions",
)


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    truth = votes.where("ord = 1").select(F.col("asset").alias("rig"), F.array("category", F.lit("avian")).alias("accepted"))
    got, _ = c.patch_categories(votes.where("ord = 0 AND confidence = 'high'").select(F.col("asset").alias("rig"), "category"), votes.where("ord = 2 AND category = 'bipedal'").select(F.col("asset").alias("rig"), "category"))
    return c.score_categories(got, truth)


CATEGORY_SCORES = with_views(
    """, g AS (SELECT a.asset, coalesce(p.category, a.category) AS category FROM votes a LEFT JOIN votes p ON p.asset = a.asset AND p.ord = 2 AND p.category = 'bipedal' WHERE a.ord = 0 AND a.confidence = 'high')
    SELECT CASE WHEN g.category IS NULL THEN 'missing' WHEN g.category IN (t.category, 'avian') THEN 'correct' WHEN g.category = 'uncertain' THEN 'uncertain' ELSE 'wrong' END AS mark, count(*) AS n FROM votes t LEFT JOIN g ON g.asset = t.asset WHERE t.ord = 1 GROUP BY 1""",
    "votes",
)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    return raw.select("rig", "j", "raw", F.regexp_replace(F.regexp_replace("raw", r"_\d+$", ""), "^(Left|Right)", "$1 ").alias("label"))


_LABELS = ", l AS (SELECT rig, j, raw, regexp_replace(regexp_replace(raw, '_[0-9]+$', ''), '^(Left|Right)', '\\1 ') AS label, regexp_replace(raw, '^(?:Left|Right)|_[0-9]+$', '', 'g') AS part FROM labels_raw)"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.label_histogram_facts(_labels(spark, sf_dir), 4)


HISTOGRAM = with_views(
    _LABELS + ", h AS (SELECT rig, part, count(*) AS n FROM l GROUP BY rig, part), r AS (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY regexp_matches(part, 'Leg|Arm') DESC, n DESC, part) AS rank FROM h) SELECT rig, part, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4",
    "labels_raw",
)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir).withColumn("part", F.when(F.substring(F.sha1("rig"), -1, 1) == "0", "Odd").otherwise(F.regexp_replace("label", "^(?:Left|Right) ", ""))).withColumn("ord", F.col("j"))
    # written: to learn from and to apply to
    labels = staged(labels, "labels")
    v = c.learn_vocab(labels)
    joints = labels.select("rig", "j", "raw", F.when(F.col("j") % 2 == 0, "Bone").otherwise(F.col("label")).alias("label"))
    return c.apply_vocab(joints, v, F.col("label") == "Bone").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


VOCABULARY = with_views(
    _LABELS
    + """, k AS (SELECT rig, j, CASE WHEN right(sha1(rig), 1) = '0' THEN 'Odd' ELSE part END AS part, unnest(CASE part WHEN 'UpLeg' THEN ['up leg', 'leg'] WHEN 'ForeArm' THEN ['fore arm', 'arm'] ELSE [lower(part)] END) AS key FROM l),
    n AS (SELECT key, part, count(*) AS n, min(j) AS f FROM k GROUP BY key, part), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS r, n / sum(n) OVER (PARTITION BY key) AS share FROM n),
    v AS (SELECT key, part FROM t WHERE r = 1 AND share >= 0.9 AND (SELECT count(DISTINCT rig) FROM k WHERE k.key = t.key) >= 3),
    a AS (SELECT label, part, CASE part WHEN 'UpLeg' THEN 'up leg' WHEN 'ForeArm' THEN 'fore arm' ELSE lower(part) END AS k1, CASE part WHEN 'UpLeg' THEN 'leg' WHEN 'ForeArm' THEN 'arm' END AS k2, j FROM l)
    SELECT CASE WHEN j % 2 = 0 OR label = 'Bone' THEN coalesce(v1.part, v2.part, 'Bone') ELSE label END AS label, count(*) AS n FROM a LEFT JOIN v v1 ON v1.key = k1 LEFT JOIN v v2 ON v2.key = k2 GROUP BY 1""",
    "labels_raw",
)


def label_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir).withColumn("label", F.when(F.col("j") == 0, "Hip").when(F.col("j") == 4, "7").otherwise(F.col("label")))
    fixed, _ = c.apply_label_overrides(c.unify_roots(labels), labels.where("j = 2").select("rig", "j", F.lit("Tail").alias("label")))
    return fixed.select("rig", "j", "label", c.is_canonical_label(F.col("label"), ["Hips", "UpLeg", "Leg", "Bone", "Tail"]).alias("canonical"))


LABEL_FIXES = with_views(
    _LABELS
    + """, f AS (SELECT rig, j, CASE WHEN j = 0 THEN 'Hips' WHEN j = 2 THEN 'Tail' WHEN j = 4 THEN 'Bone' ELSE label END AS label FROM l)
    SELECT rig, j, label, regexp_replace(label, '^(Left|Right) ', '') IN ('Hips', 'UpLeg', 'Leg', 'Bone', 'Tail') AS canonical FROM f""",
    "labels_raw",
)


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.candidate_partition(_labels(spark, sf_dir))
    return out.select("rig", "group", F.array_join(F.transform("joints", lambda j: j.cast("string")), ",").alias("joints"))


PARTITIONS = with_views(_LABELS + " SELECT rig, lower(split_part(label, ' ', 1)) AS \"group\", string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS joints FROM l WHERE label LIKE 'Left %' OR label LIKE 'Right %' GROUP BY 1, 2", "labels_raw")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    got = labels.where("j <> 3").select("rig", "j", F.when(F.col("label").contains("Spine"), "Chest").otherwise(F.col("label")).alias("label"))
    return c.score_annotation(labels, got).withColumn("accuracy", F.round("accuracy", 9))


ACCURACY = with_views(
    _LABELS + " SELECT CASE WHEN right(sha1(rig), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'dev' ELSE 'test' END AS half, count(*) AS n, round(avg(CASE WHEN j <> 3 AND part <> 'Spine' THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM l GROUP BY 1",
    "labels_raw",
)

QUERIES = {
    "l1_l2_caption_rejection": (rejections, REJECTIONS),
    "l3_l4_clean_and_validate": (answers, ANSWERS),
    "l5_apply_rewrites": (rewrites, REWRITES),
    "l6_normalize_captions": (normalized, NORMALIZED),
    "l7_normalize_locomotion": (locomotion, LOCOMOTION),
    "l9_sync_captions": (synced, SYNCED),
    "l10_parse_category": (categories, CATEGORIES),
    "l11_aggregate_votes": (vote_results, VOTE_RESULTS),
    "l12_label_histogram": (histogram, HISTOGRAM),
    "l13_caption_evidence": (evidence, EVIDENCE),
    "l14_l15_score_categories": (category_scores, CATEGORY_SCORES),
    "k1_k3_vocabulary": (vocabulary, VOCABULARY),
    "k7_k11_k14_label_fixes": (label_fixes, LABEL_FIXES),
    "k20_score_annotation": (accuracy, ACCURACY),
    "k26_candidate_partition": (partitions, PARTITIONS),
}
