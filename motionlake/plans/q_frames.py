"""Queries of the frame-ordered operators, windows and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from .build_clips import rejected, surviving_frames
from .views import load, with_views


def joint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    (positions,) = load(spark, sf_dir, "positions")
    return fr.joint_step(positions).select("clip", "frame", "j", F.round("step", 8).alias("step"))


_STEP = """, st AS (SELECT *, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2) + pow(pz - lag(pz) OVER w, 2)) AS step FROM positions WINDOW w AS (PARTITION BY clip, j ORDER BY frame))"""
JOINT_STEPS = with_views(_STEP + " SELECT clip, frame, j, round(step, 8) AS step FROM st", "positions")


def static_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    (positions,) = load(spark, sf_dir, "positions")
    return fr.trim_static_ends(positions).groupBy("clip").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"))


_TRIM = (
    _STEP
    + """, fa AS (SELECT clip, frame, max(step) AS m FROM st GROUP BY clip, frame),
    en AS (SELECT clip, min(CASE WHEN m > 1e-5 THEN frame - 1 END) AS a, max(CASE WHEN m > 1e-5 THEN frame END) AS b FROM fa GROUP BY clip),
    tr AS (SELECT p.* FROM positions p JOIN en ON en.clip = p.clip AND p.frame BETWEEN a AND b)"""
)
STATIC_ENDS = with_views(_TRIM + " SELECT clip, min(frame) AS first, max(frame) AS last, count(*) AS n FROM tr GROUP BY clip", "positions")


def head_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, clips = load(spark, sf_dir, "frames", "clips")
    out = fr.head_trim(frames, clips.where("user_id % 2 = 0").select("clip", (F.col("user_id") % 80).cast("int").alias("n")))
    return out.groupBy("clip").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("n"))


HEAD_TRIMS = with_views(
    """SELECT f.clip, 0 AS first, max(frame) - t AS last, count(*) AS n FROM frames f JOIN (SELECT clip, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 80 AS INT) ELSE 0 END AS t FROM clips) c ON c.clip = f.clip WHERE frame >= t GROUP BY f.clip, t""",
    "frames",
    "clips",
)


def halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, clips = load(spark, sf_dir, "frames", "clips")
    fps = clips.select("clip", F.element_at(F.array(*(F.lit(x) for x in (24, 60, 119, 120, 240, 479))), (F.col("user_id") % 6 + 1).cast("int")).alias("fps"))
    sized = fps.join(frames.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames")), "clip")
    return fr.downsample_halving(frames, sized).groupBy("clip", "out_fps").agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last"))


HALVING = with_views(
    """, c AS (SELECT clip, [24, 60, 119, 120, 240, 479][CAST(user_id % 6 + 1 AS INT)] AS fps FROM clips), k AS (SELECT clip, fps, CASE WHEN fps < 60 THEN 1 WHEN fps < 120 THEN 2 WHEN fps < 240 THEN 4 WHEN fps < 480 THEN 8 END AS m FROM c)
    SELECT f.clip, fps // m AS out_fps, count(*) AS n, max(frame // m) AS last FROM frames f JOIN k ON k.clip = f.clip WHERE frame % m = 0 GROUP BY f.clip, fps, m""",
    "frames",
    "clips",
)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    holes = frames.select("clip", "frame", F.when(F.col("frame") % 7 < 2, F.col("frame")).alias("facing"))
    return fr.nearest_valid_fill(holes, "facing")


FILLED = with_views(
    """, v AS (SELECT clip, frame FROM frames WHERE frame % 7 < 2), d AS (SELECT f.clip, f.frame, v.frame AS facing, row_number() OVER (PARTITION BY f.clip, f.frame ORDER BY abs(v.frame - f.frame), v.frame) AS k FROM frames f JOIN v ON v.clip = f.clip)
    SELECT clip, frame, facing FROM d WHERE k = 1""",
    "frames",
)


def root_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    moved = frames.select("clip", "frame", F.sin("s").alias("vx"), F.cos(F.col("s") * 2).alias("vz"), (F.col("s") / 3).alias("angle"))
    return fr.integrate_root(moved).select("clip", "frame", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


ROOT_PATHS = with_views(
    """, p AS (SELECT clip, frame, s, coalesce(lag(sin(s)) OVER w, 0) AS vx, coalesce(lag(cos(s * 2)) OVER w, 0) AS vz FROM frames WINDOW w AS (PARTITION BY clip ORDER BY frame))
    SELECT clip, frame, round(sum(vx * cos(s / 3) + vz * sin(s / 3)) OVER w, 6) AS x, round(sum(vz * cos(s / 3) - vx * sin(s / 3)) OVER w, 6) AS z FROM p WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)""",
    "frames",
)


def planted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return fr.runs(frames, F.pmod(F.floor(F.col("s") * 100), F.lit(3)) < 2)


RUNS = with_views(
    """, h AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM frames WHERE (CAST(floor(s * 100) AS BIGINT) % 3 + 3) % 3 < 2)
    SELECT clip, min(frame) AS start, max(frame) + 1 AS "end" FROM h GROUP BY clip, g HAVING count(*) >= 4""",
    "frames",
)


def _soles(frames: DataFrame) -> DataFrame:
    return frames.select("clip", "frame", F.abs(F.sin(F.col("s") * 5)).alias("h"), F.abs(F.cos(F.col("s") * 3)).alias("v"), F.lit(0.9).alias("leg_length"))


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return fr.stance_windows(_soles(frames), 0.8, 0.9)


STANCES = with_views(
    """, s AS (SELECT clip, frame, abs(sin(s * 5)) AS h, abs(cos(s * 3)) AS v FROM frames),
    m AS (SELECT clip, frame, (coalesce(lag(h) OVER w, h) + h + coalesce(lead(h) OVER w, h)) / 3 AS h, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3 AS v FROM s WINDOW w AS (PARTITION BY clip ORDER BY frame)),
    k AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM m WHERE h <= 0.9 * 0.8 AND v <= 0.9 * 0.9)
    SELECT clip, min(frame) AS start, max(frame) + 1 AS "end" FROM k GROUP BY clip, g HAVING count(*) >= 4""",
    "frames",
)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    planted = frames.select("clip", F.expr("frame DIV 9").alias("run"), "frame", F.sin("s").alias("x"), F.cos("s").alias("z"), F.when(F.col("frame") % 5 > 0, F.abs(F.sin(F.col("s") * 7))).alias("error"))
    out = fr.contact_metrics(planted)
    return out.select("clip", "run", "n", *(F.round(c, 8).alias(c) for c in ("median_step", "max_step", "max_error")), "unresolved")


CONTACTS = with_views(
    """, p AS (SELECT clip, CAST(frame // 9 AS BIGINT) AS run, frame, sin(s) AS x, cos(s) AS z, CASE WHEN frame % 5 > 0 THEN abs(sin(s * 7)) END AS e FROM frames),
    q AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY clip, run ORDER BY frame))
    SELECT clip, run, count(*) AS n, round(quantile_cont(d, 0.5), 8) AS median_step, round(max(d), 8) AS max_step, round(max(e), 8) AS max_error, CAST(count_if(e IS NULL) AS BIGINT) AS unresolved FROM q GROUP BY clip, run HAVING count(*) >= 2""",
    "frames",
)


def _timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(_TIMELINES)


_TIMELINES = """SELECT o_custkey AS timeline, row_number() OVER w AS ord, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS prompt,
CAST(coalesce(sum(o_orderkey % 97 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS start,
CAST(sum(o_orderkey % 97 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS `end` FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.validate_timeline(_timelines(spark, sf_dir))


_T = "WITH t AS (" + _TIMELINES.replace("`", '"') + ")"
TIMELINES = (
    _T
    + """, r AS (SELECT *, lag("end") OVER (PARTITION BY timeline ORDER BY ord) AS prev FROM t),
a AS (SELECT timeline, count(*) AS n, bool_or("end" - start NOT BETWEEN 2 AND 600) AS l, bool_or(start <> coalesce(prev, start)) AS g, bool_or(trim(prompt) = '') AS b, max("end") - min(start) AS total FROM r GROUP BY timeline)
SELECT timeline, 'more than 32 clips' AS reason FROM a WHERE n > 32 UNION ALL SELECT timeline, 'a clip''s length' FROM a WHERE l UNION ALL SELECT timeline, 'clips apart or out of order' FROM a WHERE g
UNION ALL SELECT timeline, 'blank prompt' FROM a WHERE b UNION ALL SELECT timeline, 'too long' FROM a WHERE total > 10000"""
)


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timelines(spark, sf_dir)
    return fr.plan_windows(t, 60, 20).select("timeline", "ord", "windows", fr.edit_window_count(F.col("end") - F.col("start"), 60, 40).alias("edit_windows"))


PLANNED = _T + """ SELECT timeline, CAST(ord AS INT) AS ord, CAST(greatest(1, 1 + round_even(("end" - start - CASE WHEN ord = 1 THEN 60 ELSE 40 END) / 40, 0)) AS INT) AS windows, CAST(1 + greatest(0, ceil(("end" - start - 60) / 40)) AS INT) AS edit_windows FROM t"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return frames.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fr.clip_windows(_sizes(spark, sf_dir), 40, 30)
    return out.select(fr.clip_key(F.col("clip"), F.col("segment")).alias("key"), "start", "end")


_WINDOWS = """, sz AS (SELECT clip, CAST(count(*) AS INT) AS t FROM frames GROUP BY clip), k AS (SELECT clip, t, CASE WHEN t <= 40 THEN 0 ELSE (t - 40) // 30 END AS k FROM sz),
e AS (SELECT clip, t, k, unnest(range(0, k + 1)) AS i FROM k),
wi AS (SELECT clip, i AS segment, CASE WHEN t > 40 AND i = k AND i >= 1 AND t > k * 30 + 40 AND t - (k * 30 + 30) < 10 AND (k - 1) * 30 + 40 >= t - 40 THEN t - 40 ELSE i * 30 END AS start, t, k FROM e
UNION ALL SELECT clip, k + 1, k * 30 + 30, t, k FROM k WHERE t > 40 AND t > k * 30 + 40 AND t - (k * 30 + 30) >= 10)
"""
WINDOWS = with_views(_WINDOWS + " SELECT clip || '-' || lpad(CAST(segment AS VARCHAR), 3, '0') AS key, CAST(start AS INT) AS start, CAST(least(start + 40, t) AS INT) AS \"end\" FROM wi", "frames")


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    out = fr.slice_frames(frames, fr.clip_windows(_sizes(spark, sf_dir), 40, 30))
    return out.select("clip", "frame", F.round("s", 9).alias("s"))


SLICED = with_views(_WINDOWS + " SELECT f.clip || '-' || lpad(CAST(segment AS VARCHAR), 3, '0') AS clip, CAST(frame - start AS INT) AS frame, round(s, 9) AS s FROM frames f JOIN wi ON wi.clip = f.clip AND frame >= start AND frame < least(start + 40, t)", "frames")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, rigs = load(spark, sf_dir, "clips", "rigs")
    ok, _ = fr.joint_count_gate(rigs, 2, 6)
    out = fr.select_clips(clips, clips.where("user_id % 5 = 0").select("clip"), rigs.where("r % 7 = 0").select("rig"))
    return out.join(ok.select("rig"), "rig", "left_semi").select("clip", "rig", "n_joints")


CHOSEN = with_views("SELECT clip, c.rig, c.n_joints FROM clips c JOIN rigs g ON g.rig = c.rig WHERE user_id % 5 <> 0 AND r % 7 <> 0 AND c.n_joints BETWEEN 2 AND 6", "clips", "rigs")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    (positions,) = load(spark, sf_dir, "positions")
    m = fr.activity_metrics(positions)
    return m.select("clip", *(F.round(c, 7).alias(c) for c in ("root", "mean", "top")))


_ACTIVITY = """, re AS (SELECT p.clip, p.j, CASE WHEN p.j = 0 THEN p.px ELSE p.px - r.px END AS x, CASE WHEN p.j = 0 THEN p.py ELSE p.py - r.py END AS y, CASE WHEN p.j = 0 THEN p.pz ELSE p.pz - r.pz END AS z FROM {p} p JOIN {p} r ON r.clip = p.clip AND r.frame = p.frame AND r.j = 0),
sp AS (SELECT clip, j, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS s FROM re GROUP BY clip, j),
rk AS (SELECT clip, s, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip ORDER BY s DESC) AS k FROM sp WHERE j > 0),
ac AS (SELECT a.clip, a.s AS root, avg(rk.s) AS mean, avg(CASE WHEN k <= least(greatest(2, round_even(n / 4, 0)), n) THEN rk.s END) AS top FROM sp a LEFT JOIN rk ON rk.clip = a.clip WHERE a.j = 0 GROUP BY a.clip, a.s)"""
ACTIVITY = with_views(_ACTIVITY.format(p="positions") + " SELECT clip, round(root, 7) AS root, round(mean, 7) AS mean, round(top, 7) AS top FROM ac", "positions")


def low_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions, clips = load(spark, sf_dir, "positions", "clips")
    return fr.low_activity_gate(fr.activity_metrics(positions), clips.where("user_id % 3 = 0").select("clip"), 1.0)


LOW_ACTIVITY = with_views(_ACTIVITY.format(p="positions") + " SELECT ac.clip, 'low activity' AS reason FROM ac JOIN clips c ON c.clip = ac.clip WHERE coalesce(top, 0) < 1.0 AND root < 1.0 AND user_id % 3 <> 0", "positions", "clips")


def discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    (positions,) = load(spark, sf_dir, "positions")
    m = fr.discontinuity_metrics(positions)
    gate = fr.discontinuity_gate(m, 0.05, 3.0)
    return m.join(gate, "clip", "left").select("clip", F.round("median", 7).alias("median"), F.round("max", 7).alias("max"), "n_jumps", "reason")


DISCONTINUITY = with_views(
    _STEP
    + """, bx AS (SELECT clip, greatest(max(px) - min(px), max(py) - min(py), max(pz) - min(pz)) AS e FROM positions GROUP BY clip),
    fs AS (SELECT st.clip, frame, avg(step) / any_value(greatest(e, 1e-9)) AS s FROM st JOIN bx ON bx.clip = st.clip WHERE step IS NOT NULL GROUP BY st.clip, frame),
    md AS (SELECT clip, quantile_cont(s, 0.5) AS m, max(s) AS x FROM fs GROUP BY clip)
    SELECT md.clip, round(m, 7) AS median, round(x, 7) AS max, CAST(count_if(s > greatest(6 * m, 0.05)) AS BIGINT) AS n_jumps, CASE WHEN x >= 0.05 AND (m <= 1e-9 OR x / m >= 3.0) THEN 'discontinuity' END AS reason FROM fs JOIN md ON md.clip = fs.clip GROUP BY md.clip, m, x""",
    "positions",
)


def rest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    (frames,) = load(spark, sf_dir, "frames")
    return fr.remove_rest_frames(frames.select("clip", "frame", F.abs(F.sin("s") * 3).alias("angle"))).groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"))


REST_FRAMES = with_views(
    """, a AS (SELECT clip, frame, abs(sin(s) * 3) AS angle FROM frames), k AS (SELECT *, count_if(angle >= 1) OVER (PARTITION BY clip) AS n FROM a)
    SELECT clip, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames FROM k WHERE n < 2 OR angle >= 1 GROUP BY clip""",
    "frames",
)


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions, documents = load(spark, sf_dir, "captions", "documents")
    clips = documents.select(F.concat("source", F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("clip"), F.when(F.col("doc_id") % 4 > 0, 30 + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)).alias("fps"))
    kept = fr.caption_required(clips, captions.where("lang <> 'en'"))
    return kept.join(fr.fps_gate(kept), "clip", "left").select("clip", "status")


CAPTIONED = with_views("SELECT clip, CASE WHEN d.doc_id % 4 = 0 THEN 'assumed' WHEN d.doc_id % 9 = 0 THEN 'error' END AS status FROM captions c JOIN documents d ON c.clip = d.source || '-' || lpad(CAST(d.doc_id AS VARCHAR), 6, '0') WHERE c.lang <> 'en'", "captions")


def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    (positions,) = load(spark, sf_dir, "positions")
    return fr.root_travel(fr.ground_clip(positions), F.lit(1.7))


TRAVEL = with_views(
    """, r AS (SELECT clip, min_by(px, frame) AS ax, min_by(pz, frame) AS az, max_by(px, frame) AS bx, max_by(pz, frame) AS bz FROM positions WHERE j = 0 AND frame < 200 GROUP BY clip)
    SELECT clip, round_even(sqrt(pow(bx - ax, 2) + pow(bz - az, 2)) / 1.7, 3) AS net FROM r""",
    "positions",
)

_PLACED = """, c0 AS (SELECT p.clip, any_value(user_id) AS u, any_value(c.n_joints) AS nj, max(frame) + 1 AS nf FROM positions p JOIN clips c ON c.clip = p.clip WHERE user_id % 11 <> 0 AND user_id % 13 <> 0 GROUP BY p.clip),
c1 AS (SELECT *, CASE WHEN u % 17 = 0 THEN 500 WHEN u % 6 = 1 THEN u % 7 ELSE 0 END AS cut, CASE WHEN u % 5 = 2 THEN 4 ELSE 1 END AS m FROM c0),
c2 AS (SELECT *, CASE WHEN nj < 2 THEN 'too few joints' WHEN nj > 6 THEN 'too many joints' WHEN u % 7 = 3 THEN 'no caption' WHEN cut >= nf THEN 'head trim takes all' END AS reason FROM c1),
th AS (SELECT p.clip, p.rig, CAST((frame - cut) // m AS INT) AS frame, j, px, py, pz, u, nj FROM positions p JOIN c2 ON c2.clip = p.clip WHERE reason IS NULL AND frame >= cut AND (frame - cut) % m = 0),
f0 AS (SELECT clip, any_value(u) AS u, any_value(nj) AS nj, max(px) FILTER (j = 0) AS rx, max(pz) FILTER (j = 0) AS rz, max(pz) FILTER (j = 1) - max(pz) FILTER (j = 2) AS fx, max(px) FILTER (j = 2) - max(px) FILTER (j = 1) AS fz FROM th WHERE frame = 0 GROUP BY clip),
f1 AS (SELECT clip, rx, rz, CASE WHEN u % 2 = 0 THEN 0.5 ELSE 1.0 END AS k, CASE WHEN nj >= 3 AND sqrt(fx * fx + fz * fz) >= 1e-6 THEN fx / sqrt(fx * fx + fz * fz) ELSE 0 END AS fx, CASE WHEN nj >= 3 AND sqrt(fx * fx + fz * fz) >= 1e-6 THEN fz / sqrt(fx * fx + fz * fz) ELSE 1 END AS fz FROM f0),
placed AS (SELECT th.clip, rig, frame, j, ((px - rx) * fz - (pz - rz) * fx) * k AS px, py * k AS py, ((px - rx) * fx + (pz - rz) * fz) * k AS pz FROM th JOIN f1 ON f1.clip = th.clip)"""
_SURVIVE = (
    _PLACED
    + _TRIM.replace("positions", "placed")
    + """, sa AS (SELECT c2.clip, max(frame) + 1 AS t, count(DISTINCT frame) AS n FROM c2 LEFT JOIN tr ON tr.clip = c2.clip WHERE reason IS NULL GROUP BY c2.clip),
sz AS (SELECT clip, CAST(t AS INT) AS t FROM sa WHERE n >= 8), k AS (SELECT clip, t, CASE WHEN t <= 40 THEN 0 ELSE (t - 40) // 30 END AS k FROM sz),
e AS (SELECT clip, t, k, unnest(range(0, k + 1)) AS i FROM k),
wi AS (SELECT clip, i AS segment, CASE WHEN t > 40 AND i = k AND i >= 1 AND t > k * 30 + 40 AND t - (k * 30 + 30) < 10 AND (k - 1) * 30 + 40 >= t - 40 THEN t - 40 ELSE i * 30 END AS start, t, k FROM e
UNION ALL SELECT clip, k + 1, k * 30 + 30, t, k FROM k WHERE t > 40 AND t > k * 30 + 40 AND t - (k * 30 + 30) >= 10),
sl AS (SELECT p.clip || '-' || lpad(CAST(segment AS VARCHAR), 3, '0') AS clip, p.clip AS stem, rig, frame - start AS frame, j, px, py, pz FROM tr p JOIN wi ON wi.clip = p.clip AND frame >= start AND frame < least(start + 40, t))"""
    + _ACTIVITY.format(p="sl")
    + """, ss AS (SELECT *, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2) + pow(pz - lag(pz) OVER w, 2)) AS step FROM sl WINDOW w AS (PARTITION BY clip, j ORDER BY frame)),
bx AS (SELECT clip, any_value(stem) AS stem, any_value(rig) AS rig, count(DISTINCT frame) AS n, greatest(max(px) - min(px), max(py) - min(py), max(pz) - min(pz)) AS e FROM sl GROUP BY clip),
fs AS (SELECT ss.clip, frame, avg(step) / any_value(greatest(e, 1e-9)) AS s FROM ss JOIN bx ON bx.clip = ss.clip WHERE step IS NOT NULL GROUP BY ss.clip, frame),
md AS (SELECT clip, quantile_cont(s, 0.5) AS m, max(s) AS x FROM fs GROUP BY clip),
jd AS (SELECT bx.clip, rig, n, CASE WHEN coalesce(top, 0) < 0.02 AND root < 0.02 AND u % 3 <> 0 THEN 'low activity' WHEN x >= 0.2 AND (md.m <= 1e-9 OR x / md.m >= 8.0) THEN 'discontinuity' END AS reason FROM bx JOIN c2 ON c2.clip = bx.stem JOIN ac ON ac.clip = bx.clip LEFT JOIN md ON md.clip = bx.clip)"""
)
SURVIVING = with_views(_SURVIVE + " SELECT rig, count(*) AS clips, CAST(sum(n) AS BIGINT) AS frames FROM jd WHERE reason IS NULL GROUP BY rig", "positions", "clips")
LEDGER = with_views(
    _SURVIVE + """ SELECT clip, CASE WHEN reason LIKE 'too%' THEN 'joints' WHEN reason LIKE 'no%' THEN 'captions' ELSE 'head' END AS stage, reason FROM c2 WHERE reason IS NOT NULL
    UNION ALL SELECT clip, 'frames', 'too few frames' FROM sa WHERE n < 8 UNION ALL SELECT clip, CASE WHEN reason LIKE 'low%' THEN 'activity' ELSE 'discontinuity' END, reason FROM jd WHERE reason IS NOT NULL""",
    "positions",
    "clips",
)

QUERIES = {
    "f16_surviving_frames": (surviving_frames, SURVIVING),
    "f15_reject_ledger": (rejected, LEDGER),
    "e1_joint_step": (joint_steps, JOINT_STEPS),
    "e2_trim_static_ends": (static_ends, STATIC_ENDS),
    "e3_head_trim": (head_trims, HEAD_TRIMS),
    "e4_downsample_halving": (halving, HALVING),
    "e5_nearest_valid_fill": (filled, FILLED),
    "e6_integrate_root": (root_paths, ROOT_PATHS),
    "e7_runs": (planted_runs, RUNS),
    "e8_stance_windows": (stances, STANCES),
    "e9_contact_metrics": (contacts, CONTACTS),
    "e10_validate_timeline": (timelines, TIMELINES),
    "e11_e12_plan_windows": (planned, PLANNED),
    "f1_f4_clip_windows": (windows, WINDOWS),
    "f5_slice_frames": (sliced, SLICED),
    "f6_f7_select_clips": (chosen, CHOSEN),
    "f8_activity_metrics": (activity, ACTIVITY),
    "f9_low_activity_gate": (low_activity, LOW_ACTIVITY),
    "f10_f11_discontinuity": (discontinuity, DISCONTINUITY),
    "f13_remove_rest_frames": (rest_frames, REST_FRAMES),
    "f18_f19_caption_and_fps": (captioned, CAPTIONED),
    "g13_g14_root_travel": (travel, TRAVEL),
}
