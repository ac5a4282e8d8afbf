"""Queries of facing pairs, name maps, curation lists, audits, patches and changed trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import captions as c
from ..operators import frames as fr
from ..operators import motion as m
from ..operators import review as r
from ..operators import topology, training
from ..operators import trees as t
from .q_captions import _LABELS, _labels
from .q_trees import _UP
from .views import load, with_views

PARTS = ["UpLeg", "Leg", "Arm", "Spine"]
RANKS = [("UpLeg", 1), ("Arm", 2), ("Leg", 3)]


def _last(column: str = "rig"):
    """The last digit of a rig's SHA-1, by which the queries pick some of them."""
    return F.substring(F.sha1(column), -1, 1)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.select_face_pair(_labels(spark, sf_dir), spark.createDataFrame(RANKS, "part string, rank int"))


_PAIRS = """, d AS (SELECT rig, j, CASE WHEN label LIKE 'Right %' THEN 'right' WHEN label LIKE 'Left %' THEN 'left' END AS side, part, regexp_extract_all(raw, '[0-9]+') AS d FROM l),
e AS (SELECT *, array_to_string(d, '.') AS digits, array_to_string(d[1 : len(d) - 1], '.') AS short FROM d),
b AS (SELECT x.rig, x.part, x.j AS r, y.j AS l, CASE x.part WHEN 'UpLeg' THEN 1 WHEN 'Arm' THEN 2 WHEN 'Leg' THEN 3 ELSE 4 END AS rank, CASE WHEN x.digits = y.digits THEN 0 WHEN x.short = y.short THEN 1 ELSE 2 END AS m
  FROM e x JOIN e y ON y.rig = x.rig AND y.part = x.part AND x.side = 'right' AND y.side = 'left'),
fp AS (SELECT rig, part, r AS "right", l AS "left" FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY rank, part, m, r, l) AS k FROM b) WHERE k = 1)"""


def axis_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.body_axis_pair(_labels(spark, sf_dir), "Arm$", "Spine")


AXIS_PAIRS = with_views(_LABELS + " SELECT rig, max(j) FILTER (part LIKE '%Arm') AS head, max(j) FILTER (part = 'Spine') AS tail, true AS body_axis FROM l GROUP BY rig HAVING head IS NOT NULL AND tail IS NOT NULL", "labels_raw")


def patched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    overrides = labels.where((F.col("j") == 1) & (_last() == "0")).select("rig", F.col("j").alias("right"), F.lit(0).alias("left"))
    return r.patch_face_pairs(_pairs(spark, sf_dir).withColumn("source", F.lit("rule")), overrides, labels)


PATCHED_PAIRS = with_views(
    _LABELS + _PAIRS
    + """, o AS (SELECT rig FROM l WHERE j = 1 AND right(sha1(rig), 1) = '0'),
    p AS (SELECT fp.rig, CASE WHEN o.rig IS NULL THEN "right" ELSE 1 END AS "right", CASE WHEN o.rig IS NULL THEN "left" ELSE 0 END AS "left", CASE WHEN o.rig IS NULL THEN 'rule' ELSE 'override' END AS source FROM fp LEFT JOIN o ON o.rig = fp.rig)
    SELECT p.rig, "right", "left", a.label AS right_label, b.label AS left_label, source FROM p LEFT JOIN l a ON a.rig = p.rig AND a.j = "right" LEFT JOIN l b ON b.rig = p.rig AND b.j = "left\"""",
    "labels_raw",
)


def face_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    first = labels.where("j = 0").select("rig", F.col("raw").alias("right"))
    second = labels.where("j = 1").select("rig", F.col("raw").alias("left"))
    left = F.when(_last() == "1", "Nobody").when(_last() == "2", F.col("right")).otherwise(F.coalesce("left", F.lit("Nobody")))
    return r.validate_face_answers(first.join(second, "rig", "left").withColumn("left", left), labels)


FACE_ANSWERS = with_views(
    _LABELS + """, a AS (SELECT x.rig, x.raw AS rr, x.label AS rl, CASE right(sha1(x.rig), 1) WHEN '1' THEN 'Nobody' WHEN '2' THEN x.raw ELSE coalesce(y.raw, 'Nobody') END AS lr FROM l x LEFT JOIN l y ON y.rig = x.rig AND y.j = 1 WHERE x.j = 0),
    n AS (SELECT rig, raw, min(label) AS label FROM l GROUP BY rig, raw)
    SELECT a.rig, CASE WHEN n.label IS NULL THEN 'unknown name' WHEN rr = lr THEN 'same joint' WHEN rl LIKE 'Left %' AND n.label LIKE 'Right %' THEN 'sides swapped' END AS reason FROM a LEFT JOIN n ON n.rig = a.rig AND n.raw = lr""",
    "labels_raw",
)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(_last() < "8", "rule").otherwise("model")
    return r.annotation_coverage(_pairs(spark, sf_dir).withColumn("source", source), _labels(spark, sf_dir), PARTS)


COVERAGE = with_views(
    _LABELS + _PAIRS + """ SELECT 'source' AS kind, CASE WHEN right(sha1(rig), 1) < '8' THEN 'rule' ELSE 'model' END AS name, count(*) AS n FROM fp GROUP BY 2
    UNION ALL SELECT 'label', label, count(*) FROM l WHERE part NOT IN ('UpLeg', 'Leg', 'Arm', 'Spine') GROUP BY label""",
    "labels_raw",
)


def curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, clips = load(spark, sf_dir, "frames", "clips")
    sizes = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"))
    u = F.col("user_id")
    entries = clips.select(F.col("clip").alias("key"), (u % 50).alias("n"), u.alias("line"))
    entries = entries.union(clips.where(u % 4 == 0).select("clip", u % 90, u + 1_000_000)).union(clips.where(u % 5 == 0).select(F.concat(F.lit("x"), "clip"), u % 7, u))
    return r.curation_lists(entries, sizes)


CURATION = with_views(
    """, s AS (SELECT clip, count(*) AS n_frames FROM frames GROUP BY clip),
    e AS (SELECT clip AS key, user_id % 50 AS n, user_id AS line FROM clips UNION ALL SELECT clip, user_id % 90, user_id + 1000000 FROM clips WHERE user_id % 4 = 0 UNION ALL SELECT 'x' || clip, user_id % 7, user_id FROM clips WHERE user_id % 5 = 0),
    k AS (SELECT key, arg_max(n, line) AS n, count(*) AS times FROM e GROUP BY key)
    SELECT key, n, CASE WHEN n_frames IS NULL THEN 'unknown' WHEN n >= n_frames THEN 'leaves no frames' WHEN times > 1 THEN 'repeated' ELSE 'ok' END AS status FROM k LEFT JOIN s ON s.clip = k.key""",
    "frames",
    "clips",
)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return joints.select("rig", "j", F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    return r.mirror_conflicts(_labels(spark, sf_dir).join(_placed(spark, sf_dir), ["rig", "j"]).join(joints.select("rig", "j", "parent"), ["rig", "j"]), _pairs(spark, sf_dir))


_CONFLICTS = _LABELS + _PAIRS + """, ax AS (SELECT fp.rig, a.ox - b.ox AS x, a.oz - b.oz AS z FROM fp JOIN joints a ON a.rig = fp.rig AND a.j = "right" JOIN joints b ON b.rig = fp.rig AND b.j = "left"),
sl AS (SELECT e.rig, e.j, p.parent, e.side, e.part, ox, oz FROM e JOIN joints p ON p.rig = e.rig AND p.j = e.j),
lh AS (WITH RECURSIVE a AS (SELECT s.rig, s.j, s.j AS head, s.side FROM sl s LEFT JOIN sl q ON q.rig = s.rig AND q.j = s.parent WHERE s.side IS NOT NULL AND q.side IS DISTINCT FROM s.side
  UNION ALL SELECT a.rig, s.j, a.head, a.side FROM a JOIN sl s ON s.rig = a.rig AND s.parent = a.j AND s.side = a.side) SELECT * FROM a),
li AS (SELECT h.rig, h.side, h.head, max(s.part) FILTER (s.j = h.head) AS part, avg(ox) AS x, avg(oz) AS z FROM lh h JOIN sl s ON s.rig = h.rig AND s.j = h.j GROUP BY h.rig, h.side, h.head),
lm AS (SELECT rig, part, max(x) FILTER (side = 'right') - max(x) FILTER (side = 'left') AS x, max(z) FILTER (side = 'right') - max(z) FILTER (side = 'left') AS z FROM li GROUP BY rig, part HAVING count(*) FILTER (side = 'right') = 1 AND count(*) FILTER (side = 'left') = 1),
bx AS (SELECT rig, greatest(max(ox) - min(ox), max(oy) - min(oy), max(oz) - min(oz)) AS extent FROM joints GROUP BY rig),
mc AS (SELECT lm.rig, count(*) AS judged, count_if((lm.x * ax.x + lm.z * ax.z) / sqrt(ax.x * ax.x + ax.z * ax.z) / sqrt(lm.x * lm.x + lm.z * lm.z) < -0.5) AS conflicts FROM lm JOIN ax ON ax.rig = lm.rig JOIN bx ON bx.rig = lm.rig
  WHERE sqrt(ax.x * ax.x + ax.z * ax.z) >= 1e-8 AND sqrt(lm.x * lm.x + lm.z * lm.z) > 0 AND sqrt(lm.x * lm.x + lm.z * lm.z) >= 0.02 * CASE WHEN extent > 0 THEN extent ELSE 1 END GROUP BY lm.rig)"""
CONFLICTS = with_views(_CONFLICTS + " SELECT *, judged >= 2 AND conflicts * 2 > judged AS flagged FROM mc", "labels_raw", "joints")


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    rigs = labels.select("rig").distinct()
    out = r.review_flags(labels.select("rig", "j", "label"), PARTS, conflicts(spark, sf_dir), rigs.where(_last() == "2"), rigs.where(_last() == "3"))
    return out.select("rig", "j", F.array_join("reasons", "|").alias("reasons"))


REVIEW = with_views(
    _CONFLICTS + """, q AS (SELECT l.rig, l.j, concat_ws('|', CASE WHEN right(sha1(l.rig), 1) <> '3' AND label = 'Bone' THEN 'placeholder' END, CASE WHEN right(sha1(l.rig), 1) <> '3' AND label <> 'Bone' AND part NOT IN ('UpLeg', 'Leg', 'Arm', 'Spine') THEN 'not in the vocabulary' END,
    CASE WHEN judged >= 2 AND conflicts * 2 > judged AND regexp_matches(label, '^(?:Left|Right) ') THEN 'mirror conflict' END, CASE WHEN l.j = 0 AND right(sha1(l.rig), 1) = '2' THEN 'weak pair' END) AS reasons FROM l LEFT JOIN mc ON mc.rig = l.rig)
    SELECT * FROM q WHERE reasons <> ''""",
    "labels_raw",
    "joints",
)


def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = _placed(spark, sf_dir)
    gone = F.when(_last() == "4", 0.0).otherwise(1.0)
    rest = rest.select("rig", "j", *((F.col(a) * gone).alias(a) for a in "xyz"))
    first = rest.where(_last() != "5").select("rig", "j", *((F.col(a) + F.when(_last() == "4", F.col("j") % 2).otherwise(0.0)).alias(a) for a in "xyz"))
    return r.face_separation_audit(_pairs(spark, sf_dir), rest, first).select("rig", F.round("rest", 6).alias("rest"), F.round("first", 6).alias("first"), "flag")


SEPARATION = with_views(
    _LABELS + _PAIRS + """, z AS (SELECT fp.rig, right(sha1(fp.rig), 1) AS h, sqrt(pow(a.ox - b.ox, 2) + pow(a.oy - b.oy, 2) + pow(a.oz - b.oz, 2)) AS d, sqrt(3) * abs("right" % 2 - "left" % 2) AS o FROM fp JOIN joints a ON a.rig = fp.rig AND a.j = "right" JOIN joints b ON b.rig = fp.rig AND b.j = "left"),
    w AS (SELECT rig, CASE WHEN h = '4' THEN 0.0 ELSE d END AS rest, CASE WHEN h = '4' THEN o WHEN h <> '5' THEN d END AS first FROM z)
    SELECT rig, round(rest, 6) AS rest, round(first, 6) AS first, CASE WHEN first IS NULL THEN 'unresolved' WHEN rest < 1e-6 AND first < 1e-6 THEN 'coincident' WHEN rest < 1e-6 THEN 'degenerate rest' END AS flag FROM w""",
    "labels_raw",
    "joints",
)

_SIGNED = _UP + ", tn AS (SELECT n.rig, n.j, n.parent, depth, regexp_replace(raw, '_[0-9]+$', '') AS name FROM labels_raw n JOIN dp ON dp.rig = n.rig AND dp.j = n.j), " + ", ".join(
    f"s{k} AS (SELECT tn.rig, tn.j, tn.parent, sha1(name || '(' || "
    + (f"coalesce(string_agg(c.sig, ',' ORDER BY c.sig), '') || ')') AS sig FROM tn LEFT JOIN s{k + 1} c ON c.rig = tn.rig AND c.parent = tn.j WHERE depth = {k} GROUP BY tn.rig, tn.j, tn.parent, name)" if k < 7 else f"')') AS sig FROM tn WHERE depth = {k})")
    for k in range(7, -1, -1)
) + ", sg AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(8)) + "), tp AS (SELECT rig, string_agg(sig, ',' ORDER BY sig) AS template FROM sg WHERE parent < 0 GROUP BY rig)"


def _named(spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw", given=given)
    label = F.regexp_replace(F.regexp_replace("raw", r"_\d+$", ""), "^(Left|Right)", "$1 ")
    label = F.when((_last() == "6") & (F.col("j") == 1), "Odd").otherwise(label)
    return raw.select("rig", "j", "parent", F.regexp_replace("raw", "_[0-9]+$", "").alias("name"), "raw", label.alias("label"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tree_template_key(_named(spark, sf_dir))


TEMPLATES = with_views(_SIGNED + " SELECT rig, template FROM tp", "labels_raw")

_MAPPED = _SIGNED + """, ps AS (WITH RECURSIVE a AS (SELECT rig, j, sig AS path FROM sg WHERE parent < 0 UNION ALL SELECT sg.rig, sg.j, a.path || '/' || sg.sig FROM a JOIN sg ON sg.rig = a.rig AND sg.parent = a.j) SELECT rig, j, sha1(path) AS position FROM a),
lb AS (SELECT ps.rig, ps.j, template, position, raw, lower(regexp_replace(raw, '[_0-9]+$', '')) AS bone, CASE WHEN right(sha1(ps.rig), 1) = '6' AND ps.j = 1 THEN 'Odd' ELSE regexp_replace(regexp_replace(raw, '_[0-9]+$', ''), '^(Left|Right)', '\\1 ') END AS label FROM ps JOIN tp ON tp.rig = ps.rig JOIN labels_raw r ON r.rig = ps.rig AND r.j = ps.j),
tc AS (SELECT template, position, label, count(*) AS n FROM lb GROUP BY ALL), tx AS (SELECT *, max(n) OVER (PARTITION BY template, position) AS top FROM tc),
tm AS (SELECT template, position, CASE WHEN count(*) = 1 THEN max(label) END AS label FROM tx WHERE n = top GROUP BY template, position),
nc AS (SELECT bone, label, count(*) AS n FROM lb GROUP BY ALL), nm AS (SELECT bone, label FROM (SELECT *, n / sum(n) OVER (PARTITION BY bone) AS share FROM nc) WHERE share >= 0.9)"""


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.placed_joints(_named(spark, sf_dir))
    return r.apply_name_map(rows, *r.learn_name_map(rows), F.col("label") == "Odd")


MAPPED = with_views(
    _MAPPED + """ SELECT lb.rig, lb.j, CASE WHEN tm.label IS NOT NULL THEN tm.label WHEN lb.label = 'Odd' AND nm.label IS NOT NULL THEN nm.label ELSE lb.label END AS label, CASE WHEN tm.label IS NOT NULL THEN 'template' WHEN lb.label = 'Odd' AND nm.label IS NOT NULL THEN 'name' ELSE 'own' END AS source
    FROM lb LEFT JOIN tm ON tm.template = lb.template AND tm.position = lb.position LEFT JOIN nm ON nm.bone = lb.bone""",
    "labels_raw",
)


def _lengths(spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints", given=given)
    return joints.select("rig", "j", "parent", F.sqrt(F.col("ox") ** 2 + F.col("oy") ** 2 + F.col("oz") ** 2).alias("length"))


def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.bfs_reorder(_lengths(spark, sf_dir))


REORDERED = with_views(
    _UP + """, sz AS (SELECT rig, anc AS j, count(*) AS size FROM up GROUP BY rig, anc),
    rk AS (SELECT n.rig, n.j, n.parent, row_number() OVER (PARTITION BY n.rig, n.parent ORDER BY size DESC, sqrt(ox * ox + oy * oy + oz * oz), n.j) AS place FROM joints n JOIN sz ON sz.rig = n.rig AND sz.j = n.j),
    pt AS (WITH RECURSIVE a AS (SELECT rig, j, parent, [place] AS path FROM rk WHERE parent < 0 UNION ALL SELECT rk.rig, rk.j, rk.parent, list_append(a.path, rk.place) FROM a JOIN rk ON rk.rig = a.rig AND rk.parent = a.j) SELECT * FROM a),
    nw AS (SELECT rig, j, parent, row_number() OVER (PARTITION BY rig ORDER BY len(path), path) - 1 AS new FROM pt)
    SELECT nw.rig, nw.j, nw.new, coalesce(u.new, -1) AS new_parent FROM nw LEFT JOIN nw u ON u.rig = nw.rig AND u.j = nw.parent""",
    "joints",
)


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir).join(_named(spark, sf_dir).select("rig", "j", "name"), ["rig", "j"])
    out = t.topology_condition(rows)
    return out.select("rig", "n_joints", "template", F.array_max(F.transform("joints", lambda x: x["depth"])).alias("depth"), F.size("chains").alias("chains"), F.array_join(F.transform("joints", lambda x: x["name"]), "/").alias("names"), F.col("diameter").isNotNull().alias("has_diameter"))


CONDITIONS = with_views(
    _SIGNED + """, lf AS (SELECT rig, count(*) AS chains FROM (SELECT rig, j FROM joints WHERE j NOT IN (SELECT parent FROM joints k WHERE k.rig = joints.rig)) GROUP BY rig)
    SELECT tp.rig, count(*) AS n_joints, template, max(tn.depth) AS depth, max(chains) AS chains, string_agg(tn.name, '/' ORDER BY tn.j) AS names, count(*) > 1 AS has_diameter FROM tn JOIN tp ON tp.rig = tn.rig JOIN lf ON lf.rig = tn.rig GROUP BY tp.rig, template""",
    "labels_raw",
    "joints",
)


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bones of the frames' joints as capsules; pairs more than two joints apart."""
    positions, joints = load(spark, sf_dir, "positions", "joints")
    at = positions.select("clip", "rig", "frame", "j", *(F.col(p).alias(p[1]) for p in fr.AXES))
    up = joints.where("parent >= 0").select("rig", "j", "parent")
    ends = at.join(up, ["rig", "j"]).join(at.select("clip", "frame", F.col("j").alias("parent"), *(F.col(a).alias(f"a{a}") for a in "xyz")), ["clip", "frame", "parent"])
    capsules = ends.select("clip", "rig", "frame", "j", *(f"a{a}" for a in "xyz"), *(F.col(a).alias(f"b{a}") for a in "xyz"), F.lit(0.1).alias("radius"))
    far = t.joint_pairs(joints).where("distance > 2 AND a < b").select("rig", "a", "b")
    out = r.capsule_overlap_audit(capsules, far)
    return out.select("clip", "frame", F.round("depth", 5).alias("depth"))


def _nearest(source: str) -> str:
    for name, value in r.NEAREST:
        source = f"(SELECT *, {value} AS {name} FROM {source})"
    return source


OVERLAPS = with_views(
    _UP + """, c AS (SELECT x.rig, x.j AS a, y.j AS b, max(dp.depth) AS m FROM up x JOIN up y ON y.rig = x.rig AND y.anc = x.anc AND x.j < y.j JOIN dp ON dp.rig = x.rig AND dp.j = x.anc GROUP BY ALL),
    fa AS (SELECT c.rig, a, b FROM c JOIN dp p ON p.rig = c.rig AND p.j = a JOIN dp q ON q.rig = c.rig AND q.j = b WHERE p.depth + q.depth - 2 * m > 2),
    cp AS (SELECT x.clip, x.rig, x.frame, x.j, y.px AS ax, y.py AS ay, y.pz AS az, x.px AS bx, x.py AS by, x.pz AS bz FROM positions x JOIN joints n ON n.rig = x.rig AND n.j = x.j AND n.parent >= 0 JOIN positions y ON y.clip = x.clip AND y.frame = x.frame AND y.j = n.parent),
    pp AS (SELECT x.clip, x.frame, x.ax AS a_ax, x.ay AS a_ay, x.az AS a_az, x.bx AS a_bx, x.by AS a_by, x.bz AS a_bz, y.ax AS b_ax, y.ay AS b_ay, y.az AS b_az, y.bx AS b_bx, y.by AS b_by, y.bz AS b_bz FROM cp x JOIN fa ON fa.rig = x.rig AND fa.a = x.j JOIN cp y ON y.clip = x.clip AND y.frame = x.frame AND y.j = fa.b)
    SELECT clip, frame, round(max(0.2 - apart), 5) AS depth FROM """ + _nearest("pp") + " WHERE apart < 0.2 GROUP BY clip, frame",
    "positions",
    "joints",
)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, joints = load(spark, sf_dir, "frames", "joints")
    rows = frames.join(joints.select("rig", "j", "parent"), "rig")
    k = F.col("s") * (F.col("j") + 1)
    return rows.select("clip", "frame", "j", "parent", g.qunit(g.quat(F.lit(1.0), k * 0.1, F.col("s"), -k * 0.2)).alias("q"))


_TURNS = """, k0 AS (SELECT f.clip, f.frame, n.j, n.parent, s, s * (n.j + 1) AS k FROM frames f JOIN joints n ON n.rig = f.rig),
tq AS (SELECT clip, frame, j, parent, 1 / h AS w, k * 0.1 / h AS x, s / h AS y, -k * 0.2 / h AS z FROM (SELECT *, sqrt(1 + pow(k * 0.1, 2) + s * s + pow(k * 0.2, 2)) AS h FROM k0))"""


def _times(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """SQL of a product of two quaternions."""
    (w, x, y, z), (p, q, s, u) = a, b
    return (
        f"({w}*{p} - {x}*{q} - {y}*{s} - {z}*{u})", f"({w}*{q} + {x}*{p} + {y}*{u} - {z}*{s})", f"({w}*{s} - {x}*{u} + {y}*{p} + {z}*{q})", f"({w}*{u} + {x}*{s} - {y}*{q} + {z}*{p})",
    )


def _four(prefix: str, inverse: bool = False) -> tuple[str, ...]:
    return tuple(f"{'-' if inverse and k != 'w' else ''}{prefix}{k}" for k in "wxyz")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("clip", "frame", "j", *(F.round(F.col(f"q.{k}"), 6).alias(k) for k in "wxyz"))


def realigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(m.realign_clip(_turns(spark, sf_dir)))


REALIGNED = with_views(
    _TURNS + ", q0 AS (SELECT clip, w AS fw, x AS fx, y AS fy, z AS fz FROM tq WHERE parent < 0 AND frame = 0) SELECT tq.clip, frame, j, "
    + ", ".join(f"round(CASE WHEN parent < 0 THEN {a} WHEN parent = 0 THEN {b} ELSE {k} END, 6) AS {k}" for k, a, b in zip("wxyz", _times(_four(""), _four("f", True)), _times(_four("f"), _four("")), strict=True))
    + " FROM tq JOIN q0 ON q0.clip = tq.clip",
    "frames",
    "joints",
)


def offset_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    patches = turns.select("clip").distinct().where(_last("clip") < "8").withColumn("offset", g.quat(F.lit(0.6), F.lit(0.0), F.lit(0.8), F.lit(0.0)))
    return _flat(m.root_offset_patch(turns, patches))


OFFSET_ROOTS = with_views(
    _TURNS + " SELECT clip, frame, j, " + ", ".join(f"round(CASE WHEN parent < 0 AND right(sha1(clip), 1) < '8' THEN {a} ELSE {k} END, 6) AS {k}" for k, a in zip("wxyz", _times(_four(""), ("0.6", "0", "0.8", "0")), strict=True)) + " FROM tq",
    "frames",
    "joints",
)


def turned_rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn about the vertical, and a shift, of some rigs' roots."""
    (joints,) = load(spark, sf_dir, "joints")
    half = 0.5**0.5
    rests = joints.select("rig", "j", "parent", g.vec(F.col("ox"), F.col("oy"), F.col("oz")).alias("p"), g.quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("q"))
    patches = joints.select("rig").distinct().where(_last() < "4").select("rig", g.quat(F.lit(half), F.lit(0.0), F.lit(half), F.lit(0.0)).alias("turn"), g.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("shift"))
    return m.rest_orientation_patch(rests, patches).select("rig", "j", *(F.round(F.col(f"p.{k}"), 6).alias(k) for k in "xyz"), F.round("q.y", 6).alias("turn"))


TURNED_RESTS = with_views(
    """ SELECT rig, j, round(CASE WHEN b THEN oz + 1 ELSE ox END, 6) AS x, round(CASE WHEN b THEN oy + 2 ELSE oy END, 6) AS y, round(CASE WHEN b THEN 3 - ox ELSE oz END, 6) AS z, round(CASE WHEN b THEN sqrt(0.5) ELSE 0 END, 6) AS turn
    FROM (SELECT *, parent < 0 AND right(sha1(rig), 1) < '4' AS b FROM joints)""",
    "joints",
)


def _bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "joints")[0].select("rig", "j", "parent", "ox", "oy", "oz")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("rig", "j", "parent", *(F.round(a, 9).alias(a) for a in ("ox", "oy", "oz")))


def fewer_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.aug_leaf_removal(_bones(spark, sf_dir), 0.4, 3))


_DRAWN = ", w AS (SELECT rig, j, parent, ox, oy, oz, CAST('0x' || substr(md5('3|' || rig || '/' || j), 1, 6) AS BIGINT) / 16777216 AS u, (SELECT count(*) FROM joints k WHERE k.rig = joints.rig AND k.parent = joints.j) AS n, (SELECT max(j) + 1 FROM joints k WHERE k.rig = joints.rig) AS size FROM joints)"
FEWER_LEAVES = with_views(_DRAWN + " SELECT rig, j, parent, round(ox, 9) AS ox, round(oy, 9) AS oy, round(oz, 9) AS oz FROM w WHERE n > 0 OR parent < 0 OR u >= 0.4", "joints")


def more_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.aug_joint_addition(_bones(spark, sf_dir), 0.3, 3))


MORE_JOINTS = with_views(
    _DRAWN + """, q AS (SELECT *, parent >= 0 AND u < 0.3 AS b FROM w)
    SELECT rig, j, CASE WHEN b THEN size + j ELSE parent END AS parent, round(ox / CASE WHEN b THEN 2 ELSE 1 END, 9) AS ox, round(oy / CASE WHEN b THEN 2 ELSE 1 END, 9) AS oy, round(oz / CASE WHEN b THEN 2 ELSE 1 END, 9) AS oz FROM q
    UNION ALL SELECT rig, size + j, parent, round(ox / 2, 9), round(oy / 2, 9), round(oz / 2, 9) FROM q WHERE b""",
    "joints",
)


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    joints = _bones(spark, sf_dir)
    return _rounded(training.aug_pooling(joints, t.joint_depths(joints)))


POOLED = with_views(
    _UP + _DRAWN + """, g AS (SELECT w.* FROM w JOIN dp ON dp.rig = w.rig AND dp.j = w.j WHERE n = 1 AND depth % 2 = 1)
    SELECT w.rig, w.j, coalesce(g.parent, w.parent) AS parent, round(w.ox + coalesce(g.ox, 0), 9) AS ox, round(w.oy + coalesce(g.oy, 0), 9) AS oy, round(w.oz + coalesce(g.oz, 0), 9) AS oz FROM w LEFT JOIN g ON g.rig = w.rig AND g.j = w.parent WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.rig = w.rig AND h.j = w.j)""",
    "joints",
)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.aug_bone_scale(_bones(spark, sf_dir), 0.8, 1.2, 3))


SCALED = with_views(
    _DRAWN + " SELECT rig, j, parent, round(ox * k, 9) AS ox, round(oy * k, 9) AS oy, round(oz * k, 9) AS oz FROM (SELECT *, CASE WHEN parent < 0 THEN 1.0 ELSE 0.8 + (1.2 - 0.8) * u END AS k FROM w)",
    "joints",
)


def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    rigs = votes.where("ord = 0").select(F.col("asset").alias("rig"), "category")
    return training.object_subset(rigs, "avian", 25, votes.where("confidence = 'medium' AND category = 'bipedal'").select(F.col("asset").alias("rig")))


SUBSET = with_views("SELECT asset AS rig, category FROM votes WHERE ord = 0 AND category = 'avian' AND asset NOT IN (SELECT asset FROM votes WHERE confidence = 'medium' AND category = 'bipedal') ORDER BY rig LIMIT 25", "votes")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    (clips,) = load(spark, sf_dir, "captions")
    return c.representative_asset(clips.select("rig", F.col("clip").alias("asset")))


REPRESENTATIVES = with_views("SELECT rig, min(clip) AS asset FROM captions GROUP BY rig", "captions")


def of_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    (joints,) = load(spark, sf_dir, "joints")
    rows = joints.groupBy("rig").agg(F.array_sort(F.collect_list(F.struct("j", "parent", F.array("ox", "oz").alias("f")))).alias("joints"))
    out = topology.parent_features(rows.select(F.col("rig").alias("clip"), F.lit(0).alias("frame"), F.transform("joints", lambda x: F.struct(x["parent"].alias("parent"), x["f"].alias("f"))).alias("joints")))
    return out.select("clip", F.posexplode("joints").alias("j", "x")).select("clip", "j", F.round(F.col("x.f")[0], 9).alias("f0"), F.round(F.col("x.f")[1], 9).alias("f1"))


OF_PARENTS = with_views("SELECT n.rig AS clip, n.j, round(u.ox, 9) AS f0, round(u.oz, 9) AS f1 FROM joints n JOIN joints u ON u.rig = n.rig AND u.j = CASE WHEN n.parent < 0 THEN n.j ELSE n.parent END", "joints")


def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = load(spark, sf_dir, "frames")[0].groupBy("clip").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    return fr.truncate_window(frames, fr.default_stride(100, 40))


FIRST_WINDOWS = with_views("SELECT clip, CAST(count(*) AS INT) AS n_frames, 0 AS segment, 0 AS start, CAST(least(count(*), 60) AS INT) AS \"end\" FROM frames GROUP BY clip", "frames")


def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    (captions,) = load(spark, sf_dir, "captions")
    k = F.substring_index("clip", "-", -1).cast("int")
    normal = captions.where(k % 4 > 0).select("clip", "text")
    extra = captions.where(k % 3 > 0).select("clip", F.concat(F.lit(" The animal of "), "lang").alias("text"))
    kept, counts = c.extra_captions(normal, extra, "animal", {})
    return kept.select("clip", "text").union(counts.select("kind", F.col("n").cast("string")))


EXTRAS = with_views(
    """, k AS (SELECT clip, lang, CAST(split_part(clip, '-', 2) AS INT) AS k FROM captions)
    SELECT clip, 'The animal of ' || lang || '.' AS text FROM k WHERE k % 3 > 0 AND k % 4 > 0 UNION ALL SELECT 'unknown', CAST(count(*) AS VARCHAR) FROM k WHERE k % 3 > 0 AND k % 4 = 0 UNION ALL SELECT 'missing', CAST(count(*) AS VARCHAR) FROM k WHERE k % 3 = 0 AND k % 4 > 0""",
    "captions",
)


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    view = F.element_at(F.array(F.lit("front"), F.lit("side"), F.lit("top")), (F.col("ord") % 3 + 1).cast("int"))
    frames = F.when(_last("asset") == "7", F.col("ord") % 2 + 1).when(_last("asset") == "8", 0).otherwise(12)
    return c.render_completeness(votes.select(F.col("asset").alias("clip"), view.alias("view"), frames.alias("frames"), (_last("asset") != "9").alias("has_meta")), ["front", "side"])


RENDERS = with_views(
    """, v AS (SELECT asset, ord % 3 AS v, right(sha1(asset), 1) AS h, CASE right(sha1(asset), 1) WHEN '7' THEN ord % 2 + 1 WHEN '8' THEN 0 ELSE 12 END AS f FROM votes)
    SELECT asset AS clip, CASE WHEN count(DISTINCT v) FILTER (v < 2) < 2 THEN 'a view is missing' WHEN max(h) = '9' THEN 'no metadata' WHEN min(f) FILTER (v < 2) = 0 THEN 'no frames' WHEN min(f) FILTER (v < 2) <> max(f) FILTER (v < 2) THEN 'frames differ' END AS reason FROM v GROUP BY asset""",
    "votes",
)


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    (votes,) = load(spark, sf_dir, "votes")
    text = F.when(F.col("ord") % 4 == 0, "nothing here").otherwise(F.concat(F.lit('So: {"category": "'), "category", F.lit('", "n": '), F.col("ord").cast("string"), F.lit("} I think")))
    return votes.select("asset", "ord", c.leaky_json(text, "category string, n int").alias("v")).select("asset", "ord", "v.category", "v.n")


LEAKY = with_views("SELECT asset, ord, CASE WHEN ord % 4 <> 0 THEN category END AS category, CASE WHEN ord % 4 <> 0 THEN ord END AS n FROM votes", "votes")

TOKENS = [("up leg", "Thigh"), ("leg", "Leg"), ("fore arm", "Forearm"), ("arm", "Arm")]
UNDER, ABOVE = {("Leg", "Thigh"): "Shin"}, {("Arm", "Forearm"): "Upper Arm"}
FACES = [("Thigh", 1), ("Upper Arm", 2)]


def _rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([("spine", "Spine")], "bone string, label string"), spark.createDataFrame(TOKENS, "key string, part string")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    return r.clean_joint_names(raw, *_rule_tables(spark)).select("rig", "j", "label")


_CLEANED = _LABELS + """, cn AS (SELECT l.rig, l.j, CASE WHEN lower(regexp_replace(l.raw, '[_0-9]+$', '')) = 'spine' THEN 'Spine' WHEN part IN ('UpLeg', 'Leg', 'Arm', 'ForeArm') THEN regexp_extract(l.label, '^(?:Left |Right )?') || CASE part WHEN 'UpLeg' THEN 'Thigh' WHEN 'ForeArm' THEN 'Forearm' ELSE part END ELSE 'Bone' END AS label, r.parent FROM l JOIN labels_raw r ON r.rig = l.rig AND r.j = l.j)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = load(spark, sf_dir, "labels_raw")
    labels, pairs = r.rule_annotation(raw.select("rig", "j", "parent", "raw"), *_rule_tables(spark), spark.createDataFrame(FACES, "part string, rank int"), UNDER, ABOVE, same_side=True)
    return labels.join(pairs.select("rig", "right", "left"), "rig", "left").select("rig", "j", "label", ((F.col("j") == F.col("right")) | (F.col("j") == F.col("left"))).alias("faces"))


ANNOTATED = with_views(
    _CLEANED + """, sd AS (SELECT *, regexp_extract(label, '^(?:Left |Right )?') AS s, regexp_replace(label, '^(?:Left|Right) ', '') AS p FROM cn),
    lc AS (SELECT x.rig, x.j, x.s, CASE WHEN x.p = 'Leg' AND u.p = 'Thigh' AND u.s = x.s THEN 'Shin' WHEN x.p = 'Arm' AND EXISTS (SELECT 1 FROM sd d WHERE d.rig = x.rig AND d.parent = x.j AND d.s = x.s AND d.p = 'Forearm') THEN 'Upper Arm' ELSE x.p END AS p FROM sd x LEFT JOIN sd u ON u.rig = x.rig AND u.j = x.parent),
    dg AS (SELECT lc.*, regexp_extract_all(raw, '[0-9]+') AS d FROM lc JOIN labels_raw r ON r.rig = lc.rig AND r.j = lc.j WHERE s <> ''),
    bp AS (SELECT x.rig, x.p, x.j AS r, y.j AS l, CASE x.p WHEN 'Thigh' THEN 1 WHEN 'Upper Arm' THEN 2 ELSE 3 END AS rank, CASE WHEN x.d = y.d THEN 0 WHEN x.d[1 : len(x.d) - 1] = y.d[1 : len(y.d) - 1] THEN 1 ELSE 2 END AS m FROM dg x JOIN dg y ON y.rig = x.rig AND y.p = x.p AND x.s = 'Right ' AND y.s = 'Left '),
    f AS (SELECT rig, r, l FROM (SELECT *, row_number() OVER (PARTITION BY rig ORDER BY rank, p, m, r, l) AS k FROM bp) WHERE k = 1)
    SELECT lc.rig, lc.j, s || p AS label, lc.j = r OR lc.j = l AS faces FROM lc LEFT JOIN f ON f.rig = lc.rig""",
    "labels_raw",
)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rig beside a copy with another offset, another order, opposite turns or another parent, by its hash."""
    (joints,) = load(spark, sf_dir, "joints")
    name = F.concat(F.lit("n"), F.col("j").cast("string"))
    up = F.when(F.col("parent") >= 0, F.concat(F.lit("n"), F.col("parent").cast("string")))
    turn = [F.lit(0.6).alias("w"), F.lit(0.8).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz")]
    old = joints.select("rig", "j", name.alias("name"), up.alias("parent_name"), F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"), *turn)
    h = _last()
    sign = F.when(h == "2", -1.0).otherwise(1.0)
    new = old.select("rig", F.when(h == "1", 100 - F.col("j")).otherwise(F.col("j")).alias("j"), "name", F.when((h == "3") & (F.col("j") == 2), "n1").otherwise(F.col("parent_name")).alias("parent_name"), (F.col("x") + F.when(h == "0", 0.5).otherwise(0.0)).alias("x"), "y", "z", *((F.col(k) * sign).alias(k) for k in ("w", "tx", "ty", "tz")))
    return r.compare_conditions(old, new.where((h != "4") | (F.col("j") == 0)))


COMPARED = with_views(
    """ SELECT rig, CASE WHEN h = '0' OR h = '3' AND n > 2 OR h = '4' AND n > 1 THEN 'different' WHEN h IN ('1', '2') THEN 'equivalent' ELSE 'identical' END AS verdict FROM (SELECT rig, right(sha1(rig), 1) AS h, count(*) AS n FROM joints GROUP BY rig)""",
    "joints",
)

QUERIES = {
    "k6_clean_joint_names": (cleaned, with_views(_CLEANED + " SELECT rig, j, label FROM cn", "labels_raw")),
    "k8_k25_rule_annotation": (annotated, ANNOTATED),
    "g16_compare_conditions": (compared, COMPARED),
    "k15_face_pairs": (_pairs, with_views(_LABELS + _PAIRS + ' SELECT rig, part, "right", "left" FROM fp', "labels_raw")),
    "k16_body_axis_pairs": (axis_pairs, AXIS_PAIRS),
    "k17_patch_face_pairs": (patched_pairs, PATCHED_PAIRS),
    "k19_curation_lists": (curation, CURATION),
    "k21_review_flags": (review, REVIEW),
    "k23_validate_face_answers": (face_answers, FACE_ANSWERS),
    "k24_annotation_coverage": (coverage, COVERAGE),
    "k4_k5_name_map": (mapped, MAPPED),
    "j10_tree_template_key": (templates, TEMPLATES),
    "j8_topology_condition": (conditions, CONDITIONS),
    "g2_bfs_reorder": (reordered, REORDERED),
    "g10_realign_clip": (realigned, REALIGNED),
    "g11_root_offset_patch": (offset_roots, OFFSET_ROOTS),
    "g12_rest_orientation_patch": (turned_rests, TURNED_RESTS),
    "g17_face_separation": (separation, SEPARATION),
    "g19_mirror_conflicts": (conflicts, CONFLICTS),
    "g20_capsule_overlap": (overlaps, OVERLAPS),
    "i4_object_subset": (subset, SUBSET),
    "i11_leaf_removal": (fewer_leaves, FEWER_LEAVES),
    "i12_joint_addition": (more_joints, MORE_JOINTS),
    "i13_pooling": (pooled, POOLED),
    "i14_bone_scale": (scaled, SCALED),
    "i17_parent_features": (of_parents, OF_PARENTS),
    "f2_f3_first_windows": (first_windows, FIRST_WINDOWS),
    "l8_extra_captions": (extras, EXTRAS),
    "l16_render_completeness": (renders, RENDERS),
    "l17_representative_asset": (representatives, REPRESENTATIVES),
    "m10_leaky_json": (leaky, LEAKY),
}
