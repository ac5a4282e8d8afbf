"""Corpus tables derived from the test tables: rigs, joints, clips, frames, positions, captions, votes and raw labels.

Each is one SQL text that Spark and DuckDB both run, so a query and the SQL that
it is held against start from the same rows. A rig's number is its order's; a user's
clip hangs on the rig with the user's number, or the nearest of the next seven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: In order: later ones use earlier ones.
VIEWS = {
    "joints": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS jj FROM lineitem)
SELECT 'o' || CAST(l_orderkey AS STRING) AS rig, CAST(jj AS INT) AS j, CASE WHEN jj = 0 THEN -1 ELSE CAST(floor((jj - 1) / 2.0) AS INT) END AS parent,
(l_discount - 0.05) * 10 AS ox, l_quantity / 50.0 AS oy, (l_tax - 0.04) * 10 AS oz, l_partkey AS part FROM n""",
    "bodies": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS jj FROM lineitem),
q AS (SELECT n.*, CASE WHEN jj < 4 THEN -1 ELSE CAST(floor((jj - 4) / 2.0) AS INT) % 4 END AS limb, CASE WHEN jj < 4 THEN jj ELSE CAST(floor((jj - 4) / 8.0) AS INT) END AS lv, CASE WHEN jj < 4 THEN 0 ELSE 1 - 2 * (jj % 2) END AS sg FROM n),
w AS (SELECT q.*, CASE WHEN sg > 0 THEN 'Left ' WHEN sg < 0 THEN 'Right ' ELSE '' END AS sd, (l_orderkey * 31 + l_linenumber * 7) % 16 AS c, (l_partkey + limb) % 5 AS k FROM q)
SELECT 'p' || CAST(l_partkey AS STRING) AS rig, CAST(jj AS INT) AS j, CAST(CASE WHEN jj < 4 THEN jj - 1 WHEN jj < 12 THEN limb ELSE jj - 8 END AS INT) AS parent,
CASE WHEN sg = 0 THEN 0.0 ELSE sg * (0.2 + 0.1 * lv * (l_partkey % 2)) END AS x, CASE WHEN jj < 4 THEN 1 + 0.3 * jj ELSE 1 + 0.3 * limb - (lv + 1) * CASE WHEN (l_partkey + limb) % 3 = 0 THEN 0.4 ELSE 0.1 END END AS y, CASE WHEN jj < 4 THEN jj ELSE limb END * 0.2 * (l_partkey % 4) AS z,
CASE WHEN l_partkey % 4 = 0 THEN 'Bone.' || lpad(CAST(jj AS STRING), 3, '0') WHEN c = 0 THEN 'lIndex3' WHEN c = 1 THEN 'rIndex3' WHEN c = 2 THEN 'Finger' || CAST(lv AS STRING) WHEN c = 3 THEN 'FLeg01' WHEN c = 4 THEN 'BLeg01' ELSE 'joint_' || CAST(jj AS STRING) END AS raw,
CASE WHEN l_partkey % 4 = 0 THEN 'Bone' WHEN l_partkey % 4 = 1 AND jj >= 4 THEN sd || CASE WHEN k = 0 THEN 'Back Leg Upper' WHEN k = 1 THEN 'Front Leg Lower' WHEN k = 2 THEN 'Hind Leg' WHEN k = 3 THEN 'Arm' ELSE 'Leg' END
WHEN l_partkey % 4 = 2 AND c > 9 THEN sd || 'Frog' WHEN c = 0 OR c = 1 THEN 'Index Finger' WHEN c = 2 THEN sd || 'Finger' WHEN c = 3 OR c = 4 THEN sd || 'Leg' WHEN c = 5 THEN sd || 'Rex Toe' WHEN c = 6 THEN sd || 'Collar' WHEN c = 7 THEN sd || 'Thigh Rear' WHEN c = 8 THEN sd || 'Foot' WHEN c = 9 THEN sd || 'Middle Finger End' WHEN c = 10 THEN 'Cola' ELSE 'Spine' END AS label FROM w""",
    "rigs": "SELECT rig, CAST(substr(rig, 2) AS BIGINT) AS r, count(*) AS n_joints FROM joints GROUP BY rig",
    "clips": """SELECT u.user_id, g.rig, g.n_joints, g.rig || '-u' || CAST(u.user_id AS STRING) AS clip FROM (SELECT n.user_id, min(k.r) AS r FROM (WITH e AS (SELECT DISTINCT user_id FROM events) SELECT user_id, user_id + 0 AS r FROM e UNION ALL SELECT user_id, user_id + 1 AS r FROM e UNION ALL SELECT user_id, user_id + 2 AS r FROM e UNION ALL SELECT user_id, user_id + 3 AS r FROM e UNION ALL SELECT user_id, user_id + 4 AS r FROM e UNION ALL SELECT user_id, user_id + 5 AS r FROM e UNION ALL SELECT user_id, user_id + 6 AS r FROM e UNION ALL SELECT user_id, user_id + 7 AS r FROM e) n JOIN rigs k ON k.r = n.r GROUP BY n.user_id) u JOIN rigs g ON g.r = u.r""",
    "frames": """SELECT c.clip, c.rig, CAST(e.f AS INT) AS frame, e.s FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f,
sum(CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1000.0 AS s FROM events) e
JOIN clips c ON c.user_id = e.user_id""",
    "positions": """SELECT f.clip, f.rig, f.frame, j.j, j.ox + f.s + 0.05 * sin(f.s * (j.j + 1)) AS px, j.oy + 0.05 * cos(f.s * (j.j + 1)) AS py, j.oz AS pz
FROM frames f JOIN joints j ON j.rig = f.rig""",
    "captions": "SELECT source || '-' || lpad(CAST(doc_id AS STRING), 6, '0') AS clip, source AS rig, text, lang FROM documents",
    "votes": """SELECT 'a' || CAST(conv_id AS STRING) AS asset, turn AS ord, CASE length(text) % 4 WHEN 0 THEN 'bipedal' WHEN 1 THEN 'quadrupedal' WHEN 2 THEN 'avian' ELSE 'uncertain' END AS category,
CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM conversations""",
    "labels_raw": """SELECT j.rig, j.j, j.parent, CASE j.part % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'Right' ELSE '' END || CASE CAST(floor(j.part / 3.0) AS INT) % 6 WHEN 0 THEN 'UpLeg' WHEN 1 THEN 'Leg' WHEN 2 THEN 'Arm' WHEN 3 THEN 'ForeArm' WHEN 4 THEN 'Spine' ELSE 'Bone' END || '_' || lpad(CAST(j.j AS STRING), 3, '0') AS raw FROM joints j""",
}
NEEDS = {
    "rigs": ["joints"],
    "clips": ["joints", "rigs"],
    "frames": ["joints", "rigs", "clips"],
    "positions": ["joints", "rigs", "clips", "frames"],
    "labels_raw": ["joints"],
}
BASE = {"joints": "lineitem", "bodies": "lineitem", "clips": "events", "frames": "events", "captions": "documents", "votes": "conversations"}


def _wanted(names: tuple[str, ...]) -> list[str]:
    need = {m for n in names for m in (*NEEDS.get(n, []), n)}
    return [n for n in VIEWS if n in need]


def load(spark: SparkSession, sf_dir: str, *names: str, given: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """The named corpus tables; a name that isn't one of them is read from sf_dir. Those in `given` are taken from there, by the others too."""
    wanted = _wanted(tuple(n for n in names if n in VIEWS))
    for base in {BASE[n] for n in wanted if n in BASE}:
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    for name in wanted:
        (given[name] if given and name in given else spark.sql(VIEWS[name])).createOrReplaceTempView(name)
    return [spark.table(n) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB that begins with the named corpus tables; sql is a SELECT, or further table expressions and a SELECT that starts with a comma."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _wanted(names))
    return f"WITH {head}{sql}" if sql.lstrip().startswith(",") else f"WITH {head} {sql}"
