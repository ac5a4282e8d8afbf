"""Joins, merges and reconciliation of metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_ci(keys: DataFrame, meta: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's row of meta: the exact match, else the first match by `order` that differs in case only. Keys without one keep nulls."""
    # one row a spelling, so that names which many rows share don't multiply
    row = F.struct(*[F.col(c) for c in meta.columns])
    spelt = meta.groupBy(F.lower(key).alias("_k"), F.col(key).alias("_n")).agg(F.min_by(row, F.struct(order)).alias("_m"))
    any_case = spelt.groupBy("_k").agg(F.min_by("_m", F.struct(f"_m.{order}", "_n")).alias("_any"))
    found = keys.distinct().withColumn("_k", F.lower(key)).join(any_case, "_k", "left")
    out = found.join(spelt.select("_n", F.col("_m").alias("_own")), F.col(key) == F.col("_n"), "left").withColumn("_m", F.coalesce("_own", "_any"))
    return out.select(*keys.columns, *(F.col(f"_m.{c}").alias(f"meta_{c}") for c in meta.columns))


def rekey(segments: DataFrame, captions: DataFrame, stem: Column) -> DataFrame:
    """Every segment takes the caption of its clip; segments without one are left out."""
    return segments.withColumn("clip", stem).join(captions, "clip")


def merge_last_wins(parts: list[DataFrame], key: list[str], seq: str) -> DataFrame:
    """One row a key from several tables: a later table wins over an earlier one, and inside a table the larger seq."""
    every = [p.withColumn("_rank", F.lit(k)) for k, p in enumerate(parts)]
    out = every[0]
    for p in every[1:]:
        out = out.unionByName(p)
    last = out.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_rank"), F.desc(seq))))
    return last.where("_n = 1").drop("_n", "_rank")


def merge_caption_shards(shards: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """shards(clip, text, rank, seq), failures(clip): (merged captions, failures that no complete caption has settled)."""
    last = Window.partitionBy("clip").orderBy(F.desc("rank"), F.desc("seq"))
    merged = shards.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("clip", "text")
    complete = merged.where((F.coalesce("text", F.lit("")) != "") & ~F.col("text").startswith("ERROR:"))
    return merged, failures.select("clip").distinct().join(complete, "clip", "left_anti")


def recover_missing_counts(motions: DataFrame, summary: DataFrame) -> DataFrame:
    """Frames of the clips that the summary lacks."""
    return motions.join(summary.select("clip"), "clip", "left_anti").groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"))


def pending_work(items: DataFrame, done: DataFrame, key: str, status: str, retry: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """Items that aren't done, or whose status is one that is tried again."""
    return items.join(done.where(~F.col(status).isin(*retry)).select(key), key, "left_anti")


def stable_digest(columns: list[str]) -> Column:
    """Sixteen hex digits of the SHA-1 of the columns' JSON, names in order."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(columns)))), 1, 16)


def cache_decision(tasks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """tasks and cache(key, settings map, digest): what to do, and which settings changed. An entry without a digest is taken over and stamped."""
    old = cache.select(key, F.col("settings").alias("old_settings"), F.col("digest").alias("old_digest"), F.lit(True).alias("_hit"))
    changed = F.array_sort(
        F.filter(F.array_union(F.map_keys("settings"), F.map_keys("old_settings")), lambda k: ~F.coalesce(F.element_at("settings", k), F.lit("\0")).eqNullSafe(F.coalesce(F.element_at("old_settings", k), F.lit("\0"))))
    )
    out = tasks.join(old, key, "left").withColumn("changed", F.when(F.col("_hit"), changed))
    action = F.when(F.col("_hit").isNull(), "new").when(F.size("changed") > 0, "settings").when(F.col("old_digest").isNull(), "stamp").when(F.col("old_digest") != F.col("digest"), "export").otherwise("reuse")
    return out.select(key, action.alias("action"), "changed")


def check_key_sets(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys, lower-cased, that some of the tables lack: one row for each key and table that lacks it."""
    seen = None
    for name, df in tables.items():
        one = df.select(F.lower(key).alias("key"), F.lit(name).alias("has")).distinct()
        seen = one if seen is None else seen.unionByName(one)
    have = seen.groupBy("key").agg(F.collect_set("has").alias("has"))
    return have.select("key", F.explode(F.array_except(F.array(*(F.lit(n) for n in tables)), "has")).alias("missing_in"))


def align_joints(clip_joints: DataFrame, rig_joints: DataFrame) -> DataFrame:
    """clip_joints(clip, rig, j, parent, raw), rig_joints(rig, j, parent, raw): per clip whether its joints are the rig's in another order, and why not.

    Names must be unique, the same, and their parents' names too.
    """
    def named(df: DataFrame, keys: list[str]) -> DataFrame:
        up = df.select(*keys, F.col("j").alias("parent"), F.col("raw").alias("parent_raw"))
        return df.join(up, [*keys, "parent"], "left").select(*keys, "raw", "j", F.coalesce("parent_raw", F.lit("")).alias("parent_raw"))

    clips, rigs = named(clip_joints, ["clip", "rig"]), named(rig_joints, ["rig"])
    size = rigs.groupBy("rig").agg(F.count(F.lit(1)).alias("n_rig"))
    right = rigs.groupBy("rig", "raw").agg(F.first("parent_raw").alias("want"), F.first("j").alias("to"), F.count(F.lit(1)).alias("twice"))
    met = clips.join(right, ["rig", "raw"], "left")
    out = met.groupBy("clip", "rig").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("n_names"), F.count("want").alias("n_met"), F.max(F.coalesce("twice", F.lit(1))).alias("twice"),
        F.bool_and(F.coalesce(F.col("parent_raw") == F.col("want"), F.lit(True))).alias("same_parents"),
    ).join(size, "rig", "left")
    reason = (
        F.when((F.col("n_names") < F.col("n")) | (F.col("twice") > 1), "names repeat").when((F.col("n_met") < F.col("n")) | (F.col("n") != F.coalesce("n_rig", F.lit(0))), "names differ").when(~F.col("same_parents"), "parents differ")
    )
    return out.select("clip", "rig", reason.isNull().alias("ok"), reason.alias("reason"))


def main_skeleton(clips: DataFrame, names: str, order: str) -> DataFrame:
    """clips(rig, clip, names, order): marks the clips of each rig's largest group of equal joint names; of equal groups, the one that was first."""
    groups = clips.groupBy("rig", names).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    main = groups.groupBy("rig").agg(F.max_by(names, F.struct("n", -F.col("first"))).alias("_main"))
    return clips.join(main, "rig").withColumn("is_main", F.col(names) == F.col("_main")).drop("_main")


def reconcile_embeddings(current: DataFrame, cache: DataFrame, encoder: str) -> tuple[DataFrame, DataFrame]:
    """current(key, text), cache(key, text, encoder): (what becomes of each cache entry, distinct texts to encode with the keys that want them)."""
    cur = current.select("key", F.col("text").alias("now"))
    judged = cache.join(cur, "key", "left").withColumn(
        "verdict", F.when(F.col("encoder") != encoder, "encoder").when(F.col("now").isNull(), "orphan").when(F.col("now") != F.col("text"), "stale").otherwise("keep")
    )
    wanted = current.join(judged.where("verdict = 'keep'").select("key"), "key", "left_anti")
    return judged.select("key", "verdict"), wanted.groupBy("text").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def resolve_stats_key(datasets: DataFrame, stats: DataFrame, fallback: dict[str, str], pool: str) -> DataFrame:
    """The statistics' key for each dataset: its own, else its fallback's, else the pool's, else null."""
    keys = stats.select(F.col("dataset").alias("_k")).distinct()
    back = F.create_map(*(F.lit(x) for kv in fallback.items() for x in kv)) if fallback else F.create_map(F.lit(""), F.lit(""))
    out = datasets.withColumn("_f", F.element_at(back, F.col("dataset")))
    for name, key in (("_own", "dataset"), ("_back", "_f")):
        out = out.join(keys.withColumnRenamed("_k", name), F.col(key) == F.col(name), "left")
    out = out.join(keys.where(F.col("_k") == pool).withColumnRenamed("_k", "_pool"), F.lit(True), "left")
    return out.select("dataset", F.coalesce("_own", "_back", "_pool").alias("stats_key"))


def namespace_clash_report(df: DataFrame, key: str, dataset: str = "dataset") -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(dataset)).alias("datasets")).where(F.size("datasets") > 1)


def manifest_jobs(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """samples(sample, asset, n_joints), assets(asset, n_joints, topology): one row a sample with all the reasons against it."""
    a = assets.select("asset", F.col("n_joints").alias("asset_joints"), "topology")
    out = samples.join(a, "asset", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("asset_joints").isNull(), "no asset"), F.when(F.col("asset_joints").isNotNull() & F.col("topology").isNull(), "no condition"), F.when(F.col("asset_joints") != F.col("n_joints"), "joint counts differ")
        )
    )
    return out.withColumn("problems", F.array_sort(F.array_distinct(reasons))).select("sample", "asset", (F.size("problems") == 0).alias("ok"), "problems")


def merge_manifest(old_assets: DataFrame, new_assets: DataFrame, old_samples: DataFrame, new_samples: DataFrame, key: str, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """New assets replace old ones; an old asset whose identity changed loses its earlier samples; a new sample replaces the old one of its name."""
    o, n = old_assets.alias("o"), new_assets.alias("n")
    changed = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).where(~F.expr(" AND ".join(f"o.{c} <=> n.{c}" for c in identity))).select(F.col(f"o.{key}").alias(key))
    assets = old_assets.join(new_assets.select(key), key, "left_anti").unionByName(new_assets)
    kept = old_samples.join(changed, key, "left_anti").join(new_samples.select("sample"), "sample", "left_anti")
    return assets, kept.unionByName(new_samples)


def resolve_clip(cases: DataFrame, clips: DataFrame) -> DataFrame:
    """cases(case, rig), clips(clip, rig, split): the clip that is the case's id, or its rig, dash or underscore, and id; train before eval."""
    tries = cases.select("case", "rig", F.explode(F.array(F.col("case"), F.concat_ws("-", "rig", "case"), F.concat_ws("_", "rig", "case"))).alias("clip"))
    met = tries.join(clips, ["clip", "rig"])
    return met.groupBy("case", "rig").agg(F.min_by("clip", F.struct((F.col("split") != "train").alias("late"), F.col("clip"))).alias("clip"))


def table_diff(before: DataFrame, after: DataFrame, key: list[str], columns: list[str], kind: str) -> DataFrame:
    """One row for each value that changed: kind, the key, column, old, new and note (added, removed or changed)."""
    b = before.select(*key, *(F.col(c).cast("string").alias(f"_b_{c}") for c in columns), F.lit(True).alias("_in_b"))
    a = after.select(*key, *(F.col(c).cast("string").alias(f"_a_{c}") for c in columns), F.lit(True).alias("_in_a"))
    both = b.join(a, key, "full_outer")
    note = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").otherwise("changed")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("old"), F.col(f"_a_{c}").alias("new")) for c in columns))).alias("cell")
    return both.select(F.lit(kind).alias("kind"), *key, note.alias("note"), cells).select("kind", *key, "cell.column", "cell.old", "cell.new", "note").where("NOT old <=> new")
