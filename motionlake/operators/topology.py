"""Spectral features of joint trees, pruning candidates and chain labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .trees import down, to_rigs


def laplacian(parents: list[int]) -> np.ndarray:
    """The normalized Laplacian of a tree."""
    n = len(parents)
    a = np.zeros((n, n))
    for j, p in enumerate(parents):
        if p >= 0 and p != j:
            a[j, p] = a[p, j] = 1
    d = np.maximum(a.sum(axis=1), 1) ** -0.5
    return np.eye(n) * (a.sum(axis=1) > 0) - d[:, None] * a * d[None, :]


def rig_spectra(joints: DataFrame, k: int = 8) -> DataFrame:
    """(rig, parents, values): one row a rig with the rows of spectral_features as an array in joint order.

    Only distinct trees are solved, in Arrow batches, and joined back by their
    parents. Rigs and solved trees are written, so that trees are broadcast if they
    are few and Spark splits the hot ones otherwise.
    """
    rigs = to_rigs(joints, ["parent"]).select("rig", F.transform("joints", lambda x: x["parent"].cast("int")).alias("parents"))
    rigs = staged(rigs, "spectra-rigs").withColumn("tree", tree_key("parents"))
    return rigs.join(staged(tree_spectra(rigs, k), "spectra"), "tree").select("rig", "parents", "values")


def spectral_features(joints: DataFrame, k: int = 8) -> DataFrame:
    """(rig, j, values): eigenvectors 1 to k of the normalized Laplacian, of length one, zeros where the rig has fewer joints.

    Signs, and bases of equal eigenvalues, are free.
    """
    return rig_spectra(joints, k).select("rig", F.posexplode("values").alias("j", "values"))


def tree_key(parents: str) -> Column:
    return F.sha1(F.array_join(F.transform(parents, lambda p: p.cast("string")), ","))


def tree_spectra(rigs: DataFrame, k: int) -> DataFrame:
    """rigs(tree, parents): (tree, values), for each distinct tree a row of k values a joint."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for parents in batch["parents"]:
                _, v = np.linalg.eigh(laplacian(list(parents)))
                rows.append([np.pad(r[1 : k + 1], (0, max(0, k + 1 - len(r))))[:k].tolist() for r in v])
            yield pd.DataFrame({"tree": batch["tree"], "values": rows})

    return rigs.groupBy("tree").agg(F.first("parents").alias("parents")).mapInPandas(solve, "tree string, values array<array<double>>")


def eigenbasis_audit(rigs: DataFrame) -> DataFrame:
    """rigs(rig, parents, values) as rig_spectra makes them: (rig, c, length, residual), per rig and column the squared length, and the largest residual of L v - (v L v) v, which is zero for an eigenvector.

    A rig's row has all that this takes, so nothing is shuffled; the rigs of an Arrow batch are worked out together.
    """
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, values = batch.column("parents"), batch.column("values")
            n = parents.value_lengths().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(n > 0)
            if len(keep) == 0:
                continue
            first = np.concatenate(([0], np.cumsum(n[keep])[:-1]))
            v = values.flatten().flatten().to_numpy(zero_copy_only=False).reshape(n.sum(), -1)
            up, own = parents.flatten().to_numpy(zero_copy_only=False), np.arange(len(v))
            at = np.repeat(first, n[keep])
            child = np.flatnonzero((up >= 0) & (up + at != own))
            parent = (up + at)[child]
            degree = np.bincount(np.concatenate((child, parent)), minlength=len(v))[:, None]
            u = v / np.sqrt(np.maximum(degree, 1))
            s = np.zeros_like(v)
            np.add.at(s, child, u[parent])
            np.add.at(s, parent, u[child])
            lv = np.where(degree > 0, v - s / np.sqrt(np.maximum(degree, 1)), 0.0)
            along = np.add.reduceat(v * lv, first)
            length = np.add.reduceat(v * v, first)
            residual = np.maximum.reduceat(np.abs(lv - np.repeat(along, n[keep], axis=0) * v), first)
            k = v.shape[1]
            rig = batch.column("rig").take(pa.array(np.repeat(keep, k)))
            yield pa.RecordBatch.from_arrays([rig, pa.array(np.tile(np.arange(k, dtype=np.int32), len(keep))), pa.array(length.ravel()), pa.array(residual.ravel())], ["rig", "c", "length", "residual"])

    return rigs.select("rig", "parents", "values").mapInArrow(audit, "rig string, c int, length double, residual double")


def prune_candidates(joints: DataFrame, motion: DataFrame) -> DataFrame:
    """joints(rig, j, parent, name, skin, length), motion(rig, clip, j, turn, slide, stretch: each the largest in a clip): unskinned joints that may go, and why.

    A control by name, no offset, no motion, a leaf whose bone's length varies,
    or one that never turns; a leaf stays if its parent turns.
    """
    over = motion.groupBy("rig", "j").agg(F.max("turn").alias("turn"), F.max("slide").alias("slide"), F.max("stretch").alias("stretch"))
    inner = joints.where("parent >= 0").select("rig", F.col("parent").alias("j"), F.lit(True).alias("inner")).distinct()
    up = over.select("rig", F.col("j").alias("parent"), F.col("turn").alias("up_turn"))
    rows = joints.join(over, ["rig", "j"], "left").join(inner, ["rig", "j"], "left").join(up, ["rig", "parent"], "left")
    leaf, still = F.col("inner").isNull(), F.coalesce("turn", F.lit(0.0)) <= 1e-6
    reason = (
        F.when(F.col("name").rlike("(?i)ctrl|control|ik_|pole"), "control").when(F.col("length") <= 1e-8, "no offset").when(still & (F.coalesce("slide", F.lit(0.0)) <= 1e-6), "no motion")
        .when(leaf & (F.coalesce("stretch", F.lit(0.0)) > 1e-3), "length varies").when(still & ~(leaf & (F.coalesce("up_turn", F.lit(0.0)) > 1e-6)), "no rotation")
    )
    return rows.where(F.col("skin") <= 0).select("rig", "j", reason.alias("reason")).where("reason IS NOT NULL")


def relabel_chains(joints: DataFrame, sequences: DataFrame) -> DataFrame:
    """joints(rig, j, parent, label), sequences(label, names array): a run of one label down single children takes the names by place, the last for the rest."""
    rigs = to_rigs(joints, ["parent", "label"])
    only = F.transform("joints", lambda x: F.struct(x["j"].alias("j"), x["parent"].alias("parent"), x["label"].alias("label"), (F.size(F.filter("joints", lambda y: y["parent"] == x["parent"])) == 1).alias("single")))
    rigs = rigs.withColumn("marked", only)
    place = down(F.col("marked"), lambda x: F.struct(F.lit(1).alias("k"), x["label"].alias("label")), lambda up, x: F.struct(F.when(x["single"] & (up["label"] == x["label"]), up["k"] + 1).otherwise(1).alias("k"), x["label"].alias("label")))
    rows = rigs.select("rig", F.posexplode(place).alias("j", "c")).select("rig", "j", "c.k", "c.label").join(sequences, "label", "left")
    return rows.select("rig", "j", F.when(F.col("names").isNotNull(), F.element_at("names", F.least("k", F.size("names")))).otherwise(F.col("label")).alias("label"))


def parent_features(features: DataFrame) -> DataFrame:
    """features(clip, frame, joints array of (parent, f)): each joint's row is its parent's; the root keeps its own."""
    return features.withColumn("joints", F.transform("joints", lambda x: F.struct(x["parent"].alias("parent"), F.when(x["parent"] < 0, x["f"]).otherwise(F.get("joints", x["parent"])["f"]).alias("f"))))


def rig_flags(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """(rig, category, reason): a manual flag overrides the automatic one, `verified_ok` clears it."""
    every = automatic.withColumn("_p", F.lit(0)).unionByName(manual.withColumn("_p", F.lit(1)))
    top = every.groupBy("rig").agg(F.max_by(F.struct("category", "reason"), F.struct("_p", "category")).alias("f"))
    return top.select("rig", "f.category", "f.reason").where("category <> 'verified_ok'")
