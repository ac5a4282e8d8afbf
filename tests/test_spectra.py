"""Spectra of trees and their audit, against numpy."""

import numpy as np
from motionlake.operators import topology as t


def test_a_rigs_audit_stays_in_its_row(spark):
    trees = {"a": [-1, 0, 0, 1, 1], "b": [-1], "c": [-1, 0], "d": [-1, 0, 0, 1, 1], "e": [-1, 0, -1, 2], "f": [-1, 1, 0]}
    joints = spark.createDataFrame([(rig, j, p) for rig, tree in trees.items() for j, p in enumerate(tree)], "rig string, j int, parent int")
    rigs = t.rig_spectra(joints, 3)
    audit = t.eigenbasis_audit(rigs)
    assert "Exchange" not in t.eigenbasis_audit(rigs.sparkSession.createDataFrame(rigs.collect(), rigs.schema))._jdf.queryExecution().executedPlan().toString()
    got = {(r.rig, r.c): (r.length, r.residual) for r in audit.collect()}
    assert len(got) == 3 * len(trees)
    for rig, tree in trees.items():
        for c in range(3):
            assert abs(got[rig, c][0] - (c + 1 < len(tree))) < 1e-9 and got[rig, c][1] < 1e-9
    features = {(r.rig, r.j): r["values"] for r in t.spectral_features(joints, 3).collect()}
    assert len(features) == sum(map(len, trees.values())) and features["a", 3] == features["d", 3]


def test_the_audit_finds_what_is_no_eigenvector(spark):
    wrong = [("a", [-1, 0, 0], [[1.0, 0.5], [2.0, 0.5], [0.0, 0.5]]), ("b", [], []), ("c", [-1], [[3.0, 0.0]])]
    got = {(r.rig, r.c): (r.length, r.residual) for r in t.eigenbasis_audit(spark.createDataFrame(wrong, "rig string, parents array<int>, values array<array<double>>")).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("c", 0), ("c", 1)}
    for rig, parents, values in (wrong[0], wrong[2]):
        m = t.laplacian(parents)
        for c in (0, 1):
            v = np.array([row[c] for row in values])
            assert np.allclose(got[rig, c], (v @ v, np.abs(m @ v - (v @ m @ v) * v).max()))
