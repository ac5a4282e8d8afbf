"""Joints that mirror each other, held against brute force."""

import math
import random

from motionlake.operators import motion


def brute(joints, share=0.03):
    by_rig = {}
    for rig, j, x, y, z, extent in joints:
        by_rig.setdefault(rig, []).append((j, x, y, z, extent))
    out = set()
    for rig, rows in by_rig.items():
        best = {}
        for axis, (s, o) in {"x": (1, 3), "z": (3, 1)}.items():
            for a in rows:
                near = [(math.sqrt((a[s] + b[s]) ** 2 + (a[2] - b[2]) ** 2 + (a[o] - b[o]) ** 2), b[0]) for b in rows if b[0] != a[0] and a[s] > 0 > b[s]]
                near = [n for n in near if n[0] <= share * a[4]]
                if near:
                    best.setdefault(axis, []).append((a[0], min(near)[1]))
        if best:
            axis = min(best, key=lambda k: (-len(best[k]), k))
            out.update((rig, axis, a, b) for a, b in best[axis])
    return out


def test_one_axis_a_rig(spark):
    draw = random.Random(7)
    joints = [(f"r{r}", j, draw.choice([-1.0, 0.0, 1.0]), draw.choice([0.0, 0.5]), draw.choice([-1.0, 1.0, 2.0]), 5.0) for r in range(200) for j in range(6)]
    table = spark.createDataFrame(joints, "rig string, j int, x double, y double, z double, extent double")
    found = motion.name_pairs_by_mirror(table)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(joints)
    # after a union Spark may take the rows of a rig for gathered where they aren't, on tables of several shuffle partitions a side
    assert "Union" not in found._jdf.queryExecution().toString()
