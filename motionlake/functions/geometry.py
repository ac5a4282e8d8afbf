"""Column expressions for vectors struct<x,y,z>, quaternions struct<w,x,y,z>, rotation matrices (nine numbers by row) and angles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, so that nested expressions stay small."""
    return F.transform(F.array(value), then)[0]


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def vsub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def vadd(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def vscale(a: Column, k: Column) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def vdot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def vcross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def vnorm(a: Column) -> Column:
    return F.sqrt(vdot(a, a))


def vunit(a: Column) -> Column:
    """Length one; a vector shorter than the floor is divided by the floor."""
    return let(a, lambda v: vscale(v, 1 / F.greatest(vnorm(v), F.lit(FLOOR))))


def qmul(a: Column, b: Column) -> Column:
    return quat(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def qconj(q: Column) -> Column:
    return quat(q["w"], -q["x"], -q["y"], -q["z"])


def qunit(q: Column) -> Column:


    def divided(q: Column) -> Column:
        n = F.greatest(F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]), F.lit(FLOOR))
        return quat(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n)

    return let(q, divided)


def qrot(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q: v + 2 w (u x v) + 2 u x (u x v)."""
    u = vec(q["x"], q["y"], q["z"])
    return let(vscale(vcross(u, v), F.lit(2.0)), lambda t: vadd(vadd(v, vscale(t, q["w"])), vcross(u, t)))


def qbetween(a: Column, b: Column) -> Column:
    """The shortest turn of unit vector a to unit vector b; opposite vectors turn by half about the up axis."""
    turn = qunit(let(vcross(a, b), lambda c: quat(1 + vdot(a, b), c["x"], c["y"], c["z"])))
    return F.when(vdot(a, b) < -1 + 1e-9, quat(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(turn)


def q_angle(a: Column, b: Column) -> Column:
    """Degrees between two rotations; q and -q are the same."""
    d = F.abs(a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), d)))


def q_to_matrix(q: Column) -> Column:
    """Nine numbers, row by row."""
    w, x, y, z = (q[k] for k in "wxyz")
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    )


def q_to_6d(q: Column) -> Column:
    """The matrix's first two columns, one after the other."""
    return let(q_to_matrix(q), _first_columns)


def _first_columns(m: Column) -> Column:
    return F.array(m[0], m[3], m[6], m[1], m[4], m[7])


def r6_to_matrix(r: Column) -> Column:
    """Six numbers to a rotation by Gram-Schmidt: the columns are a, b without its part along a, and their cross product."""
    second = vec(r[3], r[4], r[5])

    def matrix(a: Column, b: Column) -> Column:
        return let(vcross(a, b), lambda c: F.array(a["x"], b["x"], c["x"], a["y"], b["y"], c["y"], a["z"], b["z"], c["z"]))

    return let(vunit(vec(r[0], r[1], r[2])), lambda a: let(vunit(vsub(second, vscale(a, vdot(a, second)))), lambda b: matrix(a, b)))


def matrix_to_q(m: Column) -> Column:
    """Unit quaternion with w >= 0 from the largest of the four candidates."""
    t = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    up, right, front = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    by_largest = [quat(t[0], up, right, front), quat(up, t[1], xy, xz), quat(right, xy, t[2], yz), quat(front, xz, yz, t[3])]
    top = F.greatest(*t)
    q = F.when(t[0] == top, by_largest[0]).when(t[1] == top, by_largest[1]).when(t[2] == top, by_largest[2]).otherwise(by_largest[3])
    return let(qunit(q), upright)


def upright(q: Column) -> Column:
    """The same rotation with w >= 0."""
    sign = F.when(q["w"] < 0, -1.0).otherwise(1.0)
    return quat(q["w"] * sign, q["x"] * sign, q["y"] * sign, q["z"] * sign)


def geodesic_error(a: Column, b: Column) -> Column:
    """Radians between two rotation matrices, from the trace of a's transpose times b, clamped."""
    trace = sum((a[k] * b[k] for k in range(1, 9)), a[0] * b[0])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))


def bbox_extent(points: list[str]) -> Column:
    """Aggregate: the largest side of the box around the columns."""
    return F.greatest(*(F.max(p) - F.min(p) for p in points))
