"""Vectors, quaternions, matrices and rotations as Column expressions.

Vectors are structs (x, y[, z]), quaternions structs (w, x, y, z), matrices arrays of nine numbers by row,
six-dimensional rotations arrays of six numbers (the first two matrix columns).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8

#: An expression whose text is longer is bound to a name before it is used more than once.
SHORT = 120


def let(fn: Callable[..., Column], *args: Column) -> Column:
    """``fn(*args)`` with each long argument evaluated once.

    Expressions are trees: what is used six times in a formula is there six times, and in formulas of formulas that grows as a
    power of the depth. A lambda's parameter is the one name that an expression can have.
    """
    for k, a in enumerate(args):
        if len(str(a)) > SHORT:
            return _bound(fn, args, k)
    return fn(*args)


def _bound(fn: Callable[..., Column], args: tuple[Column, ...], k: int) -> Column:
    def inner(x: Column) -> Column:
        return let(fn, *args[:k], x, *args[k + 1 :])

    return F.get(F.transform(F.array(args[k]), inner), F.lit(0))


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec3(x, y, z) -> Column:
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def vec2(x, y) -> Column:
    return F.struct(lit(x).alias("x"), lit(y).alias("y"))


def quat(w, x, y, z) -> Column:
    return F.struct(lit(w).alias("w"), lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def identity() -> Column:
    return quat(1, 0, 0, 0)


def add(a: Column, b: Column) -> Column:
    return let(lambda a, b: vec3(a.x + b.x, a.y + b.y, a.z + b.z), a, b)


def sub(a: Column, b: Column) -> Column:
    return let(lambda a, b: vec3(a.x - b.x, a.y - b.y, a.z - b.z), a, b)


def scale(a: Column, k: float | Column) -> Column:
    return let(lambda a, k: vec3(a.x * k, a.y * k, a.z * k), a, lit(k))


def dot(a: Column, b: Column) -> Column:
    return let(lambda a, b: a.x * b.x + a.y * b.y + a.z * b.z, a, b)


def cross(a: Column, b: Column) -> Column:
    return let(lambda a, b: vec3(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x), a, b)


def length_sq(a: Column) -> Column:
    return let(lambda a: dot(a, a), a)


def length(a: Column) -> Column:
    return F.sqrt(length_sq(a))


def normalized(a: Column) -> Column:
    """Unit vector; zero where the length is not above 1e-8."""
    return let(lambda a: let(lambda n: F.when(n > TINY, scale(a, 1 / n)).otherwise(vec3(0, 0, 0)), length(a)), a)


def lerp(a: Column, b: Column, t: float | Column) -> Column:
    return let(lambda a, b: add(a, scale(sub(b, a), t)), a, b)


def midpoint(a: Column, b: Column) -> Column:
    return scale(add(a, b), 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return let(lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))), x)


def wrap_angle(x: Column) -> Column:
    """Radians in [-pi, pi]."""
    return let(lambda x: x - 2 * F.pi() * F.round(x / (2 * F.pi())), x)


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two vectors; zero if one has no length."""

    def angle(a: Column, b: Column, m: Column, n: Column) -> Column:
        return F.when((m >= TINY) & (n >= TINY), F.degrees(F.acos(clamp(dot(a, b) / (m * n), -1, 1)))).otherwise(0.0)

    return let(lambda a, b: let(lambda m, n: angle(a, b, m, n), length(a), length(b)), a, b)


def joint_angle(parent: Column, joint: Column, child: Column) -> Column:
    return angle_between(sub(parent, joint), sub(child, joint))


# Quaternions


def q_dot(a: Column, b: Column) -> Column:
    return let(lambda a, b: a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z, a, b)


def q_norm(q: Column) -> Column:
    return let(lambda q: F.sqrt(q_dot(q, q)), q)


def q_scale(q: Column, k: Column | float) -> Column:
    return let(lambda q, k: quat(q.w * k, q.x * k, q.y * k, q.z * k), q, lit(k))


def q_normalized(q: Column) -> Column:
    """Unit quaternion; the identity where the norm is not above 1e-8."""
    return let(lambda q: let(lambda n: F.when(n > TINY, q_scale(q, 1 / n)).otherwise(identity()), q_norm(q)), q)


def q_conjugate(q: Column) -> Column:
    return let(lambda q: quat(q.w, -q.x, -q.y, -q.z), q)


def q_mul(a: Column, b: Column) -> Column:
    return let(
        lambda a, b: quat(
            a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
            a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
            a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
            a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
        ),
        a,
        b,
    )


def q_rotate(q: Column, v: Column) -> Column:
    """v turned by q: v + 2 u x (u x v + w v), u the vector part."""

    def turned(q: Column, u: Column, v: Column) -> Column:
        return add(v, scale(cross(u, add(cross(u, v), scale(v, q.w))), 2.0))

    return let(lambda q, v: let(lambda u: turned(q, u, v), vec3(q.x, q.y, q.z)), q, v)


def q_angle(a: Column, b: Column) -> Column:
    """Degrees between two rotations."""
    return F.degrees(2 * F.acos(clamp(F.abs(q_dot(a, b)), 0, 1)))


def slerp(a: Column, b: Column, t: float | Column) -> Column:
    """Along the shorter arc; linear where the two are nearly equal (dot above 0.9995)."""

    def mixed(a: Column, b: Column, t: Column, d: Column) -> Column:
        near, angle = F.abs(d) > 0.9995, F.acos(F.least(F.abs(d), F.lit(1.0)))
        wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
        wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * F.when(d < 0, -1.0).otherwise(1.0)
        return let(lambda wa, wb: quat(wa * a.w + wb * b.w, wa * a.x + wb * b.x, wa * a.y + wb * b.y, wa * a.z + wb * b.z), wa, wb)

    return q_normalized(let(lambda a, b, t: let(lambda d: mixed(a, b, t, d), q_dot(a, b)), a, b, lit(t)))


def from_axis_angle(axis: Column, degrees: float | Column) -> Column:
    made = let(lambda a, h: quat(F.cos(h), a.x * F.sin(h), a.y * F.sin(h), a.z * F.sin(h)), normalized(axis), F.radians(lit(degrees)) / 2)
    return q_normalized(made)


def to_axis_angle(q: Column) -> Column:
    """struct(axis, degrees); the x axis and 0 for the identity."""

    def parts(q: Column) -> Column:
        half = F.acos(clamp(q.w, -1, 1))
        turned = F.sin(half) > 1e-7
        axis = F.when(turned, scale(vec3(q.x, q.y, q.z), 1 / F.sin(half))).otherwise(vec3(1, 0, 0))
        return F.struct(axis.alias("axis"), F.when(turned, F.degrees(2 * half)).otherwise(0.0).alias("degrees"))

    return let(parts, q_normalized(q))


def rotation_between(a: Column, b: Column) -> Column:
    """The shortest rotation that takes the direction of a to that of b."""

    def turn(a: Column, b: Column, d: Column, axis: Column, side: Column) -> Column:
        side = let(lambda s: normalized(F.when(length_sq(s) < 1e-7, cross(vec3(0, 1, 0), a)).otherwise(s)), side)
        half = let(lambda s: quat(0, s.x, s.y, s.z), side)
        return (
            F.when(d > 1 - 1e-7, identity())
            .when(d < -1 + 1e-7, half)
            .otherwise(q_normalized(quat(1 + d, axis.x, axis.y, axis.z)))
        )

    return let(
        lambda a, b: let(lambda d, axis, side: turn(a, b, d, axis, side), dot(a, b), cross(a, b), cross(vec3(1, 0, 0), a)), normalized(a), normalized(b)
    )


def euler_to_quat(e: Column) -> Column:
    """Degrees about x, y, z (intrinsic) to a unit quaternion: a product of three, so it needs no normalising."""

    def made(cx: Column, sx: Column, cy: Column, sy: Column, cz: Column, sz: Column) -> Column:
        return quat(
            cx * cy * cz + sx * sy * sz,
            sx * cy * cz - cx * sy * sz,
            cx * sy * cz + sx * cy * sz,
            cx * cy * sz - sx * sy * cz,
        )

    def halves(e: Column) -> Column:
        return made(*(f(F.radians(e[a]) / 2) for a in "xyz" for f in (F.cos, F.sin)))

    return let(halves, e)


def quat_to_euler(q: Column) -> Column:
    """Degrees about x, y, z; the middle angle stops at 90 either way."""

    def angles(q: Column) -> Column:
        s = 2 * (q.w * q.y - q.z * q.x)
        return vec3(
            F.degrees(F.atan2(2 * (q.w * q.x + q.y * q.z), 1 - 2 * (q.x * q.x + q.y * q.y))),
            F.when(F.abs(s) >= 1, F.signum(s) * 90.0).otherwise(F.degrees(F.asin(clamp(s, -1, 1)))),
            F.degrees(F.atan2(2 * (q.w * q.z + q.x * q.y), 1 - 2 * (q.y * q.y + q.z * q.z))),
        )

    return let(angles, q)


# Matrices


def quat_to_mat3(q: Column) -> Column:


    def cells(q: Column) -> Column:
        w, x, y, z = q.w, q.x, q.y, q.z
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return let(cells, q)


def mat3_from_columns(a: Column, b: Column, c: Column) -> Column:
    return let(lambda a, b, c: F.array(a.x, b.x, c.x, a.y, b.y, c.y, a.z, b.z, c.z), a, b, c)


def mat3_mul(a: Column, b: Column) -> Column:
    def cells(a: Column, b: Column) -> Column:
        return F.array(*(a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)))

    return let(cells, a, b)


def mat3_transpose(m: Column) -> Column:
    return let(lambda m: F.array(*(m[3 * c + r] for r in range(3) for c in range(3))), m)


def mat3_determinant(m: Column) -> Column:

    def expand(m: Column) -> Column:
        return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])

    return let(expand, m)


def mat3_to_quat(m: Column) -> Column:
    """From a rotation matrix, starting from whichever component is greatest."""

    def root(x: Column) -> Column:  # branches that are not taken must not fail
        return 2 * F.sqrt(F.greatest(x, F.lit(1e-300)))

    def pick(m: Column) -> Column:
        t = m[0] + m[4] + m[8]
        s0, s1, s2, s3 = root(1 + t), root(1 + m[0] - m[4] - m[8]), root(1 + m[4] - m[0] - m[8]), root(1 + m[8] - m[0] - m[4])
        a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
        d, e, f = m[1] + m[3], m[2] + m[6], m[5] + m[7]
        return (
            F.when(t > 0, quat(s0 / 4, a / s0, b / s0, c / s0))
            .when((m[0] > m[4]) & (m[0] > m[8]), quat(a / s1, s1 / 4, d / s1, e / s1))
            .when(m[4] > m[8], quat(b / s2, d / s2, s2 / 4, f / s2))
            .otherwise(quat(c / s3, e / s3, f / s3, s3 / 4))
        )

    return q_normalized(let(pick, m))


def mat3_to_rot6d(m: Column) -> Column:
    return let(lambda m: F.array(m[0], m[3], m[6], m[1], m[4], m[7]), m)


def rot6d_to_mat3(r: Column) -> Column:
    """Gram-Schmidt on the two columns; the third is their cross product."""

    def third(a: Column, b: Column) -> Column:
        return mat3_from_columns(a, b, cross(a, b))

    def second(a: Column, b: Column) -> Column:
        return let(lambda b: third(a, b), normalized(sub(b, scale(a, dot(a, b)))))

    return let(lambda r: let(second, normalized(vec3(r[0], r[1], r[2])), vec3(r[3], r[4], r[5])), r)


def quat_to_rot6d(q: Column) -> Column:
    return mat3_to_rot6d(quat_to_mat3(q))


def rot6d_to_quat(r: Column) -> Column:
    return mat3_to_quat(rot6d_to_mat3(r))


def look_rotation(forward: Column, up: Column) -> Column:
    basis = let(lambda f: let(lambda r: mat3_from_columns(r, cross(f, r), f), normalized(cross(up, f))), normalized(forward))
    return mat3_to_quat(basis)


def heading(q: Column) -> Column:
    """Radians of the forward (z) direction about the vertical axis."""
    return let(lambda forward: F.atan2(forward.x, forward.z), q_rotate(q, vec3(0, 0, 1)))
