"""Functions for SQL: the same expressions under names, as temporary SQL functions (no Python runs for them)."""

from __future__ import annotations

from pyspark.sql import SparkSession

V = "ARRAY<DOUBLE>"
Q = "STRUCT<w: DOUBLE, x: DOUBLE, y: DOUBLE, z: DOUBLE>"
BOX = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"

FUNCTIONS = {
    "vec_dot": (f"a {V}, b {V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": (f"a {V}", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_cosine": (
        f"a {V}, b {V}",
        "DOUBLE",
        "if(vec_norm(a) * vec_norm(b) > 1e-8, vec_dot(a, b) / (vec_norm(a) * vec_norm(b)), 0D)",
    ),
    "vec_distance": (f"a {V}, b {V}", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "quat_conjugate": (f"q {Q}", Q, "named_struct('w', q.w, 'x', -q.x, 'y', -q.y, 'z', -q.z)"),
    "quat_mul": (
        f"a {Q}, b {Q}",
        Q,
        "named_struct('w', a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z, 'x', a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y, "
        "'y', a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x, 'z', a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w)",
    ),
    "quat_angle": (f"a {Q}, b {Q}", "DOUBLE", "degrees(2 * acos(least(abs(a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z), 1D)))"),
    "box_inter": (
        f"a {BOX}, b {BOX}",
        "DOUBLE",
        "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0D) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0D)",
    ),
    "box_iou": (
        f"a {BOX}, b {BOX}",
        "DOUBLE",
        "if(a.w * a.h + b.w * b.h - box_inter(a, b) > 0, box_inter(a, b) / (a.w * a.h + b.w * b.h - box_inter(a, b)), 0D)",
    ),
    "safe_name": ("name STRING", "STRING", "coalesce(nullif(regexp_replace(replace(name, ' ', '_'), '[^A-Za-z0-9_-]', ''), ''), 'unnamed')"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
