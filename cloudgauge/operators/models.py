"""Residuals, statistics and reports for fitted shapes.

A model is one row per cloud: ``kind`` (plane, sphere, cylinder, quadric, quartic),
``center`` and ``direction`` structs, ``radius``, ``standard_diameter``, ``basis_u``,
``basis_v``, ``surface_scale``, ``coefficients``. Columns a kind does not need may be
absent. Models are joined to their points with the points spread over salts, since one
cloud may hold a large part of all points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.functions.vec import Vec, dot, fields, literal_sum, norm, scale, sub, vec
from cloudgauge.operators.cloud import filter_finite
from cloudgauge.session import salted_join

VEC3 = T.StructType([T.StructField(n, T.DoubleType()) for n in "xyz"])

MODEL_COLUMNS: dict[str, T.DataType] = {
    "kind": T.StringType(), "center": VEC3, "direction": VEC3, "offset": T.DoubleType(), "radius": T.DoubleType(),
    "standard_diameter": T.DoubleType(), "basis_u": VEC3, "basis_v": VEC3, "surface_scale": T.DoubleType(),
    "coefficients": T.ArrayType(T.DoubleType()),
}


def complete_models(models: DataFrame) -> DataFrame:
    """Add the model columns that are absent, as NULL."""
    missing = {n: F.lit(None).cast(t) for n, t in MODEL_COLUMNS.items() if n not in models.columns}
    return models.withColumns(missing) if missing else models


def surface_terms(u: Column, v: Column, degree: int) -> list[Column]:
    """Monomials by total degree, then by rising power of ``u``."""
    powers_u, powers_v = [F.lit(1.0)], [F.lit(1.0)]
    for _ in range(degree):
        powers_u.append(powers_u[-1] * u)
        powers_v.append(powers_v[-1] * v)
    return [powers_u[i] * powers_v[total - i] for total in range(degree + 1) for i in range(total + 1)]


def surface_height(u: Column, v: Column, coefficients: Column, degree: int, surface_scale: Column) -> Column:
    terms = surface_terms(u / surface_scale, v / surface_scale, degree)
    return literal_sum([F.element_at(coefficients, i + 1) * t for i, t in enumerate(terms)])


def residual(point: Vec, m: Column | None = None) -> Column:
    """Signed distance of a point to the model in the same row (or in struct ``m``)."""

    def get(name: str) -> Column:
        return F.col(name) if m is None else m[name]

    delta = sub(point, fields(get("center")))
    axis = fields(get("direction"))
    along = dot(delta, axis)
    rho = F.when(get("standard_diameter") > 0, get("standard_diameter") / 2).otherwise(get("radius"))
    u, v = dot(delta, fields(get("basis_u"))), dot(delta, fields(get("basis_v")))
    kind = get("kind")
    return (
        F.when(kind == "plane", along)
        .when(kind == "sphere", norm(delta) - rho)
        .when(kind == "cylinder", norm(sub(delta, scale(axis, along))) - rho)
        .when(kind == "quadric", along - surface_height(u, v, get("coefficients"), 2, get("surface_scale")))
        .when(kind == "quartic", along - surface_height(u, v, get("coefficients"), 4, get("surface_scale")))
    )


def with_models(df: DataFrame, models: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Attach the model of each row's cloud as struct column ``model``."""
    packed = complete_models(models).select(*by, F.struct(*[F.col(n) for n in MODEL_COLUMNS]).alias("model"))
    return salted_join(df, packed, by, spread=["x", "y", "z"])


def signed_error(df: DataFrame, models: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    joined = with_models(df, models, by)
    return joined.withColumn("signed_error", residual(vec("x", "y", "z"), F.col("model"))).drop("model")


def nearest_model_error(
    df: DataFrame, first: DataFrame, second: DataFrame, by: Sequence[str] = ("cloud_id",)
) -> DataFrame:
    """The residual of smaller size among two models; the first wins a tie."""
    once = signed_error(df, first, by).withColumnRenamed("signed_error", "_e1")
    both = signed_error(once, second, by).withColumnRenamed("signed_error", "_e2")
    chosen = F.when(F.abs("_e2") < F.abs("_e1"), F.col("_e2")).otherwise(F.col("_e1"))
    return both.withColumn("signed_error", chosen).drop("_e1", "_e2")


def residual_stats(df: DataFrame, models: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Mean, RMSE and largest residual, and the extent along the axis, over all finite
    points of each cloud."""
    joined = with_models(filter_finite(df), models, by)
    point = vec("x", "y", "z")
    model = F.col("model")
    along = dot(sub(point, fields(model["center"])), fields(model["direction"]))
    rows = joined.select(*by, residual(point, model).alias("e"), along.alias("t"))
    return rows.groupBy(*by).agg(
        F.avg("e").alias("me"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.max(F.abs("e")).alias("max_abs"),
        F.min("t").alias("axis_min"),
        F.max("t").alias("axis_max"),
        F.count(F.lit(1)).alias("n"),
    )


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def fit_report(models: DataFrame) -> DataFrame:
    """Diameter and its deviation, axial length and plane angles, where they apply."""
    kind = F.col("kind")
    round_kind = kind.isin("sphere", "cylinder")
    out = models.withColumn("diameter", F.when(round_kind, F.col("radius") * 2))
    out = out.withColumn(
        "diameter_deviation",
        F.when(round_kind & (F.col("standard_diameter") > 0), F.col("radius") * 2 - F.col("standard_diameter")))
    out = out.withColumn("axial_length", F.when(kind == "cylinder", F.col("axis_max") - F.col("axis_min")))
    for plane, part in (("xy", "z"), ("xz", "y"), ("yz", "x")):
        angle = F.degrees(F.acos(clamp01(F.abs(F.col("direction")[part]))))
        out = out.withColumn(f"angle_{plane}", F.when(kind == "plane", angle))
    return out


def plane_angle(first: DataFrame, second: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Angle in degrees between the planes of two model tables with equal keys. The second
    table should be fitted on whole clouds, never on a selection."""
    a = first.filter("kind = 'plane'").select(*by, F.col("direction").alias("_a"))
    b = second.filter("kind = 'plane'").select(*by, F.col("direction").alias("_b"))
    cosine = clamp01(F.abs(dot(fields("_a"), fields("_b"))))
    return a.join(b, list(by)).select(*by, F.degrees(F.acos(cosine)).alias("angle_deg"))


def sphere_distance(first: DataFrame, second: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    a = first.filter("kind = 'sphere'").select(*by, F.col("center").alias("_a"))
    b = second.filter("kind = 'sphere'").select(*by, F.col("center").alias("_b"))
    return a.join(b, list(by)).select(*by, norm(sub(fields("_a"), fields("_b"))).alias("distance"))
