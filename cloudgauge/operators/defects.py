"""Dents and bumps: connected groups of points far from the fitted surface."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.functions.vec import dot, fields, sub, vec
from cloudgauge.operators.cloud import filter_finite
from cloudgauge.operators.fit import pca
from cloudgauge.operators.graph import connected_components
from cloudgauge.operators.models import signed_error
from cloudgauge.operators.neighbours import estimate_spacing, reach_edges
from cloudgauge.session import cut_lineage, join_on, salted_join

# Fixed values.
DEPTH, MIN_POINTS, SPACING_FACTOR = 1.0, 3, 2.5


def measure_defects(
    df: DataFrame,
    models: DataFrame,
    depth: float = DEPTH,
    radius: float | None = None,
    min_points: int = MIN_POINTS,
    by: Sequence[str] = ("cloud_id",),
) -> tuple[DataFrame, DataFrame]:
    """``(defects, members)``.

    Points with an error of at least ``depth`` are grouped with those of the same sign
    within ``radius`` (2.5 times each cloud's spacing when not given; no spacing is an
    error). ``defect_id`` is the smallest point id, so ordering by it gives first-member
    order. Area is the bounding rectangle in the defect's own plane.
    """
    bad_radius = radius is not None and (not math.isfinite(radius) or radius <= 0)
    if not math.isfinite(depth) or depth <= 0 or bad_radius or min_points < 1:
        raise ValueError("depth, radius and min_points must be positive")
    keys = list(by)
    errors = signed_error(filter_finite(df).select(*keys, "point_id", "x", "y", "z"), models, keys)
    far = errors.filter(F.abs("signed_error") >= depth).withColumn("dent", F.col("signed_error") < 0)
    far = far.withColumns({a: F.col(a) + F.lit(0.0) for a in "xyz"})
    if radius is None:
        spacing = estimate_spacing(df, keys)
        usable = F.when(
            ~(F.col("spacing") > 0), F.raise_error(F.lit("no spacing could be estimated, give a radius"))
        ).otherwise(F.col("spacing") * SPACING_FACTOR)
        scaled = cut_lineage(salted_join(
            far, spacing.select(*keys, usable.alias("_reach")), keys, spread=["point_id"]))
        # In units of the cloud's own radius, all clouds share the reach 1.
        space = scaled.withColumns({a: F.col(a) / F.col("_reach") for a in "xyz"})
        reach = 1.0
    else:
        scaled = cut_lineage(far.withColumn("_reach", F.lit(1.0)))
        space, reach = scaled, float(radius)
    group = [*keys, "dent"]
    vertices, edges = reach_edges(space, reach, group)
    labels = connected_components(vertices.select(*group, "id"), edges, group)
    named = vertices.join(labels, [*group, "id"])
    joined = space.select(*group, "point_id", "signed_error", "x", "y", "z", "_reach").join(named, [*group, "x", "y", "z"])
    members = joined.select(
        *keys, "dent", F.col("label").alias("defect_id"), "point_id", "signed_error",
        *[(F.col(a) * F.col("_reach")).alias(a) for a in "xyz"])
    sizes = members.groupBy(*keys, "defect_id").agg(
        F.first("dent").alias("dent"), F.count(F.lit(1)).alias("n"), F.max(F.abs("signed_error")).alias("max_depth"))
    sizes = sizes.filter(F.col("n") >= min_points)
    named_keys = [*keys, "defect_id"]
    members = cut_lineage(members.drop("dent").join(sizes.select(*named_keys), named_keys))
    axes = pca(members, named_keys).select(*named_keys, "center", "axis2", "axis1")
    placed = salted_join(members, axes, named_keys, spread=["point_id"])
    delta = sub(vec("x", "y", "z"), fields("center"))
    placed = placed.withColumns({"_u": dot(delta, fields("axis2")), "_v": dot(delta, fields("axis1"))})
    extents = placed.groupBy(*named_keys).agg(
        (F.max("_u") - F.min("_u")).alias("length"), (F.max("_v") - F.min("_v")).alias("width"))
    defects = join_on(sizes, extents, named_keys).withColumn("area", F.col("length") * F.col("width"))
    return defects, members.select(*named_keys, "point_id")
