"""Point-cloud filters, selections, edits, merging, down-sampling and summaries.

Points are rows ``(cloud_id, point_id, x, y, z)``; lengths are millimetres.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudgauge.functions.vec import finite
from cloudgauge.operators import ordered
from cloudgauge.session import salted_join

BY = ("cloud_id",)
AXES = ("x", "y", "z")

# Factors to millimetres, grid limit, colours and display budget.
UNITS = {"mm": 1.0, "cm": 10.0, "dm": 100.0, "m": 1000.0}
CELL_LIMIT = 9e18
SELECTED_COLOR = (255, 110, 0)
PREVIEW_BUDGET = 300_000
HISTOGRAM_BINS = 40


# -- filters -------------------------------------------------------------------------


def filter_finite(df: DataFrame) -> DataFrame:
    """Rows whose three coordinates are all finite."""
    return df.filter(finite(*AXES))


def pass_through(df: DataFrame, axis: int, lo: float, hi: float) -> DataFrame:
    """Finite rows with ``lo <= coordinate <= hi`` on one axis (0, 1 or 2)."""
    if axis not in (0, 1, 2) or not (math.isfinite(lo) and math.isfinite(hi)) or lo > hi:
        raise ValueError("pass_through needs an axis in 0..2 and finite lo <= hi")
    return filter_finite(df).filter(F.col(AXES[axis]).between(lo, hi))


# -- import options ------------------------------------------------------------------


def stride_filter(index: str, total: str, keep: str) -> Column:
    """True for row ``index`` when it is one of ``floor(i * total / keep)``, ``i < keep``."""
    i = f"(({index} * {keep} + {total} - 1) div {total})"
    return F.expr(f"{i} < {keep} AND ({i} * {total}) div {keep} = {index}")


def import_cloud(df: DataFrame, unit: str = "mm", rate: float = 1.0, by: Sequence[str] = BY) -> DataFrame:
    """Scale to millimetres and keep ``max(1, floor(n * rate))`` evenly strided points."""
    if unit not in UNITS or not 0 < rate <= 1:
        raise ValueError("unknown unit, or rate outside (0, 1]")
    factor = UNITS[unit]
    scaled = df.withColumns({axis: F.col(axis) * factor for axis in AXES})
    if rate == 1.0:
        return scaled
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.withColumn("_keep", F.greatest(F.lit(1), F.floor(F.col("_n") * rate)).cast("bigint"))
    joined = salted_join(scaled, totals, by, spread=["point_id"])
    kept = joined.filter(stride_filter("point_id", "_n", "_keep"))
    return kept.drop("_n", "_keep").select(*df.columns)


# -- selection and edits -------------------------------------------------------------


def select_all(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", F.lit(True))


def select_none(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", F.lit(False))


def invert_selection(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", ~F.col("selected"))


def select_indices(df: DataFrame, keys: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add the rows named in ``keys (cloud_id, point_id)`` to the selection; keys of no
    point are ignored."""
    wanted = keys.select(*by, "point_id").distinct().withColumn("_hit", F.lit(True))
    before = F.col("selected") if "selected" in df.columns else F.lit(False)
    return (
        df.join(wanted, [*by, "point_id"], "left")
        .withColumn("selected", before | F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_hit")
    )


def rect_polygon(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    left, right, top, bottom = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    return [(left, top), (right, top), (right, bottom), (left, bottom)]


def ellipse_polygon(x0: int, y0: int, x1: int, y1: int, corners: int = 64) -> list[tuple[int, int]]:
    """Corner points of the ellipse inside a pixel rectangle, cut to whole pixels."""
    left, right, top, bottom = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    width, height = right - left + 1, bottom - top + 1
    cx, cy = left + width / 2, top + height / 2
    turn = 2 * math.pi / corners
    return [
        (int(cx + width / 2 * math.cos(i * turn)), int(cy + height / 2 * math.sin(i * turn)))
        for i in range(corners)
    ]


def inside_polygon(px: Column, py: Column, polygon: Sequence[tuple[int, int]]) -> Column:
    """Odd-even rule: count the edges that a ray to the left of the pixel crosses."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by_) in zip(polygon, [*polygon[1:], polygon[0]]):
        if ay == by_:
            continue
        (lx, ly), (hx, hy) = ((ax, ay), (bx, by_)) if ay < by_ else ((bx, by_), (ax, ay))
        at = F.lit(float(lx)) + F.lit((hx - lx) / (hy - ly)) * (py - F.lit(ly))
        crossings = crossings + F.when((py >= ly) & (py < hy) & (at <= px), 1).otherwise(0)
    return F.pmod(crossings, F.lit(2)) == 1


def select_polygon(
    df: DataFrame,
    matrix: Sequence[float],
    width: int,
    height: int,
    polygon: Sequence[tuple[int, int]],
    mode: str = "replace",
) -> DataFrame:
    """Select the points whose screen pixel lies in ``polygon``, hidden ones included.

    ``matrix`` is the row-major 4x4 view projection. ``mode`` is ``replace``, ``add`` or
    ``remove``. A polygon of fewer than three corners changes nothing.
    """
    if mode not in ("replace", "add", "remove"):
        raise ValueError("mode must be replace, add or remove")
    before = F.col("selected") if "selected" in df.columns else F.lit(False)
    if len(polygon) < 3:
        return df.withColumn("selected", before)
    clip = [
        sum((F.col(a) * F.lit(float(matrix[4 * r + c])) for c, a in enumerate(AXES)), F.lit(0.0))
        + F.lit(float(matrix[4 * r + 3]))
        for r in range(4)
    ]
    w = F.when(clip[3] > 1e-12, clip[3])
    nx, ny, nz = (c / w for c in clip[:3])
    visible = w.isNotNull() & nz.between(-1, 1) & (F.abs(nx) <= 1) & (F.abs(ny) <= 1)
    staged = df.withColumns({
        "_px": F.when(visible, ((nx + 1) * F.lit(width) / 2).cast("int")),
        "_py": F.when(visible, ((F.lit(1.0) - ny) * F.lit(height) / 2).cast("int")),
    })
    hit = F.coalesce(inside_polygon(F.col("_px"), F.col("_py"), polygon), F.lit(False))
    chosen = {"replace": hit, "add": before | hit, "remove": before & ~hit}[mode]
    return staged.withColumn("selected", chosen).drop("_px", "_py")


def edit_selection(df: DataFrame, op: str, suffix: str = "_edit", by: str = "cloud_id") -> DataFrame:
    """``delete`` drops the selected points, ``keep`` and ``extract`` drop the others.

    The result is a new cloud per cloud that had a selection. A cloud without a selection,
    or whose result would be empty, gives no rows: its original stays as it is.
    """
    if op not in ("delete", "keep", "extract"):
        raise ValueError("op must be delete, keep or extract")
    touched = df.groupBy(by).agg(F.bool_or("selected").alias("_any")).filter("_any").drop("_any")
    rows = salted_join(df, touched, [by], spread=["point_id"])
    kept = rows.filter(~F.col("selected") if op == "delete" else F.col("selected"))
    return kept.withColumn(by, F.concat(F.col(by), F.lit(suffix))).drop("selected").select(
        *[c for c in df.columns if c != "selected"])


def working_set(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The selected points of a cloud, or all of them where none is selected."""
    flags = df.groupBy(*by).agg(F.bool_or("selected").alias("_any"))
    joined = salted_join(df, flags, by, spread=["point_id"])
    return joined.filter(F.col("selected") | ~F.col("_any")).select(*df.columns)


# -- merging -------------------------------------------------------------------------


def merge_clouds(df: DataFrame, ids: Sequence[str], new_id: str) -> DataFrame:
    """Concatenate clouds in list order, duplicates kept, with new dense ids."""
    if len(ids) < 2:
        raise ValueError("merge_clouds needs at least two clouds")
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("cloud_id"))
    rows = df.filter(F.col("cloud_id").isin(list(ids))).withColumn("_place", place)
    rows = rows.withColumn("cloud_id", F.lit(new_id))
    ranked = ordered.row_number(
        rows, ["cloud_id"], ["_place", "point_id"], "_new",
        F.struct(F.col("_place"), ordered.point_slice().alias("_part")),
    )
    return ranked.withColumn("point_id", F.col("_new") - 1).drop("_new", "_place").select(*df.columns)


# -- down-sampling and summaries -----------------------------------------------------


def cell(axis: str, size: float) -> Column:
    quotient = F.col(axis) / F.lit(float(size))
    checked = F.when(F.abs(quotient) > CELL_LIMIT, F.raise_error(F.lit("voxel size too small for the coordinates")))
    return checked.otherwise(F.floor(quotient)).cast("bigint")


def voxel_downsample(
    df: DataFrame, size: float, by: Sequence[str] = BY, dense_ids: bool = False
) -> DataFrame:
    """Centroid per cubic cell. Cells carry their integer key ``kx, ky, kz`` and ``n``;
    ``dense_ids`` numbers them in key order (this costs a sort)."""
    if not math.isfinite(size) or size <= 0:
        raise ValueError("voxel size must be positive")
    keys = [cell(a, size).alias(f"k{a}") for a in AXES]
    cells = (
        filter_finite(df)
        .groupBy(*by, *keys)
        .agg(*[F.avg(a).alias(a) for a in AXES], F.count(F.lit(1)).alias("n"))
    )
    if not dense_ids:
        return cells
    ranked = ordered.row_number(cells, by, ["kx", "ky", "kz"], "_at", None)
    return ranked.withColumn("point_id", F.col("_at") - 1).drop("_at")


def cloud_summary(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Count, bounds, size and centroid of the finite points of each cloud."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for a in AXES:
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.avg(a).alias(f"mean_{a}")]
    out = filter_finite(df).groupBy(*by).agg(*aggs)
    return out.withColumns({f"size_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES})


def upper_median(name: str) -> Column:
    """The element at position ``n div 2`` of the sorted values of a column."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def error_histogram(
    df: DataFrame, by: Sequence[str] = BY, column: str = "signed_error", bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Counts of ``bins`` equal bins between each group's smallest and largest error."""
    spans = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = salted_join(df.select(*by, column), spans, by, spread=[column])
    width = F.greatest(F.lit(1e-12), F.col("_hi") - F.col("_lo"))
    at = ((F.col(column) - F.col("_lo")) / width * F.lit(bins)).cast("int")
    binned = joined.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


# -- display -------------------------------------------------------------------------


def error_color(df: DataFrame, error_range: float, column: str = "signed_error") -> DataFrame:
    """Blue-green-red ramp over ``[-range, range]``; selected points get their own colour."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(column) / F.lit(max(error_range, 1e-12))))

    def rgb(r: Column, g: Column, b: Column) -> Column:
        return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))

    ramp = (
        F.when(v < 0, rgb(F.lit(0), 255 * (1 + v), -255 * v))
        .when(v < 0.5, rgb(v * 510, F.lit(255), F.lit(0)))
        .otherwise(rgb(F.lit(255), 510 * (1 - v), F.lit(0)))
    )
    if "selected" in df.columns:
        ramp = F.when(F.col("selected"), rgb(*[F.lit(c) for c in SELECTED_COLOR])).otherwise(ramp)
    return df.withColumn("color", ramp)


def preview(df: DataFrame, budget: int = PREVIEW_BUDGET) -> DataFrame:
    """Every ``stride``-th finite point of each shown cloud, the stride set so that about
    ``budget`` points of all clouds together remain."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    stride = F.greatest(F.lit(1), F.ceil(total / F.lit(budget))).cast("bigint")
    return filter_finite(df).filter(F.pmod(F.col("point_id"), stride) == 0)


def preview_bounds(df: DataFrame) -> DataFrame:
    """Bounds of the view: over all finite points, not only the shown ones."""
    return filter_finite(df).agg(
        *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])

