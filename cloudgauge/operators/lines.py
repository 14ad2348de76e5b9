"""Laser-line extraction from pixel tables.

Pixels are rows ``(frame keys, y, x, gray)`` inside the region of interest, or with
``b, g, r``. All neighbourhood work scatters a pixel to the few positions it touches and
groups by position with map-side combination; no image is ever gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.operators import ordered
from cloudgauge.operators.graph import connected_components
from cloudgauge.session import cut_lineage, join_on

FRAME = ("frame_id",)

# Fixed values of the two extraction modes.
CENTROID_MIN_AREA, CENTROID_BORDER = 30.0, 2
RIDGE_MIN_AREA, RIDGE_BORDER = 500.0, 10
MIN_ROW_TOTAL = 200.0
CHANNELS = {"blue": "b", "green": "g", "red": "r"}


def laser_gray(color: str = "gray", b: str = "b", g: str = "g", r: str = "r") -> Column:
    """Grey value for a laser colour: one channel, or the usual luma weights."""
    if color == "gray":
        return F.round(F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114).cast("int")
    return F.col({"b": b, "g": g, "r": r}[CHANNELS[color]])


def clamp_roi(df: DataFrame, roi: tuple[int, int, int, int], image: tuple[int, int]) -> DataFrame:
    """Pixels inside ``roi = (x, y, width, height)`` cut to the image, with ``x, y``
    counted from the region's corner. No overlap is an error."""
    left, top = max(0, roi[0]), max(0, roi[1])
    right, bottom = min(image[0], roi[0] + roi[2]), min(image[1], roi[1] + roi[3])
    if left >= right or top >= bottom:
        raise ValueError("region of interest is outside the image")
    inside = df.filter(F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1))
    return inside.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def intensity_mask(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("gray") > threshold)


def _in_span(column: Column, limit: int) -> Column:
    return column.between(0, limit - 1)


def _spread(df: DataFrame, axis: str, reach: int, limit: int) -> DataFrame:
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-reach, reach + 1)])).alias("_o")
    moved = df.select("*", offsets).withColumn(axis, F.col(axis) + F.col("_o"))
    return moved.drop("_o").filter(_in_span(F.col(axis), limit))


def morph_open(mask: DataFrame, width: int, height: int, by: Sequence[str] = FRAME) -> DataFrame:
    """3x3 opening of a sparse mask (one row per set pixel). Pixels outside the image do
    not count against erosion. The square kernel is done as a row and a column pass."""
    rows = mask.select(*by, "y", "x")
    for axis, limit in (("x", width), ("y", height)):
        touched = _spread(rows, axis, 1, limit).groupBy(*by, "y", "x").agg(F.count(F.lit(1)).alias("_c"))
        edge = F.when(F.col(axis) == 0, 1).otherwise(0) + F.when(F.col(axis) == limit - 1, 1).otherwise(0)
        rows = touched.filter(F.col("_c") == 3 - edge).drop("_c")
    for axis, limit in (("x", width), ("y", height)):
        rows = _spread(rows, axis, 1, limit).distinct()
    return rows


# -- connected regions by runs -------------------------------------------------------


def pixel_runs(mask: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """``(by, y, x0, x1)``: the longest runs of set pixels in each image row. Repeated pixels count once."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    rows = mask.select(*by, "y", "x", (F.col("x") - F.dense_rank().over(w)).alias("_g"))
    return rows.groupBy(*by, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def _code() -> Column:
    return F.shiftleft(F.col("y").cast("bigint"), 32) + F.col("x0")


def _touching(runs: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """``(keys, src, dst)``: runs of neighbouring rows that overlap when widened by ``reach`` (0 or 1).

    Of two such runs the one that starts later does so inside the other, which is then the last of its row to start
    before. So each run looks at one run of the row above and one of the row below, and no pairs are formed.
    """
    sides = F.array(F.struct(F.col("y").alias("row"), F.lit(True).alias("up")),
                    F.struct((F.col("y") - 1).alias("row"), F.lit(False).alias("up")))
    rows = runs.select(*keys, _code().alias("src"), "x0", "x1", F.explode(sides).alias("_s")).select(
        *keys, "src", "x0", "x1", "_s.row", "_s.up")
    before = Window.partitionBy(*keys, "row").orderBy("x0", "up").rowsBetween(Window.unboundedPreceding, -1)

    def last(up: bool) -> Column:
        return F.last(F.when(F.col("up") == up, F.struct("src", "x1")), ignorenulls=True).over(before)

    met = rows.withColumns({"_upper": last(True), "_lower": last(False)})
    other = F.when(F.col("up"), F.col("_lower")).otherwise(F.col("_upper"))
    met = met.withColumn("_o", other).filter(F.col("_o.x1") + reach >= F.col("x0"))
    return met.select(*keys, "src", F.col("_o.src").alias("dst"))


def _labelled(runs: DataFrame, keys: Sequence[str], reach: int, label: str) -> DataFrame:
    """``runs`` with the smallest run code of their connected region."""
    coded = runs.withColumn("id", _code())
    found = connected_components(coded.select(*keys, "id"), _touching(runs, keys, reach), keys)
    return coded.join(found.withColumnRenamed("label", label), [*keys, "id"]).drop("id")


def pixel_components(mask: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """``(by, y, x, label)`` of the 8-connected regions of a sparse mask."""
    runs = _labelled(cut_lineage(pixel_runs(mask, by)), by, 1, "label")
    return runs.select(*by, F.col("y").cast("int").alias("y"),
                       F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"), "label")


def _filled(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of each region with its holes. Only gaps between two runs of a row can belong to a hole, and a 4-connected
    group of them does unless one of them lies beside a place outside the first and last run of the next row."""
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    gaps = runs.withColumn("_before", F.lag("x1").over(row)).filter("_before is not null").select(
        *keys, "y", (F.col("_before") + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    gaps = cut_lineage(gaps)
    if gaps.isEmpty():
        return runs
    spans = runs.groupBy(*keys, "y").agg(F.min("x0").alias("_a"), F.max("x1").alias("_b"))
    groups = cut_lineage(_labelled(gaps, keys, 0, "_hole"))
    beside = groups.withColumn("_to", F.explode(F.array(F.col("y") - 1, F.col("y") + 1))).join(
        spans.withColumnRenamed("y", "_to"), [*keys, "_to"], "left")
    leaves = F.col("_a").isNull() | (F.col("x0") < F.col("_a")) | (F.col("x1") > F.col("_b"))
    outside = beside.filter(leaves).select(*keys, "_hole").distinct()
    holes = groups.join(outside, [*keys, "_hole"], "left_anti")
    both = runs.select(*keys, "y", "x0", "x1").unionByName(holes.select(*keys, "y", "x0", "x1"))
    begins = F.coalesce(F.col("x0") > F.lag("x1").over(row) + 1, F.lit(True)).cast("int")
    joined = both.withColumn("_new", begins).withColumn("_g", F.sum("_new").over(row))
    return joined.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def _enclosed(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _inner)``: pixels whose four neighbours are set, counted where the row's runs without their ends and the
    runs of the rows above and below all overlap."""
    def ends(y: Column, begin: Column, stop: Column) -> list[Column]:
        return [F.struct(y.alias("row"), at.alias("at"), F.lit(d).alias("d")) for at, d in ((begin, 1), (stop, -1))]

    y, x0, x1 = F.col("y"), F.col("x0"), F.col("x1")
    events = F.array(*ends(y, x0 + 1, F.greatest(x1, x0 + 1)), *ends(y - 1, x0, x1 + 1), *ends(y + 1, x0, x1 + 1))
    rows = runs.select(*keys, F.explode(events).alias("_e")).select(*keys, "_e.row", "_e.at", "_e.d")
    w = Window.partitionBy(*keys, "row").orderBy("at")
    depth = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = rows.select(*keys, depth.alias("_depth"), (F.lead("at").over(w) - F.col("at")).alias("_length"))
    return parts.filter("_depth = 3").groupBy(*keys).agg(F.sum("_length").alias("_inner"))


def stripe_ranges(
    mask: DataFrame, width: int, height: int, min_area: float, border: int, by: Sequence[str] = FRAME
) -> DataFrame:
    """Bounding boxes of the large connected regions, grown by ``border`` and cut to the
    image, numbered ``range_id`` by (y, x) from 0. The area is that of the outline through
    the pixel centres, holes filled: ``N - B / 2 - 1`` with ``B`` outline pixels. Regions are
    handled as runs of pixels in image rows, so a thin stripe across the frame costs its runs and not its box."""
    keys = [*by, "region"]
    runs = cut_lineage(_labelled(cut_lineage(pixel_runs(mask, by)), by, 1, "region"))
    full = _filled(runs, keys)
    inner = _enclosed(full, keys)
    boxes = full.groupBy(*keys).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"), F.min("y").alias("_ly"), F.max("y").alias("_hy"),
        F.min("x0").alias("_lx"), F.max("x1").alias("_hx"))
    boxes = join_on(boxes, inner, keys, "left")
    outline = F.col("_n") - F.coalesce("_inner", F.lit(0))
    boxes = boxes.withColumn("area", F.greatest(F.lit(0.0), F.col("_n") - outline / 2 - 1)).filter(
        F.col("area") >= min_area)
    x0, y0 = F.greatest(F.lit(0), F.col("_lx") - border), F.greatest(F.lit(0), F.col("_ly") - border)
    w = F.least(F.lit(width) - x0, F.col("_hx") - F.col("_lx") + 1 + 2 * border)
    h = F.least(F.lit(height) - y0, F.col("_hy") - F.col("_ly") + 1 + 2 * border)
    sized = boxes.select(
        *by, "region", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), w.cast("int").alias("w"),
        h.cast("int").alias("h"), "area")
    ranked = ordered.row_number(sized, by, ["y0", "x0", "region"], "_at", F.floor(F.col("y0") / 64))
    return ranked.withColumn("range_id", F.col("_at") - 1).drop("_at", "region")


def whole_ranges(frames: DataFrame, width: int, height: int, by: Sequence[str] = FRAME) -> DataFrame:
    return frames.select(*by).distinct().select(
        *by, F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(width).alias("w"), F.lit(height).alias("h"),
        F.lit(float(width * height)).alias("area"), F.lit(0).cast("bigint").alias("range_id"))


def ranges_or_whole(
    ranges: DataFrame, frames: DataFrame, width: int, height: int, by: Sequence[str] = FRAME
) -> DataFrame:
    """The found ranges, and the whole region for frames that have none."""
    missing = frames.select(*by).distinct().join(ranges.select(*by).distinct(), list(by), "left_anti")
    return ranges.unionByName(whole_ranges(missing, width, height, by))


def _in_ranges(pixels: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels of each range: ranges become rows of (frame, y), so that a frame's pixels
    meet only the ranges of their own line."""
    lines = ranges.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)))
    joined = pixels.join(lines.select(*by, "y", "range_id", "x0", "y0", "w", "h"), [*by, "y"])
    return joined.filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")))


def gray_centroid(
    pixels: DataFrame, mask: DataFrame, ranges: DataFrame, min_gray: float, roi_x: int = 0, roi_y: int = 0,
    by: Sequence[str] = FRAME,
) -> DataFrame:
    """Grey-weighted centre per image row and range, over masked pixels brighter than
    ``min_gray``. Rows with a total under 200 give nothing."""
    bright = pixels.filter(F.col("gray") > min_gray).join(mask.select(*by, "y", "x"), [*by, "y", "x"], "left_semi")
    rows = _in_ranges(bright, ranges, by)
    sums = rows.groupBy(*by, "range_id", "y").agg(
        F.sum(F.col("gray").cast("double")).alias("_total"), F.sum(F.col("gray").cast("double") * F.col("x")).alias("_wx"))
    return sums.filter(F.col("_total") >= MIN_ROW_TOTAL).select(
        *by, "range_id", "y", (F.col("_wx") / F.col("_total") + roi_x).alias("u"),
        (F.col("y") + roi_y).cast("double").alias("v"))


def ridge_points(
    pixels: DataFrame, mask: DataFrame, ranges: DataFrame, stripe_width: float, selection: float,
    roi_x: int = 0, roi_y: int = 0, by: Sequence[str] = FRAME,
) -> DataFrame:
    """Sub-pixel ridge points from Gaussian derivatives and the Hessian's normal.

    The derivative kernels are products of 1-D kernels: a row pass scatters each pixel of
    a range to the columns it touches, a column pass sums those for candidates only.
    Neighbours outside the range count as dark. A pixel is used by the first range, in
    range order, that accepts it.
    """
    sigma = max(0.5, stripe_width / math.sqrt(3.0))
    radius = max(1, math.floor(3.0 * sigma + 0.5))
    g = {o: math.exp(-o * o / (2 * sigma * sigma)) for o in range(-radius, radius + 1)}
    second = {o: (o * o / (sigma * sigma) - 1.0) * g[o] for o in g}
    c4, c6 = 1 / (2 * math.pi * sigma**4), 1 / (2 * math.pi * sigma**6)

    def kernel(sign: int) -> Column:
        return F.explode(F.array(*[
            F.struct(F.lit(o).alias("o"), F.lit(g[o]).alias("g0"), F.lit(sign * o * g[o]).alias("g1"),
                     F.lit(second[o]).alias("g2")) for o in sorted(g)])).alias("_k")

    keys = [*by, "range_id"]
    lit = _in_ranges(pixels.filter("gray > 0"), ranges, by)
    k = F.col("_k")
    # A pixel at x adds to column x + o, for which it lies at offset -o.
    scattered = lit.select(*keys, "y", "x", "x0", "w", F.col("gray").cast("double").alias("_i"), kernel(-1))
    scattered = scattered.withColumn("x", F.col("x") + k["o"]).filter(
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("w")))
    rows = scattered.groupBy(*keys, "y", "x").agg(
        *[F.sum(F.col("_i") * k[n]).alias(f"_h{i}") for i, n in enumerate(("g0", "g1", "g2"))])
    candidates = lit.filter(F.col("gray") > selection).join(mask.select(*by, "y", "x"), [*by, "y", "x"], "left_semi")
    reach = candidates.select(*keys, "x", F.col("y").alias("_cy"), kernel(1)).withColumn("y", F.col("_cy") + k["o"])
    met = reach.join(rows, [*keys, "y", "x"])
    d = met.groupBy(*keys, "x", F.col("_cy").alias("y")).agg(
        (F.sum(F.col("_h1") * k["g0"]) * c4).alias("dx"), (F.sum(F.col("_h0") * k["g1"]) * c4).alias("dy"),
        (F.sum(F.col("_h2") * k["g0"]) * c4).alias("a"), (F.sum(F.col("_h1") * k["g1"]) * c6).alias("b"),
        (F.sum(F.col("_h0") * k["g2"]) * c4).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    d = d.withColumn("_root", F.sqrt((a - c) * (a - c) + 4 * b * b))
    root = F.col("_root")
    swap = F.abs((a + c + root) / 2) < F.abs((a + c - root) / 2)
    along = c - a + root
    d = d.withColumns({"_nx": F.when(swap, -along).otherwise(2 * b), "_ny": F.when(swap, 2 * b).otherwise(along)})
    d = d.withColumn("_mag", F.sqrt(F.col("_nx") ** 2 + F.col("_ny") ** 2)).filter("_mag >= 1e-9")
    d = d.withColumns({"_nx": F.col("_nx") / F.col("_mag"), "_ny": F.col("_ny") / F.col("_mag")})
    nx, ny = F.col("_nx"), F.col("_ny")
    d = d.withColumn("_den", a * nx * nx + 2 * b * nx * ny + c * ny * ny).filter("abs(_den) >= 1e-9")
    d = d.withColumn("_t", -(F.col("dx") * nx + F.col("dy") * ny) / F.col("_den"))
    d = d.withColumns({"_px": F.col("_t") * nx, "_py": F.col("_t") * ny}).filter("abs(_px) <= 0.5 AND abs(_py) <= 0.5")
    first = d.groupBy(*by, "y", "x").agg(F.min_by(F.struct("range_id", "_px", "_py"), "range_id").alias("_f"))
    return first.select(
        *by, F.col("_f.range_id").alias("range_id"), "y", "x", (F.col("x") + F.col("_f._px") + roi_x).alias("u"),
        (F.col("y") + F.col("_f._py") + roi_y).alias("v"))


def _row_slice() -> Column:
    return F.struct(F.col("range_id"), F.floor(F.col("y") / 64).alias("_part"))


def middle_per_row(points: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """The candidate at position ``count div 2`` of each image row of a range."""
    keys = [*by, "range_id", "y"]
    ranked = ordered.row_number(points, keys, ["x"], "_at", F.floor(F.col("x") / 4096))
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_on(ranked, counts, keys).filter(F.expr("_at = _n div 2 + 1")).select(*points.columns)


def number_observations(points: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """``obs_id`` in line order: range, image row, column."""
    order = ["range_id", "y"] + (["x"] if "x" in points.columns else [])
    ranked = ordered.row_number(points, by, order, "_at", _row_slice())
    return ranked.withColumn("obs_id", F.col("_at") - 1).drop("_at")


def trim_line_ends(line_obs: DataFrame, n: int, by: Sequence[str] = ("frame_id", "side")) -> DataFrame:
    """Drop the first and last ``n`` observations of lines longer than ``2 n``. Ids stay."""
    if n <= 0:
        return line_obs
    ranked = ordered.row_number(line_obs, by, ["obs_id"], "_at", ordered.point_slice("obs_id"))
    counts = line_obs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_on(ranked, counts, by)
    keep = (F.col("_n") <= 2 * n) | ((F.col("_at") > n) & (F.col("_at") <= F.col("_n") - n))
    return joined.filter(keep).select(*line_obs.columns)


def extract_centroid(
    pixels: DataFrame, width: int, height: int, threshold: float = 120, min_gray: float = 20, trim: int = 0,
    roi_x: int = 0, roi_y: int = 0, by: Sequence[str] = FRAME, frames: DataFrame | None = None,
) -> DataFrame:
    """Grey-centroid line of every frame: mask, opening, ranges, centroids, numbering."""
    mask = cut_lineage(morph_open(intensity_mask(pixels, threshold), width, height, by))
    ranges = stripe_ranges(mask, width, height, CENTROID_MIN_AREA, CENTROID_BORDER, by)
    ranges = ranges_or_whole(ranges, frames if frames is not None else pixels, width, height, by)
    line = number_observations(gray_centroid(pixels, mask, ranges, min_gray, roi_x, roi_y, by), by)
    return trim_line_ends(line, trim, by)


def extract_ridge(
    pixels: DataFrame, width: int, height: int, binary_threshold: float, stripe_width: float, selection: float,
    one_per_row: bool = True, trim: int = 0, roi_x: int = 0, roi_y: int = 0, by: Sequence[str] = FRAME,
    min_area: float = RIDGE_MIN_AREA, border: int = RIDGE_BORDER,
) -> DataFrame:
    """Ridge line of every frame; frames without a range give no points."""
    mask = cut_lineage(morph_open(intensity_mask(pixels, binary_threshold), width, height, by))
    ranges = cut_lineage(stripe_ranges(mask, width, height, min_area, border, by))
    points = ridge_points(pixels, mask, ranges, stripe_width, selection, roi_x, roi_y, by)
    if one_per_row:
        points = middle_per_row(points, by)
    return trim_line_ends(number_observations(points, by), trim, by)
