"""Calibration quality: table checks, pair audits, reprojection errors, board grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions.vec import add, entry, mat_vec, vec
from cloudgauge.operators.stereo import with_params

# Fixed values.
REQUIRED = ("k1", "d1", "k2", "d2", "r", "t")
MIN_PAIRS = 3


def _present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.size(name) > 0)


def load_calibrations(df: DataFrame) -> DataFrame:
    """Usable calibrations: all required matrices present; a missing projection matrix is
    taken from the camera matrix."""
    for p, k in (("p1", "k1"), ("p2", "k2")):
        if p not in df.columns:
            df = df.withColumn(p, F.col(k))
        df = df.withColumn(p, F.when(_present(p), F.col(p)).otherwise(F.col(k)))
    usable = F.lit(True)
    for name in REQUIRED:
        usable = usable & _present(name)
    return df.filter(usable)


def calibration_audit(pairs: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Valid and failed pairs and single-camera images per run, with the failed frame
    numbers as text. ``pairs`` has ``frame_number`` (1-based), ``left_found``,
    ``right_found``. A run is one calibration series, so its failures are a short list."""
    both = F.col("left_found") & F.col("right_found")

    def listed(ok: Column) -> Column:
        numbers = F.array_sort(F.collect_list(F.when(~ok, F.col("frame_number"))))
        text = F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", ")
        return F.when(text == "", "none").otherwise(text)

    out = pairs.groupBy(*by).agg(
        F.sum(F.when(both, 1).otherwise(0)).alias("successful_pairs"),
        F.sum(F.when(both, 0).otherwise(1)).alias("failed_pairs"), listed(both).alias("failed_frames"),
        F.sum(F.when(F.col("left_found"), 1).otherwise(0)).alias("left_images"),
        listed(F.col("left_found")).alias("left_failed"),
        F.sum(F.when(F.col("right_found"), 1).otherwise(0)).alias("right_images"),
        listed(F.col("right_found")).alias("right_failed"))
    enough = F.least("successful_pairs", "left_images", "right_images") >= MIN_PAIRS
    return out.withColumn("success", enough)


def project(x: Column, y: Column, z: Column, k: str, d: str) -> tuple[Column, Column]:
    """Pixel of a camera-frame point with the five parameter lens model."""
    c = [entry(d, 0, i, 5) for i in range(5)]
    px, py = x / z, y / z
    r2 = px * px + py * py
    radial = 1 + ((c[4] * r2 + c[1]) * r2 + c[0]) * r2
    dx = px * radial + 2 * c[2] * px * py + c[3] * (r2 + 2 * px * px)
    dy = py * radial + c[2] * (r2 + 2 * py * py) + 2 * c[3] * px * py
    return entry(k, 0, 0) * dx + entry(k, 0, 2), entry(k, 1, 1) * dy + entry(k, 1, 2)


def reprojection_error(
    images: DataFrame, obs: DataFrame, poses: DataFrame, cams: DataFrame, by: Sequence[str] = ("image_id",),
    cam: Sequence[str] = ("camera_id",),
) -> DataFrame:
    """Mean pixel distance of projected and observed corners per image; 0 without corners.

    ``obs``: board point ``ox, oy, oz`` and pixel ``u, v``; ``poses``: rotation ``r`` (9)
    and ``t`` (3) per image; ``cams``: ``k`` (9) and ``d`` (5) per camera.
    """
    joined = with_params(with_params(obs, poses, by), cams, cam)
    turned = add(mat_vec("r", vec("ox", "oy", "oz")), tuple(F.element_at("t", i + 1) for i in range(3)))
    staged = joined.withColumns({f"_{a}": c for a, c in zip("xyz", turned)})
    pu, pv = project(F.col("_x"), F.col("_y"), F.col("_z"), "k", "d")
    gaps = staged.select(*by, F.sqrt((pu - F.col("u")) ** 2 + (pv - F.col("v")) ** 2).alias("_gap"))
    means = gaps.groupBy(*by).agg(F.avg("_gap").alias("error"), F.count(F.lit(1)).alias("corners"))
    out = images.select(*by).distinct().join(means, list(by), "left")
    return out.na.fill(0.0, ["error"]).na.fill(0, ["corners"])


def board_grids(boards: DataFrame) -> DataFrame:
    """Corners of each board ``(width, height, square_x, square_y)``, row by row, in the
    plane z = 0."""
    rows = boards.withColumn("corner_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("width").cast("bigint") * F.col("height") - 1)))
    return rows.withColumns({
        "ox": F.expr("corner_id % width") * F.col("square_x"), "oy": F.expr("corner_id div width") * F.col("square_y"),
        "oz": F.lit(0.0)})


def board_points(
    spark: SparkSession, width: int = 11, height: int = 8, square_x: float = 15.0, square_y: float = 15.0
) -> DataFrame:
    """Corner grid of one chessboard."""
    one = spark.range(1).select(
        F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(float(square_x)).alias("square_x"),
        F.lit(float(square_y)).alias("square_y"))
    return board_grids(one).select("corner_id", "ox", "oy", "oz")
