"""Filters, selections, edits, merging, down-sampling, summaries on the point clouds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.operators import cloud, selection
from cloudgauge.plans import recipes
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query

# A fixed perspective-like view over the recipe's value ranges (row-major).
VIEW = (0.04, 0.0, 0.0, -1.0, 0.0, 0.02, 0.0, -1.0, 0.0, 0.0, 0.1, -0.5, 0.0, 0.0, 0.05, 1.0)
WIDTH, HEIGHT = 800, 600
LASSO = [(100, 80), (700, 150), (620, 500), (400, 260), (180, 520)]


def round_all(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded for comparison (negative zero becomes zero)."""
    columns = [
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double"
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which every fifth is selected, in every cloud but each third."""
    pts = recipes.points(spark, sf_dir)
    return pts.withColumn("selected", F.expr("point_id % 5 = 2 AND cast(cloud_id as bigint) % 3 <> 0"))


#: As ``MARKED``, and whether the cloud has the point that marks it.
MARKED_CLOUDS = ("(SELECT *, (point_id % 5 = 2 AND CAST(cloud_id AS BIGINT) % 3 <> 0) AS selected, "
                 "BOOL_OR(point_id = 2) OVER (PARTITION BY cloud_id) AS has_two FROM points)")
MARKED = "(SELECT *, (point_id % 5 = 2 AND CAST(cloud_id AS BIGINT) % 3 <> 0) AS selected FROM points)"
FLAT = """SELECT CAST(l_suppkey AS VARCHAR) AS cloud_id, l_quantity AS x, l_extendedprice / 1000 AS y,
  l_discount * 100 AS z FROM lineitem"""


@query("flagship_clean_voxel_summary", sql=f"""
WITH points AS ({FLAT}), cells AS (
  SELECT cloud_id, FLOOR(x / 5.0) kx, FLOOR(y / 5.0) ky, FLOOR(z / 5.0) kz, AVG(x) x, AVG(y) y, AVG(z) z
  FROM points WHERE x BETWEEN 5 AND 45 GROUP BY ALL)
SELECT cloud_id, COUNT(*) AS n, ROUND(MIN(x), 6) AS min_x, ROUND(MAX(x), 6) AS max_x, ROUND(AVG(x), 6) AS mean_x,
  ROUND(MIN(y), 6) AS min_y, ROUND(MAX(y), 6) AS max_y, ROUND(AVG(y), 6) AS mean_y,
  ROUND(MIN(z), 6) AS min_z, ROUND(MAX(z), 6) AS max_z, ROUND(AVG(z), 6) AS mean_z,
  ROUND(MAX(x) - MIN(x), 6) AS size_x, ROUND(MAX(y) - MIN(y), 6) AS size_y, ROUND(MAX(z) - MIN(z), 6) AS size_z
FROM cells GROUP BY cloud_id""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, crop, down-sample and summarise every cloud."""
    cells = cloud.voxel_downsample(cloud.pass_through(recipes.raw_points(spark, sf_dir), 0, 5.0, 45.0), 5.0)
    return round_all(cloud.cloud_summary(cells), 6)


@query("filter_finite", sql=f"""
WITH points AS ({FLAT})
SELECT cloud_id, ROUND(x, 9) AS x, ROUND(y / (z - 3), 9) AS y, ROUND(z, 9) AS z FROM points WHERE z - 3 <> 0""")
def q_filter_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = recipes.raw_points(spark, sf_dir)
    broken = pts.withColumn("y", F.when(F.col("z") - 3 == 0, F.lit(float("nan"))).otherwise(F.col("y") / (F.col("z") - 3)))
    return round_all(cloud.filter_finite(broken))


@query("pass_through", sql=f"WITH points AS ({FLAT}) SELECT cloud_id, x, ROUND(y, 9) AS y, ROUND(z, 9) AS z "
                           "FROM points WHERE y BETWEEN 20 AND 40.5")
def q_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.pass_through(recipes.raw_points(spark, sf_dir), 1, 20.0, 40.5))


@query("import_cloud", sql=with_sql("points", body="""
, c AS (SELECT cloud_id, COUNT(*) n, GREATEST(1, CAST(FLOOR(COUNT(*) * 0.3) AS BIGINT)) k FROM points GROUP BY 1)
, kept AS (SELECT cloud_id, (i * n) // k AS point_id FROM c, LATERAL (SELECT UNNEST(RANGE(k)) AS i))
SELECT cloud_id, point_id, ROUND(x * 10, 9) AS x, ROUND(y * 10, 9) AS y, ROUND(z * 10, 9) AS z
FROM points JOIN kept USING (cloud_id, point_id)"""))
def q_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.import_cloud(recipes.points(spark, sf_dir), "cm", 0.3))


@query("selection_counts", sql=with_sql("points", body=f"""
SELECT cloud_id, COUNT(*) AS n_all, 0 AS n_none, CAST(SUM(CASE WHEN selected THEN 0 ELSE 1 END) AS BIGINT) AS n_inverted,
  CAST(SUM(CASE WHEN point_id IN (1, 4, 9) THEN 1 ELSE 0 END) AS BIGINT) AS n_listed
FROM {MARKED} GROUP BY cloud_id"""))
def q_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = marked(spark, sf_dir)
    ids = pts.select("cloud_id").distinct().withColumn(
        "point_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 4, 9, 10**12)])))
    flagged = cloud.select_indices(cloud.select_none(pts), ids).withColumnRenamed("selected", "listed")
    both = (cloud.invert_selection(flagged.withColumn("selected", F.expr(
        "point_id % 5 = 2 AND cast(cloud_id as bigint) % 3 <> 0"))))

    def total(name: str):
        return F.sum(F.when(F.col(name), 1).otherwise(0)).cast("bigint")

    return both.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.lit(0).alias("n_none"), total("selected").alias("n_inverted"),
        total("listed").alias("n_listed"))


def _lasso_sql(polygon: list[tuple[int, int]] = LASSO) -> str:
    edges = []
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay == by:
            continue
        (lx, ly), (hx, hy) = ((ax, ay), (bx, by)) if ay < by else ((bx, by), (ax, ay))
        edges.append(f"CASE WHEN py >= {ly} AND py < {hy} AND {lx} + CAST({hx - lx} AS DOUBLE) / {hy - ly} * (py - {ly})"
                     " <= px THEN 1 ELSE 0 END")
    return " + ".join(edges)


PIXELS = f"""
, clip AS (SELECT *, x * 0.04 - 1.0 AS cx, y * 0.02 - 1.0 AS cy, z * 0.1 - 0.5 AS cz, z * 0.05 + 1.0 AS w FROM {MARKED})
, pix AS (SELECT *, CASE WHEN w > 1e-12 AND cz / w BETWEEN -1 AND 1 AND ABS(cx / w) <= 1 AND ABS(cy / w) <= 1 THEN
    CAST(TRUNC((cx / w + 1) * {WIDTH} / 2) AS INT) END AS px, CASE WHEN w > 1e-12 AND cz / w BETWEEN -1 AND 1
    AND ABS(cx / w) <= 1 AND ABS(cy / w) <= 1 THEN CAST(TRUNC((1 - cy / w) * {HEIGHT} / 2) AS INT) END AS py FROM clip)"""
RECTANGLE, OVAL = (520, 90, 130, 410), (90, 60, 640, 480)
# Corners of the oval as whole pixels, cut towards zero.
OVAL_CORNERS = [
    (int(90 + 551 / 2 + 551 / 2 * math.cos(i * 2 * math.pi / 64)), int(60 + 421 / 2 + 421 / 2 * math.sin(i * 2 * math.pi / 64)))
    for i in range(64)]


@query("select_shapes", sql=with_sql("points", body=PIXELS + f"""
SELECT cloud_id, point_id, COALESCE(px >= 130 AND px < 520 AND py >= 90 AND py < 410, FALSE) AS in_rectangle,
  px IS NOT NULL AND ({_lasso_sql(OVAL_CORNERS)}) % 2 = 1 AS in_oval FROM pix"""))
def q_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = recipes.points(spark, sf_dir)
    shapes = {"in_rectangle": cloud.rect_polygon(*RECTANGLE), "in_oval": cloud.ellipse_polygon(*OVAL)}
    for name, polygon in shapes.items():
        pts = cloud.select_polygon(pts, VIEW, WIDTH, HEIGHT, polygon).withColumnRenamed("selected", name)
    return pts.select("cloud_id", "point_id", *shapes)


@query("select_polygon", sql=with_sql("points", body=PIXELS + f"""
, hits AS (SELECT *, px IS NOT NULL AND ({_lasso_sql()}) % 2 = 1 AS hit FROM pix)
SELECT cloud_id, CAST(SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_replace,
  CAST(SUM(CASE WHEN hit OR selected THEN 1 ELSE 0 END) AS BIGINT) AS n_add,
  CAST(SUM(CASE WHEN selected AND NOT hit THEN 1 ELSE 0 END) AS BIGINT) AS n_remove FROM hits GROUP BY cloud_id"""))
def q_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = marked(spark, sf_dir).withColumn("marked", F.col("selected"))
    for mode in ("replace", "add", "remove"):
        pts = cloud.select_polygon(pts.withColumn("selected", F.col("marked")), VIEW, WIDTH, HEIGHT, LASSO, mode)
        pts = pts.withColumnRenamed("selected", mode)
    return pts.groupBy("cloud_id").agg(*[
        F.sum(F.when(F.col(m), 1).otherwise(0)).cast("bigint").alias(f"n_{m}") for m in ("replace", "add", "remove")])


@query("edit_delete_selected", sql=with_sql("points", body=f"""
SELECT cloud_id || '_edit' AS cloud_id, point_id, x, ROUND(y, 9) AS y, ROUND(z, 9) AS z FROM {MARKED_CLOUDS}
WHERE NOT selected AND CAST(cloud_id AS BIGINT) % 3 <> 0
  AND has_two"""))
def q_edit_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.edit_selection(marked(spark, sf_dir), "delete"))


@query("edit_keep_selected", sql=with_sql("points", body=f"""
SELECT cloud_id || '_sel' AS cloud_id, point_id, x, ROUND(y, 9) AS y, ROUND(z, 9) AS z FROM {MARKED} WHERE selected"""))
def q_edit_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.edit_selection(marked(spark, sf_dir), "keep", "_sel"))


@query("working_set", sql=with_sql("points", body=f"""
SELECT cloud_id, point_id, x, ROUND(y, 9) AS y, ROUND(z, 9) AS z, selected FROM {MARKED_CLOUDS}
WHERE selected OR CAST(cloud_id AS BIGINT) % 3 = 0 OR NOT has_two"""))
def q_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.working_set(marked(spark, sf_dir)))


@query("merge_clouds", sql=with_sql("points", body="""
SELECT 'merged' AS cloud_id, ROW_NUMBER() OVER (ORDER BY CASE cloud_id WHEN '7' THEN 1 WHEN '3' THEN 2 ELSE 3 END,
  point_id) - 1 AS point_id, x, ROUND(y, 9) AS y, ROUND(z, 9) AS z FROM points WHERE cloud_id IN ('7', '3', '5')"""))
def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.merge_clouds(recipes.points(spark, sf_dir), ["7", "3", "5"], "merged"))


@query("voxel_downsample", sql=f"""
WITH points AS ({FLAT})
SELECT cloud_id, CAST(FLOOR((x - 25) / 4.0) AS BIGINT) AS kx, CAST(FLOOR(y / 4.0) AS BIGINT) AS ky,
  CAST(FLOOR(z / 4.0) AS BIGINT) AS kz, ROUND(AVG(x - 25), 9) AS x, ROUND(AVG(y), 9) AS y, ROUND(AVG(z), 9) AS z,
  COUNT(*) AS n FROM points GROUP BY 1, 2, 3, 4""")
def q_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = recipes.raw_points(spark, sf_dir).withColumn("x", F.col("x") - 25)
    return round_all(cloud.voxel_downsample(shifted, 4.0))


@query("voxel_in_key_order", sql=f"""
WITH points AS ({FLAT}), cells AS (
SELECT cloud_id, CAST(FLOOR(x / 8.0) AS BIGINT) AS kx, CAST(FLOOR(y / 8.0) AS BIGINT) AS ky,
  CAST(FLOOR(z / 8.0) AS BIGINT) AS kz, ROUND(AVG(x), 9) AS x, ROUND(AVG(y), 9) AS y, ROUND(AVG(z), 9) AS z,
  COUNT(*) AS n FROM points GROUP BY 1, 2, 3, 4)
SELECT *, ROW_NUMBER() OVER (PARTITION BY cloud_id ORDER BY kx, ky, kz) - 1 AS point_id FROM cells""")
def q_voxel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.voxel_downsample(recipes.raw_points(spark, sf_dir), 8.0, dense_ids=True))


@query("cloud_summary", sql=f"""
WITH points AS ({FLAT})
SELECT cloud_id, COUNT(*) AS n, ROUND(MIN(x), 9) AS min_x, ROUND(MAX(x), 9) AS max_x, ROUND(AVG(x), 9) AS mean_x,
  ROUND(MIN(y), 9) AS min_y, ROUND(MAX(y), 9) AS max_y, ROUND(AVG(y), 9) AS mean_y,
  ROUND(MIN(z), 9) AS min_z, ROUND(MAX(z), 9) AS max_z, ROUND(AVG(z), 9) AS mean_z,
  ROUND(MAX(x) - MIN(x), 9) AS size_x, ROUND(MAX(y) - MIN(y), 9) AS size_y, ROUND(MAX(z) - MIN(z), 9) AS size_z
FROM points GROUP BY cloud_id""")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.cloud_summary(recipes.raw_points(spark, sf_dir)))


@query("upper_median", sql=f"""
WITH points AS ({FLAT}), r AS (SELECT cloud_id, y, ROW_NUMBER() OVER (PARTITION BY cloud_id ORDER BY y) - 1 AS i,
  COUNT(*) OVER (PARTITION BY cloud_id) AS n FROM points)
SELECT cloud_id, ROUND(MAX(y), 9) AS median_y FROM r WHERE i = n // 2 GROUP BY cloud_id""")
def q_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = recipes.raw_points(spark, sf_dir)
    return round_all(selection.upper_medians(pts, ["cloud_id"], "y", "median_y"))


@query("error_histogram", sql=f"""
WITH points AS ({FLAT}), e AS (SELECT cloud_id, z - 5 AS e, MIN(z - 5) OVER (PARTITION BY cloud_id) AS lo,
  MAX(z - 5) OVER (PARTITION BY cloud_id) AS hi FROM points)
SELECT cloud_id, GREATEST(0, LEAST(39, CAST(TRUNC((e - lo) / GREATEST(1e-12, hi - lo) * 40) AS INT))) AS bin,
  COUNT(*) AS n FROM e GROUP BY 1, 2""")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = recipes.raw_points(spark, sf_dir).withColumn("signed_error", F.col("z") - 5)
    return cloud.error_histogram(errors)


@query("error_color", sql=with_sql("points", body=f"""
, v AS (SELECT *, GREATEST(-1.0, LEAST(1.0, (z - 5) / 4.0)) AS v FROM {MARKED})
SELECT cloud_id, point_id,
  CASE WHEN selected THEN 255 WHEN v < 0 THEN 0 WHEN v < 0.5 THEN CAST(TRUNC(v * 510) AS INT) ELSE 255 END AS r,
  CASE WHEN selected THEN 110 WHEN v < 0 THEN CAST(TRUNC(255 * (1 + v)) AS INT) WHEN v < 0.5 THEN 255
    ELSE CAST(TRUNC(510 * (1 - v)) AS INT) END AS g,
  CASE WHEN selected THEN 0 WHEN v < 0 THEN CAST(TRUNC(-255 * v) AS INT) ELSE 0 END AS b FROM v"""))
def q_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = marked(spark, sf_dir).withColumn("signed_error", F.col("z") - 5)
    return cloud.error_color(errors, 4.0).select("cloud_id", "point_id", "color.r", "color.g", "color.b")


@query("preview", sql=with_sql("points", body="""
SELECT cloud_id, point_id, x, ROUND(y, 9) AS y, ROUND(z, 9) AS z FROM points
WHERE point_id % (SELECT GREATEST(1, CAST(CEIL(COUNT(*) / 7000.0) AS BIGINT)) FROM points) = 0"""))
def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.preview(recipes.points(spark, sf_dir), 7000))


@query("preview_bounds", sql=f"""
WITH points AS ({FLAT}) SELECT MIN(x) AS min_x, MAX(x) AS max_x, ROUND(MIN(y), 9) AS min_y, ROUND(MAX(y), 9) AS max_y,
  ROUND(MIN(z), 9) AS min_z, ROUND(MAX(z), 9) AS max_z FROM points""")
def q_preview_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(cloud.preview_bounds(recipes.raw_points(spark, sf_dir)))
