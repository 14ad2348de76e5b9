"""Laser-line extraction on the 8x8 pixel tiles and the line observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.operators import lines
from cloudgauge.plans import recipes
from cloudgauge.plans.cloud_queries import round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query

SIDE = 8
OPENED = """
, mask AS (SELECT frame_id, y, x FROM pixels WHERE gray > 60)
, eroded AS (SELECT m.frame_id, m.y, m.x FROM mask m JOIN mask n ON n.frame_id = m.frame_id
    AND ABS(n.y - m.y) <= 1 AND ABS(n.x - m.x) <= 1 GROUP BY 1, 2, 3
    HAVING COUNT(*) = (3 - CASE WHEN m.y IN (0, 7) THEN 1 ELSE 0 END) * (3 - CASE WHEN m.x IN (0, 7) THEN 1 ELSE 0 END))
, opened AS (SELECT DISTINCT frame_id, y + dy AS y, x + dx AS x FROM eroded, RANGE(-1, 2) a(dy), RANGE(-1, 2) b(dx)
    WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"""


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.morph_open(lines.intensity_mask(recipes.pixels(spark, sf_dir), 60), SIDE, SIDE)


@query("laser_gray", sql=with_sql("pixels", body="""
, rgb AS (SELECT frame_id, y, x, gray AS b, (gray * 3 + x) % 256 AS g, (gray * 7 + y) % 256 AS r FROM pixels)
SELECT frame_id, CAST(SUM(CAST(ROUND(r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS gray_sum,
  CAST(SUM(r) AS BIGINT) AS red_sum, CAST(SUM(b) AS BIGINT) AS blue_sum FROM rgb GROUP BY 1"""))
def q_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = recipes.pixels(spark, sf_dir).selectExpr(
        "frame_id", "y", "x", "gray AS b", "(gray * 3 + x) % 256 AS g", "(gray * 7 + y) % 256 AS r")
    return rgb.groupBy("frame_id").agg(
        F.sum(lines.laser_gray("gray")).alias("gray_sum"), F.sum(lines.laser_gray("red")).alias("red_sum"),
        F.sum(lines.laser_gray("blue")).alias("blue_sum"))


@query("clamp_roi", sql=with_sql("pixels", body="""
SELECT frame_id, y - 2 AS y, x AS x, gray FROM pixels WHERE x BETWEEN 0 AND 4 AND y BETWEEN 2 AND 7"""))
def q_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clamp_roi(recipes.pixels(spark, sf_dir), (-3, 2, 8, 20), (SIDE, SIDE))


@query("intensity_mask", sql=with_sql("pixels", body="""
SELECT frame_id, COUNT(*) AS n FROM pixels WHERE gray > 100 GROUP BY 1"""))
def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.intensity_mask(recipes.pixels(spark, sf_dir), 100).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("morph_open", sql=with_sql("pixels", body=OPENED + " SELECT frame_id, y, x FROM opened"))
def q_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).select("frame_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


@query("gray_centroid", sql=with_sql("pixels", body="""
, t AS (SELECT frame_id, y, SUM(CAST(gray AS DOUBLE)) AS total, SUM(CAST(gray AS DOUBLE) * x) AS wx FROM pixels
   WHERE gray > 100 AND gray > 20 GROUP BY 1, 2)
SELECT frame_id, CAST(y AS BIGINT) AS y, ROUND(wx / total + 10, 9) AS u, y + 5.0 AS v FROM t WHERE total >= 200"""))
def q_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = recipes.pixels(spark, sf_dir)
    ranges = lines.whole_ranges(pixels, SIDE, SIDE)
    line = lines.gray_centroid(pixels, lines.intensity_mask(pixels, 100), ranges, 20, 10, 5)
    return round_all(line.select("frame_id", F.col("y").cast("bigint").alias("y"), "u", "v"))


@query("trim_line_ends", sql=with_sql("line_obs", body="""
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_id, side ORDER BY obs_id) AS i,
   COUNT(*) OVER (PARTITION BY frame_id, side) AS n FROM line_obs)
SELECT frame_id, side, obs_id, ROUND(u, 9) AS u, ROUND(v, 9) AS v FROM r WHERE n <= 4 OR (i > 2 AND i <= n - 2)"""))
def q_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(lines.trim_line_ends(recipes.line_obs(spark, sf_dir), 2))


@query("middle_per_row", sql=with_sql("pixels", body="""
, c AS (SELECT frame_id, CAST(0 AS BIGINT) AS range_id, y, x, ROW_NUMBER() OVER (PARTITION BY frame_id, y ORDER BY x) - 1 AS i,
   COUNT(*) OVER (PARTITION BY frame_id, y) AS n FROM pixels WHERE gray > 100)
SELECT frame_id, y, x FROM c WHERE i = n // 2"""))
def q_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = recipes.pixels(spark, sf_dir).filter("gray > 100").withColumn("range_id", F.lit(0).cast("bigint"))
    return lines.middle_per_row(bright.select("frame_id", "range_id", "y", "x")).select("frame_id", "y", "x")


LABELS = """
, label AS (WITH RECURSIVE reach AS (SELECT frame_id, y, x, y * 4294967296 + x AS label FROM opened
   UNION SELECT r.frame_id, o.y, o.x, r.label FROM reach r JOIN opened o ON o.frame_id = r.frame_id
   AND ABS(o.y - r.y) <= 1 AND ABS(o.x - r.x) <= 1)
   SELECT frame_id, y, x, MIN(label) AS label FROM reach GROUP BY 1, 2, 3)"""
# Per region: its box, what of the box is empty and cannot be left through empty neighbours, then outline and area.
AREAS = """
, box AS (SELECT frame_id, label, MIN(y) AS ly, MAX(y) AS hy, MIN(x) AS lx, MAX(x) AS hx FROM label GROUP BY 1, 2)
, blank AS (SELECT b.frame_id, b.label, r.y, c.x, r.y IN (ly, hy) OR c.x IN (lx, hx) AS edge FROM box b
    JOIN RANGE(8) r(y) ON r.y BETWEEN ly AND hy JOIN RANGE(8) c(x) ON c.x BETWEEN lx AND hx
    ANTI JOIN label l ON l.frame_id = b.frame_id AND l.label = b.label AND l.y = r.y AND l.x = c.x)
, outside AS (WITH RECURSIVE o AS (SELECT frame_id, label, y, x FROM blank WHERE edge
    UNION SELECT n.frame_id, n.label, n.y, n.x FROM o JOIN blank n ON n.frame_id = o.frame_id AND n.label = o.label
    AND ABS(n.y - o.y) + ABS(n.x - o.x) = 1) SELECT * FROM o)
, filled AS (SELECT frame_id, label, y, x FROM label UNION ALL SELECT frame_id, label, y, x FROM blank b
    ANTI JOIN outside o USING (frame_id, label, y, x))
, enclosed AS (SELECT f.frame_id, f.label, f.y, f.x FROM filled f JOIN filled n ON n.frame_id = f.frame_id
    AND n.label = f.label AND ABS(n.y - f.y) + ABS(n.x - f.x) = 1 GROUP BY 1, 2, 3, 4 HAVING COUNT(*) = 4)
, counts AS (SELECT b.*, (SELECT COUNT(*) FROM filled f WHERE f.frame_id = b.frame_id AND f.label = b.label) AS n,
    (SELECT COUNT(*) FROM enclosed e WHERE e.frame_id = b.frame_id AND e.label = b.label) AS i FROM box b)
, sized AS (SELECT *, GREATEST(CAST(0 AS DOUBLE), n - CAST(n - i AS DOUBLE) / 2 - 1) AS area FROM counts)"""


def ranges_sql(min_area: int, border: int) -> str:
    """CTE ``ranges``: boxes of the large regions, grown and cut to the tile."""
    x0, y0 = f"GREATEST(0, lx - {border})", f"GREATEST(0, ly - {border})"
    return OPENED + LABELS + AREAS + f"""
, ranges AS (SELECT frame_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(w AS INT) AS w, CAST(h AS INT) AS h, area,
    ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY y0, x0, label) - 1 AS range_id
  FROM (SELECT *, {x0} AS x0, {y0} AS y0, LEAST(8 - {x0}, hx - lx + 1 + 2 * {border}) AS w,
    LEAST(8 - {y0}, hy - ly + 1 + 2 * {border}) AS h FROM sized WHERE area >= {min_area}) q)"""


@query("stripe_ranges", sql=with_sql("pixels", body=ranges_sql(4, 1) + """
SELECT frame_id, x0, y0, w, h, area, range_id FROM ranges"""))
def q_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.stripe_ranges(opened(spark, sf_dir), SIDE, SIDE, 4.0, 1)


@query("extract_centroid", sql=with_sql("pixels", body=ranges_sql(30, 2) + """
, used AS (SELECT frame_id, x0, y0, w, h, range_id FROM ranges
    UNION ALL SELECT DISTINCT frame_id, 0, 0, 8, 8, 0 FROM pixels p ANTI JOIN ranges r USING (frame_id))
, sums AS (SELECT p.frame_id, range_id, p.y, SUM(CAST(gray AS DOUBLE)) AS total, SUM(CAST(gray AS DOUBLE) * p.x) AS wx
  FROM pixels p JOIN opened o ON o.frame_id = p.frame_id AND o.y = p.y AND o.x = p.x
  JOIN used r ON r.frame_id = p.frame_id AND p.x >= x0 AND p.x < x0 + w AND p.y >= y0 AND p.y < y0 + h
  WHERE gray > 20 GROUP BY 1, 2, 3)
SELECT frame_id, range_id, y, ROUND(wx / total, 9) AS u, CAST(y AS DOUBLE) AS v,
  ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY range_id, y) - 1 AS obs_id FROM sums WHERE total >= 200"""))
def q_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(lines.extract_centroid(recipes.pixels(spark, sf_dir), SIDE, SIDE, 60, 20))


@query("extract_ridge", sql=with_sql("pixels", body=ranges_sql(4, 1) + """
, k AS (SELECT o, EXP(-o * o / 2.0 / (4.0 / 3)) AS g0, o * EXP(-o * o / 2.0 / (4.0 / 3)) AS g1,
    (o * o / (4.0 / 3) - 1) * EXP(-o * o / 2.0 / (4.0 / 3)) AS g2 FROM RANGE(-3, 4) t(o))
, lit AS (SELECT p.*, range_id FROM pixels p JOIN ranges r ON r.frame_id = p.frame_id AND p.x >= x0 AND p.x < x0 + w
    AND p.y >= y0 AND p.y < y0 + h WHERE gray > 0)
, d AS (SELECT c.frame_id, c.range_id, c.y, c.x, SUM(n.gray * kx.g1 * ky.g0) / (2 * PI() * POW(4.0 / 3, 2)) AS dx,
    SUM(n.gray * kx.g0 * ky.g1) / (2 * PI() * POW(4.0 / 3, 2)) AS dy,
    SUM(n.gray * kx.g2 * ky.g0) / (2 * PI() * POW(4.0 / 3, 2)) AS a, SUM(n.gray * kx.g1 * ky.g1) / (2 * PI() * POW(4.0 / 3, 3)) AS b,
    SUM(n.gray * kx.g0 * ky.g2) / (2 * PI() * POW(4.0 / 3, 2)) AS c
  FROM lit c SEMI JOIN opened o ON o.frame_id = c.frame_id AND o.y = c.y AND o.x = c.x
  JOIN lit n ON n.frame_id = c.frame_id AND n.range_id = c.range_id JOIN k kx ON kx.o = n.x - c.x JOIN k ky ON ky.o = n.y - c.y
  WHERE c.gray > 40 GROUP BY 1, 2, 3, 4)
, roots AS (SELECT *, SQRT((a - c) * (a - c) + 4 * b * b) AS root FROM d)
, v AS (SELECT *, CASE WHEN ABS(a + c + root) < ABS(a + c - root) THEN -(c - a + root) ELSE 2 * b END AS vx,
    CASE WHEN ABS(a + c + root) < ABS(a + c - root) THEN 2 * b ELSE c - a + root END AS vy FROM roots)
, n AS (SELECT *, vx / SQRT(vx * vx + vy * vy) AS nx, vy / SQRT(vx * vx + vy * vy) AS ny FROM v WHERE SQRT(vx * vx + vy * vy) >= 1e-9)
, s AS (SELECT *, a * nx * nx + 2 * b * nx * ny + c * ny * ny AS den FROM n)
, t AS (SELECT *, -(dx * nx + dy * ny) / den * nx AS px, -(dx * nx + dy * ny) / den * ny AS py FROM s WHERE ABS(den) >= 1e-9)
, hit AS (SELECT * FROM t WHERE ABS(px) <= 0.5 AND ABS(py) <= 0.5
    QUALIFY ROW_NUMBER() OVER (PARTITION BY frame_id, y, x ORDER BY range_id) = 1)
, mid AS (SELECT * FROM hit QUALIFY ROW_NUMBER() OVER (PARTITION BY frame_id, range_id, y ORDER BY x) - 1
    = COUNT(*) OVER (PARTITION BY frame_id, range_id, y) // 2)
SELECT frame_id, range_id, y, x, ROUND(x + px, 9) AS u, ROUND(y + py, 9) AS v,
  ROW_NUMBER() OVER (PARTITION BY frame_id ORDER BY range_id, y, x) - 1 AS obs_id FROM mid"""))
def q_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(lines.extract_ridge(
        recipes.pixels(spark, sf_dir), SIDE, SIDE, 60, 2.0, 40, min_area=4.0, border=1))


@query("connected_components", sql=with_sql("pixels", body=OPENED + LABELS + """
SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, label FROM label"""))
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.pixel_components(opened(spark, sf_dir))
