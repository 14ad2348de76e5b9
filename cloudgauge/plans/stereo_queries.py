"""Stereo pairing, matching, triangulation and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions.vec import ratio
from cloudgauge.operators import ordered, stereo
from cloudgauge.plans import recipes
from cloudgauge.plans.cloud_queries import round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query
from cloudgauge.session import cut_lineage

K = [2000.0, 0.0, 1224.0, 0.0, 2000.0, 1024.0, 0.0, 0.0, 1.0]
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
LENS = [-0.1, 0.05, 0.001, -0.0005, 0.01]


def array(values: list[float]):
    return F.array(*[F.lit(float(v)) for v in values])


def calibrations(spark: SparkSession, d: list[float] | None = None) -> DataFrame:
    d = d or [0.0] * 5
    return spark.range(1).select(
        F.lit("rig").alias("rig_id"), array(K).alias("k1"), array(K).alias("k2"), array(K).alias("p1"),
        array(K).alias("p2"), array(d).alias("d1"), array(d).alias("d2"), array(EYE).alias("r"),
        array([-60.0, 0.0, 0.0]).alias("t"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.line_obs(spark, sf_dir).withColumn("rig_id", F.lit("rig"))


RAYS = """
, rays AS (SELECT *, (u - 1224) / 2000 AS px, (v - 1024) / 2000 AS py FROM line_obs)
, units AS (SELECT frame_id, side, obs_id, u, v, px * (1.0 / SQRT(px * px + py * py + 1.0 * 1.0)) AS rx,
    py * (1.0 / SQRT(px * px + py * py + 1.0 * 1.0)) AS ry, 1.0 * (1.0 / SQRT(px * px + py * py + 1.0 * 1.0)) AS rz FROM rays)"""
MATCH = RAYS + """
, n AS (SELECT frame_id, SUM(CASE WHEN side = 'left' THEN 1 ELSE 0 END) AS nl,
    SUM(CASE WHEN side = 'right' THEN 1 ELSE 0 END) AS nr FROM line_obs GROUP BY 1)
, pairs AS (SELECT l.frame_id, l.obs_id AS lo, r.obs_id AS ro, l.u AS lu, l.v AS lv, r.u AS ru, r.v AS rv,
    ABS(l.ry * r.rz - l.rz * r.ry) AS err, nl <= nr AS left_drives
  FROM units l JOIN units r ON l.frame_id = r.frame_id AND l.side = 'left' AND r.side = 'right'
  JOIN n ON n.frame_id = l.frame_id)
, best AS (SELECT * FROM pairs QUALIFY ROW_NUMBER() OVER (PARTITION BY frame_id, CASE WHEN left_drives THEN lo ELSE ro END
    ORDER BY err, CASE WHEN left_drives THEN ro ELSE lo END) = 1)"""
MATCH_COLUMNS = """SELECT frame_id, lo AS left_obs, ro AS right_obs, ROUND(lu, 6) AS left_u, ROUND(lv, 6) AS left_v,
  ROUND(ru, 6) AS right_u, ROUND(rv, 6) AS right_v, ROUND(err, 6) AS error FROM best WHERE err < {}"""


def matched(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    return stereo.epipolar_match(observations(spark, sf_dir), calibrations(spark), threshold)


@query("pixel_ray", sql=with_sql("line_obs", body=RAYS + """
SELECT frame_id, side, obs_id, ROUND(rx, 9) AS rx, ROUND(ry, 9) AS ry, ROUND(rz, 9) AS rz FROM units"""))
def q_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = stereo.observation_rays(observations(spark, sf_dir), calibrations(spark))
    return round_all(rays.select("frame_id", "side", "obs_id", "rx", "ry", "rz"))


@query("epipolar_match", sql=with_sql("line_obs", body=MATCH + MATCH_COLUMNS.format(0.5)))
def q_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(matched(spark, sf_dir), 6)


@query("epipolar_match_small_threshold", sql=with_sql("line_obs", body=MATCH + MATCH_COLUMNS.format(0.001)))
def q_match_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(matched(spark, sf_dir, 0.001), 6)


# Closed form for R = I, t = (-60, 0, 0): solve the 2x2 normal equations of the two rays.
TRIANGULATED = MATCH + """
, d AS (SELECT b.*, l.rx AS ax, l.ry AS ay, l.rz AS az, r.rx AS bx, r.ry AS by_, r.rz AS bz FROM best b
   JOIN units l ON l.frame_id = b.frame_id AND l.side = 'left' AND l.obs_id = lo
   JOIN units r ON r.frame_id = b.frame_id AND r.side = 'right' AND r.obs_id = ro WHERE err < 0.01)
, e AS (SELECT *, ax * ax + ay * ay + az * az AS aa, ax * bx + ay * by_ + az * bz AS ab, bx * bx + by_ * by_ + bz * bz AS bb,
   ax * -60 AS at_, bx * -60 AS bt FROM d)
, c AS (SELECT *, (ab * bt - bb * at_) / (aa * bb - ab * ab) AS ca, (aa * bt - ab * at_) / (aa * bb - ab * ab) AS cb FROM e)
, points AS (SELECT frame_id, lo AS left_obs, ro AS right_obs, 0.5 * (-60 + ax * ca + bx * cb) + 60 AS x,
   0.5 * (ay * ca + by_ * cb) AS y, 0.5 * (az * ca + bz * cb) AS z, err FROM c)"""


@query("triangulate", sql=with_sql("line_obs", body=TRIANGULATED + """
SELECT frame_id, left_obs, right_obs, ROUND(x / z, 6) AS x_slope, ROUND(y / z, 6) AS y_slope, ROUND(1 / z, 9) AS nearness
FROM points"""))
def q_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matched(spark, sf_dir, 0.01).withColumn("rig_id", F.lit("rig"))
    points = stereo.triangulate(pairs, calibrations(spark))
    # Nearly parallel rays meet far away, where only ratios have a fixed number of digits.
    return slopes(points)


def slopes(points: DataFrame) -> DataFrame:
    x, y, z = (F.col(a) for a in "xyz")
    return points.select("frame_id", "left_obs", "right_obs", F.round(ratio(x, z), 6).alias("x_slope"),
                         F.round(ratio(y, z), 6).alias("y_slope"), F.round(ratio(F.lit(1.0), z), 9).alias("nearness"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = recipes.raw_line_obs(spark, sf_dir)
    frames = obs.select("frame_id").distinct()
    pairs = matched(spark, sf_dir, 0.01)
    points = stereo.triangulate(pairs.withColumn("rig_id", F.lit("rig")), calibrations(spark))
    return stereo.frame_diagnostics(frames, obs, points, points, 2448, 2048)


DIAG = TRIANGULATED + """
, frames AS (SELECT DISTINCT frame_id FROM line_obs)
, o AS (SELECT frame_id, side, COUNT(*) AS c, LEAST(1.0, GREATEST(0.0, GREATEST((MAX(u) - MIN(u) + 1) / 2448.0,
    (MAX(v) - MIN(v) + 1) / 2048.0))) AS cov FROM line_obs GROUP BY 1, 2)
, m AS (SELECT frame_id, COUNT(*) AS matched, AVG(err) AS me, MAX(err) AS xe FROM points GROUP BY 1)
, diag AS (SELECT f.frame_id, COALESCE(l.c, 0) AS left_count, COALESCE(r.c, 0) AS right_count,
    COALESCE(matched, 0) AS matched, me, xe, COALESCE(l.cov, 0) AS lc, COALESCE(r.cov, 0) AS rc,
    CASE WHEN l.c IS NULL AND r.c IS NULL THEN 'both_empty' WHEN l.c IS NULL THEN 'left_empty' WHEN r.c IS NULL
      THEN 'right_empty' WHEN matched IS NULL THEN 'match_empty' ELSE 'ok' END AS reason
  FROM frames f LEFT JOIN o l ON l.frame_id = f.frame_id AND l.side = 'left'
  LEFT JOIN o r ON r.frame_id = f.frame_id AND r.side = 'right' LEFT JOIN m ON m.frame_id = f.frame_id)
, runs AS (SELECT frame_id % 7 AS run_id, ROW_NUMBER() OVER (PARTITION BY frame_id % 7 ORDER BY frame_id) AS frame_index,
    * FROM diag)"""


@query("frame_diagnostics", sql=with_sql("line_obs", body=DIAG + """
SELECT frame_id, left_count, right_count, matched, ROUND(me, 6) AS mean_error, ROUND(xe, 6) AS max_error,
  ROUND(lc, 6) AS left_coverage, ROUND(rc, 6) AS right_coverage, reason,
  CASE WHEN LEAST(left_count, right_count) > 0 THEN ROUND(CAST(matched AS DOUBLE) / LEAST(left_count, right_count), 6)
    ELSE 0 END AS match_rate FROM diag"""))
def q_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(diagnostics(spark, sf_dir).select(
        "frame_id", "left_count", "right_count", "matched", "mean_error", "max_error", "left_coverage",
        "right_coverage", "reason", "match_rate"), 6)


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = cut_lineage(diagnostics(spark, sf_dir).withColumn("run_id", F.col("frame_id") % 7))
    return ordered.row_number(runs, ["run_id"], ["frame_id"], "frame_index", ordered.point_slice("frame_id"))


@query("sample_diagnostics", sql=with_sql("line_obs", body=DIAG + """
, t AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id) AS n FROM runs)
SELECT run_id, frame_index, frame_id, reason, reason <> 'ok' OR n <= 200 OR frame_index <= 10
  OR frame_index = n OR frame_index % 50 = 0 AS sampled FROM t"""))
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stereo.sample_diagnostics(run_table(spark, sf_dir)).select("run_id", "frame_index", "frame_id", "reason", "sampled")


@query("progress", sql=with_sql("line_obs", body=DIAG + """
, t AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id) AS n,
   CAST(SUM(matched) OVER (PARTITION BY run_id ORDER BY frame_index) AS BIGINT) AS points_so_far FROM runs)
SELECT run_id, frame_index, n AS frames, points_so_far FROM t WHERE frame_index = 1 OR frame_index = n
  OR frame_index % GREATEST(1, CAST(CEIL(n / 10.0) AS BIGINT)) = 0"""))
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stereo.progress(run_table(spark, sf_dir))


@query("run_summary", sql=with_sql("line_obs", body=DIAG + """
SELECT run_id, CAST(SUM(matched) AS BIGINT) AS merged_points, COUNT(*) AS frames,
  CAST(SUM(CASE WHEN reason <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS failed_frames, SUM(matched) > 0 AS success,
  CASE WHEN SUM(matched) > 0 THEN 'Reconstruction finished, points=' || CAST(CAST(SUM(matched) AS BIGINT) AS VARCHAR)
    ELSE 'Reconstruction finished without valid points' END AS message FROM runs GROUP BY 1"""))
def q_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stereo.run_summary(run_table(spark, sf_dir))


def _undistort_sql() -> str:
    k1, k2, p1, p2, k3 = LENS
    step = ", s0 AS (SELECT *, (u - 1224) / 2000 AS x0, (v - 1024) / 2000 AS y0, (u - 1224) / 2000 AS x, " \
           "(v - 1024) / 2000 AS y FROM line_obs)"
    for i in range(1, 6):
        step += f"""
, s{i} AS (SELECT frame_id, side, obs_id, x0, y0,
  (x0 - (2 * {p1} * x * y + ({p2}) * ((x * x + y * y) + 2 * x * x))) / (1 + ((CAST({k3} AS DOUBLE) * (x * x + y * y) + {k2}) * (x * x + y * y) + ({k1})) * (x * x + y * y)) AS x,
  (y0 - ({p1} * ((x * x + y * y) + 2 * y * y) + 2 * ({p2}) * x * y)) / (1 + ((CAST({k3} AS DOUBLE) * (x * x + y * y) + {k2}) * (x * x + y * y) + ({k1})) * (x * x + y * y)) AS y FROM s{i - 1})"""
    return step + """
SELECT frame_id, side, obs_id, ROUND(2000 * x + 1224, 6) AS u, ROUND(2000 * y + 1024, 6) AS v FROM s5"""


@query("undistort", sql=with_sql("line_obs", body=_undistort_sql()))
def q_undistort(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = stereo.undistort_observations(observations(spark, sf_dir), calibrations(spark, LENS))
    return round_all(flat.select("frame_id", "side", "obs_id", "u", "v"), 6)
