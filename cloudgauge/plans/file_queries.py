"""Round trips of the driver tables through the file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.operators import models
from cloudgauge.plans import recipes
from cloudgauge.plans.cloud_queries import round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query
from cloudgauge.plans.stereo_queries import LENS, calibrations, observations
from cloudgauge.operators import stereo
from cloudgauge.session import run_folder
from cloudgauge.sources import sinks, station
from cloudgauge.sources.binary_clouds import read_binary_cloud
from cloudgauge.sources.text_clouds import read_ascii_cloud, read_xyz_text

POINTS = "SELECT cloud_id, point_id, ROUND(x, 9) AS x, ROUND(y, 9) AS y, ROUND(z, 9) AS z FROM points"


def folder(spark: SparkSession) -> str:
    """A new folder on the shared mount of the checkpoint folder."""
    base = run_folder(spark).removeprefix("file://").removeprefix("file:")
    return f"{base}/files-{uuid.uuid4().hex}"


@query("xyz_text_round_trip", sql=with_sql("points", body=POINTS.replace(" point_id,", "")))
def q_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.write_xyz_text(recipes.points(spark, sf_dir), path)
    return round_all(read_xyz_text(spark, path).drop("point_id"))


@query("ply_round_trip", sql=with_sql("points", body=POINTS))
def q_ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.export_clouds(recipes.points(spark, sf_dir), path, "ply")
    return round_all(read_ascii_cloud(spark, path))


@query("pcd_round_trip", sql=with_sql("points", body="""
SELECT cloud_id, point_id, ROUND(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x, ROUND(CAST(CAST(y AS FLOAT) AS DOUBLE), 5) AS y,
  ROUND(CAST(CAST(z AS FLOAT) AS DOUBLE), 5) AS z FROM points"""))
def q_pcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.export_clouds(recipes.points(spark, sf_dir), path, "pcd")
    return round_all(read_binary_cloud(spark, path), 5)


@query("ascii_pcd_round_trip", sql=with_sql("points", body=POINTS))
def q_ascii_pcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.export_clouds(recipes.points(spark, sf_dir), path, "pcd_ascii")
    return round_all(read_ascii_cloud(spark, path))


@query("binary_ply_round_trip", sql=with_sql("points", body=POINTS))
def q_binary_ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.export_clouds(recipes.points(spark, sf_dir), path, "ply_binary")
    return round_all(read_binary_cloud(spark, path))


@query("publish_results", sql=with_sql("points", body="""
, n AS (SELECT '/scans/part ' || cloud_id AS session_path, COUNT(*) AS n FROM points GROUP BY 1)
SELECT session_path, n, 'point_cloud_20260102_030405_678' || CASE WHEN i = 1 THEN '' ELSE '_' || (i - 1) END AS name
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY session_path) AS i FROM n) q"""))
def q_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cloud as the result of a session; all sessions have one time, so their names have to be told apart."""
    path = folder(spark)
    points = recipes.points(spark, sf_dir).withColumn("session_path", F.concat(F.lit("/scans/part "), "cloud_id"))
    sessions = points.select("session_path").distinct().withColumn(
        "created_ts", F.expr("timestamp'2026-01-02 03:04:05.678'"))
    return sinks.publish_results(points, sessions, f"{path}/results", f"{path}/catalog")


PACK = "p_partkey // 50 AS station, p_partkey, p_brand || CHR(10) || 'WAIT ' || p_size AS content"


@query("command_packs", sql=f"""
SELECT station, ROW_NUMBER() OVER (PARTITION BY station ORDER BY p_partkey) - 1 AS position,
  'pack ' || p_partkey AS name, content FROM (SELECT {PACK} FROM part) p""")
def q_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file per station of fifty parts, written and read again."""
    path = folder(spark)
    part = recipes.table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 50 AS station", "p_partkey", "concat('pack ', p_partkey) AS name",
        "concat(p_brand, chr(10), 'WAIT ', p_size) AS content")
    packs = part.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "name", "content"))).alias("packs"))
    packs.select("station", F.to_json(F.struct(F.lit("made from parts").alias("_note"), "packs")).alias("value")).write.partitionBy(
        "station").text(path)
    back = station.read_command_packs(spark, path)
    return back.select(F.regexp_extract("file", r"station=(\d+)", 1).cast("bigint").alias("station"),
                       F.col("position").cast("bigint").alias("position"), "name", "content")


INI = """
WITH p AS (SELECT p_partkey // 50 AS station, p_partkey, p_size, ROW_NUMBER() OVER (PARTITION BY p_partkey // 50
    ORDER BY p_partkey) AS nth FROM part)"""


@query("station_config", sql=INI + """
, bad AS (SELECT station, MAX(nth) AS nth FROM p GROUP BY 1)
SELECT station, 'part/size' || p_partkey AS key, CAST(p_size AS VARCHAR) AS value, 2 + 2 * nth AS line_no, NULL AS reason
FROM p WHERE station % 3 = 0
UNION ALL SELECT station, NULL, NULL, 2 + 2 * nth + 2, CASE station % 3 WHEN 1 THEN 'repeated key' ELSE 'not key=value' END
FROM bad WHERE station % 3 <> 0""")
def q_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One INI file per station; of three stations one repeats a key at its end and one ends without a value."""
    path = folder(spark)
    part = recipes.table(spark, sf_dir, "part").selectExpr("p_partkey div 50 AS station", "p_partkey AS k", "p_size")
    lines = part.select("station", "k", F.explode(F.expr(
        "array('; a part', concat('  size', k, ' = ', p_size, ' '))")).alias("value"))
    ends = part.groupBy("station").agg(F.max("k").alias("m"))
    tails = ends.selectExpr("station", "m + 1 AS k", "explode(CASE station % 3 WHEN 0 THEN array('; end') WHEN 1 THEN "
                            "array('; again', concat('size', m, '=0')) ELSE array('; bare', 'size') END) AS value")
    heads = ends.selectExpr("station", "-1L AS k", "explode(array('; settings', '[part]')) AS value")
    rows = lines.unionByName(tails).unionByName(heads)
    # The comment of a key stands before its line.
    rows = rows.withColumn("_last", ~F.col("value").startswith(";")).repartition("station").sortWithinPartitions("station", "k", "_last")
    rows.select("station", "value").write.partitionBy("station").option("extension", "ini").csv(
        path, sep="\u0001", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        emptyValue="")
    kv, errors = station.read_station_config(spark, path)
    number = F.regexp_extract("file", r"station=(\d+)", 1).cast("bigint").alias("station")
    none = F.lit(None).cast("string")
    return kv.select(number, "key", "value", F.col("line_no").cast("bigint").alias("line_no"), none.alias("reason")).unionByName(
        errors.select(number, none.alias("key"), none.alias("value"), "line_no", "reason"))


@query("error_csv", sql=with_sql("points", body="""
SELECT cloud_id, point_id + 1 AS index, ROUND(x, 9) AS x_mm, ROUND(y, 9) AS y_mm, ROUND(z, 9) AS z_mm, ROUND(z - 5, 9) AS signed_error_mm FROM points"""))
def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sinks.write_error_csv(models.signed_error(recipes.points(spark, sf_dir), recipes.models(spark, sf_dir)), path)
    schema = ("index bigint, x_mm double, y_mm double, z_mm double, signed_error_mm double, cloud_id string")
    back = spark.read.schema(schema).csv(path, header=True)
    return round_all(back.select("cloud_id", "index", "x_mm", "y_mm", "z_mm", "signed_error_mm"))


@query("log_files", sql=with_sql("logs", body="""
SELECT epoch_us(ts) // 1000 AS ts_ms, level, module, text FROM logs WHERE level <> 'Debug'"""))
def q_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    station.write_logs(recipes.logs(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), path)
    return station.read_logs(spark, path).select(F.unix_millis("ts").alias("ts_ms"), "level", "module", "text")


@query("frame_audit_files", sql=with_sql("frame_events", body="""
SELECT event_id AS index, frame_number AS left_frame_number, frame_number + 1 AS right_frame_number,
  trigger_index AS left_trigger_count, trigger_index + 2 AS right_trigger_count, arrival_us AS left_host_timestamp,
  arrival_us + n_bytes AS right_host_timestamp FROM frame_events"""))
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    events = recipes.frame_events(spark, sf_dir)
    station.write_frame_audit(events.select(
        F.col("event_id").alias("index"), F.col("frame_number").alias("left_frame_number"),
        (F.col("frame_number") + 1).alias("right_frame_number"), F.col("trigger_index").alias("left_trigger_count"),
        (F.col("trigger_index") + 2).alias("right_trigger_count"), F.col("arrival_us").alias("left_host_timestamp"),
        (F.col("arrival_us") + F.col("n_bytes")).alias("right_host_timestamp")), path)
    return station.read_frame_audit(spark, path).drop("file")


@query("reconstruct_with_lens")
def q_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    points, _ = stereo.reconstruct(
        obs.select("frame_id").distinct(), obs, calibrations(spark, LENS), 2448, 2048, 0.01)
    return round_all(points.select("frame_id", "left_obs", "right_obs", "x", "y", "z"), 3)
