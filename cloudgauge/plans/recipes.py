"""Scan data derived from the driver tables, at whatever scale those have.

Every recipe is a plan over the whole table; positions inside a group come from
``ordered.row_number``, so a hot supplier, user or frame is cut into slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.operators import ordered
from cloudgauge.session import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cloud per supplier, one point per line item."""
    lines = table(spark, sf_dir, "lineitem").withColumn("cloud_id", F.col("l_suppkey").cast("string"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
    ranked = ordered.running_sum(lines, ["cloud_id"], order, {"_at": F.lit(1)}, F.expr("l_orderkey div 1000000"), joined=False)
    return ranked.select(
        "cloud_id", (F.col("_at") - 1).alias("point_id"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clouds without ids, for operators that do not use the order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("cloud_id"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One given plane per cloud."""
    zero = F.lit(0.0)
    return (
        table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("cloud_id")).distinct()
        .select(
            "cloud_id", F.lit("plane").alias("kind"),
            F.struct(F.lit(25.0).alias("x"), F.lit(52.0).alias("y"), F.lit(5.0).alias("z")).alias("center"),
            F.struct(zero.alias("x"), zero.alias("y"), F.lit(1.0).alias("z")).alias("direction"),
        )
    )


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera frames: one session per ten users, even users left, odd users right."""
    events = table(spark, sf_dir, "events")
    base = events.select(
        "event_id", "ts", "value",
        F.expr("user_id div 10").alias("session_id"),
        F.when(F.col("user_id") % 2 == 0, "left").otherwise("right").alias("side"),
        micros(events, "ts").alias("arrival_us"),
    )
    ranked = ordered.row_number(base, ["session_id", "side"], ["arrival_us", "event_id"], "k")
    return ranked.select(
        "session_id", "side", F.col("ts").alias("arrival_ts"), "arrival_us", "event_id",
        F.expr("(4294967290 + k + k div 29) % 4294967296").alias("frame_number"),
        F.expr("CASE WHEN session_id % 2 = 0 THEN 0 ELSE k + k div 29 + 100 END").cast("bigint").alias("trigger_index"),
        F.expr("CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END").cast("bigint").alias("lost_packets"),
        F.expr("event_id % 733 <> 0").alias("metadata_valid"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("n_bytes"),
    )


def raw_line_obs(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """The observations without ids."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey % 5000").alias("frame_id"),
        F.when(F.col("l_linestatus") == "O", "left").otherwise("right").alias("side"),
        (F.col("l_quantity") * 40).alias("u"), (F.col("l_extendedprice") / 60).alias("v"), *others)


def line_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laser-line observations of 5000 frames."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    lines = raw_line_obs(spark, sf_dir, *order)
    ranked = ordered.running_sum(
        lines, ["frame_id", "side"], ["v", "u", *order], {"_at": F.lit(1)}, F.floor(F.col("v") / 64), joined=False)
    return ranked.select("frame_id", "side", (F.col("_at") - 1).alias("obs_id"), "u", "v")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-float embeddings read as 8x8 grey tiles."""
    tiles = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("pos", "v"))
    return tiles.select(
        "frame_id", F.expr("cast(pos div 8 as int)").alias("y"), F.expr("cast(pos % 8 as int)").alias("x"),
        F.expr("cast(least(255, floor(abs(cast(v as double)) * 800)) as int)").alias("gray"))


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 2 == 0, "left").otherwise("right").alias("side"),
        F.concat(
            "url", F.lit("/frame_"), F.lpad(F.col("page_id").cast("string"), 6, "0"),
            F.expr("CASE WHEN page_id % 7 = 0 THEN '.txt' WHEN page_id % 3 = 0 THEN '.BMP' ELSE '.png' END"),
        ).alias("path"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.expr("CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' "
               "WHEN 'view' THEN 'Debug' ELSE 'Info' END").alias("level"),
        F.concat(F.lit("Module"), (F.col("user_id") % 5).cast("string")).alias("module"),
        F.col("props").alias("text"))


def config_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("station_id"),
        F.expr("CASE p_size % 4 WHEN 0 THEN 'reconstruction/grayThreshold' WHEN 1 THEN 'reconstruction/stripeWidth' "
               "WHEN 2 THEN 'acquisition/laserDuty' ELSE 'acquisition/triggerSourceLine' END").alias("key"),
        F.expr("CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE cast(p_size * 10 - 50 as string) END").alias("value"))


def serial_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    base = events.select(
        "event_id", F.col("ts"), micros(events, "ts").alias("ts_us"),
        F.concat(F.lit("COM"), (F.col("user_id") % 4).cast("string")).alias("port"),
        F.expr("1 + user_id % 15").alias("a"), F.expr("1 + event_id % 200").alias("b"))

    def two(expr: str) -> str:
        return f"lpad(hex({expr}), 2, '0')"

    answer = (f"concat('55AA0111', {two('a')}, '000000', {two('b')}, '000000', "
              f"{two('(273 + a + b + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) % 256')})")
    return base.select(
        "port", "ts", "ts_us", "event_id",
        F.expr("CASE WHEN event_id % 3 = 0 THEN 'tx' ELSE 'rx' END").alias("direction"),
        F.expr(f"CASE WHEN event_id % 3 = 0 THEN '55AA011111' ELSE {answer} END").alias("hex"))


def corner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("frame_id"), (F.col("quality") == 1).alias("left_found"),
        (F.col("toxic") == 0).alias("right_found"))


# The same recipes as SQL for the side-by-side check.
SQL = {
    "points": """
SELECT CAST(l_suppkey AS VARCHAR) AS cloud_id,
       ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS point_id,
       l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z
FROM lineitem""",
    "frame_events": """
SELECT session_id, side, arrival_ts, epoch_us(arrival_ts) AS arrival_us, event_id,
       (4294967290 + k + k // 29) % 4294967296 AS frame_number,
       CASE WHEN session_id % 2 = 0 THEN 0 ELSE k + k // 29 + 100 END AS trigger_index,
       CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END AS lost_packets,
       event_id % 733 <> 0 AS metadata_valid, CAST(FLOOR(value * 1000) AS BIGINT) AS n_bytes
FROM (SELECT e.*, CAST(FLOOR(user_id / 10) AS BIGINT) AS session_id,
             CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, ts AS arrival_ts,
             ROW_NUMBER() OVER (PARTITION BY FLOOR(user_id / 10), user_id % 2 ORDER BY ts, event_id) AS k
      FROM events e) q""",
    "line_obs": """
SELECT frame_id, side, ROW_NUMBER() OVER (PARTITION BY frame_id, side ORDER BY v, u, l_orderkey, l_linenumber,
         l_partkey, l_suppkey, l_shipdate) - 1 AS obs_id, u, v
FROM (SELECT l.*, l_orderkey % 5000 AS frame_id, CASE WHEN l_linestatus = 'O' THEN 'left' ELSE 'right' END AS side,
             l_quantity * 40 AS u, l_extendedprice / 60 AS v FROM lineitem l) q""",
    "pixels": """
SELECT vec_id AS frame_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x,
       CAST(LEAST(255, FLOOR(ABS(CAST(embedding[pos + 1] AS DOUBLE)) * 800)) AS INT) AS gray
FROM embeddings, RANGE(64) t(pos)""",
    "image_manifest": """
SELECT CASE WHEN page_id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
       CONCAT(url, '/frame_', LPAD(CAST(page_id AS VARCHAR), 6, '0'),
         CASE WHEN page_id % 7 = 0 THEN '.txt' WHEN page_id % 3 = 0 THEN '.BMP' ELSE '.png' END) AS path
FROM pages""",
    "logs": """
SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' WHEN 'view' THEN 'Debug'
         ELSE 'Info' END AS level, CONCAT('Module', CAST(user_id % 5 AS VARCHAR)) AS module, props AS text
FROM events""",
    "config_kv": """
SELECT p_partkey AS station_id,
       CASE p_size % 4 WHEN 0 THEN 'reconstruction/grayThreshold' WHEN 1 THEN 'reconstruction/stripeWidth'
         WHEN 2 THEN 'acquisition/laserDuty' ELSE 'acquisition/triggerSourceLine' END AS key,
       CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE CAST(p_size * 10 - 50 AS VARCHAR) END AS value
FROM part""",
    "serial_trace": """
SELECT CONCAT('COM', CAST(user_id % 4 AS VARCHAR)) AS port, ts, epoch_us(ts) AS ts_us, event_id,
       CASE WHEN event_id % 3 = 0 THEN 'tx' ELSE 'rx' END AS direction,
       CASE WHEN event_id % 3 = 0 THEN '55AA011111' ELSE
         CONCAT('55AA0111', LPAD(HEX(a), 2, '0'), '000000', LPAD(HEX(b), 2, '0'), '000000',
           LPAD(HEX((273 + a + b + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) % 256), 2, '0')) END AS hex
FROM (SELECT e.*, 1 + user_id % 15 AS a, 1 + event_id % 200 AS b FROM events e) q""",
    "corner_pairs": """
SELECT doc_id AS frame_id, quality = 1 AS left_found, toxic = 0 AS right_found FROM labels""",
}


def with_sql(*names: str, body: str) -> str:
    """``body`` preceded by the named recipes as common table expressions."""
    return "WITH " + ",\n".join(f"{name} AS ({SQL[name]})" for name in names) + "\n" + body
