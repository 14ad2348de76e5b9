"""Manifests, names, logs, configuration, serial links, scripts, calibration checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.functions import serialcodec, text
from cloudgauge.operators import calib, fleet, stereo
from cloudgauge.plans import recipes
from cloudgauge.plans.cloud_queries import round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query

TIMEOUT_MS = 43_200_000
RANKED = """
, ranked AS (SELECT side, path, ROW_NUMBER() OVER (PARTITION BY side ORDER BY path) - 1 AS rank FROM image_manifest
  WHERE regexp_matches(path, '(?i)\\.(jpg|jpeg|png|bmp|tif|tiff)$'))"""


@query("image_range", sql=with_sql("image_manifest", body=RANKED + """
SELECT * FROM ranked WHERE rank BETWEEN 10 AND 60"""))
def q_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.select_images(recipes.image_manifest(spark, sf_dir), ["side"], 10, 60).select("side", "path", "rank")


@query("pair_by_rank", sql=with_sql("image_manifest", body=RANKED + """
SELECT l.rank, l.path AS left_path, r.path AS right_path FROM ranked l JOIN ranked r ON l.rank = r.rank
AND l.side = 'left' AND r.side = 'right'"""))
def q_pair_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = fleet.select_images(recipes.image_manifest(spark, sf_dir), ["side"]).withColumn("run", F.lit(1))
    pairs = stereo.pair_by_rank(ranked.filter("side = 'left'"), ranked.filter("side = 'right'"), ["run"])
    return pairs.select("rank", "left_path", "right_path")


@query("pair_warnings", sql=with_sql("image_manifest", body=RANKED + """
SELECT CAST(SUM(CASE WHEN side = 'left' THEN 1 ELSE 0 END) AS BIGINT) AS n_left,
  CAST(SUM(CASE WHEN side = 'right' THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
  CASE WHEN SUM(CASE WHEN side = 'left' THEN 1 ELSE 0 END) = SUM(CASE WHEN side = 'right' THEN 1 ELSE 0 END)
    THEN 'ok' ELSE 'counts_differ' END AS state FROM ranked"""))
def q_pair_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = recipes.image_manifest(spark, sf_dir).filter(F.col("path").rlike(fleet.IMAGE_PATTERN)).withColumn(
        "run", F.lit(1))
    return stereo.pair_warnings(images.filter("side = 'left'"), images.filter("side = 'right'"), ["run"]).drop("run")


@query("unique_names", sql="""
WITH asks AS (SELECT 'point_cloud_' || CAST(o_custkey % 400 AS VARCHAR) AS base, o_orderkey AS request,
   ROW_NUMBER() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey) - 1 AS i FROM orders),
cat AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'point_cloud_' ELSE 'old_cloud_' END || CAST(c_custkey % 400 AS VARCHAR) AS base,
   c_custkey % 5 AS t FROM customer),
tk AS (SELECT base, t - ROW_NUMBER() OVER (PARTITION BY base ORDER BY t) + 1 AS v FROM cat),
n AS (SELECT a.base, a.request, a.i, a.i + COUNT(tk.v) AS k FROM asks a LEFT JOIN tk ON tk.base = a.base AND tk.v <= a.i
   GROUP BY 1, 2, 3)
SELECT base, request, CASE WHEN k = 0 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS name FROM n""")
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = recipes.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("point_cloud_"), (F.col("o_custkey") % 400).cast("string")).alias("base"),
        F.col("o_orderkey").alias("request"))
    base, number = F.expr("cast(c_custkey % 400 as string)"), F.expr("c_custkey % 5")
    # Two thirds of the catalogue have names that nothing asks for.
    named = F.concat(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'point_cloud_' ELSE 'old_cloud_' END"), base)
    catalog = recipes.table(spark, sf_dir, "customer").select(
        F.when(number == 0, named).otherwise(F.concat(named, F.lit("_"), number.cast("string"))).alias("name"))
    return fleet.unique_names(asks, catalog)


@query("session_key", sql="""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d_%H%M%S_') || LPAD(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')
  WHEN 1 THEN strftime(o_orderdate, '%Y%m%d_%H%M%S_') || LPAD(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '_1'
  WHEN 2 THEN strftime(o_orderdate, '%Y%m%d_%H%M%S_') || '000_abcd'
  ELSE strftime(o_orderdate, '%Y%m%d_%H%M%S_000') END AS session_key FROM orders""")
def q_session_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = recipes.table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyyMMdd_HHmmss_")
    digits = F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")
    kind = F.col("o_orderkey") % 4
    path = (F.when(kind == 0, F.concat(F.lit("/data/"), stamp, digits))
            .when(kind == 1, F.concat(F.lit("/data/"), stamp, digits, F.lit("_1")))
            .when(kind == 2, F.concat(F.lit("/data/reconstruction_capture_"), stamp, F.lit("000_abcd")))
            .otherwise(F.concat(F.lit("/data/other_"), stamp)))
    return orders.select("o_orderkey", text.session_key(path, F.col("o_orderdate")).alias("session_key"))


@query("link_results", sql="""
WITH s AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d_%H%M%S_') || CASE WHEN o_custkey % 2 = 0 THEN '007' ELSE '008' END AS k FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S_') || '007' AS session_key,
  CASE WHEN s.k IS NOT NULL THEN '/cap/' || s.k END AS session_path
FROM orders LEFT JOIN s ON s.k = strftime(o_orderdate, '%Y%m%d_%H%M%S_') || '007'""")
def q_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = recipes.table(spark, sf_dir, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss_"), F.lit("007"))
    results = orders.select("o_orderkey", name.alias("source_path"), F.col("o_orderdate").alias("created_ts"))
    # The session of an odd customer's order has a key that no result has.
    session = F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss_"), F.expr("CASE WHEN o_custkey % 2 = 0 THEN '007' ELSE '008' END"))
    sessions = orders.select(
        F.concat(F.lit("/cap/"), session).alias("path"), F.col("o_orderdate").alias("created_ts")).distinct()
    return fleet.link_results(results, sessions).select("o_orderkey", "session_key", "session_path")


@query("key_logs", sql=with_sql("logs", body="""
SELECT module, level, COUNT(*) AS n FROM logs WHERE level <> 'Debug' GROUP BY 1, 2"""))
def q_key_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.key_logs(recipes.logs(spark, sf_dir)).groupBy("module", "level").agg(F.count(F.lit(1)).alias("n"))


@query("log_text", sql=with_sql("logs", body="""
SELECT event_id, REPLACE(REPLACE(text || CHR(13) || CHR(10) || '  end ', CHR(13), '\\r'), CHR(10), '\\n') AS escaped,
  TRIM(regexp_replace(text || CHR(13) || CHR(10) || '  end ', '\\s+', ' ', 'g')) AS shown,
  CASE level WHEN 'Debug' THEN 0 WHEN 'Info' THEN 1 WHEN 'Warning' THEN 2 ELSE 3 END AS code FROM logs"""))
def q_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("text", F.lit("\r\n  end "))
    return recipes.logs(spark, sf_dir).select(
        "event_id", text.escape_line(raw).alias("escaped"), text.display_line(raw).alias("shown"),
        text.label_code(F.col("level"), text.LEVELS).cast("int").alias("code"))


@query("expired_logs", sql="""
SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0
  AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'""")
def q_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = recipes.table(spark, sf_dir, "orders")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "20261345_120000_000").otherwise(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss_"), F.lit("123")))
    name = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "other_").otherwise("run_"), stamp, F.lit("_2.log"))
    manifest = orders.select("o_orderkey", name.alias("name"), F.col("o_orderdate").alias("mtime"),
                             (F.col("o_orderkey") % 7 != 0).alias("is_file"))
    return fleet.expired_logs(manifest, F.expr("timestamp_ntz'1997-01-02 00:00:00'")).select("o_orderkey")


@query("resolve_config", sql=with_sql("config_kv", body="""
, r(key, type, d, lo, hi) AS (VALUES ('reconstruction/grayThreshold', 'int', 120.0, 0.0, 255.0),
   ('reconstruction/stripeWidth', 'double', 5.0, 0.5, 100.0), ('acquisition/laserDuty', 'int', 100.0, 0.0, 100.0),
   ('acquisition/triggerSourceLine', 'int', 5.0, 0.0, 5.0))
, n AS (SELECT c.*, r.*, CASE WHEN type = 'int' THEN CAST(TRY_CAST(value AS INT) AS DOUBLE) ELSE TRY_CAST(value AS DOUBLE) END AS num
   FROM config_kv c LEFT JOIN r ON r.key = c.key)
SELECT station_id, key, value, CASE WHEN num IS NULL THEN 'bad_type' WHEN num < lo OR num > hi THEN 'out_of_range' END AS warning,
  CASE WHEN num IS NULL OR num < lo OR num > hi THEN CAST(d AS DOUBLE) ELSE num END AS effective FROM n"""))
def q_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.resolve_config(recipes.config_kv(spark, sf_dir), fleet.config_rules(spark)).select(
        "station_id", "key", "value", "warning", "effective")


ANSWERS = """
, q AS (SELECT port, event_id, ts_us FROM serial_trace WHERE direction = 'tx')
, a AS (SELECT port, event_id, ts_us, hex FROM serial_trace WHERE direction = 'rx' AND event_id % 13 <> 0)
, m AS (SELECT q.port, q.event_id, q.ts_us, a.ts_us AS ats, a.hex FROM q ASOF LEFT JOIN a ON q.port = a.port
   AND q.ts_us < a.ts_us)
, r AS (SELECT port, event_id, COALESCE((ats - ts_us) / 1000.0 <= 43200000, FALSE) AS answered,
   CASE WHEN (ats - ts_us) / 1000.0 <= 43200000 THEN hex END AS response,
   CASE WHEN (ats - ts_us) / 1000.0 <= 43200000 THEN ROUND((ats - ts_us) / 1000.0, 3) END AS wait_ms FROM m)"""


@query("match_responses", sql=with_sql("serial_trace", body=ANSWERS + " SELECT * FROM r"))
def q_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fleet.match_responses(recipes.serial_trace(spark, sf_dir), TIMEOUT_MS, ["event_id"])
    return round_all(found.select("port", "event_id", "answered", "response", "wait_ms"), 3)


@query("link_quality", sql=with_sql("serial_trace", body=ANSWERS + """
, c AS (SELECT port, CAST(SUM(CASE WHEN event_id % 13 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS decoded,
  CAST(SUM(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS checksum_failures
  FROM serial_trace WHERE direction = 'rx' GROUP BY 1)
SELECT c.*, COUNT(*) AS queries, CAST(SUM(CASE WHEN answered THEN 0 ELSE 1 END) AS BIGINT) AS unanswered
FROM r JOIN c USING (port) GROUP BY ALL"""))
def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.link_quality(recipes.serial_trace(spark, sf_dir), TIMEOUT_MS, ["event_id"])


@query("serial_decode", sql="""
SELECT event_id, 17 AS opcode, 1 + user_id % 15 AS first, 1 + event_id % 200 AS second,
  (1 + user_id % 15) * (1 + event_id % 200) / 100.0 AS value FROM events WHERE event_id % 3 <> 0 AND event_id % 13 <> 0""")
def q_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = recipes.serial_trace(spark, sf_dir).withColumn("d", serialcodec.decode(F.col("hex")))
    return frames.filter("d IS NOT NULL").select("event_id", "d.opcode", "d.first", "d.second", "d.value")


CODES = """CASE event_id % 8 WHEN 0 THEN 3 WHEN 1 THEN 11 WHEN 2 THEN 13 WHEN 3 THEN 15 WHEN 4 THEN 17 WHEN 5 THEN 23
  WHEN 6 THEN 25 ELSE 29 END"""


@query("serial_decode_all", sql=f"""
WITH f AS (SELECT event_id, {CODES} AS opcode, user_id % 15 AS a, 1 + event_id % 200 AS b FROM events)
SELECT event_id, opcode, a AS first, CASE WHEN opcode IN (11, 13, 17) THEN b END AS second, CAST(CASE opcode
  WHEN 17 THEN a * b / 100.0 WHEN 11 THEN a * b WHEN 13 THEN a * b WHEN 29 THEN a / 10.0
  WHEN 3 THEN CASE WHEN a = 0 THEN 0 ELSE 1 END ELSE a END AS DOUBLE) AS value FROM f""")
def q_decode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every query opcode: pairs of numbers, and single ones."""
    answers = recipes.table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{CODES} AS code", "user_id % 15 AS a", "1 + event_id % 200 AS b")
    answers = answers.selectExpr(
        "event_id", "concat('55AA01', lpad(hex(code), 2, '0'), lpad(hex(a), 2, '0'), '000000', CASE WHEN code IN (11, 13, 17) "
        "THEN concat(lpad(hex(b), 2, '0'), '000000') ELSE '' END, "
        "lpad(hex((256 + code + a + CASE WHEN code IN (11, 13, 17) THEN b ELSE 0 END) % 256), 2, '0')) AS hex")
    return answers.select("event_id", serialcodec.decode(F.col("hex")).alias("d")).select(
        "event_id", "d.opcode", "d.first", "d.second", "d.value")


@query("hex_text", sql="""
SELECT event_id, UPPER(CONCAT('55 AA ', LPAD(HEX(user_id % 256), 2, '0'))) AS shown FROM events""")
def q_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.lower(F.lpad(F.hex(F.col("user_id") % 256), 2, "0"))
    kind = F.col("event_id") % 3
    raw = (F.when(kind == 0, F.concat(F.lit("55, aa;"), byte)).when(kind == 1, F.concat(F.lit("0x55aa"), byte))
           .otherwise(F.concat(F.lit("0x55 0xAA  "), byte)))
    events = recipes.table(spark, sf_dir, "events")
    return events.select("event_id", text.spaced_hex(text.parse_hex(raw)).alias("shown"))


@query("frame_names", sql="""
SELECT event_id, 'frame_' || LPAD(CAST(event_id + 1 AS VARCHAR), 6, '0') || '.bmp' AS name, event_id AS back FROM events""")
def q_frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.frame_file_name(F.col("event_id"))
    return recipes.table(spark, sf_dir, "events").select("event_id", name.alias("name"), text.frame_index(name).alias("back"))


@query("stamp_names", sql="""
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_%g') AS name, epoch_us(ts) // 1000 AS back_ms,
  printf('%.3f', value) AS shown, CASE event_id % 5 WHEN 0 THEN 'Disconnected' WHEN 1 THEN 'Connected'
  WHEN 2 THEN 'Streaming' WHEN 3 THEN 'Error' ELSE 'Unknown' END AS state FROM events""")
def q_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    name = text.stamp_name(F.col("t"))
    return events.select(
        "event_id", name.alias("name"), F.unix_millis(text.parse_stamp(name)).alias("back_ms"),
        text.fixed(F.col("value"), 3).alias("shown"),
        text.label(F.col("event_id") % 5, text.CAMERA_STATES).alias("state"))


@query("calibration_audit", sql=with_sql("corner_pairs", body="""
, p AS (SELECT frame_id // 100 AS run_id, frame_id % 100 + 1 AS n, left_found AS l, right_found AS r FROM corner_pairs)
SELECT run_id, CAST(SUM(CASE WHEN l AND r THEN 1 ELSE 0 END) AS BIGINT) AS successful_pairs,
  CAST(SUM(CASE WHEN l AND r THEN 0 ELSE 1 END) AS BIGINT) AS failed_pairs,
  COALESCE(STRING_AGG(CAST(n AS VARCHAR), ', ' ORDER BY n) FILTER (NOT (l AND r)), 'none') AS failed_frames,
  CAST(SUM(CASE WHEN l THEN 1 ELSE 0 END) AS BIGINT) AS left_images,
  COALESCE(STRING_AGG(CAST(n AS VARCHAR), ', ' ORDER BY n) FILTER (NOT l), 'none') AS left_failed,
  CAST(SUM(CASE WHEN r THEN 1 ELSE 0 END) AS BIGINT) AS right_images,
  COALESCE(STRING_AGG(CAST(n AS VARCHAR), ', ' ORDER BY n) FILTER (NOT r), 'none') AS right_failed,
  LEAST(SUM(CASE WHEN l AND r THEN 1 ELSE 0 END), SUM(CASE WHEN l THEN 1 ELSE 0 END), SUM(CASE WHEN r THEN 1 ELSE 0 END)) >= 3
    AS success FROM p GROUP BY 1"""))
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = recipes.corner_pairs(spark, sf_dir).selectExpr(
        "frame_id div 100 AS run_id", "frame_id % 100 + 1 AS frame_number", "left_found", "right_found")
    return calib.calibration_audit(pairs)


@query("reprojection_error", sql="""
WITH o AS (SELECT l_suppkey AS image_id, l_quantity * 10 AS ox, l_extendedprice / 200 AS oy, l_discount * 10 AS oz,
   l_quantity * 7 + 400 AS u, l_extendedprice / 280 + 300 AS v FROM lineitem),
c AS (SELECT image_id, u, v, (ox - 100) / (oz + 1000) AS px, (oy - 50) / (oz + 1000) AS py FROM o),
d AS (SELECT *, px * px + py * py AS r2 FROM c),
e AS (SELECT image_id, u, v, px * (1 + ((CAST(0.01 AS DOUBLE) * r2 + 0.05) * r2 - 0.1) * r2) + 2 * 0.001 * px * py - 0.0005 * (r2 + 2 * px * px) AS dx,
  py * (1 + ((CAST(0.01 AS DOUBLE) * r2 + 0.05) * r2 - 0.1) * r2) + 0.001 * (r2 + 2 * py * py) - 2 * 0.0005 * px * py AS dy FROM d)
SELECT image_id, ROUND(AVG(SQRT(POW(700 * dx + 400 - u, 2) + POW(700 * dy + 300 - v, 2))), 6) AS error, COUNT(*) AS corners
FROM e GROUP BY 1""")
def q_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recipes.table(spark, sf_dir, "lineitem")
    obs = lines.select(
        F.col("l_suppkey").alias("image_id"), F.lit("cam").alias("camera_id"), (F.col("l_quantity") * 10).alias("ox"),
        (F.col("l_extendedprice") / 200).alias("oy"), (F.col("l_discount") * 10).alias("oz"),
        (F.col("l_quantity") * 7 + 400).alias("u"), (F.col("l_extendedprice") / 280 + 300).alias("v"))

    def array(*values: float):
        return F.array(*[F.lit(float(v)) for v in values])

    images = obs.select("image_id").distinct()
    poses = images.select("image_id", array(1, 0, 0, 0, 1, 0, 0, 0, 1).alias("r"), array(-100, -50, 1000).alias("t"))
    cams = spark.range(1).select(
        F.lit("cam").alias("camera_id"), array(700, 0, 400, 0, 700, 300, 0, 0, 1).alias("k"),
        array(-0.1, 0.05, 0.001, -0.0005, 0.01).alias("d"))
    return round_all(calib.reprojection_error(images, obs, poses, cams), 6)


@query("load_calibrations", sql="""
SELECT p_partkey AS rig_id, CAST(p_size AS DOUBLE) AS p1_first, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1.0 ELSE p_size + 0.0 END AS p2_first
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def q_load_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    nine, five, three = (F.array_repeat(size, n) for n in (9, 5, 3))
    rigs = recipes.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rig_id"), nine.alias("k1"), nine.alias("k2"), five.alias("d1"),
        F.when(F.col("p_partkey") % 5 != 0, five).alias("d2"), nine.alias("r"),
        F.when(F.col("p_partkey") % 7 == 0, F.array().cast("array<double>")).otherwise(three).alias("t"),
        F.when(F.col("p_partkey") % 4 == 0, F.array_repeat(size + 1, 9)).alias("p2"))
    return calib.load_calibrations(rigs).select(
        "rig_id", F.element_at("p1", 1).alias("p1_first"), F.element_at("p2", 1).alias("p2_first"))


SCRIPT = """CASE p_partkey % 9
 WHEN 0 THEN '55 AA 01 1A 1A#on' || CHR(10) || 'WAIT 3000' || CHR(10) || '0x55AA010909' || CHR(10) || 'wait 1000'
 WHEN 1 THEN '# nothing' || CHR(10) || '// still nothing' || CHR(10) || 'WAIT 10'
 WHEN 2 THEN '55 AA' || CHR(10) || CHR(10) || '?55 AA 01 10 10'
 WHEN 3 THEN '?55,AA;01 11 12'
 WHEN 4 THEN '55 GG 01'
 WHEN 5 THEN 'WAIT 25000' || CHR(10) || '55' || CHR(10) || 'WAIT 25000' || CHR(10) || 'WAIT 25000'
 WHEN 6 THEN 'WAIT 30001' || CHR(10) || '55'
 WHEN 7 THEN '?55 AA 01 11 11' || CHR(13) || CHR(10) || '?'
 ELSE REPEAT('5' || CAST(p_size % 10 AS VARCHAR) || CHR(10), 60 + p_size) END"""


@query("lint_scripts", sql="""
SELECT p_partkey AS pack_id, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1
    WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 60 + p_size END AS BIGINT) AS commands,
  CAST(CASE k WHEN 0 THEN 4000 WHEN 1 THEN 10 WHEN 5 THEN 75000 WHEN 6 THEN 30001 ELSE 0 END AS BIGINT) AS total_wait_ms,
  CAST(CASE k WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 4 WHEN 6 THEN 1 WHEN 7 THEN 2
    WHEN 8 THEN CASE WHEN p_size > 40 THEN 101 END END AS BIGINT) AS bad_line,
  CASE k WHEN 1 THEN 'no_command' WHEN 2 THEN 'setter_as_query' WHEN 3 THEN 'bad_query' WHEN 4 THEN 'bad_byte'
    WHEN 5 THEN 'wait_too_long' WHEN 6 THEN 'wait_too_long' WHEN 7 THEN 'byte_count'
    WHEN 8 THEN CASE WHEN p_size > 40 THEN 'too_many_commands' END END AS fault,
  CASE WHEN k IN (2, 3) THEN '?55 AA 01 11 11' END AS hint
FROM (SELECT *, p_partkey % 9 AS k FROM part) p""")
def q_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = recipes.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pack_id"), F.expr(SCRIPT.replace("AS VARCHAR", "AS STRING")).alias("content"))
    return fleet.lint_scripts(packs)


@query("board_points", sql="""
WITH b AS (SELECT p_partkey, 2 + p_size % 5 AS w, 3 AS h FROM part)
SELECT p_partkey, CAST(i AS BIGINT) AS corner_id, (i % w) * 12.5 AS ox, (i // w) * 10.0 AS oy, 0.0 AS oz
FROM b, RANGE(21) t(i) WHERE i < w * h""")
def q_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = recipes.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "2 + p_size % 5 AS width", "3 AS height", "12.5D AS square_x", "10.0D AS square_y")
    return calib.board_grids(boards).select("p_partkey", "corner_id", "ox", "oy", "oz")
