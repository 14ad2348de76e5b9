"""Stream operators replayed over the driver tables, beside their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.plans import recipes
from cloudgauge.plans.capture_queries import JUDGED, LIMIT, PLAN, QUEUED, plan_of
from cloudgauge.plans.fleet_queries import ANSWERS, TIMEOUT_MS
from cloudgauge.plans.cloud_queries import round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query
from cloudgauge.plans.stereo_queries import TRIANGULATED, calibrations, observations, slopes
from cloudgauge.session import cut_lineage, run_folder
from cloudgauge.streaming import jobs, stateful

DELAY = "1 second"


@query("stream_sequence", sql=with_sql("frame_events", body=JUDGED + """
SELECT session_id, side, arrival_us, event_id AS tie, frame_number, nth AS index, violation FROM judged
WHERE violation IS NOT NULL"""))
def q_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay(recipes.frame_events(spark, sf_dir), "arrival_us",
                       lambda s: stateful.monitor_sequence(s, DELAY, tie="event_id"))


@query("stream_pairs", sql=with_sql("frame_events", body=JUDGED + """
, stop AS (SELECT session_id, MIN((arrival_us, event_id)) AS at FROM judged WHERE violation IS NOT NULL GROUP BY 1)
, ok AS (SELECT p.* FROM prev p LEFT JOIN stop s ON s.session_id = p.session_id WHERE s.at IS NULL
   OR p.arrival_us < s.at[1] OR (p.arrival_us = s.at[1] AND p.event_id < s.at[2]))
SELECT l.session_id, l.nth AS pair_index, l.frame_number AS left_frame_number, r.frame_number AS right_frame_number,
  l.trigger_index AS left_trigger_index, r.trigger_index AS right_trigger_index,
  GREATEST(l.arrival_us, r.arrival_us) AS ready_us, FALSE AS late_arrival
FROM ok l JOIN ok r ON l.session_id = r.session_id AND l.nth = r.nth AND l.side = 'left' AND r.side = 'right'"""))
def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay_pairs(recipes.frame_events(spark, sf_dir), "arrival_us", DELAY, "event_id")


@query("stream_pairs_all", sql=with_sql("frame_events", body=JUDGED + """
SELECT l.session_id, l.nth AS pair_index, l.frame_number AS left_frame_number, r.frame_number AS right_frame_number,
  l.trigger_index AS left_trigger_index, r.trigger_index AS right_trigger_index,
  GREATEST(l.arrival_us, r.arrival_us) AS ready_us, FALSE AS late_arrival
FROM prev l JOIN prev r ON l.session_id = r.session_id AND l.nth = r.nth AND l.side = 'left' AND r.side = 'right'"""))
def q_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay_pairs(recipes.frame_events(spark, sf_dir), "arrival_us", DELAY, "event_id", stop_on_violation=False)


@query("stream_queue", sql=with_sql("frame_events", body=QUEUED + f"""
SELECT session_id, side, CAST(MAX(q) AS BIGINT) AS peak_bytes, BOOL_OR(q > {LIMIT}) AS overflow
FROM queued GROUP BY 1, 2"""))
def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir)
    came = events.select("session_id", "side", "arrival_us", F.col("event_id").alias("tie"), "n_bytes")
    out = jobs.replay(came, "arrival_us", lambda s: stateful.queue_monitor(s, LIMIT))
    return out.groupBy("session_id", "side").agg(
        F.max("peak_bytes").alias("peak_bytes"), F.bool_or("overflow").alias("overflow"))


@query("stream_extra", sql=with_sql("frame_events", body=JUDGED + """
SELECT session_id, side, arrival_us, event_id AS tie, frame_number, nth AS index, COALESCE(violation, 'extra_frame') AS violation
FROM judged WHERE violation IS NOT NULL OR nth > 40 + session_id % 3"""))
def q_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir).withColumn("expected_frames", 40 + F.col("session_id") % 3)
    never_ms = 1_000_000_000_000
    return jobs.replay(events, "arrival_us", lambda s: stateful.monitor_sequence(s, DELAY, never_ms, "event_id"))


WAIT_MS = 43_200_000


@query("stream_timeout", sql=with_sql("frame_events", body=JUDGED + PLAN + f"""
, waits AS (SELECT session_id, side, nth, frame_number, arrival_us, expected_frames,
    LEAD(arrival_us) OVER (PARTITION BY session_id, side ORDER BY arrival_us, event_id) AS next_us
  FROM prev JOIN plan USING (session_id))
, open_waits AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, side ORDER BY nth) AS k FROM waits
  WHERE nth < expected_frames AND (next_us IS NULL OR next_us - arrival_us >= {WAIT_MS * 1000}))
SELECT session_id, side, arrival_us + {WAIT_MS * 1000} AS arrival_us, frame_number, nth + 1 AS index, 'timeout' AS violation
FROM open_waits WHERE k = 1"""))
def q_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wait of each side that took too long, by the frame that ended it or by the watermark."""
    events = recipes.frame_events(spark, sf_dir)
    timed = events.withColumn("arrival_ts", F.timestamp_micros("arrival_us")).join(
        plan_of(events).select("session_id", "expected_frames"), "session_id")
    # A row long after the last one lets the watermark pass every open wait.
    after = F.col("m") + 864_000_000_000
    end = timed.agg(F.max("arrival_us").alias("m")).select(
        F.lit(-1).cast("bigint").alias("session_id"), F.lit("end").alias("side"), F.timestamp_micros(after).alias("arrival_ts"),
        after.alias("arrival_us"), F.lit(0).cast("bigint").alias("event_id"), F.lit(True).alias("metadata_valid"),
        F.lit(0).cast("bigint").alias("lost_packets"), *[
            F.lit(0).cast("bigint").alias(c) for c in ("frame_number", "trigger_index", "n_bytes", "expected_frames")])
    out = jobs.replay(timed.select(end.columns).unionByName(end), "arrival_us",
                      lambda s: stateful.monitor_sequence(s, DELAY, WAIT_MS, "event_id"))
    return out.filter("violation = 'timeout'").select(
        "session_id", "side", "arrival_us", "frame_number", "index", "violation")


@query("stream_live_fps", sql=with_sql("frame_events", body="""
, f AS (SELECT session_id, side, arrival_us, ROW_NUMBER() OVER (PARTITION BY session_id, side ORDER BY arrival_us, event_id) AS i
   FROM frame_events)
, done AS (WITH RECURSIVE w AS (
   SELECT session_id, side, arrival_us, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS fps FROM f WHERE i = 1
   UNION ALL SELECT session_id, side, hit_us, j, fps FROM (
     SELECT w.session_id, w.side, n.arrival_us AS hit_us, n.i AS j, CAST(n.i - w.i AS DOUBLE) / ((n.arrival_us - w.arrival_us) / 1e6) AS fps,
       ROW_NUMBER() OVER (PARTITION BY w.session_id, w.side ORDER BY n.i) AS k
     FROM w JOIN f n ON n.session_id = w.session_id AND n.side = w.side AND n.i > w.i AND n.arrival_us >= w.arrival_us + 86400000000) q
     WHERE k = 1)
   SELECT * FROM w)
SELECT session_id, side, arrival_us, fps, FALSE AS late_arrival FROM done WHERE fps IS NOT NULL"""))
def q_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay(recipes.frame_events(spark, sf_dir), "arrival_us",
                       lambda s: stateful.live_fps(s, DELAY, 86_400.0, "event_id"))


@query("stream_fps_tumbling", sql=with_sql("frame_events", body="""
SELECT session_id, side, epoch_us(date_trunc('hour', arrival_ts)) AS start_us, COUNT(*) AS frames
FROM frame_events GROUP BY 1, 2, 3"""))
def q_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir).withColumn("arrival_ts", F.timestamp_micros("arrival_us"))
    # A row far behind the last one closes the open windows; it is not counted itself.
    end = events.agg(F.max("arrival_us").alias("m")).select(
        F.lit(-1).cast("bigint").alias("session_id"), F.lit("end").alias("side"),
        F.timestamp_micros(F.col("m") + 864_000_000_000).alias("arrival_ts"),
        (F.col("m") + 864_000_000_000).alias("arrival_us"))
    rows = events.select("session_id", "side", "arrival_ts", "arrival_us").unionByName(end)
    out = jobs.replay(rows, "arrival_us", lambda s: stateful.fps_tumbling(s, DELAY, "1 hour"))
    return out.filter("session_id >= 0").select(
        "session_id", "side", F.unix_micros("window_start").alias("start_us"), "frames")


def as_stream(rows: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """Stored rows as a file stream, and a new folder for its outputs and checkpoints."""
    spark = rows.sparkSession
    written = cut_lineage(rows)
    stream = spark.readStream.schema(written.schema).options(**options).parquet(written._written_path)
    return stream, f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_reconstruct", sql=with_sql("line_obs", body=TRIANGULATED + """
SELECT frame_id, left_obs, right_obs, ROUND(x / z, 6) AS x_slope, ROUND(y / z, 6) AS y_slope, ROUND(1 / z, 9) AS nearness
FROM points"""))
def q_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames reconstructed some files at a time; each file holds whole frames."""
    stream, base = as_stream(observations(spark, sf_dir).repartition("frame_id"), maxFilesPerTrigger="64")
    jobs.reconstruct_stream(stream, calibrations(spark), base, 2448, 2048, 0.01).option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return slopes(spark.read.parquet(f"{base}/points"))


@query("stream_logs", sql=with_sql("logs", body="""
SELECT sink, event_id, level, module, text FROM logs, (VALUES ('file'), ('panel')) s(sink) WHERE level <> 'Debug'"""))
def q_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log row that is not Debug, given to two sinks."""
    stream, base = as_stream(recipes.logs(spark, sf_dir))

    def sink(name: str) -> jobs.Sink:
        return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/out/sink={name}/batch={batch}")

    jobs.log_stream(stream, [sink("file"), sink("panel")]).option("checkpointLocation", f"{base}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sink", "event_id", "level", "module", "text")


@query("stream_serial", sql=with_sql("serial_trace", body=ANSWERS + """
SELECT r.port, q.ts_us, r.answered, r.response, r.wait_ms FROM r JOIN q USING (port, event_id)"""))
def q_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = recipes.serial_trace(spark, sf_dir).select(
        "port", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "direction", "hex")
    last = trace.agg(F.max("ts_us").alias("m"))
    # One query and one answer long after the last row let the watermark pass everything.
    after = F.col("m") + 8_640_000_000_000
    ends = [last.select(
        F.lit("END").alias("port"), F.timestamp_micros(after).alias("ts"), after.alias("ts_us"),
        F.lit(d).alias("direction"), F.lit(h).alias("hex"))
        for d, h in (("tx", "55AA011111"), ("rx", "55AA011101000000010000001301"))]
    rows = trace.unionByName(ends[0]).unionByName(ends[1].withColumn("hex", F.lit("55AA0111010000000100000013")))
    out = jobs.replay(rows, "ts_us", lambda s: jobs.serial_monitor(s, TIMEOUT_MS, DELAY))
    wait = (F.unix_micros("answer_ts") - F.unix_micros("query_ts")) / 1000.0
    return round_all(out.filter("port <> 'END'").select(
        "port", F.unix_micros("query_ts").alias("ts_us"), F.col("answer_ts").isNotNull().alias("answered"), "response",
        wait.alias("wait_ms")), 3)
