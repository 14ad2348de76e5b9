"""Capture-session audits on the frame events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.operators import capture
from cloudgauge.plans import recipes
from cloudgauge.plans.cloud_queries import round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query

ORDER = ("event_id",)
LIMIT = 60_000_000

WINDOW = "OVER (PARTITION BY session_id, side ORDER BY arrival_us, event_id)"
JUDGED = f"""
, prev AS (SELECT *, LAG(frame_number) {WINDOW} AS pf, LAG(trigger_index) {WINDOW} AS pt,
    ROW_NUMBER() {WINDOW} AS nth FROM frame_events)
, judged AS (SELECT *, CASE WHEN NOT metadata_valid OR lost_packets <> 0 THEN 'incomplete_frame'
    WHEN pf IS NOT NULL AND ((frame_number - pf) % 4294967296 + 4294967296) % 4294967296 <> 1 THEN 'frame_gap'
    WHEN pf IS NOT NULL AND (trigger_index <> 0 OR pt <> 0)
      AND ((trigger_index - pt) % 4294967296 + 4294967296) % 4294967296 <> 1 THEN 'trigger_gap' END AS violation
  FROM prev)"""
# The tables know no removals: the running sum is the upper bound of the queue.
QUEUED = """
, queued AS (SELECT session_id, side, arrival_us AS us, event_id, SUM(n_bytes) OVER (PARTITION BY session_id, side
    ORDER BY arrival_us, event_id ROWS UNBOUNDED PRECEDING) AS q FROM frame_events)"""
PLAN = """
, plan AS (SELECT session_id, CAST(MIN(c) + session_id % 3 AS BIGINT) AS expected_frames, MIN(first_us) AS start_us
   FROM (SELECT session_id, side, COUNT(*) AS c, MIN(arrival_us) AS first_us FROM frame_events GROUP BY 1, 2) s
   GROUP BY session_id)"""


def plan_of(events: DataFrame) -> DataFrame:
    sides = events.groupBy("session_id", "side").agg(
        F.count(F.lit(1)).alias("c"), F.min("arrival_ts").alias("first_ts"))
    return sides.groupBy("session_id").agg(F.min("c").alias("c"), F.min("first_ts").alias("start_ts")).select(
        "session_id", (F.col("c") + F.col("session_id") % 3).alias("expected_frames"), "start_ts")


@query("sequence_violations", sql=with_sql("frame_events", body=JUDGED + """
SELECT session_id, side, event_id, frame_number, trigger_index, pf AS prev_frame, violation FROM judged
WHERE violation IS NOT NULL"""))
def q_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capture.sequence_violations(recipes.frame_events(spark, sf_dir), ORDER)
    return found.select("session_id", "side", "event_id", "frame_number", "trigger_index", "prev_frame", "violation")


@query("first_violation", sql=with_sql("frame_events", body=JUDGED + QUEUED + PLAN + f"""
, found AS (SELECT session_id, side, arrival_us AS us, event_id, 0 AS rank, violation FROM judged
    WHERE violation IS NOT NULL
  UNION ALL SELECT session_id, side, us, event_id, 1, 'queue_full' FROM queued WHERE q > {LIMIT}
  UNION ALL SELECT session_id, side, arrival_us, event_id, 2, 'extra_frame' FROM prev JOIN plan USING (session_id)
    WHERE nth > expected_frames)
SELECT session_id, side, us AS at_us, event_id, violation FROM found
QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY us, side, event_id, rank) = 1"""))
def q_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir)
    return capture.first_violation(events, LIMIT, plan_of(events), ORDER)


@query("queue_pressure", sql=with_sql("frame_events", body=QUEUED + f"""
SELECT session_id, side, CAST(MAX(q) AS BIGINT) AS peak_bytes, BOOL_OR(q > {LIMIT}) AS overflow,
  MIN(CASE WHEN q > {LIMIT} THEN us END) AS overflow_us FROM queued GROUP BY 1, 2"""))
def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.queue_pressure(recipes.frame_events(spark, sf_dir), LIMIT, ORDER)


@query("arrival_timeouts", sql=with_sql("frame_events", body=JUDGED + PLAN + """
, sides AS (SELECT session_id, UNNEST(['left', 'right']) AS side, expected_frames, start_us FROM plan)
, waits AS (SELECT session_id, side, nth, arrival_us - COALESCE(LAG(arrival_us) OVER (PARTITION BY session_id, side
    ORDER BY arrival_us, event_id), start_us) AS w, expected_frames FROM prev JOIN sides USING (session_id, side))
, late AS (SELECT session_id, side, MIN(nth) AS late FROM waits WHERE w >= 43200000000 AND nth <= expected_frames
    GROUP BY 1, 2)
, got AS (SELECT session_id, side, COUNT(*) AS got FROM frame_events GROUP BY 1, 2)
, judged2 AS (SELECT session_id, side, COALESCE(late, CASE WHEN COALESCE(got, 0) < expected_frames
    THEN COALESCE(got, 0) + 1 END) AS index, expected_frames
  FROM sides LEFT JOIN late USING (session_id, side) LEFT JOIN got USING (session_id, side))
SELECT session_id, side, index, expected_frames FROM judged2 WHERE index IS NOT NULL"""))
def q_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir)
    plan = plan_of(events).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    return capture.arrival_timeouts(events, plan, 43_200_000, ORDER)


@query("pair_by_arrival", sql=with_sql("frame_events", body=JUDGED + """
SELECT l.session_id, l.nth AS pair_index, l.frame_number AS left_frame_number, r.frame_number AS right_frame_number,
  l.trigger_index AS left_trigger_index, r.trigger_index AS right_trigger_index
FROM prev l JOIN prev r ON l.session_id = r.session_id AND l.nth = r.nth AND l.side = 'left' AND r.side = 'right'"""))
def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = capture.pair_by_arrival(recipes.frame_events(spark, sf_dir), ORDER)
    return pairs.select("session_id", "pair_index", "left_frame_number", "right_frame_number",
                        "left_trigger_index", "right_trigger_index")


FILES = """
, files AS (SELECT session_id, side, 'frame_' || LPAD(CAST((frame_number + 6) % 4294967296 AS VARCHAR), 6, '0') || '.bmp'
    AS file_name, n_bytes % 10 <> 3 AS saved FROM frame_events)
, state AS (SELECT session_id, file_name, CASE SUM(DISTINCT CASE WHEN NOT saved THEN 0 WHEN side = 'left' THEN 1 ELSE 2 END)
    WHEN 1 THEN 'left_only' WHEN 2 THEN 'right_only' WHEN 3 THEN 'pair' ELSE 'unsaved' END AS state
  FROM files GROUP BY 1, 2)"""


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = recipes.frame_events(spark, sf_dir).select(
        "session_id", "side", F.expr("n_bytes % 10 <> 3").alias("saved"),
        F.format_string("frame_%06d.bmp", F.expr("(frame_number + 6) % 4294967296")).alias("file_name"))
    return capture.complete_pairs(files.filter("side = 'left'"), files.filter("side = 'right'"))


@query("complete_pairs", sql=with_sql("frame_events", body=FILES + "SELECT * FROM state"))
def q_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_state(spark, sf_dir)


@query("session_success", sql=with_sql("frame_events", body=FILES + PLAN + """
, c AS (SELECT session_id, CAST(SUM(CASE WHEN state = 'pair' THEN 1 ELSE 0 END) AS BIGINT) AS captured,
  CAST(SUM(CASE WHEN state <> 'pair' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM state GROUP BY 1)
SELECT session_id, expected_frames, COALESCE(captured, 0) AS captured, COALESCE(failed, 0) AS failed,
  COALESCE(captured, 0) = expected_frames AND COALESCE(failed, 0) = 0 AS success FROM plan LEFT JOIN c USING (session_id)"""))
def q_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.session_success(saved_state(spark, sf_dir), plan_of(recipes.frame_events(spark, sf_dir)), True)


DELETED = JUDGED + """
, pairs AS (SELECT l.session_id, l.nth AS pair_index, l.event_id FROM prev l JOIN prev r ON l.session_id = r.session_id
  AND l.nth = r.nth AND l.side = 'left' AND r.side = 'right')
, kept AS (SELECT session_id, event_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY pair_index) AS pair_index
  FROM pairs WHERE pair_index % 7 <> 3)"""


def deletion(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = capture.pair_by_arrival(recipes.frame_events(spark, sf_dir), ORDER).select(
        "session_id", "pair_index", "left_frame_number")
    return pairs, capture.delete_pairs(pairs, pairs.filter("pair_index % 7 = 3"))


@query("delete_pairs", sql=with_sql("frame_events", body=DELETED + """
SELECT k.session_id, k.pair_index, f.frame_number AS left_frame_number
FROM kept k JOIN frame_events f USING (session_id, event_id)"""))
def q_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletion(spark, sf_dir)[1]


@query("deletion_summary", sql=with_sql("frame_events", body=DELETED + """
SELECT p.session_id, COUNT(k.event_id) AS captured, COUNT(k.event_id) > 0 AS success FROM pairs p
LEFT JOIN kept k USING (session_id, event_id) GROUP BY 1"""))
def q_deletion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.deletion_summary(*deletion(spark, sf_dir))


@query("failure_runs", sql=with_sql("frame_events", body="""
, a AS (SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY arrival_us, event_id) AS attempt,
   n_bytes % 3 <> 0 AND n_bytes % 10 <> 4 AS saved FROM frame_events)
, g AS (SELECT *, SUM(CASE WHEN saved THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY attempt) AS grp FROM a)
, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, grp ORDER BY attempt) AS run FROM g WHERE NOT saved)
SELECT session_id, MIN(attempt) AS stopped_at FROM n WHERE run >= 3 GROUP BY 1"""))
def q_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir)
    attempts = capture.ordered.row_number(
        events, ["session_id"], ["arrival_us", "event_id"], "attempt")
    attempts = attempts.select(
        "session_id", "attempt", F.expr("n_bytes % 3 <> 0 AND n_bytes % 10 <> 4").alias("saved"))
    return capture.failure_runs(attempts)


@query("capture_report", sql=with_sql("frame_events", body=JUDGED + PLAN + """
, saves AS (SELECT l.session_id, l.nth AS pair_index, GREATEST(l.arrival_us, r.arrival_us) AS s,
    GREATEST(l.arrival_us, r.arrival_us) + l.n_bytes AS e FROM prev l JOIN prev r ON l.session_id = r.session_id
    AND l.nth = r.nth AND l.side = 'left' AND r.side = 'right')
, found AS (SELECT session_id, side, arrival_us AS us, event_id, 0 AS rank, violation FROM judged
    WHERE violation IS NOT NULL
  UNION ALL SELECT session_id, side, arrival_us, event_id, 2, 'extra_frame' FROM prev JOIN plan USING (session_id)
    WHERE nth > expected_frames)
, cause AS (SELECT session_id, us AS stop, violation FROM found
    QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY us, side, event_id, rank) = 1)
, got AS (SELECT session_id, CAST(SUM(CASE WHEN side = 'left' THEN 1 ELSE 0 END) AS BIGINT) AS l,
    CAST(SUM(CASE WHEN side = 'right' THEN 1 ELSE 0 END) AS BIGINT) AS r,
    MIN(CASE WHEN side = 'left' THEN arrival_us END) AS lf, MIN(CASE WHEN side = 'right' THEN arrival_us END) AS rf
  FROM frame_events LEFT JOIN cause USING (session_id)
  WHERE stop IS NULL OR arrival_us < stop OR (arrival_us = stop AND violation IN ('queue_full', 'extra_frame'))
  GROUP BY 1)
, sv AS (SELECT session_id, COUNT(*) AS n, SUM((e - s) / 1000.0) AS t, AVG((e - s) / 1000.0) AS m,
    MAX((e - s) / 1000.0) AS x, ARG_MIN(e, pair_index) AS fe FROM saves GROUP BY 1)
SELECT session_id, expected_frames, violation AS cause, COALESCE(l, 0) AS left_received, COALESCE(r, 0) AS right_received,
  COALESCE(n, 0) AS saved_pairs, ROUND(t, 3) AS total_save_ms, ROUND(m, 3) AS mean_save_ms, ROUND(x, 3) AS max_save_ms,
  CASE WHEN lf IS NULL THEN ROUND((fe - rf) / 1000.0, 3) WHEN rf IS NULL THEN ROUND((fe - lf) / 1000.0, 3)
    ELSE ROUND((fe - GREATEST(lf, rf)) / 1000.0, 3) END AS first_pair_latency_ms,
  violation IS NULL AND COALESCE(l, 0) = expected_frames AND COALESCE(r, 0) = expected_frames
    AND COALESCE(n, 0) = expected_frames AS success,
  GREATEST(0, expected_frames - COALESCE(n, 0)) AS failed
FROM plan LEFT JOIN cause USING (session_id) LEFT JOIN got USING (session_id) LEFT JOIN sv USING (session_id)"""))
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.frame_events(spark, sf_dir)
    pairs = capture.pair_by_arrival(events, ORDER)
    start = F.greatest("left_us", "right_us")
    saves = pairs.select("session_id", "pair_index", start.alias("save_start_ts"),
                         (start + F.col("left_n_bytes")).alias("save_end_ts"))
    report = capture.capture_report(events, saves, plan_of(events), ORDER)
    return round_all(report, 3)


@query("expected_frames", sql="""
SELECT p_partkey, CAST(CASE WHEN p_size - 5 <= 0 OR p_retailprice - 905 <= 0 THEN 0 ELSE
  GREATEST(1, FLOOR((p_size - 5) * 0.8 / ((p_retailprice - 905) / 1000) + 0.5)) END AS BIGINT) AS frames FROM part""")
def q_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = recipes.table(spark, sf_dir, "part")
    total = (F.col("p_size") - 5) * 4 / 5  # rounded once, as the twin's decimal; times 0.8 in doubles is off in the last digit
    step = (F.col("p_retailprice") - 905) / 1000
    return part.select("p_partkey", capture.expected_frames(total, step).alias("frames"))


@query("validate_scan_plan", sql="""
WITH p AS (SELECT p_partkey, 0.02 * (1 + p_partkey % 5) AS step, 1.0 * (p_size % 41) AS total,
  CAST(p_size * 20 AS BIGINT) AS frames FROM part),
q AS (SELECT *, step + 0.0025 * (p_partkey % 7) AS rs, total + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS rt,
  step + CASE WHEN p_partkey % 3 = 0 THEN 0.001 ELSE 0 END AS ss, total AS st, p_partkey % 2 = 0 AS hw,
  CASE WHEN p_partkey % 5 = 0 THEN 'Async' ELSE 'Sync' END AS sync, p_partkey % 6 AS ld, p_partkey % 4 AS rd,
  p_partkey % 3 AS ll, p_partkey % 9 % 6 AS rl FROM p),
f AS (SELECT *, CASE WHEN total > 0 THEN GREATEST(1, FLOOR(total / ss + 0.5)) ELSE 0 END AS ef FROM q)
SELECT p_partkey, CONCAT_WS(',', CASE WHEN NOT total > 0 THEN 'bad_angles' END,
  CASE WHEN ABS(rs - step) > 0.006 OR rt <> total THEN 'readback_mismatch' END,
  CASE WHEN ABS(ss - step) > 1e-4 OR ef <> frames THEN 'snapshot_mismatch' END,
  CASE WHEN hw AND sync <> 'Sync' THEN 'not_sync' END, CASE WHEN hw AND ld = rd THEN 'same_camera' END,
  CASE WHEN hw AND ll <> rl THEN 'line_mismatch' END) AS violations,
  CONCAT_WS(',', CASE WHEN ABS(step * frames - total) > step THEN 'rotation_differs' END) AS warnings FROM f""")
def q_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = recipes.table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("0.02D * (1 + p_partkey % 5)").alias("step_deg"),
        F.expr("1.0D * (p_size % 41)").alias("total_deg"), F.expr("cast(p_size * 20 as bigint)").alias("frame_count"))
    plans = part.selectExpr(
        "*", "step_deg + 0.0025D * (p_partkey % 7) AS readback_step",
        "total_deg + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS readback_total",
        "step_deg + CASE WHEN p_partkey % 3 = 0 THEN 0.001D ELSE 0D END AS snap_step", "total_deg AS snap_total",
        "p_partkey % 2 = 0 AS hardware_trigger",
        "CASE WHEN p_partkey % 5 = 0 THEN 'Async' ELSE 'Sync' END AS sync_mode", "p_partkey % 6 AS left_device",
        "p_partkey % 4 AS right_device", "p_partkey % 3 AS left_line", "p_partkey % 9 % 6 AS right_line")
    return capture.validate_scan_plan(plans).select(
        "p_partkey", F.array_join("violations", ",").alias("violations"), F.array_join("warnings", ",").alias("warnings"))


@query("trigger_feasible", sql="""
SELECT p_partkey, CASE WHEN p_retailprice * 20 >= p_size * 1000 THEN 'exposure_too_long'
  WHEN p_partkey % 4 = 0 THEN 'rate_unknown' WHEN 1000.0 / p_size > p_partkey % 60 + 0.01 THEN 'rate_too_high'
  ELSE 'ok' END AS state,
  p_retailprice * 20 < p_size * 1000 AND (p_partkey % 4 = 0 OR 1000.0 / p_size <= p_partkey % 60 + 0.01) AS feasible
FROM part""")
def q_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = recipes.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_retailprice * 20 AS exposure_us", "p_size AS interval_ms",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE cast(p_partkey % 60 as double) END AS resulting_fps")
    return capture.trigger_feasible(part).select("p_partkey", "state", "feasible")


@query("last_n_logs", sql=with_sql("logs", body="""
SELECT event_id, module, level, recency FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY module ORDER BY ts DESC,
  event_id DESC) AS recency FROM logs) q WHERE recency <= 2000"""))
def q_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.last_n(recipes.logs(spark, sf_dir), 2000, ["module"], ["ts", "event_id"])
    return rows.select("event_id", "module", "level", "recency")
