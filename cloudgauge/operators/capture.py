"""Capture-session audit: frame sequences, pairing, queue pressure, plans and reports.

Frame events are rows ``(session_id, side, arrival_ts, frame_number, trigger_index,
lost_packets, metadata_valid, n_bytes)``. Counters are 32-bit values held in longs.
Order inside a side is ``arrival_ts, frame_number`` unless ``order`` says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.operators import ordered
from cloudgauge.session import join_on, micros

# 32-bit wrap, default limits of the capture plan.
WRAP = 4294967296
QUEUE_LIMIT = 128 * 1024 * 1024
FRAME_TIMEOUT_MS = 3000
STEP_TOLERANCE = 0.006
SNAPSHOT_TOLERANCE = 1e-4
RATE_TOLERANCE = 0.01
MAX_FRAMES = 2147483647
CONSECUTIVE_FAILURES = 3

SIDE = ("session_id", "side")


def timed(events: DataFrame, name: str = "arrival_ts") -> DataFrame:
    """Add ``_us``, the arrival in microseconds."""
    return events.withColumn("_us", micros(events, name))


def _order(order: Sequence[str]) -> list[str]:
    return ["_us", *order]


# -- sequence rules ------------------------------------------------------------------


def violation_rules(index: Column, prev_frame: Column, prev_trigger: Column) -> list[tuple[str, Column]]:
    """Rules in the order in which one frame is judged; ``index`` counts from 0."""
    later = index > 0

    def jump(current: Column, previous: Column) -> Column:
        return F.pmod(current - previous, F.lit(WRAP)) != 1

    counted = (F.col("trigger_index") != 0) | (prev_trigger != 0)
    return [
        ("incomplete_frame", ~F.col("metadata_valid") | (F.col("lost_packets") != 0)),
        ("frame_gap", later & jump(F.col("frame_number"), prev_frame)),
        ("trigger_gap", later & counted & jump(F.col("trigger_index"), prev_trigger)),
    ]


def sequence_violations(
    events: DataFrame, order: Sequence[str] = ("frame_number",)
) -> DataFrame:
    """Every frame that breaks a rule against the frame before it on its side, with the
    first broken rule as ``violation``."""
    rows = timed(events)
    rows = ordered.previous(
        rows, SIDE, _order(order), {"_prev_frame": "frame_number", "_prev_trigger": "trigger_index"})
    index = F.when(F.col("_prev_frame").isNull(), 0).otherwise(1)
    judged = F.lit(None).cast("string")
    for name, broken in reversed(violation_rules(index, F.col("_prev_frame"), F.col("_prev_trigger"))):
        judged = F.when(broken, name).otherwise(judged)
    out = rows.withColumn("violation", judged).filter("violation IS NOT NULL")
    return out.withColumnsRenamed({"_prev_frame": "prev_frame", "_prev_trigger": "prev_trigger"}).drop("_us")


def queue_steps(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Queued bytes of a side after each arrival and each removal. Frames leave at
    ``taken_ts``; without that column nothing leaves, which gives an upper bound."""
    rows = timed(events)
    came = rows.select(
        *SIDE, F.col("_us"), F.lit(1).alias("_kind"), *order, F.col("n_bytes").alias("_delta"))
    steps = came
    if "taken_ts" in events.columns:
        left = rows.withColumn("_us", micros(events, "taken_ts")).filter("_us IS NOT NULL")
        steps = came.unionByName(left.select(
            *SIDE, "_us", F.lit(0).alias("_kind"), *order, (-F.col("n_bytes")).alias("_delta")))
    return ordered.running_sum(steps, SIDE, ["_us", "_kind", *order], {"queued_bytes": F.col("_delta")})


def queue_pressure(
    events: DataFrame, limit: int = QUEUE_LIMIT, order: Sequence[str] = ("frame_number",)
) -> DataFrame:
    """Peak queued bytes per side, and whether an arrival went over ``limit``."""
    steps = queue_steps(events, order).filter("_kind = 1")
    return steps.groupBy(*SIDE).agg(
        F.max("queued_bytes").alias("peak_bytes"),
        F.bool_or(F.col("queued_bytes") > limit).alias("overflow"),
        F.min(F.when(F.col("queued_bytes") > limit, F.col("_us"))).alias("overflow_us"))


def extra_frames(
    events: DataFrame, plan: DataFrame, order: Sequence[str] = ("frame_number",)
) -> DataFrame:
    """Frames of a side beyond the session's ``expected_frames``."""
    ranked = ordered.row_number(timed(events), SIDE, _order(order), "_nth")
    joined = ranked.join(plan.select("session_id", "expected_frames"), "session_id")
    return joined.filter(F.col("_nth") > F.col("expected_frames")).drop("_nth", "expected_frames", "_us")


def first_violation(
    events: DataFrame,
    limit: int | None = None,
    plan: DataFrame | None = None,
    order: Sequence[str] = ("frame_number",),
) -> DataFrame:
    """The earliest violation of each session, over both sides; it is the cause that stops
    the session. Within one frame the sequence rules go before queue and count rules."""
    found = timed(sequence_violations(events, order)).select(
        *SIDE, "_us", *order, F.lit(0).alias("_rank"), "violation")
    if limit is not None:
        over = queue_steps(events, order).filter((F.col("_kind") == 1) & (F.col("queued_bytes") > limit))
        found = found.unionByName(over.select(
            *SIDE, "_us", *order, F.lit(1).alias("_rank"), F.lit("queue_full").alias("violation")))
    if plan is not None:
        extra = timed(extra_frames(events, plan, order))
        found = found.unionByName(extra.select(
            *SIDE, "_us", *order, F.lit(2).alias("_rank"), F.lit("extra_frame").alias("violation")))
    cause = F.struct("side", "_us", *order, "violation")
    best = found.groupBy("session_id").agg(F.min_by(cause, F.struct("_us", "side", *order, "_rank")).alias("_c"))
    return best.select(
        "session_id", "_c.side", F.col("_c._us").alias("at_us"), *[f"_c.{c}" for c in order], "_c.violation")


def arrival_timeouts(
    events: DataFrame,
    plan: DataFrame,
    timeout_ms: float = FRAME_TIMEOUT_MS,
    order: Sequence[str] = ("frame_number",),
) -> DataFrame:
    """First wait longer than the timeout per side, before the expected count: frame
    ``index`` of ``expected_frames`` did not come in time. ``plan`` has ``start_ts``;
    sides without any frame are found too (they must be in ``plan``, one row per side)."""
    plan = plan.withColumn("_start", micros(plan, "start_ts")).drop("start_ts")
    rows = ordered.ranges(timed(events), SIDE, _order(order))
    rows = ordered.row_number(rows, SIDE, _order(order), "_nth", F.col("_range"))
    rows = ordered.previous(rows, SIDE, _order(order), {"_prev_us": "_us"}, F.col("_range"))
    rows = rows.select(*SIDE, "_us", "_nth", "_prev_us").join(plan, list(SIDE))
    limit = F.lit(int(timeout_ms * 1000))
    waited = F.col("_us") - F.coalesce("_prev_us", "_start")
    late = rows.filter((waited >= limit) & (F.col("_nth") <= F.col("expected_frames")))
    late = late.groupBy(*SIDE).agg(F.min("_nth").alias("_late"))
    counts = timed(events).groupBy(*SIDE).agg(F.count(F.lit(1)).alias("_got"))
    out = join_on(join_on(plan, late, SIDE, "left"), counts, SIDE, "left")
    got = F.coalesce("_got", F.lit(0))
    index = F.coalesce("_late", F.when(got < F.col("expected_frames"), got + 1))
    return out.withColumn("index", index).filter("index IS NOT NULL").select(*SIDE, "index", "expected_frames")


def failure_runs(
    attempts: DataFrame, n: int = CONSECUTIVE_FAILURES, by: Sequence[str] = ("session_id",), order: str = "attempt",
    slice_by: Column | None = None,
) -> DataFrame:
    """First attempt at which ``n`` failures in a row end the session. ``attempts`` has a
    boolean ``saved``; a saved pair starts the count again."""
    cut = slice_by if slice_by is not None else ordered.point_slice(order)
    rows = ordered.running_sum(attempts, by, [order], {
        "_resets": F.when(F.col("saved"), 1).otherwise(0), "_fails": F.when(F.col("saved"), 0).otherwise(1)}, cut)
    base = rows.groupBy(*by, "_resets").agg(F.min("_fails").alias("_base"), F.min(F.when(
        F.col("saved"), F.col("_fails"))).alias("_at_reset"))
    joined = join_on(rows.filter(~F.col("saved")), base, [*by, "_resets"])
    run = F.col("_fails") - F.coalesce("_at_reset", F.col("_base") - 1)
    return joined.withColumn("_run", run).filter(F.col("_run") >= n).groupBy(*by).agg(
        F.min(order).alias("stopped_at"))


# -- pairing -------------------------------------------------------------------------


def pair_by_arrival(
    events: DataFrame, order: Sequence[str] = ("frame_number",)
) -> DataFrame:
    """k-th left frame with k-th right frame of a session; the longer side is cut."""
    ranked = ordered.row_number(timed(events), SIDE, _order(order), "pair_index")
    keep = ["session_id", "pair_index"]
    columns = ["frame_number", "trigger_index", "n_bytes", "_us"]
    sides = {
        side: ranked.filter(F.col("side") == side).select(
            *keep, *[F.col(c).alias(f"{side}_{c.lstrip('_')}") for c in columns])
        for side in ("left", "right")
    }
    return sides["left"].join(sides["right"], keep)


def complete_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("session_id", "file_name")) -> DataFrame:
    """Full outer join of the files of both sides: ``pair``, the side whose partner is missing and
    which must be withdrawn, or ``unsaved``. A file counts unless its ``saved`` (where that column exists) is not true."""
    def files(df: DataFrame, name: str) -> DataFrame:
        saved = F.coalesce(F.col("saved"), F.lit(False)) if "saved" in df.columns else F.lit(True)
        return df.groupBy(*keys).agg(F.bool_or(saved).alias(name))

    both = files(left, "_l").join(files(right, "_r"), list(keys), "full")
    has_left, has_right = F.coalesce("_l", F.lit(False)), F.coalesce("_r", F.lit(False))
    state = F.when(has_left & has_right, "pair").when(has_left, "left_only").when(has_right, "right_only")
    return both.withColumn("state", state.otherwise("unsaved")).drop("_l", "_r")


def session_success(pairs: DataFrame, plan: DataFrame, require_all: bool) -> DataFrame:
    """Captured and failed counts per session. A reconstruction capture needs all expected
    pairs, a plain capture needs any."""
    counts = pairs.groupBy("session_id").agg(
        F.sum(F.when(F.col("state") == "pair", 1).otherwise(0)).alias("captured"),
        F.sum(F.when(F.col("state") != "pair", 1).otherwise(0)).alias("failed"))
    out = join_on(plan.select("session_id", "expected_frames"), counts, ["session_id"], "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("captured", "failed")})
    ok = F.col("captured") == F.col("expected_frames") if require_all else F.col("captured") > 0
    if require_all:
        ok = ok & (F.col("failed") == 0)
    return out.withColumn("success", ok)


def delete_pairs(pairs: DataFrame, keys: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Remove the listed pairs; later pairs move up. Adds ``captured`` and ``success``."""
    kept = pairs.join(keys.select(*by, "pair_index").distinct(), [*by, "pair_index"], "left_anti")
    ranked = ordered.row_number(kept, by, ["pair_index"], "_new", ordered.point_slice("pair_index"))
    return ranked.withColumn("pair_index", F.col("_new")).drop("_new")


def deletion_summary(pairs: DataFrame, kept: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    before = pairs.select(*by).distinct()
    counts = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("captured"))
    out = join_on(before, counts, by, "left").withColumn("captured", F.coalesce("captured", F.lit(0)))
    return out.withColumn("success", F.col("captured") > 0)


# -- reports and plans ---------------------------------------------------------------


def capture_report(
    events: DataFrame, saves: DataFrame, plan: DataFrame, order: Sequence[str] = ("frame_number",),
    limit: int | None = None,
) -> DataFrame:
    """One row per session. ``saves`` holds ``(session_id, pair_index, save_start_ts,
    save_end_ts)``. Frames after the session's first violation are not received; a frame
    that fills the queue or comes in excess still counts."""
    cause = first_violation(events, limit, plan, order)
    stop = cause.select("session_id", F.col("at_us").alias("_stop"), F.col("violation").alias("cause"))
    rows = join_on(timed(events), stop, ["session_id"], "left")
    counted = F.col("_stop").isNull() | (F.col("_us") < F.col("_stop")) | (
        (F.col("_us") == F.col("_stop")) & F.col("cause").isin("queue_full", "extra_frame"))
    got = rows.filter(counted).groupBy("session_id").agg(
        *[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"{s}_received") for s in ("left", "right")],
        *[F.min(F.when(F.col("side") == s, F.col("_us"))).alias(f"_{s}_first") for s in ("left", "right")])
    timing = saves.withColumns({"_s": micros(saves, "save_start_ts"), "_e": micros(saves, "save_end_ts")})
    took = (F.col("_e") - F.col("_s")) / 1000.0
    saved = timing.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("saved_pairs"), F.sum(took).alias("total_save_ms"), F.avg(took).alias("mean_save_ms"),
        F.max(took).alias("max_save_ms"), F.min_by("_e", "pair_index").alias("_first_saved"))
    out = plan.select("session_id", "expected_frames")
    for part in (stop, got, saved):
        out = join_on(out, part.drop("_stop"), ["session_id"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("left_received", "right_received", "saved_pairs")}
    out = out.withColumns(zero)
    expected = F.col("expected_frames")
    ready = F.greatest("_left_first", "_right_first")
    ok = (F.col("cause").isNull() & (F.col("left_received") == expected) & (F.col("right_received") == expected)
          & (F.col("saved_pairs") == expected))
    return out.withColumns({
        "first_pair_latency_ms": (F.col("_first_saved") - ready) / 1000.0,
        "success": ok,
        "failed": F.greatest(F.lit(0), expected - F.col("saved_pairs")),
    }).drop("_left_first", "_right_first", "_first_saved")


def expected_frames(total: Column, step: Column) -> Column:
    """Frames of a scan: the rounded quotient, at least 1; 0 for angles that make no sense."""
    big = F.lit(float("inf"))
    valid = (
        total.isNotNull() & step.isNotNull() & ~F.isnan(total) & ~F.isnan(step) & (F.abs(total) < big)
        & (F.abs(step) < big) & (total > 0) & (step > 0))
    quotient = F.when(valid, total / step)
    usable = quotient.isNotNull() & (quotient <= MAX_FRAMES)
    rounded = F.floor(F.when(usable, quotient) + 0.5)
    return F.when(usable, F.greatest(F.lit(1), rounded)).otherwise(0).cast("bigint")


def validate_scan_plan(df: DataFrame) -> DataFrame:
    """Violation and warning codes of scan plans.

    Columns: requested ``step_deg, total_deg, frame_count``, ``readback_step,
    readback_total``, snapshot ``snap_step, snap_total``, ``hardware_trigger, sync_mode,
    left_device, right_device, left_line, right_line``.
    """
    c = F.col
    hardware = c("hardware_trigger")
    codes = [
        F.when(~(c("step_deg") > 0) | ~(c("total_deg") > 0), "bad_angles"),
        F.when((F.abs(c("readback_step") - c("step_deg")) > STEP_TOLERANCE) | ~(c("readback_step") > 0)
               | (c("readback_total") != c("total_deg")), "readback_mismatch"),
        F.when((F.abs(c("snap_step") - c("step_deg")) > SNAPSHOT_TOLERANCE)
               | (F.abs(c("snap_total") - c("total_deg")) > SNAPSHOT_TOLERANCE)
               | (expected_frames(c("snap_total"), c("snap_step")) != c("frame_count")), "snapshot_mismatch"),
        F.when(hardware & (c("sync_mode") != "Sync"), "not_sync"),
        F.when(hardware & (c("left_device") == c("right_device")), "same_camera"),
        F.when(hardware & (c("left_line") != c("right_line")), "line_mismatch"),
    ]
    off = F.abs(c("step_deg") * c("frame_count") - c("total_deg")) > c("step_deg")
    return df.withColumns({
        "violations": F.array_compact(F.array(*codes)),
        "warnings": F.array_compact(F.array(F.when(off, "rotation_differs"))),
    })


def trigger_feasible(df: DataFrame) -> DataFrame:
    """Is the exposure shorter than the trigger interval, and can the camera deliver the
    rate? An unknown camera rate is only a warning."""
    rate = F.lit(1000.0) / F.col("interval_ms")
    fps = F.col("resulting_fps")
    state = (
        F.when(F.col("exposure_us") >= F.col("interval_ms") * 1000, "exposure_too_long")
        .when(fps.isNull() | ~(fps > 0), "rate_unknown")
        .when(rate > fps + RATE_TOLERANCE, "rate_too_high")
        .otherwise("ok"))
    return df.withColumn("state", state).withColumn("feasible", F.col("state").isin("ok", "rate_unknown"))


def last_n(
    df: DataFrame, n: int, by: Sequence[str], newest: Sequence[str]
) -> DataFrame:
    """The newest ``n`` rows of each group with ``recency`` 1 for the newest. Rank filters
    on a window are pre-limited by Spark before the shuffle, so a hot group sends only its
    top rows per task."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in newest])
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
