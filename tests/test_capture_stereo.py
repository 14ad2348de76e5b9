import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudgauge.functions import serialcodec, text
from cloudgauge.operators import calib, capture, fleet, graph, lines, ordered, stereo
from cloudgauge.streaming import jobs, stateful

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = ("session_id long, side string, arrival_ts timestamp, frame_number long, trigger_index long, "
          "lost_packets long, metadata_valid boolean, n_bytes long")


def frames(session, side, n, first=1, trigger=False, step_ms=30, **edit):
    rows = [
        [session, side, T0 + datetime.timedelta(milliseconds=step_ms * i), (first + i) % capture.WRAP,
         i + 1 if trigger else 0, 0, True, 100] for i in range(n)]
    for name, at in edit.items():
        if name == "gap":
            for r in rows[at:]:
                r[3] += 1
        elif name == "duplicate":
            for r in rows[at:]:
                r[3] -= 1
        elif name == "trigger_gap":
            for r in rows[at:]:
                r[4] += 1
        elif name == "lost":
            rows[at][5] = 2
        elif name == "invalid":
            rows[at][6] = False
        elif name == "stall":
            for r in rows[at:]:
                r[2] += datetime.timedelta(seconds=10)
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def sessions(spark):
    rows = frames(1, "left", 20, 1) + frames(1, "right", 20, 5000)
    rows += frames(2, "left", 20, gap=7) + frames(2, "right", 20, duplicate=9)
    rows += frames(3, "left", 20, trigger=True, trigger_gap=5) + frames(3, "right", 20, lost=3)
    rows += frames(4, "left", 20, 4294967290) + frames(4, "right", 19, invalid=18)
    rows += frames(5, "left", 22) + frames(5, "right", 20, stall=6)
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([(i, 20, T0) for i in range(1, 6)], "session_id long, expected_frames long, start_ts timestamp")


def found(df):
    return sorted((r.session_id, r.side, r.frame_number, r.violation) for r in df.collect())


WANTED = [
    (2, "left", 9, "frame_gap"), (2, "right", 9, "frame_gap"), (3, "left", 6, "trigger_gap"),
    (3, "right", 4, "incomplete_frame"), (4, "right", 19, "incomplete_frame")]


def test_violations(sessions, plan):
    assert found(capture.sequence_violations(sessions)) == WANTED
    first = {r.session_id: (r.side, r.violation) for r in capture.first_violation(sessions, 1500, plan).collect()}
    assert first == {
        1: ("left", "queue_full"), 2: ("left", "frame_gap"), 3: ("right", "incomplete_frame"), 4: ("left", "queue_full"),
        5: ("left", "queue_full")}
    assert {r.session_id: r.violation for r in capture.first_violation(sessions, None, plan).collect()}[5] == "extra_frame"


def test_report_and_timeouts(sessions, plan, spark):
    pairs = capture.pair_by_arrival(sessions)
    assert {r.session_id: r["count"] for r in pairs.groupBy("session_id").count().collect()} == {1: 20, 2: 20, 3: 20, 4: 19, 5: 20}
    saves = pairs.select("session_id", "pair_index", F.greatest("left_us", "right_us").alias("save_start_ts"),
                         (F.greatest("left_us", "right_us") + 5000).alias("save_end_ts"))
    report = {r.session_id: r for r in capture.capture_report(sessions, saves, plan).collect()}
    assert report[1].success and report[1].mean_save_ms == 5 and report[1].first_pair_latency_ms == 5
    assert [report[i].success for i in (2, 3, 4, 5)] == [False] * 4
    assert report[4].failed == 1 and report[2].left_received == 7 and report[5].cause == "extra_frame"
    sides = plan.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    late = {(r.session_id, r.side): r["index"] for r in capture.arrival_timeouts(sessions, sides).collect()}
    assert late == {(4, "right"): 20, (5, "right"): 7}


def test_queue_bound(spark):
    rows = spark.createDataFrame(frames(1, "left", 40), EVENTS).withColumn(
        "taken_ts", F.expr("arrival_ts + INTERVAL 200 MILLISECONDS"))
    peak = capture.queue_pressure(rows, 700).collect()[0]
    assert peak.peak_bytes == 700 and not peak.overflow
    assert capture.queue_pressure(rows.drop("taken_ts"), 700).collect()[0].peak_bytes == 4000


def test_hot_side_is_cut_by_count(spark):
    rows = spark.createDataFrame(frames(1, "left", 2000), EVENTS).withColumn("_us", F.unix_micros("arrival_ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        spread = ordered.ranges(rows, capture.SIDE, ["_us", "frame_number"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_range = [r["count"] for r in spread.groupBy("_range").count().collect()]
    assert sum(per_range) == 2000 and len(per_range) > 1 and max(per_range) < 1200
    steps = capture.queue_steps(rows.drop("_us"), ["frame_number"])
    assert steps.agg(F.max("queued_bytes")).first()[0] == 2000 * 100


def test_complete_pairs_judges_saved(spark):
    files = "session_id long, file_name string, saved boolean"
    left = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "c", True), (1, "d", None)], files)
    right = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", True), (1, "e", True), (1, "d", False)], files)
    found = {r.file_name: r.state for r in capture.complete_pairs(left, right).collect()}
    assert found == {"a": "pair", "b": "left_only", "c": "pair", "d": "unsaved", "e": "right_only"}
    plain = capture.complete_pairs(left.drop("saved"), right.drop("saved"))
    assert {r.file_name: r.state for r in plain.collect()} == {
        "a": "pair", "b": "pair", "c": "pair", "d": "pair", "e": "right_only"}


def test_failure_runs(spark):
    rows = [(1, i, i % 3 == 0) for i in range(1, 20)] + [(2, i, i not in (4, 5, 6, 7)) for i in range(1, 10)] + [
        (3, i, False) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "session_id long, attempt long, saved boolean")
    assert {r.session_id: r.stopped_at for r in capture.failure_runs(df).collect()} == {2: 6, 3: 3}


def test_expected_frames(spark):
    df = spark.createDataFrame(
        [(40.0, 0.02), (40.0, 0.2), (1.0, 3.0), (0.0, 1.0), (-1.0, 1.0), (float("nan"), 1.0), (1e300, 1e-300), (2.5, 1.0)],
        "total double, step double")
    assert [r[0] for r in df.select(capture.expected_frames(F.col("total"), F.col("step"))).collect()] == [
        2000, 200, 1, 0, 0, 0, 0, 3]


def test_streams_equal_batch(sessions, plan, spark):
    rows = sessions.withColumn("us", F.unix_micros("arrival_ts"))
    live = jobs.replay(rows, "us", lambda s: stateful.monitor_sequence(s, "1 second"))
    assert found(live) == WANTED
    timed = rows.join(plan.select("session_id", "expected_frames"), "session_id")
    live = jobs.replay(timed, "us", lambda s: stateful.monitor_sequence(s, "1 second"))
    extra = [r for r in found(live) if r not in WANTED]
    assert (5, "left", 21, "extra_frame") in extra and (5, "left", 22, "extra_frame") in extra
    assert any(r[3] == "timeout" and r[:2] == (4, "right") for r in extra)
    every = jobs.replay_pairs(rows, "us", "1 second", stop_on_violation=False)
    key = ["session_id", "pair_index", "left_frame_number", "right_frame_number"]
    assert sorted(every.select(key).collect()) == sorted(capture.pair_by_arrival(sessions).select(key).collect())
    stopped = jobs.replay_pairs(rows, "us", "1 second")
    counts = {r.session_id: r["count"] for r in stopped.groupBy("session_id").count().collect()}
    assert counts == {1: 20, 2: 7, 3: 3, 4: 18, 5: 20}


def test_timeouts_do_not_depend_on_batches(spark):
    """A stalled and a silent side give the same timeouts however the rows are cut."""
    rows = spark.createDataFrame(
        frames(1, "left", 10) + frames(1, "right", 10, stall=6) + frames(2, "left", 4) + frames(2, "right", 10, stall=9)
        + [(9, "end", T0 + datetime.timedelta(hours=1), 1, 0, 0, True, 1)], EVENTS)
    rows = rows.withColumn("expected_frames", F.when(F.col("session_id") < 9, 10)).withColumn("us", F.unix_micros("arrival_ts"))
    for n in (1, 3, 8):
        live = jobs.replay(rows, "us", lambda s: stateful.monitor_sequence(s, "1 second"), n)
        late = live.filter("violation = 'timeout'").select("session_id", "side", "index", "frame_number", "arrival_us")
        base = int(T0.timestamp()) * 1_000_000 + 3_000_000
        assert sorted(map(tuple, late.collect())) == [
            (1, "right", 7, 6, base + 150_000), (2, "left", 5, 4, base + 90_000), (2, "right", 10, 9, base + 240_000)]


def test_pair_stream_in_two_queries(spark, sessions, tmp_path):
    sessions.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sessions.schema).parquet(str(tmp_path / "in"))
    writer, pairs = jobs.pair_stream(stream, str(tmp_path / "numbered"))
    writer.option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination()
    pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(str(tmp_path / "out")).groupBy("session_id").count().collect()
    assert dict(map(tuple, counts)) == {1: 20, 2: 7, 3: 3, 4: 18, 5: 20}


def test_one_side_far_ahead():
    """A million left frames before the first right one: counters, and blocks of bounded length."""
    n, state = 1_000_000, Held()
    at = np.arange(n)
    left = pd.DataFrame({"session_id": 1, "side": "left", "arrival_us": at, "tie": at, "frame_number": at % 2**32,
                         "trigger_index": 0, "bad": False, "n_bytes": 1})
    right = left[:3000].assign(side="right", arrival_us=at[:3000] + n)
    numbered = pd.concat([*stateful._numbering(True)((1,), iter([left[i::7] for i in range(7)]), state),
                          *stateful._numbering(True)((1,), iter([right]), state)])
    assert not any(isinstance(v, (list, np.ndarray)) for v in state.get)
    assert len(numbered) == n + 3000 and state.get[:2] == (n, 3000)
    longest, pairs = 0, 0
    for block, part in numbered.groupby((numbered["nth"].astype("i8") - 1) // stateful.PAIR_BLOCK):
        held = Held()
        for half in (part[part["side"] == "left"], part[part["side"] == "right"]):
            if len(half):
                pairs += sum(map(len, stateful._pair_block((1, block), iter([half]), held)))
                longest = max([longest, *[len(v) for v in held.get[:8]]] if held.exists else [longest])
    assert longest == stateful.PAIR_BLOCK and pairs == 3000


def test_hot_session_in_slices(monkeypatch):
    """Slices carry the state: small ones give what one slice gives."""
    rng = np.random.default_rng(5)
    n = 5000
    rows = pd.DataFrame({"session_id": 1, "side": rng.choice(["left", "right"], n), "arrival_us": rng.integers(0, n // 2, n),
                         "tie": rng.permutation(n), "bad": rng.random(n) < 0.001, "n_bytes": rng.integers(-50, 60, n),
                         "expected": 4000.0})
    rows = rows.sort_values(["arrival_us", "tie"])
    rows["frame_number"] = rows.groupby("side").cumcount() + (rng.random(n) < 0.001)
    rows["trigger_index"] = 0
    rows = rows.sample(frac=1, random_state=1)

    def outcome(run, size):
        monkeypatch.setattr(stateful, "SLICE", size)
        state = Held()
        out = pd.concat(run((1, "left"), iter([rows[i::4] for i in range(4)]), state))
        return out.sort_values(list(out.columns), ignore_index=True), state.get

    for run in (stateful._sequence(300), stateful._numbering(False), stateful._numbering(True), stateful._fps(100), stateful._queue(100)):
        (whole, end), (cut, cut_end) = outcome(run, n), outcome(run, 37)
        pd.testing.assert_frame_equal(whole, cut, check_dtype=False)
        assert end == cut_end


def test_sides_are_judged_together():
    """One call of the sequence rules takes any number of sides, with and without a session, and gives what calls per side give."""
    rng, n, state = np.random.default_rng(7), 4000, Held()
    rows = pd.DataFrame({"session_id": rng.integers(0, 50, n).astype(object), "side": rng.choice(["left", "right"], n),
                         "arrival_us": rng.integers(0, 30_000_000, n), "tie": rng.permutation(n), "bad": rng.random(n) < 0.01,
                         "trigger_index": 0, "expected": 35.0}).sort_values(["arrival_us", "tie"])
    rows["frame_number"] = rows.groupby(["session_id", "side"]).cumcount() + (rng.random(n) < 0.02)
    rows.loc[rows["session_id"] == 7, "session_id"] = None
    halves = [rows[:n // 2].sample(frac=1, random_state=1), rows[n // 2:].sample(frac=1, random_state=2)]
    together = [pd.concat(stateful._sequence(2_000_000)((0,), iter([half]), state)) for half in halves]
    apart = []
    for _, mine in rows.groupby(["session_id", "side"], dropna=False):
        held = Held()
        for half in halves:
            here = half[half.index.isin(mine.index)]
            apart += list(stateful._sequence(2_000_000)((0,), iter([here]), held)) if len(here) else []

    def tuples(frames):
        found = pd.concat(frames).astype(object)
        return sorted(map(str, found.where(found.notna(), None).itertuples(index=False, name=None)))

    assert tuples(together) == tuples(apart)
    assert {v for f in together for v in f["violation"]} == {"incomplete_frame", "frame_gap", "extra_frame", "timeout"}
    assert len(state.get[0]) == 100


def test_replay_makes_its_rows_once_and_keeps_their_order(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        made.add(1)
        return v

    rows = spark.range(100).select(((F.col("id") * 37) % 100).alias("us")).withColumn("v", counted("us"))
    live = jobs.replay(rows, "us", lambda s: stateful.queue_monitor(s.select(
        F.lit(1).cast("bigint").alias("session_id"), F.lit("left").alias("side"), F.col("us").alias("arrival_us"),
        F.col("v").alias("tie"), F.lit(1).cast("bigint").alias("n_bytes"))), rows_per_batch=10)
    assert sorted((r.queued_bytes, r.late_rows) for r in live.collect()) == [(10 * (i + 1), 0) for i in range(10)]
    assert made.value == 100


def test_replay_leaves_settings_and_takes_rows_without_time(spark):
    width = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.createDataFrame([(i if i % 3 else None, i) for i in range(100)], "us long, v long")
    out = jobs.replay(rows, "us", lambda s: s.select("v"), rows_per_batch=10)
    assert sorted(r.v for r in out.collect()) == list(range(100))
    assert jobs.replay(rows.limit(0), "us", lambda s: s.select("v")).count() == 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == width


def test_live_fps(spark):
    rows = spark.createDataFrame(frames(1, "left", 101), EVENTS).withColumn("us", F.unix_micros("arrival_ts"))
    rates = jobs.replay(rows, "us", lambda s: stateful.live_fps(s, "1 second")).orderBy("arrival_us").collect()
    # The first window counts its opening frame; later ones start after it.
    assert [round(r.fps, 6) for r in rates] == [round(35 / 1.02, 6)] + [round(34 / 1.02, 6)] * 1


class Held:
    """State of one key between micro-batches."""

    exists, hasTimedOut, get, timer = False, False, None, None

    def update(self, value):
        self.exists, self.get, self.timer = True, value, None

    def remove(self):
        self.exists, self.get = False, None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, mark):
        self.timer = mark


EVENT_NAMES = ["session_id", "side", "arrival_us", "tie", "frame_number", "trigger_index", "bad", "n_bytes"]


def micro_batches(run, *batches, names=EVENT_NAMES, key=(1, "left"), state=None):
    state = state or Held()
    for rows in batches:
        out = list(run(key, iter([pd.DataFrame(rows, columns=names)]), state))
        yield pd.concat(out) if out else None


def test_late_rows_come_out():
    def row(side, us, frame, n_bytes=10):
        return (1, side, us, frame, frame, 0, False, n_bytes)

    first = [row("left", 10, 1), row("left", 20, 2), row("right", 21, 1)]
    second = [row("left", 5, 9), row("right", 30, 2)]
    numbered = list(micro_batches(stateful._numbering(False), first, second))
    assert numbered[1]["late_arrival"].tolist() == [True, False] and numbered[1]["nth"].isna().tolist() == [True, False]
    late, pairs = (pd.concat(stateful._pair_block((1, block), iter(rows), Held())) for block, rows in (
        (-1, [numbered[1][:1]]), (0, [numbered[0], numbered[1][1:]])))
    assert late["left_frame_number"].tolist() == [9] and late["pair_index"].isna().all() and late["ready_us"].tolist() == [5]
    assert pairs["pair_index"].tolist() == [1, 2] and pairs["ready_us"].tolist() == [21, 30]
    _, rates = micro_batches(stateful._fps(1_000_000), first[:2], [row("left", 5, 9), row("left", 3_000_000, 3)])
    assert rates["late_arrival"].tolist() == [True, False] and rates["arrival_us"].tolist() == [5, 3_000_000]
    _, queue, only_late = micro_batches(
        stateful._queue(100), first[:2], [row("left", 5, 9, 70), row("left", 30, 3, 5)], [row("left", 6, 9, -70)])
    assert queue["queued_bytes"].tolist() == [95] and queue["late_rows"].tolist() == [1]
    assert only_late["queued_bytes"].tolist() == [25] and only_late["late_rows"].tolist() == [1]


def test_log_stream_keeps_other_sinks(spark, tmp_path):
    logs = spark.createDataFrame([("Debug", "a"), ("Info", "b"), ("Error", "c")], "level string, text string")
    logs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    errors = []

    def failing(df, batch):
        raise RuntimeError("disk full")

    def keeping(df, batch):
        df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}"))

    query = jobs.log_stream(stream, [failing, keeping], lambda i, e: errors.append((i, str(e)))).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    seen = []
    jobs.with_progress(query, lambda p: seen.append(p["numInputRows"]))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert errors == [(0, "disk full")] and sum(seen) >= 2


def test_log_stream_without_handler_fails(spark, tmp_path):
    logs = spark.createDataFrame([("Info", "b")], "level string, text string")
    logs.write.parquet(str(tmp_path / "in"))
    done = []

    def failing(df, batch):
        raise RuntimeError("disk full")

    query = jobs.log_stream(
        spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in")), [failing, lambda df, b: done.append(df.count())]
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="log sinks failed"):
        query.awaitTermination()
    assert done == [1]


# -- stereo and lines ----------------------------------------------------------------

RIG = {"k": [100, 0, 32, 0, 100, 24, 0, 0, 1], "d": [0] * 5, "r": [1, 0, 0, 0, 1, 0, 0, 0, 1], "t": [-60, 0, 0]}


def rig(spark, **change):
    v = {n: [float(x) for x in values] for n, values in {**RIG, **change}.items()}
    a = "array<double>"
    return spark.createDataFrame(
        [("rig", v["k"], v["k"], v["k"], v["k"], v["d"], v["d"], v["r"], v["t"])],
        f"rig_id string, k1 {a}, k2 {a}, p1 {a}, p2 {a}, d1 {a}, d2 {a}, r {a}, t {a}")


def stripes(spark):
    rows = []
    for f in range(2):
        for side, x0 in (("left", 38 + f), ("right", 33 + f)):
            rows += [(f, side, y, x, 255) for y in range(48) for x in range(x0 - 1, x0 + 2)]
    return spark.createDataFrame(rows, "frame_id long, side string, y int, x int, gray int")


def test_stripe_pair_reconstructs(spark, tmp_path):
    pixels = stripes(spark)
    by = ["frame_id", "side"]
    obs = lines.extract_centroid(pixels, 64, 48, 120, 20, by=by).withColumn("rig_id", F.lit("rig"))
    assert sorted({(r.frame_id, r.side, r.u) for r in obs.collect()}) == [
        (0, "left", 38.0), (0, "right", 33.0), (1, "left", 39.0), (1, "right", 34.0)]
    hooks = []

    def bad_hook(df):
        raise ValueError("hook")

    points, diag = stereo.reconstruct(
        spark.range(3).withColumnRenamed("id", "frame_id"), obs, rig(spark), 64, 48, on_frames=bad_hook, on_error=hooks.append)
    rows = points.collect()
    assert len(rows) == 96 and len(hooks) == 1
    # disparity 5 px at f = 100 and a 60 mm baseline: z = 1200
    assert all(abs(r.z - 1200) < 1e-6 for r in rows)
    reasons = {r.frame_id: (r.reason, r.matched, round(r.left_coverage, 3)) for r in diag.collect()}
    assert reasons == {0: ("ok", 48, 1.0), 1: ("ok", 48, 1.0), 2: ("both_empty", 0, 0.0)}
    obs.write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "obs"))
    for _ in range(2):
        query = jobs.reconstruct_stream(stream, rig(spark), str(tmp_path / "out"), 64, 48).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/points")).count() == 96
    summary = stereo.run_summary(spark.read.parquet(str(tmp_path / "out/diagnostics")).withColumn("run_id", F.lit(1)))
    assert summary.collect()[0].merged_points == 96


def all_pairs(obs, cal, threshold, same=0.0):
    """Every driving observation against every searched one; errors up to ``same`` count as 0, lowest id on ties."""
    rays = stereo.observation_rays(obs, cal).toPandas()
    out = []
    for frame, rows in rays.groupby("frame_id"):
        left, right = rows[rows["side"] == "left"], rows[rows["side"] == "right"]
        if not len(left) or not len(right):
            continue
        drive, other = (left, right) if len(left) <= len(right) else (right, left)
        other = other.sort_values("obs_id")
        base = rows[["bx", "by", "bz"]].to_numpy()[0]
        err = np.abs(np.cross(drive[["rx", "ry", "rz"]].to_numpy()[:, None], other[["rx", "ry", "rz"]].to_numpy()[None]) @ base)
        err[err <= same] = 0.0
        best = err.argmin(axis=1)
        for i, j in enumerate(best):
            if err[i, j] < threshold:
                ids = int(drive["obs_id"].iloc[i]), int(other["obs_id"].iloc[j])
                out.append((frame, *(ids if drive is left else ids[::-1])))
    return sorted(out)


def matched_ids(obs, cal, threshold):
    return sorted(map(tuple, stereo.epipolar_match(obs, cal, threshold).select("frame_id", "left_obs", "right_obs").collect()))


OBSERVED = "frame_id long, side string, obs_id long, u double, v double, rig_id string"


def test_lines_along_the_epipolar_direction(spark):
    """Horizontal lines of 100 observations, rows that repeat, the image centre row, and a line off every other."""
    rng = np.random.default_rng(9)
    rows = []
    for f, (vl, vr) in enumerate([(31.0, 31.0), (24.0, 24.0), (24.0, 25.0)]):
        for side, v in (("left", vl), ("right", vr)):
            ids = rng.permutation(100)
            rows += [(f, side, int(i), float(u), v, "rig") for i, u in zip(ids, rng.uniform(0, 64, 100))]
    for side, n in (("left", 200), ("right", 240)):
        rows += [(3, side, i, float(u), float(v), "rig") for i, (u, v) in enumerate(
            zip(rng.uniform(0, 64, n), rng.integers(0, 6, n)))]
    obs = spark.createDataFrame(rows, OBSERVED)
    cal = rig(spark)
    for threshold in (0.5, 0.001):
        got = matched_ids(obs, cal, threshold)
        assert got == all_pairs(obs, cal, threshold, 1e-13)
    assert {r for f, _, r in matched_ids(obs, cal, 0.5) if f in (0, 1)} == {0}


def test_observations_on_the_baseline(spark):
    """With the baseline along the view, rays through its image have no azimuth: error 0 with everything."""
    rng = np.random.default_rng(2)
    rows = [(0, side, i, float(u), float(v), "rig") for side in ("left", "right")
            for i, (u, v) in enumerate(rng.uniform(0, 48, (60, 2)))]
    rows += [(1, "left", i, 40.0 + i, 30.0 - i, "rig") for i in range(20)] + [(1, "left", 20, 32.0, 24.0, "rig")]
    rows += [(1, "right", i, 10.0 + i, 40.0 - i * i / 9, "rig") for i in range(30)]
    rows += [(2, "left", i, 40.0 + i, 30.0 - i * i, "rig") for i in range(5)]
    rows += [(2, "right", i, 10.0 + i, 40.0 - i * i / 9, "rig") for i in range(30)] + [(2, "right", 30, 32.0, 24.0, "rig")]
    obs = spark.createDataFrame(rows, OBSERVED)
    cal = rig(spark, t=[0.0, 0.0, -60.0])
    assert matched_ids(obs, cal, 0.5) == all_pairs(obs, cal, 0.5, 1e-13)


def test_pruned_match_equals_full(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(3):
        for side, n in (("left", 40 + 60 * f), ("right", 90)):
            v = rng.uniform(0, 48, n) if f < 2 else 24 + rng.normal(size=n) * 1e-3
            rows += [(f, side, i, float(u), float(w), "rig") for i, (u, w) in enumerate(zip(rng.uniform(0, 64, n), v))]
    obs = spark.createDataFrame(rows, OBSERVED)
    turn = [np.cos(0.1), 0, np.sin(0.1), 0, 1, 0, -np.sin(0.1), 0, np.cos(0.1)]
    cal = rig(spark, r=[float(x) for x in turn], t=[-60.0, 3.0, 5.0])
    for threshold in (0.5, 0.002):
        assert matched_ids(obs, cal, threshold) == all_pairs(obs, cal, threshold)


def test_undistort_inverts_projection(spark):
    d = [-0.1, 0.05, 0.001, -0.0005, 0.0]
    cal = rig(spark, d=d)
    pts = spark.createDataFrame([(x / 10.0, y / 10.0) for x in range(-2, 3) for y in range(-2, 3)], "px double, py double")
    staged = pts.withColumn("rig_id", F.lit("rig")).join(cal, "rig_id")
    u, v = calib.project(F.col("px"), F.col("py"), F.lit(1.0), "k1", "d1")
    obs = staged.select("rig_id", F.lit("left").alias("side"), u.alias("u"), v.alias("v"), "px", "py")
    flat = stereo.undistort_observations(obs, cal)
    assert flat.agg(F.max(F.abs(F.col("u") - (F.col("px") * 100 + 32)))).collect()[0][0] < 1e-3


def test_missing_parameters_are_an_error(spark):
    obs = spark.createDataFrame([(0, "left", 0, 1.0, 1.0, "other")], "frame_id long, side string, obs_id long, u double, v double, rig_id string")
    with pytest.raises(Exception, match="no parameters"):
        stereo.observation_rays(obs, rig(spark)).collect()


def test_stripe_ranges_with_hole(spark):
    ring = [(0, y, x) for y in range(3, 11) for x in range(2, 12) if not (5 <= y <= 7 and 5 <= x <= 7)]
    block = [(0, y, x) for y in range(20, 23) for x in range(20, 23)]
    mask = spark.createDataFrame(ring + block, "frame_id long, y int, x int")
    got = lines.stripe_ranges(mask, 32, 32, 1.0, 2).orderBy("range_id").collect()
    assert [(r.range_id, r.y0, r.x0, r.w, r.h, r.area) for r in got] == [
        (0, 1, 0, 14, 12, 63.0), (1, 18, 18, 7, 7, 4.0)]


def dense_ranges(cells, min_area):
    """Areas and boxes of the regions by flooding a picture."""
    def flood(start, free, steps):
        seen, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                spot = (y + dy, x + dx)
                if spot in free and spot not in seen:
                    seen.add(spot)
                    todo.append(spot)
        return seen

    four = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    eight = four + [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    left, out = set(cells), []
    while left:
        region = flood(next(iter(left)), left, eight)
        left -= region
        ys, xs = [y for y, _ in region], [x for _, x in region]
        box = (min(ys), min(xs), max(ys), max(xs))
        canvas = {(y, x) for y in range(box[0] - 1, box[2] + 2) for x in range(box[1] - 1, box[3] + 2)}
        full = canvas - flood((box[0] - 1, box[1] - 1), canvas - region, four)
        edge = sum(any((y + dy, x + dx) not in full for dy, dx in four) for y, x in full)
        area = max(0.0, len(full) - edge / 2 - 1)
        if area >= min_area:
            out.append((*box, area))
    return sorted(out)


def test_stripe_ranges_match_flooding(spark):
    rng = np.random.default_rng(11)
    frames = {f: {(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random((18, 22)) < share))}
              for f, share in enumerate((0.2, 0.45, 0.55, 0.65, 0.8))}
    frames[5] = {(y, x) for y in range(18) for x in range(y, y + 3)}  # a stripe across the frame
    rings = [(1, 1, 16, 20), (4, 4, 13, 16), (6, 7, 10, 11)]
    frames[6] = {(y, x) for a, b, c, d in rings for y in range(a, c + 1) for x in range(b, d + 1) if y in (a, c) or x in (b, d)}
    frames[7] = frames[6] - {(1, 5)}
    rows = [(f, y, x) for f, cells in frames.items() for y, x in cells]
    mask = spark.createDataFrame(rows + rows[:50], "frame_id long, y int, x int")
    found = {f: [] for f in frames}
    for r in lines.stripe_ranges(mask, 40, 40, 1.0, 0).collect():
        found[r.frame_id].append((r.y0, r.x0, r.y0 + r.h - 1, r.x0 + r.w - 1, r.area))
    for f, cells in frames.items():
        assert sorted(found[f]) == dense_ranges(cells, 1.0), f
    assert lines.stripe_ranges(mask.limit(0), 40, 40, 1.0, 0).count() == 0


def test_ridge_matches_dense_filters(spark):
    rng = np.random.default_rng(2)
    height, width, stripe, threshold, selection = 24, 40, 3.0, 100, 150
    x = np.arange(width)
    image = np.array([255 * np.exp(-((x - 18.3 - 0.1 * y) ** 2) / 8) for y in range(height)]) + rng.uniform(0, 5, (height, width))
    image = np.clip(image, 0, 255).astype(int)
    rows = [(0, int(y), int(c), int(image[y, c])) for y in range(height) for c in range(width)]
    pixels = spark.createDataFrame(rows, "frame_id long, y int, x int, gray int")
    got = lines.extract_ridge(pixels, width, height, threshold, stripe, selection, one_per_row=False, min_area=20.0, border=10)
    mine = {(r.y, r.x): (r.u, r.v) for r in got.collect()}
    on = np.argwhere(image > threshold)
    y0, y1 = max(0, on[:, 0].min() - 10), min(height, on[:, 0].max() + 11)
    x0, x1 = max(0, on[:, 1].min() - 10), min(width, on[:, 1].max() + 11)
    sigma = stripe / np.sqrt(3)
    radius = int(round(3 * sigma))
    oy, ox = np.mgrid[-radius:radius + 1, -radius:radius + 1]
    bell = np.exp(-(ox**2 + oy**2) / (2 * sigma**2)) / (2 * np.pi * sigma**4)
    kernels = [ox * bell, oy * bell, (ox**2 / sigma**2 - 1) * bell, ox * oy * bell / sigma**2, (oy**2 / sigma**2 - 1) * bell]
    patch = np.zeros((height + 2 * radius, width + 2 * radius))
    patch[radius + y0:radius + y1, radius + x0:radius + x1] = image[y0:y1, x0:x1]
    wanted = {}
    for y, c in on:
        if image[y, c] <= selection:
            continue
        view = patch[y:y + 2 * radius + 1, c:c + 2 * radius + 1]
        dx, dy, a, b, e = ((k * view).sum() for k in kernels)
        values, vectors = np.linalg.eigh([[a, b], [b, e]])
        n = vectors[:, np.argmax(np.abs(values))]
        t = -(dx * n[0] + dy * n[1]) / (a * n[0] ** 2 + 2 * b * n[0] * n[1] + e * n[1] ** 2)
        if abs(t * n[0]) <= 0.5 and abs(t * n[1]) <= 0.5:
            wanted[(int(y), int(c))] = (c + t * n[0], y + t * n[1])
    assert mine.keys() == wanted.keys() and len(mine) > 10
    assert all(np.allclose(mine[k], wanted[k]) for k in mine)
    assert lines.extract_ridge(pixels, width, height, threshold, stripe, selection, min_area=20.0).count() == len(
        {y for y, _ in wanted})


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = [(1, a, b) for a, b in zip(order, order[1:])] + [(1, 1000, 1001), (2, 0, 5)]
    got = {(r.g, r.id): r.label for r in graph.components_of(
        spark.createDataFrame(edges, "g int, src long, dst long"), ["g"]).collect()}
    assert all(got[(1, i)] == 0 for i in range(n)) and got[(1, 1001)] == 1000 and got[(2, 5)] == 0


# -- calibration, text, serial -------------------------------------------------------


def test_reprojection_error(spark):
    board = calib.board_points(spark, 8, 5, 25.0, 25.0)
    angle = 0.3
    r = [float(x) for x in (1, 0, 0, 0, np.cos(angle), -np.sin(angle), 0, np.sin(angle), np.cos(angle))]
    poses = spark.createDataFrame([(i, r, [-80.0, -50.0, 600.0 + 10 * i]) for i in range(6)], "image_id long, r array<double>, t array<double>")
    cams = spark.createDataFrame([("c", [700.0, 0.0, 400.0, 0.0, 700.0, 300.0, 0.0, 0.0, 1.0], [0.0] * 5)], "camera_id string, k array<double>, d array<double>")
    obs = poses.select("image_id").join(board, how="cross").withColumn("camera_id", F.lit("c"))
    full = stereo.with_params(stereo.with_params(obs, poses, ["image_id"]), cams, ["camera_id"])
    from cloudgauge.functions.vec import add, mat_vec, vec
    cam = add(mat_vec("r", vec("ox", "oy", "oz")), tuple(F.element_at("t", i + 1) for i in range(3)))
    u, v = calib.project(*cam, "k", "d")
    seen = full.select("image_id", "camera_id", "ox", "oy", "oz", (u + 3).alias("u"), (v + 4).alias("v"))
    images = spark.range(7).withColumnRenamed("id", "image_id")
    errors = {r.image_id: (round(r.error, 6), r.corners) for r in calib.reprojection_error(images, seen, poses, cams).collect()}
    assert errors == {**{i: (5.0, 40) for i in range(6)}, 6: (0.0, 0)}


def test_session_names(spark):
    names = ["20260917_173001_123", "/x/20260917_173001_123_1/", "reconstruction_capture_20260916_120000_000_abcd1234", "other"]
    df = spark.createDataFrame([(n, T0) for n in names], "p string, t timestamp")
    assert [r[0] for r in df.select(text.session_key(F.col("p"), F.col("t"))).collect()] == [
        "20260917_173001_123", "20260917_173001_123_1", "20260916_120000_000_abcd1234", "20260101_000000_000"]


def test_log_retention_edge(spark):
    hours = [("run_20260101_000000_000.log", 25, True), ("run_20260101_000000_001.log", 23, True),
             ("run_20260101_000000_002_3.log", 24, True), ("notes.log", 99, True), ("run_20261341_000000_000.log", 99, True),
             ("run_20260101_000000_003.log", 99, False)]
    df = spark.createDataFrame(
        [(n, T0 - datetime.timedelta(hours=h), f) for n, h, f in hours], "name string, mtime timestamp, is_file boolean")
    gone = fleet.expired_logs(df, F.lit(T0)).collect()
    assert [r.name for r in gone] == ["run_20260101_000000_000.log"]


def test_serial_values(spark):
    frames_ = {"55AA01110200000005000000": 0.1, "55AA010B0300000007000000": 21.0, "55AA011D46000000": 7.0, "55AA010301000000": 1.0}
    rows = []
    for body, value in frames_.items():
        total = sum(bytes.fromhex(body)) & 0xFF
        rows.append((body + f"{total:02X}", value))
    rows.append(("55AA011D4600000000", None))
    df = spark.createDataFrame(rows, "hex string, wanted double")
    assert all(r.value == r.wanted for r in df.select("wanted", serialcodec.decode(F.col("hex"))["value"].alias("value")).collect())


def test_script_lint(spark):
    packs = [(1, "55 AA 01 1A 1A#on\nWAIT 3000\n55 AA 01 09 09#\nWAIT 1000\n55 AA 01 1B 1B#off"), (2, None), (3, "等待 5\n?55AA010202"),
             (4, "\n".join(["55"] * 101)), (5, " ".join(["55"] * 257))]
    got = {r.pack_id: (r.commands, r.bad_line, r.fault, r.hint) for r in fleet.lint_scripts(
        spark.createDataFrame(packs, "pack_id long, content string")).collect()}
    assert got[1] == (3, None, None, None) and got[2][2] == "no_command"
    assert got[3] == (1, 2, "setter_as_query", "?55 AA 01 03 03")
    assert got[4][1:3] == (101, "too_many_commands") and got[5][1:3] == (1, "byte_count")
