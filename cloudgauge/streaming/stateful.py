"""Stateful stream operators on frame events.

Each operator keeps a few numbers per key. A micro-batch of a key is ordered by arrival
inside the operator: it holds the rows' numbers once, so the source's rate limit bounds it, and
walks them in slices that carry the state. Rules are evaluated on whole arrays. Arrivals older than what a key has already seen cannot be put in order any
more; they come out as ``late_arrival`` and belong to a batch audit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloudgauge.operators.capture import FRAME_TIMEOUT_MS, QUEUE_LIMIT, WRAP
from cloudgauge.session import micros

VIOLATIONS = "session_id bigint, side string, arrival_us bigint, tie bigint, frame_number bigint, `index` bigint, violation string"
SEQUENCE_STATE = ("session_id array<bigint>, side array<string>, prev_frame array<bigint>, prev_trigger array<bigint>, count array<bigint>, "
                  "last_us array<bigint>, last_tie array<bigint>, expected array<bigint>, mark array<bigint>, timed_out array<boolean>")
#: Groups of sides that ``monitor_sequence`` judges together, one state row each.
SIDE_GROUPS = 256
#: A number that is not known: no expected count, no timer, no arrival time.
NEVER = np.iinfo(np.int64).min
SLICE = 100_000


def prepare(events: DataFrame, watermark: str, tie: str = "frame_number") -> DataFrame:
    """Numeric event columns under an event-time watermark; ``tie`` orders equal times."""
    rows = events.withColumn("_us", micros(events, "arrival_ts"))
    rows = rows.withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp")).withWatermark("arrival_ts", watermark)
    expected = F.col("expected_frames") if "expected_frames" in events.columns else F.lit(None)
    return rows.select(
        "session_id", "side", "arrival_ts", F.col("_us").alias("arrival_us"), F.col(tie).alias("tie"), "frame_number",
        "trigger_index", (~F.col("metadata_valid") | (F.col("lost_packets") != 0)).alias("bad"),
        F.col("n_bytes"), expected.cast("bigint").alias("expected"))


def gather(
    batches: Iterator[pd.DataFrame], last: tuple[int, int] | None, columns: Sequence[str]
) -> tuple[pd.DataFrame, Iterator[pd.DataFrame]]:
    """Rows of one key and micro-batch that came too late, and the others in arrival order, slice by slice."""
    rows = pd.concat([batch[list(columns)] for batch in batches], ignore_index=True)
    us, tie = rows["arrival_us"].to_numpy(), rows["tie"].to_numpy()
    order = np.lexsort((tie, us))
    n_late = 0
    if last is not None:
        n_late = int(((us < last[0]) | ((us == last[0]) & (tie < last[1]))).sum())
    in_time = order[n_late:]
    parts = (rows.take(in_time[at:at + SLICE]).reset_index(drop=True) for at in range(0, len(in_time), SLICE))
    return rows.take(order[:n_late]), parts


def broken(
    frame: np.ndarray, trigger: np.ndarray, before_frame: np.ndarray, before_trigger: np.ndarray, known: np.ndarray, bad: np.ndarray
) -> np.ndarray:
    """First broken rule per frame, given the one before it, where that is ``known``."""
    gap = known & ((frame - before_frame) % WRAP != 1)
    counted = (trigger != 0) | (before_trigger != 0)
    trigger_gap = known & counted & ((trigger - before_trigger) % WRAP != 1)
    return np.select([bad, gap, trigger_gap], ["incomplete_frame", "frame_gap", "trigger_gap"], "")


def judge(rows: pd.DataFrame, prev_frame: int | None, prev_trigger: int | None) -> np.ndarray:
    """First broken rule per row of one side, empty text where none is."""
    frame, trigger = rows["frame_number"].to_numpy(), rows["trigger_index"].to_numpy()
    before_frame, before_trigger = np.roll(frame, 1), np.roll(trigger, 1)
    known = np.ones(len(rows), dtype=bool)
    if prev_frame is None:
        known[0] = False
    else:
        before_frame[0], before_trigger[0] = prev_frame, prev_trigger
    return broken(frame, trigger, before_frame, before_trigger, known, rows["bad"].to_numpy(bool))


class Sides:
    """What is held of a group's sides, an array per number, and the place of each side in them."""

    names = ("prev_frame", "prev_trigger", "count", "last_us", "last_tie", "expected", "mark")

    def __init__(self, state: GroupState) -> None:
        old = state.get if state.exists else [[]] * 10
        self.keys = list(zip(old[0], old[1]))
        self.places = {key: i for i, key in enumerate(self.keys)}
        for name, values in zip(self.names, old[2:9]):
            setattr(self, name, np.array(values, "i8"))
        self.timed_out = np.array(old[9], bool)

    def find(self, rows: pd.DataFrame) -> np.ndarray:
        """Place of each row's side; new sides get one."""
        (session, sessions), (side, sides) = (pd.factorize(rows[c], use_na_sentinel=False) for c in ("session_id", "side"))
        codes, at = np.unique(session * len(sides) + side, return_inverse=True)
        keys = [(None if pd.isna(a) else int(a), None if pd.isna(b) else b)
                for a, b in ((sessions[c // len(sides)], sides[c % len(sides)]) for c in codes.tolist())]
        for key in keys:
            if key not in self.places:
                self.places[key] = len(self.keys)
                self.keys.append(key)
        more = len(self.keys) - len(self.count)
        for name in self.names:
            new = np.full(more, NEVER if name in ("expected", "mark") else 0, "i8")
            setattr(self, name, np.concatenate([getattr(self, name), new]))
        self.timed_out = np.concatenate([self.timed_out, np.zeros(more, bool)])
        return np.array([self.places[key] for key in keys], "i8")[at]

    def found(self, at: np.ndarray, us: np.ndarray, tie: np.ndarray, frame: np.ndarray, index: np.ndarray, violation, known=None) -> pd.DataFrame:
        """Rows of ``VIOLATIONS``; frame numbers that are not ``known`` are NULL."""
        return pd.DataFrame({
            "session_id": pd.array([self.keys[i][0] for i in at.tolist()], dtype="Int64"), "side": [self.keys[i][1] for i in at.tolist()],
            "arrival_us": pd.arrays.IntegerArray(us, us == NEVER), "tie": tie,
            "frame_number": frame if known is None else pd.arrays.IntegerArray(frame, ~known), "index": index, "violation": violation})

    def keep(self, state: GroupState) -> None:
        """Give everything to the state, with a timer at the earliest mark."""
        held = ([list(c) for c in zip(*self.keys)], [getattr(self, n).tolist() for n in self.names], [self.timed_out.tolist()])
        state.update(tuple(c for part in held for c in part))
        open_marks = self.mark[self.mark != NEVER]
        if len(open_marks):
            state.setTimeoutTimestamp(max(int(open_marks.min()), state.getCurrentWatermarkMs() + 1))


def _sequence(timeout_us: int):
    columns = ["session_id", "side", "arrival_us", "tie", "frame_number", "trigger_index", "bad", "expected"]

    def passed(sides: Sides, watermark: int, seen: np.ndarray) -> pd.DataFrame:
        """The waits of sides without new rows that the watermark has passed."""
        at = np.flatnonzero((sides.mark != NEVER) & (sides.mark < watermark) & ~seen)
        sides.timed_out[at], sides.mark[at] = True, NEVER
        return sides.found(at, sides.last_us[at] + timeout_us, np.zeros(len(at), "i8"), sides.prev_frame[at], sides.count[at] + 1, "timeout")

    def walk(sides: Sides, at: np.ndarray, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of several sides, ``at``, one side after the other and each in arrival order."""
        n, starts = len(at), np.flatnonzero(np.diff(at, prepend=-1))
        sizes, mine = np.diff(starts, append=n), at[starts]
        us, tie, frame, trigger = (rows[c].to_numpy("i8") for c in ("arrival_us", "tie", "frame_number", "trigger_index"))
        begun = sides.count[mine] > 0

        def earlier(values: np.ndarray, held: np.ndarray) -> np.ndarray:
            out = np.roll(values, 1)
            out[starts] = held
            return out

        def first(marked: np.ndarray) -> np.ndarray:
            return np.minimum.reduceat(np.where(marked, np.arange(n), n), starts)

        known = np.ones(n, bool)
        known[starts] = begun
        before_frame, before_trigger = earlier(frame, sides.prev_frame[mine]), earlier(trigger, sides.prev_trigger[mine])
        violation = broken(frame, trigger, before_frame, before_trigger, known, rows["bad"].to_numpy(bool))
        index = np.arange(1, n + 1) + np.repeat(sides.count[mine] - starts, sizes)
        planned = rows["expected"].to_numpy(float)
        told = first(~np.isnan(planned))
        there = told < n
        sides.expected[mine[there]] = planned[told[there]].astype("i8")
        expected = np.repeat(sides.expected[mine], sizes)
        violation[np.repeat(there, sizes) & (index > expected) & (violation == "")] = "extra_frame"
        # A wait that ended inside the micro-batch; the timer finds those that are still open.
        before = earlier(us, np.where(begun, sides.last_us[mine], us[starts]))
        asked = np.repeat((sides.expected[mine] != NEVER) & ~sides.timed_out[mine], sizes)
        waited = first(asked & (us - before >= timeout_us) & (index <= expected))
        hit = waited[waited < n]
        if len(hit):
            sides.timed_out[at[hit]] = True
            yield sides.found(at[hit], before[hit] + timeout_us, np.zeros(len(hit), "i8"), before_frame[hit], index[hit], "timeout", known[hit])
        bad = np.flatnonzero(violation != "")
        if len(bad):
            yield sides.found(at[bad], us[bad], tie[bad], frame[bad], index[bad], violation[bad])
        last = starts + sizes - 1
        sides.count[mine] += sizes
        sides.prev_frame[mine], sides.prev_trigger[mine], sides.last_us[mine], sides.last_tie[mine] = frame[last], trigger[last], us[last], tie[last]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sides, watermark = Sides(state), state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            yield passed(sides, watermark, np.zeros(len(sides.keys), bool))
            sides.keep(state)
            return
        rows = pd.concat([batch[columns] for batch in batches], ignore_index=True)
        at, us, tie = sides.find(rows), rows["arrival_us"].to_numpy("i8"), rows["tie"].to_numpy("i8")
        last_us, last_tie = sides.last_us[at], sides.last_tie[at]
        late = (sides.count[at] > 0) & (us != NEVER) & ((us < last_us) | ((us == last_us) & (tie < last_tie)))
        order = np.lexsort((tie, us, us == NEVER, at))
        if late.any():
            old = order[late[order]]
            yield sides.found(at[old], us[old], tie[old], rows["frame_number"].to_numpy("i8")[old], np.zeros(len(old), "i8"), "late_arrival")
            order = order[~late[order]]
        for i in range(0, len(order), SLICE):
            part = order[i:i + SLICE]
            yield from walk(sides, at[part], rows.take(part))
        seen = np.zeros(len(sides.keys), bool)
        seen[at] = True
        waiting = seen & (sides.expected != NEVER) & (sides.count < sides.expected) & ~sides.timed_out
        sides.mark[seen] = NEVER
        sides.mark[waiting] = np.maximum((sides.last_us[waiting] + timeout_us) // 1000, watermark + 1)
        silent = passed(sides, watermark, seen)
        if len(silent):
            yield silent
        sides.keep(state)

    return run


def monitor_sequence(
    events: DataFrame, watermark: str = "10 seconds", timeout_ms: int = FRAME_TIMEOUT_MS, tie: str = "frame_number"
) -> DataFrame:
    """All violations per (session, side) as they happen: incomplete frames, frame and
    trigger gaps, frames beyond ``expected_frames`` (where that column exists), and once a
    timeout where a frame up to the expected count came ``timeout_ms`` or more after the one before, or not at
    all. A side is known from its first frame on. What counts is event time: a wait shows by the frame that ends it or by the watermark that passes it,
    so the result does not depend on how the rows fall into micro-batches. The sides are dealt over ``SIDE_GROUPS`` groups,
    whose rows are judged as arrays; the state of a group has a few numbers per side."""
    rows = prepare(events, watermark, tie)
    # Numbers without NULL stay whole numbers in pandas; sides without a session have a group of their own.
    group = F.when(F.col("session_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("session_id", "side"), F.lit(SIDE_GROUPS))).cast("int")
    rows = rows.withColumns({"arrival_us": F.coalesce("arrival_us", F.lit(NEVER)), "_group": group})
    return rows.groupBy("_group").applyInPandasWithState(
        _sequence(timeout_ms * 1000), VIOLATIONS, SEQUENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


NUMBERED = ("session_id bigint, side string, nth bigint, frame_number bigint, trigger_index bigint, arrival_us bigint, "
            "late_arrival boolean")
NUMBERED_COLUMNS = [c.split()[0] for c in NUMBERED.split(", ")]
NUMBER_STATE = ("left bigint, right bigint, stopped boolean, last_us bigint, last_tie bigint, left_frame bigint, "
                "left_trigger bigint, right_frame bigint, right_trigger bigint")


def _numbering(stop_on_violation: bool):
    columns = ["session_id", "side", "arrival_us", "tie", "frame_number", "trigger_index", "bad"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (0, 0, False, None, None, None, None, None, None)
        count = dict(zip(("left", "right"), old[:2]))
        stopped, last_us, last_tie = old[2:5]
        prev = {"left": old[5:7], "right": old[7:9]}
        late, parts = gather(batches, None if last_us is None else (last_us, last_tie), columns)
        if len(late):
            nth = pd.array([None] * len(late), dtype="Int64")
            yield late.assign(nth=nth, late_arrival=True)[NUMBERED_COLUMNS]
        for rows in parts:
            last_us, last_tie = int(rows["arrival_us"].iloc[-1]), int(rows["tie"].iloc[-1])
            if stopped:
                continue
            places = {side: np.flatnonzero((rows["side"] == side).to_numpy()) for side in count}
            kept = len(rows)
            if stop_on_violation:
                for side, at in places.items():
                    if len(at):
                        broken = np.flatnonzero(judge(rows.take(at).reset_index(drop=True), *prev[side]) != "")
                        if len(broken):
                            stopped, kept = True, min(kept, int(at[broken[0]]))
            for side, at in places.items():
                mine = rows.take(at[at < kept])
                if len(mine):
                    yield mine.assign(nth=np.arange(1, len(mine) + 1) + count[side], late_arrival=False)[NUMBERED_COLUMNS]
                    count[side] += len(mine)
                    prev[side] = (int(mine["frame_number"].iloc[-1]), int(mine["trigger_index"].iloc[-1]))
        state.update((count["left"], count["right"], stopped, last_us, last_tie, *prev["left"], *prev["right"]))

    return run


def number_frames(
    events: DataFrame, watermark: str = "10 seconds", tie: str = "frame_number", stop_on_violation: bool = True
) -> DataFrame:
    """Every frame with its number ``nth`` on its side of the session, from counters alone. With
    ``stop_on_violation`` the first broken sequence rule ends the session. A frame older than what its session has
    already seen has no number and comes out as ``late_arrival``."""
    rows = prepare(events, watermark, tie).drop("arrival_ts", "n_bytes", "expected")
    return rows.groupBy("session_id").applyInPandasWithState(
        _numbering(stop_on_violation), NUMBERED, NUMBER_STATE, "append", GroupStateTimeout.NoTimeout)


PAIRS = ("session_id bigint, pair_index bigint, left_frame_number bigint, right_frame_number bigint, "
         "left_trigger_index bigint, right_trigger_index bigint, ready_us bigint, late_arrival boolean")
PAIR_COLUMNS = [c.split()[0] for c in PAIRS.split(", ")]
PAIR_BLOCK = 1024
BLOCK_STATE = ("left_nth array<bigint>, left_frame array<bigint>, left_trigger array<bigint>, left_us array<bigint>, "
               "right_nth array<bigint>, right_frame array<bigint>, right_trigger array<bigint>, right_us array<bigint>, "
               "paired bigint")
WAITING = ["nth", "frame_number", "trigger_index", "arrival_us"]


def _pair_block(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of one block of numbers; the state holds the block's frames that still wait for their partner."""
    if key[1] < 0:
        for late in batches:
            is_left = late["side"] == "left"
            yield pd.DataFrame({
                "session_id": key[0], "pair_index": None, "left_frame_number": late["frame_number"].where(is_left),
                "right_frame_number": late["frame_number"].where(~is_left),
                "left_trigger_index": late["trigger_index"].where(is_left),
                "right_trigger_index": late["trigger_index"].where(~is_left), "ready_us": late["arrival_us"],
                "late_arrival": True})[PAIR_COLUMNS].astype({c: "Int64" for c in PAIR_COLUMNS[:-1]})
        return
    old = state.get if state.exists else (*[[]] * 8, 0)
    rows = pd.concat([batch[["side", *WAITING]] for batch in batches], ignore_index=True)
    sides = []
    for i, side in enumerate(("left", "right")):
        held = pd.DataFrame({c: np.array(v, "i8") for c, v in zip(WAITING, old[4 * i:4 * i + 4])})
        sides.append(pd.concat([held, rows.loc[rows["side"] == side, WAITING].astype("i8")]).set_index("nth"))
    left, right = sides
    both = left.join(right, how="inner", lsuffix="_l", rsuffix="_r").sort_index()
    if len(both):
        yield pd.DataFrame({
            "session_id": key[0], "pair_index": both.index.to_numpy(), "left_frame_number": both["frame_number_l"].to_numpy(),
            "right_frame_number": both["frame_number_r"].to_numpy(),
            "left_trigger_index": both["trigger_index_l"].to_numpy(),
            "right_trigger_index": both["trigger_index_r"].to_numpy(),
            "ready_us": np.maximum(both["arrival_us_l"], both["arrival_us_r"]).to_numpy(), "late_arrival": False})
    paired = old[8] + len(both)
    if paired == PAIR_BLOCK:
        state.remove()
        return
    rest = [side.drop(both.index).reset_index() for side in sides]
    state.update((*[frames[c].tolist() for frames in rest for c in WAITING], paired))


def pair_numbered(numbered: DataFrame) -> DataFrame:
    """Left and right frame of equal number per session. A state row holds the waiting frames of ``PAIR_BLOCK``
    numbers and goes when all of them are paired, so a side that is far ahead adds rows, not longer ones."""
    block = F.when(F.col("late_arrival"), -1).otherwise(F.floor((F.col("nth") - 1) / PAIR_BLOCK)).cast("bigint")
    return numbered.withColumn("block", block).groupBy("session_id", "block").applyInPandasWithState(
        _pair_block, PAIRS, BLOCK_STATE, "append", GroupStateTimeout.NoTimeout)


FPS = "session_id bigint, side string, arrival_us bigint, fps double, late_arrival boolean"
FPS_STATE = "start_us bigint, count bigint, last_us bigint, last_tie bigint"


def _fps(period_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count, last_us, last_tie = state.get if state.exists else (None, 0, None, None)
        late, parts = gather(
            batches, None if last_us is None else (last_us, last_tie), ["session_id", "side", "arrival_us", "tie"])
        if len(late):
            yield late[["session_id", "side", "arrival_us"]].assign(fps=np.nan, late_arrival=True)
        for rows in parts:
            times = rows["arrival_us"].to_numpy("i8")
            if start is None:
                start = int(times[0])
            at, done = 0, []
            while at < len(times):
                hit = int(np.searchsorted(times, start + period_us, side="left"))
                hit = max(hit, at)
                if hit >= len(times):
                    count += len(times) - at
                    break
                count += hit - at + 1
                done.append((*key, int(times[hit]), count / ((int(times[hit]) - start) / 1e6)))
                start, count, at = int(times[hit]), 0, hit + 1
            last_us, last_tie = int(times[-1]), int(rows["tie"].iloc[-1])
            if done:
                yield pd.DataFrame(done, columns=["session_id", "side", "arrival_us", "fps"]).assign(late_arrival=False)
        state.update((start, count, last_us, last_tie))

    return run


def live_fps(
    events: DataFrame, watermark: str = "10 seconds", period_s: float = 1.0, tie: str = "frame_number"
) -> DataFrame:
    """Frame rate per camera: frames over elapsed time, given at the first frame that is at
    least ``period_s`` after the window start; the window restarts at that frame. Frames older than the last
    one count in no window and come out as ``late_arrival``."""
    rows = prepare(events, watermark, tie).select("session_id", "side", "arrival_us", "tie")
    return rows.groupBy("session_id", "side").applyInPandasWithState(
        _fps(int(period_s * 1_000_000)), FPS, FPS_STATE, "append", GroupStateTimeout.NoTimeout)


def fps_tumbling(events: DataFrame, watermark: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Frames per fixed window and camera, final once the watermark has passed it."""
    rows = events.withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp")).withWatermark("arrival_ts", watermark)
    counts = rows.groupBy(F.window("arrival_ts", width), "session_id", "side").agg(F.count(F.lit(1)).alias("frames"))
    return counts.select("session_id", "side", F.col("window.start").alias("window_start"), "frames")


ANSWERED = "port string, opcode bigint, query_us bigint, query string, answer_us bigint, response string"
ANSWERED_COLUMNS = [c.split()[0] for c in ANSWERED.split(", ")]
ANSWER_STATE = "query_us array<bigint>, query array<string>, answer_us array<bigint>, response array<string>"

def _first_answers(limit_us: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        passed = mark * 1000 if mark > 0 else NEVER
        old = state.get if state.exists else ([], [], [], [])
        held = [pd.DataFrame({"us": np.array(old[i], "i8"), "hex": pd.Series(old[i + 1], dtype=object)}) for i in (0, 2)]
        asked, answers = [held[0]], [held[1]]
        if not state.hasTimedOut:
            for batch in batches:
                batch = batch[batch["us"] > passed]
                is_query = batch["asks"].to_numpy(bool)
                asked.append(batch.loc[is_query, ["us", "hex"]])
                answers.append(batch.loc[~is_query, ["us", "hex"]])
        queries = pd.concat(asked, ignore_index=True).sort_values(["us", "hex"], ignore_index=True)
        given = pd.concat(answers, ignore_index=True).sort_values(["us", "hex"], ignore_index=True)
        us, times = queries["us"].to_numpy("i8"), given["us"].to_numpy("i8")
        at = np.searchsorted(times, us, side="right")
        there = np.append(times, 0)[at]
        answered = (at < len(times)) & (there - us <= limit_us)
        # Nothing can come any more before the instant that the watermark has passed.
        settled = np.where(answered, there, us + limit_us)
        done = settled <= passed
        if done.any():
            hit = answered[done]
            text = np.append(given["hex"].to_numpy(object), None)[at[done]]
            yield pd.DataFrame({
                "port": key[0], "opcode": key[1], "query_us": us[done], "query": queries["hex"].to_numpy(object)[done],
                "answer_us": pd.array(np.where(hit, there[done], 0), dtype="Int64").copy(),
                "response": np.where(hit, text, None)}).assign(
                    answer_us=lambda rows: rows["answer_us"].where(pd.Series(hit), pd.NA))[ANSWERED_COLUMNS]
        rest, late = queries[~done], given[times > passed]
        if not len(rest) and not len(late):
            state.remove()
            return
        state.update((rest["us"].tolist(), rest["hex"].tolist(), late["us"].tolist(), late["hex"].tolist()))
        next_us = int(settled[~done].min()) if len(rest) else int(late["us"].max())
        state.setTimeoutTimestamp(max(next_us // 1000 + 1, mark + 1))

    return run


def first_answers(rows: DataFrame, timeout_ms: int) -> DataFrame:
    """Per port and opcode each query with the first later answer within the timeout, given once the watermark has passed
    the answer or the timeout. ``rows`` are ``(port, opcode, ts, us, asks, hex)`` under a watermark. The state holds open
    queries and the answers that the watermark has not passed, so a row is looked at a few times, whatever the timeout."""
    return rows.groupBy("port", "opcode").applyInPandasWithState(
        _first_answers(timeout_ms * 1000), ANSWERED, ANSWER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


QUEUE = ("session_id bigint, side string, at_us bigint, queued_bytes bigint, peak_bytes bigint, overflow boolean, "
         "late_rows bigint")
QUEUE_STATE = "queued bigint, peak bigint, last_us bigint, last_tie bigint"


def _queue(limit: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queued, peak, last_us, last_tie = state.get if state.exists else (0, 0, None, None)
        late, parts = gather(
            batches, None if last_us is None else (last_us, last_tie), ["arrival_us", "tie", "n_bytes"])
        # A late step is in no order any more, but its bytes are in the queue, or gone, from now on.
        queued += int(late["n_bytes"].sum())
        peak = max(peak, queued) if len(late) else peak
        for rows in parts:
            level = rows["n_bytes"].to_numpy("i8").cumsum() + queued
            came = level[rows["n_bytes"].to_numpy() >= 0]
            queued, peak = int(level[-1]), max(peak, int(came.max()) if len(came) else 0)
            last_us, last_tie = int(rows["arrival_us"].iloc[-1]), int(rows["tie"].iloc[-1])
        state.update((queued, peak, last_us, last_tie))
        yield pd.DataFrame({
            "session_id": [key[0]], "side": [key[1]], "at_us": [last_us], "queued_bytes": [queued], "peak_bytes": [peak],
            "overflow": [peak > limit], "late_rows": [len(late)]})

    return run


def queue_monitor(
    steps: DataFrame, limit: int = QUEUE_LIMIT, keys: Sequence[str] = ("session_id", "side")
) -> DataFrame:
    """Queued and peak bytes per camera after each micro-batch. ``steps`` are rows
    ``(session_id, side, arrival_us, tie, n_bytes)``, with negative bytes for removals. Steps older than the
    last one change the level when they come; ``late_rows`` counts them."""
    rows = steps.select("session_id", "side", "arrival_us", "tie", "n_bytes")
    return rows.groupBy(*keys).applyInPandasWithState(
        _queue(limit), QUEUE, QUEUE_STATE, "append", GroupStateTimeout.NoTimeout)
