"""Stream jobs: progressive reconstruction, log fan-out, query/answer monitor, replay."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from cloudgauge.functions import serialcodec
from cloudgauge.operators import stereo
from cloudgauge.operators.fleet import COMMAND_TIMEOUT_MS, frames_of, key_logs
from cloudgauge.session import below, cut_lineage, dated_in_order, delete_path, make_folder, own_session, release, run_folder
from cloudgauge.streaming import stateful

Sink = Callable[[DataFrame, int], None]
ROWS_PER_STORE = 500_000
ROWS_PER_BATCH = 1_000_000
ROW_GROUP_BYTES = 4 << 20


def reconstruct_stream(
    obs: DataFrame, calibrations: DataFrame, folder: str, roi_width: int, roi_height: int,
    threshold: float = stereo.MATCH_THRESHOLD, by: Sequence[str] = stereo.FRAME,
) -> DataStreamWriter:
    """Reconstruct each micro-batch of complete frames into ``folder/points`` and
    ``folder/diagnostics``. A repeated batch replaces its own output, so a restart neither
    doubles nor loses points; ``stereo.run_summary`` on the diagnostics gives the summary."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            points, diag = stereo.reconstruct(
                df.select(*by), df, calibrations, roi_width, roi_height, threshold, by)
            points.write.mode("overwrite").parquet(f"{folder}/points/batch={batch_id}")
            diag.write.mode("overwrite").parquet(f"{folder}/diagnostics/batch={batch_id}")
        finally:
            df.unpersist()

    return obs.writeStream.foreachBatch(batch)


def log_stream(
    logs: DataFrame, sinks: Sequence[Sink], on_error: Callable[[int, Exception], None] | None = None
) -> DataStreamWriter:
    """Give the log rows that are not Debug to every sink. A sink that fails is reported
    with its index and does not keep the rows from the others; without ``on_error`` the batch
    fails once all sinks have been tried."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        failed: list[Exception] = []
        try:
            for index, sink in enumerate(sinks):
                try:
                    sink(rows, batch_id)
                except Exception as error:  # noqa: BLE001 - one sink must not stop the others
                    if on_error is None:
                        failed.append(error)
                    else:
                        on_error(index, error)
        finally:
            rows.unpersist()
        if failed:
            raise ExceptionGroup("log sinks failed", failed)

    return key_logs(logs).writeStream.foreachBatch(batch)


def serial_monitor(
    trace: DataFrame, timeout_ms: int = COMMAND_TIMEOUT_MS, watermark: str = "10 seconds"
) -> DataFrame:
    """Each query with the first fitting answer within the timeout, or with NULL once the
    watermark proves that none came. Equal queries of one time stay apart, as in ``fleet.match_responses``."""
    rows = frames_of(trace).withColumn("ts", F.col("ts").cast("timestamp"))
    needs = serialcodec.expected_size(F.col("opcode"))
    rows = rows.filter(F.col("opcode").isNotNull() & (needs > 0) & F.col("valid"))
    asks = F.col("direction") == "tx"
    rows = rows.filter("ts IS NOT NULL").filter(asks | ((F.col("direction") == "rx") & (F.col("size") == needs)))
    rows = rows.select("port", "opcode", "ts", F.unix_micros("ts").alias("us"), asks.alias("asks"), "hex").withWatermark("ts", watermark)
    found = stateful.first_answers(rows, timeout_ms)
    return found.select(
        "port", "opcode", F.timestamp_micros("query_us").alias("query_ts"), "query",
        F.timestamp_micros("answer_us").alias("answer_ts"), "response")


def pair_stream(
    events: DataFrame, folder: str, watermark: str = "10 seconds", tie: str = "frame_number", stop_on_violation: bool = True
) -> tuple[DataStreamWriter, DataFrame]:
    """k-th left frame with k-th right frame per session, each frame used once.

    Two queries, because Spark takes one such operator in each: the first writes numbered frames to ``folder`` (start the
    returned writer with a checkpoint), the second is the returned stream of pairs over that folder.
    """
    spark = events.sparkSession
    make_folder(spark, folder)
    numbered = stateful.number_frames(events, watermark, tie, stop_on_violation)
    writer = numbered.writeStream.format("parquet").option("path", folder).outputMode("append")
    return writer, stateful.pair_numbered(spark.readStream.schema(stateful.NUMBERED).parquet(folder))


def with_progress(
    query: StreamingQuery, callback: Callable[[dict], None], on_error: Callable[[Exception], None] | None = None,
    poll_s: float = 0.2,
) -> None:
    """Wait for a query and report each micro-batch's progress once. A failing callback
    never stops the query."""
    seen = -1
    while True:
        active = query.isActive
        for progress in query.recentProgress:
            if progress["batchId"] > seen:
                seen = progress["batchId"]
                try:
                    callback(dict(progress))
                except Exception as error:  # noqa: BLE001
                    if on_error is not None:
                        on_error(error)
        if not active:
            query.awaitTermination()
            return
        time.sleep(poll_s)


def replay(
    rows: DataFrame, time_column: str, build: Callable[[DataFrame], DataFrame], slices: int = 3,
    rows_per_batch: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Run a stream operator over stored rows in time order and return all it emitted.

    The rows are written once and then parted by time ranges of about equal size: at least ``slices``, and so many that a
    range holds about ``rows_per_batch`` rows (rows of one time stay together). Each range is one file, and one query takes
    the files in order, one per micro-batch. Rows without a time go first.
    """
    spark = rows.sparkSession
    base = f"{run_folder(spark)}/replay-{uuid.uuid4().hex}"
    stored = cut_lineage(rows)
    n = stored.count()
    slices = max(slices, -(-n // rows_per_batch))
    cuts = stored.agg(F.percentile_approx(
        time_column, [i / slices for i in range(1, slices)], max(10_000, 20 * slices)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    # The first cut that is not below the time; a time above all cuts has the last slice.
    at = F.lit(len(cuts))
    if cuts:
        known = F.array(*[F.lit(c) for c in cuts])
        at = F.size(F.filter(known, lambda c: c < F.col(time_column)))
    sliced = stored.withColumn("_slice", F.when(F.col(time_column).isNull(), 0).otherwise(at))
    # All rows of a slice meet in one task, so it has one file; its row groups are small, so many tasks read it.
    sliced.repartitionByRange(len(cuts) + 1, "_slice").write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(
        "_slice").parquet(f"{base}/slices")
    release(stored)
    names = sorted(below(spark, f"{base}/slices", "_slice="), key=lambda name: int(name.rsplit("=", 1)[1]))
    source = f"{base}/slices/*"
    if not n:
        source = f"{base}/in"
        rows.limit(0).write.parquet(source)
    elif not dated_in_order(spark, names):
        source = f"{base}/in"
        for name in names:
            spark.read.schema(rows.schema).parquet(name).coalesce(1).write.mode("append").parquet(source)
    # State stores are opened per partition and micro-batch, so their number follows the rows.
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, n // ROWS_PER_STORE))
    session = own_session(spark, spark__sql__shuffle__partitions=str(stores))
    out = build(session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source))
    out.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    for folder in ("in", "slices", "state"):
        delete_path(spark, f"{base}/{folder}")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def replay_pairs(
    rows: DataFrame, time_column: str, watermark: str = "10 seconds", tie: str = "frame_number", stop_on_violation: bool = True
) -> DataFrame:
    """Both steps of ``pair_stream`` over stored rows."""
    numbered = replay(rows, time_column, lambda s: stateful.number_frames(s, watermark, tie, stop_on_violation))
    return replay(numbered, "arrival_us", stateful.pair_numbered)
