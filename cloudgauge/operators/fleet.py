"""Operations data of a fleet: manifests, names, logs, configuration, serial links,
command scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudgauge.functions import serialcodec, text
from cloudgauge.operators import ordered
from cloudgauge.session import micros

# Image types, log retention, script limits, configuration rules.
IMAGE_PATTERN = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff)$"
RETENTION_HOURS = 24
COMMAND_TIMEOUT_MS = 500
MAX_BYTES, MAX_COMMANDS, MAX_WAIT_MS, MAX_TOTAL_WAIT_MS = 256, 100, 30_000, 60_000

# (key, type, default, lowest, highest)
CONFIG_RULES = [
    ("calibration/boardWidth", "int", 11, 2, 100), ("calibration/boardHeight", "int", 8, 2, 100),
    ("calibration/squareWidth", "double", 15, 0.001, 10000), ("calibration/squareHeight", "double", 15, 0.001, 10000),
    ("calibration/imageBegin", "int", -1, -1, 2147483647), ("calibration/imageEnd", "int", -1, -1, 2147483647),
    ("reconstruction/mode", "int", 0, 0, 1), ("reconstruction/color", "int", 3, 0, 3),
    ("reconstruction/leftRoiX", "int", 0, 0, 100000), ("reconstruction/leftRoiY", "int", 0, 0, 100000),
    ("reconstruction/leftRoiW", "int", 2448, 1, 100000), ("reconstruction/leftRoiH", "int", 2048, 1, 100000),
    ("reconstruction/rightRoiX", "int", 0, 0, 100000), ("reconstruction/rightRoiY", "int", 0, 0, 100000),
    ("reconstruction/rightRoiW", "int", 2448, 1, 100000), ("reconstruction/rightRoiH", "int", 2048, 1, 100000),
    ("reconstruction/grayThreshold", "int", 120, 0, 255), ("reconstruction/minGray", "int", 20, 0, 255),
    ("reconstruction/binaryThreshold", "double", 100, 0, 255),
    ("reconstruction/selectionThreshold", "double", 200, 0, 255),
    ("reconstruction/stripeWidth", "double", 5, 0.5, 100), ("reconstruction/matchDistance", "double", 0.5, 0.0001, 100),
    ("reconstruction/removeEndpointCount", "int", 10, 0, 10000),
    ("reconstruction/imageBegin", "int", -1, -1, 2147483647), ("reconstruction/imageEnd", "int", -1, -1, 2147483647),
    ("acquisition/exposureTime", "double", 3000, 1, 10000000), ("acquisition/triggerSourceLine", "int", 5, 0, 5),
    ("acquisition/stepAngleDeg", "double", 0.02, 0.01, 650.25),
    ("acquisition/totalRotationAngleDeg", "double", 40, 0, 40), ("acquisition/speedMs", "int", 30, 1, 1000),
    ("acquisition/cameraGain", "double", 15, 0, 1000000), ("acquisition/grabTimeoutMs", "int", 1000, 1, 2147483647),
    ("acquisition/baudRate", "int", 115200, 1, 2147483647),
    ("acquisition/commandTimeoutMs", "int", 500, 1, 2147483647),
    ("acquisition/captureIntervalMs", "int", 30, 1, 65535),
    ("acquisition/continuousCaptureWaitMs", "int", 30, 1, 65535), ("acquisition/laserDuty", "int", 100, 0, 100),
    ("acquisition/voltageRangeV", "double", 7, 0, 10),
]


# -- manifests and names -------------------------------------------------------------


def rank_paths(df: DataFrame, by: Sequence[str], out: str = "rank") -> DataFrame:
    """Zero-based dense position by path, in byte order."""
    ranked = ordered.row_number(df, by, ["path"], "_at", None)
    return ranked.withColumn(out, F.col("_at") - 1).drop("_at")


def select_images(df: DataFrame, by: Sequence[str], begin: int = -1, end: int = -1) -> DataFrame:
    """Image files by extension, ranked by path, cut to an inclusive index range. Both
    bounds -1 keep all; an end before the start keeps none."""
    ranked = rank_paths(df.filter(F.col("path").rlike(IMAGE_PATTERN)), by)
    if begin == -1 and end == -1:
        return ranked
    return ranked.filter(F.col("rank").between(max(0, begin), end))


def unique_names(df: DataFrame, catalog: DataFrame, order: Sequence[str] = ("request",)) -> DataFrame:
    """Free name for each request ``(base, *order)``: the base itself, else ``base_1``,
    ``base_2``..., skipping names in ``catalog (name)`` and earlier requests.

    The i-th request of a base gets the i-th free number. With the taken numbers
    ``t_0 < t_1 < ...`` that is ``i`` plus how many ``t_j - j`` are at most ``i``.
    """
    names = catalog.select("name").distinct()
    suffix = F.regexp_extract("name", r"^(.*)_([1-9]\d*)$", 2)
    stem = F.regexp_extract("name", r"^(.*)_([1-9]\d*)$", 1)
    taken = names.select(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("_t")).unionByName(
        names.filter(suffix != "").select(stem.alias("base"), suffix.try_cast("bigint").alias("_t")))
    taken = taken.filter("_t IS NOT NULL").join(df.select("base").distinct(), "base", "left_semi")
    rows = ordered.row_number(taken, ["base"], ["_t"], "_j", ordered.point_slice("_t"))
    rows = rows.select("base", (F.col("_t") - F.col("_j") + 1).alias("_v"), F.lit(0).alias("_kind"))
    asks = ordered.row_number(df, ["base"], list(order), "_i", None)
    asks = asks.withColumn("_v", F.col("_i") - 1).withColumn("_kind", F.lit(1)).drop("_i")
    both = asks.unionByName(rows, allowMissingColumns=True)
    counted = ordered.running_sum(
        both, ["base"], ["_v", "_kind"], {"_before": F.when(F.col("_kind") == 0, 1).otherwise(0)},
        ordered.point_slice("_v"))
    number = F.col("_v") + F.col("_before")
    name = F.when(number == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), number.cast("string")))
    return counted.filter("_kind = 1").withColumn("name", name).drop("_v", "_kind", "_before")


def link_results(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Results with the capture session of their key; ``results`` has ``source_path`` and
    ``created_ts``, ``sessions`` has ``path`` and ``created_ts``."""
    keyed = results.withColumn("session_key", text.session_key(F.col("source_path"), F.col("created_ts")))
    known = sessions.select(
        text.session_key(F.col("path"), F.col("created_ts")).alias("session_key"), F.col("path").alias("session_path"))
    return keyed.join(known, "session_key", "left")


# -- logs ----------------------------------------------------------------------------


def key_logs(df: DataFrame) -> DataFrame:
    """Log rows that are worth keeping: everything but Debug."""
    return df.filter(F.col("level") != "Debug")


def expired_logs(manifest: DataFrame, now: Column, prefix: str = "run_") -> DataFrame:
    """Files of ``manifest (name, mtime, is_file)`` to delete: log names of this program
    with a real time stamp, last written strictly before the 24 hour limit."""
    stamp = F.regexp_extract("name", rf"^{prefix}(\d{{8}}_\d{{6}}_\d{{3}})(?:_\d+)?\.log$", 1)
    limit = now - F.expr(f"INTERVAL {RETENTION_HOURS} HOURS")
    real = (stamp != "") & text.parse_stamp(stamp).isNotNull()
    return manifest.filter(F.col("is_file") & real & F.col("mtime").isNotNull() & (F.col("mtime") < limit))


# -- configuration -------------------------------------------------------------------


def config_rules(spark) -> DataFrame:
    rows = [(k, t, float(d), float(lo), float(hi)) for k, t, d, lo, hi in CONFIG_RULES]
    return spark.createDataFrame(rows, "key string, type string, default double, lo double, hi double")


def resolve_config(kv: DataFrame, rules: DataFrame) -> DataFrame:
    """Effective number per key: the value when it has the rule's type and range, else the
    default with a ``warning`` (``bad_type`` or ``out_of_range``). Keys without a rule pass."""
    joined = kv.join(rules, "key", "left")
    whole = F.when(F.col("value").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("value").try_cast("int").cast("double"))
    real = F.trim("value").try_cast("double")
    real = F.when(~F.isnan(real) & (F.abs(real) < float("inf")), real)
    number = F.when(F.col("type") == "int", whole).otherwise(real)
    known = F.col("type").isNotNull()
    bad = F.when(~known, None).when(number.isNull(), "bad_type").when(
        ~number.between(F.col("lo"), F.col("hi")), "out_of_range")
    staged = joined.withColumns({"number": number, "warning": bad})
    effective = F.when(known & F.col("warning").isNotNull(), F.col("default")).otherwise(F.col("number"))
    return staged.withColumn("effective", effective).drop("type", "default", "lo", "hi", "number")


# -- serial links --------------------------------------------------------------------


def frames_of(trace: DataFrame) -> DataFrame:
    """Add ``opcode``, ``size``, ``valid`` (header and checksum) to a trace with ``hex``."""
    frame = F.col("hex")
    return trace.withColumns({
        "opcode": serialcodec.opcode(frame), "size": serialcodec.n_bytes(frame),
        "valid": serialcodec.has_header(frame) & serialcodec.checksum_ok(frame)})


def match_responses(
    trace: DataFrame, timeout_ms: float = COMMAND_TIMEOUT_MS, order: Sequence[str] = (),
) -> DataFrame:
    """Each query with its answer: the first later received frame on the port with the
    same opcode, the expected length and a valid checksum, if it came within the timeout.
    Rows are ``(port, ts, direction, hex)``; ``order`` breaks equal times."""
    rows = frames_of(trace).withColumn("_us", micros(trace, "ts"))
    needs = serialcodec.expected_size(F.col("opcode"))
    rows = rows.filter(F.col("opcode").isNotNull() & (needs > 0))
    answer = F.when(
        (F.col("direction") == "rx") & F.col("valid") & (F.col("size") == needs), F.struct("_us", "hex"))
    paired = ordered.following(rows, ["port", "opcode"], ["_us", *order], answer, "_answer")
    queries = paired.filter((F.col("direction") == "tx") & F.col("valid"))
    wait = (F.col("_answer._us") - F.col("_us")) / 1000.0
    on_time = F.col("_answer").isNotNull() & (wait <= float(timeout_ms))
    return queries.withColumns({
        "answered": F.coalesce(on_time, F.lit(False)), "response": F.when(on_time, F.col("_answer.hex")),
        "wait_ms": F.when(on_time, wait)}).drop("_answer", "_us", "valid", "size")


def link_quality(
    trace: DataFrame, timeout_ms: float = COMMAND_TIMEOUT_MS, order: Sequence[str] = (),
) -> DataFrame:
    """Per port: answers decoded, checksum failures, queries and those unanswered."""
    seen = frames_of(trace).filter("direction = 'rx'").withColumn("_ok", serialcodec.decode(F.col("hex")).isNotNull())
    counts = seen.groupBy("port").agg(
        F.sum(F.when(F.col("_ok"), 1).otherwise(0)).alias("decoded"),
        F.sum(F.when(F.col("opcode").isNotNull() & ~F.col("valid"), 1).otherwise(0)).alias("checksum_failures"))
    asked = match_responses(trace, timeout_ms, order).groupBy("port").agg(
        F.count(F.lit(1)).alias("queries"), F.sum(F.when(F.col("answered"), 0).otherwise(1)).alias("unanswered"))
    out = counts.join(asked, "port", "full")
    return out.na.fill(0, ["decoded", "checksum_failures", "queries", "unanswered"])


# -- command scripts -----------------------------------------------------------------


def _hex2(code: Column) -> Column:
    return F.lpad(F.hex(code), 2, "0")


def script_lines(packs: DataFrame, by: Sequence[str], keep_packs: bool = False) -> DataFrame:
    """Lines of command texts that do something, with what they mean and their own fault. With ``keep_packs`` a row of
    line 0, whose other columns are NULL, stands for each pack itself."""
    rows = packs.select(*by, F.posexplode_outer(F.split("content", "\n")).alias("_p", "_raw"))
    clean = F.regexp_replace(F.substring_index("_raw", "#", 1), r"^\s+|\s+$", "")
    rows = rows.select(*by, (F.coalesce("_p", F.lit(0)) + 1).cast("bigint").alias("line"), clean.alias("_l"))
    works = F.coalesce((F.col("_l") != "") & ~F.col("_l").startswith("//"), F.lit(False))
    if keep_packs:
        line = F.struct("line", F.when(works, F.col("_l")).alias("_l"))
        pack = F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(None).cast("string").alias("_l"))
        both = F.when(F.col("line") == 1, F.array(pack, line)).otherwise(F.array(line))
        rows = rows.select(*by, F.inline(both)).filter("line = 0 OR _l IS NOT NULL")
    else:
        rows = rows.filter(works)
    wait = F.regexp_extract("_l", r"(?i)^(?:WAIT|等待)\s+(\d+)$", 1)
    rows = rows.withColumns({"_w": wait, "_ask": F.col("_l").startswith("?")})
    rows = rows.withColumn("_is_wait", F.col("_w") != "")
    body = F.when(F.col("_ask"), F.expr("substring(_l, 2)")).otherwise(F.col("_l"))
    rows = rows.withColumn("_tokens", text.hex_tokens(F.trim(body)))
    tokens = F.col("_tokens")
    count = F.size(tokens)
    rows = rows.withColumns({
        "_wait_ms": F.when(F.col("_is_wait"), F.col("_w").try_cast("int")),
        "_count_ok": count.between(1, MAX_BYTES),
        "_hex_ok": F.forall(tokens, lambda t: t.rlike("^[0-9A-Fa-f]{2}$")),
        "_frame": F.upper(F.array_join(tokens, "")),
        "_size": count,
    })
    known = F.col("_ask") & F.col("_hex_ok") & serialcodec.has_header(F.col("_frame"))
    code = F.when(known, serialcodec.byte_at(F.col("_frame"), 3))
    getter = F.lit(None).cast("bigint")
    for setter, query in serialcodec.GETTER_OF_SETTER.items():
        getter = F.when(code == setter, F.lit(query).cast("bigint")).otherwise(getter)
    rows = rows.withColumns({"_code": code, "_getter": getter})
    setter_used = F.col("_getter").isNotNull() & (F.col("_size") == 5)
    is_getter = F.col("_code").isin(serialcodec.PAIR_GETTERS + serialcodec.SINGLE_GETTERS)
    bad_query = is_getter & ((F.col("_size") != 5) | (serialcodec.byte_at(F.col("_frame"), 4) != F.col("_code")))
    fault = (
        F.when(F.col("_is_wait"), F.when(F.col("_wait_ms").isNull() | (F.col("_wait_ms") > MAX_WAIT_MS), "wait_too_long"))
        .when(~F.col("_count_ok"), "byte_count")
        .when(~F.col("_hex_ok"), "bad_byte")
        .when(setter_used, "setter_as_query")
        .when(bad_query, "bad_query"))
    hint_code = F.when(setter_used, F.col("_getter")).when(bad_query, F.col("_code"))
    hint = F.when(hint_code.isNotNull(), F.concat(
        F.lit("?55 AA 01 "), _hex2(hint_code), F.lit(" "), _hex2(hint_code)))
    return rows.select(*by, "line", F.col("_is_wait").alias("is_wait"), "_wait_ms", fault.alias("fault"), hint.alias("hint"))


def lint_scripts(packs: DataFrame, by: Sequence[str] = ("pack_id",)) -> DataFrame:
    """Verdict per command pack: the first bad line with its fault, or ``no_command``.
    ``packs`` has a ``content`` text."""
    # The packs themselves come along as rows, so that nothing with a row per pack is joined.
    lines = script_lines(packs, by, keep_packs=True).withColumn("fault", F.when(F.col("line") > 0, F.col("fault")))
    command = F.when(F.col("is_wait") | (F.col("line") == 0), 0).otherwise(1)
    totals = ordered.running_sum(
        lines, by, ["line"], {"_waited": F.coalesce("_wait_ms", F.lit(0)).cast("bigint"), "_commands": command},
        ordered.point_slice("line"), joined=False)
    over = F.when(F.col("is_wait") & (F.col("_waited") > MAX_TOTAL_WAIT_MS), "wait_too_long").when(
        ~F.col("is_wait") & (F.col("_commands") > MAX_COMMANDS), "too_many_commands")
    judged = totals.withColumn("fault", F.coalesce("fault", over))
    summary = judged.groupBy(*by).agg(
        F.sum(command).alias("commands"),
        F.sum(F.coalesce("_wait_ms", F.lit(0))).cast("bigint").alias("total_wait_ms"),
        F.min_by(F.struct("line", "fault", "hint"), F.when(F.col("fault").isNotNull(), F.col("line"))).alias("_f"))
    count = F.col("commands").cast("bigint")
    first = F.when(F.col("_f.fault").isNotNull(), F.col("_f"))
    return summary.select(
        *by, count.alias("commands"), F.coalesce("total_wait_ms", F.lit(0)).cast("bigint").alias("total_wait_ms"),
        first["line"].alias("bad_line"),
        F.coalesce(first["fault"], F.when(count == 0, "no_command")).alias("fault"), first["hint"].alias("hint"))
