"""Station files: image manifests, frame audits, logs, command packs, INI settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.functions import text
from cloudgauge.operators import ordered
from cloudgauge.operators.fleet import IMAGE_PATTERN, key_logs, rank_paths
from cloudgauge.sources.text_clouds import lines_of

# Columns of the frame audit, log record format.
AUDIT_COLUMNS = [
    "index", "left_frame_number", "right_frame_number", "left_trigger_count", "right_trigger_count",
    "left_host_timestamp", "right_host_timestamp",
]
LOG_PATTERN = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\] \[([^\]]*)\] \[([^\]]*)\] (.*)$"
LOG_TIME = "yyyy-MM-dd HH:mm:ss.SSS"

PACKS = T.StructType([T.StructField("packs", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])))])


def image_manifest(spark: SparkSession, folder: str, begin: int = -1, end: int = -1) -> DataFrame:
    """Image files below a folder, ranked by path; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "length", "modificationTime"))
    images = files.filter(F.col("path").rlike(IMAGE_PATTERN)).withColumn("folder", F.lit(folder))
    ranked = rank_paths(images, ["folder"])
    if begin == -1 and end == -1:
        return ranked
    return ranked.filter(F.col("rank").between(max(0, begin), end))


def read_frame_audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pair rows of audit files; the heading and the free text at the end are skipped."""
    lines = lines_of(spark, path)
    rows = lines.filter(F.col("value").rlike(r"^\d+\t")).withColumn("_c", F.split("value", "\t"))
    rows = rows.filter(F.size("_c") == len(AUDIT_COLUMNS))
    return rows.select("file", *[F.col("_c")[i].cast("bigint").alias(c) for i, c in enumerate(AUDIT_COLUMNS)])


def write_frame_audit(df: DataFrame, path: str) -> None:
    df.select(*AUDIT_COLUMNS).write.csv(path, sep="\t", header=True)


def parse_log_line(line: Column) -> list[Column]:
    parts = [F.regexp_extract(line, LOG_PATTERN, i) for i in range(1, 5)]
    return [
        F.try_to_timestamp(parts[0], F.lit(LOG_TIME)).alias("ts"), parts[1].alias("level"),
        text.unescape_line(parts[2]).alias("module"), text.unescape_line(parts[3]).alias("text")]


def log_line(ts: str = "ts") -> Column:
    return F.concat(
        F.lit("["), F.date_format(ts, LOG_TIME), F.lit("] ["), F.col("level"), F.lit("] ["),
        text.escape_line(F.col("module")), F.lit("] "), text.escape_line(F.col("text")))


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log records ``(file, ts, level, module, text)``; other lines are skipped."""
    lines = lines_of(spark, path).filter(F.col("value").rlike(LOG_PATTERN))
    return lines.select("file", *parse_log_line(F.col("value")))


def write_logs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Log records as text lines; Debug is never written."""
    key_logs(df).select(log_line().alias("value")).write.mode(mode).text(path)


def read_command_packs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Packs of JSON files, in their order; unknown fields do not matter."""
    files = spark.read.schema(PACKS).json(path, multiLine=True)
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode("packs").alias("position", "_p")).select(
        "file", "position", "_p.name", "_p.content")


def read_station_config(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(settings, errors)`` of INI files. A line without ``=`` (or with it first) and a
    repeated key each make their whole file invalid."""
    lines = lines_of(spark, path, "*.ini")
    clean = F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"^\s+|\s+$", ""))
    rows = lines.withColumn("_l", clean)
    rows = ordered.row_number(rows, ["file"], ["block", "seq"], "line_no", F.col("block"))
    rows = rows.filter((F.col("_l") != "") & ~F.col("_l").rlike("^[;#]"))
    header = F.col("_l").rlike(r"^\[.*\]$")
    rows = ordered.latest(
        rows, ["file"], ["line_no"], F.when(header, F.trim(F.regexp_extract("_l", r"^\[(.*)\]$", 1))), "section",
        ordered.point_slice("line_no"))
    entries = rows.filter(~header).withColumn("_at", F.instr("_l", "="))
    bad = entries.filter("_at <= 1").select("file", F.col("line_no").cast("bigint").alias("line_no"),
                                            F.lit("not key=value").alias("reason"))
    key = F.trim(F.expr("substring(_l, 1, _at - 1)"))
    section = F.coalesce("section", F.lit(""))
    kv = entries.filter("_at > 1").select(
        "file", section.alias("section"), F.when(section == "", key).otherwise(F.concat(section, F.lit("/"), key)).alias("key"),
        F.trim(F.expr("substring(_l, _at + 1)")).alias("value"), F.col("line_no").cast("int").alias("line_no"))
    repeated = kv.groupBy("file", "key").agg(F.count(F.lit(1)).alias("_n"), F.max("line_no").alias("line_no")).filter(
        "_n > 1").select("file", F.col("line_no").cast("bigint").alias("line_no"), F.lit("repeated key").alias("reason"))
    errors = bad.unionByName(repeated)
    return kv.join(errors.select("file").distinct(), "file", "left_anti"), errors
