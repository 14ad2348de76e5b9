"""Corpora of text point clouds: XYZ lists, ASCII PCD and ASCII PLY.

Lines keep their place through the split of their file (``file_block_start``) and their
place in the split, so positions inside a file are found without reading a file in one
task. An ASCII PCD or PLY file of a few megabytes is one row instead, so its records need no shuffle.
Bad lines and files are data: ``strict`` mode raises on them, ``permissive`` mode returns them as a second table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudgauge.functions.text import last_part
from cloudgauge.functions.vec import finite
from cloudgauge.operators import ordered
from cloudgauge.session import cut_lineage

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(nan|inf|infinity)$"
POINT_COLUMNS = ["cloud_id", "point_id", "x", "y", "z"]
#: Largest PCD or PLY file that is read as one row; the lines of larger ones are spread over tasks.
WHOLE_BYTES = 4 << 20


def lines_of(spark: SparkSession, path: str | list[str], glob: str | None = None, above: int = 0) -> DataFrame:
    """Text lines as ``(file, block, seq, value)`` and the partition columns of the path, of files of more than ``above`` bytes."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path)
    if above:
        lines = lines.filter(F.col("_metadata.file_size") > above)
    return lines.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))


def number(token: Column) -> Column:
    """A number's value; NULL for any other text. ``nan`` and ``inf`` are numbers."""
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def cloud_name(lines: DataFrame) -> Column:
    """The ``cloud_id`` directory of the file, or its name without the ending."""
    if "cloud_id" in lines.columns:
        return F.col("cloud_id").cast("string")
    return F.regexp_replace(last_part(F.col("file")), r"\.[^.]*$", "")


def _place() -> Column:
    return F.struct("file", "block")


def number_points(rows: DataFrame) -> DataFrame:
    ranked = ordered.row_number(rows, ["cloud_id"], ["file", "block", "seq"], "_at", _place())
    return ranked.withColumn("point_id", F.col("_at") - 1).select(*POINT_COLUMNS)


def _finish(points: DataFrame, rejects: DataFrame, mode: str) -> DataFrame | tuple[DataFrame, DataFrame]:
    if mode == "permissive":
        return points, rejects
    if mode != "strict":
        raise ValueError("mode must be strict or permissive")
    fault = F.raise_error(F.concat_ws(": ", "reason", "file", F.coalesce("value", F.lit(""))))
    stop = rejects.select(
        F.col("cloud_id"), fault.cast("bigint").alias("point_id"),
        *[F.lit(None).cast("double").alias(a) for a in "xyz"])
    return points.unionByName(stop)


def read_xyz_text(
    spark: SparkSession, path: str | list[str], mode: str = "strict", glob: str | None = "*.{txt,xyz,asc}"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Points of XYZ text files. ``#`` starts a comment, commas count as blanks, the first
    three numbers are the coordinates, blank lines are skipped, non-finite points dropped.
    Faults are lines without three numbers and files without a valid point."""
    lines = lines_of(spark, path, glob)
    lines = lines.withColumn("cloud_id", cloud_name(lines))
    cut = F.replace(F.substring_index("value", "#", 1), F.lit(","), F.lit(" "))
    rows = lines.withColumn("_t", tokens_of(cut))
    rows = rows.withColumns({a: number(F.try_element_at("_t", F.lit(i + 1))) for i, a in enumerate("xyz")})
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    good = rows.filter(whole & finite("x", "y", "z"))
    points = number_points(good.select("cloud_id", "file", "block", "seq", "x", "y", "z"))
    bad = rows.filter((F.size("_t") > 0) & ~whole).select(
        "cloud_id", "file", "value", F.lit("invalid point data").alias("reason"))
    empty = rows.groupBy("cloud_id", "file").agg(
        F.sum(F.when(whole & finite("x", "y", "z"), 1).otherwise(0)).alias("_n")).filter("_n = 0")
    empty = empty.select("cloud_id", "file", F.lit(None).cast("string").alias("value"),
                         F.lit("no valid points").alias("reason"))
    return _finish(points, bad.unionByName(empty), mode)


# -- ASCII PCD and PLY ---------------------------------------------------------------


def _words_after(lines: Column, key: str) -> Column:
    """Words after ``key`` on the last header line that starts with it."""
    hits = F.filter(lines, lambda t: F.upper(F.try_element_at(t, F.lit(1))) == key)
    last = F.try_element_at(hits, F.lit(-1))
    return F.slice(last, F.lit(2), F.greatest(F.size(last), F.lit(0)))


def _is_ply() -> Column:
    return F.lower("file").endswith(".ply")


def _ends_header(clean: Column) -> Column:
    return F.when(_is_ply(), clean == "end_header").otherwise(F.upper(clean).rlike(r"^DATA(\s|$)"))


def _in_header(clean: Column) -> Column:
    return _is_ply() | ~clean.startswith("#")


def _is_record(line: Column) -> Column:
    """PCD data may hold blank lines and comments."""
    return (F.col("dialect") == "ply") | ~line.rlike(r"^\s*(#|$)")


def _headers(lines: DataFrame) -> DataFrame:
    """One row per file with a header: its layout and the place of its last header line."""
    first = lines.filter("block = 0").withColumn("_clean", F.trim("value"))
    end = first.groupBy("file").agg(F.min(F.when(_ends_header(F.col("_clean")), F.col("seq"))).alias("_end"))
    head = first.join(end, "file").filter(F.col("seq") <= F.col("_end")).filter(_in_header(F.col("_clean")))
    packed = head.groupBy("file").agg(
        F.first("_end").alias("_end"), F.array_sort(F.collect_list(F.struct("seq", tokens_of(F.col("_clean")).alias("w")))).alias("_l"))
    return _layouts(packed.withColumn("_l", F.transform("_l", lambda s: s["w"])))


def _layouts(packed: DataFrame) -> DataFrame:
    """Dialect, record count, value count, indexes of x, y, z and fault of files whose header lines are the words ``_l``."""
    h = F.col("_l")
    names = F.coalesce(_words_after(h, "FIELDS"), _words_after(h, "FIELD"))
    counts = F.coalesce(
        F.transform(_words_after(h, "COUNT"), lambda c: c.try_cast("int")), F.transform(names, lambda _: F.lit(1)))

    def one(key: str) -> Column:
        return F.try_element_at(_words_after(h, key), F.lit(1))

    points = F.coalesce(one("POINTS").try_cast("bigint"), F.lit(0))
    pcd = F.struct(
        F.transform(names, lambda n: F.lower(n)).alias("names"), counts.alias("counts"),
        F.when(points == 0, one("WIDTH").try_cast("bigint") * one("HEIGHT").try_cast("bigint")).otherwise(
            points).alias("records"),
        F.lower(one("DATA")).alias("encoding"), F.lit("pcd").alias("dialect"),
        F.size(_words_after(h, "SIZE")).alias("_s"), F.size(_words_after(h, "TYPE")).alias("_ty"))
    # Properties belong to the element line above them; only those of ``vertex`` count.
    folded = F.aggregate(
        h,
        F.struct(F.lit(False).alias("on"), F.lit(0).cast("bigint").alias("n"),
                 F.array().cast("array<string>").alias("names"), F.lit(None).cast("string").alias("enc"),
                 F.lit(False).alias("bad")),
        lambda s, w: F.when(
            F.get(w, 0) == "element",
            F.struct((F.get(w, 1) == "vertex").alias("on"),
                     F.when(F.get(w, 1) == "vertex", F.get(w, 2).try_cast("bigint")).otherwise(s["n"]).alias("n"),
                     s["names"].alias("names"), s["enc"].alias("enc"),
                     (s["bad"] | ((F.get(w, 1) != "vertex") & (s["n"] == 0) & (F.get(w, 2).try_cast("bigint") > 0))
                      ).alias("bad")),
        ).when(
            (F.get(w, 0) == "property") & s["on"],
            F.struct(s["on"].alias("on"), s["n"].alias("n"),
                     F.concat(s["names"], F.array(F.get(w, 2))).alias("names"), s["enc"].alias("enc"),
                     (s["bad"] | (F.get(w, 1) == "list")).alias("bad")),
        ).when(
            F.get(w, 0) == "format",
            F.struct(s["on"].alias("on"), s["n"].alias("n"), s["names"].alias("names"), F.get(w, 1).alias("enc"),
                     s["bad"].alias("bad")),
        ).otherwise(s))
    ply = F.struct(
        F.col("_f.names").alias("names"), F.transform("_f.names", lambda _: F.lit(1)).alias("counts"),
        F.col("_f.n").alias("records"), F.when(F.col("_f.bad"), "unsupported").otherwise(F.col("_f.enc")).alias("encoding"),
        F.lit("ply").alias("dialect"), F.size("_f.names").alias("_s"), F.size("_f.names").alias("_ty"))
    kept = [c for c in packed.columns if c != "_l"]
    folds = packed.withColumn("_f", F.when(_is_ply(), folded))
    both = folds.withColumn("_h", F.when(_is_ply(), ply).otherwise(pcd)).select(*kept, "_h.*")
    at = {a: F.array_position("names", a) for a in "xyz"}

    def offset(position: Column) -> Column:
        before = F.slice("counts", 1, F.greatest(F.lit(0), (position - 1).cast("int")))
        return F.aggregate(before, F.lit(0), lambda acc, c: acc + c)

    scalar = F.lit(True)
    for a in "xyz":
        scalar = scalar & (at[a] > 0) & (F.try_element_at("counts", at[a].cast("int")) == 1)
    fault = (
        F.when(F.col("names").isNull() | (F.size("names") != F.size("counts")) | (F.size("names") != F.col("_s"))
               | (F.size("names") != F.col("_ty")), "incomplete header")
        .when(F.col("encoding").isNull() | (F.col("encoding") != "ascii"), "unsupported encoding")
        .when(F.col("records").isNull() | (F.col("records") < 0) | (
            (F.col("dialect") == "pcd") & (F.col("records") == 0)), "invalid point count")
        .when(~F.coalesce(scalar, F.lit(False)), "missing scalar x, y, z"))
    return both.select(
        *kept, "dialect", "records", fault.alias("fault"),
        F.aggregate("counts", F.lit(0), lambda acc, c: acc + c).alias("width"),
        *[offset(at[a]).alias(f"_i{a}") for a in "xyz"])


def _record(line: Column, words: Column, numbers: Column) -> Column:
    """A record's text, coordinates and whether it is whole."""
    sized = F.when(F.col("dialect") == "pcd", F.size(words) == F.col("width")).otherwise(F.size(words) >= F.col("width"))
    return F.struct(
        line.alias("value"), (sized & F.forall(numbers, lambda v: v.isNotNull())).alias("whole"),
        *[F.try_element_at(numbers, F.col(f"_i{a}") + 1).alias(a) for a in "xyz"])


def _numbers(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.lit(1), F.col("width"))), number)


def _good(record: Column) -> Column:
    return record["whole"] & finite(*[record[a] for a in "xyz"])


def _short(records: Column, seen: Column, good: Column) -> Column:
    """Fault of a file by its number of records and of points."""
    return F.when(seen < records, "file ended before all points were read").when(good == 0, "no valid points")


#: A row is a point with its place among those of its file, or a fault.
ROW = ["cloud_id", "file", "at", "x", "y", "z", "value", "reason"]
ROW_SCHEMA = "cloud_id string, file string, at bigint, x double, y double, z double, value string, reason string"


def _row(at: Column | None = None, record: Column | None = None, value: Column | None = None, reason: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if at is None else at).cast("bigint").alias("at"),
        *[(none.cast("double") if record is None else record[a]).alias(a) for a in "xyz"],
        (none if value is None else value).cast("string").alias("value"),
        (none if reason is None else reason).cast("string").alias("reason"))


def _value(token: bytes) -> float | None:
    """The value of a number's text as ``number`` gives it."""
    if b"_" in token or token[1:].lower() == b"nan" and token[1:] != b"NaN":
        return None
    try:
        return float(token)
    except ValueError:
        return None


def _parse(lines: list[bytes], words: list[list[bytes]], is_pcd: bool, width: int, at: list[int]) -> tuple[np.ndarray, list[bytes]]:
    """Coordinates of the whole records, and the lines of the others."""
    good, bad = [], []
    for line, tokens in zip(lines, words):
        values = [_value(t) for t in tokens[:max(1, width)]]
        sized = len(tokens) == width if is_pcd else len(tokens) >= width
        if sized and None not in values:
            good.append([values[i] if 0 <= i < len(values) else np.nan for i in at])
        else:
            bad.append(line)
    return np.array(good, dtype="f8").reshape(-1, 3), bad


def _parse_body(body: bytes, is_pcd: bool, records: int, width: int, at: list[int]) -> tuple[np.ndarray, list[bytes], int]:
    """Coordinates of the whole records, the lines of the others and how many records there are. ``body`` starts with
    the end of the last header line."""
    lines = (re.split(rb"\r\n|\n|\r", body) if b"\r" in body else body.split(b"\n"))[1:]
    if lines and not lines[-1]:
        lines.pop()
    if is_pcd:
        lines = [t for t in lines if not re.match(rb"\s*(#|$)", t)]
    lines = lines[:records]
    words = [t.split() for t in lines]
    if width > 0 and b"_" not in body and all(len(w) == width for w in words):
        try:
            flat = np.array([float(t) for w in words for t in w], dtype="f8").reshape(-1, width)
        except ValueError:
            flat = None
        if flat is not None and not np.isnan(flat).any() and min(at) >= 0 and max(at) < width:
            return flat[:, at], [], len(lines)
    return *_parse(lines, words, is_pcd, width, at), len(lines)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole files whose layouts are known."""
    for batch in batches:
        for i in range(batch.num_rows):
            file = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            points, bad, reasons = np.empty((0, 3)), [], [file["fault"]]
            if file["fault"] is None:
                body = file["text"][file["_end"]:].encode()
                points, bad, seen = _parse_body(
                    body, file["dialect"] == "pcd", file["records"], file["width"], [file[f"_i{a}"] for a in "xyz"])
                points = points[np.isfinite(points).all(axis=1)]
                reasons = ["file ended before all points were read" if seen < file["records"] else
                           None if len(points) else "no valid points"]
            reasons = ["invalid record"] * len(bad) + [r for r in reasons if r]
            n, faults = len(points), len(reasons)
            values = [t.decode("utf-8", "replace") for t in bad]
            yield pa.RecordBatch.from_arrays([
                pa.array([file["cloud_id"]] * (n + faults), pa.string()), pa.array([file["file"]] * (n + faults), pa.string()),
                pa.array(list(range(n)) + [None] * faults, pa.int64()),
                *[pa.concat_arrays([pa.array(points[:, k]), pa.nulls(faults, pa.float64())]) for k in range(3)],
                pa.array([None] * n + values + [None] * (faults - len(values)), pa.string()),
                pa.array([None] * n + reasons, pa.string())], names=ROW)


def _rows_of_whole_files(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    """Rows of files of at most ``WHOLE_BYTES``. Spark reads the headers; a read task holds a split of files."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=glob).filter(F.col("_metadata.file_size") <= WHOLE_BYTES)
    texts = texts.withColumn("file", F.col("_metadata.file_path"))
    # As in a read by lines, a byte order mark is no text.
    files = texts.select(cloud_name(texts).alias("cloud_id"), "file", F.regexp_replace("value", "^\ufeff", "").alias("text"))
    # All up to the first line that ends a header, as ``_ends_header`` tells it.
    ply = F.regexp_extract("text", r"(?s)\A(.*?(?:\A|[\r\n]) *end_header *)(?=[\r\n]|\z)", 1)
    pcd = F.regexp_extract("text", r"(?s)\A(.*?(?:\A|[\r\n]) *(?i:DATA)(?!\S)[^\r\n]*)", 1)
    files = files.withColumn("_head", F.when(_is_ply(), ply).otherwise(pcd)).withColumn("_end", F.length("_head"))
    clean = F.transform(F.split("_head", "\r\n|\n|\r"), lambda t: F.trim(t))
    files = _layouts(files.withColumn("_l", F.transform(F.filter(clean, _in_header), tokens_of)).drop("_head"))
    files = files.withColumn("fault", F.when(F.col("_end") == 0, "incomplete header").otherwise(F.col("fault")))
    files = files.withColumn("text", F.when(F.col("fault").isNull(), F.col("text")))
    return files.mapInArrow(_parse_files, ROW_SCHEMA)


def _rows_of_lines(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    """Rows of larger files."""
    lines = lines_of(spark, path, glob, WHOLE_BYTES)
    lines = cut_lineage(lines.select(cloud_name(lines).alias("cloud_id"), "file", "block", "seq", "value"))
    heads = cut_lineage(_headers(lines))
    names = lines.select("cloud_id", "file").distinct()
    listed = names.join(heads, "file", "left").withColumn(
        "fault", F.when(F.col("_end").isNull(), "incomplete header").otherwise(F.col("fault")))
    body = lines.join(heads.filter("fault IS NULL"), "file").filter(
        (F.col("block") > 0) | (F.col("seq") > F.col("_end"))).filter(_is_record(F.col("value")))
    body = ordered.row_number(body, ["file"], ["block", "seq"], "_nth", F.col("block"))
    body = body.filter(F.col("_nth") <= F.col("records")).withColumn("_t", tokens_of(F.col("value")))
    body = body.withColumn("_v", _numbers(F.col("_t"))).withColumn("_r", _record(F.col("value"), F.col("_t"), F.col("_v")))
    body = cut_lineage(body.select("cloud_id", "file", "block", "seq", "_r", _good(F.col("_r")).alias("_good")))
    good = ordered.row_number(body.filter("_good"), ["file"], ["block", "seq"], "_at", F.col("block"))
    counts = body.groupBy("file").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_good").alias("_points"))
    told = listed.join(counts, "file", "left").na.fill(0, ["_n", "_points"])
    told = told.withColumn("reason", F.coalesce("fault", _short(F.col("records"), F.col("_n"), F.col("_points"))))
    rows = [(good, _row(F.col("_at") - 1, F.col("_r"))),
            (body.filter("NOT _r.whole"), _row(value=F.col("_r.value"), reason=F.lit("invalid record"))),
            (told.filter("reason IS NOT NULL"), _row(reason=F.col("reason")))]
    first, second, third = [part.withColumn("_row", row).select("cloud_id", "file", "_row.*") for part, row in rows]
    return first.unionByName(second).unionByName(third).select(*ROW)


def read_ascii_cloud(
    spark: SparkSession, path: str | list[str], mode: str = "strict", glob: str | None = "*.{pcd,ply}"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Points of ASCII PCD and PLY files, x, y, z found by name in the header. A PCD record
    has exactly the declared values, a PLY record at least those; surplus records are
    ignored, missing ones are a fault of the file."""
    # Many files are slow to open and their lines slow to parse, so both are done once.
    rows = cut_lineage(_rows_of_whole_files(spark, path, glob)).unionByName(cut_lineage(_rows_of_lines(spark, path, glob)))
    # The points of a cloud run on over its files; most clouds have one.
    sizes = rows.filter("reason IS NULL").groupBy("cloud_id", "file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("cloud_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.sum("_n").over(before)).filter("_start > 0")
    starts = cut_lineage(starts.select("cloud_id", "file", "_start"))
    points = rows.filter("reason IS NULL").join(starts, ["cloud_id", "file"], "left").withColumn(
        "point_id", F.col("at") + F.coalesce("_start", F.lit(0)))
    return _finish(points.select(*POINT_COLUMNS), rows.filter("reason IS NOT NULL").select("cloud_id", "file", "value", "reason"), mode)
