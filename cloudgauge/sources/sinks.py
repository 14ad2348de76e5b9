"""Sinks: XYZ text, error tables, one cloud file per group, results without overwrite."""

from __future__ import annotations

import itertools
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.functions.text import last_part, session_key
from cloudgauge.operators import ordered
from cloudgauge.operators.cloud import filter_finite
from cloudgauge.operators.fleet import unique_names
from cloudgauge.session import cut_lineage

#: Formats by name, with the file ending of each.
FORMATS = {"ply": "ply", "ply_binary": "ply", "pcd": "pcd", "pcd_ascii": "pcd", "txt": "txt"}


def write_xyz_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``x y z`` lines below one directory per cloud, in point order inside each file.
    Numbers are the shortest text that reads back as the same double."""
    rows = df.withColumn("_slice", ordered.point_slice())
    rows = rows.repartition("cloud_id", "_slice").sortWithinPartitions("cloud_id", "_slice", "point_id")
    rows.select("cloud_id", F.concat_ws(" ", "x", "y", "z").alias("value")).write.mode(mode).partitionBy(
        "cloud_id").text(path)


def error_rows(df: DataFrame) -> DataFrame:
    return df.select(
        (F.col("point_id") + 1).alias("index"), F.col("x").alias("x_mm"), F.col("y").alias("y_mm"),
        F.col("z").alias("z_mm"), F.col("signed_error").alias("signed_error_mm"), "cloud_id")


def write_error_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-point errors with a 1-based index, one directory per cloud and one file per slice of a cloud in it."""
    rows = df.withColumn("_slice", ordered.point_slice())
    rows = rows.repartition("cloud_id", "_slice").sortWithinPartitions("cloud_id", "_slice", "point_id")
    error_rows(rows).write.mode(mode).partitionBy("cloud_id").csv(path, header=True)


# -- one file per cloud --------------------------------------------------------------


def _header(fmt: str, n: int) -> bytes:
    if fmt in ("ply", "ply_binary"):
        kind = "ascii" if fmt == "ply" else "binary_little_endian"
        return (f"ply\nformat {kind} 1.0\nelement vertex {n}\nproperty double x\nproperty double y\n"
                "property double z\nend_header\n").encode()
    if fmt in ("pcd", "pcd_ascii"):
        size, kind = ("4 4 4", "binary") if fmt == "pcd" else ("8 8 8", "ascii")
        return (f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE {size}\nTYPE F F F\n"
                f"COUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {kind}\n").encode()
    return b""


def _body(fmt: str, frame: pd.DataFrame) -> bytes:
    xyz = frame[["x", "y", "z"]].to_numpy()
    if fmt == "pcd":
        return xyz.astype("<f4").tobytes()
    if fmt == "ply_binary":
        return xyz.astype("<f8").tobytes()
    return ("%.17g %.17g %.17g\n" * len(xyz) % tuple(xyz.ravel().tolist())).encode()


def _part_writer(folder: str, fmt: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stream, count, temp = None, None, 0, ""
        done = []

        def close() -> None:
            stream.close()
            final = os.path.join(folder, f"{uuid.uuid5(uuid.NAMESPACE_OID, current[0]).hex}-{current[1]:012d}")
            os.replace(temp, final)
            done.append((current[0], current[1], count, final))

        for frame in batches:
            # Rows come sorted, so a part is a run of rows.
            clouds, parts = frame["cloud_id"].to_numpy(), frame["part"].to_numpy()
            changes = np.flatnonzero((clouds[1:] != clouds[:-1]) | (parts[1:] != parts[:-1])) + 1
            borders = [0, *changes.tolist(), len(frame)] if len(frame) else [0]
            for start, end in zip(borders, borders[1:]):
                key = (clouds[start], int(parts[start]))
                if key != current:
                    if current is not None:
                        close()
                    current, count = key, 0
                    temp = os.path.join(folder, f"attempt-{uuid.uuid4().hex}")
                    stream = open(temp, "wb")
                stream.write(_body(fmt, frame.iloc[start:end]))
                count += end - start
            if done:
                yield pd.DataFrame(done, columns=["cloud_id", "part", "n", "path"])
                done.clear()
        if current is not None:
            close()
            yield pd.DataFrame(done, columns=["cloud_id", "part", "n", "path"])

    return run


def _assemble(target: str, fmt: str):
    def write(cloud: str, n: int, paths: list[str]) -> str:
        final = os.path.join(target, f"{cloud}.{FORMATS[fmt]}")
        temp = os.path.join(target, f".{uuid.uuid4().hex}.tmp")
        try:
            with open(temp, "wb") as out:
                out.write(_header(fmt, n))
                for path in paths:
                    with open(path, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 24)
            os.replace(temp, final)
        except OSError:
            if os.path.exists(temp):
                os.unlink(temp)
            raise
        return final

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Parts come sorted by cloud and part; a cloud's parts may lie in several batches.
        rows = (row for frame in batches for row in frame.itertuples(index=False))
        done = []
        for cloud, group in itertools.groupby(rows, lambda row: row.cloud_id):
            parts = list(group)
            n = sum(int(row.n) for row in parts)
            done.append((cloud, n, write(cloud, n, [row.path for row in parts])))
            if len(done) == 1000:
                yield pd.DataFrame(done, columns=["cloud_id", "n", "path"])
                done = []
        if done:
            yield pd.DataFrame(done, columns=["cloud_id", "n", "path"])

    return run


def export_clouds(df: DataFrame, folder: str, fmt: str) -> DataFrame:
    """One file per cloud: ``ply`` (ASCII doubles, finite points), ``ply_binary`` (doubles, finite points), ``pcd``
    (binary, 32-bit, so digits are lost), ``pcd_ascii`` or ``txt``. Returns ``(cloud_id, n, path)``.

    Slices of a cloud are written in parallel as parts; a part list, not the rows, goes to
    the task that joins the parts. Files appear under their name only when complete. Rows without a cloud id belong to no file.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {tuple(FORMATS)}")
    os.makedirs(folder, exist_ok=True)
    staging = os.path.join(folder, f".parts-{uuid.uuid4().hex}")
    os.makedirs(staging)
    rows = filter_finite(df) if FORMATS[fmt] == "ply" else df
    rows = rows.filter("cloud_id IS NOT NULL").select("cloud_id", ordered.point_slice().alias("part"), "point_id", "x", "y", "z")
    rows = rows.repartition("cloud_id", "part").sortWithinPartitions("cloud_id", "part", "point_id")
    try:
        parts = cut_lineage(rows.mapInPandas(
            _part_writer(staging, fmt), "cloud_id string, part bigint, n bigint, path string"))
        # The list is small in bytes; a given number of partitions keeps its files from being joined by one task.
        dealt = parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cloud_id")
        return cut_lineage(dealt.sortWithinPartitions("cloud_id", "part").mapInPandas(
            _assemble(folder, fmt), "cloud_id string, n bigint, path string"))
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def publish_results(df: DataFrame, sessions: DataFrame, folder: str, catalog_path: str) -> DataFrame:
    """Write the points of each session as TXT and PCD under a free shared name and note
    the names in the catalog. ``df`` has ``session_path`` beside the point columns,
    ``sessions`` has ``session_path, created_ts``. Sessions without points publish nothing.
    """
    spark = df.sparkSession
    try:
        catalog = spark.read.schema("name string, session_path string, n bigint").parquet(catalog_path).select("name")
        catalog = cut_lineage(catalog)
    except Exception as error:  # noqa: BLE001 - only a missing table means "no names yet"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        catalog = spark.createDataFrame([], "name string")
    if os.path.isdir(folder) and any(os.scandir(folder)):
        present = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,pcd}").load(folder).select(
            F.regexp_replace(last_part(F.col("path")), r"\.[^.]*$", "").alias("name"))
        catalog = cut_lineage(catalog.unionByName(present).distinct())
    alive = sessions.join(df.select("session_path").distinct(), "session_path", "left_semi")
    base = F.concat(F.lit("point_cloud_"), session_key(F.col("session_path"), F.col("created_ts")))
    named = cut_lineage(unique_names(alive.withColumn("base", base), catalog, ["session_path"]).select(
        "session_path", "name"))
    rows = df.join(named, "session_path").select(
        F.col("name").alias("cloud_id"), "point_id", "x", "y", "z")
    written = []
    try:
        for fmt in ("txt", "pcd"):
            written.append(export_clouds(rows, folder, fmt))
    except Exception:
        for row in named.toLocalIterator():
            for fmt in ("txt", "pcd"):
                leftover = os.path.join(folder, f"{row['name']}.{fmt}")
                if os.path.exists(leftover):
                    os.unlink(leftover)
        raise
    done = written[0].select(F.col("cloud_id").alias("name"), "n").join(named, "name").select("name", "session_path", "n")
    done = cut_lineage(done)
    done.write.mode("append").parquet(catalog_path)
    return done


