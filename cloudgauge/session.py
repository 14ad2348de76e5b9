"""Session helpers: local session for tests and benches, lineage cutting, small joins."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, name: str = "cloudgauge", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CLOUDGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session with nothing set gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="cloudgauge-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the checkpoint folder. It is deleted when the application ends."""
    folder = f"{checkpoint_folder(spark)}/run-{spark.sparkContext.applicationId}"
    files, location = _file_system(spark, folder)
    if not files.exists(location):
        files.mkdirs(location)
        files.deleteOnExit(location)
    return folder


def cut_lineage(df: DataFrame, row_group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the run's shared folder and read it back.

    Iterations then neither recompute earlier rounds nor lose them with an executor, and
    the planner sees the real size of the result, so only small ones are broadcast.
    ``release`` deletes a table that a loop has superseded. A reader holds the long values of a whole row group at once, so a
    table of such values has few ``row_group_rows``.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write if row_group_rows is None else df.write.option("parquet.block.row.count.limit", row_group_rows)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def own_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of the same application with the caller's settings and some others; the caller's stay as they are."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    for name, value in settings.items():
        session.conf.set(name.replace("__", "."), value)
    return session


def reread(spark: SparkSession, table: DataFrame) -> DataFrame:
    """The table behind a result of ``cut_lineage``, read by another session."""
    out = spark.read.schema(table.schema).parquet(table._written_path)
    out._written_path = table._written_path
    return out


def make_folder(spark: SparkSession, path: str) -> None:
    files, location = _file_system(spark, path)
    files.mkdirs(location)


def delete_path(spark: SparkSession, path: str) -> None:
    files, location = _file_system(spark, path)
    files.delete(location, True)


def below(spark: SparkSession, path: str, start: str) -> list[str]:
    """Paths in a folder whose names begin with ``start``."""
    files, location = _file_system(spark, path)
    if not files.exists(location):
        return []
    found = [status.getPath() for status in files.listStatus(location)]
    return [p.toString() for p in found if p.getName().startswith(start)]


def dated_in_order(spark: SparkSession, folders: Sequence[str]) -> bool:
    """Date the files of the folders one second apart, in order. False where the file system does not keep such dates."""
    first = int(time.time() - len(folders)) * 1000
    for i, folder in enumerate(folders):
        for path in below(spark, folder, "part-"):
            files, location = _file_system(spark, path)
            files.setTimes(location, first + 1000 * i, -1)
            if files.getFileStatus(location).getModificationTime() != first + 1000 * i:
                return False
    return True


def release(*frames: DataFrame) -> None:
    """Delete the tables behind results of ``cut_lineage`` that nothing reads any more."""
    for frame in frames:
        delete_path(frame.sparkSession, frame._written_path)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys; right key columns are dropped."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition: Column = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def salt_count(spark: SparkSession) -> int:
    """Salts per key: an eighth of the shuffle partitions, between 16 and 256. What is
    still too large for one task after salting, adaptive execution splits at run time."""
    return max(16, min(256, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Join whose left side may hold a hot key while ``right`` has one row per key.

    Left rows of one key are spread over the salts by the hash of ``spread``; the right
    rows are repeated once per salt. For right sides with a row per cloud, run or frame; one with a
    row per position, cell or vertex takes a plain join, whose skewed partitions adaptive execution splits.
    """
    salts = salts or salt_count(left.sparkSession)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a zone."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    return F.col(name).cast("bigint")
