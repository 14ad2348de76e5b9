"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cloudgauge.session import run_folder

#: Bytes of text that a Python function of this package holds at a time; one longer text is held alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one job in the shared folder of ``spark.checkpoint.dir``.

    ``write`` cuts the lineage, so a lost executor costs no earlier stage; ``drop`` deletes
    what later steps no longer read. The rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{run_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_field(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with the fields appended; fields of the same names are replaced."""
    names = {name for name, _ in fields}
    kept = [f for f in schema.fields if f.name not in names]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in fields])


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        if batch.column(column).nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def appended(batch: pa.RecordBatch, schema: T.StructType, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with columns added or replaced, in the order of ``schema``."""
    arrays = [columns[n] if n in columns else batch.column(n) for n in schema.names]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)

