"""Ordered scans that never put a whole group into one task.

Rows are range-partitioned by (group, order) and written with the number of their range. A window runs inside a
(group, range); what crosses a border is one row per group and range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch

#: Rows of a group between two borders once its rows are numbered.
SLICE = 4096


def ranges(df: DataFrame, order: Sequence[str], scratch: Scratch, out: str = "_range") -> DataFrame:
    """Written rows with ``out``, the number of their range of the ordering; ranges hold about equally many rows."""
    return scratch.write(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()))


def numbered(df: DataFrame, by: str, order: Sequence[str], out: str, part: str = "_range") -> DataFrame:
    """``df`` (with ranges in ``part``) and ``out``, the place in the group from 1. ``by`` holds no nulls."""
    inside = Window.partitionBy(by, part).orderBy(*order)
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(by, part).agg(F.count("*").alias("_n")).select(
        by, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = df.withColumn("_place", F.row_number().over(inside))
    return placed.join(offsets, [by, part]).withColumn(out, F.col("_offset") + F.col("_place")).drop("_offset", "_place")


def running(df: DataFrame, by: str, place: str, sums: Mapping[str, Column], backwards: bool = False) -> DataFrame:
    """``df`` with running sums including the row itself, over ``place`` (a number from 0 or 1 without large gaps).

    ``backwards`` sums from the last place to the row.
    """
    sliced = df.withColumns({f"_v_{n}": v for n, v in sums.items()}).withColumn(
        "_slice", F.floor(F.col(place) / F.lit(SLICE)).cast("int"))
    turned = (lambda c: F.col(c).desc()) if backwards else F.col
    inside = Window.partitionBy(by, "_slice").orderBy(turned(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy(turned("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(by, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]).select(
        by, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    # Only groups of several slices need the totals before them.
    crossed = totals.filter(F.col("_slice") > 0) if not backwards else totals
    sliced = sliced.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    joined = sliced.join(crossed, [by, "_slice"], "left")
    out = joined.withColumns({n: F.coalesce(f"_o_{n}", F.lit(0)) + F.col(f"_i_{n}") for n in sums})
    return out.drop("_slice", *[f"{p}{n}" for n in sums for p in ("_v_", "_i_", "_o_")])


def latest(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, scratch: Scratch,
) -> DataFrame:
    """``df`` with ``out``, the last ``value`` that is not null among the rows of the group up to and including the row:
    an as-of search. Null groups are a group."""
    parts = ranges(df.withColumn("_value", value), [*by, *order], scratch)
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tails = parts.groupBy(*by, "_range").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail"))
    tails = tails.select("_range", *[F.col(b).alias(f"_by_{b}") for b in by],
                         F.last("_tail", ignorenulls=True).over(before).alias("_earlier"))
    near = parts.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    joined = near.join(tails.withColumnRenamed("_range", "_tail_range"), F.expr(" and ".join(
        ["_range = _tail_range", *[f"`{b}` <=> `_by_{b}`" for b in by]])))
    return joined.withColumn(out, F.coalesce("_near", "_earlier")).drop(
        "_value", "_near", "_earlier", "_range", "_tail_range", *[f"_by_{b}" for b in by])
