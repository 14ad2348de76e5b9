"""Ordered operators that do not put a whole group into one task.

A plain window over ``partitionBy(group)`` sends every row of a hot group to one task.
Here a group is cut into *slices*: ranges of the ordering. The window runs inside a
slice, and what crosses a slice border (how many rows came before, what the last row
was) travels in a table with one row per slice.

``slice_by`` is a Column that never decreases along the ordering and holds a bounded number
of rows, such as ``point_id div 2**20`` of a dense id. Where no such column exists (path
strings, times), pass ``None``: the rows are then range-partitioned by the sampled ordering
and written, so that slices follow the row counts and both passes see the same ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.session import cut_lineage, join_on

POINT_SLICE = 1 << 20


def point_slice(name: str = "point_id") -> Column:
    """Slice of a dense id: a million neighbours in id order."""
    return F.floor(F.col(name) / F.lit(POINT_SLICE)).cast("bigint")


def with_slice(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_by: Column | None) -> DataFrame:
    if slice_by is not None:
        return df.withColumn("_slice", slice_by)
    return ranges(df, by, order, "_slice")


def ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_range") -> DataFrame:
    """Written rows with ``out``, their range of the ordering; ranges hold about equally many rows. Operators over the
    same ordering share it as ``slice_by=F.col(out)``."""
    return cut_lineage(df.repartitionByRange(*by, *order).withColumn(out, F.spark_partition_id()))


def row_number(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, slice_by: Column | None = None
) -> DataFrame:
    """1-based position inside the group."""
    sliced = with_slice(df, by, order, slice_by)
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = sliced.withColumn("_rank", F.row_number().over(inside))
    return (
        join_on(ranked, offsets, [*by, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_rank"))
        .drop("_offset", "_rank", "_slice")
    )


def previous(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    slice_by: Column | None = None,
) -> DataFrame:
    """Values of the row before, as ``{new name: source column}``; NULL on the first row."""
    sliced = with_slice(df, by, order, slice_by)
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    across = Window.partitionBy(*by).orderBy("_slice")
    packed = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
    carried = (
        sliced.groupBy(*by, "_slice")
        .agg(F.max_by(packed, F.struct(*order)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .drop("_last")
    )
    shifted = sliced.withColumn("_before", F.lag(packed).over(inside))
    joined = join_on(shifted, carried, [*by, "_slice"])
    chosen = F.coalesce(F.col("_before"), F.col("_carried"))
    for name in columns:
        joined = joined.withColumn(name, chosen[name])
    return joined.drop("_before", "_carried", "_slice")


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    slice_by: Column | None = None,
    joined: bool = True,
) -> DataFrame:
    """Running totals including the row itself, as ``{new name: value}``.

    Without ``joined`` a slice's start comes as a row of its own before the others and not by a join: better for many small
    groups, whose slices are about as many as their rows and too many for a broadcast."""
    prepared = df
    for name, value in sums.items():
        prepared = prepared.withColumn(f"_v_{name}", value)
    sliced = with_slice(prepared, by, order, slice_by)
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    for name in sums:
        totals = totals.withColumn(f"_o_{name}", F.sum(f"_t_{name}").over(before))
    totals = totals.drop(*[f"_t_{n}" for n in sums])
    if not joined:
        starts = totals.select(*by, "_slice", *[F.coalesce(f"_o_{n}", F.lit(0)).alias(f"_v_{n}") for n in sums], F.lit(0).alias("_own"))
        both = sliced.withColumn("_own", F.lit(1)).unionByName(starts, allowMissingColumns=True)
        upto = Window.partitionBy(*by, "_slice").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumns({name: F.coalesce(F.sum(f"_v_{name}").over(upto), F.lit(0)) for name in sums})
        return both.filter("_own = 1").drop("_own", "_slice", *[f"_v_{name}" for name in sums])
    for name in sums:
        sliced = sliced.withColumn(f"_i_{name}", F.sum(f"_v_{name}").over(inside))
    joined = join_on(sliced, totals, [*by, "_slice"])
    for name in sums:
        joined = joined.withColumn(
            name, F.coalesce(F.col(f"_o_{name}"), F.lit(0)) + F.coalesce(F.col(f"_i_{name}"), F.lit(0))
        )
    helpers = [f"{p}{n}" for n in sums for p in ("_v_", "_i_", "_o_")]
    return joined.drop("_slice", *helpers)


def following(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, slice_by: Column | None = None
) -> DataFrame:
    """The next non-NULL ``value`` among the later rows of the group: a forward as-of join
    of a group with itself. A descending scan carries the value, so each row is visited once; a frame to
    the group's end would be evaluated anew for every row."""
    sliced = with_slice(df.withColumn("_value", value), by, order, slice_by)
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_slice").orderBy(*[F.desc(c) for c in order]).rowsBetween(*earlier)
    across = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(*earlier)
    heads = (
        sliced.groupBy(*by, "_slice")
        .agg(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_head"))
        .withColumn("_later", F.last("_head", ignorenulls=True).over(across))
        .drop("_head")
    )
    near = sliced.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    return (
        join_on(near, heads, [*by, "_slice"])
        .withColumn(out, F.coalesce("_near", "_later"))
        .drop("_value", "_near", "_later", "_slice")
    )


def latest(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, slice_by: Column | None = None
) -> DataFrame:
    """The last non-NULL ``value`` up to and including the row: a forward fill."""
    sliced = with_slice(df.withColumn("_value", value), by, order, slice_by)
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    across = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tails = (
        sliced.groupBy(*by, "_slice")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail"))
        .withColumn("_earlier", F.last("_tail", ignorenulls=True).over(across))
        .drop("_tail")
    )
    near = sliced.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    return (
        join_on(near, tails, [*by, "_slice"])
        .withColumn(out, F.coalesce("_near", "_earlier"))
        .drop("_value", "_near", "_earlier", "_slice")
    )
