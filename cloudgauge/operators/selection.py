"""Exact values of a given rank in any group, however large, by counting digits.

Each pass counts the values of every group by a digit: first sign and binary exponent, then 4096 equal parts of what is
left. The part that holds the rank is kept with its own smallest and largest value, until few enough values are left to
sort or all that are left are equal. A pass shuffles at most a row per group, digit and task; no buffer holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.session import cut_lineage, release, salted_join

PARTS = 4096
#: Values of a group that are sorted at last. Bounds memory only.
SORTED_VALUES = 50_000
#: Above every binary exponent of a double, so that digits of positive values are positive.
EXPONENTS = 1100


def exponent_digit(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: sign and binary exponent; NaN comes last."""
    size = (F.floor(F.log2(F.abs(v))) + EXPONENTS).cast("int")
    endless = F.lit(2 * EXPONENTS)
    return (
        F.when(F.isnan(v), endless + 1).when(F.abs(v) == float("inf"), F.when(v > 0, endless).otherwise(-endless))
        .when(v > 0, size).when(v < 0, -size).otherwise(0))


def part_digit(v: Column, low: Column, high: Column) -> Column:
    """Which of ``PARTS`` equal parts between ``low`` and ``high`` holds ``v``; each operation keeps the order."""
    width = high / 2 - low / 2  # the whole difference might overflow
    part = F.least(F.lit(PARTS - 1), F.floor((v / 2 - low / 2) / width * PARTS))
    return F.when(width > 0, part).otherwise(F.when(v > low, 1).otherwise(0)).cast("int")


def _hit(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The digit that holds ``_rank``, with what is left inside: ``_low``, ``_high``, ``_rank``, ``_inside``."""
    upto = Window.partitionBy(*by).orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_upto", F.sum("_count").over(upto))
    hit = run.filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_count") <= F.col("_rank")))
    return hit.select(
        *by, "_low", "_high", (F.col("_rank") - F.col("_upto") + F.col("_count")).alias("_rank"), F.col("_count").alias("_inside"))


def upper_medians(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """``by`` and ``out``: the element at position ``n div 2`` of each group's sorted values that are not null.

    NaN counts as the largest value. Groups without a value have no row. ``df`` is read once per pass, two or three
    times as a rule, so an expensive one should be a written table.
    """
    values = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    first = values.withColumn("_digit", exponent_digit(F.col("_v"))).groupBy(*by, "_digit").agg(
        F.count("*").alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    total = F.sum("_count").over(Window.partitionBy(*by))
    state = cut_lineage(_hit(first.withColumn("_rank", F.shiftright(total, 1)), by))
    while state.filter(f"_low <> _high and _inside > {SORTED_VALUES}").limit(1).count():
        wide = state.filter(f"_low <> _high and _inside > {SORTED_VALUES}")
        inside = salted_join(values, wide, by, spread=["_v"]).filter("_v between _low and _high")
        counts = inside.withColumn("_digit", part_digit(F.col("_v"), F.col("_low"), F.col("_high"))).groupBy(*by, "_digit").agg(
            F.count("*").alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_rank").alias("_rank"))
        rest = state.filter(f"not (_low <> _high and _inside > {SORTED_VALUES})")
        before, state = state, cut_lineage(rest.unionByName(_hit(counts, by)))
        release(before)
    few = state.filter("_low <> _high")
    kept = salted_join(values, few.select(*by, "_low", "_high", "_rank"), by, spread=["_v"]).filter("_v between _low and _high")
    found = kept.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_sorted"), F.first("_rank").alias("_rank"))
    found = found.select(*by, F.get("_sorted", F.col("_rank").cast("int")).alias(out))
    return state.filter("_low <=> _high").select(*by, F.col("_low").alias(out)).unionByName(found)
