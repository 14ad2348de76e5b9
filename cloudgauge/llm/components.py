"""Connected components of edge tables, without any hub or component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id``, ``root`` for every end of ``edges`` (src, dst), the root being the smallest id of its component.

    Alternating large-star and small-star rounds: each vertex links its larger (then its smaller)
    neighbours to the smallest one. Rounds are written to the shared folder; a hub's edges meet only in
    map-side combined minima and in joins that adaptive execution may split.
    """
    pairs = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
    pairs = scratch.write(pairs.distinct())
    mark = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.write(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            least.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct()
        small = scratch.write(small)
        scratch.drop(pairs, large)
        pairs = small
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(
                pairs.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
        mark = now
