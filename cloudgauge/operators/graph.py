"""Connected components of undirected edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.session import cut_lineage, release


def connected_components(
    vertices: DataFrame, edges: DataFrame, by: Sequence[str] = (), vertex: str = "id"
) -> DataFrame:
    """``(by, vertex, label)`` with the smallest vertex id of the component as label.

    Each round joins the remaining edges with the labels of their ends (vertices have few
    edges, so no key is hot), lets every label hook onto the smallest neighbouring label
    through a map-side combined ``min``, shortens the hook chains, and relabels. A giant
    component makes its label hot on one side of a join, which adaptive execution splits. Edges inside a
    component drop out; the labels that remain at least halve per round.
    """
    keys = list(by)
    labels = cut_lineage(vertices.select(*keys, vertex).distinct().withColumn("label", F.col(vertex)))
    open_edges = edges.select(*keys, "src", "dst").filter("src <> dst")
    before = None
    while True:
        def end(name: str) -> DataFrame:
            return labels.select(*keys, F.col(vertex).alias(name), F.col("label").alias(f"_{name}"))

        joined = open_edges.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"])
        crossing = cut_lineage(joined.filter("_src <> _dst").select(*keys, "src", "dst", "_src", "_dst"))
        if before is not None:
            release(before)
        if crossing.isEmpty():
            release(crossing)
            return labels
        both = crossing.select(*keys, F.greatest("_src", "_dst").alias("_hi"), F.least("_src", "_dst").alias("_lo"))
        hooks = both.groupBy(*keys, F.col("_hi").alias("label")).agg(F.min("_lo").alias("_to"))
        direct = hooks = cut_lineage(hooks)
        for _ in range(3):
            onward = hooks.select(*keys, F.col("label").alias("_to"), F.col("_to").alias("_next"))
            hooks = hooks.join(onward, [*keys, "_to"], "left").select(
                *keys, "label", F.coalesce("_next", "_to").alias("_to"))
        moved = labels.join(hooks, [*keys, "label"], "left")
        relabelled = cut_lineage(moved.select(*keys, vertex, F.coalesce("_to", "label").alias("label")))
        release(labels, direct)
        labels, before = relabelled, crossing
        open_edges = crossing.select(*keys, "src", "dst")


def components_of(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Components when every vertex has an edge."""
    keys = list(by)
    ends = edges.select(*keys, F.col("src").alias("id")).unionByName(edges.select(*keys, F.col("dst").alias("id")))
    return connected_components(ends, edges, keys)


