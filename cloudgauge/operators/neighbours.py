"""Exact nearest neighbours and radius search without an all-pairs join.

Positions are cut into a tree of cells whose depth follows the local density: a cell is
split (halved on each axis) until it holds at most ``LEAF`` distinct positions. The search
walks pairs of cells from the roots down. A pair is dropped as soon as the gap between the
two boxes proves that it cannot matter, so a crowded region costs no more per point than a
sparse one. Copies of a position are one row with a count, however many there are.

A cloud of at most ``WHOLE`` points is no tree: its points meet once and are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.operators.cloud import filter_finite
from cloudgauge.operators.selection import upper_medians
from cloudgauge.session import cut_lineage, join_on, release, salted_join

LEAF = 32
MAX_LEVEL = 52
CHUNK = 4096
#: Points of a cloud that are compared without a tree, and rows of their distance table that one step holds.
WHOLE, BLOCK = 2048, 256

# Fixed values of the reference procedure.

BOX = ["lx", "ly", "lz", "hx", "hy", "hz"]


def positions(points: DataFrame, by: Sequence[str], keep_ids: int) -> DataFrame:
    """Distinct finite positions with their count ``m``, smallest id ``id`` and the
    ``keep_ids`` smallest ids. The rank filter limits copies before the shuffle."""
    keys = [*by, "x", "y", "z"]
    pts = filter_finite(points).select(*by, "point_id", *[(F.col(a) + F.lit(0.0)).alias(a) for a in "xyz"])
    counts = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("point_id").alias("id"))
    if keep_ids <= 1:
        return counts.withColumn("ids", F.array("id"))
    w = Window.partitionBy(*keys).orderBy("point_id")
    few = pts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep_ids)
    lists = few.groupBy(*keys).agg(F.array_sort(F.collect_list("point_id")).alias("ids"))
    return counts.join(lists, keys)


# -- clouds of few points ------------------------------------------------------------


def by_size(points: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Written finite points of the clouds of at most ``WHOLE`` points, and those of larger clouds (None without any)."""
    known = filter_finite(points).filter(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    pts = cut_lineage(known.withColumns({a: F.col(a) + F.lit(0.0) for a in "xyz"}))
    large = cut_lineage(pts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE).select(*by))
    if large.isEmpty():
        return pts, None
    return pts.join(large, list(by), "left_anti"), pts.join(large, list(by), "left_semi")


def _squares(xyz: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of ``BLOCK`` points to all, with the index of the first."""
    for at in range(0, len(xyz), BLOCK):
        total = 0.0
        for c in xyz.T:
            gap = c[at:at + BLOCK, None] - c[None, :]
            total = total + gap * gap
        yield at, total


def _nearest_others(squares: np.ndarray, at: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indexes of the ``k`` nearest others of each row, the smaller index first among equals."""
    gaps = np.sqrt(squares)
    own = np.arange(len(gaps))
    gaps[own, at + own] = np.inf
    limit = np.partition(gaps, k - 1, axis=1)[:, k - 1:k]
    row, col = np.nonzero(gaps <= limit)
    row, col = row[col != at + row], col[col != at + row]
    order = np.lexsort((col, gaps[row, col], row))
    row, col = row[order], col[order]
    counts = np.bincount(row, minlength=len(gaps))
    kept = np.arange(len(row)) - (np.cumsum(counts) - counts)[row] < k
    row, col = row[kept], col[kept]
    return gaps[row, col], col


def _each_cloud(points: DataFrame, by: Sequence[str], schema: T.StructType, work: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """``work`` on the points of each cloud in id order, with their coordinates."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("point_id")
        return work(table, np.column_stack([table.column(a).to_numpy() for a in "xyz"])).select(schema.names)

    return points.groupBy(*by).applyInArrow(run, schema)


def whole_neighbours(points: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Points of small clouds with the arrays ``d`` and ``ids`` of their ``min(k, n - 1)`` nearest others."""
    schema = T.StructType([*points.schema.fields, T.StructField("d", T.ArrayType(T.DoubleType())),
                           T.StructField("ids", T.ArrayType(T.LongType()))])

    def work(table: pa.Table, xyz: np.ndarray) -> pa.Table:
        n, ids = len(xyz), table.column("point_id").to_numpy()
        most = min(k, n - 1)
        found = [_nearest_others(s, at, most) for at, s in _squares(xyz)] if most else [(np.empty(0), np.empty(0, int))]
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * most)
        d, near = (np.concatenate(part) for part in zip(*found))
        return table.append_column("d", pa.ListArray.from_arrays(ends, pa.array(d))).append_column(
            "ids", pa.ListArray.from_arrays(ends, pa.array(ids[near].astype(np.int64))))

    return _each_cloud(points, by, schema, work)


# -- tree of cells -------------------------------------------------------------------


def _node(level: int) -> Column:
    side = float(2**level)
    return F.struct(
        F.lit(level).alias("level"), *[F.floor(F.col(f"_f{a}") * side).cast("bigint").alias(f"c{a}") for a in "xyz"])


def build_tree(pos: DataFrame, by: Sequence[str], reach: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Written tables of the cells of all levels, and of the positions with their leaf ``node``.

    With ``reach``, the largest cell around a position whose whole box fits into that
    distance names its ``unit``: all its positions are within reach of each other.
    """
    span = pos.groupBy(*by).agg(
        *[F.min(a).alias(f"_o{a}") for a in "xyz"],
        F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("_e"))
    size = F.when(F.col("_e") > 0, F.col("_e") * (1 + 1e-9)).otherwise(1.0)
    rows = salted_join(pos, span, by, spread=["id"])
    rows = rows.withColumns({f"_f{a}": (F.col(a) - F.col(f"_o{a}")) / size for a in "xyz"})
    begin = pending = cut_lineage(rows.drop("_ox", "_oy", "_oz", "_e").withColumn("unit", F.lit(None).cast("bigint")))
    levels, leaves, written = [], [], []
    for level in range(MAX_LEVEL + 1):
        staged = pending.withColumn("node", _node(level))
        cells = staged.groupBy(*by, "node").agg(
            F.count(F.lit(1)).alias("_rows"), F.sum("m").alias("n"), F.sum(F.size("ids")).alias("kept"), F.min("id").alias("_rep"),
            F.min("unit").alias("unit"), *[F.min(a).alias(f"l{a}") for a in "xyz"], *[F.max(a).alias(f"h{a}") for a in "xyz"])
        if reach is not None:
            diagonal = F.sqrt(sum(((F.col(f"h{a}") - F.col(f"l{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
            cells = cells.withColumn("unit", F.coalesce("unit", F.when(diagonal <= reach, F.col("_rep"))))
        leaf = (F.col("_rows") <= LEAF) | F.lit(level == MAX_LEVEL)
        cells = cut_lineage(cells.withColumn("leaf", leaf).drop("_rows", "_rep"))
        parent = F.struct(
            (F.col("node.level") - 1).alias("level"),
            *[F.shiftright(F.col("node")[f"c{a}"], 1).alias(f"c{a}") for a in "xyz"])
        levels.append(cells.withColumn("parent", parent))
        placed = staged.drop("unit").join(cells.select(*by, "node", "leaf", "unit"), [*by, "node"])
        placed = cut_lineage(placed)
        if level == 0:
            release(begin)
        written += [cells, placed]
        leaves.append(placed.filter("leaf").select(*by, "id", "m", "ids", "x", "y", "z", "node", "unit"))
        pending = placed.filter("NOT leaf").drop("node", "leaf")
        if pending.isEmpty():
            break
    nodes, points = levels[0], leaves[0]
    for a, b in zip(levels[1:], leaves[1:]):
        nodes, points = nodes.unionByName(a), points.unionByName(b)
    nodes, points = cut_lineage(nodes), cut_lineage(points)
    release(*written)
    return nodes, points


def _info() -> Column:
    return F.struct("node", "n", "kept", "leaf", "unit", *BOX)


def _gap(a: Column, b: Column, far: bool) -> Column:
    total = F.lit(0.0)
    for axis in "xyz":
        if far:
            part = F.greatest(a[f"h{axis}"] - b[f"l{axis}"], b[f"h{axis}"] - a[f"l{axis}"])
        else:
            part = F.greatest(F.lit(0.0), a[f"l{axis}"] - b[f"h{axis}"], b[f"l{axis}"] - a[f"h{axis}"])
        total = total + part * part
    return F.sqrt(total)


def _roots(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    return nodes.filter("node.level = 0").select(*by, _info().alias("a"), _info().alias("b"))


def _open_pairs(pairs: DataFrame, nodes: DataFrame, by: Sequence[str], wanted: DataFrame | None) -> DataFrame:
    """Replace every inner cell of a pair by its children."""
    kids = nodes.filter("node.level > 0").select(*by, F.col("parent").alias("_p"), _info().alias("_kid"))
    for side in ("a", "b"):
        table = kids
        if side == "a" and wanted is not None:
            table = kids.join(wanted.withColumnRenamed("node", "_w"), [
                *[kids[k] == wanted[k] for k in by], F.col("_kid.node") == F.col("_w")], "left_semi")
        inner = pairs.filter(~F.col(side)["leaf"]).withColumn("_p", F.col(side)["node"])
        opened = inner.join(table, [*by, "_p"]).withColumn(side, F.col("_kid")).select(*by, "a", "b")
        pairs = pairs.filter(F.col(side)["leaf"]).select(*by, "a", "b").unionByName(opened)
    return pairs


def _nearest_batches(k: int, by: list[str]):
    """Distances and ids of the ``k + 1`` nearest copies per query position of a cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = []
            for row in frame.itertuples(index=False):
                order = np.argsort(row.cid, kind="stable")
                ids = np.asarray(row.cid)[order]
                cand = np.column_stack([row.cx, row.cy, row.cz])[order]
                query = np.column_stack([row.qx, row.qy, row.qz])
                gaps = np.sqrt(((query[:, None, :] - cand[None, :, :]) ** 2).sum(axis=2))
                near = np.argsort(gaps, axis=1, kind="stable")[:, : k + 1]
                parts.append(pd.DataFrame({
                    **{c: getattr(row, c) for c in by}, "id": row.qid, "x": row.qx, "y": row.qy, "z": row.qz,
                    "d": list(np.take_along_axis(gaps, near, axis=1)), "ids": list(ids[near])}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def position_neighbours(
    points: DataFrame, k: int, by: Sequence[str] = ("cloud_id",), queries: DataFrame | None = None
) -> DataFrame:
    """Per distinct position the ``k + 1`` nearest points, itself included: sorted arrays
    ``d`` and ``ids`` (smaller id first among equals). ``queries`` limits the positions
    that are asked for, not those that are found."""
    if k < 1:
        raise ValueError("k must be at least 1")
    keys = list(by)
    nodes, placed = build_tree(positions(points, keys, k + 1), keys)
    asked, wanted = placed, None
    if queries is not None:
        spots = queries.select(*keys, *[(F.col(a) + F.lit(0.0)).alias(a) for a in "xyz"]).distinct()
        asked = placed.join(spots, [*keys, "x", "y", "z"], "left_semi")
        ups = F.transform(F.sequence(F.lit(0), F.col("node.level")), lambda s: F.struct(
            (F.col("node.level") - s).alias("level"),
            *[F.floor(F.col("node")[f"c{a}"] / F.pow(F.lit(2.0), s)).cast("bigint").alias(f"c{a}") for a in "xyz"]))
        wanted = cut_lineage(asked.select(*keys, F.explode(ups).alias("node")).distinct())
    pairs, before = _roots(nodes, keys), None
    while True:
        a, b = F.col("a"), F.col("b")
        pairs = pairs.withColumns({"_near": _gap(a, b, False), "_far": _gap(a, b, True), "_a": a["node"]})
        w = Window.partitionBy(*keys, "_a").orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = pairs.withColumn("_within", F.sum(b["n"]).over(w))
        whole = Window.partitionBy(*keys, "_a")
        bound = F.min(F.when(F.col("_within") >= k + 1, F.col("_far"))).over(whole)
        pairs = pairs.withColumn("_bound", bound).filter(
            F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * (1 + 1e-12)))
        pairs = cut_lineage(pairs.select(*keys, "a", "b", "_near"))
        if before is not None:
            release(before)
        before = pairs
        if pairs.filter("NOT a.leaf OR NOT b.leaf").isEmpty():
            break
        pairs = _open_pairs(pairs.drop("_near"), nodes, keys, wanted)
    # Candidates of a cell in chunks of bounded size.
    w = Window.partitionBy(*keys, "_a").orderBy("_near", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    links = pairs.select(
        *keys, F.col("a.node").alias("_a"), F.col("b.node").alias("_b"), "_near", F.col("b.kept").alias("_n"))
    links = links.withColumn("_chunk", F.floor((F.sum("_n").over(w) - F.col("_n")) / CHUNK)).drop("_near", "_n")
    copies = placed.select(*keys, F.col("node").alias("_b"), "x", "y", "z", F.explode("ids").alias("id"))
    found = links.join(copies, [*keys, "_b"]).drop("_b").withColumn("_c", F.lit(True))
    ask = links.select(*keys, "_a", "_chunk").distinct().join(
        asked.select(*keys, F.col("node").alias("_a"), "id", "x", "y", "z"), [*keys, "_a"]).withColumn("_c", F.lit(False))

    def listed(name: str, candidate: bool) -> Column:
        return F.collect_list(F.when(F.col("_c") == candidate, F.col(name))).alias(("c" if candidate else "q") + name)

    # A fixed partition count: the rows are few bytes but much work, so they must not be merged.
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = found.unionByName(ask).repartition(width, *keys, "_a", "_chunk")
    rows = both.groupBy(*keys, "_a", "_chunk").agg(
        *[listed(n, c) for c in (True, False) for n in ("id", "x", "y", "z")]).drop("_a", "_chunk")
    schema = T.StructType([
        *[points.schema[c] for c in keys], T.StructField("id", T.LongType()),
        *[T.StructField(a, T.DoubleType()) for a in "xyz"], T.StructField("d", T.ArrayType(T.DoubleType())),
        T.StructField("ids", T.ArrayType(T.LongType()))])
    parts = rows.mapInPandas(_nearest_batches(k, keys), schema)
    zipped = F.transform(F.arrays_zip("d", "ids"), lambda s: F.struct(s["d"].alias("d"), s["ids"].alias("i")))
    merged = parts.groupBy(*keys, "id", "x", "y", "z").agg(F.flatten(F.collect_list(zipped)).alias("_z"))
    best = F.slice(F.array_sort("_z"), 1, k + 1)
    return merged.select(
        *keys, "id", "x", "y", "z", F.transform(best, lambda s: s["d"]).alias("d"),
        F.transform(best, lambda s: s["i"]).alias("ids"))


def knn(points: DataFrame, k: int, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Rows ``(by, point_id, rank, neighbour_id, distance)``: the ``min(k, n - 1)`` nearest
    other points, smaller id first among equals."""
    if k < 1:
        raise ValueError("k must be at least 1")
    keys = list(by)
    few, many = by_size(points.select(*keys, "point_id", "x", "y", "z"), keys)
    near = whole_neighbours(few, k, keys).withColumnRenamed("ids", "_ids")
    rows = near.select(*keys, "point_id", F.posexplode(F.arrays_zip("d", "_ids")).alias("_r", "_s"))
    if many is not None:
        lists = position_neighbours(many, k, keys).withColumnRenamed("ids", "_ids")
        joined = many.join(lists.drop("id"), [*keys, "x", "y", "z"])
        others = F.filter(F.arrays_zip("d", "_ids"), lambda s: s["_ids"] != F.col("point_id"))
        rows = rows.unionByName(joined.select(*keys, "point_id", F.posexplode(F.slice(others, 1, k)).alias("_r", "_s")))
    return rows.select(
        *keys, "point_id", (F.col("_r") + 1).alias("rank"), F.col("_s._ids").alias("neighbour_id"),
        F.col("_s.d").alias("distance"))


def statistical_outlier_removal(
    df: DataFrame, k: int = 50, lam: float = 1.0, by: Sequence[str] = ("cloud_id",)
) -> DataFrame:
    """Keep points whose mean distance to their ``k`` neighbours is at most the cloud's
    mean plus ``lam`` sample standard deviations. Clouds under three points are an error."""
    if k < 1 or not np.isfinite(lam) or lam <= 0:
        raise ValueError("k and lam must be positive")
    keys = list(by)
    few, many = by_size(df, keys)

    def mean(others: Column) -> Column:
        total = F.aggregate(others, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(others) > 0, total / F.size(others)).alias("_mean")

    rows = cut_lineage(whole_neighbours(few, k, keys).select(*df.columns, mean(F.col("d"))))
    if many is not None:
        spots = position_neighbours(many, k, keys).select(*keys, "x", "y", "z", mean(F.slice("d", 2, k)))
        rows = rows.unionByName(cut_lineage(many.join(spots, [*keys, "x", "y", "z"]).select(*df.columns, "_mean")))
    stats = rows.groupBy(*keys).agg(
        F.avg("_mean").alias("_mu"), F.stddev_samp("_mean").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    scarce = F.when(F.col("_n") < 3, F.raise_error(F.lit("outlier removal needs three valid points")))
    stats = stats.withColumn("_limit", F.coalesce(scarce.cast("double"), F.col("_mu") + lam * F.col("_sd")))
    joined = salted_join(rows, stats.select(*keys, "_limit"), keys, spread=["point_id"])
    return joined.filter(F.col("_mean") <= F.col("_limit")).select(*df.columns)


def estimate_spacing(df: DataFrame, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Upper median of the distance to the nearest other point over all finite points, zeros
    left out; 0 where nothing remains."""
    keys = list(by)
    few, many = by_size(df.select(*keys, "point_id", "x", "y", "z"), keys)
    values = whole_neighbours(few, 1, keys).select(*keys, F.try_element_at("d", F.lit(1)).alias("_d"))
    clouds = few.select(*keys).distinct()
    if many is not None:
        # A position with copies has a nearest other point at distance 0; the others stand for one point each.
        lists = position_neighbours(many, 1, keys)
        values = values.unionByName(lists.select(*keys, F.try_element_at("d", F.lit(2)).alias("_d")))
        clouds = clouds.unionByName(many.select(*keys).distinct())
    values = cut_lineage(values.filter("_d > 0"))
    medians = upper_medians(values, keys, "_d", "spacing")
    return join_on(clouds, medians, keys, "left").na.fill(0.0, ["spacing"])


# -- radius search -------------------------------------------------------------------


def _close_leaves(
    nodes: DataFrame, by: Sequence[str], reach: float, units: bool, whole: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Leaf pairs that may hold points within ``reach``. With ``units``, pairs of one unit
    are dropped, and pairs of two units that are wholly within reach become edges. With
    ``whole``, a cell wholly within reach of another is no pair but a row ``(node, near)`` with its number of points."""
    keys = list(by)
    pairs, edges, before = _roots(nodes, keys), None, None
    while True:
        a, b = F.col("a"), F.col("b")
        pairs = pairs.filter(_gap(a, b, False) <= reach * (1 + 1e-12))
        if units:
            pairs = pairs.filter(a["unit"].isNull() | b["unit"].isNull() | (a["unit"] < b["unit"]))
            both = a["unit"].isNotNull() & b["unit"].isNotNull() & (_gap(a, b, True) <= reach)
            pairs = cut_lineage(pairs.withColumn("_sure", F.coalesce(both, F.lit(False))))
            sure = pairs.filter("_sure").select(*keys, F.col("a.unit").alias("src"), F.col("b.unit").alias("dst"))
            edges = sure if edges is None else edges.unionByName(sure)
            pairs = pairs.filter("NOT _sure").drop("_sure")
        elif whole:
            pairs = cut_lineage(pairs.withColumn("_sure", _gap(a, b, True) <= reach * (1 - 1e-12)))
            sure = pairs.filter("_sure").groupBy(*keys, F.col("a.node").alias("node")).agg(F.sum("b.n").alias("near"))
            edges = sure if edges is None else edges.unionByName(sure)
            pairs = pairs.filter("NOT _sure").drop("_sure")
        else:
            pairs = cut_lineage(pairs)
            if before is not None:
                release(before)
            before = pairs
        if pairs.filter("NOT a.leaf OR NOT b.leaf").isEmpty():
            return pairs, edges
        pairs = _open_pairs(pairs, nodes, keys, None)


def _leaf_pairs(pairs: DataFrame, placed: DataFrame, by: Sequence[str], reach: float) -> DataFrame:
    """Position pairs ``p, q`` within ``reach`` of the given leaf pairs."""
    keys = list(by)

    def side(name: str) -> DataFrame:
        body = F.struct("id", "m", "unit", "x", "y", "z").alias(f"_{name}p")
        return placed.select(*keys, F.col("node").alias(f"_{name}"), body)

    links = pairs.select(*keys, F.col("a.node").alias("_a"), F.col("b.node").alias("_b"))
    rows = links.join(side("a"), [*keys, "_a"]).join(side("b"), [*keys, "_b"])
    p, q = F.col("_ap"), F.col("_bp")
    squared = sum(((p[a] - q[a]) * (p[a] - q[a]) for a in "xyz"), F.lit(0.0))
    return rows.withColumn("_d2", squared).filter(F.col("_d2") <= reach * reach)


def radius_pairs(points: DataFrame, radius: float, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """All ``(by, point_id, neighbour_id, distance)`` with a distance of at most
    ``radius``, each point with itself included."""
    keys = list(by)
    few, many = by_size(points.select(*keys, "point_id", "x", "y", "z"), keys)
    schema = T.StructType([
        *[few.schema[c] for c in keys], T.StructField("point_id", T.LongType()), T.StructField("neighbour_id", T.LongType()),
        T.StructField("distance", T.DoubleType())])

    def work(table: pa.Table, xyz: np.ndarray) -> pa.Table:
        found = []
        for at, squares in _squares(xyz):
            row, col = np.nonzero(squares <= radius * radius)
            found.append((row + at, col, np.sqrt(squares[row, col])))
        row, col, distance = (np.concatenate(part) for part in zip(*found))
        ids = table.column("point_id").to_numpy().astype(np.int64)
        return table.select(keys).take(pa.array(row)).append_column("point_id", pa.array(ids[row])).append_column(
            "neighbour_id", pa.array(ids[col])).append_column("distance", pa.array(distance))

    out = _each_cloud(few, keys, schema, work)
    return out if many is None else out.unionByName(_tree_pairs(many, radius, keys))


def _tree_pairs(points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    nodes, placed = build_tree(positions(points, keys, 1), keys)
    pairs, _ = _close_leaves(nodes, keys, radius, False)
    close = _leaf_pairs(pairs, placed, keys, radius).select(
        *keys, *[F.col("_ap")[a].alias(a) for a in "xyz"], *[F.col("_bp")[a].alias(f"_{a}") for a in "xyz"],
        F.sqrt("_d2").alias("distance"))
    pts = filter_finite(points).select(*keys, "point_id", *[(F.col(a) + F.lit(0.0)).alias(a) for a in "xyz"])
    other = pts.withColumnsRenamed({"point_id": "neighbour_id", "x": "_x", "y": "_y", "z": "_z"})
    return pts.join(close, [*keys, "x", "y", "z"]).join(other, [*keys, "_x", "_y", "_z"]).select(
        *keys, "point_id", "neighbour_id", "distance")


def radius_counts(points: DataFrame, radius: float, by: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """``(by, point_id, neighbours)``: the points within ``radius`` of each finite point, itself included.

    In clouds of more than ``WHOLE`` points cells that lie wholly within reach of each other count as such, copies of a
    position by their number, so neither dense regions nor copies make a row per pair of points.
    """
    keys = list(by)
    few, many = by_size(points.select(*keys, "point_id", "x", "y", "z"), keys)
    schema = T.StructType([
        *[few.schema[c] for c in keys], T.StructField("point_id", T.LongType()), T.StructField("neighbours", T.LongType())])

    def work(table: pa.Table, xyz: np.ndarray) -> pa.Table:
        counts = [(squares <= radius * radius).sum(axis=1) for _, squares in _squares(xyz)]
        return table.append_column("neighbours", pa.array(np.concatenate(counts).astype(np.int64)))

    out = _each_cloud(few, keys, schema, work)
    return out if many is None else out.unionByName(_tree_counts(many, radius, keys))


def _tree_counts(points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    nodes, placed = build_tree(positions(points, keys, 1), keys)
    pairs, sure = _close_leaves(nodes, keys, radius, False, whole=True)
    ups = F.transform(F.sequence(F.lit(0), F.col("_leaf.level")), lambda s: F.struct(
        (F.col("_leaf.level") - s).alias("level"),
        *[F.floor(F.col("_leaf")[f"c{a}"] / F.pow(F.lit(2.0), s)).cast("bigint").alias(f"c{a}") for a in "xyz"]))
    lines = nodes.filter("leaf").select(*keys, F.col("node").alias("_leaf")).withColumn("node", F.explode(ups))
    given = lines.join(sure, [*keys, "node"]).groupBy(*keys, F.col("_leaf").alias("node")).agg(F.sum("near").alias("_sure"))
    near = _leaf_pairs(pairs, placed, keys, radius).groupBy(*keys, F.col("_ap.id").alias("id")).agg(
        F.sum("_bp.m").alias("_near"))
    spots = placed.join(given, [*keys, "node"], "left").join(near, [*keys, "id"], "left").select(
        *keys, "x", "y", "z", (F.coalesce("_sure", F.lit(0)) + F.coalesce("_near", F.lit(0))).alias("neighbours"))
    pts = filter_finite(points).select(*keys, "point_id", *[(F.col(a) + F.lit(0.0)).alias(a) for a in "xyz"])
    return pts.join(spots, [*keys, "x", "y", "z"]).select(*keys, "point_id", "neighbours")


def reach_edges(points: DataFrame, reach: float, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges whose components are those of "within ``reach``", without one
    edge per close pair: cells that fit into the reach are single vertices.

    Returns ``members (by, x, y, z, id)`` with the vertex of each position, and edges.
    """
    keys = list(by)
    nodes, placed = build_tree(positions(points, keys, 1), keys, reach)
    pairs, edges = _close_leaves(nodes, keys, reach, True)
    vertex = F.coalesce("unit", "id")
    near = _leaf_pairs(pairs, placed, keys, reach)

    def own(name: str) -> Column:
        return F.coalesce(F.col(name)["unit"], F.col(name)["id"])

    found = near.select(*keys, own("_ap").alias("src"), own("_bp").alias("dst")).filter("src <> dst")
    edges = found if edges is None else edges.unionByName(found)
    return placed.select(*keys, "x", "y", "z", vertex.alias("id")), edges.distinct()
