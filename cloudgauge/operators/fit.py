"""Shape fits for many clouds at once.

All sums (centroids, covariances, normal equations) are grouped aggregates; the closing
3x3 eigen problem or the at most 15x15 solve of an already aggregated row runs in a pandas
UDF. Every step uses all finite points of a cloud: candidates are compared by exact medians, found digit by digit
from bounded counters of slices of the cloud, Gauss-Newton sums its normal equations over all
open clouds in one grouped aggregate per step. Each least-squares pass first centres
its points, so large coordinates do not cost precision. Groups whose points cannot
determine a shape get a ``failure`` text instead of failing the job.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cloudgauge.functions.vec import Vec, computed_once, cross, dot, fields, finite as is_finite, pack, scale, sub, vec
from cloudgauge.operators import ordered
from cloudgauge.operators.cloud import filter_finite, stride_filter
from cloudgauge.operators.models import (
    MODEL_COLUMNS, VEC3, complete_models, surface_terms,
)
from cloudgauge.operators.selection import upper_medians
from cloudgauge.operators.fitsteps import (
    CANDIDATES, DEGENERATE_EIGENVALUE, DIGITS, MINIMUM_POINTS, RANK_TOLERANCE, REFINE_STEPS, STATS, close, gauss_newton, measure,
    replay, run_whole, steps,
)
from cloudgauge.session import cut_lineage, join_on, own_session, release, reread, salted_join

#: Points of a cloud that one task scores at a time.
SCORE_SLICE = 16_384
#: Points of a cloud up to which one task takes all steps; larger clouds are summed by all tasks.
TASK_POINTS = 200_000
#: Bytes of points and of sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20
#: Rows of packed points in a row group; a reader holds those of one.
PACKED_ROWS = 16
#: Bytes of packed points that go to Python at a time.
SENT_BYTES = 4 << 20

EIGEN = T.StructType(
    [T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("vectors", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(EIGEN)
def eigen3(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
    """Rising eigenvalues and the eigenvectors (one after the other) of symmetric 3x3s."""
    m = np.empty((len(xx), 3, 3))
    m[:, 0, 0], m[:, 1, 1], m[:, 2, 2] = xx, yy, zz
    m[:, 0, 1] = m[:, 1, 0] = xy
    m[:, 0, 2] = m[:, 2, 0] = xz
    m[:, 1, 2] = m[:, 2, 1] = yz
    ok = np.isfinite(m).all(axis=(1, 2))
    values, vectors = np.linalg.eigh(np.where(ok[:, None, None], m, 0.0))
    return pd.DataFrame({"values": list(values), "vectors": list(vectors.transpose(0, 2, 1).reshape(len(m), 9))})


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(matrix: pd.Series, right: pd.Series) -> pd.Series:
    """Solutions of packed symmetric systems; NULL where the matrix is rank deficient."""
    out = []
    for packed, b in zip(matrix, right):
        b = np.asarray(b, dtype=float)
        n = len(b)
        a = np.zeros((n, n))
        a[np.triu_indices(n)] = packed
        a = a + np.triu(a, 1).T
        size = np.sqrt(np.maximum(np.diag(a), 1e-300))
        scaled = a / np.outer(size, size)
        if not np.isfinite(scaled).all() or np.linalg.eigvalsh(scaled)[0] < RANK_TOLERANCE:
            out.append(None)
        else:
            out.append(np.linalg.solve(scaled, b / size) / size)
    return pd.Series(out)


def orient(v: Vec) -> Vec:
    """Flip a direction so that its largest component is not negative."""
    ax, ay, az = (F.abs(c) for c in v)
    dominant = F.when((ax >= ay) & (ax >= az), v[0]).when(ay >= az, v[1]).otherwise(v[2])
    sign = F.when(dominant < 0, -1.0).otherwise(1.0)
    return scale(v, sign)


def orthogonal(v: Vec) -> Vec:
    """Some unit vector at a right angle to ``v``."""
    use_xy = (F.abs(v[0]) > 1e-12 * F.abs(v[2])) | (F.abs(v[1]) > 1e-12 * F.abs(v[2]))
    zero = F.lit(0.0)
    a = F.sqrt(v[0] * v[0] + v[1] * v[1])
    b = F.sqrt(v[1] * v[1] + v[2] * v[2])
    return (
        F.when(use_xy, -v[1] / a).otherwise(zero),
        F.when(use_xy, v[0] / a).otherwise(-v[2] / b),
        F.when(use_xy, zero).otherwise(v[1] / b),
    )


def _attach(points: DataFrame, groups: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Group values beside each point. Minimal subsets hold a bounded number of rows per group
    and join as they are; whole clouds are spread over salts."""
    if bounded:
        return join_on(points, groups, keys)
    return salted_join(points, groups, keys, spread=["x", "y", "z"])


# -- principal axes ------------------------------------------------------------------


def pca(df: DataFrame, by: Sequence[str] = ("cloud_id",), bounded: bool = False) -> DataFrame:
    """Centroid, covariance eigenvalues (rising) and axes per group.

    Two passes: centroid first, then centred products, so that large coordinates are safe.
    """
    pts = filter_finite(df)
    centers = pts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    joined = _attach(pts.select(*by, "x", "y", "z"), centers, by, bounded)
    d = {a: F.col(a) - F.col(f"c{a}") for a in "xyz"}
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    sums = joined.groupBy(*by).agg(
        F.first("n").alias("n"), *[F.first(f"c{a}").alias(f"c{a}") for a in "xyz"],
        *[F.avg(d[p[0]] * d[p[1]]).alias(f"_{p}") for p in pairs])
    solved = sums.withColumn("_e", eigen3(*[F.col(f"_{p}") for p in pairs]))
    axes = [
        pack(orient(tuple(F.element_at(F.col("_e")["vectors"], 3 * i + j + 1) for j in range(3)))).alias(f"axis{i}")
        for i in range(3)
    ]
    return solved.select(
        *by, "n", F.struct(*[F.col(f"c{a}").alias(a) for a in "xyz"]).alias("center"),
        F.col("_e")["values"].alias("eigenvalues"), *axes)


# -- least squares -------------------------------------------------------------------


def _normal_sums(terms: Sequence[Column], value: Column) -> list[Column]:
    n = len(terms)
    matrix = F.array(*[F.sum(terms[i] * terms[j]) for i in range(n) for j in range(i, n)])
    right = F.array(*[F.sum(t * value) for t in terms])
    return [matrix.alias("_m"), right.alias("_b")]


def least_squares(points: DataFrame, kind: str, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """One model row per key with the ``failure`` of degenerate groups."""
    axes = pca(points, keys, bounded)
    degenerate = F.element_at("eigenvalues", 2) <= DEGENERATE_EIGENVALUE
    axes = axes.withColumn("failure", F.when(degenerate, "degenerate"))
    if kind == "plane":
        out = axes.withColumns({"kind": F.lit(kind), "direction": F.col("axis0")})
        out = out.withColumn("offset", -dot(fields("direction"), fields("center")))
        return _shape(out, keys)
    if kind in ("quadric", "quartic"):
        return _surface(points, axes, kind, keys, bounded)
    if kind == "sphere":
        return _sphere(points, axes, keys, bounded)
    return _cylinder(points, axes, keys, bounded)


def _shape(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return complete_models(df).select(*keys, *MODEL_COLUMNS, "failure")


def _surface(points: DataFrame, axes: DataFrame, kind: str, keys: Sequence[str], bounded: bool) -> DataFrame:
    degree = 2 if kind == "quadric" else 4
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda acc, v: acc + v)
    normal = fields("axis0")
    frame = axes.select(
        *keys, "failure", "center", F.col("axis0").alias("direction"), pack(orthogonal(normal)).alias("basis_u"),
        F.sqrt(total).alias("surface_scale"))
    frame = frame.withColumn("basis_v", pack(cross(fields("direction"), fields("basis_u"))))
    joined = _attach(points.select(*keys, "x", "y", "z"), frame, keys, bounded)
    delta = sub(vec("x", "y", "z"), fields("center"))
    u = dot(delta, fields("basis_u")) / F.col("surface_scale")
    v = dot(delta, fields("basis_v")) / F.col("surface_scale")
    rows = joined.select(*keys, u.alias("u"), v.alias("v"), dot(delta, fields("direction")).alias("h"))
    sums = rows.groupBy(*keys).agg(*_normal_sums(surface_terms(F.col("u"), F.col("v"), degree), F.col("h")))
    solved = sums.select(*keys, solve_normal("_m", "_b").alias("coefficients"))
    out = join_on(frame, solved, keys).withColumn("kind", F.lit(kind))
    out = out.withColumn("offset", -dot(fields("direction"), fields("center")))
    missing = F.when(F.col("coefficients").isNull(), "rank")
    return _shape(out.withColumn("failure", F.coalesce("failure", missing)), keys)


def _sphere(points: DataFrame, axes: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    base = axes.select(*keys, "failure", "center")
    joined = _attach(points.select(*keys, "x", "y", "z"), base, keys, bounded)
    delta = sub(vec("x", "y", "z"), fields("center"))
    rows = joined.select(*keys, *[c.alias(f"d{a}") for a, c in zip("xyz", delta)])
    d = vec("dx", "dy", "dz")
    terms = [*scale(d, 2.0), F.lit(1.0)]
    solved = rows.groupBy(*keys).agg(*_normal_sums(terms, dot(d, d))).select(
        *keys, solve_normal("_m", "_b").alias("_s"))
    out = join_on(base, solved, keys)
    shift = tuple(F.element_at("_s", i + 1) for i in range(3))
    squared = dot(shift, shift) + F.element_at("_s", 4)
    bad = F.when(F.col("_s").isNull(), "rank").when(~(squared > 0), "radius")
    out = out.withColumns({
        "failure": F.coalesce("failure", bad), "kind": F.lit("sphere"),
        "radius": F.when(squared > 0, F.sqrt(F.abs(squared))),
        "center": pack(tuple(a + b for a, b in zip(fields("center"), shift))),
        "direction": F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")),
    })
    return _shape(out, keys)


def _cylinder(points: DataFrame, axes: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Each principal axis is tried as the cylinder axis with a circle fit; the candidate
    of least squared error wins, the earlier one in a tie."""
    tries = axes.select(
        *keys, "failure", F.col("center").alias("origin"),
        F.posexplode(F.array("axis0", "axis1", "axis2")).alias("_try", "direction"))
    tries = tries.withColumn("basis_u", pack(orthogonal(fields("direction"))))
    tries = tries.withColumn("basis_v", pack(cross(fields("direction"), fields("basis_u"))))
    packed = tries.groupBy(*keys).agg(
        F.first("failure").alias("failure"),
        F.collect_list(F.struct("_try", "origin", "direction", "basis_u", "basis_v")).alias("_tries"))
    joined = _attach(points.select(*keys, "x", "y", "z"), packed, keys, bounded).select(
        *keys, "x", "y", "z", F.explode("_tries").alias("_c"))
    c = F.col("_c")
    delta = sub(vec("x", "y", "z"), fields(c["origin"]))
    rows = joined.select(
        *keys, c["_try"].alias("_try"), dot(delta, fields(c["basis_u"])).alias("p"),
        dot(delta, fields(c["basis_v"])).alias("q"))
    p, q = F.col("p"), F.col("q")
    circle = rows.groupBy(*keys, "_try").agg(*_normal_sums([2 * p, 2 * q, F.lit(1.0)], p * p + q * q)).select(
        *keys, "_try", solve_normal("_m", "_b").alias("_s"))
    solved = join_on(tries, circle, [*keys, "_try"])
    s = [F.element_at("_s", i + 1) for i in range(3)]
    squared = s[0] * s[0] + s[1] * s[1] + s[2]
    solved = solved.filter(F.col("_s").isNotNull() & (squared > 0)).withColumns({
        "p0": s[0], "q0": s[1], "radius": F.sqrt(F.abs(squared))})
    circles = solved.select(*keys, "_try", "p0", "q0", "radius")
    scored = join_on(rows, circles, [*keys, "_try"]) if bounded else salted_join(rows, circles, [*keys, "_try"], spread=["p", "q"])
    gap = F.sqrt((p - F.col("p0")) ** 2 + (q - F.col("q0")) ** 2) - F.col("radius")
    scores = scored.groupBy(*keys, "_try").agg(F.sum(gap * gap).alias("_score"))
    best = join_on(solved, scores, [*keys, "_try"])
    center = tuple(
        o + F.col("p0") * u + F.col("q0") * v
        for o, u, v in zip(fields("origin"), fields("basis_u"), fields("basis_v")))
    best = best.withColumn("_model", F.struct(
        pack(center).alias("center"), pack(orient(fields("direction"))).alias("direction"), F.col("radius")))
    best = best.groupBy(*keys).agg(F.min_by("_model", F.struct("_score", "_try")).alias("_model"))
    out = join_on(axes.select(*keys, "failure"), best, keys, "left")
    out = out.withColumn("failure", F.coalesce("failure", F.when(F.col("_model").isNull(), "rank")))
    out = out.select(*keys, "failure", F.lit("cylinder").alias("kind"), "_model.*")
    return _shape(out, keys)


# -- candidates, trimming, refinement ------------------------------------------------


def numbered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """All finite points of each cloud, numbered ``_i`` from 0 in id order, with their count ``_n``."""
    pts = filter_finite(df).select(*by, "point_id", "x", "y", "z")
    ranked = ordered.row_number(pts, by, ["point_id"], "_row", ordered.point_slice())
    totals = pts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = salted_join(ranked, totals, by, spread=["point_id"])
    return rows.select(*by, "point_id", "x", "y", "z", "_n", (F.col("_row") - 1).alias("_i"))


def fit_sample(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """At most ``limit`` finite points per cloud, evenly strided in id order, numbered
    ``_i`` from 0 with the sample size ``_keep``. For display and imports; fits use every point."""
    rows = numbered(df, by).withColumnRenamed("_i", "_at")
    rows = rows.withColumn("_keep", F.least(F.col("_n"), F.lit(limit)).cast("bigint")).filter(stride_filter("_at", "_n", "_keep"))
    return rows.select(*by, "point_id", "x", "y", "z", "_n", "_keep", F.expr("(_at * _keep + _n - 1) div _n").alias("_i"))


def _candidate_subsets(
    points: DataFrame, groups: DataFrame, kind: str, by: Sequence[str], seed: int, draw: Sequence[str] | None = None
) -> DataFrame:
    """``CANDIDATES`` minimal subsets per cloud of ``groups`` with its count ``_n``: distinct points picked by the hash of ``draw``."""
    size = MINIMUM_POINTS[kind]
    # More picks than needed, so that repeats can be dropped; the first distinct ones stay.
    picks = groups.withColumn("_cand", F.explode(F.sequence(F.lit(1), F.lit(CANDIDATES))))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(8 * size)),
        lambda k: F.pmod(F.xxhash64(*(draw or by), F.lit(seed), F.col("_cand"), k), F.col("_n")))
    picks = picks.withColumn("_i", F.explode(F.slice(F.array_distinct(draws), 1, size)))
    return join_on(points.select(*by, "_i", "x", "y", "z"), picks.select(*by, "_i", "_cand"), [*by, "_i"])


def hash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of 32-bit numbers after columns whose hash is ``seed``, all as unsigned 64-bit numbers."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (value.astype(np.uint64) * p1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def drawn(start: int, n: int, size: int) -> np.ndarray:
    """The point numbers of ``_candidate_subsets`` for a cloud, a row per subset; ``start`` is the hash of its keys and the seed."""
    first = hash_int(np.arange(1, CANDIDATES + 1), np.full(CANDIDATES, start, np.int64).view(np.uint64))
    draws = hash_int(np.tile(np.arange(8 * size + 1), (CANDIDATES, 1)), first[:, None]).view(np.int64) % n
    rows = [list(dict.fromkeys(row))[:size] for row in draws.tolist()]
    return np.array([r for r in rows if len(r) == size], dtype=np.int64).reshape(-1, size)


def _slices(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """A written row per ``SCORE_SLICE`` points of a cloud with their coordinates in one array."""
    rows = points.withColumn("_part", F.floor(F.col("_i") / SCORE_SLICE))
    return cut_lineage(rows.groupBy(*by, "_part").agg(F.collect_list(F.struct("x", "y", "z")).alias("_xyz"), F.first("_n").alias("_n")))


def _digit_counts(parts: DataFrame, pools: DataFrame, by: Sequence[str], shift: int, width: int) -> DataFrame:
    """Per cloud and open candidate how many absolute residuals have each digit: ``width`` bits above ``shift`` of the
    number's own bits, whose order is the order of the numbers.

    A pool row holds the open candidates ``_cands``, their shapes ``_params`` as flat groups of 7 (centre, normal, radius; a
    radius below zero marks a plane) and ``_lead``, the bits above the digit that count, or NULL for all. A slice
    gives at most ``2 ** width`` counters per candidate, whatever its points.
    """
    keys = [*by, "_part"]
    schema = T.StructType([*[parts.schema[k] for k in keys], T.StructField("_cand", T.IntegerType()),
                           T.StructField("_digit", T.LongType()), T.StructField("_count", T.LongType())])

    def count(table: pa.Table) -> pa.Table:
        cands, digits, counts = [], [], []
        flat = table.column("_xyz").combine_chunks().flatten()
        pts = np.column_stack([flat.field(a).to_numpy(zero_copy_only=False) for a in "xyz"])
        row = table.select(["_params", "_cands", "_lead"]).slice(0, 1).to_pylist()[0]
        for n, c in enumerate(np.asarray(row["_params"], float).reshape(-1, 7)):
            delta = pts - c[:3]
            e = np.abs(delta @ c[3:6]) if c[6] < 0 else np.abs(np.sqrt((delta * delta).sum(axis=1)) - c[6])
            bits = e.view(np.int64)
            if row["_lead"] is not None:
                bits = bits[bits >> shift + width == row["_lead"][n]]
            found = np.bincount(bits >> shift & (1 << width) - 1, minlength=1)
            held = np.flatnonzero(found)
            cands.append(np.full(len(held), row["_cands"][n]))
            digits.append(held)
            counts.append(found[held])
        cands = np.concatenate(cands).astype(np.int32)
        first = pa.array(np.zeros(len(cands), np.int64))
        return pa.Table.from_arrays(
            [*[table.column(k).combine_chunks().take(first) for k in keys], pa.array(cands), pa.array(np.concatenate(digits)),
             pa.array(np.concatenate(counts))], names=schema.names)

    rows = join_on(parts.select(*keys, "_xyz"), pools.select(*by, "_cands", "_params", "_lead"), by)
    # Slices are few bytes and much work: a fixed number of partitions is not merged into fewer tasks.
    dealt = rows.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    counts = dealt.groupBy(*keys).applyInArrow(count, schema)
    return counts.groupBy(*by, "_cand", "_digit").agg(F.sum("_count").alias("_count"))


def best_candidates(points: DataFrame, pools: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``_best``: index of the candidate with the smallest upper median of absolute residuals over all
    points, the earlier one in a tie.

    Medians are found digit by digit, for all candidates of all clouds together. After each digit only candidates stay
    open whose median has the smallest one so far: the lower bound of any other already exceeds their upper bound.
    """
    parts = _slices(points, by)
    totals = parts.groupBy(*by).agg(F.first("_n").alias("_n"))
    shapes = F.transform(F.sequence(F.lit(0), F.expr("cast(size(_params) div 7 as int)") - 1), lambda i: F.struct(
        i.alias("c"), F.slice("_params", i * 7 + 1, 7).alias("p"), F.lit(None).cast("long").alias("lead"), F.col("_n").alias("n")))
    state = join_on(pools.filter(F.size("_params") > 0), totals, by).select(
        *by, F.transform(shapes, lambda c: F.struct(c["c"], c["p"], c["lead"], F.shiftright(c["n"], 1).alias("rank"))).alias("_open"))
    state = cut_lineage(state)
    for at, (shift, width) in enumerate(DIGITS):
        pool = state.select(
            *by, F.transform("_open", lambda c: c["c"]).alias("_cands"), F.flatten(F.transform("_open", lambda c: c["p"])).alias("_params"),
            F.lit(None).cast("array<bigint>").alias("_lead") if at == 0 else F.transform("_open", lambda c: c["lead"]).alias("_lead"))
        known = state.select(*by, F.explode("_open").alias("_c")).select(*by, F.col("_c.c").alias("_cand"), "_c")
        counts = join_on(_digit_counts(parts, pool, by, shift, width), known, [*by, "_cand"])
        upto = F.sum("_count").over(Window.partitionBy(*by, "_cand").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        run = counts.withColumn("_upto", upto)
        rank = F.col("_c.rank")
        hit = run.filter((F.col("_upto") > rank) & (F.col("_upto") - F.col("_count") <= rank))
        lead = F.shiftleft(F.coalesce(F.col("_c.lead"), F.lit(0).cast("long")), width) + F.col("_digit")
        left = hit.select(*by, "_digit", F.struct(
            F.col("_c.c").alias("c"), F.col("_c.p").alias("p"), lead.alias("lead"), (rank - F.col("_upto") + F.col("_count")).alias("rank")).alias("_c"))
        least = left.withColumn("_least", F.min("_digit").over(Window.partitionBy(*by))).filter("_digit = _least")
        before, state = state, cut_lineage(least.groupBy(*by).agg(F.array_sort(F.collect_list("_c")).alias("_open")))
        release(before)
        if not state.filter(F.size("_open") > 1).limit(1).count():
            break
    release(parts)
    return state.select(*by, F.get("_open", F.lit(0))["c"].alias("_best"))


STEPPED = T.StructType([
    T.StructField("center", VEC3), T.StructField("direction", VEC3), T.StructField("u", VEC3), T.StructField("v", VEC3),
    T.StructField("radius", T.DoubleType()), T.StructField("state", T.StringType())])


@F.pandas_udf(STEPPED)
def take_step(matrix: pd.Series, right: pd.Series, start: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """New models of already summed clouds."""
    rows = [gauss_newton(m, b, s, k) for m, b, s, k in zip(matrix, right, start, kind)]
    return pd.DataFrame(rows, columns=STEPPED.names)


def _refine_small(points: DataFrame, moving: DataFrame, kind: str, by: Sequence[str]) -> DataFrame:
    """All steps of clouds that fit into one task, in one job. The steps are those of ``refine``."""
    schema = moving.select(*by, "center", "direction", "radius", "state").schema
    keys = [f"_own_{k}" for k in by]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in schema.names})
        pts, row = left[["x", "y", "z"]].to_numpy(float), right.iloc[0]
        c, d, r, state = dict(row["center"]), dict(row["direction"]), row["radius"], row["state"]
        for _ in range(REFINE_STEPS):
            if state != "open":
                break
            at = [*(c[a] for a in "xyz"), *(d[a] for a in "xyz"), r]
            sums, n = measure(("gauss", None, np.array(at[:3]), np.array(at[3:6]), r, kind), pts)[0], 4 if kind == "sphere" else 5
            c, d, _, _, r, state = gauss_newton(*((sums[1:-n], sums[-n:]) if sums[0] else (None, None)), at, kind)
        out = pd.DataFrame({"center": [c], "direction": [d], "radius": [r], "state": [state]})
        for name, value in zip(by, key):
            out[name] = value
        return out[schema.names]

    left = points.select(*by, "x", "y", "z")
    right = moving.select(*[F.col(k).alias(f"_own_{k}") for k in by], "center", "direction", "radius", "state")
    return left.groupBy(*by).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def refine(points: DataFrame, models: DataFrame, kind: str, by: Sequence[str]) -> DataFrame:
    """Gauss-Newton on the geometric distance over all ``points``, at most ``REFINE_STEPS`` steps.

    Clouds of at most ``TASK_POINTS`` points take all steps in one task each; for larger ones each step is one grouped
    aggregate of the normal equations of every cloud that still moves. Both take the same steps."""
    if kind not in ("sphere", "cylinder"):
        return models

    def start() -> Column:
        return F.array(*fields("center"), *fields("direction"), F.col("radius"))

    none = F.lit(None).cast("array<double>")
    first = models.filter("failure IS NULL").select(*by, take_step(none, none, start(), F.lit(kind)).alias("_f"))
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    both = cut_lineage(join_on(first.select(*by, "_f.*"), sizes, by))
    small = both.filter(F.col("_size") <= TASK_POINTS)
    near = join_on(points.select(*by, "x", "y", "z"), small.select(*by), by)
    ended = cut_lineage(_refine_small(near, small, kind, by))
    moving = both.filter(F.col("_size") > TASK_POINTS).drop("_size")
    shape = ("center", "direction", "radius", "state")
    for _ in range(0 if moving.isEmpty() else REFINE_STEPS):
        at = _attach(points.select(*by, "x", "y", "z"), moving.select(*by, F.struct("center", "direction", "u", "v", "radius").alias("_g")), by)
        g = F.col("_g")
        delta = sub(vec("x", "y", "z"), fields(g["center"]))
        if kind == "sphere":
            radial, t = delta, F.lit(0.0)
        else:
            t = dot(delta, fields(g["direction"]))
            radial = sub(delta, scale(fields(g["direction"]), t))
        rows = at.select(*by, *[c.alias(f"_r{a}") for a, c in zip("xyz", radial)], t.alias("_t"), "_g")
        rows = rows.withColumn("_l", F.sqrt(dot(vec("_rx", "_ry", "_rz"), vec("_rx", "_ry", "_rz")))).filter("_l >= 1e-12")
        normal = scale(vec("_rx", "_ry", "_rz"), 1.0 / F.col("_l"))
        if kind == "sphere":
            terms = [-normal[0], -normal[1], -normal[2], F.lit(-1.0)]
        else:
            nu, nv = dot(normal, fields(g["u"])), dot(normal, fields(g["v"]))
            terms = [-nu, -nv, -F.col("_t") * nu, -F.col("_t") * nv, F.lit(-1.0)]
        rows = rows.select(*by, *[x.alias(f"_j{i}") for i, x in enumerate(terms)], (g["radius"] - F.col("_l")).alias("_e"))
        sums = rows.groupBy(*by).agg(*_normal_sums([F.col(f"_j{i}") for i in range(len(terms))], F.col("_e")))
        stepped = join_on(moving, sums, by, "left").select(
            *by, take_step("_m", "_b", start(), F.lit(kind)).alias("_f"))
        seen = Observation()
        stepped = cut_lineage(stepped.select(*by, "_f.*").observe(seen, F.count_if(F.col("state") == "open").alias("open")))
        ended = ended.unionByName(stepped.filter("state <> 'open'").select(*by, *shape))
        moving = stepped.filter("state = 'open'")
        if not seen.get["open"]:
            break
    steps = ended.unionByName(moving.select(*by, *shape)).select(*by, F.struct(*shape).alias("_f"))
    out = join_on(models, steps, by, "left")
    f = F.col("_f")
    return out.withColumns({
        "center": F.coalesce(f["center"], F.col("center")),
        "direction": F.when(f.isNotNull(), pack(orient(fields(f["direction"])))).otherwise(F.col("direction")),
        "radius": F.coalesce(f["radius"], F.col("radius")),
        "failure": F.when(f["state"] == "failed", "not_converged").otherwise(F.col("failure")),
    }).drop("_f")


FITTED = T.StructType([
    *[T.StructField(n, t) for n, t in MODEL_COLUMNS.items()], T.StructField("failure", T.StringType()),
    *[T.StructField(n, T.LongType() if n == "n" else T.DoubleType()) for n in STATS]])


def _fitted(m: dict) -> dict:
    """A model as a row of ``FITTED``."""
    row = {n: m.get(n) for n in FITTED.names}
    for name, value in row.items():
        if isinstance(value, np.ndarray):
            row[name] = value.tolist() if name == "coefficients" else dict(zip("xyz", value.tolist()))
        elif isinstance(value, np.floating):
            row[name] = float(value)
    return row


def _fit_small(points: DataFrame, kind: str, by: Sequence[str], diameter: float, seed: int, draw: Sequence[str]) -> DataFrame:
    """Fits of clouds that fit into one task each."""
    least, random = MINIMUM_POINTS[kind], kind in ("plane", "sphere")
    schema = T.StructType([*[points.schema[k] for k in by], *FITTED])
    arrow = to_arrow_schema(FITTED)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = [*by, *FITTED.names]
        if table.num_rows < least:
            return pa.Table.from_arrays([*[table.column(k).slice(0, 0) for k in by], *[pa.array([], f.type) for f in arrow]], names=names)
        pts = np.column_stack([table.column(a).to_numpy() for a in "xyz"])
        subsets = np.zeros((0, least, 3))
        if random:
            order = np.argsort(table.column("point_id").to_numpy(), kind="stable")
            subsets = pts[order[drawn(table.column("_h")[0].as_py(), len(pts), least)]]
        with np.errstate(all="ignore"):
            row = _fitted(run_whole(steps(kind, len(pts), pts.mean(axis=0), subsets, diameter, True), pts))
        return pa.Table.from_arrays([*[table.column(k).slice(0, 1) for k in by], *[pa.array([row[f.name]], f.type) for f in arrow]], names=names)

    # Clouds are few bytes and much work: a fixed number of partitions is not merged into fewer tasks.
    dealt = points.withColumn("_h", F.xxhash64(*draw, F.lit(seed))).repartition(
        int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return dealt.groupBy(*by, "_h").applyInArrow(run, schema)


def _rows_of_keys(table: pa.Table, by: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Which rows of a batch each cloud has."""
    codes = np.zeros(table.num_rows, np.int64)
    for k in by:
        values = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * (len(values.dictionary) + 1) + values.indices.to_numpy()
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []
    return {tuple(table.column(k)[int(p[0])].as_py() for k in by): p for p in parts}


def _packed(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of up to ``SCORE_SLICE`` points of a cloud, ``_xyz``, as they stand in their tasks: nothing is shuffled."""
    keys = [points.schema[k] for k in by]
    schema, size = T.StructType([*keys, T.StructField("_xyz", T.BinaryType())]), SCORE_SLICE
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        counts: dict[tuple, int] = {}

        def row(key: tuple) -> pa.RecordBatch:
            data = np.concatenate(held.pop(key)).tobytes()
            del counts[key]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, data), arrow)], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            pts = np.column_stack([table.column(a).to_numpy() for a in "xyz"])
            for key, rows in _rows_of_keys(table, by).items():
                held.setdefault(key, []).append(pts[rows])
                counts[key] = counts.get(key, 0) + len(rows)
                if counts[key] >= size:
                    yield row(key)
            if sum(counts.values()) * 24 > HELD_BYTES:
                yield from [row(key) for key in list(held)]
        yield from [row(key) for key in list(held)]

    return points.select(*by, "x", "y", "z").mapInArrow(pack, schema)


def _summed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of each cloud's request ``_ask`` over its packed points: arrays of places, sums and largest values (at places below 0).
    The last place is the number of sums; sums of 0 are left out."""
    schema = T.StructType([*[parts.schema[k] for k in by], T.StructField("_at", T.LongType()), T.StructField("_sum", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for key, (sums, most) in held.items():
                at = np.concatenate([np.flatnonzero(sums), [len(sums)], -1 - np.arange(len(most))]).astype(np.int64)
                values = np.concatenate([sums[np.flatnonzero(sums)], [0.0], most])
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v] * len(at), f.type) for v, f in zip(key, arrow)], pa.array(at), pa.array(values)], schema=arrow)
            held.clear()

        with np.errstate(all="ignore"):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for i in range(table.num_rows):
                    key = tuple(table.column(k)[i].as_py() for k in by)
                    ask = pickle.loads(table.column("_ask")[i].as_py())
                    sums, most = measure(ask, np.frombuffer(table.column("_xyz")[i].as_buffer(), float).reshape(-1, 3))
                    if key in held:
                        before = held[key]
                        sums, most = before[0] + sums, np.maximum(before[1], most)
                    held[key] = [sums, most]
                    if sum(h[0].nbytes for h in held.values()) > HELD_BYTES:
                        yield from rows()
            yield from rows()

    sums = parts.mapInArrow(add, schema).groupBy(*by, "_at").agg(
        F.when(F.col("_at") >= 0, F.sum("_sum")).otherwise(F.max("_sum")).alias("_sum"))
    return sums.groupBy(*by).agg(F.collect_list(F.struct("_at", "_sum")).alias("_s")).select(
        *by, F.col("_s._at").alias("_at"), F.col("_s._sum").alias("_sum"))


def _fit_large(
    points: DataFrame, totals: DataFrame, kind: str, by: Sequence[str], diameter: float, seed: int, draw: Sequence[str]
) -> DataFrame:
    """The same steps for clouds of any size: each pass answers one request of every cloud that is not ready. The passes run in a session of
    their own, whose batches for Python are small: the default of 64 MB takes more memory and twice the time."""
    points = join_on(points, totals.select(*by), by)
    parts, least = cut_lineage(_packed(points, by), PACKED_ROWS), MINIMUM_POINTS[kind]
    state = totals.select(*by, "_n", F.array("_x", "_y", "_z").alias("_origin"))
    if kind in ("plane", "sphere"):
        rows = ordered.row_number(points, by, ["point_id"], "_row", ordered.point_slice()).withColumn("_i", F.col("_row") - 1)
        picks = _candidate_subsets(rows, totals.select(*by, "_n"), kind, by, seed, draw).groupBy(*by, "_cand").agg(
            F.array_sort(F.collect_list(F.struct("_i", "x", "y", "z"))).alias("_p")).filter(F.size("_p") == least)
        flat = F.flatten(F.transform("_p", lambda p: F.array(p["x"], p["y"], p["z"])))
        picks = picks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_cand", flat.alias("_f")))).alias("_c"))
        state = join_on(state, picks.select(*by, F.flatten("_c._f").alias("_picks")), by, "left")
    else:
        state = state.withColumn("_picks", F.lit(None).cast("array<double>"))
    keys = [totals.schema[k] for k in by]
    kept = T.StructType([*keys, T.StructField("_n", T.LongType()), T.StructField("_origin", T.ArrayType(T.DoubleType())),
                         T.StructField("_picks", T.ArrayType(T.DoubleType())), T.StructField("_told", T.BinaryType()),
                         T.StructField("_ask", T.BinaryType()), T.StructField("_m", FITTED)])
    arrow = to_arrow_schema(kept)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                told = pickle.loads(row["_told"]) if row["_told"] else []
                if row["_ask"]:
                    at, values = np.array(row["_at"]), np.array(row["_sum"])
                    sums, most = np.zeros(at.max()), np.zeros((at < 0).sum())
                    held = (at >= 0) & (at < at.max())
                    sums[at[held]], most[-1 - at[at < 0]] = values[held], values[at < 0]
                    told.append(close(pickle.loads(row["_ask"]), np.concatenate([sums, most])))
                subsets = np.array(row["_picks"] or []).reshape(-1, least, 3)
                with np.errstate(all="ignore"):
                    ask, m = replay(steps(kind, row["_n"], np.array(row["_origin"]), subsets, diameter, False), told)
                row |= {"_told": pickle.dumps(told), "_ask": ask and pickle.dumps(ask), "_m": m and _fitted(m)}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

    spark, none = parts.sparkSession, F.lit(None)
    session, state = own_session(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(SENT_BYTES)), cut_lineage(state)
    parts, state, first = reread(session, parts), reread(session, state), state
    start = state.withColumns({"_told": none.cast("binary"), "_ask": none.cast("binary"), "_at": none.cast("array<bigint>"),
                               "_sum": none.cast("array<double>")})
    ready, tables = None, [first]
    while True:
        seen = Observation()
        state = cut_lineage(start.mapInArrow(advance, kept).observe(seen, F.count_if(F.col("_ask").isNotNull()).alias("open")))
        tables.append(state)
        done = state.filter("_ask IS NULL").select(*by, "_m.*")
        ready = done if ready is None else ready.unionByName(done)
        if not seen.get["open"]:
            break
        going = state.filter("_ask IS NOT NULL")
        start = join_on(going.drop("_m"), _summed(join_on(parts, going.select(*by, "_ask"), by), by), by)
    out = cut_lineage(ready)
    release(parts, *tables)
    return reread(spark, out)


def fit(
    df: DataFrame, kind: str, by: Sequence[str] = ("cloud_id",), standard_diameter: float = 0.0, seed: int = 12345,
    draw: Sequence[str] | None = None,
) -> DataFrame:
    """Fit one shape to every cloud: solve, robust start or refinement, trimmed refits, then
    statistics, all over every finite point. Clouds of up to ``TASK_POINTS`` points take all steps in one task; larger
    ones are packed once, and each step sums over the packed points of all of them. Eager for the latter. Random candidates come from
    the hash of ``draw``, or else of ``by``.

    Returns one model row per cloud; ``failure`` tells why a cloud has no model
    (``too_few``, ``degenerate``, ``rank``, ``radius``, ``not_converged``).
    """
    if kind not in MINIMUM_POINTS:
        raise ValueError(f"unknown kind {kind}")
    if not np.isfinite(standard_diameter) or standard_diameter < 0:
        raise ValueError("standard diameter must not be negative")
    keys = list(by)
    draw = list(draw or by)
    df = computed_once(df.select(*keys, "point_id", "x", "y", "z"))
    pts = filter_finite(df)
    # Clouds without a finite point count too: they have no model.
    finite = F.col("_finite")
    marked = df.select(*keys, "x", "y", "z", is_finite("x", "y", "z").alias("_finite"))
    totals = cut_lineage(marked.groupBy(*keys).agg(
        F.count_if(finite).alias("_n"), *[F.avg(F.when(finite, F.col(a))).alias(f"_{a}") for a in "xyz"]))
    bound = max(TASK_POINTS, MINIMUM_POINTS[kind] - 1)
    large = totals.filter(F.col("_n") > bound)
    diameter = float(standard_diameter) if kind in ("sphere", "cylinder") else 0.0
    if large.isEmpty():
        models = _fit_small(pts, kind, keys, diameter, seed, draw)
    else:
        models = _fit_large(pts, large, kind, keys, diameter, seed, draw)
        small = totals.filter(F.col("_n") <= bound)
        if not small.isEmpty():
            models = models.unionByName(_fit_small(join_on(pts, small.select(*keys), keys), kind, keys, diameter, seed, draw))
    out = join_on(totals.select(*keys), models, keys, "left")
    return out.select(
        *keys, *[c for c in MODEL_COLUMNS if c != "standard_diameter"], F.when(F.col("kind").isNull(), "too_few").otherwise(
            F.col("failure")).alias("failure"), "standard_diameter", *STATS).withColumn("kind", F.lit(kind))


def fit_double_sphere(
    df: DataFrame, standard_diameter: float = 0.0, by: Sequence[str] = ("cloud_id",)
) -> tuple[DataFrame, DataFrame]:
    """Split each cloud at the upper median along its longest axis (at most the median goes
    first) and fit a sphere to either half. Clouds under eight points are left out. Both halves take their steps together."""
    keys = list(by)
    pts = filter_finite(computed_once(df))
    axes = cut_lineage(pca(pts, keys).filter("n >= 8").select(*keys, "center", "axis2"))
    placed = salted_join(pts, axes, keys, spread=["x", "y", "z"])
    along = dot(sub(vec("x", "y", "z"), fields("center")), fields("axis2"))
    placed = cut_lineage(placed.select(*keys, "point_id", "x", "y", "z", along.alias("_t")))
    middle = upper_medians(placed, keys, "_t", "_middle")
    sides = salted_join(placed, middle, keys, spread=["x", "y", "z"]).filter("_t IS NOT NULL AND _middle IS NOT NULL")
    sides = sides.select(*keys, (F.col("_t") > F.col("_middle")).alias("_second"), "point_id", "x", "y", "z")
    both = cut_lineage(fit(sides, "sphere", [*keys, "_second"], standard_diameter, draw=keys))
    release(placed)
    return both.filter("NOT _second").drop("_second"), both.filter("_second").drop("_second")
