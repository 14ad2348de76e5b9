"""Stereo reconstruction: pairing, undistortion, epipolar matching, triangulation and
per-frame diagnostics.

Line observations are rows ``(frame keys, side, obs_id, u, v)``. A calibration is one row
per rig: row-major arrays ``k1, k2, p1, p2, r`` (9), ``d1, d2`` (5) and ``t`` (3).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.functions.vec import Vec, add, cross, dot, entry, finite, inverse3, pack, ratio, scale, sub, unit, vec
from cloudgauge.operators import ordered
from cloudgauge.operators.fit import orthogonal
from cloudgauge.session import cut_lineage, join_on, salted_join

# Fixed values of matching and logging.
MATCH_THRESHOLD = 0.5
UNDISTORT_STEPS = 5
DIAGNOSTIC_FULL = 200
DIAGNOSTIC_HEAD = 10
DIAGNOSTIC_EVERY = 50
BLOCK = 8
#: Observations of a frame that are matched in one task, and numbers that one step of it holds.
WHOLE, STEP_NUMBERS = 200_000, 1 << 20
# Azimuths about the baseline (radians) that agree this well are equal; their error is rounding only.
SAME_AZIMUTH = 1e-12
AZIMUTH_CELL = 1e-11
AZIMUTH_ROUNDING = 4e-15

FRAME = ("frame_id",)


def with_params(df: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach parameter rows; a key without parameters is an error. Spark broadcasts the
    table when its own size estimate says that it is small."""
    known = params.withColumn("_known", F.lit(True))
    joined = df.join(known, list(keys), "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.lit("no parameters for a key"))).otherwise(F.lit(True))
    return joined.filter(checked).drop("_known")


def pair_by_rank(left: DataFrame, right: DataFrame, by: Sequence[str], rank: str = "rank") -> DataFrame:
    """Positional pairs of two ranked manifests: equal ranks meet, the longer side is cut."""
    a = left.select(*by, rank, F.col("path").alias("left_path"))
    b = right.select(*by, rank, F.col("path").alias("right_path"))
    return a.join(b, [*by, rank])


def pair_warnings(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per group and whether they differ or leave nothing to pair."""
    counts = left.select(*by, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*by, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    out = counts.groupBy(*by).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    state = F.when(F.least("n_left", "n_right") == 0, "no_pairs").when(
        F.col("n_left") != F.col("n_right"), "counts_differ").otherwise("ok")
    return out.withColumn("state", state)


# -- camera model --------------------------------------------------------------------


def undistort(df: DataFrame, u: str, v: str, k: str, d: str, p: str) -> DataFrame:
    """Replace pixel columns by undistorted ones: five fixed-point steps of the five
    parameter lens model, then projection with ``p``."""
    c = [entry(d, 0, i, 5) for i in range(5)]
    x0 = (F.col(u) - entry(k, 0, 2)) / entry(k, 0, 0)
    y0 = (F.col(v) - entry(k, 1, 2)) / entry(k, 1, 1)

    def step(at: Column, _: Column) -> Column:
        x, y = at["x"], at["y"]
        r2 = x * x + y * y
        inv = F.lit(1.0) / (1 + ((c[4] * r2 + c[1]) * r2 + c[0]) * r2)
        dx = 2 * c[2] * x * y + c[3] * (r2 + 2 * x * x)
        dy = c[2] * (r2 + 2 * y * y) + 2 * c[3] * x * y
        return F.struct(((x0 - dx) * inv).alias("x"), ((y0 - dy) * inv).alias("y"))

    # A fold keeps the expression small; five nested projections would multiply when the
    # optimizer pushes a null check on the result down to the scan.
    rounds = F.array(*[F.lit(i) for i in range(UNDISTORT_STEPS)])
    df = df.withColumn("_s", F.aggregate(rounds, F.struct(x0.alias("x"), y0.alias("y")), step))
    x, y = F.col("_s.x"), F.col("_s.y")
    rows = [entry(p, i, 0) * x + entry(p, i, 1) * y + entry(p, i, 2) for i in range(3)]
    return df.withColumns({u: rows[0] / rows[2], v: rows[1] / rows[2]}).drop("_s")


def undistort_observations(obs: DataFrame, calibrations: DataFrame, rig: Sequence[str] = ("rig_id",)) -> DataFrame:
    """Undistort both sides with the camera of their side."""
    joined = with_params(obs, calibrations, rig)
    left = F.col("side") == "left"
    staged = joined.withColumns({
        "_k": F.when(left, F.col("k1")).otherwise(F.col("k2")), "_d": F.when(left, F.col("d1")).otherwise(F.col("d2")),
        "_p": F.when(left, F.col("p1")).otherwise(F.col("p2"))})
    return undistort(staged, "u", "v", "_k", "_d", "_p").select(*obs.columns)


def pixel_ray(u: Column, v: Column, k: str | Column) -> Vec:
    """Unit ray of a pixel."""
    return unit(((u - entry(k, 0, 2)) / entry(k, 0, 0), (v - entry(k, 1, 2)) / entry(k, 1, 1), F.lit(1.0)))


def _scalars(calibrations: DataFrame, rig: Sequence[str], inverse: bool = False) -> DataFrame:
    """Entries of the camera matrices, rotation and translation as plain columns, with the inverse rotation on
    request. They are worked out once per rig, before the join, so that the code per point stays small."""
    out = {f"_{k}_{n}": entry(k, *at) for k in ("k1", "k2") for n, at in (("fx", (0, 0)), ("fy", (1, 1)), ("cx", (0, 2)), ("cy", (1, 2)))}
    out |= {f"_r{i}{j}": entry("r", i, j) for i in range(3) for j in range(3)}
    out |= {f"_t{a}": F.element_at("t", i + 1) for i, a in enumerate("xyz")}
    out |= {f"_u{a}": c for a, c in zip("xyz", unit(tuple(F.element_at("t", i + 1) for i in range(3))))}
    if inverse:
        out |= {f"_i{i}{j}": c for i, row in enumerate(inverse3("r")) for j, c in enumerate(row)}
    return calibrations.select(*rig, *[c.alias(n) for n, c in out.items()])


def _ray(u: str, v: str, k: str) -> Vec:
    """Unit ray of a pixel with the columns of ``_scalars``."""
    return unit((
        (F.col(u) - F.col(f"_{k}_cx")) / F.col(f"_{k}_fx"), (F.col(v) - F.col(f"_{k}_cy")) / F.col(f"_{k}_fy"), F.lit(1.0)))


def _times(name: str, v: Vec) -> Vec:
    return tuple(dot(tuple(F.col(f"{name}{i}{j}") for j in range(3)), v) for i in range(3))


def observation_rays(obs: DataFrame, calibrations: DataFrame, rig: Sequence[str] = ("rig_id",)) -> DataFrame:
    """Rays of both sides in the right camera's frame, as ``rx, ry, rz``, with the unit
    baseline ``bx, by, bz``."""
    joined = with_params(obs, _scalars(calibrations, rig), rig)
    left, right = _ray("u", "v", "k1"), _ray("u", "v", "k2")
    is_left = F.col("side") == "left"
    staged = joined.withColumns({f"_l{a}": c for a, c in zip("xyz", left)})
    turned = _times("_r", vec("_lx", "_ly", "_lz"))
    base = vec("_ux", "_uy", "_uz")
    out = staged.withColumns({
        **{f"r{a}": F.when(is_left, tl).otherwise(r) for a, tl, r in zip("xyz", turned, right)},
        **{f"b{a}": c for a, c in zip("xyz", base)},
    })
    return out.select(*obs.columns, "rx", "ry", "rz", "bx", "by", "bz")


# -- epipolar matching ---------------------------------------------------------------


def _roles(rays: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mark the side with fewer observations (left on a tie) as the driving one; frames
    with an empty side fall out."""
    counts = rays.groupBy(*by).agg(
        *[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"_{s[0]}") for s in ("left", "right")])
    driver = F.when(F.col("_l") <= F.col("_r"), "left").otherwise("right")
    counts = counts.filter("_l > 0 AND _r > 0").select(*by, driver.alias("_driver"))
    return salted_join(rays, counts, by, spread=["u", "v"]).withColumn("_drives", F.col("side") == F.col("_driver"))


def _error(a: Vec, b: Vec, base: Vec) -> Column:
    return F.abs(dot(cross(a, b), base))


def _oriented(best: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """From (driving, found) to (left, right), accepted below the threshold only."""
    left_drives = F.col("side") == "left"
    m = F.col("_m")

    def pick(mine: str, other: str, name: str, on_left: bool) -> Column:
        drives = left_drives if on_left else ~left_drives
        return F.when(drives, F.col(mine)).otherwise(m[other]).alias(name)

    return best.filter(m["err"] < threshold).select(
        *by, pick("obs_id", "obs", "left_obs", True), pick("obs_id", "obs", "right_obs", False),
        pick("u", "u", "left_u", True), pick("v", "v", "left_v", True),
        pick("u", "u", "right_u", False), pick("v", "v", "right_v", False), m["err"].alias("error"))


def _same_azimuth(drive: DataFrame, found: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """For each driving observation the lowest searched id of the same azimuth, as ``_same``. Azimuths 0 and pi are one."""
    first = found.groupBy(*by, F.col("_phi").alias("_there")).agg(F.min(hit).alias("_same"))
    first = first.withColumn("_cell", F.floor(F.col("_there") / AZIMUTH_CELL))
    phi = F.col("_phi")
    turns = F.filter(F.array(phi, phi + F.pi(), phi - F.pi()),
                     lambda a: (a > -AZIMUTH_CELL) & (a < F.pi() + AZIMUTH_CELL))
    here = drive.select(*by, "obs_id", F.explode(turns).alias("_here"))
    cells = F.array_distinct(F.array(*[F.floor((F.col("_here") + d) / AZIMUTH_CELL) for d in (-SAME_AZIMUTH, SAME_AZIMUTH)]))
    near = here.withColumn("_cell", F.explode(cells)).join(first, [*by, "_cell"])
    near = near.filter(F.abs(F.col("_here") - F.col("_there")) <= SAME_AZIMUTH)
    return near.groupBy(*by, "obs_id").agg(F.min("_same").alias("_same"))


def _lowest_within(start: np.ndarray, end: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The lowest of ``ranks[start:end]`` per row, ``len(ranks)`` for an empty range; from minima of runs of 1, 2, 4, ..."""
    out, runs, width = np.full(len(start), len(ranks)), ranks, 1
    while width <= len(ranks) and (end - start >= width).any():
        fits = (end - start >= width) & (end - start < 2 * width)
        out[fits] = np.minimum(runs[start[fits]], runs[end[fits] - width])
        runs, width = np.minimum(runs[:-width], runs[width:]), 2 * width
    return out


def _match_rays(mine: np.ndarray, phi: np.ndarray, size: np.ndarray, others: np.ndarray, there: np.ndarray,
                sizes: np.ndarray, base: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index and error of the best of ``others`` for each ray of ``mine``; the lowest index among equals.

    A window of neighbours in azimuth is compared, and widened by 8 while its ends bound less than its best."""
    best, error = np.zeros(len(mine), np.int64), np.zeros(len(mine))
    axis, axes = size <= SAME_AZIMUTH, np.flatnonzero(sizes <= SAME_AZIMUTH)
    off = np.flatnonzero(sizes > SAME_AZIMUTH)
    line = off[np.argsort(there[off], kind="stable")]
    around, turned = there[line], np.concatenate([line, line, line])
    angles = np.concatenate([around - np.pi, around, around + np.pi])
    same = _lowest_within(np.searchsorted(angles, phi - SAME_AZIMUTH), np.searchsorted(angles, phi + SAME_AZIMUTH, "right"), turned)
    same = np.where(same < len(angles), same, len(others))
    if len(axes):
        same = np.minimum(same, axes[0])
    same[axis] = 0
    known = same < len(others)
    best[known] = same[known]
    left, width, n = np.flatnonzero(~known), BLOCK, len(line)
    while len(left):
        whole, waiting = 2 * width >= n, []
        span = np.arange(n) if whole else np.arange(-width, width)
        step = max(1, STEP_NUMBERS // len(span))
        for at in range(0, len(left), step):
            rows = left[at:at + step]
            place = np.searchsorted(around, phi[rows])
            near = line[(place[:, None] + span[None, :]) % n]
            a, b = mine[rows].T[:, :, None], others[near].transpose(2, 0, 1)
            gaps = np.abs((a[1] * b[2] - a[2] * b[1]) * base[0] + (a[2] * b[0] - a[0] * b[2]) * base[1]
                          + (a[0] * b[1] - a[1] * b[0]) * base[2])
            least = gaps.min(axis=1)
            best[rows] = np.where(gaps == least[:, None], near, len(others)).min(axis=1)
            error[rows] = least
            if not whole:
                ends = [(phi[rows] - around[(place - width) % n]) % np.pi, (around[(place + width - 1) % n] - phi[rows]) % np.pi]
                reach = np.minimum(*np.sin(ends)) - AZIMUTH_ROUNDING
                bound = size[rows] * sizes[line].min() * np.maximum(reach, 0.0)
                waiting.append(rows[(least >= bound * (1 - 1e-9)) & (bound < threshold)])
        left, width = np.concatenate([np.empty(0, np.int64), *waiting]), 8 * width
    return best, error


def _match_whole(rays: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """``epipolar_match`` of frames that one task holds; equal rays of a side are compared once."""
    kinds = {f.name: f.dataType for f in rays.schema.fields}
    columns = ["left_obs", "right_obs", "left_u", "left_v", "right_u", "right_v"]
    of = {c: {"obs": "obs_id"}.get(c.split("_")[1], c.split("_")[1]) for c in columns}
    schema = T.StructType([*[rays.schema[c] for c in by], *[T.StructField(c, kinds[of[c]]) for c in columns],
                           T.StructField("error", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("obs_id", "u", "v")])
        is_left, is_right = (np.asarray(table.column("side").to_pandas() == s) for s in ("left", "right"))
        left_drives = is_left.sum() <= is_right.sum()
        n = {c: table.column(c).to_numpy() for c in ("rx", "ry", "rz", "bx", "by", "bz", "_phi", "_len")}
        usable = np.isfinite(n["_phi"]) & np.isfinite(n["_len"])
        drive, found = (np.flatnonzero(usable & s) for s in ((is_left, is_right) if left_drives else (is_right, is_left)))
        pairs, errors = np.empty((2, 0), np.int64), np.empty(0)
        if len(drive) and len(found):
            xyz = np.column_stack([n[f"r{a}"] for a in "xyz"])
            _, first, copies = np.unique(xyz[drive], axis=0, return_index=True, return_inverse=True)
            once = drive[first]
            kept = found[np.sort(np.unique(xyz[found], axis=0, return_index=True)[1])]
            best, error = _match_rays(xyz[once], n["_phi"][once], n["_len"][once], xyz[kept], n["_phi"][kept], n["_len"][kept],
                                      np.array([n[f"b{a}"][drive[0]] for a in "xyz"]), threshold)
            best, error = kept[best][copies.ravel()], error[copies.ravel()]
            near = error < threshold
            pairs, errors = np.stack([drive[near], best[near]]), error[near]
        sides = dict(zip(("left", "right"), pairs if left_drives else pairs[::-1]))
        data = {c: table.column(c).take(pa.array(pairs[0])) for c in by}
        data |= {c: table.column(of[c]).take(pa.array(sides[c.split("_")[0]])) for c in columns}
        return pa.table({**data, "error": pa.array(errors, pa.float64())})

    return rays.groupBy(*by).applyInArrow(run, schema)


def epipolar_match(
    obs: DataFrame,
    calibrations: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    by: Sequence[str] = FRAME,
    rig: Sequence[str] = ("rig_id",),
) -> DataFrame:
    """For each observation of the smaller side the observation of the other side with the
    smallest epipolar error (lowest id on ties), if the error is below ``threshold``.

    Observations of the same azimuth about the baseline (to ``SAME_AZIMUTH``), or on the baseline, have the error 0;
    one lowest id per azimuth answers them, so a line along the epipolar direction costs its observations, not their
    pairs. A frame of at most ``WHOLE`` observations is matched in one task, after one shuffle of its observations; in
    larger ones only blocks meet.
    """
    known = obs.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    wanted = list(dict.fromkeys([*by, *rig, "side", "obs_id", "u", "v"]))
    known = cut_lineage(known.select(*wanted))
    large = cut_lineage(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE).select(*by))
    if large.isEmpty():
        return _match_whole(_azimuths(observation_rays(known.repartition(*by), calibrations, rig)), by, threshold)
    few, many = known.join(large, list(by), "left_anti"), known.join(large, list(by), "left_semi")
    whole = _match_whole(_azimuths(observation_rays(few.repartition(*by), calibrations, rig)), by, threshold)
    return whole.unionByName(_match_blocks(observation_rays(many, calibrations, rig), threshold, by))


def _azimuths(rays: DataFrame) -> DataFrame:
    """Rays with ``_phi``, their azimuth about the baseline from 0 to pi, and ``_len``, the length of their part at right
    angles to it."""
    ray, base = vec("rx", "ry", "rz"), vec("bx", "by", "bz")
    rays = rays.withColumn("_e1", pack(orthogonal(base)))
    e1 = tuple(F.col("_e1")[a] for a in "xyz")
    e2 = cross(base, e1)
    p, q = dot(ray, e1), dot(ray, e2)
    rays = rays.withColumns({"_p": p, "_q": q}).drop("_e1")
    folded = F.atan2("_q", "_p")
    folded = F.when(folded < 0, folded + F.pi()).otherwise(folded)
    return rays.withColumns({"_phi": folded, "_len": F.sqrt(F.col("_p") ** 2 + F.col("_q") ** 2)}).drop("_p", "_q")


def _match_blocks(rays: DataFrame, threshold: float, by: Sequence[str]) -> DataFrame:
    """``epipolar_match`` of rays in frames of any size.

    For observations without an equal azimuth the searched side is cut into blocks of equal count along the azimuth. Since
    ``error = |a||b||sin(azimuth difference)|`` for the parts ``a, b`` at right angles to the baseline, the blocks
    around a ray bound what the others could give; rays whose best is not yet proven search a wider window in the
    next round.
    """
    rays = _azimuths(_roles(cut_lineage(rays), by))
    ray, base = vec("rx", "ry", "rz"), vec("bx", "by", "bz")
    # Position among the searched side, for both sides, in one ordered pass.
    placed = ordered.running_sum(
        rays, by, ["_phi", "_drives", "obs_id"], {"_pos": F.when(F.col("_drives"), 0).otherwise(1)})
    placed = cut_lineage(placed)
    found = placed.filter("NOT _drives").withColumn("_block", F.floor((F.col("_pos") - 1) / BLOCK))
    edges = found.groupBy(*by, "_block").agg(F.min("_phi").alias("_first"), F.max("_phi").alias("_last"))
    on_axis = F.col("_len") <= SAME_AZIMUTH
    hit = F.struct(F.lit(0.0).alias("err"), F.col("obs_id").alias("obs"), "u", "v")
    spans = found.groupBy(*by).agg(
        F.min("_phi").alias("_lo"), F.max("_phi").alias("_hi"), F.min(F.when(~on_axis, F.col("_len"))).alias("_short"),
        F.max("_block").alias("_blocks"), F.min(hit).alias("_any"), F.min(F.when(on_axis, hit)).alias("_axis"))
    drive = placed.filter("_drives").withColumn("_home", F.floor(F.col("_pos") / BLOCK))
    drive = salted_join(drive, spans, by, spread=["obs_id"])
    drive = join_on(drive, _same_azimuth(drive.filter(~on_axis), found.filter(~on_axis), by, hit), [*by, "obs_id"], "left")
    exact = F.when(on_axis, F.col("_any")).otherwise(F.least("_same", "_axis"))
    drive = cut_lineage(drive.withColumn("_m", exact).drop("_any", "_axis", "_same"))
    answer = [*by, "side", "obs_id", "u", "v", "_m"]
    results, width = [drive.filter("_m IS NOT NULL").select(*answer)], 1
    drive = drive.filter("_m IS NULL").drop("_m")
    other = found.select(
        *by, "_block", F.struct(F.col("obs_id").alias("obs"), "u", "v", "rx", "ry", "rz").alias("_o"))
    while True:
        lo = F.greatest(F.lit(0), F.least(F.col("_home"), F.col("_blocks")) - width)
        hi = F.least(F.col("_blocks"), F.col("_home") + width)
        wide = drive.withColumns({"_from": lo.cast("bigint"), "_to": F.greatest(lo, hi).cast("bigint")})
        o = F.col("_o")
        pairs = wide.withColumn("_block", F.explode(F.sequence("_from", "_to"))).join(other, [*by, "_block"])
        m = F.struct(_error(ray, (o["rx"], o["ry"], o["rz"]), base).alias("err"), o["obs"].alias("obs"),
                     o["u"].alias("u"), o["v"].alias("v"))
        best = pairs.groupBy(*by, "obs_id").agg(F.min(m).alias("_m"))
        judged = join_on(wide, best, [*by, "obs_id"], "left")
        first = edges.select(*by, F.col("_block").alias("_from"), "_first")
        last = edges.select(*by, F.col("_block").alias("_to"), "_last")
        judged = judged.join(first, [*by, "_from"]).join(last, [*by, "_to"])
        all_left, all_right = F.col("_from") == 0, F.col("_to") == F.col("_blocks")
        far = F.greatest(F.col("_hi") - F.col("_phi"), F.col("_phi") - F.col("_lo"))
        gap = F.least(
            F.when(~all_left, F.col("_phi") - F.col("_first")).otherwise(F.lit(10.0)),
            F.when(~all_right, F.col("_last") - F.col("_phi")).otherwise(F.lit(10.0)))
        gap = F.greatest(gap - AZIMUTH_ROUNDING, F.lit(0.0))
        bound = F.col("_len") * F.col("_short") * F.least(F.sin(gap), F.sin(far))
        err = F.col("_m")["err"]
        proven = (all_left & all_right) | (err < bound * (1 - 1e-9)) | (bound >= threshold)
        judged = cut_lineage(judged.withColumn("_proven", proven).drop("_first", "_last"))
        results.append(judged.filter("_proven").select(*answer))
        if judged.filter("NOT _proven").isEmpty():
            break
        drive = judged.filter("NOT _proven").drop("_m", "_proven", "_from", "_to")
        width *= 8
    done = results[0]
    for part in results[1:]:
        done = done.unionByName(part)
    return _oriented(done, by, threshold)


def triangulate(matches: DataFrame, calibrations: DataFrame, rig: Sequence[str] = ("rig_id",)) -> DataFrame:
    """Midpoint of the closest points of the two rays, in the left camera's frame; NaN where the rays are parallel."""
    joined = with_params(matches, _scalars(calibrations, rig, inverse=True), rig)
    left, right = _ray("left_u", "left_v", "k1"), _ray("right_u", "right_v", "k2")
    staged = joined.withColumns({
        **{f"_l{a}": c for a, c in zip("xyz", left)}, **{f"_b{a}": c for a, c in zip("xyz", right)}})
    staged = staged.withColumns({f"_a{a}": c for a, c in zip("xyz", _times("_r", vec("_lx", "_ly", "_lz")))})
    da, db = vec("_ax", "_ay", "_az"), vec("_bx", "_by", "_bz")
    t = vec("_tx", "_ty", "_tz")
    # Normal equations of  t + ca * da = cb * db.
    aa, ab, bb = dot(da, da), dot(da, db), dot(db, db)
    at, bt = dot(da, t), dot(db, t)
    det = aa * bb - ab * ab
    staged = staged.withColumns({"_ca": ratio(ab * bt - bb * at, det), "_cb": ratio(aa * bt - ab * at, det)})
    mid = scale(add(add(t, scale(da, F.col("_ca"))), scale(db, F.col("_cb"))), 0.5)
    shifted = sub(mid, t)
    staged = staged.withColumns({f"_s{a}": c for a, c in zip("xyz", shifted)})
    back = _times("_i", vec("_sx", "_sy", "_sz"))
    out = staged.withColumns(dict(zip("xyz", back)))
    return out.select(*matches.columns, "x", "y", "z")


# -- diagnostics ---------------------------------------------------------------------


def coverage(min_u: Column, max_u: Column, min_v: Column, max_v: Column, width: Column, height: Column) -> Column:
    share = F.greatest((max_u - min_u + 1) / width, (max_v - min_v + 1) / height)
    return F.when(min_u.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def frame_diagnostics(
    frames: DataFrame, obs: DataFrame, matches: DataFrame, points: DataFrame, roi_width: int, roi_height: int,
    by: Sequence[str] = FRAME,
) -> DataFrame:
    """One row per frame of ``frames``: counts, coverage, match quality, bounds, reason. Where ``points`` are the triangulated
    matches, they may be given for both, and are then worked out once."""
    aggs = []
    for side in ("left", "right"):
        def when(c: str, side: str = side) -> Column:
            return F.when(F.col("side") == side, F.col(c))

        aggs += [F.count(when("u")).alias(f"{side}_count")]
        aggs += [f(when(c)).alias(f"_{side}_{n}_{c}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))]
    lines = obs.groupBy(*by).agg(*aggs)
    quality = [F.count(F.lit(1)).alias("matched"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error")]
    bounds = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    if matches is points:
        found = [points.groupBy(*by).agg(*quality, *bounds)]
    else:
        found = [matches.groupBy(*by).agg(*quality), points.groupBy(*by).agg(*bounds)]
    out = frames.select(*by).distinct()
    for part in (lines, *found):
        out = join_on(out, part, by, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("left_count", "right_count", "matched")}
    out = out.withColumns(zero)
    out = out.withColumns({
        f"{s}_coverage": coverage(
            *[F.col(f"_{s}_{n}_{c}") for c in "uv" for n in ("min", "max")], F.lit(float(roi_width)),
            F.lit(float(roi_height)))
        for s in ("left", "right")
    })
    least = F.least("left_count", "right_count")
    reason = (
        F.when((F.col("left_count") == 0) & (F.col("right_count") == 0), "both_empty")
        .when(F.col("left_count") == 0, "left_empty").when(F.col("right_count") == 0, "right_empty")
        .when(F.col("matched") == 0, "match_empty").otherwise("ok"))
    out = out.withColumns({
        "match_rate": F.when(least > 0, F.col("matched") / least).otherwise(0.0), "reason": reason})
    return out.drop(*[f"_{s}_{n}_{c}" for s in ("left", "right") for n in ("min", "max") for c in "uv"])


def sample_diagnostics(diag: DataFrame, run: Sequence[str] = ("run_id",), index: str = "frame_index") -> DataFrame:
    """All frames with ``sampled``: worth logging are failures, short runs, the first ten, the last, each 50th."""
    totals = diag.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    i = F.col(index)
    keep = (F.col("reason") != "ok") | (F.col("_n") <= DIAGNOSTIC_FULL) | (i <= DIAGNOSTIC_HEAD) | (
        i == F.col("_n")) | (i % DIAGNOSTIC_EVERY == 0)
    return salted_join(diag, totals, run, spread=[index]).select(*diag.columns, keep.alias("sampled"))


def progress(
    diag: DataFrame, run: Sequence[str] = ("run_id",), index: str = "frame_index", points: str = "matched",
    failed: str | None = None,
) -> DataFrame:
    """Progress rows with cumulative points: first, last and about ten in between; failed
    frames too when the boolean column ``failed`` is named."""
    rows = ordered.running_sum(
        diag, run, [index], {"points_so_far": F.col(points)}, ordered.point_slice(index))
    totals = diag.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    i, n = F.col(index), F.col("_n")
    step = F.greatest(F.lit(1), F.ceil(n / 10))
    keep = (i == 1) | (i == n) | (i % step == 0)
    if failed:
        keep = keep | F.col(failed)
    joined = salted_join(rows, totals, run, spread=[index])
    return joined.filter(keep).select(*run, index, F.col("_n").alias("frames"), "points_so_far")


def run_summary(diag: DataFrame, run: Sequence[str] = ("run_id",), points: str = "matched") -> DataFrame:
    out = diag.groupBy(*run).agg(
        F.sum(points).alias("merged_points"), F.count(F.lit(1)).alias("frames"),
        F.sum(F.when(F.col("reason") != "ok", 1).otherwise(0)).alias("failed_frames"))
    ok = F.col("merged_points") > 0
    message = F.when(ok, F.format_string("Reconstruction finished, points=%d", "merged_points")).otherwise(
        "Reconstruction finished without valid points")
    return out.withColumns({"success": ok, "message": message})


def reconstruct(
    frames: DataFrame,
    obs: DataFrame,
    calibrations: DataFrame,
    roi_width: int,
    roi_height: int,
    threshold: float = MATCH_THRESHOLD,
    by: Sequence[str] = FRAME,
    rig: Sequence[str] = ("rig_id",),
    on_frames: Callable[[DataFrame], None] | None = None,
    on_error: Callable[[Exception], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Points and per-frame diagnostics of line observations.

    ``on_frames`` gets the diagnostics table; an exception in it goes to ``on_error`` and
    never fails the run. Frames whose observations are not finite lose those rows only.
    """
    clean = obs.filter(finite("u", "v"))
    flat = undistort_observations(clean, calibrations, rig)
    matches = epipolar_match(flat, calibrations, threshold, by, rig)
    rigs = flat.select(*by, *rig).distinct() if not set(rig) <= set(by) else None
    keyed = matches if rigs is None else salted_join(matches, rigs, by, spread=["left_obs"])
    points = triangulate(keyed, calibrations, rig)
    diag = frame_diagnostics(frames, clean, matches, points, roi_width, roi_height, by)
    if on_frames is not None:
        try:
            on_frames(diag)
        except Exception as error:  # noqa: BLE001 - a hook must not stop the run
            if on_error is not None:
                on_error(error)
    return points, diag


