import pathlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cloudgauge.functions.vec import computed_once
from cloudgauge.operators import defects, fit, models, neighbours
from cloudgauge.operators.cloud import filter_finite
from tests.conftest import cylinder, grid_plane, sphere

FAR = (1e6, -2e6, 3e6)


def by_cloud(df):
    return {r.cloud_id: r for r in df.collect()}


def test_planes(clouds):
    noisy = np.vstack([grid_plane(), [[100, 100, 100]]])
    df = clouds(clean=grid_plane(), noisy=noisy, line=[(0, 0, 0), (1, 0, 0), (2, 0, 0)], two=[(0, 0, 0), (1, 0, 0)])
    got = by_cloud(fit.fit(df, "plane"))
    assert abs(got["clean"].offset + 2) < 1e-9 and got["clean"].rmse < 1e-9
    assert abs(got["noisy"].offset + 2) < 1e-9 and abs(got["noisy"].max_abs - 98) < 1e-9
    assert got["line"].failure == "degenerate" and got["two"].failure == "too_few"


def test_spheres(clouds):
    outliers = [[FAR[0] + 50 + i, FAR[1] + 70, FAR[2] - 60] for i in range(12)]
    df = clouds(s=sphere(FAR, 2), o=np.vstack([sphere(FAR, 2), outliers]), flat=grid_plane())
    got = by_cloud(fit.fit(df, "sphere", standard_diameter=4.2))
    for name in "so":
        assert np.allclose([got[name].center.x, got[name].center.y, got[name].center.z], FAR, atol=1e-6)
        assert abs(got[name].radius - 2) < 1e-6
    assert abs(got["s"].me + 0.1) < 1e-6
    assert got["flat"].failure == "rank"
    with pytest.raises(ValueError):
        fit.fit(df, "sphere", standard_diameter=-1)


def test_fits_use_every_point(clouds, monkeypatch):
    """More points than one scoring slice; the outliers stand where strided samples would miss or hit them all."""
    monkeypatch.setattr(fit, "SCORE_SLICE", 7_000)
    rng = np.random.default_rng(9)
    plane = np.column_stack([rng.uniform(-9, 9, (30_000, 2)), np.full(30_000, 2.0)])
    plane[::2] += [0, 0, 50.0]
    plane[: 30_000 : 10, 2] = 2.0  # 60 % on the plane, most of the even rows are off it
    ball = rng.normal(size=(30_000, 3))
    ball = ball / np.linalg.norm(ball, axis=1, keepdims=True) * 3 + [5, 6, 7]
    ball[1::3] += [40, 40, 40]
    got = by_cloud(fit.fit(clouds(p=plane), "plane"))
    assert abs(got["p"].offset + 2) < 1e-9 and got["p"].direction.z == pytest.approx(1)
    got = by_cloud(fit.fit(clouds(b=ball), "sphere"))
    assert abs(got["b"].radius - 3) < 1e-6 and abs(got["b"].center.x - 5) < 1e-6
    assert got["b"].max_abs > 50


def test_medians_from_digits(clouds):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(501, 3))
    pts[:100] = pts[0]
    pools = rng.normal(size=(40, 7))
    pools[:, 6] = np.where(np.arange(40) % 2, -1.0, np.abs(pools[:, 6]))
    df = fit.numbered(clouds(c=pts), ["cloud_id"])
    packed = df.sparkSession.createDataFrame([("c", pools.ravel().tolist())], "cloud_id string, _params array<double>")
    best = fit.best_candidates(df, packed, ["cloud_id"]).collect()[0]["_best"]
    scores = []
    for c in pools:
        d = pts - c[:3]
        e = np.abs(d @ c[3:6]) if c[6] < 0 else np.abs(np.linalg.norm(d, axis=1) - c[6])
        scores.append(np.sort(e)[len(e) // 2])
    assert best == int(np.argmin(scores))


def test_cylinders(clouds):
    got = by_cloud(fit.fit(clouds(short=cylinder(2), tall=cylinder(20)), "cylinder"))
    for name, height in (("short", 2), ("tall", 20)):
        assert abs(got[name].radius - 2) < 1e-6 and got[name].rmse < 1e-6
        assert abs(got[name].axis_max - got[name].axis_min - height) < 1e-6


@pytest.mark.parametrize("kind", ["sphere", "cylinder"])
def test_steps_in_one_task_equal_summed_steps(clouds, monkeypatch, kind):
    rng = np.random.default_rng(6)
    pts = (sphere(FAR, 2) if kind == "sphere" else cylinder(9)) + rng.normal(size=(264 if kind == "sphere" else 540, 3)) * 0.2
    df = fit.numbered(clouds(a=pts, b=pts[::2] * 1.5), ["cloud_id"])
    start = fit.least_squares(df, kind, ["cloud_id"])
    alone = by_cloud(fit.refine(df, start, kind, ["cloud_id"]))
    monkeypatch.setattr(fit, "TASK_POINTS", 300)
    monkeypatch.setattr(fit, "REFINE_STEPS", 25)
    summed = by_cloud(fit.refine(df, start, kind, ["cloud_id"]))
    for name in "ab":
        assert abs(alone[name].radius - summed[name].radius) < 1e-7
        assert np.allclose(list(alone[name].direction), list(summed[name].direction), atol=1e-7)


def test_surfaces(clouds):
    u, v = (a.ravel() for a in np.meshgrid(np.arange(-1, 1.01, 0.1), np.arange(-1, 1.01, 0.1)))
    df = clouds(q=np.column_stack([u, v, 0.03 * u * u + 0.02 * v * v + 0.01 * u**4]))
    second, fourth = (fit.fit(df, k).collect()[0] for k in ("quadric", "quartic"))
    assert fourth.rmse < 1e-8 < second.rmse
    assert len(second.coefficients) == 6 and len(fourth.coefficients) == 15


def test_double_sphere(clouds):
    df = clouds(d=np.vstack([sphere((-8, 0, 0), 2), sphere((8, 0, 0), 3)]))
    first, second = fit.fit_double_sphere(df)
    assert abs(models.sphere_distance(first, second).collect()[0].distance - 16) < 1e-6
    nearest = models.nearest_model_error(df, first, second)
    assert nearest.agg(F.max(F.abs("signed_error"))).collect()[0][0] < 1e-6


def brute(points, k):
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    out = {}
    for i in range(len(points)):
        near = sorted((gaps[i, j], j) for j in range(len(points)) if j != i)[:k]
        out[i] = near
    return out, gaps


def test_neighbours_match_brute_force(clouds):
    rng = np.random.default_rng(1)
    crowded = np.vstack([
        rng.normal(size=(150, 3)) * 1e-3, np.tile([[5.0, 5, 5]], (60, 1)), rng.uniform(-50, 50, size=(40, 3))])
    sets = {"a": rng.normal(size=(200, 3)), "b": crowded, "c": rng.normal(size=(2, 3))}
    df = clouds(**sets)
    got = {}
    for r in neighbours.knn(df, 5).collect():
        got.setdefault((r.cloud_id, r.point_id), []).append((r.rank, r.distance, r.neighbour_id))
    close = {}
    for r in neighbours.radius_pairs(df, 0.7).collect():
        close.setdefault((r.cloud_id, r.point_id), set()).add(r.neighbour_id)
    counts = {reach: {(r.cloud_id, r.point_id): r.neighbours for r in neighbours.radius_counts(df, reach).collect()}
              for reach in (0.7, 30.0)}
    for name, pts in sets.items():
        wanted, gaps = brute(pts, 5)
        for i, near in wanted.items():
            mine = sorted(got[(name, i)])
            assert [m[2] for m in mine] == [j for _, j in near]
            assert np.allclose([m[1] for m in mine], [d for d, _ in near])
            assert close[(name, i)] == set(np.flatnonzero(gaps[i] <= 0.7))
            for reach, told in counts.items():
                assert told[(name, i)] == (gaps[i] <= reach).sum()


def test_outliers_and_spacing(clouds):
    df = clouds(p=np.vstack([grid_plane(), [[100, 100, 100]]]))
    kept = neighbours.statistical_outlier_removal(df, 12, 1.0)
    assert kept.count() == 441 and kept.agg(F.max("z")).collect()[0][0] == 2
    spacing = by_cloud(neighbours.estimate_spacing(clouds(g=grid_plane(), one=[(0, 0, 0)], same=[(1, 1, 1)] * 3)))
    assert spacing["g"].spacing == 1 and spacing["one"].spacing == 0 and spacing["same"].spacing == 0
    with pytest.raises(Exception, match="three valid points"):
        neighbours.statistical_outlier_removal(clouds(p=[(0, 0, 0), (1, 1, 1)])).collect()


def damaged():
    pts = grid_plane()
    pts[(abs(pts[:, 0] + 5) <= 1) & (abs(pts[:, 1] + 5) <= 1), 2] = 0
    pts[(abs(pts[:, 0] - 5) <= 1) & (abs(pts[:, 1] - 5) <= 1), 2] = 4
    return pts


@pytest.mark.parametrize("radius", [1.5, None])
def test_defects(clouds, radius):
    df = clouds(d=damaged())
    plane = fit.fit(df, "plane")
    found, members = defects.measure_defects(df, plane, 1.0, radius)
    rows = found.orderBy("defect_id").collect()
    assert [(r.dent, r.n, round(r.max_depth, 9)) for r in rows] == [(True, 9, 2.0), (False, 9, 2.0)]
    assert members.count() == 18


def test_defects_in_a_crowded_patch(clouds):
    """Many copies and near copies join through cells, not through pairs."""
    rng = np.random.default_rng(3)
    blob = np.column_stack([rng.normal(size=(400, 2)) * 0.01, np.full(400, 3.0)])
    chain = [(0.9 * i, 0, 3.0) for i in range(1, 6)]
    away = [(20 + i, 0, 3.0) for i in range(2)]
    df = clouds(d=np.vstack([blob, np.tile([[0.0, 0, 3.0]], (100, 1)), chain, away]))
    plane = df.sparkSession.sql(
        "SELECT 'd' cloud_id, 'plane' kind, named_struct('x', 0D, 'y', 0D, 'z', 0D) center, "
        "named_struct('x', 0D, 'y', 0D, 'z', 1D) direction")
    found, _ = defects.measure_defects(df, plane, 1.0, 1.0, 3)
    rows = found.collect()
    assert [(r.n, r.defect_id) for r in rows] == [(505, 0)]


def test_packed_points_are_read_in_small_pieces(spark, clouds, monkeypatch):
    """Row groups of few rows and small batches bound what a task holds of large clouds; the caller's settings stay."""
    name, groups, sent = "spark.sql.execution.arrow.maxBytesPerBatch", [], []
    before = spark.conf.get(name)
    summed, release = fit._summed, fit.release

    def watched(parts, by):
        sent.append(parts.sparkSession.conf.get(name))
        return summed(parts, by)

    def looked(*frames):
        files = pathlib.Path(frames[0]._written_path.removeprefix("file:")).glob("*.parquet")
        metas = [pq.ParquetFile(f).metadata for f in files] if "_xyz" in frames[0].columns else []
        groups.extend(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups))
        release(*frames)

    monkeypatch.setattr(fit, "TASK_POINTS", 100)
    monkeypatch.setattr(fit, "_summed", watched)
    monkeypatch.setattr(fit, "release", looked)
    models = fit.fit(clouds(**{f"c{i}": grid_plane(float(i)) for i in range(40)}).coalesce(1), "quadric").collect()
    assert len(models) == 40 and max(m.rmse for m in models) < 1e-9
    assert sum(groups) == 40 and max(groups) <= fit.PACKED_ROWS
    assert set(sent) == {str(fit.SENT_BYTES)} and spark.conf.get(name) == before


def test_halves_take_their_steps_together(clouds, monkeypatch):
    calls, one = [], fit.fit
    monkeypatch.setattr(fit, "fit", lambda *args, **more: calls.append(args) or one(*args, **more))
    both = np.vstack([sphere([0, 0, 0], 2.0), sphere([20, 0, 0], 3.0)])
    first, second = fit.fit_double_sphere(clouds(a=both))
    assert sorted(round(m.radius, 6) for m in first.collect() + second.collect()) == [2.0, 3.0]
    assert len(calls) == 1


def test_filtered_expressions_are_computed_once(spark):
    rows = spark.range(9).select(F.sqrt("id").alias("x"), F.col("id").cast("double").alias("y"), F.when(F.col("id") < 4, 1.0).alias("z"))
    once = filter_finite(computed_once(rows))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1 and once.columns == ["x", "y", "z"]
    assert [r.x for r in once.orderBy("x").collect()] == [0.0, 1.0, 2.0 ** 0.5, 3.0 ** 0.5]
