import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge.operators import cloud, ordered
from tests.conftest import grid_plane

FIVE = [(0.1, 0.2, 0.3), (0.3, 0.4, 0.5), (-0.1, 0, 0), (2, 0, 0), (float("nan"), 0, 0)]


def test_finite_voxel_pass_through(clouds):
    df = clouds(a=FIVE)
    assert cloud.filter_finite(df).count() == 4
    cells = cloud.voxel_downsample(df, 1.0, dense_ids=True).orderBy("point_id").collect()
    assert [(c.kx, c.ky, c.kz, c.n) for c in cells] == [(-1, 0, 0, 1), (0, 0, 0, 2), (2, 0, 0, 1)]
    assert abs(cells[1].x - 0.2) < 1e-12
    assert cloud.pass_through(df, 0, -0.1, 0.3).count() == 3
    for args in ((3, 0, 1), (0, 2, 1), (0, float("nan"), 1)):
        with pytest.raises(ValueError):
            cloud.pass_through(df, *args)
    with pytest.raises(ValueError):
        cloud.voxel_downsample(df, 0.0)
    with pytest.raises(Exception, match="voxel size"):
        cloud.voxel_downsample(clouds(a=[(1e300, 0, 0)]), 1e-3).collect()


def test_null_counts_as_not_finite(spark):
    df = spark.sql("SELECT 'a' cloud_id, 0L point_id, CAST(NULL AS DOUBLE) x, 1D y, 1D z")
    assert cloud.filter_finite(df).count() == 0


def test_voxel_count_falls_with_size(clouds):
    df = clouds(a=grid_plane())
    counts = [cloud.voxel_downsample(df, s).count() for s in (1.0, 2.0, 4.0, 100.0)]
    assert counts == sorted(counts, reverse=True)


def test_stride_filter_equals_loop(spark):
    for n in (1, 7, 10, 41):
        for keep in range(1, n + 1):
            df = spark.range(n).selectExpr("id", f"{n}L AS n", f"{keep}L AS keep") if keep in (1, n, n // 2 or 1) else None
            if df is not None:
                got = [r.id for r in df.filter(cloud.stride_filter("id", "n", "keep")).orderBy("id").collect()]
                assert got == [i * n // keep for i in range(keep)]


def test_selection_algebra(clouds):
    df = cloud.select_none(clouds(a=grid_plane(), b=FIVE[:3]))
    twice = cloud.invert_selection(cloud.invert_selection(df))
    assert twice.filter("selected").count() == 0
    assert cloud.select_all(df).filter("selected").count() == 444
    assert cloud.edit_selection(df, "delete").count() == 0
    some = df.withColumn("selected", (F.col("cloud_id") == "a") & (F.col("point_id") < 10))
    assert cloud.working_set(some).groupBy("cloud_id").count().collect().__len__() == 2
    assert cloud.working_set(some).count() == 13
    assert cloud.edit_selection(some, "delete").count() == 431
    assert {r.cloud_id for r in cloud.edit_selection(some, "extract", "_x").collect()} == {"a_x"}
    assert cloud.edit_selection(cloud.select_all(df), "delete").count() == 0


def test_polygon_selection(clouds):
    df = clouds(a=[(0, 0, 0), (0.5, 0.5, 0), (-0.9, 0.9, 0), (0, 0, 5), (3, 0, 0)])
    eye = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    box = cloud.rect_polygon(60, 60, 40, 40)

    def picked(frame):
        return [r.point_id for r in frame.filter("selected").orderBy("point_id").collect()]

    first = cloud.select_polygon(df, eye, 100, 100, box)
    assert picked(first) == [0]
    more = cloud.select_polygon(first, eye, 100, 100, cloud.rect_polygon(70, 20, 80, 30), "add")
    assert picked(more) == [0, 1]
    assert picked(cloud.select_polygon(more, eye, 100, 100, box, "remove")) == [1]
    assert picked(cloud.select_polygon(more, eye, 100, 100, [(0, 0), (9, 9)], "replace")) == [0, 1]
    round_shape = cloud.ellipse_polygon(0, 0, 99, 99)
    assert len(round_shape) == 64 and picked(cloud.select_polygon(df, eye, 100, 100, round_shape)) == [0, 1]


def test_merge_keeps_order_and_copies(clouds):
    df = clouds(a=[(1, 0, 0), (2, 0, 0)], b=[(2, 0, 0)], c=[(9, 0, 0)])
    merged = cloud.merge_clouds(df, ["b", "a"], "m").orderBy("point_id").collect()
    assert [(r.point_id, r.x) for r in merged] == [(0, 2), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        cloud.merge_clouds(df, ["a"], "m")


def test_ordered_windows_across_slices(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(o)) for g, o in zip(rng.integers(0, 3, 400), rng.permutation(400))]
    df = spark.createDataFrame(rows, "g int, o int").repartition(5)
    for slice_by in (F.floor(F.col("o") / 37), None):
        out = ordered.row_number(df, ["g"], ["o"], "n", slice_by)
        out = ordered.previous(out, ["g"], ["o"], {"p": "o"}, slice_by)
        out = ordered.running_sum(out, ["g"], ["o"], {"s": F.col("o")}, slice_by)
        out = ordered.following(out, ["g"], ["o"], F.when(F.col("o") % 50 == 0, F.col("o")), "f", slice_by)
        out = ordered.latest(out, ["g"], ["o"], F.when(F.col("o") % 50 == 0, F.col("o")), "l", slice_by)
        got = {(r.g, r.o): (r.n, r.p, r.s, r.f, r.l) for r in out.collect()}
        for g in range(3):
            mine = sorted(o for k, o in rows if k == g)
            for i, o in enumerate(mine):
                marks = [m for m in mine if m % 50 == 0]
                assert got[(g, o)] == (
                    i + 1, mine[i - 1] if i else None, sum(mine[: i + 1]), min((m for m in marks if m > o), default=None),
                    max((m for m in marks if m <= o), default=None))
