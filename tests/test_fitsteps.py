"""Fits of small clouds take few jobs; large ones take the same steps over packed points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge.operators import fit, fitsteps
from tests.conftest import cylinder, sphere


def rows(df):
    return {r.cloud_id: r.asDict(recursive=True) for r in df.collect()}


def bent(rng):
    x, y = rng.uniform(-1, 1, (2, 500))
    pts = np.column_stack([x, y, 0.3 * x * x + 0.1 * y * y + 0.05 * x**4])
    pts[::25, 2] += 2
    return pts


@pytest.mark.parametrize("kind", list(fitsteps.MINIMUM_POINTS))
def test_packed_points_give_the_fit_of_one_task(clouds, monkeypatch, kind):
    rng = np.random.default_rng(8)
    shapes = {"sphere": sphere((1, 2, 3), 2), "cylinder": cylinder(9), "plane": rng.uniform(-9, 9, (400, 3)) * [1, 1, 0.01]}
    pts = bent(rng) if kind in ("quadric", "quartic") else shapes[kind] + rng.normal(size=shapes[kind].shape) * 0.01
    pts[::17] += [0, 0, 3]
    df = clouds(a=pts, b=pts[::2] * 1.5, few=pts[:2], none=[(np.nan, 0, 0)])
    alone = rows(fit.fit(df, kind))
    monkeypatch.setattr(fit, "SCORE_SLICE", 90)
    monkeypatch.setattr(fit, "TASK_POINTS", 350 if kind == "plane" else 1)
    packed = rows(fit.fit(df, kind))
    assert set(alone) == set(packed) == {"a", "b", "few", "none"}
    for name, one in alone.items():
        assert one["failure"] == packed[name]["failure"] == (None if name in "ab" else "too_few")
        for column in ("radius", *fitsteps.STATS):
            assert one[column] == (None if packed[name][column] is None else pytest.approx(packed[name][column], abs=1e-7))


def test_small_clouds_take_few_jobs(spark, clouds):
    """Every step was jobs of its own for all clouds, some tens of them."""
    df = clouds(**{f"c{i}": sphere((i, 0, 0), 2) for i in range(4)})
    spark.sparkContext.setJobGroup("few", "few")
    try:
        assert fit.fit(df, "sphere").filter("failure IS NULL AND abs(radius - 2) < 1e-6").count() == 4
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 12


def test_draws_are_those_of_spark(spark):
    key = spark.createDataFrame([("cloud 7", 3)], "cloud_id string, part int")
    start = key.select(F.xxhash64("cloud_id", "part", F.lit(12345))).first()[0]
    wanted = key.crossJoin(spark.range(1, 4).select(F.col("id").cast("int").alias("c"))).select(
        "c", F.slice(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(32)), lambda k: F.pmod(
            F.xxhash64("cloud_id", "part", F.lit(12345), "c", k), F.lit(600)))), 1, 4).alias("d")).orderBy("c").collect()
    assert [r.d for r in wanted] == fit.drawn(start, 600, 4)[:3].tolist()


def test_heights_are_sums_of_monomials():
    u, v, c = np.random.default_rng(2).normal(size=(3, 15))
    for degree, n in ((2, 6), (4, 15)):
        assert np.allclose(fitsteps.height(u, v, c[:n], degree), fitsteps.monomials(u, v, degree) @ c[:n])
