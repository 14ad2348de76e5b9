import random
import time

import numpy as np
from pyspark.sql import functions as F

from cloudgauge.operators import ordered, selection


def test_upper_medians(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED_VALUES", 20)
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=501), "even": rng.normal(size=500) * 1e-300, "ties": np.repeat([3.0, -1.0, 7.5], 100),
        "wide": np.sign(rng.normal(size=800)) * 10.0 ** rng.uniform(-320, 308, 800), "one": [4.0], "two": [2.0, -5.0], "zeros": [0.0, -0.0, 0.0],
        "ends": [np.inf] * 30 + [-np.inf] * 30 + list(rng.normal(size=41)), "nan": [np.nan] * 60 + list(rng.normal(size=70)),
        "tiny": np.arange(60) * 5e-324, "mass": np.concatenate([np.full(300, 0.1), rng.uniform(0.05, 0.2, 280)])}
    rows = [(g, float(v), 1) for g, values in groups.items() for v in values] + [("none", None, 1), ("one", None, 1)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, _low int").repartition(5)
    got = {r["g"]: r["m"] for r in selection.upper_medians(df, ["g"], "v", "m").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        want = np.sort(np.asarray(values, float))[len(values) // 2]
        assert got[g] == want or np.isnan(want) and np.isnan(got[g]), g


def test_upper_median_of_a_large_group(spark):
    """Five million different values in one group; no step sorts more than a bounded part of them."""
    df = spark.range(5_000_000).select(F.lit("a").alias("g"), (F.sin("id") * F.col("id")).alias("v"))
    got = selection.upper_medians(df, ["g"], "v", "m").first()["m"]
    ids = np.arange(5_000_000, dtype=float)
    assert abs(got - np.sort(np.sin(ids) * ids)[2_500_000]) < 1e-6


def test_following_is_linear(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("port"), F.col("id").alias("at"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v"))
    start = time.time()
    got = ordered.following(df, ["port"], ["at"], F.col("v"), "next", F.lit(0)).agg(F.sum("next"), F.count("next")).first()
    assert time.time() - start < 20
    want = [min(x for x in (i + 1000 - (i + 1) % 1000,) if x) for i in range(n - 1)]
    assert tuple(got) == (sum(w for w in want), n - 1)


def test_following_crosses_slices(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(4)
    for slices in (F.floor(F.col("at") / 16), None):
        got = {r["at"]: r["next"] for r in ordered.following(df, ["g"], ["at"], F.col("v"), "next", slices).collect()}
        for g, at, _ in rows:
            later = [v for h, i, v in rows if h == g and i > at and v is not None]
            assert got[at] == (later[0] if later else None)
