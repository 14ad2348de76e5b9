"""Cases that larger tables showed."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloudgauge.operators import defects, fleet, neighbours, stereo
from cloudgauge.plans.stereo_queries import calibrations
from cloudgauge.sources import binary_clouds, sinks, text_clouds
from cloudgauge.streaming import stateful
from tests.oracle import compare


def con_of(folder):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


def same_as_sql(spark, folder, name):
    rows, problem = compare(spark, con_of(folder), name, entry.queries()[name], entry.oracle_sql()[name], str(folder))
    assert rows and not problem, problem


def test_expected_frames_at_a_half(spark, tmp_path):
    spark.createDataFrame([(1, 12, 969.0), (2, 24, 969.0), (3, 38, 969.0), (4, 5, 969.0)],
                          "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, tmp_path, "expected_frames")


def test_parallel_rays_have_no_point(spark):
    pairs = spark.createDataFrame([("rig", 10.0, 20.0, 10.0, 20.0), ("rig", 30.0, 20.0, 10.0, 20.0)],
                                  "rig_id string, left_u double, left_v double, right_u double, right_v double")
    points = stereo.triangulate(pairs, calibrations(spark)).orderBy("left_u").collect()
    assert all(math.isnan(points[0][a]) for a in "xyz") and all(math.isfinite(points[1][a]) for a in "xyz")


@pytest.mark.parametrize("name", ["triangulate", "stream_reconstruct"])
def test_same_pixel_on_both_sides(spark, tmp_path, name):
    rows = [(1, i, 5, i, 10.0 + i % 2, 600.0 + i // 2, "OF"[i % 3 == 0]) for i in range(1, 8)]
    rows += [(1, 8, 5, 8, 10.0, 900.0, "O"), (1, 9, 5, 9, 10.0, 900.0, "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, "
                          "l_extendedprice double, l_linestatus string").withColumn(
        "l_shipdate", F.expr("timestamp'2026-01-01 00:00:00'")).write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, tmp_path, name)


def test_small_clouds_need_no_tree(clouds, monkeypatch):
    rng = np.random.default_rng(5)
    spots = np.vstack([rng.integers(0, 4, (60, 3)), rng.normal(size=(60, 3)), rng.normal(size=(1, 3)).repeat(9, axis=0)])
    df = clouds(a=spots, b=spots[:2], c=spots[:1], d=spots[:70])
    jobs = {
        "knn": lambda: neighbours.knn(df, 5), "counts": lambda: neighbours.radius_counts(df, 1.5),
        "pairs": lambda: neighbours.radius_pairs(df, 1.0), "spacing": lambda: neighbours.estimate_spacing(df),
        "clean": lambda: neighbours.statistical_outlier_removal(df.filter("cloud_id in ('a', 'd')"), 4, 1.0)}

    def rows(job):
        return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in job().collect()), key=str)

    tree, uses = neighbours.build_tree, []
    monkeypatch.setattr(neighbours, "build_tree", lambda *args: uses.append(1) or tree(*args))
    whole = {name: rows(job) for name, job in jobs.items()}
    assert not uses
    monkeypatch.setattr(neighbours, "WHOLE", 65)
    assert {name: rows(job) for name, job in jobs.items()} == whole and len(uses) == 5


def test_error_table_has_one_file_per_cloud(spark, tmp_path):
    rows = spark.range(4000).repartition(8).selectExpr(
        "cast(id % 5 as string) AS cloud_id", "id AS point_id", "1D AS x", "2D AS y", "3D AS z", "0.5D AS signed_error")
    sinks.write_error_csv(rows, f"{tmp_path}/csv")
    assert len(list(tmp_path.glob("csv/*/*.csv"))) == 5
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 4000


def test_lint_joins_nothing(spark):
    packs = spark.createDataFrame([(1, "55 GG"), (2, None), (3, ""), (4, "WAIT 5\n55"), (None, "#")], "pack_id long, content string")
    found = fleet.lint_scripts(packs)
    assert {tuple(r)[:5] for r in found.collect()} == {
        (1, 1, 0, 1, "bad_byte"), (2, 0, 0, None, "no_command"), (3, 0, 0, None, "no_command"), (4, 1, 5, None, None),
        (None, 0, 0, None, "no_command")}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_first_answers_equal_brute_force_and_keep_little():
    rng, limit = np.random.default_rng(3), 50_000_000

    class State:
        value, exists, hasTimedOut, mark = None, False, False, 0
        get = property(lambda self: self.value)

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists = None, False

        def setTimeoutTimestamp(self, at):
            assert at > self.mark

    us = np.sort(rng.integers(1, 4000, 3000)) * 1_000_000
    rows = pd.DataFrame({"us": us, "asks": rng.random(3000) < 0.5, "hex": [f"{v:03d}" for v in rng.integers(0, 999, 3000)]})
    state, run, out = State(), stateful._first_answers(limit), []
    for at in range(0, 3000, 500):
        part = rows[at:at + 500].sample(frac=1, random_state=1)
        out += run(("p", 17), iter([part[:200], part[200:]]), state)
        state.mark = int(part["us"].max()) // 1000 - 1
        assert state.value is None or len(state.value[2]) <= 500
    state.mark, state.hasTimedOut = 10_000_000, True
    out += run(("p", 17), iter([]), state)
    got = sorted((r.query_us, r.query, None if pd.isna(r.answer_us) else int(r.answer_us), r.response) for r in pd.concat(out).itertuples())
    answers = sorted(zip(rows.us[~rows.asks], rows.hex[~rows.asks]))
    wanted = []  # equal queries of one time included
    for q, text in zip(rows.us[rows.asks], rows.hex[rows.asks]):
        hit = next(((t, h) for t, h in answers if q < t <= q + limit), (None, None))
        wanted.append((q, text, *hit))
    assert got == sorted(wanted) and not state.exists


def test_defect_of_copies_has_no_length(spark, clouds):
    df = clouds(a=[[1.0, 0.3, 9.0]] * 3 + [[20.0, 0.3, 9.0], [22.0, 0.3, 9.0], [24.0, 0.3, 9.0]])
    plane = spark.sql("SELECT 'a' AS cloud_id, 'plane' AS kind, named_struct('x', 0D, 'y', 0D, 'z', 5D) AS center, "
                      "named_struct('x', 0D, 'y', 0D, 'z', 1D) AS direction")
    found, _ = defects.measure_defects(df, plane, 3.0, 2.5, 3)
    rows = [tuple(round(v, 9) for v in r) for r in found.select("defect_id", "n", "length", "width", "area").orderBy("defect_id").collect()]
    assert rows == [(0, 3, 0.0, 0.0, 0.0), (3, 3, 4.0, 0.0, 0.0)]


def test_small_frames_are_matched_whole(spark, monkeypatch):
    rng, rows = np.random.default_rng(8), []
    for frame in range(4):
        # Spread rays, copies, a line along the epipolar direction and a few near it.
        spots = [*zip(rng.uniform(0, 2448, 90), rng.uniform(0, 2048, 90)), *zip(rng.uniform(0, 2448, 60), np.full(60, 700.0 + frame)),
                 *zip(rng.uniform(0, 2448, 9), 700.0 + frame + rng.uniform(-1e-3, 1e-3, 9))]
        spots += [spots[i] for i in rng.integers(0, len(spots), 60)]
        rows += [(frame, ("left", "right")[int(rng.random() < 0.4 + frame / 10)], i, float(u), float(v), "rig") for i, (u, v) in enumerate(spots)]
    rows += [(None, side, 0, 5.0, 5.0, "rig") for side in ("left", "right")] + [(9, "left", 0, 5.0, 5.0, "rig")]
    obs = spark.createDataFrame(rows, "frame_id long, side string, obs_id long, u double, v double, rig_id string")
    blocks, uses = stereo._match_blocks, []
    monkeypatch.setattr(stereo, "_match_blocks", lambda *args: uses.append(1) or blocks(*args))

    def matched(threshold):
        return sorted((*r[:-1], round(r[-1], 14)) for r in stereo.epipolar_match(obs, calibrations(spark), threshold).collect())

    whole = [matched(t) for t in (0.5, 0.001)]
    assert not uses and len(whole[0]) > len(whole[1]) > 0
    monkeypatch.setattr(stereo, "WHOLE", 2)
    assert matched(0.5) == whole[0] and uses


def test_small_binary_files_share_a_task(spark, tmp_path):
    rows = spark.range(900).selectExpr("concat('c', id % 30) AS cloud_id", "id div 30 AS point_id", "double(id) AS x", "1D AS y", "2D AS z")
    sinks.export_clouds(rows, f"{tmp_path}/small", "ply_binary")
    options = {"path": f"{tmp_path}/small"}
    assert len(binary_clouds.BinaryCloudReader(options).partitions()) == 1
    split = binary_clouds.BinaryCloudReader(options | {"splitBytes": "200"}).partitions()
    assert len(split) == sum(len(p.ranges) for p in split) > 30
    for given in ({}, {"splitBytes": "200"}):
        back = binary_clouds.read_binary_cloud(spark, f"{tmp_path}/small", **given)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_small_text_files_need_no_shuffle(spark, tmp_path, monkeypatch):
    ply = "ply\nformat ascii 1.0\nelement vertex {}\nproperty float y\nproperty float x\nproperty float z\n end_header \n{}"
    pcd = "# DATA ascii\nFIELDS x y z n\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 2\nWIDTH 3\nHEIGHT 1\nPOINTS {}\ndata ascii\n{}"
    files = {
        "cloud_id=a/2.ply": ply.format(3, "1 2 3\nnan 0 0\n4 5 6 7\n8 8 8"), "cloud_id=a/1.pcd": pcd.format(
            2, "# c\n\n1 2 3 0 0\n  .5\t-1e3 +2. 0 0\n9 9 9 9 9\n"),
        "cloud_id=b/crlf.ply": ply.format(2, "1 2 3\n4 5 6\n").replace("\n", "\r\n"), "cloud_id=b/bom.pcd": "\ufeff" + pcd.format(
            1, "1 2 3 0 0"), "cloud_id=c/wide.pcd": pcd.format(2, "1 2 3 0 0 0\n1 2 3 0\n1 2 3 0 0\n"),
        "cloud_id=c/odd.ply": ply.format(6, "1_0 2 3\n-nan 1 1\n\n1 two 3\n1 \u0661 3\n-NaN 1 INF\n7 7 7\n"),
        "cloud_id=d/short.ply": ply.format(9, "1 2 3\n"), "cloud_id=d/void.ply": ply.format(1, "inf 1 1\n"),
        "cloud_id=d/none.ply": ply.format(0, ""), "cloud_id=d/bare.ply": "ply\nend_headers\n", "cloud_id=d/bin.pcd": pcd.format(
            1, "").replace("data ascii", "DATA binary"), "cloud_id=d/data.pcd": "FIELDS x\nDATAascii\n", "cloud_id=d/list.ply": ply.format(
            1, "1 2 3\n").replace("float z", "list uchar int z"), "cloud_id=d/count.pcd": pcd.format("x", "1 2 3 4 5\n").replace("WIDTH 3", "WIDTH 0")}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())

    def read():
        points, rejects = text_clouds.read_ascii_cloud(spark, str(tmp_path), "permissive")
        found = [sorted(map(str, df.collect())) for df in (points, rejects)]
        return points._jdf.queryExecution().toString(), found

    plan, whole = read()
    assert "Window" not in plan
    assert len(whole[0]) == 8 and len(whole[1]) == 17
    monkeypatch.setattr(text_clouds, "WHOLE_BYTES", 0)
    assert read()[1] == whole


def test_a_cloud_of_many_parts(spark, clouds, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.ordered, "POINT_SLICE", 3)
    rng = np.random.default_rng(3)
    df = clouds(a=rng.normal(size=(20, 3)), b=rng.normal(size=(1, 3)), c=rng.normal(size=(7, 3)))
    want = sorted(map(str, df.collect()))
    for fmt in ("ply", "pcd_ascii"):
        made = sinks.export_clouds(df, str(tmp_path / fmt), fmt)
        assert sorted((r.cloud_id, r.n) for r in made.collect()) == [("a", 20), ("b", 1), ("c", 7)]
        assert sorted(map(str, text_clouds.read_ascii_cloud(spark, str(tmp_path / fmt)).collect())) == want
