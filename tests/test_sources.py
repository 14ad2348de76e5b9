import datetime
import json
import struct

import pytest
from pyspark.sql import functions as F

from cloudgauge.sources import sinks, station
from cloudgauge.sources.binary_clouds import read_binary_cloud
from cloudgauge.sources.text_clouds import read_ascii_cloud, read_xyz_text


def rows(df):
    return [(r.cloud_id, r.point_id, r.x, r.y, r.z) for r in df.orderBy("cloud_id", "point_id").collect()]


def test_xyz_text(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# head\n1,2,3 extra\n\n  4 5 6e1 # tail\nnan 0 0\n")
    (tmp_path / "b.txt").write_text("7 8 9\r\n")
    (tmp_path / "skip.dat").write_text("not a cloud\n")
    assert rows(read_xyz_text(spark, str(tmp_path))) == [
        ("a", 0, 1, 2, 3), ("a", 1, 4, 5, 60), ("b", 0, 7, 8, 9)]


def test_xyz_text_faults(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1 2 3\n1 two 3\n")
    (tmp_path / "b.xyz").write_text("# nothing\nnan nan nan\n")
    points, rejects = read_xyz_text(spark, str(tmp_path), "permissive")
    assert points.count() == 1
    assert sorted((r.cloud_id, r.reason) for r in rejects.collect()) == [
        ("a", "invalid point data"), ("b", "no valid points")]
    with pytest.raises(Exception, match="invalid point data|no valid points"):
        read_xyz_text(spark, str(tmp_path)).collect()


def test_ascii_pcd_and_ply(spark, tmp_path):
    (tmp_path / "p.pcd").write_text(
        "# c\nVERSION .7\nFIELDS intensity z X y\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 2 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 0\n"
        "DATA ascii\n9 9 3.75 1.25 2.5\n# note\n9 9 6 -4 5\nsurplus\n")
    (tmp_path / "q.ply").write_text(
        "ply\nformat ascii 1.0\ncomment x\nelement vertex 1\nproperty uchar red\nproperty float z\nproperty float x\n"
        "property float y\nelement face 1\nproperty list uchar int i\nend_header\n7 3 1 2 99\n3 0 0 0\n")
    assert rows(read_ascii_cloud(spark, str(tmp_path))) == [
        ("p", 0, 1.25, 2.5, 3.75), ("p", 1, -4, 5, 6), ("q", 0, 1, 2, 3)]


def test_ascii_faults(spark, tmp_path):
    head = "FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA {}\n1 2 3\n"
    (tmp_path / "short.pcd").write_text(head.format("ascii"))
    (tmp_path / "packed.pcd").write_text(head.format("binary_compressed"))
    (tmp_path / "noxyz.pcd").write_text(head.format("ascii").replace("FIELDS x", "FIELDS w"))
    (tmp_path / "cut.pcd").write_text("FIELDS x y z\n")
    (tmp_path / "wide.pcd").write_text(head.format("ascii").replace("1 2 3\n", "1 2 3 4\n1 2 3\n"))
    _, rejects = read_ascii_cloud(spark, str(tmp_path), "permissive")
    assert sorted((r.cloud_id, r.reason) for r in rejects.collect()) == [
        ("cut", "incomplete header"), ("noxyz", "missing scalar x, y, z"), ("packed", "unsupported encoding"),
        ("short", "file ended before all points were read"), ("wide", "invalid record")]


def test_binary_sources(spark, tmp_path):
    ply = (b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty uchar red\nproperty float z\n"
           b"property float x\nproperty float y\nend_header\n")
    body = struct.pack("<Bfff", 1, 3, 1, 2) + struct.pack("<Bfff", 1, float("nan"), 1, 2) + struct.pack("<Bfff", 1, 6, 4, 5)
    (tmp_path / "b.ply").write_bytes(ply + body)
    pcd = (b"FIELDS x y z n\nSIZE 8 2 4 1\nTYPE F I U U\nCOUNT 1 1 1 3\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n")
    body = struct.pack("<dhIBBB", 0.5, -2, 7, 0, 0, 0) + struct.pack("<dhIBBB", 1.5, 3, 4000000000, 0, 0, 0)
    (tmp_path / "c.pcd").write_bytes(pcd + body)
    for split in ("1000000", "60"):
        assert rows(read_binary_cloud(spark, str(tmp_path), splitBytes=split)) == [
            ("b", 0, 1, 2, 3), ("b", 1, 4, 5, 6), ("c", 0, 0.5, -2, 7), ("c", 1, 1.5, 3, 4e9)]


@pytest.mark.parametrize("content", [
    b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n",
    b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n",
    b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n",
])
def test_binary_rejects(spark, tmp_path, content):
    (tmp_path / "b.ply").write_bytes(content)
    with pytest.raises(Exception, match="unsupported|ended before"):
        read_binary_cloud(spark, str(tmp_path)).collect()


def test_text_round_trip(spark, clouds, tmp_path):
    df = clouds(a=[(0.1, 1 / 3, 1e-30), (1e300, -2, 3)], b=[(1, 2, 3)])
    sinks.write_xyz_text(df, str(tmp_path / "out"))
    back = read_xyz_text(spark, str(tmp_path / "out"), glob="*.txt")
    assert rows(back) == rows(df)
    sinks.write_error_csv(df.withColumn("signed_error", F.col("z")), str(tmp_path / "err"))
    lines = spark.read.csv(str(tmp_path / "err"), header=True)
    assert lines.columns == ["index", "x_mm", "y_mm", "z_mm", "signed_error_mm", "cloud_id"]
    assert sorted(r["index"] for r in lines.collect()) == ["1", "1", "2"]


def test_export_and_publish(spark, clouds, tmp_path):
    df = clouds(a=[(0.1, 1 / 3, 1), (float("nan"), 0, 0), (2, 3, 4)], b=[(1, 2, 3)])
    made = {r.cloud_id: r.n for r in sinks.export_clouds(df, str(tmp_path / "ply"), "ply").collect()}
    assert made == {"a": 2, "b": 1}
    assert rows(read_ascii_cloud(spark, str(tmp_path / "ply"))) == [
        ("a", 0, 0.1, 1 / 3, 1), ("a", 1, 2, 3, 4), ("b", 0, 1, 2, 3)]
    sinks.export_clouds(df, str(tmp_path / "pcd"), "pcd")
    assert len(rows(read_binary_cloud(spark, str(tmp_path / "pcd")))) == 3
    stamp = datetime.datetime(2026, 9, 17, 17, 30, 1, 123000)
    sessions = spark.createDataFrame(
        [("/c/20260917_173001_123", stamp), ("/c/other", stamp), ("/c/empty", stamp)], "session_path string, created_ts timestamp")
    points = df.withColumn("session_path", F.when(F.col("cloud_id") == "a", sessions.collect()[0][0]).otherwise("/c/other"))
    names = []
    for _ in range(2):
        done = sinks.publish_results(points, sessions, str(tmp_path / "res"), str(tmp_path / "catalog"))
        names += [r.name for r in done.collect()]
    base = "point_cloud_20260917_173001_123"
    assert sorted(names) == [base, base + "_1", base + "_2", base + "_3"]
    assert len(list((tmp_path / "res").glob("*.pcd"))) == 4 and len(list((tmp_path / "res").glob("*.txt"))) == 4
    assert not [p for p in (tmp_path / "res").iterdir() if p.name.startswith(".")]


def test_images_audit_packs(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "sub/c.tiff", "no.txt"):
        path = tmp_path / "img" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    ranked = station.image_manifest(spark, str(tmp_path / "img")).orderBy("rank").collect()
    assert [r.path.rsplit("/", 1)[1] for r in ranked] == ["a.jpg", "b.PNG", "c.tiff"]
    assert station.image_manifest(spark, str(tmp_path / "img"), 1, 9).count() == 2
    assert station.image_manifest(spark, str(tmp_path / "img"), 5, -1).count() == 0
    (tmp_path / "audit.txt").write_text(
        "index\tleft\tright\ta\tb\tc\td\n1\t5\t6\t0\t0\t10\t11\n2\t6\t7\t0\t0\t12\t13\n\nfinished 2 pairs\n")
    audit = station.read_frame_audit(spark, str(tmp_path / "audit.txt"))
    assert [r.left_frame_number for r in audit.orderBy("index").collect()] == [5, 6]
    station.write_frame_audit(audit, str(tmp_path / "audit_out"))
    assert station.read_frame_audit(spark, str(tmp_path / "audit_out")).count() == 2
    (tmp_path / "packs.json").write_text(json.dumps(
        {"_note": "x", "packs": [{"name": "n", "content": "55\nWAIT 1", "_extra": 1}, {"name": "m", "content": ""}]}, indent=1))
    packs = station.read_command_packs(spark, str(tmp_path / "packs.json")).orderBy("position").collect()
    assert [(p.name, p.content) for p in packs] == [("n", "55\nWAIT 1"), ("m", "")]


def test_logs(spark, tmp_path):
    stamp = datetime.datetime(2026, 9, 17, 17, 30, 1, 123000)
    df = spark.createDataFrame(
        [(stamp, level, "Mod", "two\nlines\r") for level in ("Debug", "Info", "Warning", "Error")],
        "ts timestamp, level string, module string, text string")
    station.write_logs(df, str(tmp_path / "log"))
    back = station.read_logs(spark, str(tmp_path / "log")).collect()
    assert sorted(r.level for r in back) == ["Error", "Info", "Warning"]
    assert {(r.ts, r.module, r.text) for r in back} == {(stamp, "Mod", "two\nlines\r")}


def test_station_config(spark, tmp_path):
    (tmp_path / "good.ini").write_text("﻿; note\ntop=1\n[reconstruction]\r\ngrayThreshold = 200\n# x\n\nempty=\n")
    (tmp_path / "bad.ini").write_text("[a]\nk=1\nno separator\n")
    (tmp_path / "twice.ini").write_text("[a]\nk=1\n[b]\nk=2\n[a]\nk=3\n")
    kv, errors = station.read_station_config(spark, str(tmp_path))
    assert sorted((r.key, r.value, r.line_no) for r in kv.collect()) == [
        ("reconstruction/empty", "", 7), ("reconstruction/grayThreshold", "200", 4), ("top", "1", 2)]
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no, r.reason) for r in errors.collect()) == [
        ("bad.ini", 3, "not key=value"), ("twice.ini", 6, "repeated key")]
