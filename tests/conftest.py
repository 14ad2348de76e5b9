import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cloudgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), "cloudgauge-tests", spark__sql__shuffle__partitions="4")


def cloud_frame(name, points):
    points = np.asarray(points, dtype=float)
    return pd.DataFrame({
        "cloud_id": name, "point_id": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})


@pytest.fixture()
def clouds(spark):
    def make(**named):
        return spark.createDataFrame(
            pd.concat([cloud_frame(n, p) for n, p in named.items()]),
            "cloud_id string, point_id long, x double, y double, z double")

    return make


def grid_plane(z=2.0):
    x, y = np.meshgrid(np.arange(-10.0, 11.0), np.arange(-10.0, 11.0))
    return np.column_stack([x.ravel(), y.ravel(), np.full(x.size, z)])


def sphere(center, radius):
    rows = []
    for i in range(11):
        lat = -1.4 + 2.8 * i / 10
        for j in range(24):
            a = 2 * np.pi * j / 24
            rows.append([radius * np.cos(lat) * np.cos(a), radius * np.cos(lat) * np.sin(a), radius * np.sin(lat)])
    return np.array(rows) + np.asarray(center, dtype=float)


def cylinder(height):
    axis = np.array([1.0, 2.0, 3.0]) / np.sqrt(14.0)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    turn = np.eye(3) + np.sin(0.7) * k + (1 - np.cos(0.7)) * k @ k
    rows = [[2 * np.cos(2 * np.pi * j / 36), 2 * np.sin(2 * np.pi * j / 36), -height / 2 + height * i / 14]
            for i in range(15) for j in range(36)]
    return np.array(rows) @ turn.T + [10, -3, 4]
