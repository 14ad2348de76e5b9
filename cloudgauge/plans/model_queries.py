"""Residuals, reports, fits, neighbours and defects on the point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.operators import defects, fit, models, neighbours
from cloudgauge.plans import recipes
from cloudgauge.plans.cloud_queries import FLAT, round_all
from cloudgauge.plans.recipes import with_sql
from cloudgauge.plans.registry import query


def xyz(x, y, z):
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"), F.lit(z).cast("double").alias("z"))


def shaped(spark: SparkSession, sf_dir: str, kind: str, **columns) -> DataFrame:
    base = recipes.models(spark, sf_dir).select("cloud_id")
    return base.withColumns({"kind": F.lit(kind), **columns})


def sphere(spark: SparkSession, sf_dir: str, radius: float = 20.0, diameter: float = 0.0, x: float = 25.0) -> DataFrame:
    return shaped(spark, sf_dir, "sphere", center=xyz(x, 52, 5), direction=xyz(0, 0, 1), radius=F.lit(radius),
                  standard_diameter=F.lit(diameter))


@query("signed_error_plane", sql=with_sql("points", body="""
SELECT cloud_id, point_id, ROUND(z - 5, 9) AS signed_error FROM points"""))
def q_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.signed_error(recipes.points(spark, sf_dir), recipes.models(spark, sf_dir))
    return round_all(out.select("cloud_id", "point_id", "signed_error"))


@query("signed_error_sphere", sql=with_sql("points", body="""
SELECT cloud_id, point_id, ROUND(SQRT((x - 25) * (x - 25) + (y - 52) * (y - 52) + (z - 5) * (z - 5)) - 15.5, 6) AS signed_error
FROM points"""))
def q_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.signed_error(recipes.points(spark, sf_dir), sphere(spark, sf_dir, 20.0, 31.0))
    return round_all(out.select("cloud_id", "point_id", "signed_error"), 6)


@query("signed_error_cylinder", sql=with_sql("points", body="""
SELECT cloud_id, point_id, ROUND(SQRT((x - 25) * (x - 25) + (z - 5) * (z - 5)) - 12, 6) AS signed_error FROM points"""))
def q_cylinder(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = shaped(spark, sf_dir, "cylinder", center=xyz(25, 52, 5), direction=xyz(0, 1, 0), radius=F.lit(12.0))
    return round_all(models.signed_error(recipes.points(spark, sf_dir), shape).select(
        "cloud_id", "point_id", "signed_error"), 6)


def surface(spark: SparkSession, sf_dir: str, kind: str, terms: int) -> DataFrame:
    coefficients = F.array(*[F.lit((i + 1) / 10.0) for i in range(terms)])
    return shaped(spark, sf_dir, kind, center=xyz(25, 52, 5), direction=xyz(0, 0, 1), basis_u=xyz(1, 0, 0),
                  basis_v=xyz(0, 1, 0), surface_scale=F.lit(40.0), coefficients=coefficients)


def _height_sql(degree: int) -> str:
    parts = [(x, total - x) for total in range(degree + 1) for x in range(total + 1)]
    terms = [f"CAST({(i + 1) / 10.0} AS DOUBLE) * POW((x - 25) / 40, {p}) * POW((y - 52) / 40, {q})"
             for i, (p, q) in enumerate(parts)]
    return with_sql("points", body="SELECT cloud_id, point_id, ROUND(z - 5 - (" + " + ".join(terms)
                    + "), 6) AS signed_error FROM points")


@query("signed_error_quadric", sql=_height_sql(2))
def q_quadric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.signed_error(recipes.points(spark, sf_dir), surface(spark, sf_dir, "quadric", 6))
    return round_all(out.select("cloud_id", "point_id", "signed_error"), 6)


@query("signed_error_quartic", sql=_height_sql(4))
def q_quartic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.signed_error(recipes.points(spark, sf_dir), surface(spark, sf_dir, "quartic", 15))
    return round_all(out.select("cloud_id", "point_id", "signed_error"), 6)


@query("nearest_model_error", sql=with_sql("points", body="""
, e AS (SELECT cloud_id, point_id, z - 5 AS e1, SQRT((x - 25) * (x - 25) + (y - 52) * (y - 52) + (z - 5) * (z - 5)) - 20 AS e2
  FROM points)
SELECT cloud_id, point_id, ROUND(CASE WHEN ABS(e2) < ABS(e1) THEN e2 ELSE e1 END, 6) AS signed_error FROM e"""))
def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.nearest_model_error(
        recipes.points(spark, sf_dir), recipes.models(spark, sf_dir), sphere(spark, sf_dir))
    return round_all(out.select("cloud_id", "point_id", "signed_error"), 6)


@query("residual_stats", sql=f"""
WITH points AS ({FLAT})
SELECT cloud_id, ROUND(AVG(z - 5), 7) AS me, ROUND(SQRT(AVG((z - 5) * (z - 5))), 7) AS rmse, ROUND(MAX(ABS(z - 5)), 7) AS max_abs,
  ROUND(MIN(z - 5), 7) AS axis_min, ROUND(MAX(z - 5), 7) AS axis_max, COUNT(*) AS n FROM points GROUP BY 1""")
def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(models.residual_stats(recipes.raw_points(spark, sf_dir), recipes.models(spark, sf_dir)), 7)


SHAPES = """CASE p_partkey % 3 WHEN 0 THEN 'plane' WHEN 1 THEN 'sphere' ELSE 'cylinder' END"""


@query("fit_report", sql=f"""
WITH m AS (SELECT p_partkey AS cloud_id, {SHAPES} AS kind, p_size / 10.0 AS radius,
  CASE WHEN p_partkey % 2 = 0 THEN p_size / 4.0 ELSE 0 END AS sd, p_retailprice AS hi, p_size AS lo,
  SIN(p_size) AS dx, COS(p_size) * 0.6 AS dy, COS(p_size) * 0.8 AS dz FROM part)
SELECT cloud_id, kind, CASE WHEN kind <> 'plane' THEN ROUND(radius * 2, 6) END AS diameter,
  CASE WHEN kind <> 'plane' AND sd > 0 THEN ROUND(radius * 2 - sd, 6) END AS diameter_deviation,
  CASE WHEN kind = 'cylinder' THEN ROUND(hi - lo, 6) END AS axial_length,
  CASE WHEN kind = 'plane' THEN ROUND(DEGREES(ACOS(LEAST(1.0, ABS(dz)))), 5) END AS angle_xy,
  CASE WHEN kind = 'plane' THEN ROUND(DEGREES(ACOS(LEAST(1.0, ABS(dy)))), 5) END AS angle_xz,
  CASE WHEN kind = 'plane' THEN ROUND(DEGREES(ACOS(LEAST(1.0, ABS(dx)))), 5) END AS angle_yz FROM m""")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = recipes.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cloud_id"), F.expr(SHAPES).alias("kind"),
        xyz(F.sin("p_size"), F.cos("p_size") * 0.6, F.cos("p_size") * 0.8).alias("direction"),
        (F.col("p_size") / 10).alias("radius"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_size / 4 ELSE 0D END").alias("standard_diameter"),
        F.col("p_size").cast("double").alias("axis_min"), F.col("p_retailprice").alias("axis_max"))
    out = models.fit_report(part).drop("direction", "radius", "standard_diameter", "axis_min", "axis_max")
    angles = {f"angle_{p}": F.round(f"angle_{p}", 5) for p in ("xy", "xz", "yz")}
    return round_all(out.withColumns(angles), 6)


@query("plane_angle", sql="""
SELECT s_suppkey AS cloud_id, ROUND(DEGREES(ACOS(LEAST(1.0, ABS(COS(s_suppkey) * COS(s_nationkey) + SIN(s_suppkey) * SIN(s_nationkey))))), 5)
  AS angle_deg FROM supplier""")
def q_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = recipes.table(spark, sf_dir, "supplier")

    def planes(angle: str) -> DataFrame:
        return base.select(F.col("s_suppkey").alias("cloud_id"), F.lit("plane").alias("kind"),
                           xyz(F.cos(angle), F.sin(angle), 0).alias("direction"))

    return round_all(models.plane_angle(planes("s_suppkey"), planes("s_nationkey")), 5)


@query("sphere_distance", sql="""
SELECT s_suppkey AS cloud_id, ROUND(SQRT(POW(s_acctbal - s_suppkey, 2) + POW(s_nationkey, 2)), 6) AS distance FROM supplier""")
def q_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = recipes.table(spark, sf_dir, "supplier")
    key, kind = F.col("s_suppkey").alias("cloud_id"), F.lit("sphere").alias("kind")
    first = base.select(key, kind, xyz(F.col("s_acctbal"), F.col("s_nationkey"), 1).alias("center"))
    second = base.select(key, kind, xyz(F.col("s_suppkey"), 0, 1).alias("center"))
    return round_all(models.sphere_distance(first, second), 6)


def axes_sql(rows: str, keys: str) -> str:
    """CTEs up to ``axis``: per group of ``rows`` the centre and, for the axes k = 0, 1, 2 of rising eigenvalue, the entries
    of the projection on the axis, ``(C - li)(C - lj) / ((lk - li)(lk - lj))`` with the other two eigenvalues."""
    others = {0: (1, 2), 1: (0, 2), 2: (0, 1)}
    entries = {
        "xx": "(a - {i}) * (a - {j}) + d * d + e * e", "yy": "(b - {i}) * (b - {j}) + d * d + f * f",
        "zz": "(c - {i}) * (c - {j}) + e * e + f * f", "xy": "(a - {i}) * d + d * (b - {j}) + e * f",
        "xz": "(a - {i}) * e + d * f + e * (c - {j})", "yz": "d * e + (b - {i}) * f + f * (c - {j})"}
    projections = ", ".join(
        f"({text.format(i=f'l{i}', j=f'l{j}')}) / ((l{k} - l{i}) * (l{k} - l{j})) AS {name}{k}"
        for k, (i, j) in others.items() for name, text in entries.items())
    return f"""
, centre AS (SELECT {keys}, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM {rows} GROUP BY {keys})
, cov AS (SELECT {keys}, MIN(cx) AS cx, MIN(cy) AS cy, MIN(cz) AS cz, AVG((x - cx) * (x - cx)) AS a, AVG((y - cy) * (y - cy)) AS b,
    AVG((z - cz) * (z - cz)) AS c, AVG((x - cx) * (y - cy)) AS d, AVG((x - cx) * (z - cz)) AS e, AVG((y - cy) * (z - cz)) AS f
  FROM {rows} JOIN centre USING ({keys}) GROUP BY {keys})
, mean AS (SELECT *, (a + b + c) / 3 AS q FROM cov)
, spread AS (SELECT *, SQRT(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p
  FROM mean)
, turn AS (SELECT *, ACOS(GREATEST(-1, LEAST(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e)
    + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 AS t FROM spread)
, eigen AS (SELECT *, q + 2 * p * COS(t) AS l2, q + 2 * p * COS(t + 2 * PI() / 3) AS l0,
    q + 2 * p * COS(t - 2 * PI() / 3) AS l1 FROM turn)
, axis AS (SELECT {keys}, cx, cy, cz, a + b + c - l2 <= 1e-13 * l2 AS collinear, {projections} FROM eigen)"""


@query("pca_axes", sql=f"WITH points AS ({FLAT})" + axes_sql("points", "cloud_id") + """
SELECT cloud_id, """ + ", ".join(f"ROUND({n}{k}, 6) AS {n}{k}" for k in range(3) for n in ("xx", "yy", "zz", "xy", "xz", "yz")) + """
FROM axis""")
def q_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each axis' components: the axis up to its sign."""
    axes = fit.pca(recipes.raw_points(spark, sf_dir))
    return axes.select("cloud_id", *[
        F.round(F.col(f"axis{k}")[n[0]] * F.col(f"axis{k}")[n[1]], 6).alias(f"{n}{k}")
        for k in range(3) for n in ("xx", "yy", "zz", "xy", "xz", "yz")])


# The three invariants of the covariance matrix determine its eigenvalues.
@query("pca_invariants", sql=f"""
WITH points AS ({FLAT}), m AS (SELECT cloud_id, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM points GROUP BY 1),
d AS (SELECT cloud_id, x - cx AS x, y - cy AS y, z - cz AS z, cx, cy, cz FROM points JOIN m USING (cloud_id)),
c AS (SELECT cloud_id, COUNT(*) AS n, MIN(cx) AS cx, MIN(cy) AS cy, MIN(cz) AS cz, AVG(x * x) AS a, AVG(y * y) AS b, AVG(z * z) AS c,
  AVG(x * y) AS d, AVG(x * z) AS e, AVG(y * z) AS f FROM d GROUP BY 1)
SELECT cloud_id, n, ROUND(cx, 6) AS center_x, ROUND(cy, 6) AS center_y, ROUND(cz, 6) AS center_z, ROUND(a + b + c, 6) AS trace,
  ROUND(a * b + a * c + b * c - d * d - e * e - f * f, 3) AS minors,
  ROUND((a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 1000, 3) AS determinant FROM c""")
def q_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fit.pca(recipes.raw_points(spark, sf_dir))
    e = [F.element_at("eigenvalues", i) for i in (1, 2, 3)]
    out = axes.select(
        "cloud_id", "n", *[F.round(f"center.{a}", 6).alias(f"center_{a}") for a in "xyz"],
        F.round(e[0] + e[1] + e[2], 6).alias("trace"),
        F.round(e[0] * e[1] + e[0] * e[2] + e[1] * e[2], 3).alias("minors"),
        F.round(e[0] * e[1] * e[2] / 1000, 3).alias("determinant"))
    return out


def flat_model(df: DataFrame) -> DataFrame:
    return df.select(
        "cloud_id", "kind", *[F.col("center")[a].alias(f"center_{a}") for a in "xyz"],
        *[F.col("direction")[a].alias(f"direction_{a}") for a in "xyz"], "radius", "me", "rmse", "max_abs", "n", "failure")


def fitted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return round_all(flat_model(fit.fit(recipes.points(spark, sf_dir), kind)), 6)


for _kind in fit.MINIMUM_POINTS:
    query(f"fit_{_kind}")(lambda spark, sf_dir, kind=_kind: fitted(spark, sf_dir, kind))


@query("fit_double_sphere")
def q_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = fit.fit_double_sphere(recipes.points(spark, sf_dir))
    return round_all(models.sphere_distance(first, second), 6)


# Shapes of known parameters over the keys of all order lines: one row is a point of a shape, one in seven (or 23) is an
# outlier that stands SHIFT off it. Twins state the parameters and the residuals of the outliers, to four decimals.
TRUTH_CLOUDS, SHIFT = 6, 2.0
KEY = "(l_orderkey * 8 + l_linenumber)"
SPOTS = f"""SELECT CAST({KEY} % {TRUTH_CLOUDS} AS STRING) AS cloud_id, CAST({KEY} % {TRUTH_CLOUDS} AS DOUBLE) AS c, {KEY} AS point_id,
  CAST({KEY} * 7919 % 10007 AS DOUBLE) / 10007 AS u, CAST({KEY} * 104729 % 10009 AS DOUBLE) / 10009 AS v,
  CASE WHEN {KEY} * 31 % 101 < 12 THEN CAST({SHIFT} AS DOUBLE) ELSE 0 END AS often, CASE WHEN {KEY} * 31 % 101 < 4 THEN CAST({SHIFT} AS DOUBLE) ELSE 0 END AS seldom
  FROM lineitem"""
SPHERE = ("{r} * SQRT(1 - (2 * v - 1) * (2 * v - 1)) * COS(2 * PI() * u)",
          "{r} * SQRT(1 - (2 * v - 1) * (2 * v - 1)) * SIN(2 * PI() * u)", "{r} * (2 * v - 1)")
BALL = tuple(a.format(r="(2 + c / 2 + often)") for a in SPHERE)
TUBE = ("(2 + c / 4 + seldom)", "COS(2 * PI() * u)", "SIN(2 * PI() * u)")
SURFACES = {"quadric": "0.03 * x * x + 0.01 * y * y", "quartic": "0.03 * x * x + 0.004 * x * x * y * y - 0.002 * y * y * y * y"}
TRUTH = {
    "plane": f"""SELECT cloud_id, point_id, (10 + c + often) * 0.6 + (20 * u - 10) * 0.8 AS x, 20 * v - 10 AS y,
  (10 + c + often) * 0.8 - (20 * u - 10) * 0.6 AS z, often AS off FROM ({SPOTS}) AS s""",
    "sphere": f"""SELECT cloud_id, point_id, 10 * c + 0.5 + {BALL[0]} AS x, -3 + {BALL[1]} AS y, 7 + {BALL[2]} AS z, often AS off FROM ({SPOTS}) AS s""",
    "cylinder": f"""SELECT cloud_id, point_id, c + {TUBE[0]} * {TUBE[1]} AS x, (40 * v - 20) * 0.6 + {TUBE[0]} * {TUBE[2]} * 0.8 AS y,
  (40 * v - 20) * 0.8 - {TUBE[0]} * {TUBE[2]} * 0.6 AS z, seldom AS off FROM ({SPOTS}) AS s""",
} | {
    # Mirrored in both axes, so that the normal of the points is the z axis.
    kind: f"""SELECT cloud_id, point_id, x, y, {height} + seldom + c AS z, seldom AS off FROM (
  SELECT cloud_id, c, seldom, point_id * 4 + (i + 1) + (j + 1) // 2 AS point_id, i * (0.1 + 4 * u) AS x, j * (0.1 + 3 * v) AS y
  FROM ({SPOTS}) AS s, (SELECT * FROM (VALUES (1), (-1)) AS a(i)) AS ai, (SELECT * FROM (VALUES (1), (-1)) AS b(j)) AS bj) AS m"""
    for kind, height in SURFACES.items()}
#: What each twin states of a model besides its residuals: columns of the query and their true values.
STATED = {
    "plane": {"direction.x": "0.6", "direction.y": "0.0", "direction.z": "0.8", "offset": "-10 - CAST(cloud_id AS DOUBLE)"},
    "sphere": {"center.x": "10 * CAST(cloud_id AS DOUBLE) + 0.5", "center.y": "-3.0", "center.z": "7.0", "radius": "2 + CAST(cloud_id AS DOUBLE) / 2"},
    "cylinder": {"direction.x": "0.0", "direction.y": "0.6", "direction.z": "0.8", "radius": "2 + CAST(cloud_id AS DOUBLE) / 4", "center.x": "CAST(cloud_id AS DOUBLE)"},
    "quadric": {"direction.x": "0.0", "direction.z": "1.0"}, "quartic": {"direction.x": "0.0", "direction.z": "1.0"},
}


def truth_points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The same rows as the twin's, from the same text; whole division is written differently."""
    sql = TRUTH[kind].replace("//", "div").replace("FROM lineitem", "FROM {lines}")
    return spark.sql(sql, lines=recipes.table(spark, sf_dir, "lineitem")).drop("off")


def truth_sql(kind: str) -> str:
    stated = ", ".join(f"ROUND(CAST({value} AS DOUBLE), 4) AS {name.replace('.', '_')}" for name, value in STATED[kind].items())
    return f"""SELECT cloud_id, '{kind}' AS kind, COUNT(*) AS n, ROUND(AVG(off), 4) AS me, ROUND(SQRT(AVG(off * off)), 4) AS rmse,
  ROUND(MAX(off), 4) AS max_abs, {stated} FROM ({TRUTH[kind]}) AS p GROUP BY cloud_id"""


def true_fit(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = fit.fit(truth_points(spark, sf_dir, kind), kind)
    stated = [(F.round(name, 4) + 0.0).alias(name.replace(".", "_")) for name in STATED[kind]]
    return found.filter("failure IS NULL").select(
        "cloud_id", "kind", "n", *[(F.round(n, 4) + 0.0).alias(n) for n in ("me", "rmse", "max_abs")], *stated)


for _kind in fit.MINIMUM_POINTS:
    query(f"fit_known_{_kind}", sql=truth_sql(_kind))(lambda spark, sf_dir, kind=_kind: true_fit(spark, sf_dir, kind))

PAIR = tuple(a.format(r="CASE WHEN point_id % 5 < 2 THEN 2 + c / 8 ELSE 3 + c / 8 END") for a in SPHERE)
TWO_BALLS = f"""SELECT cloud_id, point_id, CASE WHEN point_id % 5 < 2 THEN -8 - c ELSE 8 END + {PAIR[0]} AS x, {PAIR[1]} AS y,
  CASE WHEN point_id % 5 < 2 THEN 0 ELSE 6 END + {PAIR[2]} AS z FROM ({SPOTS}) AS s"""


@query("fit_known_double_sphere", sql=f"""
SELECT cloud_id, ROUND(SQRT((16 + CAST(cloud_id AS DOUBLE)) * (16 + CAST(cloud_id AS DOUBLE)) + 36), 4) AS distance,
  COUNT(*) AS n FROM ({TWO_BALLS}) AS p GROUP BY cloud_id""")
def q_known_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.sql(TWO_BALLS.replace("FROM lineitem", "FROM {lines}"), lines=recipes.table(spark, sf_dir, "lineitem"))
    first, second = fit.fit_double_sphere(points)
    both = models.sphere_distance(first, second).select("cloud_id", F.round("distance", 4).alias("distance"))
    sizes = first.select("cloud_id", "n").unionByName(second.select("cloud_id", "n")).groupBy("cloud_id").agg(F.sum("n").alias("n"))
    return both.join(sizes, "cloud_id")


GAPS = """
, pairs AS (SELECT a.cloud_id, a.point_id, b.point_id AS other, SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
   + (a.z - b.z) * (a.z - b.z)) AS d FROM points a JOIN points b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id)
, near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cloud_id, point_id ORDER BY d, other) AS rank FROM pairs
   QUALIFY rank <= 8)"""


@query("knn", sql=with_sql("points", body=GAPS + """
SELECT cloud_id, point_id, rank, other AS neighbour_id, ROUND(d, 6) AS distance FROM near"""))
def q_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(neighbours.knn(recipes.points(spark, sf_dir), 8).select(
        "cloud_id", "point_id", "rank", "neighbour_id", "distance"), 6)


@query("statistical_outlier_removal", sql=with_sql("points", body=GAPS + """
, m AS (SELECT cloud_id, point_id, AVG(d) AS m FROM near GROUP BY 1, 2)
, l AS (SELECT cloud_id, AVG(m) + STDDEV_SAMP(m) AS lim FROM m GROUP BY 1)
SELECT cloud_id, point_id FROM m JOIN l USING (cloud_id) WHERE m <= lim"""))
def q_sor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.statistical_outlier_removal(recipes.points(spark, sf_dir), 8, 1.0).select("cloud_id", "point_id")


@query("estimate_spacing", sql=with_sql("points", body=GAPS + """
, c AS (SELECT DISTINCT cloud_id FROM points)
, v AS (SELECT cloud_id, d, ROW_NUMBER() OVER (PARTITION BY cloud_id ORDER BY d) - 1 AS i, COUNT(*) OVER (PARTITION BY cloud_id) AS n
   FROM near WHERE rank = 1 AND d > 0)
SELECT cloud_id, ROUND(COALESCE(MAX(CASE WHEN i = n // 2 THEN d END), 0), 6) AS spacing FROM c LEFT JOIN v USING (cloud_id)
GROUP BY 1"""))
def q_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(neighbours.estimate_spacing(recipes.points(spark, sf_dir)), 6)


@query("radius_pairs", sql=with_sql("points", body="""
SELECT a.cloud_id, a.point_id, COUNT(*) AS n FROM points a JOIN points b ON a.cloud_id = b.cloud_id
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 6.25 GROUP BY 1, 2"""))
def q_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.radius_pairs(recipes.points(spark, sf_dir), 2.5)
    return pairs.groupBy("cloud_id", "point_id").agg(F.count(F.lit(1)).alias("n"))


@query("radius_counts", sql=with_sql("points", body="""
SELECT a.cloud_id, a.point_id, COUNT(*) AS neighbours FROM points a JOIN points b ON a.cloud_id = b.cloud_id
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 225 GROUP BY 1, 2"""))
def q_radius_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.radius_counts(recipes.points(spark, sf_dir), 15.0)


@query("measure_defects", sql=with_sql("points", body="""
, far AS (SELECT cloud_id, point_id, x, y, z, z < 5 AS dent FROM points WHERE ABS(z - 5) >= 5)
, edges AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst FROM far a JOIN far b ON a.cloud_id = b.cloud_id AND a.dent = b.dent
   AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 25)
, label AS (WITH RECURSIVE reach AS (SELECT cloud_id, point_id, point_id AS label FROM far
   UNION SELECT r.cloud_id, e.dst, r.label FROM reach r JOIN edges e ON e.cloud_id = r.cloud_id AND e.src = r.point_id)
   SELECT cloud_id, point_id, MIN(label) AS label FROM reach GROUP BY 1, 2)
, member AS (SELECT cloud_id, label, x, y, z FROM (SELECT *, COUNT(*) OVER (PARTITION BY cloud_id, label) AS n
   FROM label JOIN points USING (cloud_id, point_id)) WHERE n >= 3)""" + axes_sql("member", "cloud_id, label") + """
, along AS (SELECT cloud_id, label, z, collinear, """ + ", ".join(f"""
   CASE GREATEST(xx{k}, yy{k}, zz{k}) WHEN xx{k} THEN ((x - cx) * xx{k} + (y - cy) * xy{k} + (z - cz) * xz{k}) / SQRT(xx{k})
     WHEN yy{k} THEN ((x - cx) * xy{k} + (y - cy) * yy{k} + (z - cz) * yz{k}) / SQRT(yy{k})
     ELSE ((x - cx) * xz{k} + (y - cy) * yz{k} + (z - cz) * zz{k}) / SQRT(zz{k}) END AS s{k}""" for k in (1, 2)) + """
  FROM member JOIN axis USING (cloud_id, label))
SELECT cloud_id, label AS defect_id, BOOL_OR(z < 5) AS dent, COUNT(*) AS n, ROUND(MAX(ABS(z - 5)), 6) AS max_depth,
  ROUND(MAX(s2) - MIN(s2), 5) AS length, ROUND(CASE WHEN BOOL_OR(collinear) THEN 0 ELSE MAX(s1) - MIN(s1) END, 4) AS width,
  ROUND(CASE WHEN BOOL_OR(collinear) THEN 0 ELSE (MAX(s2) - MIN(s2)) * (MAX(s1) - MIN(s1)) END, 3) AS area
FROM along GROUP BY 1, 2"""))
def q_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = defects.measure_defects(recipes.points(spark, sf_dir), recipes.models(spark, sf_dir), 5.0, 5.0, 3)
    return found.select(
        "cloud_id", "defect_id", "dent", "n", F.round("max_depth", 6).alias("max_depth"), F.round("length", 5).alias("length"),
        F.round("width", 4).alias("width"), F.round("area", 3).alias("area"))


@query("sample_stride", sql=with_sql("points", body="""
, c AS (SELECT cloud_id, COUNT(*) AS n, LEAST(COUNT(*), 100) AS k FROM points GROUP BY 1)
SELECT cloud_id, (i * n) // k AS point_id, i FROM c, LATERAL (SELECT UNNEST(RANGE(k)) AS i)"""))
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fit.fit_sample(recipes.points(spark, sf_dir), ["cloud_id"], 100)
    return rows.select("cloud_id", "point_id", F.col("_i").alias("i"))


