"""3-vectors as tuples of Columns: dot, cross, norm, matrix products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x: str | Column, y: str | Column, z: str | Column) -> Vec:
    return tuple(F.col(v) if isinstance(v, str) else v for v in (x, y, z))


def fields(column: str | Column) -> Vec:
    """The x, y, z fields of a struct column."""
    base = F.col(column) if isinstance(column, str) else column
    return (base["x"], base["y"], base["z"])


def pack(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE has it: infinite or NaN over zero, where plain division is an error."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    return scale(a, F.lit(1.0) / norm(a))


def entry(matrix: str | Column, row: int, column: int, width: int = 3) -> Column:
    """Entry of a row-major matrix stored as an array column."""
    base = F.col(matrix) if isinstance(matrix, str) else matrix
    return F.element_at(base, row * width + column + 1)


def mat_vec(matrix: str | Column, v: Vec) -> Vec:
    return tuple(dot(tuple(entry(matrix, r, c) for c in range(3)), v) for r in range(3))


def inverse3(matrix: str | Column) -> list[Vec]:
    """Rows of the inverse of a 3x3 matrix, by cofactors."""
    rows = [tuple(entry(matrix, r, c) for c in range(3)) for r in range(3)]
    c0, c1, c2 = cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])
    det = dot(rows[0], c0)
    return [tuple(c[i] / det for c in (c0, c1, c2)) for i in range(3)]


def finite(*columns: str | Column) -> Column:
    """True where every value is a number other than NaN and the infinities."""
    condition = F.lit(True)
    for item in columns:
        value = F.col(item) if isinstance(item, str) else item
        condition = condition & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return condition


def literal_sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def computed_once(df: DataFrame, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The same rows, whose ``columns`` the planner computes once per row. Conditions on computed columns would otherwise move below them
    and repeat their expressions, until the generated method is so long that the JVM does not compile it."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
