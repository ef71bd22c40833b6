"""The point schema and the adapters from the provided tables.

A point is a row ``x, y, z, value`` (doubles), with ``point_id`` where the
table has a unique key; operators add columns, they never overwrite ``value``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Vec:
    """Three numbers: a position, a direction or a size."""

    x: float
    y: float
    z: float

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def dot(self, other: Vec) -> float:
        return sum(a * b for a, b in zip(self, other, strict=True))

    def length(self) -> float:
        return self.dot(self) ** 0.5

    def unit(self) -> Vec:
        n = self.length()
        if not n:
            raise ValueError("a direction may not be zero")
        return Vec(*(a / n for a in self))


def position() -> tuple[Column, Column, Column]:
    return F.col("x"), F.col("y"), F.col("z")


def dot(columns: tuple[Column, ...], v: Vec) -> Column:
    a, b, c = (col * F.lit(float(k)) for col, k in zip(columns, v, strict=True))
    return a + b + c


def less(columns: tuple[Column, ...], v: Vec) -> tuple[Column, ...]:
    return tuple(col - F.lit(float(k)) for col, k in zip(columns, v, strict=True))


def square(columns: tuple[Column, ...]) -> Column:
    a, b, c = columns
    return a * a + b * b + c * c


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without a key, one for each line item."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000.0).alias("y"), (F.col("l_partkey") / 40.0).alias("z"), (F.col("l_extendedprice") / 1000.0).alias("value"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a unique ``point_id``, one for each event."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = F.col("event_id")
    return t.select(e.alias("point_id"), (F.col("value") / 10.0).alias("x"), ((e * 37) % 1013 / 20.0).alias("y"), ((e * 91) % 997 / 20.0).alias("z"), (F.col("value") / 5.0).alias("value"))


#: The adapters in SQL.
LINEITEM_SQL = "SELECT l_quantity AS x, l_extendedprice / 2000.0 AS y, l_partkey / 40.0 AS z, l_extendedprice / 1000.0 AS value FROM lineitem"
EVENTS_SQL = "SELECT event_id AS point_id, value / 10.0 AS x, ((event_id * 37) % 1013) / 20.0 AS y, ((event_id * 91) % 997) / 20.0 AS z, value / 5.0 AS value FROM events"


def bounds(points: DataFrame) -> tuple[Vec, Vec] | None:
    """Smallest and largest corner (one aggregate); None for an empty table."""
    row = points.agg(*(f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES)).first()
    if row["lo_x"] is None:
        return None
    return Vec(*(row[f"lo_{a}"] for a in AXES)), Vec(*(row[f"hi_{a}"] for a in AXES))
