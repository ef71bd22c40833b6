"""Row-wise maps, spatial predicates, crops and samples: column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.points import AXES, Vec, bounds, dot, less, position, square


def _moved(points: DataFrame, columns) -> DataFrame:
    return points.withColumns(dict(zip(AXES, columns, strict=True)))


def translate(points: DataFrame, origin: Vec) -> DataFrame:
    """Positions relative to ``origin``."""
    return _moved(points, less(position(), origin))


def scale(points: DataFrame, factor: Vec | float, origin: Vec = Vec(0, 0, 0)) -> DataFrame:
    """Scale about ``origin``, by one factor or one for each axis."""
    factors = factor if isinstance(factor, Vec) else Vec(factor, factor, factor)
    return _moved(points, [c * F.lit(float(k)) + F.lit(float(o)) for c, k, o in zip(less(position(), origin), factors, origin, strict=True)])


def rotation(axis: Vec, degrees: float) -> list[Vec]:
    """Rows of the matrix that turns by ``degrees`` about ``axis`` (right-handed)."""
    u, c, s = axis.unit(), math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y, z, k = u.x, u.y, u.z, 1 - math.cos(math.radians(degrees))
    return [Vec(c + x * x * k, x * y * k - z * s, x * z * k + y * s), Vec(y * x * k + z * s, c + y * y * k, y * z * k - x * s), Vec(z * x * k - y * s, z * y * k + x * s, c + z * z * k)]


def rotate(points: DataFrame, axis: Vec, degrees: float, origin: Vec = Vec(0, 0, 0)) -> DataFrame:
    """Turn about an axis through ``origin``, clockwise seen against the axis (by minus the angle)."""
    away = less(position(), origin)
    return _moved(points, [dot(away, row) + F.lit(float(o)) for row, o in zip(rotation(axis, -degrees), origin, strict=True)])


def translate_value(points: DataFrame, by: float) -> DataFrame:
    return points.withColumn("value", F.col("value") + F.lit(float(by)))


def noise(points: DataFrame, size: float, seed: int, gaussian: bool = False) -> DataFrame:
    """White noise in a box of edge ``size``, or Gaussian noise of that deviation."""
    draw = (lambda k: F.randn(seed + k)) if gaussian else (lambda k: F.rand(seed + k) - 0.5)
    return _moved(points, [c + F.lit(float(size)) * draw(k) for k, c in enumerate(position())])


def shuffle_values(points: DataFrame, seed: int, key: str = "point_id", chunks: int = 1024) -> DataFrame:
    """Values dealt anew to positions at random; the multiset of values stays.

    Rows and values are each ranked in random order within a random chunk, and
    the sides meet on (chunk rank offsets): no single task sees all rows.
    """

    def ranked(df: DataFrame, salt: int, name: str) -> DataFrame:
        order = F.xxhash64(F.col(key), F.lit(seed * 2 + salt))
        df = df.withColumn("_chunk", F.pmod(F.xxhash64(F.col(key), F.lit(seed * 2 + salt + 7919)), F.lit(chunks)))
        before = df.groupBy("_chunk").agg(F.count("*").alias("_n"))
        before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        row = F.row_number().over(Window.partitionBy("_chunk").orderBy(order, key))
        return df.withColumn("_row", row).join(F.broadcast(before), "_chunk").withColumn(name, F.col("_before") + F.col("_row")).drop("_chunk", "_row", "_before")

    places = ranked(points.drop("value"), 0, "_rank")
    values = ranked(points.select(key, "value"), 1, "_rank").select("_rank", "value")
    return places.join(values, "_rank").select(*points.columns)


def bound_centre(points: DataFrame) -> Vec | None:
    found = bounds(points)
    return found and Vec(*((a + b) / 2 for a, b in zip(*found, strict=True)))


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(*(F.avg(a).alias(a) for a in AXES))


def stream_centroid(points: DataFrame, stream: str) -> DataFrame:
    """Mean of the streams' centroids, each stream counting once."""
    return points.groupBy(stream).agg(*(F.avg(a).alias(a) for a in AXES)).agg(*(F.avg(a).alias(a) for a in AXES))


def in_sphere(centre: Vec, radius: float) -> Column:
    return square(less(position(), centre)) < F.lit(float(radius) ** 2)


def in_front(origin: Vec, normal: Vec) -> Column:
    return dot(less(position(), origin), normal) > 0


def along(origin: Vec, axis: Vec) -> tuple[Column, Column]:
    """(distance along the axis from ``origin``, squared distance from the axis)."""
    away = less(position(), origin)
    t = dot(away, axis.unit())
    return t, square(away) - t * t


def in_cylinder(origin: Vec, axis: Vec, radius: float) -> Column:
    """Centred on ``origin``, as long as ``axis``."""
    t, off = along(origin, axis)
    return (F.abs(t) < axis.length() / 2) & (off < F.lit(float(radius) ** 2))


def in_box(centre: Vec, half: Vec) -> Column:
    out = None
    for c, o, h in zip(position(), centre, half, strict=True):
        inside = (c > F.lit(float(o - h))) & (c < F.lit(float(o + h)))
        out = inside if out is None else out & inside
    return out


def clip(points: DataFrame, inside: Column, invert: bool = False) -> DataFrame:
    """Points inside (all comparisons strict), or the others."""
    return points.where(~inside if invert else inside)


def crop_value(points: DataFrame, low: float, high: float) -> DataFrame:
    """``low <= value < high``."""
    return points.where((F.col("value") >= low) & (F.col("value") < high))


def sample_fraction(points: DataFrame, fraction: float, seed: int) -> DataFrame:
    return points.sample(fraction=fraction, seed=seed)


def sample_count(points: DataFrame, n: int, seed: int, key: str = "point_id", by: str | None = None) -> DataFrame:
    """Exactly ``n`` rows (of each ``by``), or all if there are fewer: those of least seeded hash."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    if by is None:
        return points.orderBy(order, key).limit(n)
    # a first cut per chunk keeps a frequent kind from gathering in one task
    chunk = F.pmod(F.xxhash64(F.col(key)), F.lit(256))
    part = points.withColumn("_c", chunk).withColumn("_r", F.row_number().over(Window.partitionBy(by, "_c").orderBy(order, key))).where(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("_r") <= n).drop("_r", "_c")


def sample_by(points: DataFrame, by: str, fractions: dict, seed: int) -> DataFrame:
    return points.sampleBy(by, fractions, seed)


def throttle(points: DataFrame, limit: int, seed: int) -> DataFrame:
    """All points, or a Bernoulli sample of about ``limit``."""
    n = points.count()
    return points if n <= limit else points.sample(fraction=limit / n, seed=seed)


def colour_bucket(points: DataFrame, colours: int, low: float, high: float, reverse: bool = False) -> DataFrame:
    """Add ``bucket``: the clamped value's place among ``colours`` steps."""
    t = F.least(F.greatest((F.col("value") - low) / F.lit(float(high - low)), F.lit(0.0)), F.lit(1.0))
    bucket = F.floor(t * (colours - 1)).cast("int")
    return points.withColumn("bucket", (colours - 1) - bucket if reverse else bucket)


def _jet(t: Column) -> list[Column]:
    ramp = lambda peak: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * t - peak)))
    return [ramp(3.0), ramp(2.0), ramp(1.0)]


#: Red, green and blue of a value from 0 to 1.
COLOUR_MAPS = {
    "grey": lambda t: [t, t, t],
    "jet": _jet,
    "hot": lambda t: [F.least(t * 3, F.lit(1.0)), F.least(F.greatest(t * 3 - 1, F.lit(0.0)), F.lit(1.0)), F.greatest(t * 3 - 2, F.lit(0.0))],
    "cold": lambda t: [F.greatest(t * 3 - 2, F.lit(0.0)), F.least(F.greatest(t * 3 - 1, F.lit(0.0)), F.lit(1.0)), F.least(t * 3, F.lit(1.0))],
    "blue": lambda t: [t * 0, t * 0, t],
    "positive": lambda t: [t, t * t, t * 0],
    "negative": lambda t: [1 - t, t * 0, t],
    "colour": lambda t: [F.abs(2 * t - 1), 1 - F.abs(2 * t - 1), 1 - t],
    "cyclic": lambda t: [(1 + F.cos(t * 2 * math.pi)) / 2, (1 + F.cos(t * 2 * math.pi - 2 * math.pi / 3)) / 2, (1 + F.cos(t * 2 * math.pi - 4 * math.pi / 3)) / 2],
    "random": lambda t: [F.pmod(F.xxhash64(t, F.lit(k)), F.lit(256)) / 255.0 for k in range(3)],
}


def colour(points: DataFrame, name: str, low: float, high: float, reverse: bool = False) -> DataFrame:
    """Add ``r``, ``g`` and ``b`` from 0 to 1."""
    t = F.least(F.greatest((F.col("value") - low) / F.lit(float(high - low)), F.lit(0.0)), F.lit(1.0))
    return points.withColumns(dict(zip("rgb", COLOUR_MAPS[name](1 - t if reverse else t), strict=True)))
