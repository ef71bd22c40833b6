"""Distance and nearest-neighbour joins, and what is made of near pairs.

All go through :mod:`pointloom.operators.blocks`: counts, bins and nearest
neighbours are made where the points of a cell meet, so pairs become rows only
where pairs are the result.  Nearest neighbours come from a search whose radius
doubles for the sources that found too few, and from trees where targets are far.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators import blocks, far
from pointloom.points import AXES, Vec, bounds
from pointloom.scratch import cut


def _pair_schema(sources: DataFrame, targets: DataFrame, positions: bool, source_columns: tuple[str, ...], target_columns: tuple[str, ...]) -> T.StructType:
    fields = [T.StructField(c, T.LongType()) for c in ("s_point_id", "t_point_id")]
    if positions:
        fields += [T.StructField(f"{p}{a}", T.DoubleType()) for p in ("s_", "t_") for a in AXES]
    for p, df, names in (("s_", sources, source_columns), ("t_", targets, target_columns)):
        fields += [T.StructField(f"{p}{c}", df.schema[c].dataType) for c in names]
    return T.StructType([*fields, T.StructField("d2", T.DoubleType())])


def radius_join(sources: DataFrame, targets: DataFrame, radius: float, inclusive: bool = False, keep_self: bool = False, source_columns: tuple[str, ...] = (), target_columns: tuple[str, ...] = (), positions: bool = False) -> DataFrame:
    """Pairs ``s_point_id, t_point_id, d2`` with ``d2 < radius**2`` (``<=`` if inclusive).

    A point is no neighbour of itself (same ``point_id``).  Further columns, and
    with ``positions`` the coordinates, have the prefixes ``s_`` and ``t_``.
    """
    schema = _pair_schema(sources, targets, positions, source_columns, target_columns)
    return blocks.meet(sources, targets, radius, blocks.listed(schema), schema, inclusive, keep_self, source_columns, target_columns)


def neighbour_counts(sources: DataFrame, targets: DataFrame, radius: float, inclusive: bool = False, keep_self: bool = False) -> DataFrame:
    """``point_id`` and number ``n`` of targets within the radius, for sources that have any."""
    parts = blocks.meet(sources, targets, radius, blocks.counted, blocks.COUNTED, inclusive, keep_self, tiles=True, once=True)
    return parts.groupBy("point_id").agg(F.sum("n").alias("n"))


def neighbour_summary(sources: DataFrame, targets: DataFrame, radius: float, inclusive: bool = False, keep_self: bool = False) -> DataFrame:
    """As :func:`neighbour_counts`, with the least squared distance ``d2``: a join by radius without its pairs."""
    parts = blocks.meet(sources, targets, radius, blocks.summed, blocks.SUMMED, inclusive, keep_self, tiles=True)
    return parts.groupBy("point_id").agg(F.sum("n").alias("n"), F.min("d2").alias("d2"))


def first_radius(targets: DataFrame, k: int, found: tuple[Vec, Vec] | None = None) -> float:
    """Radius that holds about ``k`` targets if they fill evenly those cells of a coarse grid that have any.

    Flat targets count as a plane or a line; so few that ``k`` needs all of them give their diagonal.
    """
    found = found or bounds(targets)
    if found is None:
        return 1.0
    sides = [b - a for a, b in zip(*found, strict=True)]
    wide = [(a, low, side) for a, low, side in zip(AXES, found[0], sides, strict=True) if side > 1e-9 * max(sides)]
    cells = [F.least(F.floor((F.col(a) - F.lit(float(low))) / F.lit(side / 32)), F.lit(31)) for a, low, side in wide] or [F.lit(0)]
    seen = targets.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*cells)).alias("c")).first()
    if seen["n"] <= k + 1 or not wide:
        return math.dist(*found) * 1.001 or 1.0
    filled = math.prod(side for *_, side in wide) * min(max(seen["c"], 1) / 32 ** len(wide), 1.0)
    return max((8 * k * filled / (seen["n"] * 4.0)) ** (1 / len(wide)), 1e-6 * max(sides))


def knn_join(sources: DataFrame, targets: DataFrame, k: int, radius: float | None = None, source_columns: tuple[str, ...] = (), target_columns: tuple[str, ...] = (), beyond: float | None = None) -> DataFrame:
    """The ``k`` nearest targets of each source (fewer if there are fewer): ``rank`` from 1, ties by key.

    With ``beyond``, only targets farther than that count (a dead zone around
    the source).  Rounds go on while they serve half of the sources left; those
    that have no targets near get theirs by :mod:`pointloom.operators.far`.
    """
    schema = _pair_schema(sources, targets, False, source_columns, target_columns)
    sources, targets = blocks.sound(sources), blocks.sound(targets)
    a, b = bounds(sources), bounds(targets)
    if a is None or b is None:
        return blocks.meet(sources, targets, 1.0, blocks.nearest(k, schema), schema, False, False, source_columns, target_columns).withColumn("rank", F.lit(1))
    r = radius or max(first_radius(targets, k, b), beyond or 0.0)
    whole = math.dist([min(p, q) for p, q in zip(a[0], b[0], strict=True)], [max(p, q) for p, q in zip(a[1], b[1], strict=True)]) * (1 + 1e-9) + 1e-9
    order = Window.partitionBy("s_point_id").orderBy("d2", "t_point_id")
    done: list[DataFrame] = []
    # beyond the targets' bounds grown by the radius, a search within it finds nothing
    grown = [(c, low - r * (1 + 1e-6), high + r * (1 + 1e-6)) for c, low, high in zip(AXES, *b, strict=True)]
    inside = reduce(and_, (F.col(c).between(F.lit(float(low)), F.lit(float(high))) for c, low, high in grown))
    seen = sources.agg(F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("i")).first()
    left, rest = sources, seen["n"]
    near = sources.where(inside) if seen["i"] < rest else sources
    # with less than half inside, the first round would be the last one
    while 2 * seen["i"] >= rest:
        parts = blocks.meet(near if not done else left, targets, r, blocks.nearest(k, schema), schema, False, False, source_columns, target_columns, beyond, bool(done))
        # blocks give k rows of a source each; only the k least of these count
        best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if r > whole:
            done.append(best)
            rest = 0
            break
        best = cut(best)
        # the k-th lies within the radius, so nothing nearer was missed
        full = best.where(F.col("rank") == k).select(F.col("s_point_id").alias("point_id"))
        done.append(best.join(full.withColumnRenamed("point_id", "s_point_id"), "s_point_id", "left_semi").select(*best.columns) if k > 1 else best)
        left, before = cut(left.join(full, "point_id", "left_anti").select(*sources.columns)), rest
        rest = left.count()
        # a round that found less than half shows that targets are far
        if not rest or 2 * rest > before:
            break
        r *= 2
    if rest:
        found, parted = far.nearest(left, targets, rest, k, schema, source_columns, target_columns, beyond)
        done.append(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) if parted else found)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def local_density(points: DataFrame, radius: float | None = None, k: int | None = None) -> DataFrame:
    """Add ``density``: neighbours within ``radius`` over its volume, or ``k`` over the sphere of the k-th."""
    if radius is not None:
        counts = neighbour_counts(points, points, radius).withColumnRenamed("n", "_n")
        volume = 4 / 3 * math.pi * radius**3
        return points.join(counts, "point_id", "left").withColumn("density", F.coalesce("_n", F.lit(0)) / F.lit(volume)).drop("_n")
    far = knn_join(points, points, k).groupBy(F.col("s_point_id").alias("point_id")).agg(F.max("d2").alias("_d2"), F.count("*").alias("_n"))
    ball = F.lit(4 / 3 * math.pi) * F.col("_d2") * F.sqrt("_d2")
    return points.join(far, "point_id", "left").withColumn("density", F.col("_n") / F.expr("nullif(_d2, 0)") * F.col("_d2") / ball).drop("_d2", "_n")


def density_filter(points: DataFrame, cutoff: float, keep_upper: bool = True, radius: float | None = None, k: int | None = None) -> DataFrame:
    """Points above the cutoff, or at most at it."""
    out = local_density(points, radius, k)
    return out.where(F.col("density") > cutoff if keep_upper else F.col("density") <= cutoff)


def subtract(points: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """Points without any other point within the tolerance."""
    return points.join(neighbour_counts(points, others, tolerance, True, True).select("point_id"), "point_id", "left_anti")


def intersect(points: DataFrame, others: DataFrame, tolerance: float, replace_value: bool = False) -> DataFrame:
    """Points with another within the tolerance; with its value if asked for (the nearest, ties by key)."""
    if not replace_value:
        return points.join(neighbour_counts(points, others, tolerance, True, True).select("point_id"), "point_id", "left_semi")
    schema = _pair_schema(points, others, False, (), ("value",))
    best = blocks.meet(points, others, tolerance, blocks.nearest(1, schema), schema, True, True, (), ("value",))
    best = best.groupBy(F.col("s_point_id").alias("point_id")).agg(F.min(F.struct("d2", "t_point_id", "t_value")).alias("_b"))
    return points.join(best, "point_id").withColumn("value", F.col("_b.t_value")).drop("_b")


def union(points: DataFrame, others: DataFrame, tolerance: float) -> DataFrame:
    """Points, and the others that no point lies within the tolerance of."""
    return points.unionByName(subtract(others, points, tolerance).select(*points.columns))


def local_concentration(pairs: DataFrame, sources: DataFrame, numerator: Column, denominator: Column) -> DataFrame:
    """Add ``concentration``: percent of numerator among numerator and denominator targets; -1 without any.

    ``pairs`` come from a radius or nearest-neighbour join of the sources with
    the targets' columns (prefix ``t_``) that the two conditions need.
    """
    n = F.sum(F.when(numerator, 1).otherwise(0))
    d = F.sum(F.when(denominator, 1).otherwise(0))
    counts = pairs.groupBy(F.col("s_point_id").alias("point_id")).agg(n.alias("_n"), d.alias("_d"))
    total = F.col("_n") + F.col("_d")
    value = F.coalesce(F.when(total > 0, F.col("_n") * 100.0 / total), F.lit(-1.0))
    return sources.join(counts, "point_id", "left").withColumn("concentration", value).drop("_n", "_d")


def radius_concentration(points: DataFrame, targets: DataFrame, radius: float, numerator: Column, denominator: Column) -> DataFrame:
    """:func:`local_concentration` of the targets within the radius, by counts; the conditions are on the targets' columns."""
    out = points
    for name, chosen in (("_n", numerator), ("_d", denominator)):
        out = out.join(neighbour_counts(points, targets.where(chosen), radius).withColumnRenamed("n", name), "point_id", "left")
    n, d = (F.coalesce(F.col(c), F.lit(0)) for c in ("_n", "_d"))
    return out.withColumn("concentration", F.coalesce(F.when(n + d > 0, n * 100.0 / (n + d)), F.lit(-1.0))).drop("_n", "_d")


def radial_distribution(sources: DataFrame, targets: DataFrame, radius: float, n: int) -> DataFrame:
    """Histogram of pair distances below ``radius``."""
    from pointloom.operators.bins import densify

    counts = blocks.meet(sources, targets, radius, blocks.distances(n), blocks.BINNED, tiles=True, once=True)
    counts = counts.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    return densify(counts, n).withColumn("x", F.col("bin") / F.lit(float(n)) * F.lit(float(radius)))


def neighbour_histograms(points: DataFrame, k: int, n: int) -> DataFrame:
    """For each rank up to ``k`` a histogram of distances on its own scale, the largest distance of the rank."""
    found = cut(knn_join(points, points, k).select("rank", F.sqrt("d2").alias("d")))
    scale = found.groupBy("rank").agg(F.max("d").alias("most"))
    b = F.least(F.floor(F.col("d") / F.col("most") * n), F.lit(n - 1)).cast("int")
    return found.join(F.broadcast(scale), "rank").select("rank", "most", b.alias("bin")).groupBy("rank", "bin").agg(F.count("*").alias("n"), F.first("most").alias("most"))


def random_neighbour_density(density: float, radius: float, k: int) -> float:
    """Probability density of the distance to the ``k``-th neighbour among random points."""
    lam = 4 / 3 * math.pi * density
    return 3 * lam**k * radius ** (3 * k - 1) * math.exp(-lam * radius**3) / math.gamma(k)


def axial_distribution(sources: DataFrame, targets: DataFrame, origin: Vec, axis: Vec, cylinder: float, radius: float, n: int) -> DataFrame:
    """Histogram of pair displacements along an axis, sources in a cylinder, targets in it grown by the radius."""
    from pointloom.operators.bins import densify
    from pointloom.operators.rowops import in_cylinder

    u, scale, grown = axis.unit(), 2 * float(radius), axis.length() + 2 * radius
    wide = Vec(u.x * grown, u.y * grown, u.z * grown)

    def bin_of(near: blocks.Near, s: np.ndarray, t: np.ndarray, _: np.ndarray) -> np.ndarray:
        x, y, z = (a[t] - a[s] for a in near.at)
        return np.floor(((x * u.x + y * u.y + z * u.z) / scale + 0.5) * n)

    own, others = sources.where(in_cylinder(origin, axis, cylinder)), targets.where(in_cylinder(origin, wide, cylinder + radius))
    counts = blocks.meet(own, others, radius, blocks.binned(n, bin_of), blocks.BINNED)
    return densify(counts.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n")), n)


def axial_neighbours(sources: DataFrame, targets: DataFrame, axis: Vec, k: int, n: int, beyond: float | None = None) -> DataFrame:
    """For each rank up to ``k`` a histogram of distances along an axis: ``rank, bin, n`` and the scale ``most``.

    The ``n`` bins of all ranks reach from 0 to the largest distance along the
    axis, which falls into the last bin; ``beyond`` is a dead zone.
    """
    u = axis.unit()
    found = knn_join(sources, targets, k, source_columns=AXES, target_columns=AXES, beyond=beyond)
    shift = (F.col("t_x") - F.col("s_x")) * F.lit(u.x) + (F.col("t_y") - F.col("s_y")) * F.lit(u.y) + (F.col("t_z") - F.col("s_z")) * F.lit(u.z)
    found = cut(found.select("rank", F.abs(shift).alias("d")))
    most = found.agg(F.max("d").alias("m")).first()["m"] or 0.0
    b = F.least(F.floor(F.col("d") / F.lit(most or 1.0) * n), F.lit(n - 1)).cast("int")
    return found.select("rank", b.alias("bin")).groupBy("rank", "bin").agg(F.count("*").alias("n")).withColumn("most", F.lit(float(most)))
