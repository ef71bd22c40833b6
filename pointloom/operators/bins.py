"""Histograms, profiles and voxel counts: group by a bin expression, then fill the gaps.

Every histogram emits all its bins, zero counts too.  Bins are a ``range`` of at
most ``MOST_BINS`` rows, joined by broadcast to the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.rowops import along
from pointloom.points import AXES, Vec, bounds, less, position, square

MOST_BINS = 2_000_000


def densify(counts: DataFrame, n: int, key: str = "bin", value: str = "n") -> DataFrame:
    """All bins from 0 to ``n - 1``; missing counts are 0."""
    if n > MOST_BINS:
        raise ValueError(f"{n} bins; at most {MOST_BINS}")
    every = counts.sparkSession.range(n).select(F.col("id").cast("int").alias(key))
    return every.join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def spectrum(points: DataFrame, low: float, high: float, width: float, value: Column | None = None) -> DataFrame:
    """``bin``, left edge ``x`` and count ``n`` of ``floor((high - low) / width)`` bins (10 if that is 0)."""
    value = F.col("value") if value is None else value
    n = math.floor((high - low) / width) or 10
    b = F.floor((value - F.lit(float(low))) / F.lit(float(width))).cast("int")
    counts = points.select(b.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy("bin").agg(F.count("*").alias("n"))
    return densify(counts, n).withColumn("x", F.lit(float(low)) + F.col("bin") * F.lit(float(width)))


def auto_spectrum(points: DataFrame, width: float, pad: float = 1.0) -> DataFrame:
    """Spectrum between the extreme values, padded."""
    row = points.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    low, high = (0.0, width) if row["lo"] is None else (row["lo"] - pad, row["hi"] + pad)
    return spectrum(points, low, high, width)


def normalise(hist: DataFrame, mode: str = "max", low: float | None = None, high: float | None = None, width: float | None = None) -> DataFrame:
    """Add ``y``: counts over the maximum (``max``; within ``[low, high)``: ``max_in``) or over the integral (``area``)."""
    if mode == "max":
        total = F.max("n")
    elif mode == "max_in":
        total = F.max(F.when((F.col("x") >= low) & (F.col("x") < high), F.col("n")))
    elif mode == "area":
        total = F.sum("n") * F.lit(float(width))
    else:
        raise ValueError(mode)
    one = hist.agg(total.alias("_t"))  # one row
    return hist.join(F.broadcast(one)).withColumn("y", F.coalesce(F.col("n") / F.expr("nullif(_t, 0)"), F.lit(0.0))).drop("_t")


def moving_deviation(plot: DataFrame, n: int = 4, order: str = "bin", y: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``mean`` and ``err``: over a window of ``n`` from half of it back, edge rows repeated.

    The rows repeated past an edge are counted with weights, so one window frame
    does.  Series are told apart by the columns ``by``; one is small (its bins are bounded).
    """
    w = Window.partitionBy(*by).orderBy(order)
    last = F.count("*").over(Window.partitionBy(*by)) - 1
    out = plot.withColumn("_i", F.row_number().over(w) - 1).withColumn("_last", last)
    terms = []
    for k in range(n):
        at = F.col("_i") - n // 2 + k
        shift = k - n // 2
        near = (F.lag(y, -shift) if shift <= 0 else F.lead(y, shift)).over(w)
        first = F.first(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        final = F.last(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        terms.append(F.when(at < 0, first).when(at > F.col("_last"), final).otherwise(near).cast("double"))
    mean = sum(terms[1:], terms[0]) / n
    out = out.withColumn("mean", mean)
    spread = [(t - F.col("mean")) * (t - F.col("mean")) for t in terms]
    return out.withColumn("err", F.sqrt(sum(spread[1:], spread[0]) / n)).drop("_i", "_last")


def axial_bin(origin: Vec, axis: Vec, radius: float, n: int) -> Column:
    """Bin along a cylinder centred on ``origin``; null outside."""
    h = axis.length() / 2
    t, off = along(origin, axis)
    inside = (F.abs(t) < h) & (off < F.lit(float(radius) ** 2))
    return F.when(inside, F.floor((t + h) / (2 * h) * n)).cast("int")


def radial_bin(origin: Vec, axis: Vec, radius: float, n: int) -> Column:
    """Bin of equal area from the axis of a cylinder; null outside."""
    h = axis.length() / 2
    t, off = along(origin, axis)
    inside = (F.abs(t) < h) & (off < F.lit(float(radius) ** 2))
    return F.when(inside, F.floor(F.greatest(off, F.lit(0.0)) / F.lit(float(radius) ** 2) * n)).cast("int")


def sphere_bin(centre: Vec, radius: float, n: int) -> Column:
    """Shell of equal thickness; null outside and on the surface."""
    r = F.sqrt(square(less(position(), centre)))
    return F.when(r < F.lit(float(radius)), F.floor(r / F.lit(float(radius)) * n)).cast("int")


def profile(points: DataFrame, where: Column, n: int, by: str | None = None, min_events: int = 0) -> DataFrame:
    """Counts by bin and by ``by`` with ``fraction`` of the bin; bins of fewer events are left out."""
    keys = ["bin", *([by] if by else [])]
    counts = points.withColumn("bin", where).where("bin is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.groupBy("bin").agg(F.sum("n").alias("total")).where(F.col("total") >= min_events)
    return counts.join(total, "bin").withColumn("fraction", F.col("n") / F.col("total"))


def profile_position(n: int, length: float, equal_area: bool = False) -> Column:
    """Middle of a bin: along a length, or of equal-area shells up to a radius."""
    middle = (F.col("bin") + 0.5) / F.lit(float(n))
    return F.sqrt(middle) * F.lit(float(length)) if equal_area else middle * F.lit(float(length))


def bin_volume(kind: str, n: int, radius: float, length: float = 0.0) -> Column:
    """Volume of a bin: ``axial`` and ``radial`` in a cylinder, ``sphere`` shells."""
    i = F.col("bin").cast("double")
    if kind in ("axial", "radial"):
        return F.lit(math.pi * radius**2 * length / n)
    return (i * i * 3 + i * 3 + 1) * F.lit(4 / 3 * math.pi * (radius / n) ** 3)


def voxels(points: DataFrame, shape: tuple[int, int, int], corners: tuple[Vec, Vec] | None = None, weight: Column | None = None) -> DataFrame:
    """Sparse counts ``ix, iy, iz, v`` on a grid over the bounds; the upper edge belongs to the last cell."""
    low, high = corners or bounds(points) or (Vec(0, 0, 0), Vec(1, 1, 1))
    cells = []
    for name, axis, n, a, b in zip(("ix", "iy", "iz"), AXES, shape, low, high, strict=True):
        size = (b - a) or 1.0
        cells.append(F.least(F.floor((F.col(axis) - F.lit(float(a))) / F.lit(float(size)) * n), F.lit(n - 1)).cast("int").alias(name))
    value = F.count("*").cast("double") if weight is None else F.sum(weight)
    out = points.select(*cells, *([weight.alias("_w")] if weight is not None else []))
    value = F.count("*").cast("double") if weight is None else F.sum("_w")
    inside = (F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("iz") >= 0)
    return out.where(inside).groupBy("ix", "iy", "iz").agg(value.alias("v"))


def voxel_ratio(points: DataFrame, shape, corners, numerator: Column, denominator: Column | None = None) -> DataFrame:
    """Numerator over denominator points (default: all) of each cell; the numerator itself where that is 0."""
    low, high = corners
    cells = {}
    for name, axis, n, a, b in zip(("ix", "iy", "iz"), AXES, shape, low, high, strict=True):
        cells[name] = F.least(F.floor((F.col(axis) - F.lit(float(a))) / F.lit(float(b - a)) * n), F.lit(n - 1)).cast("int")
    num = F.sum(F.when(numerator, 1.0).otherwise(0.0))
    den = F.count("*").cast("double") if denominator is None else F.sum(F.when(denominator, 1.0).otherwise(0.0))
    out = points.withColumns(cells).groupBy("ix", "iy", "iz").agg(num.alias("_n"), den.alias("_d"))
    return out.select("ix", "iy", "iz", F.when(F.col("_d") == 0, F.col("_n")).otherwise(F.col("_n") / F.col("_d")).alias("v"))


def voxel_summary(grid: DataFrame, threshold: float, cells: int) -> DataFrame:
    """Least, greatest and total value and the cells at or above a threshold, absent cells being 0."""
    full = F.count("*") == cells
    low, high = F.min("v"), F.max("v")
    return grid.agg(F.when(full, low).otherwise(F.least(low, F.lit(0.0))).alias("low"), high.alias("high"), F.sum("v").alias("total"), F.sum(F.when(F.col("v") >= threshold, 1).otherwise(0)).alias("n_over"))


def soft_voxels(points: DataFrame, low: Vec, edge: float, weight: Column | None = None) -> DataFrame:
    """Each point shared among the eight nearest cell centres (cloud in cell); weights of a point sum to 1."""
    base, parts = {}, []
    for name, axis, a in zip(("ix", "iy", "iz"), AXES, low, strict=True):
        u = (F.col(axis) - F.lit(float(a))) / F.lit(float(edge)) - 0.5
        base[f"_{name}"] = F.floor(u).cast("int")
        base[f"_f{name}"] = u - F.floor(u)
    points = points.withColumn("_w", F.lit(1.0) if weight is None else weight).select("_w", *(c.alias(k) for k, c in base.items()))
    for k in range(8):
        bits = [k >> 2 & 1, k >> 1 & 1, k & 1]
        share = F.col("_w")
        for bit, name in zip(bits, ("ix", "iy", "iz"), strict=True):
            share = share * (F.col(f"_f{name}") if bit else 1 - F.col(f"_f{name}"))
        parts.append(F.struct(*((F.col(f"_{n}") + bit).alias(n) for bit, n in zip(bits, ("ix", "iy", "iz"), strict=True)), share.alias("v")))
    spread = points.select(F.explode(F.array(*parts)).alias("c")).select("c.*")
    return spread.groupBy("ix", "iy", "iz").agg(F.sum("v").alias("v"))


def smooth(grid: DataFrame, shape: tuple[int, int, int], deviation: float, reach: int, laplace: bool = False) -> DataFrame:
    """Separable Gaussian (or Laplacian of Gaussian) on a sparse grid; nothing comes from beyond the edges."""
    kernel = [math.exp(-(k * k) / (2 * deviation**2)) for k in range(-reach, reach + 1)]
    kernel = [k / sum(kernel) for k in kernel]
    second = [g * ((k * k) / deviation**4 - 1 / deviation**2) for k, g in zip(range(-reach, reach + 1), kernel, strict=True)]

    def pass_over(df: DataFrame, axis: str, n: int, weights: list[float]) -> DataFrame:
        steps = F.array(*(F.struct((F.col(axis) + k - reach).alias("at"), (F.col("v") * F.lit(w)).alias("p")) for k, w in enumerate(weights)))
        spread = df.select(*(c for c in ("ix", "iy", "iz") if c != axis), F.explode(steps).alias("s"))
        moved = spread.withColumn(axis, F.col("s.at")).withColumn("p", F.col("s.p")).where((F.col(axis) >= 0) & (F.col(axis) < n))
        return moved.groupBy("ix", "iy", "iz").agg(F.sum("p").alias("v"))

    def chain(chosen: int | None) -> DataFrame:
        out = grid
        for k, (axis, n) in enumerate(zip(("ix", "iy", "iz"), shape, strict=True)):
            out = pass_over(out, axis, n, second if k == chosen else kernel)
        return out

    if not laplace:
        return chain(None)
    parts = chain(0).unionByName(chain(1)).unionByName(chain(2))
    return parts.groupBy("ix", "iy", "iz").agg(F.sum("v").alias("v"))


def grid_slice(grid: DataFrame, axis: str, at: float, interpolate: bool = False) -> DataFrame:
    """Cells of one layer, or linear between the two layers around ``at`` (in cells)."""
    if not interpolate:
        return grid.where(F.col(axis) == round(at)).drop(axis)
    low, t = math.floor(at), at - math.floor(at)
    rest = [c for c in ("ix", "iy", "iz") if c != axis]
    weight = F.when(F.col(axis) == low, 1 - t).when(F.col(axis) == low + 1, t)
    return grid.where(F.col(axis).isin(low, low + 1)).groupBy(*rest).agg(F.sum(F.col("v") * weight).alias("v"))


def voxel_threshold(grid: DataFrame, threshold: float, below: bool = False) -> DataFrame:
    return grid.where(F.col("v") < threshold if below else F.col("v") > threshold)


def binarise(grid: DataFrame, threshold: float, on: float = 1.0, off: float = 0.0) -> DataFrame:
    return grid.withColumn("v", F.when(F.col("v") < threshold, F.lit(float(off))).otherwise(F.lit(float(on))))


def rebin(grid: DataFrame, factor: int) -> DataFrame:
    """Sums over blocks of ``factor`` cells along each axis."""
    return grid.groupBy(*(F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("ix", "iy", "iz"))).agg(F.sum("v").alias("v"))


def resize(grid: DataFrame, shape: tuple[int, int, int], offset: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """The grid in other bounds: cells move by ``offset``, those outside go, new ones are absent (0)."""
    axes = ("ix", "iy", "iz")
    out = grid.withColumns({c: (F.col(c) + o).cast("int") for c, o in zip(axes, offset, strict=True)})
    inside = None
    for c, n in zip(axes, shape, strict=True):
        cond = (F.col(c) >= 0) & (F.col(c) < n)
        inside = cond if inside is None else inside & cond
    return out.where(inside)


def soft_ratio(points: DataFrame, low: Vec, edge: float, numerator: Column, denominator: Column | None = None) -> DataFrame:
    """Shared weights of numerator points over those of denominator points (default: all); 0 where that is not finite."""
    weights = points.withColumn("_a", F.when(numerator, 1.0).otherwise(0.0)).withColumn("_b", F.lit(1.0) if denominator is None else F.when(denominator, 1.0).otherwise(0.0))
    a = soft_voxels(weights, low, edge, F.col("_a")).withColumnRenamed("v", "_a")
    b = soft_voxels(weights, low, edge, F.col("_b")).withColumnRenamed("v", "_b")
    value = F.coalesce(F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0)), F.lit(0.0))
    return a.join(b, ["ix", "iy", "iz"]).select("ix", "iy", "iz", value.alias("v"))


def soft_density(points: DataFrame, low: Vec, edge: float, cells: int | None = None) -> DataFrame:
    """Shared counts over a cell's volume; with ``cells``, their number in the grid, rescaled to 0..1.

    Cells without points count as 0 for the least value.
    """
    out = soft_voxels(points, low, edge).withColumn("v", F.col("v") / F.lit(float(edge) ** 3))
    if cells is None:
        return out
    range_of = voxel_summary(out, 0.0, cells).select(F.col("low").alias("_l"), F.col("high").alias("_h"))  # one row
    value = F.coalesce((F.col("v") - F.col("_l")) / F.nullif(F.col("_h") - F.col("_l"), F.lit(0.0)), F.lit(0.0))
    return out.join(F.broadcast(range_of)).select("ix", "iy", "iz", value.alias("v"))
