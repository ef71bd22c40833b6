"""Statistics over points and small result tables.

Aggregation is Spark's; closed forms on a bounded number of results (bins,
ranks, species) run on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.bins import spectrum


def mean_deviation(df: DataFrame, column: str, corrected: bool = True) -> DataFrame:
    """``mean`` and unbiased ``sd``, with the small-sample factor if asked for."""
    n = F.count(column)
    sd = F.stddev_samp(column)
    return df.agg(F.avg(column).alias("mean"), (sd * (1 + 1 / (4 * F.expr("nullif(%s, 0)" % f"count({column})"))) if corrected else sd).alias("sd"), n.alias("n"))


def weighted_mean(df: DataFrame, x: str, weight: str, least: float = 1e-12) -> DataFrame:
    """Sum of products over the sum of weights; 0 where the weights vanish."""
    w = F.sum(weight)
    return df.agg(F.when(F.abs(w) < least, 0.0).otherwise(F.sum(F.col(x) * F.col(weight)) / w).alias("mean"))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def anderson_darling(values: list[float]) -> tuple[float, float, float, int]:
    """(mean, deviation, corrected A squared, undefined terms) of a small sample."""
    n = len(values)
    if n < 2:
        raise ValueError("at least two values")
    mean = sum(values) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    if not sd:
        return mean, 0.0, math.inf, n
    ps = [normal_cdf((v - mean) / sd) for v in sorted(values)]
    total, undefined = 0.0, 0
    for i, (p, q) in enumerate(zip(ps, reversed(ps), strict=True)):
        if p <= 0 or q >= 1:
            undefined += 1
            continue
        total += (2 * i + 1) * (math.log(p) + math.log1p(-q))
    a2 = -n - total / n
    return mean, sd, a2 * (1 + 4 / n - 25 / n**2), undefined


class FitError(ValueError):
    pass


def background_fit(points: DataFrame, low: float, high: float, width: float, most: float = 3.0) -> float:
    """Mean count of a bin of the root of the value, where counts look like noise of a flat level.

    Needs ten bins with ten counts on average, and counts that pass a normality test.
    """
    a, b = math.sqrt(low), math.sqrt(high)
    n = int((b - a) / width)
    if n < 10:
        raise FitError(f"{n} bins; at least 10")
    if n > 100_000:
        raise FitError(f"{n} bins; at most 100000")
    hist = spectrum(points.where((F.col("value") >= low) & (F.col("value") < high)), a, b, width, F.sqrt("value"))
    counts = [float(r["n"]) for r in hist.collect()]
    mean = sum(counts) / len(counts)
    if mean < 10:
        raise FitError("too few counts")
    if anderson_darling(counts)[2] > most:
        raise FitError("the counts are not like noise")
    return mean


def background_curve(intensity: float, width: float, x: Column | None = None) -> Column:
    """Expected background count of a bin of ``width`` at ``x``, flat in the root of x."""
    x = F.col("x") if x is None else x
    return F.when(x > 0, F.lit(float(intensity * width)) / (2 * F.sqrt(x))).otherwise(0.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi_square_p(statistic: float, freedom: int) -> float:
    """Probability of a larger statistic."""
    return 1 - gamma_p(freedom / 2, statistic / 2) if freedom > 0 else 1.0


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p in (0, 1):
        return float(k == n * p)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_blocks(points: DataFrame, per_block: int, edge: float, aspect: float = 2.0, axis: str = "z", key: str = "point_id") -> DataFrame:
    """Add ``block``: runs of ``per_block`` points along the axis in square columns of ``edge``.

    Unfilled blocks and those longer than ``aspect`` times the edge are left out.
    """
    across = [a for a in "xyz" if a != axis]
    columns = [F.floor(F.col(a) / F.lit(float(edge))).alias(f"_{a}") for a in across]
    w = Window.partitionBy(*(f"_{a}" for a in across)).orderBy(axis, key)
    out = points.select("*", *columns).withColumn("_k", F.floor((F.row_number().over(w) - 1) / per_block))
    group = Window.partitionBy(*(f"_{a}" for a in across), "_k")
    out = out.withColumn("_n", F.count("*").over(group)).withColumn("_span", F.max(axis).over(group) - F.min(axis).over(group))
    out = out.where((F.col("_n") == per_block) & (F.col("_span") <= F.lit(float(aspect * edge))))
    name = F.concat_ws(":", *(F.col(f"_{a}").cast("string") for a in across), F.col("_k").cast("string"))
    return out.withColumn("block", name).drop("_k", "_n", "_span", *(f"_{a}" for a in across))


def binomial_histogram(blocks: DataFrame, ion: str = "ion") -> DataFrame:
    """(ion, count in a block, blocks); blocks without the ion count as 0."""
    every = blocks.select("block").distinct()
    per = blocks.groupBy("block", ion).agg(F.count("*").alias("k"))
    total = every.agg(F.count("*").alias("_all"))
    seen = per.groupBy(ion, "k").agg(F.count("*").alias("n"))
    absent = seen.groupBy(ion).agg(F.sum("n").alias("_some")).join(F.broadcast(total)).select(ion, F.lit(0).cast("long").alias("k"), (F.col("_all") - F.col("_some")).alias("n")).where("n > 0")
    return seen.unionByName(absent)


def binomial_test(histogram: list[tuple[int, int]], per_block: int, least: int = 5) -> dict[str, float]:
    """Mean count, chi-square against the binomial law, its p-value and the normalised coefficient.

    Only counts seen at least ``least`` times enter.
    """
    blocks = sum(n for _, n in histogram)
    if not blocks:
        return {"mean": 0.0, "chi_square": 0.0, "p": 1.0, "mu": 0.0, "freedom": 0}
    mean = sum(k * n for k, n in histogram) / blocks
    used = [(k, n) for k, n in sorted(histogram) if n >= least]
    chi = 0.0
    for k, n in used:
        expected = blocks * binomial_pmf(k, per_block, mean / per_block)
        chi += (n - expected) ** 2 / expected if expected else 0.0
    freedom = len(used) - 1
    mu = math.sqrt(chi / (mean * blocks + chi)) if mean * blocks + chi else 0.0
    return {"mean": mean, "chi_square": chi, "p": chi_square_p(chi, freedom), "mu": mu, "freedom": freedom}


def binomial_curve(p: float, n: int) -> list[tuple[int, float]]:
    return [(k, binomial_pmf(k, n, p)) for k in range(n + 1)]
