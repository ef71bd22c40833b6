"""Classifying values by closed intervals, and edits of the interval dictionary.

The dictionary is small and validated, so ranging is one CASE expression: no
join, no shuffle, and the scan's filters stay pushed down.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges above this number go through a broadcast table instead of an expression.
CASES = 200


@dataclass(frozen=True)
class Ion:
    short: str
    long: str
    rgb: tuple[float, float, float] = (0.5, 0.5, 0.5)


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    ion: int
    enabled: bool = True


@dataclass(frozen=True)
class RangeTable:
    """Ions and ranges; edits return new tables, and refuse what is inconsistent."""

    ions: tuple[Ion, ...] = ()
    ranges: tuple[Range, ...] = field(default=())

    def problems(self) -> list[str]:
        """What is inconsistent: empty or overlapping ranges, unknown ions, repeated or blank names."""
        out = [f"range {k} is empty" for k, r in enumerate(self.ranges) if not r.low < r.high]
        out += [f"range {k} has no ion" for k, r in enumerate(self.ranges) if not 0 <= r.ion < len(self.ions)]
        ordered = sorted(self.ranges, key=lambda r: (r.low, r.high))
        out += [f"ranges overlap at {b.low}" for a, b in zip(ordered, ordered[1:], strict=False) if b.low < a.high]
        for kind in ("short", "long"):
            names = [getattr(i, kind) for i in self.ions]
            out += [f"{kind} name {n!r} is used twice" for n in sorted({n for n in names if names.count(n) > 1})]
            out += [f"{kind} name {n!r} is blank or has white space" for n in names if not n or n.split() != [n]]
        return out

    def checked(self) -> RangeTable:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    def add_ion(self, short: str, long: str, rgb=(0.5, 0.5, 0.5)) -> RangeTable:
        return replace(self, ions=(*self.ions, Ion(short, long, rgb))).checked()

    def add_range(self, low: float, high: float, ion: int) -> RangeTable:
        return replace(self, ranges=(*self.ranges, Range(low, high, ion))).checked()

    def move_range(self, k: int, low: float | None = None, high: float | None = None) -> RangeTable:
        r = self.ranges[k]
        moved = replace(r, low=r.low if low is None else low, high=r.high if high is None else high)
        return replace(self, ranges=tuple(moved if j == k else old for j, old in enumerate(self.ranges))).checked()

    def erase_range(self, k: int) -> RangeTable:
        return replace(self, ranges=tuple(r for j, r in enumerate(self.ranges) if j != k))

    def erase_ion(self, k: int) -> RangeTable:
        """Without the ion and its ranges; later ions move up."""
        kept = tuple(replace(r, ion=r.ion - (r.ion > k)) for r in self.ranges if r.ion != k)
        return RangeTable(tuple(i for j, i in enumerate(self.ions) if j != k), kept)

    def set_ion(self, k: int, ion: int) -> RangeTable:
        return replace(self, ranges=tuple(replace(r, ion=ion) if j == k else r for j, r in enumerate(self.ranges))).checked()

    def rename(self, k: int, short: str | None = None, long: str | None = None) -> RangeTable:
        ion = replace(self.ions[k], short=short or self.ions[k].short, long=long or self.ions[k].long)
        return replace(self, ions=tuple(ion if j == k else i for j, i in enumerate(self.ions))).checked()

    def recolour(self, k: int, rgb: tuple[float, float, float]) -> RangeTable:
        return replace(self, ions=tuple(replace(i, rgb=rgb) if j == k else i for j, i in enumerate(self.ions)))

    def find_ion(self, name: str, short: bool = True) -> int | None:
        return next((k for k, i in enumerate(self.ions) if (i.short if short else i.long) == name), None)


def overlaps(a: tuple[float, float], b: tuple[float, float]) -> bool:
    """Open intervals have a point in common."""
    return a[0] < b[1] and b[0] < a[1]


def range_column(table: RangeTable, value: Column | None = None) -> Column:
    """Number of the first range that holds the value; null for none."""
    value = F.col("value") if value is None else value
    out = None
    for k, r in enumerate(table.ranges):
        hit = value.between(F.lit(float(r.low)), F.lit(float(r.high)))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(None).cast("int") if out is None else out


def ranged(points: DataFrame, table: RangeTable) -> DataFrame:
    """Add ``range_id`` and ``ion`` (short name); null where no range holds the value."""
    if len(table.ranges) > CASES:
        return _joined(points, table)
    names = F.array(*(F.lit(table.ions[r.ion].short) for r in table.ranges)) if table.ranges else None
    out = points.withColumn("range_id", range_column(table).cast("int"))
    return out.withColumn("ion", F.lit(None).cast("string") if names is None else F.get(names, F.col("range_id")))


def _joined(points: DataFrame, table: RangeTable) -> DataFrame:
    """The same through a broadcast table of cells, for long dictionaries; every row comes out once.

    A cell has the ranges that reach into it, in the order of the table.  Ranges
    may touch: of two that hold the value the first in the table wins.
    """
    spark = points.sparkSession
    rows = [(float(r.low), float(r.high), k, table.ions[r.ion].short) for k, r in enumerate(table.ranges)]
    dims = spark.createDataFrame(rows, "_lo double, _hi double, _range int, _ion string")
    width = max((r.high - r.low for r in table.ranges), default=1.0)
    cell = lambda c: F.floor(c / F.lit(width))
    spread = dims.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    cells = spread.groupBy("_cell").agg(F.array_sort(F.collect_list(F.struct("_range", "_lo", "_hi", "_ion"))).alias("_ranges"))
    hits = points.withColumn("_cell", cell(F.col("value"))).join(F.broadcast(cells), ["_cell"], "left")
    best = F.get(F.filter("_ranges", lambda r: F.col("value").between(r["_lo"], r["_hi"])), F.lit(0))
    found = hits.withColumn("_best", best)
    return found.withColumn("range_id", F.col("_best._range")).withColumn("ion", F.col("_best._ion")).drop("_cell", "_ranges", "_best")


def keep_ranged(points: DataFrame, table: RangeTable, drop_unranged: bool = True) -> DataFrame:
    """Ranged points, without those of disabled ranges; unranged ones stay if asked for."""
    on = [k for k, r in enumerate(table.ranges) if r.enabled]
    out = ranged(points, table)
    kept = F.col("range_id").isin(on) if on else F.lit(False)
    return out.where(kept if drop_unranged else kept | F.col("range_id").isNull())


def keep_ions(points: DataFrame, table: RangeTable, names: list[str]) -> DataFrame:
    return ranged(points, table).where(F.col("ion").isin(names))


def keep_range(points: DataFrame, table: RangeTable, k: int) -> DataFrame:
    r = table.ranges[k]
    return points.where(F.col("value").between(float(r.low), float(r.high)))


def composition(points: DataFrame, table: RangeTable) -> DataFrame:
    """``ion``, ``n`` and its share of all and of ranged points; unranged ones as ``unranged``."""
    counts = ranged(points, table).groupBy(F.coalesce("ion", F.lit("unranged")).alias("ion")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("ion") != "unranged", F.col("n"))).alias("known"))
    joined = counts.join(F.broadcast(totals))  # totals is one row
    return joined.select("ion", "n", (F.col("n") / F.col("all")).alias("fraction"), F.when(F.col("ion") != "unranged", F.col("n") / F.col("known")).alias("ranged_fraction"))


def background_corrected(counts: DataFrame, table: RangeTable, intensity: float) -> DataFrame:
    """Counts by ``range_id`` less the background flat in the root of the value; never below 0."""
    rows = [(k, 2 * intensity * (r.high**0.5 - r.low**0.5)) for k, r in enumerate(table.ranges)]
    dims = counts.sparkSession.createDataFrame(rows, "range_id int, background double")
    return counts.join(F.broadcast(dims), "range_id").withColumn("corrected", F.greatest(F.col("n") - F.col("background"), F.lit(0.0)))
