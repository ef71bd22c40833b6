"""Chemistry names and isotope patterns."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def decompose(name: str) -> list[tuple[str, int]]:
    """``Al2O3`` to [(Al, 2), (O, 3)]; repeated elements are added up; empty if it is no formula."""
    if not re.fullmatch(r"([A-Z][a-z]*\d*)+", name):
        return []
    out: dict[str, int] = {}
    for symbol, n in re.findall(r"([A-Z][a-z]*)(\d*)", name):
        out[symbol] = out.get(symbol, 0) + int(n or 1)
    return list(out.items())


def compose(parts: list[tuple[str, int]]) -> str:
    return "".join(f"{symbol}{n if n > 1 else ''}" for symbol, n in parts)


def decomposed(name: Column) -> Column:
    """The same for a column: a map from symbol to count."""
    symbols = F.regexp_extract_all(name, F.lit(r"([A-Z][a-z]*)(\d*)"), F.lit(1))
    counts = F.transform(F.regexp_extract_all(name, F.lit(r"([A-Z][a-z]*)(\d*)"), F.lit(2)), lambda n: F.when(n == "", 1).otherwise(n.cast("int")))
    pairs = F.arrays_zip(symbols.alias("s"), counts.alias("n"))
    add = lambda s: F.aggregate(F.filter(pairs, lambda p: p["s"] == s), F.lit(0), lambda a, p: a + p["n"])
    return F.map_from_arrays(F.array_distinct(symbols), F.transform(F.array_distinct(symbols), add))


def isotope_pattern(isotopes: list[tuple[str, float, float]], parts: list[tuple[str, int]], charge: int = 1, merge: float = 1e-4) -> list[tuple[float, float]]:
    """(mass over charge, share) of all isotope combinations of a formula; near masses are merged."""
    peaks = [(0.0, 1.0)]
    for symbol, n in parts:
        own = [(m, a) for s, m, a in isotopes if s == symbol]
        if not own:
            raise KeyError(symbol)
        for _ in range(n):
            mixed = sorted((m + k, a * b) for m, a in peaks for k, b in own)
            peaks = [(sum(m * a for m, a in g) / sum(a for _, a in g), sum(a for _, a in g)) for g in _near(mixed, merge)]
    return [(m / charge, a) for m, a in peaks]


def _near(sorted_peaks: list[tuple[float, float]], merge: float) -> list[list[tuple[float, float]]]:
    start = [None]

    def label(p: tuple[float, float]) -> float:
        if start[0] is None or p[0] - start[0] > merge:
            start[0] = p[0]
        return start[0]

    return [list(g) for _, g in groupby(sorted_peaks, label)]
