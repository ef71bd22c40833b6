"""Work on near pairs of points in blocks of cells.

Sources lie in one cell of a few radii's edge, targets go to every cell within
the radius of them (3.4 copies on average, not 27).  The rows of a cell meet in
one place and travel as Arrow batches; there, numpy finds the pairs by columns
of half a radius, many cells at a time, and a reducer decides what leaves: the
pairs, or only counts, bins, the nearest, or links that join components.

A cell of more than ``BLOCK`` sources or targets is dealt to several blocks of
each, and every block of sources meets every block of targets, so no cell
gathers without bound; reducers give parts that add up.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.points import AXES
from pointloom.scratch import cut

#: A cell's edge in radii; where cells are crowded, and work is by tiles.
EDGE, CLOSE = 4, 2
#: Points of one side that meet in one place at most, about; the same by tiles.
BLOCK, WIDE = 8192, 1 << 19
#: Sources of a tile, about; its distances; sub-cells that have a table of their rows.
GROUP, TILE, SEATS = 32, 1 << 17, 1 << 22
#: Share of the squared radius within which single precision does not decide; above twice the bound of its error.
DOUBT = 5e-6
#: Rows worked on together, if they are of several cells; pairs tried at once; points that travel as one row.
ROWS, PAIRS, PACK = 1 << 16, 1 << 21, 1 << 12
#: Cells that are named to the tasks that send points, at most.
NAMED = 1 << 15
#: Relative slack of the search, far above rounding; distances are compared exactly.
SLACK = 1e-6
CELL = ("_cx", "_cy", "_cz")
PLACE = (*CELL, "_i", "_j")

#: (rows of sources, rows of targets, squared distance) of found pairs.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Near:
    """Whole cells, and the pairs within the radius in them."""

    def __init__(self, batch: pa.RecordBatch, radius: float, edge: float, inclusive: bool, keep_self: bool, beyond: float | None):
        self.batch, self.limit, self.inclusive, self.keep_self = batch, radius * radius, inclusive, keep_self
        self.radius, self.beyond = radius, None if beyond is None else beyond * beyond
        #: Of a join of points with themselves that holds pairs with other cells once: targets of these, and row numbers.
        self.halo: np.ndarray | None = None
        self.row: np.ndarray | None = None
        self.id = batch.column("point_id").to_numpy()
        self.at = [batch.column(a).to_numpy() for a in AXES]
        self.target = batch.column("_t").to_numpy(zero_copy_only=False)
        places = [batch.column(c).to_numpy() for c in PLACE]
        fresh = np.zeros(batch.num_rows, bool)
        for p in places:
            fresh[1:] |= p[1:] != p[:-1]
        self.cell, self.reach, self.edge = np.cumsum(fresh), radius * (1 + SLACK), edge
        width = radius / 2 if radius > 0 else edge / 8
        self.steps = 2 if radius > 0 else 0
        side = int(np.ceil(edge / width)) + 12
        self.local = [a - p * edge for a, p in zip(self.at, places[:3], strict=True)]
        # sums of a cell, a column of half a radius, and the height in it
        ix, iy = ((np.floor(v / width) + 6).astype(np.int64) for v in self.local[:2])
        self.side, self.span, self.height = side, 2 * edge + 8 * self.reach, self.local[2]
        self.column = (self.cell * side + ix) * side + iy

    def pairs(self) -> Iterator[Found]:
        """All pairs within the radius, a limited number at a time."""
        targets = np.flatnonzero(self.target)
        key = self.column[targets] * self.span + self.height[targets]
        order = np.argsort(key, kind="stable")
        targets, key = targets[order], key[order]
        sources = np.flatnonzero(~self.target)
        if not len(targets) or not len(sources):
            return
        slack = self.span * (self.column.max() + 2) * 1e-15 + self.reach * SLACK
        for dx in range(-self.steps, self.steps + 1):
            for dy in range(-self.steps, self.steps + 1):
                base = (self.column[sources] + dx * self.side + dy) * self.span + self.height[sources]
                low = np.searchsorted(key, base - self.reach - slack)
                size = np.searchsorted(key, base + self.reach + slack, "right") - low
                some = np.flatnonzero(size)
                first, size, own = low[some], size[some], sources[some]
                ends = np.cumsum(size)
                at = 0
                while at < len(some):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                    s = np.repeat(own[at:to], size[at:to])
                    starts = first[at:to] - (ends[at:to] - size[at:to]) + (ends[at - 1] if at else 0)
                    t = targets[np.arange(len(s)) + np.repeat(starts, size[at:to])]
                    yield self._within(s, t)
                    at = to

    def _within(self, s: np.ndarray, t: np.ndarray) -> Found:
        x, y, z = self.at
        dx, dy, dz = x[s] - x[t], y[s] - y[t], z[s] - z[t]
        d2 = dx * dx + dy * dy + dz * dz
        good = d2 <= self.limit if self.inclusive else d2 < self.limit
        if self.beyond is not None:
            good &= d2 > self.beyond
        if not self.keep_self:
            good &= self.id[s] != self.id[t]
        return s[good], t[good], d2[good]

    def narrowed(self, radius: float) -> Near:
        """The same cells for the tiles of a smaller radius."""
        out = copy.copy(self)
        out.radius, out.limit, out.reach, out.target = radius, radius * radius, radius * (1 + SLACK), self.target.copy()
        # what is farther from a cell is near none of its sources
        for v in self.local:
            out.target &= (v >= -2 * radius) & (v <= self.edge + 2 * radius)
        return out

    def tiles(self, sure: np.ndarray | None = None, sources: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sources, targets, and their squared distances over the squared radius, in single precision.

        All targets within the radius of a source are in its tiles, once, those of its
        own key among them; rows are filled up to whole words with distances above the
        radius.  Given ``sure``, targets of sub-cells that lie within the radius as a
        whole are added to it by number and are in no tile.  Of all sources, or of those
        given; for a radius above zero.  Where pairs with other cells are held once,
        those within a cell come once too, and a point's with itself does not come; then
        ``sure`` gets the sources of such targets as well, when all tiles are done.
        """
        targets, sources = np.flatnonzero(self.target), np.flatnonzero(~self.target) if sources is None else sources
        if not len(targets) or not len(sources):
            return
        radius = self.reach
        # places in the own cell, so that cells far apart have sub-cells as small and as few as one
        at = np.stack(self.local, 1)
        # sub-cells of some dozens of sources, half a radius wide at most and a tenth at least
        own = at[sources]
        room = np.prod(np.maximum(np.ptp(own, axis=0), radius / 10)) * (self.cell[-1] + 1)
        width = float(np.clip((GROUP * room / len(own)) ** (1 / 3), radius / 10, radius / 2))
        steps = int(np.ceil(radius / width * (1 + SLACK))) + 1
        low = at.min(0) - (steps + 1) * width
        seat = np.floor((at - low) / width).astype(np.int64)
        side = seat.max(0) + steps + 2
        place = (((self.cell * side[0] + seat[:, 0]) * side[1]) + seat[:, 1]) * side[2] + seat[:, 2]
        if self.halo is None:
            targets = targets[np.argsort(place[targets], kind="stable")]
        else:  # the cell's own points, then the others
            targets = targets[np.lexsort((place[targets], self.halo[targets]))]
            halves = np.split(targets, [len(targets) - np.count_nonzero(self.halo[targets])])
        there = [np.ascontiguousarray(at[targets, c] / self.radius) for c in range(3)]
        seats = int((self.cell[-1] + 1) * np.prod(side)) + 2

        def finder(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
            table = np.searchsorted(keys, np.arange(seats)) if seats <= SEATS else None
            return (lambda p: table[p]) if table is not None else (lambda p: np.searchsorted(keys, p))

        if self.halo is None:
            first = finder(place[targets])
        else:
            first, other = (finder(place[half]) for half in halves)
        # where targets begin and end to be counted as a whole
        passed = np.zeros(len(targets) + 1, np.int64)
        held = np.empty(TILE + 8 * len(sources), np.float32)
        sources = sources[np.argsort(place[sources], kind="stable")]
        mine = place[sources]
        heads = np.append(np.flatnonzero(np.diff(mine, prepend=-1)), len(mine))
        # columns of sub-cells that a sphere around a sub-cell reaches, and how far along z
        d = np.arange(-steps, steps + 1)
        gap = np.maximum(np.abs(d) - 1, 0) * width
        flat = gap[:, None] ** 2 + gap[None, :] ** 2
        i, j = np.nonzero(flat <= (radius * (1 + SLACK)) ** 2)
        up = np.floor(np.sqrt(np.maximum((radius * (1 + SLACK)) ** 2 - flat[i, j], 0)) / width * (1 + SLACK)).astype(np.int64) + 1
        offset = (d[i] * side[1] + d[j]) * side[2]
        # how far along z sub-cells lie within it as a whole; -1 for none
        full = ((np.abs(d[i]) + 1) ** 2 + (np.abs(d[j]) + 1) ** 2) * width**2
        inner = np.floor(np.sqrt(np.maximum((self.radius * (1 - 2 * SLACK)) ** 2 - full, 0)) / width * (1 - SLACK)).astype(np.int64) - 1
        whole = np.flatnonzero(inner >= 0) if sure is not None else i[:0]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            begin, end = mine[a] + offset - up, mine[a] + offset + up + 1
            s = sources[a:b]
            if len(whole):
                base = mine[a] + offset[whole]
                head, tail = base - inner[whole], base + inner[whole] + 1
                begin, end = np.concatenate((begin, tail)), np.concatenate((end, end[whole]))
                end[whole] = head
            if self.halo is None:
                begin, end = first(begin), first(end)
            else:  # of the cell's own points: those of this sub-cell, and those of later ones
                later = np.flatnonzero(end > mine[a] + 1)
                begin, end = (np.concatenate(([p], first(np.maximum(c[later], mine[a] + 1)), other(c) + len(halves[0]))) for p, c in ((first(mine[a]), begin), (first(mine[a] + 1), end)))
            if len(whole):
                if self.halo is None:
                    head, tail = first(head), first(tail)
                else:
                    head, tail = (np.concatenate((first(np.maximum(c, mine[a] + 1)), other(c) + len(halves[0]))) for c in (head, tail))
                    np.add.at(passed, head, len(s))
                    np.subtract.at(passed, tail, len(s))
                sure[s] += int((tail - head).sum())
            some = np.flatnonzero(end > begin)
            begin, size = begin[some], (end - begin)[some]
            if not len(size):
                continue
            before = np.cumsum(size) - size
            rows = np.arange(int(size.sum())) + np.repeat(begin - before, size)
            centre = low + (seat[s[0]] + 0.5) * width
            p = (at[s] - centre) / self.radius
            left = np.empty((len(s), 5), np.float32)
            left[:, :3], left[:, 3], left[:, 4] = -2 * p, 1, (p * p).sum(1)
            local = np.empty((3, len(rows)), np.float32)
            for c in range(3):
                np.subtract(there[c][rows], centre[c] / self.radius, out=local[c], casting="same_kind")
            x, y, z = local
            d2, wide = x * x + y * y + z * z, float(np.sqrt(left[:, 4].max())) * (1 + SLACK)
            # a target's distance from the centre, more or less by the farthest source's, may decide for all of them
            kept = d2 <= (1 + wide) ** 2 + 4 * DOUBT
            own_rows = int(size[0]) if self.halo is not None else 0
            kept[:own_rows] = True
            if sure is not None and wide < 1:
                within = d2 < (1 - wide) ** 2 - 4 * DOUBT
                within[:own_rows] = False
                sure[s] += np.count_nonzero(within)
                if self.halo is not None:
                    sure[targets[rows[within]]] += len(s)
                kept &= ~within
            kept = np.flatnonzero(kept)
            if not len(kept):
                continue
            right = np.zeros((5, -(-len(kept) // 8) * 8), np.float32)
            for c in range(3):
                np.take(local[c], kept, out=right[c, : len(kept)])
            np.take(d2, kept, out=right[3, : len(kept)])
            right[3, len(kept) :], right[4] = 2, 1
            t = targets[rows[kept]]
            step = max(8, TILE // len(s) // 8 * 8)
            for k in range(0, right.shape[1], step):
                wide = min(step, right.shape[1] - k)
                near = np.matmul(left, right[:, k : k + step], out=held[: len(s) * wide].reshape(len(s), wide))
                if k < own_rows:
                    column = np.arange(k, min(k + wide, own_rows))
                    near[:, : len(column)][column <= np.arange(len(s))[:, None]] = 2
                yield s, t[k : k + step], near
        if sure is not None and self.halo is not None:
            sure[targets] += np.cumsum(passed)[:-1]

    def same(self) -> Found:
        """The pairs within the radius that have one key."""
        sources, targets = np.flatnonzero(~self.target), np.flatnonzero(self.target)
        order = np.argsort(self.id[targets], kind="stable")
        keys = self.id[targets][order]
        begin = np.searchsorted(keys, self.id[sources])
        size = np.searchsorted(keys, self.id[sources], "right") - begin
        s = np.repeat(sources, size)
        t = targets[order[np.arange(len(s)) + np.repeat(begin - (np.cumsum(size) - size), size)]]
        d2, good = self.exact(s, t)
        good &= self.cell[s] == self.cell[t]
        return s[good], t[good], d2[good]

    def exact(self, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, and which are within the radius."""
        x, y, z = self.at
        dx, dy, dz = x[s] - x[t], y[s] - y[t], z[s] - z[t]
        d2 = dx * dx + dy * dy + dz * dz
        return d2, d2 <= self.limit if self.inclusive else d2 < self.limit


Reducer = Callable[[Iterator[Near]], Iterator[pa.RecordBatch]]


def sound(points: DataFrame) -> DataFrame:
    """Points with a key and three numbers for a position; others are near nothing."""
    return points.where(" and ".join(["point_id is not null", *(f"{a} is not null and not isnan({a})" for a in AXES)]))


def _seat(values: Column, edge: float) -> Column:
    return F.floor(values / F.lit(edge))


def meet(sources: DataFrame, targets: DataFrame, radius: float, reduce: Reducer, schema: T.StructType, inclusive: bool = False, keep_self: bool = False, source_columns: tuple[str, ...] = (), target_columns: tuple[str, ...] = (), beyond: float | None = None, few: bool = False, tiles: bool = False, once: bool = False) -> DataFrame:
    """Rows that ``reduce`` makes of the near pairs; see :class:`Near` for the conditions.

    Further columns are there as ``s_`` and ``t_`` and their name.  With ``few``
    sources, targets of cells without any stay where they are.  Reducers that work
    by ``tiles`` get smaller and fuller cells where points are dense; with ``once``, they
    may get the pairs of a join of points with themselves once.
    """
    radius = float(radius)
    edge = EDGE * radius if radius > 0 else 1.0
    if tiles and radius > 0:
        per = sound(sources).groupBy(*(_seat(F.col(a), edge).alias(c) for a, c in zip(AXES, CELL, strict=True))).agg(F.count("*").alias("n"))
        if (per.agg(F.max("n").alias("n")).first()["n"] or 0) > BLOCK:
            return _meet_packed(sources, targets, radius, reduce, schema, inclusive, keep_self, once)
    reach = radius * (1 + SLACK)
    extra = {f"{p}{c}": df.schema[c].dataType for p, df, names in (("s_", sources, source_columns), ("t_", targets, target_columns)) for c in names}

    def side(df: DataFrame, prefix: str, names: tuple[str, ...], spread: float) -> DataFrame:
        own = {f"{prefix}{c}": F.col(c) for c in names}
        out = sound(df).select("point_id", *AXES, F.lit(prefix == "t_").alias("_t"), *(own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in extra.items()))
        for axis, c in zip(AXES, CELL, strict=True):
            v = F.col(axis)
            # a radius is less than an edge, so a point reaches two cells of an axis at most
            low, high = _seat(v - spread, edge), _seat(v + spread, edge)
            out = out.withColumn(c, F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))) if spread else _seat(v, edge))
        return out

    here, there = side(sources, "s_", source_columns, 0.0), side(targets, "t_", target_columns, reach)
    if few:
        there = there.join(cut(here.select(*CELL).distinct()), list(CELL), "left_semi").select(*here.columns)
    rows = here.unionByName(there)
    counts = rows.groupBy(*CELL).agg(F.sum(F.when(F.col("_t"), 0).otherwise(1)).alias("_ns"), F.sum(F.when(F.col("_t"), 1).otherwise(0)).alias("_nt"))
    crowded = cut(counts.where(F.greatest("_ns", "_nt") > BLOCK).select(*CELL, *(F.ceil(F.greatest(n, F.lit(1)) / F.lit(BLOCK)).cast("int").alias(n) for n in ("_ns", "_nt"))))
    if crowded.limit(1).count():
        seat = F.xxhash64("point_id", *AXES)
        ns, nt = F.coalesce("_ns", F.lit(1)), F.coalesce("_nt", F.lit(1))
        i, j = F.pmod(seat, ns).cast("int"), F.pmod(seat, nt).cast("int")
        at = lambda a, b: F.struct(a.cast("int").alias("i"), b.cast("int").alias("j"))
        places = F.when(F.col("_t"), F.transform(F.sequence(F.lit(0), ns - 1), lambda k: at(k, j))).otherwise(F.transform(F.sequence(F.lit(0), nt - 1), lambda k: at(i, k)))
        columns = rows.columns
        rows = rows.join(crowded, list(CELL), "left").select(*columns, F.explode(places).alias("_p")).select(*columns, F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))
    else:
        rows = rows.select("*", F.lit(0).alias("_i"), F.lit(0).alias("_j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduce(Near(b, radius, edge, inclusive, keep_self, beyond) for b in whole(batches))

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, schema)


def _meet_packed(sources: DataFrame, targets: DataFrame, radius: float, reduce: Reducer, schema: T.StructType, inclusive: bool, keep_self: bool, once: bool) -> DataFrame:
    """:func:`meet` by tiles: points travel as arrays, one row for those of a batch that go to one cell."""
    edge, reach = CLOSE * radius, radius * (1 + SLACK)
    half = once and not keep_self and sources.sameSemantics(targets)
    sides = [sound(df).select("point_id", *AXES, F.lit(t).alias("_t")) for df, t in (((sources, False),) if half else ((sources, False), (targets, True)))]
    points = sides[0] if half else sides[0].unionByName(sides[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, ...], list[int]] = {}
        for cells, ids, _, kind in _packs(batches, edge, reach, half):
            n, sums = int(np.count_nonzero(kind)), found.setdefault(cells, [0, 0])
            sums[0] += len(ids) - n
            sums[1] += len(ids) if half else n
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((*k, *v) for k, v in found.items()), strict=True)] or [pa.array([], pa.int64())] * 5, names=[*CELL, "_ns", "_nt"])

    found = points.mapInArrow(count, "_cx long, _cy long, _cz long, _ns long, _nt long").groupBy(*CELL).agg(F.sum("_ns").alias("_ns"), F.sum("_nt").alias("_nt"))
    found = cut(found)
    total = found.agg(F.sum(F.col("_ns") + F.col("_nt")).alias("n")).first()["n"] or 0
    crowded = {tuple(r[c] for c in CELL): (max(1, -(-r["_ns"] // WIDE)), max(1, -(-r["_nt"] // WIDE))) for r in found.where(F.greatest("_ns", "_nt") > WIDE).collect()}
    if crowded and half:  # blocks of a cell meet as sources and targets
        return _meet_packed(sources, targets, radius, reduce, schema, inclusive, keep_self, False)
    # cells of one side only have no pairs; their points stay, unless there are too many cells to name
    served = found.where("_ns > 0 and _nt > 0").select(*CELL).limit(NAMED + 1).collect()
    if not served:
        return points.sparkSession.createDataFrame([], schema)
    named = {tuple(r) for r in served} if len(served) <= NAMED else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, ids, at, kind in _packs(batches, edge, reach, half):
            if named is not None and tuple(cells) not in named:
                continue
            ns, nt = crowded.get(tuple(cells), (1, 1))
            seat = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            places, blobs = [], []
            for i in range(ns):
                for j in range(nt):
                    own = np.flatnonzero(np.where(kind, seat % np.uint64(nt) == j, seat % np.uint64(ns) == i)) if (ns, nt) != (1, 1) else slice(None)
                    for k in range(0, len(ids[own]), PACK):
                        part = slice(k, k + PACK)
                        blobs.append(b"".join(np.ascontiguousarray(c[own][part]).tobytes() for c in (ids, *at, kind)))
                        places.append((*cells, i, j))
            if places:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*places, strict=True)), pa.array(blobs, pa.binary())], names=[*PLACE, "_points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nears() -> Iterator[Near]:
            for batch, halo, row in _unpacked(batches, half):
                near = Near(batch, radius, edge, inclusive, keep_self, None)
                near.halo, near.row = halo, row
                yield near

        yield from reduce(nears())

    # tiles are much work on few bytes, so tasks may not be merged by size; a batch holds its task's rows
    tasks = max(200, 8 * points.sparkSession.sparkContext.defaultParallelism, total // WIDE)
    rows = points.mapInArrow(pack, ", ".join(f"{c} long" for c in PLACE) + ", _points binary")
    return rows.repartition(tasks, *PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, schema)


def _packs(batches: Iterator[pa.RecordBatch], edge: float, reach: float, half: bool) -> Iterator[tuple[tuple[int, ...], np.ndarray, list[np.ndarray], np.ndarray]]:
    """Cell, keys, positions and which are targets; with ``half``, which are of a later cell (those of earlier ones are left out)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * ROWS:
            yield from _pack(_joined(held), edge, reach, half)
            held = []
    if held:
        yield from _pack(_joined(held), edge, reach, half)


def _pack(batch: pa.RecordBatch, edge: float, reach: float, half: bool) -> Iterator[tuple[tuple[int, ...], np.ndarray, list[np.ndarray], np.ndarray]]:
    ids, at = batch.column("point_id").to_numpy(), [batch.column(a).to_numpy() for a in AXES]
    target = batch.column("_t").to_numpy(zero_copy_only=False)
    fine = np.isfinite(at).all(0)  # others are near nothing
    cell = lambda v: np.clip(np.floor(v / edge), -9e18, 9e18).astype(np.int64)
    own = np.flatnonzero(fine & ~target)
    rows, kinds, cells = [own], [np.zeros(len(own), bool)], [[cell(v[own]) for v in at]]
    spread = own if half else np.flatnonzero(fine & target)
    ends = [(cell(v[spread] - reach), cell(v[spread] + reach)) for v in at]
    home = [cell(v[spread]) for v in at]
    # with the slack, a point half-way reaches both neighbours of its cell
    most = [range(int((high - low).max(initial=0)) + 1) for low, high in ends]
    for picks in itertools.product(*most):
        good = np.ones(len(spread), bool)
        for (low, high), k in zip(ends, picks, strict=True):
            if k:
                good &= high - low >= k
        there = [low + k for (low, _), k in zip(ends, picks, strict=True)]
        if half:
            x, y, z = (h - c for h, c in zip(home, there, strict=True))
            good &= (x > 0) | ((x == 0) & ((y > 0) | ((y == 0) & (z > 0))))
        good = np.flatnonzero(good)
        rows.append(spread[good])
        kinds.append(np.ones(len(good), bool))
        cells.append([c[good] for c in there])
    row, kind = np.concatenate(rows), np.concatenate(kinds)
    place = [np.concatenate(c) for c in zip(*cells, strict=True)]
    if not len(row):
        return
    low = [int(c.min()) for c in place]
    wide = [int(c.max()) - m + 1 for c, m in zip(place, low, strict=True)]
    if math.prod(wide) < 1 << 31:
        order = np.argsort((((place[0] - low[0]) * wide[1] + place[1] - low[1]) * wide[2] + place[2] - low[2]).astype(np.int32))
    else:
        order = np.lexsort(place)
    row, kind, place = row[order], kind[order], [c[order] for c in place]
    ids, at = ids[row], [v[row] for v in at]
    heads = np.flatnonzero(np.concatenate(([True], (place[0][1:] != place[0][:-1]) | (place[1][1:] != place[1][:-1]) | (place[2][1:] != place[2][:-1]))))
    for *cells, a, b in zip(*(c[heads].tolist() for c in place), heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        yield tuple(cells), ids[a:b], [v[a:b] for v in at], kind[a:b]


def _unpacked(batches: Iterator[pa.RecordBatch], half: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None, np.ndarray | None]]:
    """Batches of whole cells: of ``ROWS`` rows about, or one cell; with ``half`` also what is of other cells, and row numbers."""
    held: list[tuple[tuple[int, ...], list[np.ndarray]]] = []

    def made() -> tuple[pa.RecordBatch, np.ndarray | None, np.ndarray | None]:
        columns, numbers, at = [], [], 0
        for place, group in itertools.groupby(held, key=lambda h: h[0]):
            parts = [np.concatenate(c) for c in zip(*(g[1] for g in group), strict=True)]
            kind = parts[4]
            number = np.where(kind, -1, np.arange(at, at + len(kind)))
            at += len(kind)
            if half:  # the cell's own points are sources and targets
                own = np.flatnonzero(~kind)
                parts = [np.concatenate((c[own], c)) for c in parts]
                number = np.concatenate((number[own], number))
                halo, parts[4] = parts[4], np.arange(len(number)) >= len(own)
                numbers.append((halo, number))
            columns.append([*parts, *(np.full(len(parts[0]), p) for p in place)])
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], names=["point_id", *AXES, "_t", *PLACE])
        halo, row = (np.concatenate(c) for c in zip(*numbers, strict=True)) if half else (None, None)
        return batch, halo, row

    size = 0
    for batch in batches:
        places = list(zip(*(batch.column(c).to_pylist() for c in PLACE), strict=True))
        for place, blob in zip(places, batch.column("_points"), strict=True):
            if held and size > ROWS and place != held[-1][0]:
                yield made()
                held, size = [], 0
            raw = blob.as_buffer()
            n = raw.size // 33
            held.append((place, [np.frombuffer(raw, np.int64, n), *(np.frombuffer(raw, np.float64, n, 8 * n * k) for k in (1, 2, 3)), np.frombuffer(raw, bool, n, 32 * n)]))
            size += n
    if held:
        yield made()


def whole(batches: Iterator[pa.RecordBatch], place: tuple[str, ...] = PLACE) -> Iterator[pa.RecordBatch]:
    """Batches of whole cells: of ``ROWS`` rows about, or one cell."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        places = np.stack([batch.column(c).to_numpy() for c in place])
        ends = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1
        if last is not None and (places[:, 0] != last).any():
            ends = np.concatenate(([0], ends))
        at = 0
        if held and size + batch.num_rows > ROWS and len(ends):
            # as many whole cells as fit, at least the one begun
            to = int(ends[max(0, int(np.searchsorted(ends, ROWS - size, "right")) - 1)])
            yield _joined([*held, batch.slice(0, to)])
            held, size, at = [], 0, to
        held.append(batch.slice(at))
        size += batch.num_rows - at
        last = places[:, -1]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- reducers ----------------------------------------------------------------


def _batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)


def listed(schema: T.StructType) -> Reducer:
    """Every pair; ``schema`` names what is wanted of ``s_``, ``t_`` and ``d2``."""

    def column(near: Near, name: str, s: np.ndarray, t: np.ndarray, d2: np.ndarray):
        if name == "d2":
            return pa.array(d2)
        rows = s if name.startswith("s_") else t
        return near.batch.column(name[2:] if name[2:] in ("point_id", *AXES) else name).take(pa.array(rows))

    def work(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
        for near in cells:
            for found in near.pairs():
                if len(found[0]):
                    yield _batch(schema, [column(near, c, *found) for c in schema.names])

    return work


COUNTED = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("n", T.LongType())])


def _tally(near: Near) -> np.ndarray:
    """Numbers of targets of each row, by tiles; where pairs are held once, of both points of a pair."""
    n = np.zeros(len(near.id), np.int64)
    for s, t, d2 in near.tiles(n):
        sure, maybe = d2 < 1 - DOUBT, d2 < 1 + DOUBT
        n[s] += _true(sure)
        i, j = _places(np.not_equal(maybe, sure, out=maybe))
        good = near.exact(s[i], t[j])[1] if len(i) else i
        np.add.at(n, s[i], good)
        if near.halo is not None:
            n[t] += sure.view(np.uint8).sum(0, dtype=np.uint8 if len(s) < 256 else np.int64)[: len(t)]
            np.add.at(n, t[j], good)
    if near.halo is not None:
        s, t, _ = near.same()
        other = near.row[s] != near.row[t]
        np.subtract.at(n, s[other], 1)
        np.subtract.at(n, t[near.halo[t]], 1)
        # what the cell's own points have as targets goes to them as sources
        own, twice = np.flatnonzero(~near.target), np.flatnonzero(near.target & ~near.halo)
        seat = np.empty(len(n), np.int64)
        seat[near.row[own]] = own
        n[seat[near.row[twice]]] += n[twice]
        n[twice] = 0
    elif not near.keep_self:
        np.subtract.at(n, near.same()[0], 1)
    return n


def _lowest(near: Near, n: np.ndarray) -> np.ndarray:
    """The least squared distance of the rows that have targets: most have one in a small part of the radius, where tiles are still full."""
    least, left = np.full(len(n), np.inf), np.flatnonzero(n)
    radius = near.radius * (512 / max(512.0, float(n[left].mean()))) ** (1 / 3) if len(left) else near.radius
    while len(left):
        some = near.narrowed(radius) if radius < near.radius else near
        for s, t, d2 in some.tiles(None, left):
            if not near.keep_self:
                d2[:, : len(t)][near.id[s][:, None] == near.id[t]] = np.inf
            low = d2.min(1, keepdims=True)
            i, j = _places(d2 <= np.where(low < 1 + DOUBT, low + 2 * DOUBT, -1))
            found, good = some.exact(s[i], t[j])
            np.minimum.at(least, s[i[good]], found[good])
        if some is near:
            break
        left, radius = left[least[left] == np.inf], 2 * radius
    return least


def _true(found: np.ndarray) -> np.ndarray:
    """Numbers of true values by row; rows are whole words."""
    return np.bitwise_count(found.view(np.uint64)).sum(1, dtype=np.int64)


def _places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true values; rows are whole words."""
    words = np.flatnonzero(found.reshape(-1).view(np.uint64) != 0)
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.divmod(at[found.reshape(-1)[at]], found.shape[1])


def _dense(near: Near) -> bool:
    if near.radius <= 0 or near.beyond is not None:
        return False
    # targets that a source's cell has; about half of them where pairs are held once
    n, m = (np.bincount(near.cell[side], minlength=near.cell[-1] + 1) for side in (~near.target, near.target))
    return (2 if near.halo is None else 4) * int((n * m).sum()) > BLOCK * int(n.sum())


def counted(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
    """Numbers of targets of each source that has any."""
    for near in cells:
        if _dense(near):
            n = _tally(near)
        else:
            n = np.zeros(len(near.id), np.int64)
            for s, t, _ in near.pairs():
                n += np.bincount(s, minlength=len(n))
                if near.halo is not None:
                    n += np.bincount(t[near.halo[t]], minlength=len(n))
        own = np.flatnonzero(n)
        yield _batch(COUNTED, [near.id[own], n[own]])


SUMMED = T.StructType([*COUNTED, T.StructField("d2", T.DoubleType())])


def summed(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
    """Numbers of targets of each source that has any, and the least squared distance."""
    for near in cells:
        if _dense(near):
            n = _tally(near)
            least = _lowest(near, n)
        else:
            n, least = np.zeros(len(near.id), np.int64), np.full(len(near.id), np.inf)
            for s, _, d2 in near.pairs():
                n += np.bincount(s, minlength=len(n))
                np.minimum.at(least, s, d2)
        own = np.flatnonzero(n)
        yield _batch(SUMMED, [near.id[own], n[own], least[own]])


BINNED = T.StructType([T.StructField("bin", T.LongType()), T.StructField("n", T.LongType())])


def binned(bins: int, bin_of: Callable[[Near, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Reducer:
    """Numbers of pairs by ``bin_of`` them; those outside of ``[0, bins)`` do not count."""

    def work(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins, np.int64)
        for near in cells:
            for s, t, d2 in near.pairs():
                b = bin_of(near, s, t, d2)
                n += np.bincount(b[(b >= 0) & (b < bins)].astype(np.int64), minlength=bins)
        own = np.flatnonzero(n)
        yield _batch(BINNED, [own, n[own]])

    return work


def distances(bins: int) -> Reducer:
    """Numbers of pairs by ``bins`` equal parts of the radius."""
    # a bin's parts are a power of two, so that few pairs are compared exactly; those of 1.05 radii have numbers of 16 bits
    most = max(0, int(math.log2(65535 / (bins * 1.05))))
    shift = np.uint16(min(range(most + 1), key=lambda k: 2 / 2**k + (bins * DOUBT * 2**k) ** 3))
    parts = 1 << int(shift)

    def tally(near: Near, d2: np.ndarray) -> np.ndarray:
        b = np.floor(np.sqrt(d2) / near.radius * bins)
        return np.bincount(b[b < bins].astype(np.int64), minlength=bins)

    def work(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(bins, np.int64)
        # the error of a bin's number is bins**2 * DOUBT / 2 over it, in bins: half a part at most above this
        near_zero = np.uint16(min(65535, math.ceil(bins * bins * DOUBT * parts) * parts))
        for near in cells:
            if not _dense(near) or bins > 200:
                for _, t, d2 in near.pairs():
                    n += tally(near, d2)
                    if near.halo is not None:
                        n += tally(near, d2[near.halo[t]])
                continue
            total, n = n, np.zeros(bins, np.int64)
            for s, t, d2 in near.tiles():
                # parts of bins; where the next bin is less than a part away, or the bin is near 0, the pair is compared exactly
                np.sqrt(np.clip(d2, 0, 1.1, out=d2), out=d2)
                part = np.multiply(d2, np.float32(bins * parts), out=d2).astype(np.uint16)
                doubt = ((part + np.uint16(1)) & np.uint16(parts - 1)) < 2
                doubt |= part < near_zero
                part >>= shift
                low = part.astype(np.uint8)
                low |= doubt.view(np.uint8) * np.uint8(255)
                n += _by_value(low)[:bins]
                i, j = _places(doubt)
                found, good = near.exact(s[i], t[j])
                n += tally(near, found[good])
            if not near.keep_self:
                s, t, d2 = near.same()
                n = n - tally(near, d2) if near.halo is None else 2 * n - tally(near, d2[near.row[s] != near.row[t]]) - tally(near, d2[near.halo[t]])
            n += total
        own = np.flatnonzero(n)
        yield _batch(BINNED, [own, n[own]])

    return work


def _by_value(of: np.ndarray) -> np.ndarray:
    """Numbers of the bytes' values, two bytes at a time; their number is even."""
    of = of.reshape(-1)
    two = np.bincount(of.view(np.uint16), minlength=1 << 16).reshape(256, 256)
    return two.sum(0) + two.sum(1)


def nearest(k: int, schema: T.StructType) -> Reducer:
    """The ``k`` nearest targets of each source among those of its block, ties by key."""

    def work(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
        for near in cells:
            none = np.zeros(0, np.int64)
            best: Found = (none, none, np.zeros(0))
            held: list[Found] = []
            for found in near.pairs():
                held.append(found)
                if sum(len(h[0]) for h in held) > 2 * PAIRS:
                    best, held = _least(near, [best, *held], k), []
            best = _least(near, [best, *held], k)
            if len(best[0]):
                rows = {"s_": pa.array(best[0]), "t_": pa.array(best[1])}
                columns = [pa.array(best[2]) if c == "d2" else near.batch.column(c[2:] if c[2:] in ("point_id", *AXES) else c).take(rows[c[:2]]) for c in schema.names]
                yield _batch(schema, columns)

    return work


def _least(near: Near, parts: list[Found], k: int) -> Found:
    s, t, d2 = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((near.id[t], d2, s))
    s, t, d2 = s[order], t[order], d2[order]
    heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))
    own = rank < k
    return s[own], t[own], d2[own]


CLOSEST = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("d2", T.DoubleType())])


def closest(measure: Callable[[Near, np.ndarray, np.ndarray], np.ndarray]) -> Reducer:
    """The least ``measure`` of each source and its targets in a block."""

    def work(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
        for near in cells:
            least = np.full(len(near.id), np.inf)
            for s, t, _ in near.pairs():
                np.minimum.at(least, s, measure(near, s, t))
            own = np.flatnonzero(least < np.inf)
            yield _batch(CLOSEST, [near.id[own], least[own]])

    return work


LINKED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def linked(cells: Iterator[Near]) -> Iterator[pa.RecordBatch]:
    """Links (by key) that join what all pairs of the block join: fewer than its points."""
    for near in cells:
        names, own = np.unique(near.id, return_inverse=True)
        label = np.arange(len(names))
        for s, t, _ in near.pairs():
            a, b, label = joining(own[s], own[t], label)
            if len(a):
                yield _batch(LINKED, [names[a], names[b]])


def joining(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the links (i, j) those that join different labels, and the labels after them."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(i[:0], j[:0])]
    while True:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]), label
        high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
        order = np.lexsort((low, high))
        pick = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        out.append((i[pick], j[pick]))
        parent = np.arange(len(label))
        parent[high[pick]] = low[pick]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
