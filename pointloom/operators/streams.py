"""Several streams of points: union, counts, density, cluster tables, regions and reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.ranging import RangeTable, ranged
from pointloom.scratch import cut

#: Rows that a report of bad points lists.
REPORT = 200
#: Regions of a chunk; regions begun before that meet it in one task.
CROWD, BEGUN = 1 << 13, 1 << 15
#: Pairs made at once; lower ends of a tile.
PAIRS, TILE = 1 << 18, 1 << 8


def collate(streams: dict[str, DataFrame], label: str = "stream") -> DataFrame:
    """All points of all streams, with the stream's name; columns that a stream lacks are null there.

    A stream's own column named like ``label`` is replaced.
    """
    if not streams:
        raise ValueError("no streams")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(label, F.lit(name)) for name, df in streams.items()))


def passed_on(own: dict[str, DataFrame], upstream: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What an operator hands on: its own streams, and those it does not change; its own win a name."""
    return {**upstream, **own}


def counted(streams: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """``stream`` and its number of rows ``n``, in one job for all; empty streams have 0."""
    chosen = {k: v for k, v in streams.items() if names is None or k in names}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stream"), "n") for name, df in chosen.items()]
    return reduce(DataFrame.unionByName, parts)


def density(points: DataFrame, table: RangeTable, volume: float) -> DataFrame:
    """``ion``, ``n`` and ``density``: counts over a volume; rows ``ranged`` and ``total`` sum up. No volume, no density."""
    counts = ranged(points, table).groupBy(F.coalesce("ion", F.lit("unranged")).alias("ion")).agg(F.count("*").alias("n"))
    sums = counts.agg(F.coalesce(F.sum(F.when(F.col("ion") != "unranged", F.col("n"))), F.lit(0)).alias("r"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    rows = sums.select(F.explode(F.array(F.struct(F.lit("ranged").alias("ion"), F.col("r").alias("n")), F.struct(F.lit("total").alias("ion"), F.col("t").alias("n")))).alias("s")).select("s.*")
    return counts.unionByName(rows).withColumn("density", F.col("n") / F.nullif(F.lit(float(volume)), F.lit(0.0)))


def cluster_composition(clusters: DataFrame, ions: DataFrame) -> DataFrame:
    """``ion``, its count ``n`` among clustered points and its share; ``ions`` has point_id and ion."""
    counts = clusters.join(ions.select("point_id", "ion"), "point_id").groupBy(F.coalesce("ion", F.lit("unranged")).alias("ion")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))  # one row
    return counts.join(F.broadcast(total)).select("ion", "n", (F.col("n") / F.col("_t")).alias("fraction"))


def spectrum_regions(spectrum: DataFrame, table: RangeTable) -> DataFrame:
    """Add ``region`` and ``ion`` to the bins of a spectrum: the enabled range that holds the left edge, if any."""
    region = None
    for k, r in enumerate(table.ranges):
        if r.enabled:
            hit = F.col("x").between(F.lit(float(r.low)), F.lit(float(r.high)))
            region = F.when(hit, k) if region is None else region.when(hit, k)
    names = F.array(*(F.lit(table.ions[r.ion].short) for r in table.ranges)) if table.ranges else None
    out = spectrum.withColumn("region", F.lit(None).cast("int") if region is None else region.cast("int"))
    return out.withColumn("ion", F.lit(None).cast("string") if names is None else F.get(names, F.col("region")))


def overlapping(regions: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs ``a < b`` of regions (``id, low, high``) that have an open interval in common.

    Regions sorted by their lower ends are cut into chunks of at most ``CROWD``.  A region
    goes to the chunks that begin within it, and by its number alone to those that end
    there too; a pair comes in the chunk of its later region, once.  So rows sent grow
    with the chunks that regions reach.  Where more than ``BEGUN`` regions reach a chunk
    they are dealt to several tasks.  Widths of cells need not be known: ``cell`` is
    not used.
    """
    spark, crowd = regions.sparkSession, CROWD
    kind, ends = regions.schema["id"].dataType, [regions.schema[c].dataType for c in ("low", "high")]
    fields = [T.StructField(n, t) for n, t in zip(("id", "low", "high"), (kind, *ends), strict=True)]
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            number = part + np.arange(at, at + batch.num_rows) // crowd
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=["id", "low", "high", "_chunk"])

    rows = regions.where("id is not null and low < high").select("id", "low", "high")
    rows = rows.repartitionByRange(8 * spark.sparkContext.defaultParallelism, "low", "id", "high").sortWithinPartitions("low", "id", "high")
    rows = cut(rows.mapInArrow(numbered, T.StructType([*fields, T.StructField("_chunk", T.LongType())])))
    chunks = rows.groupBy("_chunk").agg(F.min("low").alias("low"), F.count("*").alias("n")).toArrow().sort_by("_chunk")
    numbers, lows, sizes = (chunks.column(c).to_numpy() for c in ("_chunk", "low", "n"))
    if not len(numbers):
        return spark.createDataFrame([], pair)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(_last(lows, batch.column("high")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    ended = np.zeros(len(numbers), np.int64)
    for row in rows.select("high").mapInArrow(last, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        ended[row["at"]] = row["n"]
    before = np.cumsum(sizes - ended) - (sizes - ended)
    parts = np.maximum(1, -(-before // BEGUN))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sent(batch, numbers, lows, parts)

    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]
    place = [T.StructField(c, T.LongType()) for c in ("_chunk", "_part")]
    # pairs are many of few regions, so tasks may not be merged by size
    tasks = min(2 * int(parts.sum()), 20_000)
    met = rows.mapInArrow(sent, T.StructType([*place, *lists])).repartition(tasks, "_chunk", "_part").sortWithinPartitions("_chunk", "_part")
    return met.mapInArrow(_met, pair)


def _last(lows: np.ndarray, high: pa.Array) -> np.ndarray:
    """The last chunk that begins below each upper end."""
    return np.searchsorted(lows, high.to_numpy(zero_copy_only=False), "left") - 1


def _counted(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position ``size`` times, and 0, 1 ... within it."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Neighbours of ``PAIRS`` in all, or one."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, to)
        at = to


def _sent(batch: pa.RecordBatch, numbers: np.ndarray, lows: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Regions as lists by chunk and part: a chunk's own with their lower ends, and others that end within it with their upper ends."""
    own, last = np.searchsorted(numbers, batch.column("_chunk").to_numpy()), _last(lows, batch.column("high"))

    def lists(row: np.ndarray, chunk: np.ndarray, part: np.ndarray, *with_: str) -> Iterator[pa.RecordBatch]:
        if not len(row):
            return
        order = np.lexsort((part, chunk))
        row, chunk, part = row[order], chunk[order], part[order]
        heads = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (part[1:] != part[:-1]))))
        ends, none = pa.array([*heads.tolist(), len(row)], pa.int32()), pa.array(np.zeros(len(heads) + 1, np.int32))
        take = pa.array(row)
        columns = [pa.ListArray.from_arrays(ends, batch.column(c).take(take)) if c in ("id", *with_) else pa.ListArray.from_arrays(none, batch.column(c).slice(0, 0)) for c in ("id", "low", "high")]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[heads]), pa.array(part[heads]), *columns], names=["_chunk", "_part", "id", "low", "high"])

    for at in _slices(parts[own]):
        row, part = _counted(parts[own[at]])
        row += at.start
        head = part == 0  # the chunk's own meet there
        yield from lists(row[head], own[row[head]], part[head], "low", "high")
        yield from lists(row[~head], own[row[~head]], part[~head], "low")
    for at in _slices(last - own):
        row, chunk = _counted((last - own)[at])
        row += at.start
        chunk += own[row] + 1
        part, over = own[row] % parts[chunk], last[row] > chunk
        yield from lists(row[over], chunk[over], part[over])
        yield from lists(row[~over], chunk[~over], part[~over], "high")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of whole chunks and parts, all but the last batch by eights."""
    held: list[tuple[pa.Array, pa.Array, pa.Array]] = []
    rest: list[pa.RecordBatch] = []
    place = None

    def even(made: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        nonlocal rest
        for by_eights, batch in made:
            if by_eights:
                yield batch
                continue
            rest.append(batch)
            if (n := sum(b.num_rows for b in rest)) >= PAIRS:
                whole = pa.concat_batches(rest)
                yield whole.slice(0, n - n % 8)
                rest = [whole.slice(n - n % 8)]

    for batch in batches:
        places = zip(*(batch.column(c).to_pylist() for c in ("_chunk", "_part")), strict=True)
        for k, now in enumerate(places):
            if now != place and held:
                yield from even(_paired(held))
                held = []
            place = now
            held.append(tuple(batch.column(c)[k].values for c in ("id", "low", "high")))
    if held:
        yield from even(_paired(held))
    yield from rest


def _paired(held: list[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pairs of the regions of a chunk with those begun before, a tile of lower ends at a time.

    Beside each other the same numbers of a tile recur in the same order, mostly in lists
    of eights: Parquet packs numbers by eight, so their bytes recur too and take little.
    With each batch goes whether it has such lists only.
    """
    held = [*(h for h in held if len(h[1])), *(h for h in held if not len(h[1]))]
    n = sum(len(h[1]) for h in held)
    ids = pa.concat_arrays([h[0] for h in held])
    low = np.concatenate([h[1].to_numpy(zero_copy_only=False) for h in held if len(h[1])])
    codes, named = ids.to_numpy(zero_copy_only=False), None
    if not pa.types.is_integer(ids.type):
        _, at, codes = np.unique(codes, return_index=True, return_inverse=True)
        named = ids.take(pa.array(at))
    order = np.argsort(low, kind="stable")
    low, own, others = low[order], codes[:n][order], codes[n:]
    reach = lambda h: np.searchsorted(low, h[2].to_numpy(zero_copy_only=False), "left")
    ends = [reach(h) if len(h[2]) else np.full(len(h[0]), n) for h in held if not len(h[1])]
    begin, end, first = [np.zeros(len(others), np.int64)], ends, [others]
    if any(len(h[1]) and len(h[2]) for h in held):
        begin, first = [*begin, np.arange(1, n + 1)], [*first, own]
        end = [*end, np.concatenate([reach(h) for h in held if len(h[1])])[order]]
    if not end:
        return
    begin, end, first = np.concatenate(begin), np.concatenate(end), np.concatenate(first)
    order = np.argsort(first, kind="stable")
    begin, end, first = begin[order], end[order], first[order]
    made: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
    size = {True: 0, False: 0}
    for by_eights, a, b in _tiles(begin, end, first, own):
        if size[by_eights] + len(a) > PAIRS and made[by_eights]:
            yield by_eights, _named(made[by_eights], named)
            made[by_eights], size[by_eights] = [], 0
        made[by_eights].append((a, b))
        size[by_eights] += len(a)
    for by_eights, pairs in made.items():
        if pairs:
            yield by_eights, _named(pairs, named)


def _named(made: list[tuple[np.ndarray, np.ndarray]], named: pa.Array | None) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c) if len(c) > 1 else c[0]) for c in zip(*made, strict=True)]
    return pa.RecordBatch.from_arrays(columns if named is None else [named.take(c) for c in columns], names=["a", "b"])


def _tiles(begin: np.ndarray, end: np.ndarray, first: np.ndarray, own: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Pairs of each of ``first``, in order, with the regions at ``begin`` to ``end``; and whether they are lists of eights."""
    for k in range(0, len(own), TILE):
        to = min(k + TILE, len(own))
        over = (begin <= k) & (end >= to)
        some = np.flatnonzero(~over & (end > k) & (begin < to) & (end > begin))
        tile, whole = np.sort(own[k:to]), first[over]
        after, until = (np.searchsorted(tile, whole, side) for side in ("right", "left"))
        odd = (to - k - after) % 8
        for by_eights, start, size in ((True, after + odd, to - k - after - odd), (False, after, odd)):
            for at in _slices(size):
                row, b = _counted(size[at])
                a, b = whole[at][row], b + start[at][row]
                order = slice(None) if by_eights else np.argsort(b, kind="stable")
                yield by_eights, a[order], tile[b[order]]
        odd = until % 8
        for by_eights, start, size in ((True, np.zeros_like(until), until - odd), (False, until - odd, odd)):
            for at in _slices(size):
                row, a = _counted(size[at])
                a, b = a + start[at][row], whole[at][row]
                order = slice(None) if by_eights else np.argsort(a, kind="stable")
                yield by_eights, tile[a[order]], b[order]
        start = np.maximum(begin[some], k)
        size = np.minimum(end[some], to) - start
        for at in _slices(size):
            row, q = _counted(size[at])
            p, q = first[some[at]][row], own[q + start[at][row]]
            yield False, p[p < q], q[p < q]
            yield False, q[p > q], p[p > q]


def report(points: DataFrame, bad: Column, limit: int = REPORT) -> DataFrame:
    """At most ``limit`` of the points that a condition holds for, as a message shows them."""
    return points.where(bad).limit(limit)


def sample_indices(spark: SparkSession, most: int, n: int, seed: int) -> DataFrame:
    """``n`` different numbers ``index`` of ``[0, most)``, or all of them if there are fewer."""
    return spark.range(most).select(F.col("id").alias("index")).orderBy(F.xxhash64("index", F.lit(seed)), "index").limit(n)
