"""Nearest targets wherever they lie: for sources that a search by radius does not serve.

Two k-d trees, split by bounded samples, deal sources and targets to leaves; the
leaves' bounds come from all points.  Bounds give each leaf of sources a distance
within which its ``k``-th neighbours lie for certain, and so the leaves of targets
that may hold one.  Leaves of sources form blocks, and each block gets those
targets (in parts of ``PART`` rows, if there are more); points travel as arrays, one
row for those of a batch that go to one block.  There, groups of sources are halved,
and at each step the targets that cannot be near enough to any point of the group's
box go; what remains is compared exactly.  Samples decide on work, not on results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.blocks import PACK, ROWS, _joined
from pointloom.points import AXES

#: Points that split a tree; leaves of a tree at most; sources and targets of a block, about.
SAMPLE, LEAVES, BLOCK, PART = 1 << 16, 1 << 12, 1 << 15, 1 << 20
#: Sources of a group that is not halved; distances worked on together.
GROUP, TILE = 64, 1 << 16
#: Relative slack of bounds, far above rounding.
SLACK = 1e-9


class Tree:
    """Halves of the widest side, ``depth`` times."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        parts = [sample]
        for level in range(depth):
            below = []
            for k, p in enumerate(parts):
                node = (1 << level) - 1 + k
                if len(p) > 1:
                    axis = int(np.argmax(p.max(0) - p.min(0)))
                    cut = np.partition(p[:, axis], (len(p) - 1) // 2)[(len(p) - 1) // 2]
                    self.axis[node], self.cut[node] = axis, cut
                    right = p[:, axis] > cut
                    below += [p[~right], p[right]]
                else:
                    below += [p, p[:0]]
            parts = below

    def leaf(self, at: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(at), np.int64), np.arange(len(at))
        for _ in range(self.depth):
            node = 2 * node + 1 + (at[rows, self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def _at(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(a).to_numpy() for a in AXES], 1)


def _tree(points: DataFrame, n: int, per_leaf: int) -> Tree:
    share = min(1.0, SAMPLE / max(n, 1))
    rows = points.select(*AXES)
    rows = (rows if share >= 1 else rows.sample(share, 1)).toArrow()
    depth = max(0, min(LEAVES, n // per_leaf).bit_length() - 1)
    return Tree(np.stack([rows.column(a).to_numpy() for a in AXES], 1), depth)


BOUND = "_leaf long, _n long, " + ", ".join(f"{f}_{a} double" for f in ("lo", "hi") for a in AXES)


def _leaves(points: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, count and bounds of the leaves that have points."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << tree.depth
        n, low, high = np.zeros(size, np.int64), np.full((size, 3), np.inf), np.full((size, 3), -np.inf)
        for batch in batches:
            at = _at(batch)
            if len(at):
                leaf = tree.leaf(at)
                order = np.argsort(leaf, kind="stable")
                heads = np.flatnonzero(np.diff(leaf[order], prepend=-1))
                own, at = leaf[order][heads], at[order]
                n[own] += np.diff(np.append(heads, len(at)))
                low[own], high[own] = np.minimum(low[own], np.minimum.reduceat(at, heads)), np.maximum(high[own], np.maximum.reduceat(at, heads))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own, n[own], *low[own].T, *high[own].T)], names=names)

    names = T._parse_datatype_string(BOUND).names
    every = [f(c).alias(c) for c, f in ((c, F.min if c.startswith("lo") else F.max) for c in names[2:])]
    found = points.select(*AXES).mapInArrow(part, BOUND).groupBy("_leaf").agg(F.sum("_n").alias("_n"), *every).toArrow()
    columns = [found.column(c).to_numpy() for c in names]
    return columns[0], columns[1], np.stack(columns[2:5], 1), np.stack(columns[5:], 1)


def _needed(sources: tuple, targets: tuple, k: int, beyond: float) -> Iterator[np.ndarray]:
    """For the leaves of sources in turn, which leaves of targets may hold one of the ``k`` nearest of a point."""
    _, n, low, high = targets
    most = min(k, len(n))
    for at, to in zip(sources[2], sources[3], strict=True):
        gap = np.maximum(0.0, np.maximum(low - to, at - high))
        wide = np.maximum(high - at, to - low)
        near, far = np.sqrt((gap * gap).sum(1)), np.sqrt((wide * wide).sum(1)) * (1 + SLACK)
        # only leaves that lie beyond the dead zone as a whole give a bound
        sure = np.where(near * (1 - SLACK) > beyond, far, np.inf)
        first = np.argpartition(sure, most - 1)[:most]
        first = first[np.argsort(sure[first])]
        enough = np.flatnonzero(np.cumsum(n[first]) >= k)
        bound = sure[first[enough[0]]] if len(enough) else np.inf
        yield (near * (1 - SLACK) <= bound) & (far > beyond)


def nearest(sources: DataFrame, targets: DataFrame, n_sources: int, k: int, schema: T.StructType, source_columns: tuple[str, ...] = (), target_columns: tuple[str, ...] = (), beyond: float | None = None) -> tuple[DataFrame, bool]:
    """Rows of ``schema`` and ``rank``: the ``k`` nearest targets of each source, ties by key.

    The flag tells that blocks had parts: then a source has up to ``k`` rows of each part.
    """
    spark, dead = sources.sparkSession, -1.0 if beyond is None else float(beyond)
    # a source is no neighbour of itself; as many targets may have its key
    same = targets.groupBy("point_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("n")).first()
    enough = k + (same["m"] or 0)
    own_tree, other_tree = _tree(sources, n_sources, 64), _tree(targets, same["n"] or 0, 64)
    own, other = _leaves(sources, own_tree), _leaves(targets, other_tree)
    per = max(1024, min(BLOCK, n_sources // 64))
    block_of = np.zeros(1 << own_tree.depth, np.int64)
    numbers = np.argsort(own[0])
    block_of[own[0][numbers]] = (np.cumsum(own[1][numbers]) - 1) // per
    blocks = int(block_of.max()) + 1
    need = np.zeros((blocks, 1 << other_tree.depth), bool)
    for leaf, wanted in zip(own[0], _needed(own, other, enough, dead), strict=True):
        need[block_of[leaf], other[0][wanted]] = True
    count = np.zeros(need.shape[1], np.int64)
    count[other[0]] = other[1]
    parts = np.maximum(1, -(-(need @ count) // PART))
    first = np.cumsum(parts) - parts
    wants = [np.flatnonzero(need[:, leaf]) for leaf in range(need.shape[1])]
    lengths, flat = np.array([len(w) for w in wants]), np.concatenate(wants)
    begins = np.cumsum(lengths) - lengths
    ranked = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])

    def copies(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(counts)), counts)
        return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)

    def places_of_source(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        b = block_of[own_tree.leaf(_at(batch))]
        rows, j = copies(parts[b])
        return rows, first[b][rows] + j

    def places_of_target(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at = _at(batch)
        leaf = other_tree.leaf(at)
        rows, j = copies(lengths[leaf])
        b = flat[begins[leaf][rows] + j]
        seat = (batch.column("point_id").to_numpy() ^ at[:, 0].view(np.int64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return rows, first[b] + seat.astype(np.int64)[rows] % parts[b]

    def side(df: DataFrame, prefix: str, names: tuple[str, ...], places) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _merged(batches):
                rows, to = places(batch)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                heads = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
                for b, begin, end in zip(to[heads].tolist(), heads, [*heads[1:], len(to)], strict=True):
                    blobs = [_blob(batch.take(pa.array(rows[k : min(k + PACK, end)]))) for k in range(begin, end, PACK)]
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(blobs)), pa.array([prefix == "t_"] * len(blobs)), pa.array(blobs, pa.binary())], names=["_b", "_t", "_points"])

        rows = df.select("point_id", *AXES, *(F.col(c).alias(f"{prefix}{c}") for c in names if c not in AXES))
        return rows.mapInArrow(deal, "_b long, _t boolean, _points binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = (row for batch in batches for row in zip(*(batch.column(c) for c in ("_b", "_t", "_points")), strict=True))
        for _, group in itertools.groupby(blobs, key=lambda row: row[0].as_py()):
            sides: tuple[list[pa.Table], list[pa.Table]] = [], []
            for _, target, points in group:
                sides[target.as_py()].append(pa.ipc.open_stream(points.as_buffer()).read_all())
            if all(sides):
                both = [pa.concat_tables(side) for side in sides]
                both = [t.append_column("_t", pa.array(np.full(t.num_rows, kind))) for t, kind in zip(both, (False, True), strict=True)]
                yield from _block(pa.concat_tables(both, promote_options="default").combine_chunks(), k, enough, dead, ranked).to_batches(ROWS)

    # blocks are of unlike work, so hashing should put few of them together
    tasks = int(min(4 * parts.sum(), max(200, spark.sparkContext.defaultParallelism * 16)))
    rows = side(sources, "s_", source_columns, places_of_source).unionByName(side(targets, "t_", target_columns, places_of_target))
    return rows.repartition(tasks, "_b").sortWithinPartitions("_b").mapInArrow(run, ranked), bool((parts > 1).any())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``2 * ROWS`` rows about, so that a block's points of a batch are some hundreds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * ROWS:
            yield _joined(held)
            held = []
    if sum(b.num_rows for b in held):
        yield _joined(held)


def _blob(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _block(table: pa.Table, k: int, enough: int, beyond: float, ranked: T.StructType) -> pa.Table:
    target = table.column("_t").to_numpy()
    key, at = table.column("point_id").to_numpy(), np.stack([table.column(a).to_numpy() for a in AXES], 1)
    mine, others = np.flatnonzero(~target), np.flatnonzero(target)
    others = others[np.argsort(key[others], kind="stable")]  # the first of equal distances has the least key
    shared = bool(np.isin(key[mine], key[others]).any())
    found = [part for group in _groups(at, mine, others, enough, beyond) for part in _tiles(at, key, *group, k, beyond, shared)]
    none = np.zeros(0, np.int64)
    s, t, d2, rank = (np.concatenate(c) for c in zip((none, none, np.zeros(0), none), *found, strict=True))
    made = {"d2": pa.array(d2), "rank": pa.array(rank.astype(np.int32))}
    rows = {"s_": pa.array(s), "t_": pa.array(t)}
    columns = [made[c] if c in made else table.column(c[2:] if c[2:] in ("point_id", *AXES) else c).take(rows[c[:2]]) for c in ranked.names]
    return pa.Table.from_arrays(columns, names=ranked.names)


def _groups(at: np.ndarray, mine: np.ndarray, others: np.ndarray, enough: int, beyond: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sources, the targets that may be among the nearest of one of them, and where these are."""
    todo = [(mine, others, np.ascontiguousarray(at[others].T))]
    while todo:
        group, some, there = todo.pop()
        if not len(group) or not len(some):
            continue
        p = at[group]
        low, high = p.min(0), p.max(0)
        near2, far2 = _to_box(there, low, high)
        # farther than so many targets are from all of the group's box, none is needed; the dead zone may hold some of these
        sure = far2 if beyond < 0 else far2[near2 * (1 - SLACK) > beyond * beyond]
        # a target that lies in the dead zone of the whole box is none's neighbour
        kept = far2 * (1 + SLACK) > beyond * beyond if beyond >= 0 else np.ones(len(some), bool)
        if len(sure) >= enough:
            kept &= near2 * (1 - SLACK) <= np.partition(sure, enough - 1)[enough - 1] * (1 + SLACK)
        first = int(np.argmin(far2))
        toward = np.abs(there[:, first] - (low + high) / 2)
        if not kept.all():
            some, there = some[kept], np.ascontiguousarray(there[:, kept])
        if len(group) <= GROUP or (low == high).all() or len(group) * len(some) <= TILE // 8:
            yield group, some, there
            continue
        # depth toward the targets widens the bounds in full, width across them by its square
        wide = high - low
        axis = int(np.argmax(wide * (toward + wide)))
        order = np.argpartition(p[:, axis], len(group) // 2)
        todo += [(group[half], some, there) for half in (order[: len(group) // 2], order[len(group) // 2 :])]


def _to_box(there: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distances from the points of a box."""
    near2, far2 = np.zeros(there.shape[1]), np.zeros(there.shape[1])
    for v, a, b in zip(there, low, high, strict=True):
        over, under = v - a, b - v
        gap = np.minimum(np.minimum(over, under), 0.0)
        near2 += np.multiply(gap, gap, out=gap)
        wide = np.maximum(over, under, out=over)
        far2 += np.multiply(wide, wide, out=wide)
    return near2, far2


def _square(there: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Squared distances by the terms and the order of the joins by radius."""
    d2, q = here[0] - there[0], here[1] - there[1]
    np.multiply(d2, d2, out=d2)
    d2 += np.multiply(q, q, out=q)
    np.subtract(here[2], there[2], out=q)
    d2 += np.multiply(q, q, out=q)
    return d2


def _tiles(at: np.ndarray, key: np.ndarray, group: np.ndarray, some: np.ndarray, there: np.ndarray, k: int, beyond: float, shared: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(source, target, squared distance, rank) of the ``k`` nearest; ``shared``: sources may be targets."""
    step = max(1, TILE // len(some))
    for begin in range(0, len(group), step):
        own = group[begin : begin + step]
        d2 = _square(there, at[own].T[:, :, None])
        if shared:
            d2[key[own][:, None] == key[some]] = np.inf
        if beyond >= 0:
            d2[d2 <= beyond * beyond] = np.inf
        rows = np.arange(len(own))
        if k <= 8:
            picks = ((np.argmin(d2, 1), r) for r in range(min(k, len(some))))
        else:
            order = np.argsort(d2, 1, kind="stable")[:, :k]
            picks = ((order[:, r], r) for r in range(order.shape[1]))
        for pick, r in picks:
            least = d2[rows, pick]
            real = least < np.inf
            yield own[real], some[pick[real]], least[real], np.full(int(real.sum()), r + 1, np.int64)
            if k <= 8:
                d2[rows, pick] = np.inf
