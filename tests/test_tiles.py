"""Counts and bins of dense cells, by tiles in single precision with exact decisions."""

import numpy as np
import pyarrow as pa
import pytest

from pointloom.operators import blocks


def near(at, ids, target, inclusive=False, keep_self=False, radius=1.0):
    columns = {"point_id": np.asarray(ids, np.int64), **dict(zip("xyz", np.asarray(at, float).T, strict=True)), "_t": target}
    for c in blocks.PLACE:
        columns[c] = np.zeros(len(at), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    return blocks.Near(batch, radius, 4 * radius, inclusive, keep_self, None)


@pytest.mark.parametrize("case", range(6))
def test_tiles_are_exact(monkeypatch, case):
    """On a lattice, so that many distances equal the radius or a bin's edge."""
    rng = np.random.default_rng(case)
    radius = [1.0, 2.0, 3.0, 0.7, 1e-3, 1e4][case]
    at = rng.integers(0, 41, (3000, 3)) / 10 * radius
    at[:, 2] *= [1, 1, 0, 1, 0.2, 1][case]
    target, ids = rng.random(3000) < 0.6, rng.permutation(3000) // 2
    args = at, ids, target, case % 2 == 1, case == 2, radius
    d2 = sum((at[:, None, c] - at[None, :, c]) ** 2 for c in range(3))
    good = (~target[:, None] & target[None, :]) & ((d2 <= radius * radius) if case % 2 else (d2 < radius * radius))
    if case != 2:
        good &= ids[:, None] != ids[None, :]
    monkeypatch.setattr(blocks, "BLOCK", 100)
    assert blocks._dense(near(*args))
    monkeypatch.setattr(blocks.Near, "pairs", lambda self: pytest.fail("pairs of a dense cell"))
    n, least = good.sum(1), np.where(good, d2, np.inf).min(1)
    own = np.flatnonzero(n)
    (got,) = blocks.summed(iter([near(*args)]))
    assert got.column("n").to_numpy().tolist() == n[own].tolist() and got.column("d2").to_numpy().tolist() == least[own].tolist()
    (got,) = blocks.counted(iter([near(*args)]))
    assert got.column("n").to_numpy().tolist() == n[own].tolist()
    (got,) = blocks.distances(30)(iter([near(*args)]))
    b = np.floor(np.sqrt(d2[good]) / radius * 30).astype(int)
    want = np.bincount(b[b < 30], minlength=30)
    assert dict(zip(got.column("bin").to_pylist(), got.column("n").to_pylist(), strict=True)) == {k: v for k, v in enumerate(want.tolist()) if v}


@pytest.fixture(scope="module")
def dense():
    """12,000 points on a lattice in few cells, some with one key: keys, places, and all distances in double precision."""
    rng = np.random.default_rng(11)
    at = rng.integers(0, 60, (12000, 3)) / 20
    ids = rng.integers(0, 11000, 12000)
    d2 = sum((at[:, None, c] - at[None, :, c]) ** 2 for c in range(3))
    d2[ids[:, None] == ids[None, :]] = np.inf
    return ids, at, d2


def points_of(spark, dense):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"point_id": dense[0], **dict(zip("xyz", dense[1].T, strict=True))})).repartition(3)


@pytest.mark.parametrize(("wide", "split"), [(blocks.WIDE, False), (5000, False), (5000, True)])
def test_distribution_of_dense_cells(spark, monkeypatch, dense, wide, split):
    """a join of points with themselves makes each pair once, others make all; blocks of one cell too."""
    from pointloom.operators import spatial

    monkeypatch.setattr(blocks, "WIDE", wide)
    packed, taken = blocks._meet_packed, []
    monkeypatch.setattr(blocks, "_meet_packed", lambda *a: taken.append(a[-1]) or packed(*a))
    points = points_of(spark, dense)
    sources = points.where("x < 2.5") if split else points
    found = {r["bin"]: r["n"] for r in spatial.radial_distribution(sources, points, 0.75, 15).collect()}
    d2 = dense[2][dense[1][:, 0] < 2.5] if split else dense[2]
    b = np.floor(np.sqrt(d2[d2 < 0.75**2]) / 0.75 * 15).astype(int)
    assert found == dict(enumerate(np.bincount(b[b < 15], minlength=15).tolist()))
    assert taken


@pytest.mark.parametrize("wide", [blocks.WIDE, 5000])
def test_counts_of_dense_cells(spark, monkeypatch, dense, wide):
    """F7, F8, F10: of points half-way in a cell, too, which reach both of its neighbours."""
    from pointloom.operators import spatial

    monkeypatch.setattr(blocks, "WIDE", wide)
    points, keys = points_of(spark, dense), np.unique(dense[0])
    found = {r["point_id"]: (r["n"], r["d2"]) for r in spatial.neighbour_summary(points, points, 0.75).collect()}
    near = np.where(dense[2] < 0.75**2, dense[2], np.inf)
    n, least = np.zeros(11000, int), np.full(11000, np.inf)
    np.add.at(n, dense[0], (near < np.inf).sum(1))
    np.minimum.at(least, dense[0], near.min(1))
    assert found == {int(k): (n[k], least[k]) for k in keys if n[k]}
    found = {r["point_id"]: r["n"] for r in spatial.neighbour_counts(points, points, 0.75).collect()}
    assert found == {int(k): n[k] for k in keys if n[k]}


@pytest.mark.parametrize("block", [100, 1 << 20])
@pytest.mark.parametrize("case", range(4))
def test_counts_of_pairs_held_once(monkeypatch, case, block):
    """a join of points with themselves compares each pair once and counts it for both points, across cells too."""
    rng = np.random.default_rng(case)
    radius = [1.0, 0.7, 2.0, 1.0][case]
    at = rng.integers(0, [61, 41, 25, 200][case], (3000, 3)) / 10 * radius
    at[:, 2] *= [1, 0.3, 1, 0][case]
    if case == 2:
        at[:900] = at[0]  # more points of one place than a byte counts
    ids = rng.permutation(3000) // [1, 2, 1, 3][case]
    d2 = sum((at[:, None, c] - at[None, :, c]) ** 2 for c in range(3))
    want = ((d2 < radius * radius) & (ids[:, None] != ids[None, :])).sum(1)
    monkeypatch.setattr(blocks, "BLOCK", block)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, *at.T, np.zeros(3000, bool))], names=["point_id", "x", "y", "z", "_t"])
    rows = []
    for cells, own, place, kind in blocks._pack(batch, blocks.CLOSE * radius, radius * (1 + blocks.SLACK), True):
        rows.append((*cells, 0, 0, b"".join(np.ascontiguousarray(c).tobytes() for c in (own, *place, kind))))
    packs = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*blocks.PLACE, "_points"])
    nears = []
    for made, halo, row in blocks._unpacked(iter([packs]), True):
        nears.append(blocks.Near(made, radius, blocks.CLOSE * radius, False, False, None))
        nears[-1].halo, nears[-1].row = halo, row
    assert blocks._dense(nears[0]) == (block == 100)
    found = np.zeros(3000, int)
    for got in blocks.counted(iter(nears)):
        np.add.at(found, got.column("point_id").to_numpy(), got.column("n").to_numpy())
    by_id = np.zeros(3000, int)
    np.add.at(by_id, ids, want)
    assert (found == by_id).all() and by_id.any()


@pytest.mark.parametrize("named", [blocks.NAMED, 1])
def test_cells_of_one_side_stay(spark, monkeypatch, dense, named):
    """targets that lie near no source were sent and gathered all the same; with more cells than can be named they still are."""
    from pyspark.sql import functions as F

    from pointloom.operators import spatial

    monkeypatch.setattr(blocks, "NAMED", named)
    points = points_of(spark, dense)
    far = points.withColumn("x", F.col("x") + 50)
    met = blocks._meet_packed(points, far, 0.75, blocks.counted, blocks.COUNTED, False, False, True)
    assert met.count() == 0 and "MapInArrow" not in met._jdf.queryExecution().toString()
    some = points.where("x < 1").unionByName(far)
    found = {r["point_id"]: r["n"] for r in spatial.neighbour_counts(points, some, 0.75).collect()}
    near = dense[2][:, dense[1][:, 0] < 1] < 0.75**2
    n = np.zeros(11000, int)
    np.add.at(n, dense[0], near.sum(1))
    assert found == {i: k for i, k in enumerate(n.tolist()) if k}
