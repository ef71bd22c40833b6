"""Overlaps of regions that share cells."""

import numpy as np
import pytest

from pointloom.operators import streams


@pytest.mark.parametrize(("crowd", "text"), [(1 << 13, False), (100, False), (100, True)])
def test_overlaps_are_begun_within(spark, monkeypatch, crowd, text):
    """a crowded cell is dealt to tasks that try no pair in vain; equal ends, ids and whole rows among them."""
    rng = np.random.default_rng(5)
    ids, low = rng.integers(0, 580, 600), rng.integers(-20, 40, 600) / 20
    rows = [(int(i), float(a), float(a + n)) for i, a, n in zip(ids, low, rng.integers(-1, 9, 600) / 20, strict=True)]
    rows += rows[:3]
    key = (lambda i: f"{i:04d}") if text else (lambda i: i)
    kind = "string" if text else "long"
    monkeypatch.setattr(streams, "CROWD", crowd)
    regions = spark.createDataFrame([(key(i), a, b) for i, a, b in rows], f"id {kind}, low double, high double")
    found = streams.overlapping(regions, 0.3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    want = sorted((key(i), key(j)) for i, a, b in rows for j, c, d in rows if i < j and a < b and c < d and a < d and c < b)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == want


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written for others."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_overlaps_need_little_disk(spark, monkeypatch, tmp_path):
    """regions are sent to the chunks they reach, not once for each part of a cell, and pairs come in an order that Parquet keeps in little."""
    rng = np.random.default_rng(1)
    n = 6000
    ids, low = rng.permutation(n), rng.random(n)
    high = low + 0.6 * rng.random(n) + 1e-9
    monkeypatch.setattr(streams, "CROWD", 500)
    regions = spark.createDataFrame(zip(ids.tolist(), low.tolist(), high.tolist(), strict=True), "id long, low double, high double")
    before = _shuffled(spark)
    streams.overlapping(regions, 0.3).write.parquet(str(tmp_path / "pairs"))
    shuffled, held = _shuffled(spark) - before, sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    want = int(np.searchsorted(np.sort(low), high, "left").sum()) - n * (n + 1) // 2
    found = spark.read.parquet(str(tmp_path / "pairs"))
    assert found.count() == found.distinct().count() == want
    assert shuffled < 100 * n
    assert held < 0.5 * want


@pytest.mark.parametrize("begun", [1 << 15, 40])
def test_overlaps_of_odd_regions(spark, monkeypatch, begun):
    """lower ends that are all equal, very long, endless and undefined ones, nulls; and none at all."""
    inf, nan = float("inf"), float("nan")
    rows = [(k, 1.0, 2.0) for k in range(50)] + [(50 + k, k / 7, k / 7 + 1e9 * (k % 3) + 0.1) for k in range(60)]
    rows += [(200, -inf, inf), (201, 5.0, nan), (202, inf, nan), (203, nan, nan), (204, 3.0, 3.0), (205, None, 1.0), (206, 1.0, None), (None, 0.0, 9.0), (207, -0.0, 0.0), (208, 0.0, 1e-300)]
    monkeypatch.setattr(streams, "CROWD", 16)
    monkeypatch.setattr(streams, "BEGUN", begun)
    regions = spark.createDataFrame(rows, "id long, low double, high double").repartition(3)
    less = lambda x, y: x == x and (y != y or x < y)
    fine = [r for r in rows if None not in r and less(r[1], r[2])]
    want = sorted((i, j) for i, a, b in fine for j, c, d in fine if i < j and less(a, d) and less(c, b))
    assert sorted((r["a"], r["b"]) for r in streams.overlapping(regions, 0.1).collect()) == want
    assert streams.overlapping(regions.where("false"), 0.1).collect() == []
