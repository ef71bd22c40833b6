"""Nearest targets that lie far from the sources."""

import numpy as np
import pytest

from pointloom.operators import blocks, spatial


def frame(spark, ids, at):
    return spark.createDataFrame([(int(i), *map(float, p), 0.0) for i, p in zip(ids, at, strict=True)], "point_id long, x double, y double, z double, value double")


@pytest.mark.parametrize(("k", "beyond"), [(1, None), (2, None), (5, None), (1, 12.0), (10, 11.0)])
def test_far_targets_need_no_round(spark, monkeypatch, k, beyond):
    """F1 to F4: rounds of growing radius met all targets once the radius reached them."""
    rng = np.random.default_rng(k)
    s, t = rng.random((300, 3)) * 3, np.round(rng.random((2000, 3)) * 4, 1) + [10, 0, 0]
    if beyond is None:  # a dead zone is a first radius, which may reach
        monkeypatch.setattr(blocks, "meet", lambda *a, **b: pytest.fail("a round by radius"))
    ids = rng.permutation(len(t)) + 200  # some keys of sources are keys of targets
    found = spatial.knn_join(frame(spark, range(len(s)), s), frame(spark, ids, t), k, beyond=beyond).collect()
    d2 = sum((s[:, None, c] - t[None, :, c]) ** 2 for c in range(3))
    d2[np.arange(len(s))[:, None] == ids] = np.inf
    if beyond is not None:
        d2[d2 <= beyond * beyond] = np.inf
    want = {}
    for i, row in enumerate(d2):
        for rank, j in enumerate(np.lexsort((ids, row))[:k]):
            if row[j] < np.inf:
                want[i, rank + 1] = (int(ids[j]), row[j])
    assert {(r["s_point_id"], r["rank"]): (r["t_point_id"], r["d2"]) for r in found} == want


def test_parts_of_a_block_agree(spark, monkeypatch):
    from pointloom.operators import far

    rng = np.random.default_rng(3)
    s, t = frame(spark, range(50), rng.random((50, 3))), frame(spark, range(100, 600), rng.random((500, 3)) + [9, 0, 0])
    row = lambda df: sorted((r["s_point_id"], r["rank"], r["t_point_id"], r["d2"]) for r in df.collect())
    whole = row(spatial.knn_join(s, t, 3))
    monkeypatch.setattr(far, "PART", 64)
    assert row(spatial.knn_join(s, t, 3)) == whole and len(whole) == 150


def test_groups_keep_few_targets():
    """bounds by spheres kept some 4,000 targets for each source of a flat gap, bounds by boxes keep a third."""
    from pointloom.operators import far

    rng = np.random.default_rng(5)
    at = np.concatenate((rng.random((4096, 3)) * [4, 5, 5], rng.random((20000, 3)) * [3, 12, 12] + [9, -3.5, -3.5]))
    groups = list(far._groups(at, np.arange(4096), np.arange(4096, 24096), 3, -1.0))
    assert sorted(np.concatenate([g for g, *_ in groups])) == list(range(4096))
    assert sum(len(g) * len(some) for g, some, _ in groups) < 2000 * 4096
    for group, some, _ in groups[:5]:
        d2 = ((at[group, None] - at[None, 4096:]) ** 2).sum(2)
        assert set(4096 + np.argsort(d2, 1)[:, :3].ravel()) <= set(some)


def test_blocks_take_columns_of_any_kind(spark):
    """points travel as arrays, with further columns of their own types."""
    from pyspark.sql import functions as F

    s = frame(spark, range(40), np.random.default_rng(1).random((40, 3))).withColumn("tag", F.expr("array(cast(point_id as string), null)"))
    t = frame(spark, range(100, 400), np.random.default_rng(2).random((300, 3)) + [9, 0, 0]).withColumn("ion", F.expr("if(point_id % 3 = 0, null, concat('i', point_id))"))
    rows = spatial.knn_join(s, t, 2, source_columns=("tag", "x"), target_columns=("ion", "z")).collect()
    assert len(rows) == 80 and {r["s_point_id"]: r["s_x"] for r in rows} == {r["point_id"]: r["x"] for r in s.collect()}
    places = {r["point_id"]: r["z"] for r in t.collect()}
    for r in rows:
        assert r["s_tag"] == [str(r["s_point_id"]), None] and r["t_z"] == places[r["t_point_id"]]
        assert r["t_ion"] == (None if r["t_point_id"] % 3 == 0 else f"i{r['t_point_id']}")


def test_few_sources_inside_need_no_round(spark, monkeypatch):
    """some sources amid the targets caused a round that could not serve half of all."""
    rng = np.random.default_rng(8)
    s, t = np.concatenate((rng.random((200, 3)) * 3, rng.random((40, 3)) + 8)), rng.random((500, 3)) * 4 + [7, 7, 7]
    monkeypatch.setattr(blocks, "meet", lambda *a, **b: pytest.fail("a round by radius"))
    found = spatial.knn_join(frame(spark, range(len(s)), s), frame(spark, np.arange(len(t)) + 1000, t), 3, source_columns=(), target_columns=("value",)).collect()
    d2 = sum((s[:, None, c] - t[None, :, c]) ** 2 for c in range(3))
    order = np.argsort(d2, 1)[:, :3]
    want = {(i, r + 1): (1000 + j, d2[i, j]) for i, row in enumerate(order) for r, j in enumerate(row)}
    assert {(r["s_point_id"], r["rank"]): (r["t_point_id"], r["d2"]) for r in found} == want


def test_groups_leave_out_the_dead_zone():
    """targets within the dead zone of all sources of a group stayed among its candidates."""
    from pointloom.operators import far

    rng = np.random.default_rng(6)
    at = np.concatenate((rng.random((256, 3)), rng.random((3000, 3)), rng.random((50, 3)) + [9, 0, 0]))
    groups = list(far._groups(at, np.arange(256), np.arange(256, 3306), 2, 2.0))
    assert sorted(np.concatenate([g for g, *_ in groups])) == list(range(256))
    assert all(some.min() >= 3256 for _, some, _ in groups)
    for group, some, _ in groups:
        d2 = ((at[group, None] - at[None, 3256:]) ** 2).sum(2)
        assert set(3256 + np.argmin(d2, 1)) <= set(some)
