"""Fixtures with known answers."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import names, scalars
from pointloom.operators import bins, clusters, geometry, ranging, rowops, spatial, stats
from pointloom.plans import spec
from pointloom.points import Vec
from pointloom.sources import points_files, range_files, sinks
from pointloom.streaming import monitor

POINT = "point_id long, x double, y double, z double, value double"


def table(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], POINT)


def lattice(spark, n=1000, size=10):
    return table(spark, [(i % size, i // size % size, i // size**2 % size, i) for i in range(n)])


RANGES = ranging.RangeTable((ranging.Ion("A", "Alpha"), ranging.Ion("B", "Beta")), (ranging.Range(0, 9.5, 0), ranging.Range(20, 33.5, 1)))


def test_ranges_split_values(spark):
    df = table(spark, [(1, 1, 1, v) for v in range(100)])
    got = {r["ion"]: r["n"] for r in ranging.composition(df, RANGES).collect()}
    assert got == {"A": 10, "B": 14, "unranged": 76}
    assert {r["ion"]: r["count"] for r in ranging._joined(df, RANGES).groupBy("ion").count().collect()} == {"A": 10, "B": 14, None: 76}


def test_long_dictionaries_keep_repeated_rows(spark):
    """Over ``CASES`` ranges, touching ones among them: as many rows as came, and the ranges of the expression."""
    n = ranging.CASES + 40
    ions = (ranging.Ion("A", "Alpha"), ranging.Ion("B", "Beta"))
    long = ranging.RangeTable(ions, tuple(ranging.Range(k, k + (1 if k % 3 else 0.5), k % 2) for k in range(n))).checked()
    values = [0.25, 0.25, 0.25, 0.75, 2.0, 2.0, 3.0, 239.0, 240.5, -1.0, -1.0, None, None, float("nan"), float("nan")] + [k / 4 for k in range(-8, 4 * n + 8)]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, v) for v in values], "x double, y double, z double, value double")
    got = ranging.ranged(df, long)
    index = ranging.range_column(long)
    want = df.select("*", index.alias("range_id")).withColumn("ion", F.when(F.col("range_id") % 2 == 0, "A").when(F.col("range_id") % 2 == 1, "B"))
    assert got.columns == want.columns and got.count() == len(values)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert sum(r["n"] for r in ranging.composition(df, long).collect()) == len(values)


def test_range_table_edits():
    t = RANGES.add_ion("C", "Gamma").add_range(40, 50, 2)
    assert t.find_ion("C") == 2 and t.erase_ion(0).ranges[0].ion == 0
    with pytest.raises(ValueError):
        t.add_range(45, 55, 2)
    with pytest.raises(ValueError):
        t.move_range(2, low=60)
    assert t.move_range(2, 60, 70).ranges[2].low == 60
    assert t.rename(0, short="Z").ions[0].short == "Z" and len(t.erase_range(0).ranges) == 2
    assert ranging.overlaps((0, 2), (1, 3)) and not ranging.overlaps((0, 1), (1, 2))


def test_spectrum_counts_everything(spark):
    df = lattice(spark, 100)
    assert bins.auto_spectrum(df, 1.0).agg(F.sum("n")).first()[0] == 100
    assert bins.spectrum(df, 0, 0.5, 1.0).count() == 10


@pytest.mark.parametrize("invert", [False, True])
def test_clip(spark, invert):
    c, df = Vec(5, 5, 5), lattice(spark)
    for cond, inside in (
        (rowops.in_sphere(c, 3), lambda p: math.dist(p, c) < 3),
        (rowops.in_front(c, Vec(1, 0, 0)), lambda p: p[0] > 5),
        (rowops.in_cylinder(c, Vec(0, 0, 6), 2), lambda p: abs(p[2] - 5) < 3 and math.dist(p[:2], (5, 5)) < 2),
        (rowops.in_box(c, Vec(2, 2, 2)), lambda p: all(3 < q < 7 for q in p)),
    ):
        got = {r["point_id"] for r in rowops.clip(df, cond, invert).collect()}
        assert got == {r["point_id"] for r in df.collect() if inside((r["x"], r["y"], r["z"])) != invert}


def test_samples(spark):
    df = lattice(spark)
    assert rowops.sample_count(df, 100, 1).count() == 100
    assert 0 < rowops.sample_fraction(df, 0.1, 1).count() < 1000
    assert rowops.throttle(df, 5000, 1).count() == 1000
    back = rowops.shuffle_values(df, 5)
    assert sorted(r["value"] for r in back.collect()) == [float(i) for i in range(1000)]
    assert back.join(df.select("point_id", F.col("value").alias("old")), "point_id").where("value <> old").count() > 900


def test_colour_buckets(spark):
    df = table(spark, [(0, 0, 0, 100 * i / 1000) for i in range(1000)])
    assert rowops.colour_bucket(df, 100, 0, 100).select("bucket").distinct().count() == 99
    for name in rowops.COLOUR_MAPS:
        low, high = rowops.colour(df, name, 0, 100).agg(F.least(F.min("r"), F.min("g"), F.min("b")), F.greatest(F.max("r"), F.max("g"), F.max("b"))).first()
        assert low >= 0 and high <= 1


def test_density_and_neighbours(spark):
    pair = table(spark, [(0, 0, 0, 1), (0, 0, 1, 1)])
    want = 1 / (4 / 3 * math.pi)
    assert [r["density"] for r in spatial.local_density(pair, k=1).collect()] == pytest.approx([want, want])
    assert spatial.knn_join(pair, pair, 3).count() == 2
    assert spatial.radial_distribution(pair, pair, 2, 4).agg(F.sum("n")).first()[0] == 2
    assert spatial.knn_join(pair.limit(0), pair, 1).count() == 0


def test_local_concentration(spark):
    df = table(spark, [(0, 0, 0, 1), (0.49, 0, 0, 2), (0, 0.5, 0, 3), (0, 0, 0.51, 3)])
    src = df.where("value = 1")
    pairs = spatial.radius_join(src, df, 0.6, target_columns=("value",))
    got = spatial.local_concentration(pairs, src, F.col("t_value") == 2, F.col("t_value") == 3).first()["concentration"]
    assert got == pytest.approx(100 / 3)


def test_clusters(spark):
    rows = [(k, 0, 0, 1) for k in range(5)] + [(k, 9, 0, 1) for k in range(3)] + [(0.5, 0.4, 0, 2), (20, 20, 20, 2)]
    df = table(spark, rows)
    got = clusters.cluster(df.where("value = 1"), df.where("value = 2"), 1.1, None, 0.8)
    sizes = sorted(r["n"] for r in got.groupBy("cluster_id").agg(F.count("*").alias("n")).collect())
    assert sizes == [3, 6]
    assert clusters.cluster(df.where("value = 1"), None, 1.1, (1, 1.1), None, None, 4).count() == 5


def test_ellipsoid_axes(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-1, 1, (30000, 3))
    p = p[(p**2).sum(1) < 1] * [3, 1, 2]
    df = table(spark, [(*r, 1) for r in p.tolist()])
    got = clusters.morphology(df, df.select("point_id", F.lit(0).alias("cluster_id"))).first()
    assert [got["axis1"], got["axis2"], got["axis3"]] == pytest.approx([3, 2, 1], abs=0.1)


def test_volumes(spark):
    box = table(spark, [(7 * (k & 1), 7 * (k >> 1 & 1), 7 * (k >> 2), 1) for k in range(8)] + [(3, 3, 3, 1)])
    assert geometry.convex_volume(box) == pytest.approx(343) and geometry.box_volume(box) == pytest.approx(343)
    ball = [(7 * math.sin(a) * math.cos(b), 7 * math.sin(a) * math.sin(b), 7 * math.cos(a), 1) for a in np.linspace(0, math.pi, 40) for b in np.linspace(0, 2 * math.pi, 60)]
    assert geometry.convex_volume(table(spark, ball)) == pytest.approx(4 / 3 * math.pi * 343, rel=0.05)
    assert geometry.inside_shrunken(box, 2).count() == 1


def test_isosurface_closes(spark):
    grid = spark.createDataFrame([(1, 1, 1, 1.0)], "ix int, iy int, iz int, v double")
    t = np.array([list(r) for r in geometry.isosurface(grid, (4, 4, 4), 0.5).collect()]).reshape(-1, 3, 3)
    edges = {}
    for tri in np.round(t, 9).tolist():
        for a, b in ((0, 1), (1, 2), (2, 0)):
            e = tuple(sorted((tuple(tri[a]), tuple(tri[b]))))
            edges[e] = edges.get(e, 0) + 1
    assert len(t) >= 8 and set(edges.values()) == {2}


def test_surface_distance_is_exact(spark):
    """Against dense samples of each triangle; points on sides and inside triangles have distance 0."""
    grid = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 1, 0.8)], "ix int, iy int, iz int, v double")
    low, edge, most = Vec(-1, 2, 3), 5.0, 2.5
    tri = np.array([list(r) for r in geometry.isosurface(grid, (4, 4, 4), 0.5).collect()]).reshape(-1, 3, 3)
    tri = (tri + 0.5) * edge + np.array([low.x, low.y, low.z])
    rng = np.random.default_rng(4)
    on = np.concatenate([tri[:, [0, 1]].mean(1), tri[:, [1, 2]].mean(1), tri[:, [0, 2]].mean(1), (tri * np.array([0.2, 0.5, 0.3])[None, :, None]).sum(1)])
    points = np.concatenate([on, rng.uniform(tri.min((0, 1)) - 3, tri.max((0, 1)) + 3, (300, 3))])
    weights = np.array([(a, b, 60 - a - b) for a in range(61) for b in range(61 - a)]) / 60
    samples = np.einsum("wk,tkc->twc", weights, tri).reshape(-1, 3)
    near = np.array([np.sqrt(((samples - p) ** 2).sum(1).min()) for p in points])
    df = table(spark, [(*p, 0) for p in points])
    got = {r["point_id"]: abs(r["distance"]) for r in geometry.surface_distance(df, grid, (4, 4, 4), 0.5, low, edge, most).collect()}
    assert all(got[k] < 1e-6 for k in range(len(on)))
    assert all(k in got for k in range(len(points)) if near[k] < most)
    assert all(near[k] - 0.15 < d < min(near[k] + 1e-9, most) for k, d in got.items())


def test_statistics(spark):
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert sum(p for _, p in stats.binomial_curve(0.3, 20)) == pytest.approx(1)
    rng = np.random.default_rng(2)
    assert stats.anderson_darling(rng.normal(size=200).tolist())[2] < 1.5
    df = table(spark, [(0, 0, 0, v * v) for v in rng.uniform(0, 10, 20000).tolist()])
    assert stats.background_fit(df, 1, 81, 0.1) == pytest.approx(200, rel=0.1)
    with pytest.raises(stats.FitError):
        stats.background_fit(df, 1, 1.1, 0.1)
    blocks = rng.binomial(100, 0.7, 500)
    hist = sorted(zip(*np.unique(blocks, return_counts=True), strict=True))
    assert stats.binomial_test([(int(k), int(n)) for k, n in hist], 100)["p"] > 1e-3


def test_point_files(spark, tmp_path):
    rows = [(float(i), float(i), float(i), float(i)) for i in range(133)]
    path = f"file://{tmp_path}/a.pos"
    sinks.write_pos(table(spark, rows).coalesce(1), path)
    assert (tmp_path / "a.pos").stat().st_size == 133 * 16
    assert sorted(map(tuple, points_files.read_pos(spark, path).collect())) == rows
    (tmp_path / "bad.pos").write_bytes(b"123")
    with pytest.raises(ValueError):
        points_files.read_pos(spark, f"file://{tmp_path}/bad.pos")
    (tmp_path / "a.txt").write_text("x y z m\n1 2 3 4\n2 1 3 5\n3 2 1 6\n")
    assert points_files.read_text(spark, f"file://{tmp_path}/a.txt").count() == 3
    (tmp_path / "a.ato").write_bytes(struct.pack("<II", 0, 3) + b"".join(struct.pack("<14f", k, k, k, k, *[0] * 10) for k in range(5)))
    assert points_files.read_ato(spark, f"file://{tmp_path}/a.ato").agg(F.sum("value")).first()[0] == 10
    (tmp_path / "v.raw").write_bytes(np.arange(8, dtype="<f4").tobytes())
    cells = points_files.read_voxels(spark, f"file://{tmp_path}/v.raw", (2, 2, 2))
    assert {(r["ix"], r["iy"], r["iz"]): r["v"] for r in cells.collect()}[(1, 0, 1)] == 5
    assert sinks.voxel_bytes(cells, (2, 2, 2)) == np.arange(8, dtype="<f4").tobytes()
    sinks.write_points_vtk(table(spark, rows), f"file://{tmp_path}/p.vtk")
    sinks.write_voxels_vtk(cells, (2, 2, 2), f"file://{tmp_path}/v.vtk")
    sinks.write_text(table(spark, rows), f"file://{tmp_path}/p.txt")
    assert points_files.read_text(spark, f"file://{tmp_path}/p.txt").count() == 133


@pytest.mark.parametrize("kind", ["rng", "env", "rrng"])
def test_range_files_round_trip(kind):
    text = range_files.render(RANGES, kind)
    found, back = range_files.parse(text)
    assert found == kind
    assert [(r.low, r.high, back.ions[r.ion].short) for r in back.ranges] == [(0, 9.5, "A"), (20, 33.5, "B")]


def test_names():
    assert names.decompose("Al2O3") == [("Al", 2), ("O", 3)] and names.compose([("Al", 2), ("O", 1)]) == "Al2O"
    assert names.decompose("al2") == []
    iron = [("Fe", 53.94, 0.0585), ("Fe", 55.93, 0.9175), ("Fe", 56.94, 0.0212), ("Fe", 57.93, 0.0028)]
    got = names.isotope_pattern(iron, [("Fe", 1)], 2)
    assert len(got) == 4 and sum(a for _, a in got) == pytest.approx(1)


def test_decomposed_column(spark):
    got = spark.createDataFrame([("Al2O3",), ("CHC2",)], "n string").select(names.decomposed(F.col("n")).alias("m")).collect()
    assert [r["m"] for r in got] == [{"Al": 2, "O": 3}, {"C": 3, "H": 1}]


def test_specs(spark, small):
    table_ = {"ions": [["A", "Alpha"]], "ranges": [[1, 10, 0]]}
    tree = spec.Node("events", {}, (spec.Node("clip_sphere", {"centre": [20, 25, 25], "radius": 15}, (spec.Node("composition", {"table": table_}), spec.Node("spectrum", {"low": 0, "high": 100, "width": 1}))),))
    again = spec.load(spec.save(tree))
    got = spec.run(spark, small, again)
    assert len(got) == 2 and all(df.count() > 0 for df in got.values())
    assert spec.lint(tree) == []
    bad = spec.Node("events", {}, (spec.Node("sample", {"fraction": 0.5}, (spec.Node("density", {"k": 1}),)), spec.Node("cluster", {"core": ["A"], "link": 1})))
    assert len(spec.lint(bad)) == 2
    assert [n.children[0].params["radius"] for n in spec.sweep(tree, "/events/0:clip_sphere", "radius", [1, 2])] == [1, 2]
    assert spec.frames([(0, 1.0), (10, 3.0)])(5) == 2.0 and spec.frames([(10, 3.0), (0, 1.0)], "step")(5) == 1.0


def test_monitor(spark, tmp_path):
    src = f"{tmp_path}/in"
    lattice(spark, 100).write.parquet(src)
    work = lambda df: df.groupBy("x").count()
    for n in (100, 200):
        monitor.recompute(monitor.watch(spark, src), work, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == n
        lattice(spark, 100).write.mode("append").parquet(src)


@pytest.fixture
def small_blocks(monkeypatch):
    """Cells are dealt to blocks, which differ from the default only in size."""
    from pointloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "ROWS", 50)
    monkeypatch.setattr(blocks, "PAIRS", 64)


def _crowd(n=300, seed=5):
    rng = np.random.default_rng(seed)
    return np.concatenate((rng.normal(0, 0.3, (n, 3)), rng.uniform(-9, 9, (n // 2, 3)), [[0.5, 0.5, 0.5]] * 5, [[60.0, -70.0, 80.0]]))


@pytest.mark.parametrize("radius", [0.25, 1.5])
def test_near_pairs_of_blocks(spark, small_blocks, radius):
    at = _crowd()
    df = table(spark, [(*p, 0) for p in at])
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(d2 < radius * radius), strict=True) if i != j}
    got = [(r["s_point_id"], r["t_point_id"]) for r in spatial.radius_join(df, df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r["point_id"]: r["n"] for r in spatial.neighbour_counts(df, df, radius).collect()}
    assert counts == {int(i): sum(a == i for a, _ in want) for i in {a for a, _ in want}}
    groups = {r["point_id"]: r["cluster_id"] for r in clusters.link(df, radius).collect()}
    name = list(range(len(at)))
    for _ in at:
        for i, j in want:
            name[i] = name[j] = min(name[i], name[j])
    assert groups == dict(enumerate(name))


@pytest.mark.parametrize("beyond", [None, 0.4])
def test_nearest_of_blocks(spark, small_blocks, beyond):
    at = _crowd(120)
    df = table(spark, [(*p, 0) for p in at])
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    want = {}
    for i in range(len(at)):
        far = [j for j in range(len(at)) if j != i and (beyond is None or d2[i, j] > beyond * beyond)]
        want[i] = sorted(far, key=lambda j, i=i: (d2[i, j], j))[:4]
    got = {}
    for r in sorted(spatial.knn_join(df, df, 4, beyond=beyond).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["s_point_id"], []).append(r["t_point_id"])
    assert got == want


def test_a_crowded_cell_and_points_without_place(spark):
    """20,000 points of one cell are counted without a row for each pair; a null or NaN is near nothing."""
    df = spark.range(20_000).select(F.col("id").alias("point_id"), (F.col("id") % 7 * 0.01).alias("x"), (F.col("id") % 11 * 0.01).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("value"))
    odd = spark.createDataFrame([(None, 0.0, 0.0, 0.0, 1.0), (-1, None, 0.0, 0.0, 1.0), (-2, float("nan"), 0.0, 0.0, 1.0)], POINT)
    got = spatial.neighbour_counts(df.unionByName(odd), df, 1.0)
    assert got.agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (20_000, 19_999, 19_999)
    assert spatial.radius_join(df.limit(0), df, 1.0).count() == 0
    same = spatial.radius_join(df.where("point_id < 77"), df.where("point_id < 154"), 0.0, inclusive=True)
    assert same.count() == 77


def test_axial_neighbours(spark):
    df = table(spark, [(0, 0, 0, 0), (0, 0, 1, 0), (3, 0, 1, 0)])
    got = {(r["rank"], r["bin"]): r["n"] for r in spatial.axial_neighbours(df, df, Vec(0, 0, 2), 2, 4).collect()}
    assert got == {(1, 3): 2, (1, 0): 1, (2, 3): 2, (2, 0): 1}


def test_flat_hulls_stay_small():
    rng = np.random.default_rng(1)
    plane = np.column_stack((rng.uniform(0, 4, (3000, 2)), np.zeros(3000)))
    square = np.array([[0, 0, 0], [4, 0, 0], [4, 4, 0], [0, 4, 0]], float)
    tilt = np.array([[0.6, 0.0, 0.8], [0.0, 1.0, 0.0], [-0.8, 0.0, 0.6]])
    found = geometry.extremes(np.concatenate((plane, square)) @ tilt.T)
    assert len(found) == 4 and np.allclose(np.sort(found, 0), np.sort(square @ tilt.T, 0))
    line = np.outer(rng.uniform(0, 1, 500), [1.0, 2.0, 3.0])
    assert len(geometry.extremes(line)) == 2 and len(geometry.extremes(np.ones((9, 3)))) == 1 and len(geometry.extremes(np.zeros((0, 3)))) == 0


def test_volume_centre_is_not_the_mean_of_corners(spark):
    """A box with many corners at one end keeps its centre."""
    box = [(x, y, z) for x in (0, 8) for y in (0, 2) for z in (0, 2)]
    ring = [(0, 1 + math.cos(t / 5) , 1 + math.sin(t / 5)) for t in range(31)]
    at = np.array(box + ring, float)
    centre = geometry.volume_centre(at, geometry.hull(at))
    assert np.allclose(centre, (4, 1, 1))
    df = table(spark, [(*p, 0) for p in [*box, (0.5, 1, 1), (7.5, 1, 1), (4, 1, 1), (1.95, 1, 1), (6.05, 1, 1)]])
    got = {(r["x"]) for r in geometry.inside_shrunken(df, 0.5).collect()}
    assert got == {4.0}.union({x for x in (0.5, 7.5, 1.95, 6.05) if 2 < x < 6})


def test_cell_triangles_close_a_corner():
    """One high corner gives a closed cap around it: every cut edge of the cube's tetrahedra once."""
    for corner in range(8):
        values = np.zeros((1, 8))
        values[0, corner] = 1.0
        tri = geometry.cell_triangles(np.zeros((1, 3)), values, 0.25).reshape(-1, 3, 3)
        unit = np.array([corner & 1, corner >> 1 & 1, corner >> 2], float)
        assert np.allclose(np.abs(tri - unit).max((1, 2)).max(), 0.75)
        full = np.ones((1, 8)) - values
        assert len(geometry.cell_triangles(np.zeros((1, 3)), full, 0.75)) == len(tri)


def test_scans(spark, tmp_path):
    rows = [(float(i), i + 0.5, 2.0 * i, 7.0) for i in range(40)]
    sinks.write_pos(table(spark, rows), f"file://{tmp_path}/a.pos")
    (tmp_path / "b.txt").write_text("x y z v\n" + "\n".join(" ".join(map(str, r)) for r in rows))
    (tmp_path / "bad.txt").write_text("x y z v\n1 2 3 4\n1 two 3 4\n")
    scan = points_files.scan
    assert sorted(map(tuple, scan(spark, f"file://{tmp_path}/a.pos").collect())) == rows
    both = scan(spark, f"file://{tmp_path}/b.txt", limit=5, label="t", upstream=scan(spark, f"file://{tmp_path}/a.pos"))
    assert both.count() == 45 and both.where("label = 't'").count() == 5
    up = scan(spark, f"file://{tmp_path}/a.pos", limit=None)
    assert scan(spark, f"file://{tmp_path}/none.pos", monitored=True, upstream=up).count() == 40
    assert scan(spark, f"file://{tmp_path}/a.pos", enabled=False).count() == 0
    with pytest.raises(Exception, match="not a row of 4 numbers"):
        points_files.read_text(spark, f"file://{tmp_path}/bad.txt").collect()
    with pytest.raises(ValueError, match="kind"):
        scan(spark, f"file://{tmp_path}/a.unknown")
    before = points_files.stamp(spark, f"file://{tmp_path}/b.txt")
    (tmp_path / "b.txt").write_text("1 2 3 4\n")
    assert points_files.stamp(spark, f"file://{tmp_path}/b.txt") != before and points_files.stamp(spark, f"file://{tmp_path}/none") is None


def test_scalars(spark):
    df = spark.createDataFrame([("#0aFF10", "#00000080", " a;b,, c ", "1.10", "1.9", "/x/y.tar.gz", "TRUE", "<a & 'b'>")], "c string, d string, s string, v string, w string, f string, b string, x string")
    one, two = scalars.colour_bytes(F.col("c")), scalars.colour_bytes(F.col("d"))
    r = df.select(
        one.alias("one"), two.alias("two"), scalars.colour_bytes(F.col("s")).alias("no"), scalars.between_colours(one, two, F.lit(0.5)).alias("mid"), scalars.fields(scalars.stripped(F.col("s")), ";,").alias("parts"), scalars.later_version(F.col("v"), F.col("w")).alias("later"),
        scalars.later_version(F.lit("2"), F.lit("2.0")).alias("same"), scalars.file_name(F.col("f")).alias("name"), scalars.folder(F.col("f")).alias("folder"), scalars.extension(F.col("f")).alias("ext"), scalars.flag(F.col("b")).alias("flag"), scalars.flag(F.col("s")).alias("none"),
        scalars.xml_escaped(F.col("x")).alias("xml"), scalars.xml_unescaped(scalars.xml_escaped(F.col("x"))).alias("back"), scalars.padded(F.lit(7), 3).alias("p"), scalars.to_byte(F.lit(0.5)).alias("byte"),
    ).first()
    assert tuple(r["one"]) == (10, 255, 16, 255) and tuple(r["two"]) == (0, 0, 0, 128) and r["no"] is None and tuple(r["mid"]) == (5, 128, 8, 192)
    assert r["parts"] == ["a", "b", " c"] and (r["later"], r["same"]) == (1, 0) and (r["name"], r["folder"], r["ext"]) == ("y.tar.gz", "/x", "gz")
    assert r["flag"] is True and r["none"] is None and r["xml"] == "&lt;a &amp; &apos;b&apos;&gt;" and r["back"] == "<a & 'b'>" and (r["p"], r["byte"]) == ("007", 128)


def test_frames_and_selections_are_written(spark, small, tmp_path):
    from pointloom.plans import export

    node = spec.load('{"op": "events", "children": [{"op": "crop_value", "params": {"low": 0, "high": 1}, "children": [{"op": "spectrum", "params": {"low": 0, "high": 10, "width": 1}}]}]}')
    high = spec.frames([(0, 2.0), (4, 6.0)])
    places = export.export_frames(spark, small, node, [("/events/0:crop_value", "high", high)], [0, 2], f"file://{tmp_path}/out")
    total = lambda frame: sum(r["n"] for p in places[frame].values() for r in spark.read.parquet(p).collect())
    events = spark.read.parquet(f"{small}/events.parquet")
    for frame, most in ((0, 2.0), (2, 4.0)):
        assert total(frame) == events.where((F.col("value") / 5 >= 0) & (F.col("value") / 5 < most)).count()
    tables = spec.run(spark, small, node)
    with pytest.raises(ValueError, match="no such"):
        export.export(tables, f"file://{tmp_path}/other", selected=["nothing"])
    assert len(export.export(tables, f"file://{tmp_path}/other", "plot")) == 1


def test_results_of_a_program_and_watched_files(spark, tmp_path):
    sinks.write_pos(table(spark, [(1, 2, 3, 4)]), f"file://{tmp_path}/one.pos")
    (tmp_path / "none.pos").write_bytes(b"")
    (tmp_path / "p.xy").write_text("x a b\n1 2 3\n2 4 5\n")
    got = points_files.scan_results(spark, f"file://{tmp_path}")
    assert sorted(got) == ["one.pos", "p.xy"] and got["one.pos"].count() == 1
    assert sorted(map(tuple, got["p.xy"].collect())) == [(0, 1.0, 2.0), (0, 2.0, 4.0), (1, 1.0, 3.0), (1, 2.0, 5.0)]
    assert points_files.scan_results(spark, f"file://{tmp_path}/absent") == {}
    file = monitor.Watched(spark, f"file://{tmp_path}/w.txt")
    assert [file.current()[1], file.current()[1]] == [True, False] and file.current()[0].count() == 0
    (tmp_path / "w.txt").write_text("1 2 3 4\n2 3 4 5\n")
    df, fresh = file.current()
    assert fresh and df.count() == 2 and not file.current()[1]
    (tmp_path / "w.txt").unlink()
    assert file.current()[0].count() == 0


def test_deviation_of_several_series(spark):
    plot = spark.createDataFrame([(s, b, (b + 1) * (10 if s == "p" else 1)) for s in "pq" for b in range(6)], "series string, bin int, n long")
    both = {(r["series"], r["bin"]): (r["mean"], r["err"]) for r in bins.moving_deviation(plot, by=("series",)).collect()}
    for s in "pq":
        alone = bins.moving_deviation(plot.where(F.col("series") == s)).collect()
        assert {(s, r["bin"]): (r["mean"], r["err"]) for r in alone} == {k: v for k, v in both.items() if k[0] == s}
