"""Registered queries and their SQL, by inventory id."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointloom import points as pt
from pointloom.functions import scalars
from pointloom.operators import bins, clusters, geometry, ranging, rowops, spatial, stats, streams
from pointloom.points import Vec
from pointloom.scratch import cut

TABLE = ranging.RangeTable(
    (ranging.Ion("A", "Alpha", (1, 0, 0)), ranging.Ion("B", "Beta", (0, 1, 0)), ranging.Ion("C", "Gamma", (0, 0, 1))),
    (ranging.Range(1, 10, 0), ranging.Range(20, 35, 1), ranging.Range(50, 60, 0), ranging.Range(80, 95, 2)),
).checked()
OFF = ranging.RangeTable(TABLE.ions, (*TABLE.ranges[:3], ranging.Range(80, 95, 2, False)))
CENTRE, AXIS, NORMAL = Vec(20, 25, 25), Vec(0, 30, 0), Vec(1, 2, -1)
LOW, HIGH = Vec(0, 0, 0), Vec(50, 52, 50)
SHAPE = (10, 10, 10)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RANGE_ID = "CASE WHEN value BETWEEN 1 AND 10 THEN 0 WHEN value BETWEEN 20 AND 35 THEN 1 WHEN value BETWEEN 50 AND 60 THEN 2 WHEN value BETWEEN 80 AND 95 THEN 3 END"
ION = "CASE WHEN value BETWEEN 1 AND 10 THEN 'A' WHEN value BETWEEN 20 AND 35 THEN 'B' WHEN value BETWEEN 50 AND 60 THEN 'A' WHEN value BETWEEN 80 AND 95 THEN 'C' END"
WITH_E = f"WITH p AS ({pt.EVENTS_SQL}), r AS (SELECT *, {ION} AS ion, {RANGE_ID} AS range_id FROM p)"
WITH_L = f"WITH p AS ({pt.LINEITEM_SQL}), r AS (SELECT *, {ION} AS ion, {RANGE_ID} AS range_id FROM p)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *names: str):
    """Doubles to six places; a negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


def events(spark, d):
    return pt.event_points(spark, d)


def lines(spark, d):
    return pt.lineitem_points(spark, d)


def xyz(df):
    return rounded(df.select("point_id", "x", "y", "z"), "x", "y", "z")


XYZ = "SELECT point_id, round({x}, 6) + 0.0 AS x, round({y}, 6) + 0.0 AS y, round({z}, 6) + 0.0 AS z FROM p"

# --- ranging -----------------------------------------------------------------

query("j1_ranging", f"{WITH_E} SELECT point_id, range_id, ion FROM r")(lambda s, d: ranging.ranged(events(s, d), TABLE).select("point_id", "range_id", "ion"))
query(
    "j1_a6_composition",
    f"{WITH_L}, c AS (SELECT coalesce(ion, 'unranged') AS ion, count(*) AS n FROM r GROUP BY 1) SELECT ion, n, round(n / sum(n) OVER (), 6) AS fraction, CASE WHEN ion <> 'unranged' THEN round(n / sum(CASE WHEN ion <> 'unranged' THEN n END) OVER (), 6) END AS ranged_fraction FROM c",
)(lambda s, d: rounded(ranging.composition(lines(s, d), TABLE), "fraction", "ranged_fraction"))
query("f12_range_filter", f"{WITH_E} SELECT point_id, range_id FROM r WHERE range_id IN (0, 1, 2)")(lambda s, d: ranging.keep_ranged(events(s, d), OFF).select("point_id", "range_id"))
query("f12_keep_unranged", f"{WITH_E} SELECT point_id, range_id FROM r WHERE range_id IN (0, 1, 2) OR range_id IS NULL")(lambda s, d: ranging.keep_ranged(events(s, d), OFF, False).select("point_id", "range_id"))
query("f13_keep_ranged", f"{WITH_L} SELECT range_id, count(*) AS n FROM r WHERE range_id IS NOT NULL GROUP BY 1")(lambda s, d: ranging.keep_ranged(lines(s, d), TABLE).groupBy("range_id").agg(F.count("*").alias("n")))
query("f14_f16_keep_ions", f"{WITH_E} SELECT point_id, ion FROM r WHERE ion IN ('A', 'C')")(lambda s, d: ranging.keep_ions(events(s, d), TABLE, ["A", "C"]).select("point_id", "ion"))
query("f15_keep_range", f"{WITH_E} SELECT point_id FROM r WHERE value BETWEEN 20 AND 35")(lambda s, d: ranging.keep_range(events(s, d), TABLE, 1).select("point_id"))
_background = ", ".join(f"({k}, {2 * 3.0 * (r.high**0.5 - r.low**0.5)!r})" for k, r in enumerate(TABLE.ranges))
query(
    "a7_background_corrected",
    f"{WITH_L} SELECT range_id, count(*) AS n, round(greatest(count(*) - any_value(b.v), 0), 6) AS corrected FROM r JOIN (VALUES {_background}) b(k, v) ON range_id = k GROUP BY 1",
)(lambda s, d: rounded(ranging.background_corrected(ranging.ranged(lines(s, d), TABLE).where("range_id is not null").groupBy("range_id").agg(F.count("*").alias("n")), TABLE, 3.0).drop("background"), "corrected"))

# --- maps ---------------------------------------------------------------------

query("p1_translate", f"{WITH_E} " + XYZ.format(x="x - 20.0", y="y - 25.0", z="z - 25.0"))(lambda s, d: xyz(rowops.translate(events(s, d), CENTRE)))
query("p2_scale", f"{WITH_E} " + XYZ.format(x="(x - 20.0) * 1.5 + 20.0", y="(y - 25.0) * 1.5 + 25.0", z="(z - 25.0) * 1.5 + 25.0"))(lambda s, d: xyz(rowops.scale(events(s, d), 1.5, CENTRE)))
query("p3_scale_axes", f"{WITH_E} " + XYZ.format(x="(x - 20.0) * 2.0 + 20.0", y="(y - 25.0) * 0.5 + 25.0", z="(z - 25.0) * 3.0 + 25.0"))(lambda s, d: xyz(rowops.scale(events(s, d), Vec(2, 0.5, 3), CENTRE)))
_m = rowops.rotation(Vec(0, 0, 1), -30)
_turn = {a: " + ".join(f"({c} - {o!r}) * ({k!r})" for c, o, k in zip("xyz", map(float, CENTRE), row, strict=True)) + f" + {float(o0)!r}" for a, row, o0 in zip("xyz", _m, CENTRE, strict=True)}
query("p4_rotate", f"{WITH_E} " + XYZ.format(**_turn))(lambda s, d: xyz(rowops.rotate(events(s, d), Vec(0, 0, 1), 30, CENTRE)))
query("p5_translate_value", f"{WITH_E} SELECT point_id, round(value + 2.5, 6) AS value FROM p")(lambda s, d: rounded(rowops.translate_value(events(s, d), 2.5).select("point_id", "value"), "value"))
query("p6_value_shuffle", None)(lambda s, d: rowops.shuffle_values(events(s, d), 7))
query("p7_white_noise", None)(lambda s, d: rowops.noise(events(s, d), 0.5, 7))
query("p8_gaussian_noise", None)(lambda s, d: rowops.noise(events(s, d), 0.5, 7, True))
_both = lambda s, d, moved: events(s, d).select("point_id", *(F.col(a).alias(f"o{a}") for a in "xyz"), F.col("value").alias("o")).join(moved, "point_id", "full")
_shift = lambda a: F.col(a) - F.col(f"o{a}")
query("p6_values_stay", f"{WITH_E} SELECT round(value, 6) + 0.0 AS value, count(*) AS n FROM p GROUP BY 1")(lambda s, d: rounded(rowops.shuffle_values(events(s, d), 7).select("value"), "value").groupBy("value").agg(F.count("*").alias("n")))
query("p6_places_stay", f"{WITH_E} SELECT point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM p")(lambda s, d: xyz(rowops.shuffle_values(events(s, d), 7)))
query("p7_noise_bounds", f"{WITH_E} SELECT count(*) AS n, count(*) AS within, count(*) AS same, true AS spread FROM p")(
    lambda s, d: _both(s, d, rowops.noise(events(s, d), 0.5, 7)).agg(
        F.count("*").alias("n"), F.count(F.when(F.greatest(*(F.abs(_shift(a)) for a in "xyz")) <= 0.25 + 1e-9, 1)).alias("within"), F.count(F.when(F.col("value") == F.col("o"), 1)).alias("same"), (F.max(F.abs(_shift("x"))) > 0.2).alias("spread")
    )
)
query("p8_noise_moments", f"{WITH_E} SELECT count(*) AS n, count(*) AS same, true AS centred, true AS spread FROM p")(
    # five standard errors of the mean and of the deviation
    lambda s, d: _both(s, d, rowops.noise(events(s, d), 0.5, 7, True)).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("value") == F.col("o"), 1)).alias("same"), (F.abs(F.avg(_shift("y"))) < 2.5 / F.sqrt(F.count("*"))).alias("centred"), (F.abs(F.stddev(_shift("y")) - 0.5) < 2.5 / F.sqrt(F.count("*"))).alias("spread")
    )
)
query("p9_bounds_centre", f"{WITH_L} SELECT round((min(x) + max(x)) / 2, 6) AS x, round((min(y) + max(y)) / 2, 6) AS y, round((min(z) + max(z)) / 2, 6) AS z FROM p")(
    lambda s, d: rounded(lines(s, d).agg(*(((F.min(a) + F.max(a)) / 2).alias(a) for a in "xyz")), "x", "y", "z")
)
query("p10_a40_centroid", f"{WITH_L} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM p")(lambda s, d: rounded(rowops.centroid(lines(s, d)), "x", "y", "z"))
query("p10_stream_centroid", f"{WITH_L}, g AS (SELECT ion, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r GROUP BY 1) SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM g")(
    lambda s, d: rounded(rowops.stream_centroid(ranging.ranged(lines(s, d), TABLE), "ion"), "x", "y", "z")
)
query("p11_colour_bucket", f"{WITH_L} SELECT CAST(floor(least(greatest((value - 5) / 85.0, 0.0), 1.0) * 31) AS INT) AS bucket, count(*) AS n FROM p GROUP BY 1")(lambda s, d: rowops.colour_bucket(lines(s, d), 32, 5, 90).groupBy("bucket").agg(F.count("*").alias("n")))
query(
    "p12_colour_map",
    f"{WITH_E}, t AS (SELECT point_id, least(greatest(value / 100.0, 0.0), 1.0) AS t FROM p) SELECT point_id, round(least(t * 3, 1.0), 6) AS r, round(least(greatest(t * 3 - 1, 0.0), 1.0), 6) AS g, round(greatest(t * 3 - 2, 0.0), 6) AS b FROM t",
)(lambda s, d: rounded(rowops.colour(events(s, d), "hot", 0, 100).select("point_id", "r", "g", "b"), "r", "g", "b"))

# --- predicates and samples -----------------------------------------------------

SPHERE = "(x - 20.0) * (x - 20.0) + (y - 25.0) * (y - 25.0) + (z - 25.0) * (z - 25.0)"
query("f1_clip_sphere", f"{WITH_E} SELECT point_id FROM p WHERE {SPHERE} < 225.0")(lambda s, d: rowops.clip(events(s, d), rowops.in_sphere(CENTRE, 15)).select("point_id"))
query("f1_clip_sphere_out", f"{WITH_L} SELECT count(*) AS n FROM p WHERE NOT ({SPHERE} < 225.0)")(lambda s, d: rowops.clip(lines(s, d), rowops.in_sphere(CENTRE, 15), True).agg(F.count("*").alias("n")))
query("f2_clip_plane", f"{WITH_E} SELECT point_id FROM p WHERE (x - 20.0) * 1.0 + (y - 25.0) * 2.0 + (z - 25.0) * -1.0 > 0")(lambda s, d: rowops.clip(events(s, d), rowops.in_front(CENTRE, NORMAL)).select("point_id"))
query("f3_clip_cylinder", f"{WITH_E} SELECT point_id FROM p WHERE abs(y - 25.0) < 15 AND {SPHERE} - (y - 25.0) * (y - 25.0) < 100.0")(lambda s, d: rowops.clip(events(s, d), rowops.in_cylinder(CENTRE, AXIS, 10)).select("point_id"))
query("f4_clip_box", f"{WITH_E} SELECT point_id FROM p WHERE x > 10 AND x < 30 AND y > 5 AND y < 45 AND z > 20 AND z < 30")(lambda s, d: rowops.clip(events(s, d), rowops.in_box(CENTRE, Vec(10, 20, 5))).select("point_id"))
query("f6_crop_value", f"{WITH_E} SELECT point_id FROM p WHERE value >= 10 AND value < 40")(lambda s, d: rowops.crop_value(events(s, d), 10, 40).select("point_id"))
query("f7_sample_fraction", None)(lambda s, d: rowops.sample_fraction(events(s, d), 0.1, 3))
query("f8_sample_count", None)(lambda s, d: rowops.sample_count(events(s, d), 1000, 3))
query("f9_sample_per_ion", f"{WITH_E} SELECT coalesce(ion, 'unranged') AS ion, least(count(*), 100) AS n FROM r GROUP BY 1")(
    lambda s, d: rowops.sample_count(ranging.ranged(events(s, d), TABLE).withColumn("ion", F.coalesce("ion", F.lit("unranged"))), 100, 3, by="ion").groupBy("ion").agg(F.count("*").alias("n"))
)
_drawn = lambda s, d, sample: sample.join(events(s, d).select("point_id", F.col("value").alias("o")), "point_id", "left").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("k"), F.count(F.when(F.col("value") == F.col("o"), 1)).alias("own"))
_about = lambda share: (F.abs(F.col("n") - F.col("all") * share) < 5 * F.sqrt(F.col("all") * share)) & (F.col("n") == F.col("k")) & (F.col("n") == F.col("own"))
_all = lambda s, d: events(s, d).agg(F.count("*").alias("all"))  # noqa: E731  one row
query("f7_sample_is_fair", f"{WITH_E} SELECT count(*) AS n, true AS fair FROM p")(
    # ``n`` is of all points; a tenth of them, give or take five deviations, each its own
    lambda s, d: _drawn(s, d, rowops.sample_fraction(events(s, d), 0.1, 3)).join(F.broadcast(_all(s, d))).select(F.col("all").alias("n"), _about(0.1).alias("fair"))
)
query("f8_sample_is_exact", f"{WITH_E} SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS k, least(count(*), 1000) AS own FROM p")(lambda s, d: _drawn(s, d, rowops.sample_count(events(s, d), 1000, 3)))
query("f11_indices", "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS k, true AS inside")(lambda s, d: streams.sample_indices(s, 10_000, 500, 3).agg(F.count("*").alias("n"), F.countDistinct("index").alias("k"), (F.min("index") >= 0).__and__(F.max("index") < 10_000).alias("inside")))
query("p13_throttle_is_fair", f"{WITH_E} SELECT count(*) AS n, true AS fair FROM p")(
    lambda s, d: _drawn(s, d, rowops.throttle(events(s, d), 500, 3)).join(F.broadcast(_all(s, d))).select(F.col("all").alias("n"), _about(500 / F.col("all")).alias("fair"))
)
query("p13_throttle", None)(lambda s, d: rowops.throttle(events(s, d), 2000, 3))

# --- histograms and profiles ------------------------------------------------------

HIST = "SELECT CAST(b.bin AS INT) AS bin, round({lo} + b.bin * {w}, 6) AS x, count(p.value) AS n FROM range({k}) b(bin) LEFT JOIN p ON floor((value - {lo}) / {w}) = b.bin GROUP BY b.bin"
query("a1_spectrum", f"{WITH_L} " + HIST.format(lo="0.0", w="0.5", k=240))(lambda s, d: rounded(bins.spectrum(lines(s, d), 0, 120, 0.5), "x"))
query(
    "a2_spectrum_area",
    f"{WITH_L}, h AS ({HIST.format(lo='0.0', w='0.5', k=240)}) SELECT bin, round(n / (sum(n) OVER () * 0.5), 6) AS y FROM h",
)(lambda s, d: rounded(bins.normalise(bins.spectrum(lines(s, d), 0, 120, 0.5), "area", width=0.5).select("bin", "y"), "y"))
query(
    "a2_spectrum_max_in",
    f"{WITH_L}, h AS ({HIST.format(lo='0.0', w='0.5', k=240)}) SELECT bin, round(n / max(CASE WHEN x >= 10 AND x < 50 THEN n END) OVER (), 6) AS y FROM h",
)(lambda s, d: rounded(bins.normalise(bins.spectrum(lines(s, d), 0, 120, 0.5), "max_in", 10, 50).select("bin", "y"), "y"))
query("a5_background_curve", f"{WITH_L}, h AS ({HIST.format(lo='0.0', w='0.5', k=240)}) SELECT bin, round(CASE WHEN x > 0 THEN 1.5 / (2 * sqrt(x)) ELSE 0 END, 6) AS background, round(greatest(n - CASE WHEN x > 0 THEN 1.5 / (2 * sqrt(x)) ELSE 0 END, 0), 6) AS corrected FROM h")(
    lambda s, d: rounded(bins.spectrum(lines(s, d), 0, 120, 0.5).withColumn("background", stats.background_curve(3.0, 0.5)).select("bin", "background", F.greatest(F.col("n") - F.col("background"), F.lit(0.0)).alias("corrected")), "background", "corrected")
)
AXIAL = "CASE WHEN abs(y - 25.0) < 15 AND (x - 20.0) * (x - 20.0) + (z - 25.0) * (z - 25.0) < 100.0 THEN CAST(floor((y - 25.0 + 15.0) / 30.0 * 20) AS INT) END"
query(
    "a13_a16_axial_profile",
    f"{WITH_L}, b AS (SELECT {AXIAL} AS bin, coalesce(ion, 'unranged') AS ion FROM r), c AS (SELECT bin, ion, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY bin) AS total FROM c) SELECT bin, ion, n, CAST(total AS BIGINT) AS total, round(n / total, 6) AS fraction FROM t WHERE total >= 10",
)(lambda s, d: rounded(bins.profile(ranging.ranged(lines(s, d), TABLE).withColumn("ion", F.coalesce("ion", F.lit("unranged"))), bins.axial_bin(CENTRE, AXIS, 10, 20), 20, "ion", 10), "fraction"))
query("a14_radial_profile", f"{WITH_L} SELECT CAST(floor(((x - 20.0) * (x - 20.0) + (z - 25.0) * (z - 25.0)) / 100.0 * 16) AS INT) AS bin, count(*) AS n FROM p WHERE abs(y - 25.0) < 15 AND (x - 20.0) * (x - 20.0) + (z - 25.0) * (z - 25.0) < 100.0 GROUP BY 1")(
    # the axis is a coordinate axis, so the distance from it needs no subtraction here
    lambda s, d: lines(s, d).where((F.abs(F.col("y") - 25.0) < 15)).withColumn("o", (F.col("x") - 20.0) * (F.col("x") - 20.0) + (F.col("z") - 25.0) * (F.col("z") - 25.0)).where("o < 100").groupBy(F.floor(F.col("o") / 100.0 * 16).cast("int").alias("bin")).agg(F.count("*").alias("n"))
)
query(
    "a15_a17_sphere_profile",
    f"{WITH_L}, b AS (SELECT CAST(floor(sqrt({SPHERE}) / 18.0 * 12) AS INT) AS bin FROM p WHERE sqrt({SPHERE}) < 18.0) SELECT bin, count(*) AS n, round(count(*) / ((CAST(bin AS DOUBLE) * bin * 3 + bin * 3 + 1) * {4 / 3 * math.pi * 1.5**3!r}), 6) AS density FROM b GROUP BY 1",
)(lambda s, d: rounded(bins.profile(lines(s, d), bins.sphere_bin(CENTRE, 18, 12), 12).withColumn("density", F.col("n") / bins.bin_volume("sphere", 12, 18)).select("bin", "n", "density"), "density"))
query(
    "a19_w1_error_bars",
    f"{WITH_L}, h AS ({HIST.format(lo='0.0', w='2.0', k=60)}), k AS (SELECT h.bin, o.n FROM h, range(4) f(j), h o WHERE o.bin = least(greatest(h.bin - 2 + f.j, 0), 59)) SELECT bin, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS err FROM k GROUP BY 1",
)(lambda s, d: rounded(bins.moving_deviation(bins.spectrum(lines(s, d), 0, 120, 2.0), 4).select("bin", "mean", "err"), "mean", "err"))
query("a8_a11_bounds_volume", f"{WITH_L} SELECT round(min(x), 6) AS low_x, round(max(x), 6) AS high_x, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 4) AS volume, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))), 6) AS density FROM p")(
    lambda s, d: lines(s, d).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("low", F.min), ("high", F.max))), F.count("*").alias("n")).withColumn("v", (F.col("high_x") - F.col("low_x")) * (F.col("high_y") - F.col("low_y")) * (F.col("high_z") - F.col("low_z"))).select(F.round("low_x", 6).alias("low_x"), F.round("high_x", 6).alias("high_x"), F.round("v", 4).alias("volume"), F.round(F.col("n") / F.col("v"), 6).alias("density"))
)
query("a41_mean_deviation", f"{WITH_L} SELECT round(avg(value), 6) AS mean, round(stddev_samp(value) * (1 + 1 / (4.0 * count(value))), 6) AS sd, count(value) AS n FROM p")(lambda s, d: rounded(stats.mean_deviation(lines(s, d), "value"), "mean", "sd"))
query("a44_weighted_mean", f"{WITH_L} SELECT round(sum(x * value) / sum(value), 6) AS mean FROM p")(lambda s, d: rounded(stats.weighted_mean(lines(s, d), "x", "value"), "mean"))
query("a49_a50_plot_bounds", f"{WITH_L}, h AS ({HIST.format(lo='0.0', w='0.5', k=240)}) SELECT round(min(x), 6) AS low_x, round(max(x), 6) AS high_x, min(n) AS low_n, max(n) AS high_n, min(CASE WHEN n <> 0 THEN n END) AS least FROM h")(
    lambda s, d: bins.spectrum(lines(s, d), 0, 120, 0.5).agg(F.round(F.min("x"), 6).alias("low_x"), F.round(F.max("x"), 6).alias("high_x"), F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.min(F.when(F.col("n") != 0, F.col("n"))).alias("least"))
)
query("k8_plot_grid", f"{WITH_L} SELECT round(floor(value / 10.0) * 10.0, 6) AS x, count(*) FILTER (WHERE ion = 'A') AS a, count(*) FILTER (WHERE ion = 'B') AS b FROM r GROUP BY 1")(
    lambda s, d: rounded(ranging.ranged(lines(s, d), TABLE).withColumn("x", F.floor(F.col("value") / 10.0) * 10.0).groupBy("x").pivot("ion", ["A", "B"]).agg(F.count("value").alias("n")).select(F.col("x").cast("double"), F.coalesce("A", F.lit(0)).alias("a"), F.coalesce("B", F.lit(0)).alias("b")), "x")
)

# --- voxels -----------------------------------------------------------------------

CELL = "CAST(least(floor({c} / {size} * 10), 9) AS INT)"
CELLS = ", ".join(f"{CELL.format(c=c, size=size)} AS i{c}" for c, size in zip("xyz", ("50.0", "52.0", "50.0"), strict=True))
GRID = f"g AS (SELECT {CELLS}, CAST(count(*) AS DOUBLE) AS v FROM p WHERE x >= 0 AND y >= 0 AND z >= 0 GROUP BY 1, 2, 3)"
grid = lambda s, d: bins.voxels(events(s, d), SHAPE, (LOW, HIGH))
query("a20_voxel_counts", f"{WITH_E}, {GRID} SELECT * FROM g")(grid)
query("a21_voxel_density", f"{WITH_E}, {GRID} SELECT ix, iy, iz, round(v / 130.0, 6) AS v FROM g")(lambda s, d: rounded(grid(s, d).withColumn("v", F.col("v") / 130.0), "v"))
query("a22_voxel_fraction", f"{WITH_E} SELECT {CELLS}, round(sum(CASE WHEN ion = 'A' THEN 1.0 ELSE 0.0 END) / count(*), 6) AS v FROM r GROUP BY 1, 2, 3")(lambda s, d: rounded(bins.voxel_ratio(ranging.ranged(events(s, d), TABLE), SHAPE, (LOW, HIGH), F.col("ion") == "A"), "v"))
query("a23_voxel_ratio", f"{WITH_E}, n AS (SELECT {CELLS}, sum(CASE WHEN ion = 'A' THEN 1.0 ELSE 0.0 END) AS a, sum(CASE WHEN ion = 'B' THEN 1.0 ELSE 0.0 END) AS b FROM r GROUP BY 1, 2, 3) SELECT ix, iy, iz, round(CASE WHEN b = 0 THEN a ELSE a / b END, 6) AS v FROM n")(
    lambda s, d: rounded(bins.voxel_ratio(ranging.ranged(events(s, d), TABLE), SHAPE, (LOW, HIGH), F.col("ion") == "A", F.col("ion") == "B"), "v")
)
query("a24_voxel_summary", f"{WITH_E}, {GRID} SELECT CASE WHEN count(*) = 1000 THEN min(v) ELSE least(min(v), 0.0) END AS low, max(v) AS high, sum(v) AS total, CAST(sum(CASE WHEN v >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_over FROM g")(lambda s, d: bins.voxel_summary(grid(s, d), 10, 1000))
_soft = " UNION ALL ".join(
    "SELECT " + ", ".join(f"CAST(k{a} AS INT) + {k} AS i{a}" for a, k in zip("xyz", bits, strict=True)) + ", " + " * ".join(f"f{a}" if k else f"(1 - f{a})" for a, k in zip("xyz", bits, strict=True)) + " AS w FROM u" for bits in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
)
query("a25_soft_voxels", f"{WITH_E}, u AS (SELECT {', '.join(f'floor({a} / 5.0 - 0.5) AS k{a}, {a} / 5.0 - 0.5 - floor({a} / 5.0 - 0.5) AS f{a}' for a in 'xyz')} FROM p), w AS ({_soft}) SELECT ix, iy, iz, round(sum(w), 6) AS v FROM w GROUP BY 1, 2, 3")(
    lambda s, d: rounded(bins.soft_voxels(events(s, d), LOW, 5.0), "v")
)
query("f20_voxel_threshold", f"{WITH_E}, {GRID} SELECT ix, iy, iz FROM g WHERE v > 12")(lambda s, d: bins.voxel_threshold(grid(s, d), 12).select("ix", "iy", "iz"))
query("f21_voxel_binarise", f"{WITH_E}, {GRID} SELECT ix, iy, iz, CASE WHEN v < 12 THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM g")(lambda s, d: bins.binarise(grid(s, d), 12))
_k = [math.exp(-(k * k) / 2) for k in (-2, -1, 0, 1, 2)]
_w = ", ".join(f"({k - 2}, {v / sum(_k)!r})" for k, v in enumerate(_k))
query(
    "g8_gaussian_smooth",
    f"{WITH_E}, {GRID}, k(o, w) AS (VALUES {_w}), s AS (SELECT g.ix + a.o AS ix, g.iy + b.o AS iy, g.iz + c.o AS iz, g.v * a.w * b.w * c.w AS v FROM g, k a, k b, k c) SELECT ix, iy, iz, round(sum(v), 6) AS v FROM s WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 9 AND iz BETWEEN 0 AND 9 GROUP BY 1, 2, 3",
)(lambda s, d: rounded(bins.smooth(grid(s, d), SHAPE, 1.0, 2), "v"))
_s = ", ".join(f"({k - 2}, {v / sum(_k)!r}::DOUBLE, {v / sum(_k) * ((k - 2) ** 2 - 1)!r}::DOUBLE)" for k, v in enumerate(_k))
query(
    "g9_laplacian",
    f"{WITH_E}, {GRID}, k(o, w, q) AS (VALUES {_s}), s AS (SELECT g.ix + a.o AS ix, g.iy + b.o AS iy, g.iz + c.o AS iz, g.v * (a.q * b.w * c.w + a.w * b.q * c.w + a.w * b.w * c.q) AS v FROM g, k a, k b, k c) SELECT ix, iy, iz, round(sum(v), 6) + 0.0 AS v FROM s WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 9 AND iz BETWEEN 0 AND 9 GROUP BY 1, 2, 3",
)(lambda s, d: rounded(bins.smooth(grid(s, d), SHAPE, 1.0, 2, True), "v"))
_eight = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
_corners = lambda keep: " UNION ALL ".join(f"SELECT {keep}, " + ", ".join(f"CAST(k{a} AS INT) + {k} AS i{a}" for a, k in zip("xyz", bits, strict=True)) + ", " + " * ".join(f"f{a}" if k else f"(1 - f{a})" for a, k in zip("xyz", bits, strict=True)) + " AS w FROM u" for bits in _eight)
_near = f"{', '.join(f'floor({a} / 5.0 - 0.5) AS k{a}, {a} / 5.0 - 0.5 - floor({a} / 5.0 - 0.5) AS f{a}' for a in 'xyz')}"
_by_ion = f"{WITH_E}, u AS (SELECT ion, {_near} FROM r), w AS ({_corners('ion')})"
query("a26_soft_fraction", f"{_by_ion} SELECT ix, iy, iz, round(coalesce(sum(CASE WHEN ion = 'A' THEN w ELSE 0 END) / nullif(sum(w), 0), 0), 6) AS v FROM w GROUP BY 1, 2, 3")(
    lambda s, d: rounded(bins.soft_ratio(ranging.ranged(events(s, d), TABLE), LOW, 5.0, F.col("ion") == "A"), "v")
)
query("a26_soft_ratio", f"{_by_ion} SELECT ix, iy, iz, round(coalesce(sum(CASE WHEN ion = 'A' THEN w ELSE 0 END) / nullif(sum(CASE WHEN ion = 'B' THEN w ELSE 0 END), 0), 0), 4) AS v FROM w GROUP BY 1, 2, 3")(
    lambda s, d: bins.soft_ratio(ranging.ranged(events(s, d), TABLE), LOW, 5.0, F.col("ion") == "A", F.col("ion") == "B").withColumn("v", F.round("v", 4))
)
query("a26_soft_density", f"{_by_ion}, t AS (SELECT ix, iy, iz, sum(w) / 125.0 AS v FROM w GROUP BY 1, 2, 3) SELECT ix, iy, iz, round(v / max(v) OVER (), 6) AS v FROM t")(lambda s, d: rounded(bins.soft_density(events(s, d), LOW, 5.0, 12**3), "v"))
query("g12_resize", f"{WITH_E}, {GRID} SELECT CAST(ix + 1 AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz - 2 AS INT) AS iz, v FROM g WHERE ix + 1 < 6 AND iy < 12 AND iz >= 2")(lambda s, d: bins.resize(grid(s, d), (6, 12, 8), (1, 0, -2)))
query("g10_slice", f"{WITH_E}, {GRID} SELECT ix, iy, round(sum(v * CASE WHEN iz = 4 THEN 0.75 ELSE 0.25 END), 6) AS v FROM g WHERE iz IN (4, 5) GROUP BY 1, 2")(lambda s, d: rounded(bins.grid_slice(grid(s, d), "iz", 4.25, True), "v"))
query("g12_rebin", f"{WITH_E}, {GRID} SELECT CAST(ix // 2 AS INT) AS ix, CAST(iy // 2 AS INT) AS iy, CAST(iz // 2 AS INT) AS iz, sum(v) AS v FROM g GROUP BY 1, 2, 3")(lambda s, d: bins.rebin(grid(s, d), 2))

# --- neighbours ---------------------------------------------------------------------

NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
PAIR = f"{{s}} a JOIN {{t}} b ON b.x > a.x - {{r}} - 1e-9 AND b.x < a.x + {{r}} + 1e-9 AND {NEAR} < {{r}} * {{r}} AND a.point_id <> b.point_id"
query("j4_radius_join", f"{WITH_E} SELECT a.point_id, count(*) AS n, round(min({NEAR}), 6) AS nearest FROM {PAIR.format(s='p', t='p', r='2.0')} GROUP BY 1")(
    lambda s, d: rounded(spatial.neighbour_summary(events(s, d), events(s, d), 2.0).select("point_id", "n", F.col("d2").alias("nearest")), "nearest")
)
query("j2_w3_knn_join", f"{WITH_E}, n AS (SELECT a.point_id, min({NEAR}, 3) AS ds FROM p a JOIN p b ON a.point_id <> b.point_id GROUP BY 1) SELECT point_id, unnest([1, 2, 3]) AS rank, round(unnest(ds), 6) AS d2 FROM n")(
    lambda s, d: rounded(spatial.knn_join(events(s, d), events(s, d), 3).select(F.col("s_point_id").alias("point_id"), "rank", "d2"), "d2")
)
query("j3_nearest", f"{WITH_E} SELECT a.point_id, round(min({NEAR}), 6) AS d2 FROM r a JOIN r b ON a.ion = 'A' AND b.ion = 'B' GROUP BY 1")(
    lambda s, d: rounded(spatial.knn_join(ranging.keep_ions(events(s, d), TABLE, ["A"]), ranging.keep_ions(events(s, d), TABLE, ["B"]), 1).select(F.col("s_point_id").alias("point_id"), "d2"), "d2")
)
DENSE = f"n AS (SELECT a.point_id, count(*) AS n FROM {PAIR.format(s='p', t='p', r='2.0')} GROUP BY 1), q AS (SELECT p.point_id, coalesce(n, 0) / {4 / 3 * math.pi * 8!r} AS density FROM p LEFT JOIN n USING (point_id))"
query("j5_density_radius", f"{WITH_E}, {DENSE} SELECT point_id, round(density, 6) AS density FROM q")(lambda s, d: rounded(spatial.local_density(events(s, d), 2.0).select("point_id", "density"), "density"))
query("j5_density_knn", f"{WITH_E}, n AS (SELECT a.point_id, min({NEAR}, 3) AS ds FROM p a JOIN p b ON a.point_id <> b.point_id GROUP BY 1) SELECT point_id, round(3 / ({4 / 3 * math.pi!r} * ds[3] * sqrt(ds[3])), 6) AS density FROM n")(
    lambda s, d: rounded(spatial.local_density(events(s, d), k=3).select("point_id", "density"), "density")
)
query("j6_f17_density_filter", f"{WITH_E}, {DENSE} SELECT point_id FROM q WHERE density > 0.05")(lambda s, d: spatial.density_filter(events(s, d), 0.05, radius=2.0).select("point_id"))
MATCH = f"EXISTS (SELECT 1 FROM r b WHERE b.ion = 'B' AND b.x >= a.x - 1.5 AND b.x <= a.x + 1.5 AND {NEAR} <= 2.25)"
_ab = lambda s, d: (ranging.keep_ions(events(s, d), TABLE, ["A"]), ranging.keep_ions(events(s, d), TABLE, ["B", "C"]).where("ion = 'B'"))
query("j7_subtract", f"{WITH_E} SELECT a.point_id FROM r a LEFT JOIN r b ON b.ion = 'B' AND {NEAR} <= 6.25 WHERE a.ion IS DISTINCT FROM 'B' GROUP BY 1 HAVING count(b.point_id) = 0")(
    lambda s, d: spatial.subtract(ranging.ranged(events(s, d), TABLE).where("ion is null or ion <> 'B'"), ranging.keep_ions(events(s, d), TABLE, ["B"]), 2.5).select("point_id")
)
query("j8_intersect", f"{WITH_E} SELECT a.point_id, round(arg_min(b.value, {NEAR}), 6) AS value FROM r a JOIN r b ON b.ion = 'B' AND {NEAR} <= 6.25 WHERE a.ion IS DISTINCT FROM 'B' GROUP BY 1")(
    lambda s, d: rounded(spatial.intersect(ranging.ranged(events(s, d), TABLE).where("ion is null or ion <> 'B'"), ranging.keep_ions(events(s, d), TABLE, ["B"]), 2.5, True).select("point_id", "value"), "value")
)
query("j9_union", f"{WITH_E}, o AS (SELECT * FROM r WHERE ion IS DISTINCT FROM 'B'), t AS (SELECT b.point_id FROM r b LEFT JOIN o a ON {NEAR} <= 6.25 WHERE b.ion = 'B' GROUP BY 1 HAVING count(a.point_id) = 0) SELECT point_id FROM o UNION ALL SELECT point_id FROM t")(
    lambda s, d: spatial.union(ranging.ranged(events(s, d), TABLE).where("ion is null or ion <> 'B'"), ranging.keep_ions(events(s, d), TABLE, ["B"]), 2.5).select("point_id")
)


def _conc_radius(s, d):
    r = ranging.ranged(events(s, d), TABLE)
    src = r.where("ion = 'A'")
    return rounded(spatial.radius_concentration(src, r, 3.0, F.col("ion") == "A", F.col("ion") == "B").select("point_id", "concentration"), "concentration")


query(
    "j14_concentration_radius",
    f"{WITH_E}, n AS (SELECT a.point_id, count(*) FILTER (WHERE b.ion = 'A') AS n, count(*) FILTER (WHERE b.ion = 'B') AS d FROM {PAIR.format(s='r', t='r', r='3.0')} WHERE a.ion = 'A' GROUP BY 1) SELECT r.point_id, round(CASE WHEN coalesce(n + d, 0) > 0 THEN n * 100.0 / (n + d) ELSE -1 END, 6) AS concentration FROM r LEFT JOIN n USING (point_id) WHERE r.ion = 'A'",
)(_conc_radius)


def _conc_knn(s, d):
    r = ranging.ranged(events(s, d), TABLE)
    src, dst = r.where("ion = 'A'"), r.where("ion in ('B', 'C')")
    pairs = spatial.knn_join(src, dst, 5, target_columns=("ion",))
    return rounded(spatial.local_concentration(pairs, src, F.col("t_ion") == "B", F.col("t_ion") == "C").select("point_id", "concentration"), "concentration")


query(
    "j15_concentration_knn",
    f"{WITH_E}, n AS (SELECT a.point_id, arg_min(b.ion, {NEAR}, 5) AS l FROM r a JOIN r b ON b.ion IN ('B', 'C') WHERE a.ion = 'A' GROUP BY 1) SELECT point_id, round(len(list_filter(l, lambda q: q = 'B')) * 100.0 / len(l), 6) AS concentration FROM n",
)(_conc_knn)
query("a27_rdf", f"{WITH_E}, h AS (SELECT CAST(floor(sqrt({NEAR}) / 3.0 * 30) AS INT) AS bin, count(*) AS n FROM {PAIR.format(s='p', t='p', r='3.0')} GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n FROM range(30) b(bin) LEFT JOIN h USING (bin)")(
    lambda s, d: spatial.radial_distribution(events(s, d), events(s, d), 3.0, 30).select("bin", "n")
)
query(
    "a28_w4_knn_histograms",
    f"{WITH_E}, n AS (SELECT a.point_id, min({NEAR}, 2) AS ds FROM p a JOIN p b ON a.point_id <> b.point_id GROUP BY 1), k AS (SELECT unnest([1, 2]) AS rank, sqrt(unnest(ds)) AS d FROM n), m AS (SELECT *, max(d) OVER (PARTITION BY rank) AS most FROM k) SELECT rank, CAST(least(floor(d / most * 20), 19) AS INT) AS bin, count(*) AS n FROM m GROUP BY 1, 2",
)(lambda s, d: spatial.neighbour_histograms(events(s, d), 2, 20).select("rank", "bin", "n"))
query(
    "a30_axial_df",
    f"{WITH_E}, s AS (SELECT * FROM p WHERE abs(y - 25.0) < 15 AND {SPHERE} - (y - 25.0) * (y - 25.0) < 100.0), h AS (SELECT CAST(floor(((b.y - a.y) / 6.0 + 0.5) * 24) AS INT) AS bin, count(*) AS n FROM {PAIR.format(s='s', t='p', r='3.0')} GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n FROM range(24) b(bin) LEFT JOIN h USING (bin)",
)(lambda s, d: spatial.axial_distribution(events(s, d), events(s, d), CENTRE, AXIS, 10, 3.0, 24))

query("j3_dead_zone", f"{WITH_E} SELECT a.point_id, round(min({NEAR}), 6) AS d2 FROM r a JOIN r b ON a.ion = 'A' AND b.ion = 'B' AND {NEAR} > 4.0 GROUP BY 1")(
    lambda s, d: rounded(spatial.knn_join(ranging.keep_ions(events(s, d), TABLE, ["A"]), ranging.keep_ions(events(s, d), TABLE, ["B"]), 1, beyond=2.0).select(F.col("s_point_id").alias("point_id"), "d2"), "d2")
)
query(
    "a31_axial_knn",
    f"{WITH_E}, n AS (SELECT a.point_id, arg_min(abs(b.x - a.x), {NEAR}, 2) AS ds FROM r a JOIN r b ON a.ion = 'A' AND b.ion = 'B' GROUP BY 1), k AS (SELECT unnest([1, 2]) AS rank, unnest(ds) AS d FROM n), m AS (SELECT max(d) AS most FROM k) SELECT rank, CAST(least(floor(d / most * 25), 24) AS INT) AS bin, count(*) AS n FROM k, m GROUP BY 1, 2",
)(lambda s, d: spatial.axial_neighbours(ranging.keep_ions(events(s, d), TABLE, ["A"]), ranging.keep_ions(events(s, d), TABLE, ["B"]), Vec(3, 0, 0), 2, 25).select("rank", "bin", "n"))

# --- streams and regions -----------------------------------------------------------------

_streams = lambda s, d: {"a": ranging.keep_ions(events(s, d), TABLE, ["A"]), "b": ranging.keep_ions(events(s, d), TABLE, ["B"]), "rest": ranging.ranged(events(s, d), TABLE).where("ion is null").drop("range_id"), "none": events(s, d).where("false")}
query("u1_collate", f"{WITH_E} SELECT point_id, CASE ion WHEN 'A' THEN 'a' WHEN 'B' THEN 'b' ELSE 'rest' END AS stream, ion IS NULL AS free FROM r WHERE ion IS DISTINCT FROM 'C'")(
    lambda s, d: streams.collate(_streams(s, d)).select("point_id", "stream", F.col("range_id").isNull().alias("free"))
)
query("u2_passed_on", f"{WITH_E} SELECT point_id, 'a' AS stream FROM r WHERE ion = 'A' UNION ALL SELECT point_id, 'b' FROM r WHERE ion = 'B' AND value < 30")(
    lambda s, d: streams.collate(streams.passed_on({"b": _streams(s, d)["b"].where("value < 30")}, {k: _streams(s, d)[k] for k in "ab"})).select("point_id", "stream")
)
query("a46_stream_counts", f"{WITH_E} SELECT k.stream, count(point_id) AS n FROM (VALUES ('a', 'A'), ('b', 'B'), ('none', '')) k(stream, i) LEFT JOIN r ON ion = i GROUP BY 1")(lambda s, d: streams.counted(_streams(s, d), ["a", "b", "none"]))
_bulk = (HIGH.x - LOW.x) * (HIGH.y - LOW.y) * (HIGH.z - LOW.z)
query(
    "a10_density",
    f"{WITH_E}, c AS (SELECT coalesce(ion, 'unranged') AS ion, count(*) AS n FROM r GROUP BY 1), t AS (SELECT * FROM c UNION ALL SELECT 'ranged', count(ion) FROM r UNION ALL SELECT 'total', count(*) FROM r) SELECT ion, n, round(n / {_bulk!r}, 9) AS density FROM t",
)(lambda s, d: streams.density(events(s, d), TABLE, _bulk).withColumn("density", F.round("density", 9)))
query(
    "a3_spectrum_regions",
    f"{WITH_L}, h AS ({HIST.format(lo='0.0', w='0.5', k=240)}) SELECT bin, n, CAST({RANGE_ID.replace('value', 'x').replace('WHEN x BETWEEN 80 AND 95 THEN 3', '')} AS INT) AS region, {ION.replace('value', 'x').replace(chr(39) + 'C' + chr(39), 'NULL')} AS ion FROM h",
)(lambda s, d: streams.spectrum_regions(bins.spectrum(lines(s, d), 0, 120, 0.5), OFF).select("bin", "n", "region", "ion"))
_regions = lambda s, d: events(s, d).select(F.col("point_id").alias("id"), F.col("value").alias("low"), (F.col("value") + F.col("y") / 500.0).alias("high"))
query(
    "j19_region_overlaps",
    f"{WITH_E}, g AS (SELECT point_id AS id, value AS low, value + y / 500.0 AS high FROM p WHERE y > 0) SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id < b.id AND a.low < b.high AND b.low < a.high",
)(lambda s, d: streams.overlapping(_regions(s, d), 0.1))
query("l2_report", f"{WITH_E} SELECT least(count(*), 200) AS n FROM p WHERE value > 60")(lambda s, d: streams.report(events(s, d), F.col("value") > 60).agg(F.count("*").alias("n")))

# --- scalars -----------------------------------------------------------------------------

_rgb = lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", *((F.col("p_partkey") * k % 256).cast("int").alias(c) for c, k in zip("rgb", (1, 7, 13), strict=True)))
query("fn_colour_hex", "SELECT p_partkey, printf('#%02x%02x%02x', p_partkey % 256, p_partkey * 7 % 256, p_partkey * 13 % 256) AS hex FROM part")(lambda s, d: _rgb(s, d).select("p_partkey", scalars.colour_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")))
query("fn_colour_bytes", "SELECT p_partkey, CAST(p_partkey % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST(p_partkey * 13 % 256 AS INT) AS b, 255 AS a FROM part")(
    lambda s, d: _rgb(s, d).select("p_partkey", scalars.colour_bytes(F.upper(scalars.colour_hex(F.col("r"), F.col("g"), F.col("b")))).alias("c")).select("p_partkey", "c.*")
)
query("fn_strings", "SELECT p_partkey, trim(p_name) AS name, len(list_filter(string_split_regex(p_type, '[ ,]+'), lambda w: w <> '')) AS words, CASE WHEN len(CAST(p_size AS VARCHAR)) >= 4 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END AS size FROM part")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", scalars.stripped(F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" "))).alias("name"), F.size(scalars.fields(F.col("p_type"), " ,")).cast("long").alias("words"), scalars.padded(F.col("p_size"), 4).alias("size"))
)

# --- clusters ------------------------------------------------------------------------

LINKS = f"e AS (SELECT a.point_id AS a, b.point_id AS b FROM {{s}} a JOIN {{s}} b ON b.x > a.x - 0.9 AND b.x < a.x + 0.9 AND {NEAR} < 0.81 AND a.point_id <> b.point_id), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a), c AS (SELECT n.point_id, least(n.point_id, coalesce(min(w.b), n.point_id)) AS cluster_id FROM {{s}} n LEFT JOIN w ON w.a = n.point_id GROUP BY n.point_id)"
WITH_C = WITH_E.replace("WITH p", "WITH RECURSIVE p") + ", " + LINKS.format(s="p")
query("g1_link_clusters", f"{WITH_C} SELECT * FROM c")(lambda s, d: clusters.link(events(s, d), 0.9))
query("f18_size_crop", f"{WITH_C} SELECT point_id, cluster_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) BETWEEN 3 AND 20)")(lambda s, d: clusters.crop_sizes(clusters.link(events(s, d), 0.9), 3, 20))
query("a36_cluster_sizes", f"{WITH_C}, z AS (SELECT cluster_id, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS n FROM z GROUP BY 1")(lambda s, d: clusters.size_distribution(clusters.link(events(s, d), 0.9)))
query(
    "a37_cluster_composition",
    f"{WITH_C}, z AS (SELECT c.*, count(*) OVER (PARTITION BY cluster_id) AS size FROM c), k AS (SELECT size, coalesce(ion, 'unranged') AS ion, count(*) AS n FROM z JOIN r USING (point_id) GROUP BY 1, 2) SELECT size, ion, n, round(n / sum(n) OVER (PARTITION BY size), 6) AS fraction FROM k",
)(lambda s, d: rounded(clusters.composition_by_size(cut(clusters.link(events(s, d), 0.9)), ranging.ranged(events(s, d), TABLE)), "fraction"))
query("j12_core_points", f"{WITH_E} SELECT a.point_id FROM {PAIR.format(s='p', t='p', r='1.5')} GROUP BY 1 HAVING count(*) >= 2")(lambda s, d: clusters.core_points(events(s, d), 2, 1.5).select("point_id"))


def _full_cluster(s, d):
    r = ranging.ranged(events(s, d), TABLE)
    return clusters.cluster(r.where("ion in ('A', 'B')"), r.where("ion is null"), 1.2, None, 0.8, 0.4, 2)


_CORE = "core AS (SELECT * FROM r WHERE ion IN ('A', 'B')), bulk AS (SELECT * FROM r WHERE ion IS NULL)"
_LINKED = LINKS.format(s="core").replace("0.9", "1.2").replace("0.81", "1.44")
query(
    "g2_j10_j11_cluster_pipeline",
    f"{WITH_E.replace('WITH p', 'WITH RECURSIVE p')}, {_CORE}, {_LINKED}, k AS (SELECT * FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) >= 2)), m AS (SELECT core.*, cluster_id FROM core JOIN k USING (point_id)), "
    f"v AS (SELECT a.point_id, min(b.cluster_id) AS cluster_id FROM bulk a JOIN m b ON b.x > a.x - 0.8 AND b.x < a.x + 0.8 AND {NEAR} < {0.8 * 0.8!r} GROUP BY 1), n AS (SELECT * FROM bulk JOIN v USING (point_id)), o AS (SELECT * FROM bulk WHERE point_id NOT IN (SELECT point_id FROM v)), "
    f"e2 AS (SELECT DISTINCT a.point_id FROM n a JOIN o b ON b.x > a.x - 0.4 AND b.x < a.x + 0.4 AND {NEAR} < {0.4 * 0.4!r}) SELECT point_id, cluster_id, 'core' AS role FROM k UNION ALL SELECT point_id, cluster_id, 'bulk' FROM v WHERE point_id NOT IN (SELECT point_id FROM e2)",
)(_full_cluster)
query(
    "a38_cluster_composition",
    f"{WITH_C}, z AS (SELECT * FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) >= 2)), k AS (SELECT coalesce(ion, 'unranged') AS ion, count(*) AS n FROM z JOIN r USING (point_id) GROUP BY 1) SELECT ion, n, round(n / sum(n) OVER (), 6) AS fraction FROM k",
)(lambda s, d: rounded(streams.cluster_composition(clusters.crop_sizes(cut(clusters.link(events(s, d), 0.9)), 2), ranging.ranged(events(s, d), TABLE)), "fraction"))
query(
    "a39_morphology",
    f"{WITH_C} SELECT cluster_id, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM c JOIN p USING (point_id) GROUP BY 1",
)(lambda s, d: rounded(clusters.morphology(events(s, d), cut(clusters.link(events(s, d), 0.9))).select("cluster_id", "n", "x", "y", "z"), "x", "y", "z"))
# axes by the trigonometric roots of the covariance's characteristic polynomial
_pairs = ", ".join(f"covar_pop({a}, {b}) AS m{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))
query(
    "a39_semi_axes",
    f"{WITH_C}, mo AS (SELECT cluster_id, count(*) AS n, {_pairs} FROM c JOIN p USING (point_id) GROUP BY 1 HAVING count(*) >= 4), tr AS (SELECT *, (mxx + myy + mzz) / 3 AS q FROM mo), "
    "dev AS (SELECT *, sqrt(((mxx - q) ** 2 + (myy - q) ** 2 + (mzz - q) ** 2 + 2 * (mxy ** 2 + mxz ** 2 + myz ** 2)) / 6) AS s FROM tr), "
    "det AS (SELECT *, ((mxx - q) * ((myy - q) * (mzz - q) - myz * myz) - mxy * (mxy * (mzz - q) - myz * mxz) + mxz * (mxy * myz - (myy - q) * mxz)) / nullif(s * s * s, 0) AS d FROM dev), "
    "ang AS (SELECT *, acos(least(greatest(coalesce(d / 2, 1.0), -1.0), 1.0)) / 3 AS f FROM det) "
    "SELECT cluster_id, n, round(sqrt(5 * greatest(q + 2 * s * cos(f), 0)), 5) + 0.0 AS axis1, round(sqrt(5 * greatest(q + 2 * s * cos(f - 2 * pi() / 3), 0)), 5) + 0.0 AS axis2, round(sqrt(5 * greatest(q + 2 * s * cos(f + 2 * pi() / 3), 0)), 5) + 0.0 AS axis3 FROM ang",
)(lambda s, d: clusters.morphology(events(s, d), clusters.crop_sizes(cut(clusters.link(events(s, d), 0.9)), 4)).select("cluster_id", "n", *((F.round(f"axis{k}", 5) + 0.0).alias(f"axis{k}") for k in (1, 2, 3))))

# --- blocks and statistics ---------------------------------------------------------------

BLOCKS = "o AS (SELECT *, floor(x / 10.0) AS cx, floor(y / 10.0) AS cy FROM r), k AS (SELECT *, (row_number() OVER (PARTITION BY cx, cy ORDER BY z, point_id) - 1) // 20 AS blk FROM o), f AS (SELECT *, count(*) OVER (PARTITION BY cx, cy, blk) AS m, max(z) OVER (PARTITION BY cx, cy, blk) - min(z) OVER (PARTITION BY cx, cy, blk) AS span FROM k), u AS (SELECT *, CAST(CAST(cx AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(cy AS BIGINT) AS VARCHAR) || ':' || CAST(blk AS VARCHAR) AS block FROM f WHERE m = 20 AND span <= 20.0)"
_blocks = lambda s, d: stats.binomial_blocks(ranging.ranged(events(s, d), TABLE), 20, 10.0, 2.0)
query("a32_w2_binomial_blocks", f"{WITH_E}, {BLOCKS} SELECT block, point_id FROM u")(lambda s, d: _blocks(s, d).select("block", "point_id"))
query(
    "a33_binomial_histogram",
    f"{WITH_E}, {BLOCKS}, every AS (SELECT DISTINCT block FROM u), ions AS (SELECT DISTINCT coalesce(ion, 'unranged') AS ion FROM u), per AS (SELECT block, ions.ion, count(u.point_id) AS k FROM every CROSS JOIN ions LEFT JOIN u USING (block) GROUP BY ALL), cnt AS (SELECT e.block, i.ion, count(u.point_id) AS k FROM every e CROSS JOIN ions i LEFT JOIN u ON u.block = e.block AND coalesce(u.ion, 'unranged') = i.ion GROUP BY 1, 2) SELECT ion, k, count(*) AS n FROM cnt GROUP BY 1, 2",
)(lambda s, d: stats.binomial_histogram(_blocks(s, d).withColumn("ion", F.coalesce("ion", F.lit("unranged")))))


def _binomial(s, d):
    hist = stats.binomial_histogram(_blocks(s, d).withColumn("ion", F.coalesce("ion", F.lit("unranged")))).collect()  # at most ions x block size rows
    ions = sorted({h["ion"] for h in hist})
    rows = [(i, *stats.binomial_test([(h["k"], h["n"]) for h in hist if h["ion"] == i], 20).values()) for i in ions]
    return s.createDataFrame(rows, "ion string, mean double, chi_square double, p double, mu double, freedom int")


query("a34_binomial_test", None)(_binomial)
query(
    "a34_binomial_chi_square",
    f"{WITH_E}, {BLOCKS}, e AS (SELECT DISTINCT block FROM u), i AS (SELECT DISTINCT coalesce(ion, 'unranged') AS ion FROM u), c AS (SELECT e.block, i.ion, count(u.point_id) AS k FROM e CROSS JOIN i LEFT JOIN u ON u.block = e.block AND coalesce(u.ion, 'unranged') = i.ion GROUP BY 1, 2), "
    "h AS (SELECT ion, CAST(k AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY ion) AS b, sum(k * n) OVER (PARTITION BY ion) / sum(n) OVER (PARTITION BY ion) AS mean FROM h), "
    "x AS (SELECT *, b * CASE WHEN mean IN (0, 20) THEN CAST(k = mean AS INT) ELSE exp(lgamma(21) - lgamma(k + 1) - lgamma(21 - k) + k * ln(mean / 20) + (20 - k) * ln(1 - mean / 20)) END AS w FROM t), "
    "s AS (SELECT ion, any_value(mean) AS mean, any_value(b) AS b, coalesce(sum(CASE WHEN n >= 5 AND w > 0 THEN (n - w) ** 2 / w END), 0) AS chi, count(*) FILTER (WHERE n >= 5) - 1 AS freedom FROM x GROUP BY 1) "
    "SELECT ion, round(mean, 6) AS mean, round(chi, 4) AS chi_square, round(coalesce(sqrt(chi / nullif(mean * b + chi, 0)), 0), 6) AS mu, CAST(freedom AS INT) AS freedom FROM s",
)(lambda s, d: rounded(_binomial(s, d).withColumn("chi_square", F.round("chi_square", 4)).select("ion", "mean", "chi_square", "mu", "freedom"), "mean", "mu"))

# --- geometry ------------------------------------------------------------------------------


def _hull(s, d):
    points = events(s, d)
    return s.createDataFrame([("convex", geometry.convex_volume(points)), ("box", geometry.box_volume(points))], "kind string, volume double")


query("a9_convex_volume", None)(_hull)
query("g4_f22_shrunken_hull", None)(lambda s, d: geometry.inside_shrunken(events(s, d), 2.0))
_tets = " + ".join(f"(CASE {' + '.join(f'CAST(c{k} >= 11.5 AS INT)' for k in tet)} WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 2 THEN 2 ELSE 1 END)" for tet in geometry.TETRAHEDRA)
_cube = ", ".join(f"coalesce(max(v) FILTER (WHERE k = {k}), 0) AS c{k}" for k in range(8))
query(
    "g6_triangles_by_cell",
    f"{WITH_E}, {GRID}, s AS (SELECT CAST(ix - k % 2 AS INT) AS ix, CAST(iy - k // 2 % 2 AS INT) AS iy, CAST(iz - k // 4 AS INT) AS iz, k, v FROM g, range(8) t(k)), c AS (SELECT ix, iy, iz, {_cube} FROM s WHERE ix BETWEEN 0 AND 8 AND iy BETWEEN 0 AND 8 AND iz BETWEEN 0 AND 8 GROUP BY 1, 2, 3), n AS (SELECT ix, iy, iz, CAST({_tets} AS BIGINT) AS n FROM c) SELECT * FROM n WHERE n > 0",
)(
    # no value is at the level, so a triangle's centre lies within its cell
    lambda s, d: geometry.isosurface(grid(s, d), SHAPE, 11.5).select(*(F.floor(sum((F.col(f"{p}{a}") for p in "bc"), F.col(f"a{a}")) / 3).cast("int").alias(f"i{a}") for a in "xyz")).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))
)
query("g6_isosurface", None)(lambda s, d: geometry.isosurface(grid(s, d), SHAPE, 12.0))
query("g7_a45_proximity", None)(
    lambda s, d: geometry.proximity_histogram(geometry.surface_distance(ranging.ranged(events(s, d), TABLE), cut(bins.soft_voxels(events(s, d), LOW, 5.0)), SHAPE, 12.0, LOW, 5.0, 6.0), 1.0, F.col("ion") == "A")
)
query(
    "g11_trilinear",
    f"{WITH_E}, {GRID}, u AS (SELECT point_id, {_near} FROM p), w AS ({_corners('point_id')}), t AS (SELECT point_id, sum(w * v) AS v FROM w JOIN g USING (ix, iy, iz) GROUP BY 1) SELECT point_id, round(coalesce(t.v, 0), 6) AS sampled FROM p LEFT JOIN t USING (point_id)",
)(lambda s, d: rounded(geometry.trilinear(events(s, d), grid(s, d), LOW, 5.0).select("point_id", "sampled"), "sampled"))
