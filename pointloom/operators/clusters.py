"""Density-linked clusters: classify, link, envelope, erode, crop, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import blocks
from pointloom.operators.spatial import _pair_schema, knn_join, neighbour_counts
from pointloom.scratch import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(point_id, cluster_id): smallest key reachable over the edges (a, b); lone nodes are clusters.

    Edges are contracted to stars by turns: every node's larger neighbours go to
    its least one, then its smaller ones do.  Rounds are tables in the shared
    folder; their number grows with the logarithm of the longest path.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        upper = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = upper.groupBy("u").agg(F.min("v").alias("m"))
        lower = upper.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(lower.where("u <> v").distinct())
        after = state(links)
        if after == before:
            break
        before = after
    names = links.select(F.col("u").alias("point_id"), F.col("v").alias("cluster_id"))
    return nodes.select("point_id").distinct().join(names, "point_id", "left").select("point_id", F.coalesce("cluster_id", "point_id").alias("cluster_id"))


def core_points(points: DataFrame, k: int, distance: float) -> DataFrame:
    """Points whose ``k``-th neighbour among them is nearer than ``distance``."""
    near = neighbour_counts(points, points, distance).where(F.col("n") >= k)
    return points.join(near.select("point_id"), "point_id", "left_semi")


def link(core: DataFrame, distance: float) -> DataFrame:
    """(point_id, cluster_id) of core points linked when nearer than ``distance``.

    Of each block of near points only the links that join them leave it.
    """
    return components(core, blocks.meet(core, core, distance, blocks.linked, blocks.LINKED))


def envelope(clusters: DataFrame, core: DataFrame, bulk: DataFrame, distance: float) -> DataFrame:
    """Bulk points within ``distance`` of a core point, with the smallest such cluster."""
    marked = core.join(clusters, "point_id")
    schema = _pair_schema(bulk, marked, False, (), ("cluster_id",))
    pairs = blocks.meet(bulk, marked, distance, blocks.listed(schema), schema, False, True, (), ("cluster_id",))
    return pairs.groupBy(F.col("s_point_id").alias("point_id")).agg(F.min("t_cluster_id").alias("cluster_id"))


def erode(enveloped: DataFrame, bulk: DataFrame, distance: float) -> DataFrame:
    """Enveloped points without a free bulk point nearer than ``distance`` (one pass)."""
    inside = bulk.join(enveloped, "point_id")
    free = bulk.join(enveloped, "point_id", "left_anti")
    return enveloped.join(neighbour_counts(inside, free, distance).select("point_id"), "point_id", "left_anti")


def crop_sizes(clusters: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Clusters of ``low`` to ``high`` members, inclusive."""
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= low)
    if high is not None:
        size = size.where(F.col("_n") <= high)
    return clusters.join(size.drop("_n"), "cluster_id", "left_semi").select(*clusters.columns)


def cluster(core: DataFrame, bulk: DataFrame | None, link_distance: float, classify: tuple[int, float] | None = None, envelope_distance: float | None = None, erode_distance: float | None = None, low: int = 0, high: int | None = None) -> DataFrame:
    """(point_id, cluster_id, role) of the whole procedure; clusters are named by their smallest core key."""
    if classify:
        kept = cut(core_points(core, *classify))
        rejected = core.join(kept, "point_id", "left_anti")
        core, bulk = kept, rejected if bulk is None else bulk.unionByName(rejected)
    found = crop_sizes(link(core, link_distance), low, high)
    out = found.withColumn("role", F.lit("core"))
    if bulk is not None and envelope_distance:
        near = envelope(found, core, bulk, envelope_distance)
        if erode_distance:
            near = erode(cut(near), bulk, erode_distance)
        out = out.unionByName(near.withColumn("role", F.lit("bulk")))
    return out.select("point_id", "cluster_id", "role")


def size_distribution(clusters: DataFrame) -> DataFrame:
    """``size``, number of clusters ``n``."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def composition_by_size(clusters: DataFrame, ions: DataFrame) -> DataFrame:
    """(size, ion): count ``n`` and share of the size; ``ions`` has point_id and ion."""
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    counts = clusters.join(size, "cluster_id").join(ions.select("point_id", F.coalesce("ion", F.lit("unranged")).alias("ion")), "point_id").groupBy("size", "ion").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("size")))


def morphology(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Centroid and semi-axes (largest first) of every cluster as a uniform ellipsoid.

    Moments are ordinary sums; the eigenvalues of the 3x3 covariance are the
    roots of its characteristic polynomial in closed form, so it stays in SQL.
    """
    m = points.join(clusters, "point_id").groupBy("cluster_id").agg(
        F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in "xyz"), *(F.covar_pop(a, b).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))
    )
    xx, yy, zz, xy, xz, yz = (F.col(f"m{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz"))
    q = (xx + yy + zz) / 3
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy**2 + xz**2 + yz**2)) / 6)
    a, b, c, d, e, f = ((k / F.expr("nullif(_p, 0)")) for k in (xx - F.col("_q"), yy - F.col("_q"), zz - F.col("_q"), xy, xz, yz))
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    phi = F.acos(F.least(F.greatest(F.coalesce(det / 2, F.lit(1.0)), F.lit(-1.0)), F.lit(1.0))) / 3
    out = m.withColumn("_q", q).withColumn("_p", p).withColumn("_phi", phi)
    third = 2.0943951023931953
    values = [F.greatest(F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_phi") + s), F.lit(0.0)) for s in (0.0, -third, third)]
    axes = F.reverse(F.array_sort(F.transform(F.array(*values), lambda v: F.sqrt(5 * v))))
    out = out.withColumn("_a", axes)
    return out.select("cluster_id", "n", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), *(F.col("_a")[k].alias(f"axis{k + 1}") for k in range(3)))


def nearest_rank(points: DataFrame, k: int) -> DataFrame:
    """Distance of each point to its ``k``-th neighbour."""
    return knn_join(points, points, k).where(F.col("rank") == k).select(F.col("s_point_id").alias("point_id"), F.sqrt("d2").alias("d"))
