"""Hulls, isosurfaces and distances to them.

The hull is found per partition first: only hull points of partitions reach the
driver.  Marching tetrahedra work on joined grid corners, all cells of a batch
at once; they give more triangles than a table of cube cases, of one surface.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.points import Vec, bounds
from pointloom.scratch import cut

#: Points that one hull call may get; partitions are reduced in steps of this size.
HULL_BLOCK = 4096


def hull(points: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Triangles (indexes) of the convex hull, outward; empty if all points lie in a plane."""
    n = len(points)
    scale = max(np.ptp(points, axis=0).max() if n else 0.0, 1e-300)
    eps = tolerance * scale
    if n < 4:
        return np.zeros((0, 3), int)
    a = int(points[:, 0].argmin())
    b = int(((points - points[a]) ** 2).sum(1).argmax())
    ab = points[b] - points[a]
    c = int((np.cross(points - points[a], ab) ** 2).sum(1).argmax())
    normal = np.cross(ab, points[c] - points[a])
    height = (points - points[a]) @ normal
    d = int(np.abs(height).argmax())
    if np.linalg.norm(normal) <= eps * scale or abs(height[d]) <= eps * np.linalg.norm(normal):
        return np.zeros((0, 3), int)
    inner = points[[a, b, c, d]].mean(0)

    def face(i: int, j: int, k: int) -> tuple[int, int, int]:
        normal = np.cross(points[j] - points[i], points[k] - points[i])
        return (i, j, k) if normal @ (points[i] - inner) >= 0 else (i, k, j)

    faces = [face(*t) for t in itertools.combinations((a, b, c, d), 3)]
    left = np.ones(n, bool)
    left[[a, b, c, d]] = False
    while True:
        f = np.array(faces)
        normals = np.cross(points[f[:, 1]] - points[f[:, 0]], points[f[:, 2]] - points[f[:, 0]])
        normals /= np.maximum(np.linalg.norm(normals, axis=1), 1e-300)[:, None]
        offsets = (normals * points[f[:, 0]]).sum(1)
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        above = points[rest] @ normals.T - offsets
        best = above.max(1)
        left[rest[best <= eps]] = False
        if best.max() <= eps:
            break
        p = int(rest[best.argmax()])
        seen = above[best.argmax()] > eps
        edges: dict[tuple[int, int], int] = {}
        for t in f[seen].tolist():
            for i, j in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[i, j] = edges.get((i, j), 0) + 1
        faces = [t for t, s in zip(faces, seen.tolist(), strict=True) if not s]
        faces += [face(i, j, p) for i, j in edges if (j, i) not in edges]
        left[p] = False
    return np.array(faces)


def hull_volume(points: np.ndarray, faces: np.ndarray) -> float:
    if not len(faces):
        return 0.0
    o = points.mean(0)
    a, b, c = (points[faces[:, k]] - o for k in range(3))
    return float(np.abs((a * np.cross(b, c)).sum(1)).sum() / 6)


def extremes(points: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The points that span the convex hull: corners in space, of a plane's polygon, or a line's two ends."""
    points = np.unique(points, axis=0)
    faces = hull(points, tolerance)
    if len(faces):
        return points[np.unique(faces)]
    if len(points) < 3:
        return points
    from_mean = points - points.mean(0)
    _, size, axes = np.linalg.svd(from_mean, full_matrices=False)
    flat = from_mean @ axes[:2].T
    if size[1] <= tolerance * size[0]:
        return points[[flat[:, 0].argmin(), flat[:, 0].argmax()]]
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    chains = []
    for way in (order, order[::-1]):
        chain: list[int] = []
        for k in way.tolist():
            while len(chain) > 1:
                (ax, ay), (bx, by) = flat[chain[-1]] - flat[chain[-2]], flat[k] - flat[chain[-2]]
                if ax * by - ay * bx > 0:
                    break
                chain.pop()
            chain.append(k)
        chains += chain[:-1]
    return points[chains]


def hull_points(points: DataFrame) -> np.ndarray:
    """Corners of the hull of all points; each task sends its own hull's corners only, also of flat sets."""

    def run(batches):
        import pandas as pd

        kept = np.zeros((0, 3))
        for batch in batches:
            table = batch[["x", "y", "z"]].to_numpy(float)
            for at in range(0, len(table), HULL_BLOCK):
                kept = extremes(np.concatenate((kept, table[at : at + HULL_BLOCK])))
        if len(kept):
            yield pd.DataFrame(kept, columns=["x", "y", "z"])

    rows = points.select("x", "y", "z").mapInPandas(run, "x double, y double, z double").toLocalIterator()
    kept = np.zeros((0, 3))
    while block := list(itertools.islice(rows, HULL_BLOCK)):
        kept = extremes(np.concatenate((kept, np.array([[r["x"], r["y"], r["z"]] for r in block]))))
    return kept


def convex_volume(points: DataFrame) -> float:
    corners = hull_points(points)
    return hull_volume(corners, hull(corners))


def box_volume(points: DataFrame) -> float:
    found = bounds(points)
    return math.prod(b - a for a, b in zip(*found, strict=True)) if found else 0.0


def volume_centre(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Centroid of a hull's volume: of the pyramids from its faces to an inner point, by their volumes."""
    inner = points[np.unique(faces)].mean(0)
    a, b, c = (points[faces[:, k]] - inner for k in range(3))
    volume = np.abs((a * np.cross(b, c)).sum(1))
    return inner + (volume[:, None] * (a + b + c)).sum(0) / (4 * volume.sum())


def inside_shrunken(points: DataFrame, distance: float) -> DataFrame:
    """Points inside the hull scaled about its centre of volume so that its nearest facet moves in by ``distance``."""
    corners = hull_points(points)
    faces = hull(corners)
    if not len(faces):
        raise ValueError("the points have no volume")
    centre = volume_centre(corners, faces)
    normals = np.cross(corners[faces[:, 1]] - corners[faces[:, 0]], corners[faces[:, 2]] - corners[faces[:, 0]])
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    far = ((corners[faces[:, 0]] - centre) * normals).sum(1)
    factor = 1 - distance / far.min()
    if factor <= 0:
        raise ValueError("nothing is left of the hull")
    planes = np.unique(np.round(np.column_stack((normals, far * factor)), 12), axis=0)
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast((planes, centre))

    def run(batches):
        planes, centre = sent.value
        for b in batches:
            p = b[["x", "y", "z"]].to_numpy(float) - centre
            yield b[(p @ planes[:, :3].T < planes[:, 3]).all(1)]

    return points.mapInPandas(run, points.schema)


#: The six tetrahedra of a cell; corners are numbered x + 2 y + 4 z.
TETRAHEDRA = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def corners_of_cells(grid: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``ix, iy, iz`` and the eight corner values ``c`` of each cell with a filled corner."""
    steps = F.array(*(F.struct((F.col("ix") - (k & 1)).alias("ix"), (F.col("iy") - (k >> 1 & 1)).alias("iy"), (F.col("iz") - (k >> 2)).alias("iz"), F.lit(k).alias("k"), F.col("v").alias("v")) for k in range(8)))
    spread = grid.select(F.explode(steps).alias("s")).select("s.*")
    inside = None
    for c, n in zip(("ix", "iy", "iz"), shape, strict=True):
        cond = (F.col(c) >= 0) & (F.col(c) < n - 1)
        inside = cond if inside is None else inside & cond
    corner = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)) for k in range(8)]
    return spread.where(inside).groupBy("ix", "iy", "iz").agg(F.array(*corner).alias("c"))


def cell_triangles(base: np.ndarray, corners: np.ndarray, level: float) -> np.ndarray:
    """Triangles (rows of nine) where cells with eight corner values cross a level, by the sign cases of their tetrahedra."""
    unit = np.array([[k & 1, k >> 1 & 1, k >> 2] for k in range(8)], float)
    high = corners >= level
    out = [np.zeros((0, 9))]
    for tet in TETRAHEDRA:
        case = sum(high[:, k].astype(int) << n for n, k in enumerate(tet))
        for signs in range(1, 15):
            own = np.flatnonzero(case == signs)
            if not len(own):
                continue
            up, down = ([k for n, k in enumerate(tet) if signs >> n & 1 == bit] for bit in (1, 0))

            def cross(i: int, j: int, own=own) -> np.ndarray:
                t = (level - corners[own, i]) / (corners[own, j] - corners[own, i])
                return base[own] + unit[i] + (unit[j] - unit[i]) * t[:, None]

            if len(up) == 2:
                q = [cross(up[0], down[0]), cross(up[0], down[1]), cross(up[1], down[1]), cross(up[1], down[0])]
                out += [np.hstack((q[0], q[1], q[2])), np.hstack((q[0], q[2], q[3]))]
            else:
                one, many = (up, down) if len(up) == 1 else (down, up)
                out.append(np.hstack([cross(one[0], k) for k in many]))
    return np.concatenate(out)


def isosurface(grid: DataFrame, shape: tuple[int, int, int], level: float) -> DataFrame:
    """Triangles ``ax..cz`` (in cells) where the values cross ``level``; absent cells are 0."""
    names = [f"{p}{a}" for p in "abc" for a in "xyz"]

    def run(batches):
        import pandas as pd

        for b in batches:
            base = b[["ix", "iy", "iz"]].to_numpy(float)
            corners = np.array(b["c"].tolist(), float).reshape(-1, 8)
            yield pd.DataFrame(cell_triangles(base, corners, level), columns=names)

    return corners_of_cells(grid, shape).mapInPandas(run, ", ".join(f"{n} double" for n in names))


def triangle_distance2(p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of points to triangles with a corner at the origin and edges ``u`` and ``v`` (rows of three).

    The least of the distances to the three sides and, where the foot of the
    perpendicular lies within, to the plane; triangles may be degenerate.
    """
    dot = lambda a, b: (a * b).sum(1)
    uu, vv, uv, pu, pv = dot(u, u), dot(v, v), dot(u, v), dot(p, u), dot(p, v)
    safe = lambda d: np.where(d == 0, 1.0, d)
    clamped = lambda n, d: np.where(d > 0, np.clip(n / safe(d), 0.0, 1.0), 0.0)

    def to(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        rest = p - m[:, None] * u - n[:, None] * v
        return dot(rest, rest)

    zero = np.zeros(len(p))
    k = clamped(pv - pu + uu - uv, uu - 2 * uv + vv)
    out = np.minimum(np.minimum(to(clamped(pu, uu), zero), to(zero, clamped(pv, vv))), to(1 - k, k))
    det = uu * vv - uv * uv
    f, g = (vv * pu - uv * pv) / safe(det), (uu * pv - uv * pu) / safe(det)
    within = (det != 0) & (f >= 0) & (g >= 0) & (f + g <= 1)
    return np.where(within, np.minimum(out, to(f, g)), out)


def surface_distance(points: DataFrame, grid: DataFrame, shape: tuple[int, int, int], level: float, low: Vec, edge: float, most: float) -> DataFrame:
    """Add ``distance`` to the isosurface, negative inside; only points within ``most`` stay.

    Triangles whose centre lies within ``most`` and the largest triangle's radius
    are candidates; the distance to each is exact.  Grid values sit at cell
    centres.  Inside is decided by the cell's value.
    """
    from pointloom.operators import blocks

    place = lambda p, c: (F.col(f"{p}{c}") + 0.5) * F.lit(float(edge)) + F.lit(float(getattr(low, c)))
    side = lambda p, c: (F.col(f"{p}{c}") - F.col(f"a{c}")) * F.lit(float(edge))
    parts = [(place("a", c).alias(f"a{c}"), side("b", c).alias(f"u{c}"), side("c", c).alias(f"v{c}")) for c in "xyz"]
    tri = isosurface(grid, shape, level).select(*(p for part in zip(*parts, strict=True) for p in part)).distinct()
    tri = tri.select("*", *((F.col(f"a{c}") + (F.col(f"u{c}") + F.col(f"v{c}")) / 3).alias(c) for c in "xyz"), (-1 - F.monotonically_increasing_id()).alias("point_id"))
    surface = cut(tri)
    reach = lambda m, n: sum(((F.col(f"u{c}") * (m - 1 / 3) + F.col(f"v{c}") * (n - 1 / 3)) ** 2 for c in "xyz"), F.lit(0.0))
    widest = surface.agg(F.max(F.sqrt(F.greatest(reach(0, 0), reach(1, 0), reach(0, 1)))).alias("r")).first()["r"] or 0.0
    corners = tuple(f"{p}{c}" for p in "auv" for c in "xyz")

    def measure(near: blocks.Near, rows: np.ndarray, triangles: np.ndarray) -> np.ndarray:
        corner, u, v = (np.stack([near.batch.column(f"t_{p}{c}").to_numpy(zero_copy_only=False)[triangles] for c in "xyz"], 1) for p in "auv")
        return triangle_distance2(np.stack([a[rows] for a in near.at], 1) - corner, u, v)

    parts = blocks.meet(points, surface, (most + widest) * (1 + 1e-9), blocks.closest(measure), blocks.CLOSEST, False, True, (), corners)
    near = parts.where(F.col("d2") < F.lit(float(most) * float(most))).groupBy("point_id").agg(F.sqrt(F.min("d2")).alias("_d"))
    cell = [F.floor((F.col(a) - F.lit(float(o))) / F.lit(float(edge))).cast("int").alias(c) for a, o, c in zip("xyz", low, ("ix", "iy", "iz"), strict=True)]
    return points.join(near, "point_id").select("*", *cell).join(grid, ["ix", "iy", "iz"], "left").withColumn("distance", F.when(F.coalesce("v", F.lit(0.0)) >= level, -F.col("_d")).otherwise(F.col("_d"))).drop("_d", "v", "ix", "iy", "iz")


def proximity_histogram(near: DataFrame, shell: float, numerator, denominator=None) -> DataFrame:
    """By shell of signed distance: numerator over denominator points (default: all)."""
    den = F.count("*") if denominator is None else F.sum(F.when(denominator, 1).otherwise(0))
    out = near.groupBy(F.floor(F.col("distance") / F.lit(float(shell))).cast("int").alias("shell")).agg(F.sum(F.when(numerator, 1).otherwise(0)).alias("num"), den.alias("den"))
    return out.withColumn("x", (F.col("shell") + 0.5) * F.lit(float(shell))).withColumn("fraction", F.col("num") / F.expr("nullif(den, 0)"))


def trilinear(points: DataFrame, grid: DataFrame, low: Vec, edge: float) -> DataFrame:
    """Add ``sampled``: the grid between the eight nearest cell centres, absent cells being 0."""
    parts = []
    frames = {a: (F.col(a) - F.lit(float(o))) / F.lit(float(edge)) - 0.5 for a, o in zip("xyz", low, strict=True)}
    for k in range(8):
        bits = [k & 1, k >> 1 & 1, k >> 2]
        weight = None
        for bit, u in zip(bits, frames.values(), strict=True):
            f = u - F.floor(u)
            w = f if bit else 1 - f
            weight = w if weight is None else weight * w
        parts.append(F.struct(*((F.floor(u) + bit).cast("int").alias(c) for bit, u, c in zip(bits, frames.values(), ("ix", "iy", "iz"), strict=True)), weight.alias("w")))
    spread = points.select("point_id", F.explode(F.array(*parts)).alias("c")).select("point_id", "c.*")
    sums = spread.join(grid, ["ix", "iy", "iz"]).groupBy("point_id").agg(F.sum(F.col("w") * F.col("v")).alias("sampled"))
    return points.join(sums, "point_id", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0.0)))


def angle(a: Vec, b: Vec, c: Vec, reflex: bool = False) -> float:
    """Angle at ``b`` in degrees."""
    u, v = Vec(*(p - q for p, q in zip(a, b, strict=True))).unit(), Vec(*(p - q for p, q in zip(c, b, strict=True))).unit()
    out = math.degrees(math.acos(max(-1.0, min(1.0, u.dot(v)))))
    return 360 - out if reflex else out


def ticks(start: float, end: float, step: float | None = None, n: int | None = None) -> list[float]:
    """Marks from start to end, by step or by number."""
    if n is not None:
        return [start + (end - start) * k / max(n - 1, 1) for k in range(n)]
    if not step:
        raise ValueError("a step or a number")
    return [start + k * step for k in range(math.floor((end - start) / step + 1e-9) + 1)]
