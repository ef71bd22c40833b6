"""Writers: point files, text, VTK, plots and voxels.

Each task writes its rows as one part of a folder; ``single`` merges into one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(points: DataFrame, path: str) -> None:
    """``x y z value`` by line."""
    points.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "z", "value"))).alias("value")).write.text(path)


def pos_bytes(points: DataFrame) -> DataFrame:
    """Blocks of big-endian 32-bit floats, one value for each Arrow batch."""

    def run(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                yield pd.DataFrame({"content": [b[["x", "y", "z", "value"]].to_numpy(">f4").tobytes()]})

    return points.select("x", "y", "z", "value").mapInPandas(run, "content binary")


def write_pos(points: DataFrame, path: str) -> None:
    """One file of point records, written through Hadoop block by block on the driver's stream.

    Blocks are fetched one partition at a time, so the driver holds one of them.
    """
    spark = points.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for row in pos_bytes(points).toLocalIterator():
            out.write(bytes(row["content"]))
    finally:
        out.close()


def write_plot(plot: DataFrame, path: str) -> None:
    """Tab-separated columns with a header."""
    plot.coalesce(1).write.csv(path, sep="\t", header=True)


def plot_grid(plots: DataFrame) -> DataFrame:
    """Series side by side: one row for each x."""
    return plots.groupBy("x").pivot("series").agg(F.first("y")).orderBy("x")


def _single(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.text(path)


def write_points_vtk(points: DataFrame, path: str) -> None:
    """Legacy ASCII unstructured grid; header, positions and values in one part."""
    n = points.count()
    spark = points.sparkSession
    keyed = points.select(F.monotonically_increasing_id().alias("i"), "x", "y", "z", "value")
    head = spark.createDataFrame([(0, -1, "# vtk DataFile Version 3.0\npoints\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS %d float" % n), (2, -1, f"POINT_DATA {n}\nSCALARS value float\nLOOKUP_TABLE default")], "part int, i long, value string")
    where = keyed.select(F.lit(1).alias("part"), "i", F.concat_ws(" ", "x", "y", "z").alias("value"))
    what = keyed.select(F.lit(3).alias("part"), "i", F.col("value").cast("string").alias("value"))
    _single(head.unionByName(where).unionByName(what).orderBy("part", "i").select("value"), path)


def write_voxels_vtk(grid: DataFrame, shape: tuple[int, int, int], path: str) -> None:
    """Legacy ASCII structured points, the first axis running fastest, zeros included."""
    nx, ny, nz = shape
    spark = grid.sparkSession
    dense = spark.range(nx * ny * nz).join(grid.select((F.col("ix") + nx * (F.col("iy") + ny * F.col("iz").cast("long"))).alias("id"), "v"), "id", "left")
    head = spark.createDataFrame([(-1, f"# vtk DataFile Version 3.0\nvoxels\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {nx * ny * nz}\nSCALARS v float\nLOOKUP_TABLE default")], "id long, value string")
    _single(head.unionByName(dense.select("id", F.coalesce("v", F.lit(0.0)).cast("string").alias("value"))).orderBy("id").select("value"), path)


def voxel_bytes(grid: DataFrame, shape: tuple[int, int, int], kind: str = "<f4") -> bytes:
    """A dense raw grid; for grids that fit the driver (the caller states the shape)."""
    out = np.zeros(shape[::-1], kind)
    for r in grid.toLocalIterator():
        out[r["iz"], r["iy"], r["ix"]] = r["v"]
    return out.tobytes()
