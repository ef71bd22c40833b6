"""Point files: fixed-length float records, ATO records and delimited text.

Binary files are read by Hadoop's fixed-length record format, so one file is
split over many tasks and any store works; records travel in Arrow batches and
are decoded by numpy.  Headers, sizes and byte order come from small driver-side reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "x double, y double, z double, value double"
#: ATO: bytes of the header, floats of a record, and how many records settle the byte order.
ATO_HEADER, ATO_FLOATS, ATO_PROBE = 8, 14, 100


def _size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def _records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``value``: the file's records of ``width`` bytes; Hadoop splits the file, and no record passes through Python alone."""
    context = spark.sparkContext._jsc.sc()
    rdd = context.binaryRecords(path, width, context.hadoopConfiguration())
    binary = spark._jvm.org.apache.spark.sql.Encoders.BINARY()
    return DataFrame(spark._jsparkSession.createDataset(rdd, binary).toDF(), spark)


def _table(records: pa.Array, kind: str, columns: int) -> np.ndarray:
    """The records of an Arrow column as rows of finite numbers."""
    raw = b"".join(records.to_pylist())
    table = np.frombuffer(raw, kind).reshape(-1, columns).astype(float)
    if not np.isfinite(table).all():
        raise ValueError("the file has values that are not finite")
    return table


def read_pos(spark: SparkSession, path: str, columns: int = 4, picked: tuple[int, int, int, int] = (0, 1, 2, 3), kind: str = ">f4") -> DataFrame:
    """Records of ``columns`` big-endian 32-bit floats, four of them picked.

    The size must be a positive multiple of the record; values must be finite.
    """
    size = _size(spark, path)
    width = columns * np.dtype(kind).itemsize
    if not size or size % width:
        raise ValueError(f"{path}: {size} bytes are no positive multiple of {width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(batch.column(0), kind, columns)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in picked], names=["x", "y", "z", "value"])

    return _records(spark, path, width).mapInArrow(run, POINT)


def sampled(points: DataFrame, limit: int, seed: int) -> DataFrame:
    """All rows, or exactly ``limit`` at random."""
    return points.orderBy(F.rand(seed)).limit(limit)


def ato_order(head: bytes) -> str:
    """Byte order of the records that follow a header: the one with sensible values, else little-endian."""
    good = []
    body = head[ATO_HEADER:]
    body = body[: len(body) // (4 * ATO_FLOATS) * 4 * ATO_FLOATS]
    for kind in ("<f4", ">f4"):
        t = np.frombuffer(body, kind).reshape(-1, ATO_FLOATS)
        finite = bool(np.isfinite(t).all())
        sane = finite and bool((t[:, 3] >= -1000).all() and (np.abs(t[:, [6, 10, 11]]) <= 1000).all())
        good.append((finite, sane))
    (little, little_sane), (big, big_sane) = good
    if little != big:
        return "<f4" if little else ">f4"
    return ">f4" if big_sane and not little_sane else "<f4"


def read_ato(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """ATO records: position and value of each (the first four of fourteen floats).

    The header's eight bytes do not fit the record length, so a file is read as
    one value; such files hold one measurement.
    """
    head = _head(spark, path, ATO_HEADER + ATO_PROBE * 4 * ATO_FLOATS)
    version = {int.from_bytes(head[4:8], e) for e in ("little", "big")}
    if len(head) <= ATO_HEADER or not version & {1, 2, 3, 4}:
        raise ValueError(f"{path}: no ATO header")
    kind = order or ato_order(head)
    if (_size(spark, path) - ATO_HEADER) % (4 * ATO_FLOATS):
        raise ValueError(f"{path}: the last record is cut off")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                t = np.frombuffer(content, kind, offset=ATO_HEADER).reshape(-1, ATO_FLOATS)[:, :4].astype(float)
                if not np.isfinite(t).all():
                    raise ValueError("the file has values that are not finite")
                for at in range(0, len(t), 1 << 16):
                    yield pd.DataFrame(t[at : at + (1 << 16)], columns=["x", "y", "z", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, POINT)


_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


#: Lines among which the first numeric one must be.
HEADER = 1000


def read_text(spark: SparkSession, path: str, delimiters: str = "\t ,") -> DataFrame:
    """Rows of three numbers (value 1) or four; lines before the first numeric one are header.

    Every other row must have the same number of fields, all numeric; else
    reading fails.  A folder's files may each begin with the header's lines.
    """
    gap = f"[{re.escape(delimiters)}]+"
    lines = spark.read.text(path).select(F.btrim("value", F.lit(delimiters + "\r")).alias("line")).where("line <> ''")
    numeric = f"^{_NUMBER}({gap}{_NUMBER})*$"
    head = [r["line"] for r in lines.limit(HEADER).collect()]
    first = next((k for k, line in enumerate(head) if re.match(numeric, line)), None)
    if first is None:
        raise ValueError(f"{path}: no numeric rows")
    n = len(re.split(gap, head[first]))
    if n not in (3, 4):
        raise ValueError(f"{path}: {n} columns; 3 or 4 expected")
    rows = lines.where(~F.col("line").isin(head[:first])) if first else lines
    good = F.col("line").rlike(numeric) & (F.size(F.split("line", gap)) == n)
    checked = F.when(good, F.split("line", gap)).otherwise(F.raise_error(F.concat(F.lit(f"not a row of {n} numbers: "), F.col("line"))))
    rows = rows.select(checked.alias("p"))
    names = ["x", "y", "z", "value"]
    return rows.select(*(F.col("p")[k].cast("double").alias(names[k]) for k in range(n)), *([F.lit(1.0).alias("value")] if n == 3 else []))


def read_table(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """Delimited strings as an array column ``fields``."""
    return spark.read.text(path).select(F.split("value", re.escape(delimiter)).alias("fields"))


def read_voxels(spark: SparkSession, path: str, shape: tuple[int, int, int], kind: str = "<f4") -> DataFrame:
    """Raw dense grid, the first axis running fastest, as sparse cells (zeros left out)."""
    nx, ny, _ = shape
    width = np.dtype(kind).itemsize
    if _size(spark, path) != width * nx * ny * shape[2]:
        raise ValueError(f"{path}: the size does not fit {shape}")
    plane, rows = width * nx, ny * shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(batch.column("value"), kind, nx)
            row, ix = np.nonzero(table)
            at = batch.column("row").to_numpy()[row]
            columns = [ix, at % ny, at // ny]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(table[row, ix])], names=["ix", "iy", "iz", "v"])

    # a row of cells is one record; its number follows from the rows of the partitions before
    records = _records(spark, path, plane).withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    sizes = {r["part"]: (r["n"], r["least"]) for r in records.groupBy("part").agg(F.count("*").alias("n"), F.min("i").alias("least")).collect()}
    before, shift = 0, F.lit(None).cast("long")
    for part, (n, least) in sorted(sizes.items()):
        shift = F.when(F.col("part") == part, F.lit(before - least)).otherwise(shift)
        before += n
    if before != rows:
        raise ValueError(f"{path}: {before} rows of cells, not {rows}")
    return records.select("value", (F.col("i") + shift).alias("row")).mapInArrow(run, "ix int, iy int, iz int, v double")


#: A scan without a limit of its own keeps at most so many points: 5 MiB of records of 16 bytes.
SCAN_LIMIT = 5 * (1 << 20) // 16
KINDS = {"pos": "pos", "ato": "ato", "txt": "text", "csv": "text", "tsv": "text", "dat": "text"}


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Time of change and size of a file; None if it is not there.  A scan is due again where this differs."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    status = store.getFileStatus(where)
    return status.getModificationTime(), status.getLen()


def scan(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = SCAN_LIMIT, seed: int = 0, label: str | None = None, enabled: bool = True, monitored: bool = False, upstream: DataFrame | None = None, **options) -> DataFrame:
    """Points of a file by its kind (else by its extension), at most ``limit`` at random, after those from upstream.

    A disabled scan, or a monitored one whose file is missing, hands on upstream only.
    """
    if not enabled or (monitored and stamp(spark, path) is None):
        own = spark.createDataFrame([], POINT)
    else:
        kind = kind or KINDS.get(path.rstrip("/").rpartition(".")[2].lower())
        readers = {"pos": read_pos, "ato": read_ato, "text": read_text}
        if kind not in readers:
            raise ValueError(f"{path}: no kind of point file is known by its name; state one of {sorted(readers)}")
        own = readers[kind](spark, path, **options)
        own = own if limit is None else sampled(own, limit, seed)
    if label is not None:
        own = own.withColumn("label", F.lit(label))
    return own if upstream is None else upstream.unionByName(own, allowMissingColumns=True)


def scan_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What a program left in a folder, by file name: points of each non-empty ``.pos`` file, pairs of ``.xy`` files.

    A file of pairs gives ``series`` (the number of its column), ``x`` (its first
    column) and ``y``; lines that are not all numbers are its header.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, DataFrame] = {}
    for status in store.listStatus(where) if store.exists(where) else ():
        name, path = status.getPath().getName(), status.getPath().toString()
        if status.isDirectory() or not status.getLen():
            continue
        if name.lower().endswith(".pos"):
            out[name] = read_pos(spark, path)
        elif name.lower().endswith(".xy"):
            parts = spark.read.text(path).select(F.filter(F.split("value", "[\t ,]+"), lambda p: p != "").alias("p"))
            numbers = parts.select(F.transform("p", lambda p: p.try_cast("double")).alias("p")).where("size(p) > 1 and not exists(p, v -> v is null)")
            out[name] = numbers.select(F.col("p")[0].alias("x"), F.posexplode(F.slice("p", 2, F.size("p"))).alias("series", "y")).select("series", "x", "y")
    return out
