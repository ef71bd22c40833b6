"""Lineage cuts in the folder that every executor shares.

``spark.checkpoint.dir`` names that folder on a cluster.  Only where it is
unset (unit tests on one machine) a temporary one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_local: list[str] = []
_owner: ContextVar[str] = ContextVar("owner", default="")


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="pointloom-"))
    return _local[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for path in [p for paths in _made.values() for p in paths]:
        try:
            spark = SparkSession.getActiveSession()
            if spark is not None:
                _remove(spark, path)
        except Exception:  # the session may already be gone at interpreter exit
            return


atexit.register(_clean)


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Tables that ``cut`` writes within belong to ``name``."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Parquet is several times smaller than a row checkpoint and survives lost
    executors alike.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.setdefault(_owner.get(), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the tables written within ``owned(owner)``; nothing may read them any more."""
    for path in _made.pop(owner, []):
        _remove(spark, path)
