"""Watching a folder of point files: results follow as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pointloom.sources import points_files

SCHEMA = "point_id long, x double, y double, z double, value double"


def watch(spark: SparkSession, folder: str, schema: str = SCHEMA, per_trigger: int = 64) -> DataFrame:
    """New Parquet point files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def recompute(stream: DataFrame, work: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Aggregate everything seen so far after each trigger and replace the table at ``to``."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(to)

    query = work(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


class Watched:
    """A point file that is read again when its time of change or its size differs.

    ``current`` gives the table as of now and whether it is a new one; while the
    file is missing it is what comes from upstream, or no points.
    """

    def __init__(self, spark: SparkSession, path: str, upstream: DataFrame | None = None, **options):
        self.spark, self.path, self.upstream, self.options = spark, path, upstream, options
        self.seen: tuple[int, int] | None | str = "never"
        self.table: DataFrame | None = None

    def current(self) -> tuple[DataFrame, bool]:
        now = points_files.stamp(self.spark, self.path)
        fresh = now != self.seen
        if fresh:
            self.table = points_files.scan(self.spark, self.path, monitored=True, upstream=self.upstream, **self.options)
            self.seen = now
        return self.table, fresh
