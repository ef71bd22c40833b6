"""Writing the results of plans: chosen streams, and one folder for each frame of an animation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pointloom.plans import spec
from pointloom.sources import sinks

#: How a table is written, by format.
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "parquet": lambda df, path: df.write.parquet(path),
    "text": sinks.write_text,
    "pos": sinks.write_pos,
    "plot": sinks.write_plot,
}


def export(tables: dict[str, DataFrame], folder: str, form: str = "parquet", selected: list[str] | None = None) -> dict[str, str]:
    """Write the selected tables (default: all), each to a place of its own in the folder; where each went.

    A name that is selected but not there is an error, before anything is written.
    """
    chosen = list(tables) if selected is None else selected
    if missing := [name for name in chosen if name not in tables]:
        raise ValueError(f"no such results: {missing}")
    places = {}
    for k, name in enumerate(chosen):
        places[name] = f"{folder.rstrip('/')}/{k:03d}-{name.strip('/').replace('/', '_').replace(':', '-')}"
        WRITERS[form](tables[name], places[name])
    return places


def animated(node: spec.Node, properties: list[tuple[str, str, Callable[[int], Any]]], frames: list[int]) -> Iterator[tuple[int, spec.Node]]:
    """The plan of each frame: parameter ``name`` of the operator at ``path`` set to its value there."""
    for frame in frames:
        plan = node
        for path, name, value in properties:
            plan = spec.sweep(plan, path, name, [value(frame)])[0]
        yield frame, plan


def export_frames(spark: SparkSession, sf_dir: str, node: spec.Node, properties: list[tuple[str, str, Callable[[int], Any]]], frames: list[int], folder: str, form: str = "parquet", selected: list[str] | None = None) -> dict[int, dict[str, str]]:
    """Run the plan of each frame and write its results to ``frame-00000`` and so on."""
    return {frame: export(spec.run(spark, sf_dir, plan), f"{folder.rstrip('/')}/frame-{frame:05d}", form, selected) for frame, plan in animated(node, properties, frames)}
