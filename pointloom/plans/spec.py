"""Pipelines as data: a tree of named operators, checked, saved as JSON and run.

A spec is ``{"op": name, "params": {...}, "children": [...]}``; the root reads,
each child gets its parent's table.  Results of leaves come back by path.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pointloom import points as pt
from pointloom.operators import bins, clusters, ranging, rowops, spatial
from pointloom.points import Vec


@dataclass(frozen=True)
class Node:
    op: str
    params: dict[str, Any] = field(default_factory=dict)
    children: tuple[Node, ...] = ()

    def walk(self, path: str = "") -> Iterator[tuple[str, Node, tuple[Node, ...]]]:
        yield from self._walk(f"{path}/{self.op}", ())

    def _walk(self, path: str, above: tuple[Node, ...]) -> Iterator[tuple[str, Node, tuple[Node, ...]]]:
        yield path, self, above
        for k, child in enumerate(self.children):
            yield from child._walk(f"{path}/{k}:{child.op}", (*above, self))


@dataclass(frozen=True)
class Operator:
    """How to run an operator, and what the checks need to know."""

    run: Callable[..., DataFrame]
    makes: str = "points"
    needs_ranges: bool = False
    samples: bool = False
    moves: bool = False
    local: bool = False


def _vec(v) -> Vec:
    return v if isinstance(v, Vec) else Vec(*v)


def _table(spec) -> ranging.RangeTable:
    if isinstance(spec, ranging.RangeTable):
        return spec
    return ranging.RangeTable(tuple(ranging.Ion(*i) for i in spec["ions"]), tuple(ranging.Range(*r) for r in spec["ranges"])).checked()


OPERATORS: dict[str, Operator] = {
    "lineitem": Operator(lambda spark, sf_dir, **_: pt.lineitem_points(spark, sf_dir)),
    "events": Operator(lambda spark, sf_dir, **_: pt.event_points(spark, sf_dir)),
    "parquet": Operator(lambda spark, sf_dir, path: spark.read.parquet(path)),
    "translate": Operator(lambda df, origin: rowops.translate(df, _vec(origin)), moves=True),
    "scale": Operator(lambda df, factor, origin=(0, 0, 0): rowops.scale(df, _vec(factor) if isinstance(factor, (list, tuple)) else factor, _vec(origin)), moves=True),
    "rotate": Operator(lambda df, axis, degrees, origin=(0, 0, 0): rowops.rotate(df, _vec(axis), degrees, _vec(origin)), moves=True),
    "translate_value": Operator(lambda df, by: rowops.translate_value(df, by)),
    "clip_sphere": Operator(lambda df, centre, radius, invert=False: rowops.clip(df, rowops.in_sphere(_vec(centre), radius), invert)),
    "clip_plane": Operator(lambda df, origin, normal, invert=False: rowops.clip(df, rowops.in_front(_vec(origin), _vec(normal)), invert)),
    "clip_cylinder": Operator(lambda df, origin, axis, radius, invert=False: rowops.clip(df, rowops.in_cylinder(_vec(origin), _vec(axis), radius), invert)),
    "clip_box": Operator(lambda df, centre, half, invert=False: rowops.clip(df, rowops.in_box(_vec(centre), _vec(half)), invert)),
    "crop_value": Operator(lambda df, low, high: rowops.crop_value(df, low, high)),
    "sample": Operator(lambda df, fraction, seed=0: rowops.sample_fraction(df, fraction, seed), samples=True),
    "range": Operator(lambda df, table, drop_unranged=True: ranging.keep_ranged(df, _table(table), drop_unranged), makes="ranged"),
    "composition": Operator(lambda df, table: ranging.composition(df, _table(table)), makes="table"),
    "spectrum": Operator(lambda df, low, high, width: bins.spectrum(df, low, high, width), makes="plot"),
    "profile": Operator(lambda df, origin, axis, radius, n, by=None, min_events=10: bins.profile(df, bins.axial_bin(_vec(origin), _vec(axis), radius, n), n, by, min_events), makes="plot"),
    "voxels": Operator(lambda df, shape: bins.voxels(df, tuple(shape)), makes="voxels"),
    "density": Operator(lambda df, radius=None, k=None: spatial.local_density(df, radius, k), local=True),
    "density_filter": Operator(lambda df, cutoff, keep_upper=True, radius=None, k=None: spatial.density_filter(df, cutoff, keep_upper, radius, k), local=True),
    "rdf": Operator(lambda df, radius, n: spatial.radial_distribution(df, df, radius, n), makes="plot", local=True),
    "cluster": Operator(lambda df, core, link: clusters.cluster(df.where(df["ion"].isin(core)), None, link), makes="clusters", needs_ranges=True, local=True),
    "colour": Operator(lambda df, name, low, high: rowops.colour(df, name, low, high)),
}


def load(text: str) -> Node:
    def build(d: dict) -> Node:
        return Node(d["op"], dict(d.get("params", {})), tuple(build(c) for c in d.get("children", [])))

    return build(json.loads(text))


def save(node: Node) -> str:
    def plain(n: Node) -> dict:
        return {"op": n.op, "params": n.params, "children": [plain(c) for c in n.children]}

    return json.dumps(plain(node), indent=1, default=list)


def lint(node: Node) -> list[str]:
    """Warnings: operators without effect, local measures after sampling, missing ranges, altered composition."""
    out = []
    for path, n, above in node.walk():
        if n.op not in OPERATORS:
            out.append(f"{path}: unknown operator")
            continue
        op = OPERATORS[n.op]
        known = [OPERATORS[a.op] for a in above if a.op in OPERATORS]
        if known and known[-1].makes in ("plot", "table", "voxels", "clusters"):
            out.append(f"{path}: its parent hands on no points")
        if op.local and any(a.samples for a in known):
            out.append(f"{path}: neighbours are counted after sampling")
        if op.needs_ranges and not any(a.makes == "ranged" for a in known):
            out.append(f"{path}: no range operator above")
        if n.op == "composition" and any(a.op in ("crop_value", "translate_value") for a in above):
            out.append(f"{path}: values were changed or cropped before")
        if n.op == "composition" and any(a.op == "range" and a.params.get("drop_unranged", True) for a in above):
            out.append(f"{path}: unranged points were dropped before")
    return out


def run(spark: SparkSession, sf_dir: str, node: Node) -> dict[str, DataFrame]:
    """Tables of all leaves, lazily; Spark plans each as a whole."""
    out: dict[str, DataFrame] = {}

    def visit(n: Node, path: str, df: DataFrame | None) -> None:
        op = OPERATORS[n.op]
        made = op.run(spark, sf_dir, **n.params) if df is None else op.run(df, **n.params)
        if not n.children:
            out[path] = made
        for k, child in enumerate(n.children):
            visit(child, f"{path}/{k}:{child.op}", made)

    visit(node, f"/{node.op}", None)
    return out


def sweep(node: Node, path: str, name: str, values: list) -> list[Node]:
    """Copies of a spec in which one parameter takes each value (frames of an animation)."""

    def changed(n: Node, at: str, value) -> Node:
        params = {**n.params, name: value} if at == path else n.params
        return Node(n.op, params, tuple(changed(c, f"{at}/{k}:{c.op}", value) for k, c in enumerate(n.children)))

    return [changed(node, f"/{node.op}", v) for v in values]


def frames(keys: list[tuple[int, Any]], mode: str = "linear") -> Callable[[int], Any]:
    """Value of a property at a frame: ``step``, ``linear`` (numbers and lists of numbers) or ``list``."""
    keys = sorted(keys)

    def at(frame: int):
        before = [k for k in keys if k[0] <= frame]
        after = [k for k in keys if k[0] > frame]
        if not before:
            return keys[0][1]
        if mode == "step" or not after:
            return before[-1][1]
        (f0, a), (f1, b) = before[-1], after[0]
        if mode == "list":
            return a[min(frame - f0, len(a) - 1)]
        t = (frame - f0) / (f1 - f0)
        mix = lambda p, q: p + (q - p) * t
        return [mix(p, q) for p, q in zip(a, b, strict=True)] if isinstance(a, (list, tuple)) else mix(a, b)

    return at
