"""Cube models in YAML, with the tags of the format: !SimpleCuboid, !HexDimension and so on.

A model is a list ``[name, dimensions, cuboids, measures]`` with, as a fifth
item, functions. Cuboids refer to dimensions by anchors; a cuboid is either
``!SimpleCuboid [[*a, *b]]`` or a mapping with dimensions, hbaseTTL,
hbaseInMemory, hbaseMaxVersions and compilerGroup.
"""

from __future__ import annotations

from typing import Any

import yaml

from facetcube.functions.aggregates import SummaryFunction, canny_avg, canny_rate, registered
from facetcube.functions.summarizers import Summarizer
from facetcube.model import Cube, Cuboid, DateHierarchy, Dimension, HexDimension, Hierarchy, IrregularSampleMeasure, ModelError, NumericMeasure, TimeHourHierarchy, UTF8CharDimension

DEFAULT_TTL = 90 * 24 * 3600


class _Loader(yaml.SafeLoader):
    pass


def _cuboid(dims: list[Dimension], **more: Any) -> Cuboid:
    return Cuboid(tuple(d.name for d in dims), **more)


def _of_list(make):
    def construct(loader: yaml.SafeLoader, node: yaml.Node):
        args = loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else [loader.construct_scalar(node)]
        try:
            return make(*args)
        except (TypeError, ValueError) as e:
            raise ModelError(f"{node.tag}: {e}") from None

    return construct


def _simple_cuboid(loader: yaml.SafeLoader, node: yaml.Node) -> Cuboid:
    if isinstance(node, yaml.SequenceNode):
        return _cuboid(*loader.construct_sequence(node, deep=True)[:1], ttl=DEFAULT_TTL)
    p = loader.construct_mapping(node, deep=True)
    known = {"dimensions", "hbaseTTL", "hbaseInMemory", "hbaseMaxVersions", "compilerGroup"}
    if extra := set(p) - known:
        raise ModelError(f"cuboid: unknown property {min(extra)}")
    return _cuboid(p["dimensions"], ttl=int(p.get("hbaseTTL", DEFAULT_TTL)), in_memory=bool(p.get("hbaseInMemory", False)), max_versions=int(p.get("hbaseMaxVersions", 1)), compiler_group=p.get("compilerGroup"))


for _tag, _make in {
    "HexDimension": HexDimension, "UTF8CharDimension": UTF8CharDimension, "SimpleTimeHourHierarchy": TimeHourHierarchy,
    "SimpleTimeHierarchy": TimeHourHierarchy, "SimpleDateHierarchy": DateHierarchy, "NumericMeasure": NumericMeasure, "SimpleMeasure": NumericMeasure,
    "IrregularSampleMeasure": IrregularSampleMeasure, "Function": registered, "FCannyAvgSum": canny_avg, "FCannyRateSum": canny_rate,
    "FExpAvgSum": lambda name, ordinal, dt: SummaryFunction(name, int(ordinal), Summarizer("exp_avg", float(dt))),
    "FExpRateSum": lambda name, ordinal, dt: SummaryFunction(name, int(ordinal), Summarizer("exp_rate", float(dt))),
}.items():
    _Loader.add_constructor(f"!{_tag}", _of_list(_make))
_Loader.add_constructor("!SimpleCuboid", _simple_cuboid)


def load_cube(text: str) -> Cube:
    """The cube of a YAML text."""
    try:
        items = yaml.load(text, _Loader)
    except yaml.YAMLError as e:
        raise ModelError(str(e)) from None
    if not isinstance(items, list) or len(items) not in (4, 5):
        raise ModelError("a model is a list of name, dimensions, cuboids, measures and, if need be, functions")
    return Cube.of(*items)


def _kind(d: Dimension) -> tuple[str, list]:
    tail = [] if d.nullkey is None else [d.nullkey]
    if isinstance(d, HexDimension):
        return "HexDimension", [d.name, d.keylen, *tail]
    if isinstance(d, UTF8CharDimension):
        return "UTF8CharDimension", [d.name, d.length, d.auto_truncate, *tail]
    if isinstance(d, Hierarchy):
        return "SimpleTimeHourHierarchy" if d.depth == 2 else "SimpleDateHierarchy", [d.name, *tail]
    raise ModelError(f"dimension {d.name}: {type(d).__name__} has no tag")


def _flow(x: list) -> str:
    return yaml.safe_dump(x, default_flow_style=True, width=10**6).strip()


def dump_cube(cube: Cube) -> str:
    """YAML that ``load_cube`` turns into an equal cube."""
    at = {n: f"d{i}" for i, n in enumerate(cube.dimensions)}
    out = [f"- {_flow([cube.name])[1:-1]}", "-"]
    out += [f"  - &{at[n]} !{k} {_flow(a)}" for n, d in cube.dimensions.items() for k, a in [_kind(d)]]
    out.append("-")
    for c in cube.cuboids:
        more = {"hbaseTTL": c.ttl, "hbaseInMemory": c.in_memory, "hbaseMaxVersions": c.max_versions} | ({"compilerGroup": c.compiler_group} if c.compiler_group else {})
        out.append(f"  - !SimpleCuboid {{dimensions: [{', '.join('*' + at[d] for d in c.dims)}], {_flow(more)[1:-1]}}}")
    out.append("-")
    out += [f"  - !{type(m).__name__} {_flow([m.name])}" for m in cube.measures.values()]
    tags = {"canny_avg": "FCannyAvgSum", "canny_rate": "FCannyRateSum", "exp_avg": "FExpAvgSum", "exp_rate": "FExpRateSum"}
    if cube.functions:
        out.append("-")
        out += [f"  - !{tags[f.summarizer.kind]} {_flow([f.name, f.ordinal, f.summarizer.dt])}" if isinstance(f, SummaryFunction) else f"  - !Function {_flow([f.name])}" for f in cube.functions.values()]
    return "\n".join(out) + "\n"
