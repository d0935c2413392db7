"""Aggregate queries over cubes, as a fluent builder. The result is an ordinary DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetcube.functions.aggregates import STANDARD, SummaryFunction
from facetcube.model import Cube, ModelError
from facetcube.functions.folding import Plain
from facetcube.operators.compile import merge_cells, read_cells, unexpired, within
from facetcube.plans.planner import Slice, find_cuboid, predicates, sliced_span
from facetcube.sources.catalog import Catalog


@dataclass(frozen=True)
class Item:
    """An item of the select list: a dimension (no function) or a function of a measure."""

    alias: str
    name: str
    function: str | None = None


class CubeQuery:
    """Measures, slices and groups; ``execute`` gives the rows.

    Without groups there is one row, or none if no cell matches. A hierarchy
    that is not sliced is read at ALL. At most one slice a dimension.
    """

    def __init__(self, catalog: Catalog, cube: Cube | str | None = None, strict: bool = False):
        self.catalog, self.strict, self.cube = catalog, strict, None
        self.items: list[Item] = []
        self.slices: list[Slice] = []
        self.groups: list[str] = []
        self.levels: dict[str, int] = {}
        self.multi = False
        self.as_members = False
        self.in_order = False
        self.now: int | None = None
        self.state_of: list[tuple[str, str]] = []
        if cube is not None:
            self.set_cube(cube)

    def set_cube(self, cube: Cube | str) -> CubeQuery:
        self.cube = self.catalog.load_model(cube) if isinstance(cube, str) else cube
        return self

    def reset(self) -> CubeQuery:
        """Drop measures, slices and groups; the cube stays."""
        self.items, self.slices, self.groups, self.levels, self.state_of = [], [], [], {}, []
        return self

    def _cube(self) -> Cube:
        if self.cube is None:
            raise ModelError("the query has no cube")
        return self.cube

    def _add(self, item: Item) -> CubeQuery:
        if any(i.alias == item.alias for i in self.items):
            raise ModelError(f"Duplicate alias {item.alias}")
        self.items.append(item)
        return self

    def select(self, function: str, measure: str, alias: str | None = None) -> CubeQuery:
        """Add ``FUNCTION(measure)``; its alias is ``FUNCTION_measure`` unless given."""
        cube = self._cube()
        if measure not in cube.measures:
            raise ModelError(f"Unknown measure {measure}")
        cube.function(function)
        return self._add(Item(alias or f"{function}_{measure}", measure, function))

    def select_dimension(self, dim: str, alias: str | None = None) -> CubeQuery:
        """Add a dimension: one that is grouped by, or sliced to a point."""
        self._dim(dim)
        return self._add(Item(alias or dim, dim))

    def select_state(self, function: str, measure: str, alias: str | None = None) -> CubeQuery:
        """Add the merged state struct of a summary, for further algebra."""
        if not isinstance(self._cube().function(function), SummaryFunction):
            raise ModelError(f"{function} has no state of its own")
        self.state_of.append((measure, function))
        return self._add(Item(alias or f"{function}_{measure}_state", measure, function + "#state"))

    def add_measure(self, measure: str) -> CubeQuery:
        """Add all functions that a measure has, as ``FUNCTION_measure``."""
        cube = self._cube()
        if measure not in cube.measures:
            raise ModelError(f"Unknown measure {measure}")
        m = cube.measures[measure]
        own = [n for n, f in cube.functions.items() if isinstance(f, SummaryFunction) == m.samples]
        for name in (["COUNT"] if m.samples else [*STANDARD]) + own:
            self.select(name, measure)
        return self

    def _dim(self, dim: str) -> None:
        if dim not in self._cube().dimensions:
            raise ModelError(f"Unknown dimension {dim}")

    def add_group_by(self, *dims: str) -> CubeQuery:
        for d in dims:
            self._dim(d)
            if self._cube().dimensions[d].depth:
                raise ModelError(f"{d} is a hierarchy: group by one of its levels with group_by_level")
            if d not in self.groups:
                self.groups.append(d)
        return self

    def group_by_level(self, dim: str, level: int) -> CubeQuery:
        """Extension: group by the members of one level of a hierarchy."""
        self._dim(dim)
        if not 1 <= level <= self._cube().dimensions[dim].depth:
            raise ModelError(f"{dim} has no level {level}")
        self.levels[dim] = level
        if dim not in self.groups:
            self.groups.append(dim)
        return self

    def allow_several_slices(self) -> CubeQuery:
        """Extension: several slices a dimension, which must not overlap, add up."""
        self.multi = True
        return self

    def add_slice(self, dim: str, left: Any, left_open: bool, right: Any, right_open: bool, complement: bool = False) -> CubeQuery:
        """Slice a dimension; None is no bound, two of them drop the dimension's slice."""
        self._dim(dim)
        if left is None and right is None:
            self.slices = [s for s in self.slices if s.dim != dim]
            return self
        if not self.multi and any(s.dim == dim for s in self.slices):
            raise ModelError(f"more than one slice for dimension {dim}")
        self.slices.append(Slice(dim, left, left_open, right, right_open, complement))
        return self

    def add_closed_slice(self, dim: str, left: Any, right: Any) -> CubeQuery:
        return self.add_slice(dim, left, False, right, False)

    def add_open_slice(self, dim: str, left: Any, right: Any) -> CubeQuery:
        return self.add_slice(dim, left, True, right, True)

    def add_half_open_slice(self, dim: str, left: Any, right: Any) -> CubeQuery:
        return self.add_slice(dim, left, False, right, True)

    def add_point_slice(self, dim: str, value: Any) -> CubeQuery:
        return self.add_slice(dim, value, False, value, False)

    def add_complement_slice(self, dim: str, left: Any, right: Any, right_open: bool = True) -> CubeQuery:
        """Everything but an interval: of a hierarchy, ALL less the interval's cells."""
        return self.add_slice(dim, left, False, right, right_open, complement=True)

    def members(self) -> CubeQuery:
        """Give members (bytes, times) instead of keys for selected dimensions."""
        self.as_members = True
        return self

    def ordered(self) -> CubeQuery:
        """Rows in ascending order of the group keys."""
        self.in_order = True
        return self

    def as_of(self, now: int) -> CubeQuery:
        """Judge the age of cells, where the cuboid has a TTL, at this time (seconds) instead of the present."""
        self.now = now
        return self

    @property
    def aliases(self) -> list[str]:
        return [i.alias for i in self.items]

    def cuboid(self):
        """The cuboid that answers the query; one that all of its measures are compiled for, if there is."""
        cube = self._cube()
        asked = {i.name for i in self.items if i.function}

        def complete(c) -> bool:
            return asked <= {m for b in self.catalog.manifest(cube, c).values() for m in b["measures"]}

        return find_cuboid(cube, self.slices, self.groups, self.strict, complete)

    def explain(self) -> str:
        """The cuboid and the predicate that the query comes down to."""
        c = self.cuboid()
        return f"cuboid {c.path}; cells {predicates(self._cube(), c, self.slices, self.levels)[0]}"

    def execute(self) -> DataFrame:
        cube = self._cube()
        wanted = [i for i in self.items if i.function]
        if not wanted:
            raise ModelError("the query has no measures")
        points = {s.dim: s.left for s in self.slices if s.point}
        for i in self.items:
            if not i.function and i.name not in self.groups and i.name not in points:
                raise ModelError(f"dimension {i.name} is selected but neither grouped by nor sliced to a point")
        cuboid = self.cuboid()
        where, weight = predicates(cube, cuboid, self.slices, self.levels)
        fields: dict[str, set[str]] = {}
        for i in wanted:
            f = cube.function(i.function.removesuffix("#state"))
            if weight is not None and not f.supports_complement:
                raise ModelError(f"{f.name} cannot be taken from a complement")
            fields.setdefault(i.name, {"cnt"}).update([f.name] if isinstance(f, SummaryFunction) else [f.name, *f.needs])
        batches = self.catalog.manifest(cube, cuboid)
        if (span := sliced_span(cube, cuboid, self.slices)) is not None:
            batches = within(batches, *span)
        cells = read_cells(self.catalog, cube, cuboid, batches)
        if where is not None:
            cells = cells.filter(where)
        cells = unexpired(cells, cube, cuboid, batches, self.now)
        keys = [f"{g}_key" if g in self.levels else g for g in self.groups]
        merged = merge_cells(cells, keys, cube, list(fields), fields, weight, extra=[Plain("_cells", F.count("_written"), F.sum)])
        if not keys:
            merged = merged.filter("_cells > 0")
        if self.in_order:
            merged = merged.orderBy(*keys)
        return merged.select(*(self._column(cube, merged.columns, i, points).alias(i.alias) for i in self.items))

    def _column(self, cube: Cube, present: Sequence[str], i: Item, points: dict[str, Any]) -> Column:
        if not i.function:
            dim = cube.dimensions[i.name]
            key = F.col(f"{i.name}_key" if i.name in self.levels else i.name) if i.name in self.groups else F.lit(dim.bound(points[i.name]))
            return dim.member(key) if self.as_members else key
        get = lambda c: F.col(f"`{c}`") if c in present else F.lit(None).cast("double")
        f = cube.function(i.function.removesuffix("#state"))
        if isinstance(f, SummaryFunction):
            prefix = f"{i.name}__{f.name}__"
            state = F.when(get(f"{prefix}t").isNotNull(), F.struct(*(get(prefix + x).alias(x) for x in f.summarizer.fields)))
            return state if i.function.endswith("#state") else f.summarizer.value(state)
        return f.final({x: get(f"{i.name}__{x}") for x in {*f.needs, "cnt"}} | {x: get(f"{i.name}__{f.name}__{x}") for x, _ in f.fields})
