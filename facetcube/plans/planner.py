"""Choice of the cuboid, and slices as predicates over its cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetcube.model import Cube, Cuboid, Hierarchy, Member, ModelError, is_unbounded, to_datetime


@dataclass(frozen=True)
class Slice:
    """An interval of a dimension; None or an infinity is no bound. ``complement``: all but the interval."""

    dim: str
    left: Any
    left_open: bool
    right: Any
    right_open: bool
    complement: bool = False

    @property
    def point(self) -> bool:
        """Closed, with equal bounds."""
        return not (self.left_open or self.right_open or self.complement) and self.left is not None and self.left == self.right


def suitable(cuboid: Cuboid, slices: Sequence[Slice], groups: Sequence[str]) -> bool:
    """The strict rule: every group dimension comes before any that is neither grouped nor sliced to a point."""
    left = set(groups)
    for d in cuboid.dims:
        own = [s for s in slices if s.dim == d]
        if d in left:
            left.discard(d)
        elif not (len(own) == 1 and own[0].point) and d not in groups:
            break
    return not left


def find_cuboid(cube: Cube, slices: Sequence[Slice], groups: Sequence[str], strict: bool = False, complete: Callable[[Cuboid], bool] | None = None) -> Cuboid:
    """The cuboid with the fewest dimensions that has all of the query's, the first declared on ties.

    ``strict`` also asks for the prefix rule that sorted scans need; without it
    the rule only breaks ties. ``complete`` prefers cuboids for which it holds.
    """
    need = {s.dim for s in slices} | set(groups)
    found = [c for c in cube.cuboids if need <= set(c.dims) and (not strict or suitable(c, slices, groups))]
    if not found:
        raise ModelError(f"no cuboid of {cube.name} is suitable: it needs the dimensions {sorted(need)}" + (", grouped ones before the others" if strict else ""))
    return min(found, key=lambda c: (not complete(c) if complete else False, len(c.dims), not suitable(c, slices, groups)))


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def flat_predicate(key: Column, left: str | None, left_open: bool, right: str | None, right_open: bool) -> Column | None:
    parts = []
    if left is not None:
        parts.append(key > left if left_open else key >= left)
    if right is not None:
        parts.append(key < right if right_open else key <= right)
    if left is not None and left == right and not (left_open or right_open):
        parts = [key == left]
    return _all(parts) if parts else None


def time_ranges(h: Hierarchy, s: Slice) -> list[tuple[int, str | None, str | None]]:
    """A slice of a hierarchy as (level, least key, largest key), both included; None: unbounded.

    The fine ends of the interval are read at the finest level, what lies
    between whole coarse members at the coarse one. A boundary member that the
    interval covers wholly is read at the coarse level too.
    """
    fine = h.depth
    if isinstance(s.left, Member) or isinstance(s.right, Member):
        level = {m.level for m in (s.left, s.right) if isinstance(m, Member)}
        if len(level) > 1:
            raise ModelError(f"slice of {s.dim}: bounds at different levels")
        fine = level.pop()
    low = None if is_unbounded(s.left) else h.bound(s.left, fine)
    high = None if is_unbounded(s.right) else h.bound(s.right, fine)
    if low is not None and s.left_open:
        low = step(h, low, fine, 1)
    if high is not None and s.right_open:
        high = step(h, high, fine, -1)
    if low is not None and high is not None and low > high:
        return []
    if fine < 2:
        return [(fine, low, high)]
    coarse, n = fine - 1, h.width(fine - 1)
    first = None if low is None else low[:n] if step(h, low, fine, -1)[:n] != low[:n] else step(h, low[:n], coarse, 1)
    last = None if high is None else high[:n] if step(h, high, fine, 1)[:n] != high[:n] else step(h, high[:n], coarse, -1)
    if first is not None and last is not None and first > last:
        return [(fine, low, high)]
    out: list[tuple[int, str | None, str | None]] = [(coarse, first, last)]
    if low is not None and first != low[:n]:
        out.append((fine, low, low[:n] + "9" * (len(low) - n)))
    if high is not None and last != high[:n]:
        out.append((fine, high[:n], high))
    return out


def step(h: Hierarchy, key: str, level: int, by: int) -> str:
    """The next (1) or previous (-1) key of a level."""
    import datetime

    fmt = h.formats[level - 1][1]
    t = datetime.datetime.strptime(key, fmt)
    if fmt == "%Y%m":
        m = t.year * 12 + t.month - 1 + by
        t = datetime.datetime(m // 12, m % 12 + 1, 1)
    else:
        t += by * (datetime.timedelta(hours=1) if fmt.endswith("%H") else datetime.timedelta(days=1))
    return t.strftime(fmt).rjust(h.width(level), "0")


def time_predicate(h: Hierarchy, slices: Sequence[Slice], by_month: bool = False) -> Column:
    """Predicate over level and key for the (disjoint) slices of a hierarchy; ``by_month``: also over the folders of its months."""
    level, key = F.col(f"{h.name}_level"), F.col(f"{h.name}_key")
    ranges = [r for s in slices for r in time_ranges(h, s)]
    ors = []
    for k, low, high in ranges:
        parts = [level == k]
        for bounds, c in ((lambda x: x, key), *(((lambda x: x[:6]), F.col(f"{h.name}_month")),) * (by_month and k > 0)):
            parts += [c >= bounds(low)] if low is not None else []
            parts += [c <= bounds(high)] if high is not None else []
        ors.append(_all(parts))
    return reduce(lambda a, b: a | b, ors) if ors else F.lit(False)


def sliced_span(cube: Cube, cuboid: Cuboid, slices: Sequence[Slice]) -> tuple[str | None, str | None] | None:
    """Least and largest key (None: unbounded) that the slices of a cuboid's first hierarchy leave; None if they leave all."""
    first = next((d for d in cuboid.dims if cube.dimensions[d].depth), None)
    own = [s for s in slices if s.dim == first]
    if not own or any(s.complement for s in own) or any(isinstance(x, Member) and not x.level for s in own for x in (s.left, s.right)):
        return None
    h = cube.dimensions[first]
    bounds = [[None if is_unbounded(x) else h.bound(x) for x in (s.left, s.right)] for s in own]
    low, high = ([b[i] for b in bounds] for i in (0, 1))
    return None if None in low else min(low), None if None in high else max(high)


def predicates(cube: Cube, cuboid: Cuboid, slices: Sequence[Slice], levels: dict[str, int]) -> tuple[Column | None, Column | None]:
    """(predicate, weight) of the query's cells. ``levels``: hierarchies that are grouped at a level.

    A hierarchy without slice is read at ALL. A complement slice reads ALL and
    the interval, the latter with weight -1.
    """
    parts, weights = [], []
    first = next((d for d in cuboid.dims if cube.dimensions[d].depth), None)
    for d in cuboid.dims:
        dim, own = cube.dimensions[d], [s for s in slices if s.dim == d]
        if dim.depth:
            if d in levels:
                parts.append(F.col(f"{d}_level") == levels[d])
                if own:
                    parts.append(reduce(lambda a, b: a | b, [_grouped_slice(dim, s, levels[d]) for s in own]))
            elif not own:
                parts.append(F.col(f"{d}_level") == 0)
            elif own[0].complement:
                everything = F.col(f"{d}_level") == 0
                parts.append(everything | time_predicate(dim, own, d == first))
                weights.append(F.when(everything, 1).otherwise(-1))
            else:
                parts.append(time_predicate(dim, own, d == first))
            continue
        ors = []
        for s in own:
            low, high = (None if is_unbounded(x) else dim.bound(x) for x in (s.left, s.right))
            p = flat_predicate(F.col(d), low, s.left_open, high, s.right_open)
            if s.complement:
                p = ~p if p is not None else F.lit(False)
            ors.append(p)
        if ors and all(p is not None for p in ors):
            parts.append(reduce(lambda a, b: a | b, ors))
    return (_all(parts) if parts else None), (reduce(lambda a, b: a * b, weights) if weights else None)


def _grouped_slice(h: Hierarchy, s: Slice, level: int) -> Column:
    """Slice of a hierarchy that is grouped at ``level``: its bounds, cut to that level, must name whole members."""
    p = flat_predicate(F.col(f"{h.name}_key"), None if is_unbounded(s.left) else h.bound(s.left, level), s.left_open, None if is_unbounded(s.right) else h.bound(s.right, level), s.right_open)
    for x in (s.left, s.right):
        if level < h.depth and not is_unbounded(x) and not isinstance(x, Member) and to_datetime(x).strftime(h.formats[-1][1]) != to_datetime(h_start(h, x, level)).strftime(h.formats[-1][1]):
            raise ModelError(f"slice of {h.name}: its bounds cut a member of the level that is grouped by")
    return F.lit(True) if p is None else p


def h_start(h: Hierarchy, value: Any, level: int) -> Any:
    import datetime

    return datetime.datetime.strptime(h.bound(value, level), h.formats[level - 1][1])
