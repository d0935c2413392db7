"""Aggregation of decaying states without knowing a group's latest time beforehand.

A state is a set of sums that decay: to add two of them, one must be decayed to
the other's time. Time is cut into steps short enough that a weight does not
underflow within one, and long enough that only the last ``ring`` steps of a
group matter at all. Then two ordinary aggregates do:

1. by keys and step: sums of the weights relative to the end of the step,
2. by keys: of each of the ``ring`` classes of steps (the step's number modulo
   ``ring``) the latest one. These are the group's last steps, and older ones,
   whose weight relative to the latest time is nothing.

Both combine before the shuffle, so a key with most of the rows, or a group
without keys, meets in no single task; no window, no join, any time constant.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Time constants within which a weight underflows nowhere, and beyond which it is lost in a double's precision.
IN_A_STEP, AT_MOST = 512, 40


@dataclass(frozen=True)
class Plain:
    """An aggregate beside the decaying ones: over the rows, and over its own results."""

    name: str
    of_rows: Column
    again: Callable[[Column], Column]


@dataclass
class Decaying:
    """Sums that decay from one time: ``time`` is SQL; ``sums`` has (name, SQL of the value at that time, time constant); ``firsts`` has (name, SQL) of minima; ``times`` names the latest time's columns."""

    time: str
    sums: list[tuple[str, str, float]] = field(default_factory=list)
    firsts: list[tuple[str, str]] = field(default_factory=list)
    times: list[str] = field(default_factory=list)

    @property
    def step(self) -> float:
        """Length of a step: a power of two, so that it does not depend on the order of anything."""
        return 2.0 ** math.floor(math.log2(IN_A_STEP * min(tau for _, _, tau in self.sums)))

    @property
    def ring(self) -> int:
        return 1 + math.ceil(AT_MOST * max(tau for _, _, tau in self.sums) / self.step)


def step_of(fast: float) -> float:
    """Step of sums whose fastest time constant is ``fast``: those of equal steps can be folded together."""
    return 2.0 ** math.floor(math.log2(IN_A_STEP * fast))


def fold(rows: DataFrame, keys: Sequence[str], plain: Sequence[Plain], items: Sequence[Decaying]) -> DataFrame:
    """One row for each group of ``keys``: the keys, the plain aggregates, and the decayed sums at the latest time.

    Rows without a time add nothing to its sums; a group without any has nulls.
    """
    quoted = [f"`{k}`" for k in keys]
    if not items:
        return rows.groupBy(*quoted).agg(*(p.of_rows.alias(p.name) for p in plain))
    every = [n for it in items for n, *_ in (*it.sums, *it.firsts)]
    structs = []
    for i, it in enumerate(items):
        step = f"cast(floor({it.time} / {it.step!r}D) as bigint)"
        own = {n: f"({v}) * exp(({it.time} - ({step} + 1) * {it.step!r}D) / {tau!r}D)" for n, v, tau in it.sums} | dict(it.firsts)
        structs.append({"_item": str(i), "_step": step, "_time": it.time} | {n: own.get(n, "cast(null as double)") for n in every})
    if len(structs) == 1:
        others = [c for c in rows.columns if c not in every]
        flat = rows.selectExpr(*(f"`{c}`" for c in others), *(f"{x} as `{n}`" for n, x in structs[0].items()))
    else:  # a row for each item, of which the first has what the plain aggregates read
        others = [c for c in rows.columns if c not in every and c not in keys]
        each = (", ".join(f"'{n}', {x}" for n, x in s.items()) for s in structs)
        dealt = rows.select("*", F.expr(f"explode(array({', '.join(f'named_struct({e})' for e in each)}))").alias("_of"))
        flat = dealt.selectExpr(*quoted, *(f"case when _of._item = 0 then `{c}` end as `{c}`" for c in others), "_of.*")
    aggs = [p.of_rows.alias(p.name) for p in plain]
    aggs += [F.max("_time").alias("_time")] + [F.sum(f"`{n}`").alias(n) for it in items for n, *_ in it.sums] + [F.min(f"`{n}`").alias(n) for it in items for n, _ in it.firsts]
    steps = flat.groupBy(*quoted, "_item", "_step").agg(*aggs)
    out, final = [p.again(F.col(f"`{p.name}`")).alias(p.name) for p in plain], [F.col(f"`{p.name}`") for p in plain]
    for i, it in enumerate(items):
        held = ", ".join(f"`{n}`" for n, *_ in it.sums)
        latest = [f"_last_{i}_{r}" for r in range(it.ring)]
        out += [F.expr(f"max(case when _item = {i} and pmod(_step, {it.ring}) = {r} and _time is not null then struct(_step, _time, {held}) end)").alias(c) for r, c in enumerate(latest)]
        out += [F.min(f"`{n}`").alias(n) for n, _ in it.firsts]
        time = f"greatest({', '.join(f'{c}._time' for c in latest)}, cast(null as double))"
        for n, _, tau in it.sums:
            terms = (f"coalesce({c}.`{n}` * exp((({c}._step + 1) * {it.step!r}D - {time}) / {tau!r}D), 0D)" for c in latest)
            final.append(F.expr(f"case when {time} is not null then {' + '.join(terms)} end").alias(n))
        final += [F.expr(time).alias(n) for n in it.times] + [F.col(f"`{n}`") for n, _ in it.firsts]
    return steps.groupBy(*quoted).agg(*out).select(*quoted, *final)

