"""Aggregate functions of cubes: what a cell keeps, how cells merge, how a value is finished.

All are column expressions. A function names the cell fields it needs; a field
says how it is built from facts and merged. Null measures do not contribute;
a group with only nulls has COUNT 0 and null for everything else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetcube.functions.summarizers import Summarizer


@dataclass(frozen=True)
class Field:
    """A state field: aggregate over facts, aggregate over cells, whether it adds (so that it can be taken away), and its type."""

    of_facts: Callable[[Column], Column]
    of_cells: Callable[[Column], Column]
    additive: bool = True
    kind: str = "double"


FIELDS: dict[str, Field] = {
    "cnt": Field(F.count, F.sum),
    "sum": Field(F.sum, F.sum),
    "sum_sq": Field(lambda x: F.sum(x * x), F.sum),
    "min": Field(F.min, F.min, additive=False),
    "max": Field(F.max, F.max, additive=False),
}


@dataclass(frozen=True)
class AggFunction:
    """A named function. ``needs`` are the standard fields it reads, ``fields`` those it keeps of its own; ``final`` gets all by name.

    This is the SPI of custom functions: a state of columns, built from facts,
    merged from cells, finished by an expression, without code a row. A field
    may be of any type, so sketches that Spark aggregates natively will do.
    """

    name: str
    needs: tuple[str, ...]
    final: Callable[[dict[str, Column]], Column]
    fields: tuple[tuple[str, Field], ...] = ()
    samples: bool = False

    @property
    def supports_complement(self) -> bool:
        return all(FIELDS[f].additive for f in self.needs) and all(f.additive for _, f in self.fields)


def _variance(p: dict[str, Column]) -> Column:
    mean = F.try_divide(p["sum"], p["cnt"])
    return F.greatest(F.try_divide(p["sum_sq"], p["cnt"]) - mean * mean, F.lit(0.0))


def _some(p: dict[str, Column], value: Column) -> Column:
    return F.when(p["cnt"] > 0, value)


STANDARD: dict[str, AggFunction] = {
    f.name: f
    for f in (
        AggFunction("COUNT", ("cnt",), lambda p: F.coalesce(p["cnt"], F.lit(0)).cast("bigint"), samples=True),
        AggFunction("SUM", ("sum", "cnt"), lambda p: _some(p, p["sum"])),
        AggFunction("SUM_SQ", ("sum_sq", "cnt"), lambda p: _some(p, p["sum_sq"])),
        AggFunction("AVG", ("sum", "cnt"), lambda p: _some(p, F.try_divide(p["sum"], p["cnt"]))),
        AggFunction("VAR", ("sum", "sum_sq", "cnt"), lambda p: _some(p, _variance(p))),
        AggFunction("SD", ("sum", "sum_sq", "cnt"), lambda p: _some(p, F.sqrt(_variance(p)))),
        AggFunction("MIN", ("min",), lambda p: p["min"]),
        AggFunction("MAX", ("max",), lambda p: p["max"]),
    )
}


@dataclass(frozen=True)
class SummaryFunction:
    """A summarizer under a name of the model's choice, over sample measures. ``ordinal`` is its place in stored cells."""

    name: str
    ordinal: int
    summarizer: Summarizer

    @property
    def supports_complement(self) -> bool:
        return self.summarizer.supports_complement

    samples = True


def canny_avg(name: str, ordinal: int, dt: float) -> SummaryFunction:
    return SummaryFunction(name, int(ordinal), Summarizer("canny_avg", float(dt)))


def canny_rate(name: str, ordinal: int, dt: float) -> SummaryFunction:
    return SummaryFunction(name, int(ordinal), Summarizer("canny_rate", float(dt)))


def distinct(name: str = "DISTINCT", bits: int = 12) -> AggFunction:
    """Approximate number of different values, from a mergeable HyperLogLog state of 2 ** ``bits`` registers (1.04 / sqrt of it standard error)."""
    state = Field(lambda x: F.hll_sketch_agg(x.cast("string"), bits), lambda x: F.hll_union_agg(x), additive=False, kind="binary")
    return AggFunction(name, ("cnt",), lambda p: F.when(p["cnt"] > 0, F.hll_sketch_estimate(p["hll"])), (("hll", state),))


#: Functions that models may name with the tag !Function: code cannot be stored in a model.
REGISTERED: dict[str, AggFunction] = {}


def register(function: AggFunction) -> AggFunction:
    """Make a custom function known by its name, on every driver that loads models with it."""
    REGISTERED[function.name] = function
    return function


def registered(name: str) -> AggFunction:
    if name not in REGISTERED:
        raise ValueError(f"function {name} is not registered")
    return REGISTERED[name]


def state_of_fact(x: Column) -> Column:
    """The state of a single fact as a struct of the standard fields; null for a null measure."""
    x = x.cast("double")
    return F.when(x.isNotNull(), F.struct(F.lit(1).cast("bigint").alias("cnt"), x.alias("sum"), (x * x).alias("sum_sq"), x.alias("min"), x.alias("max")))
