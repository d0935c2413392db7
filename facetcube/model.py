"""Cube models: dimensions, hierarchies, measures, cuboids, functions.

Dimensions turn values into canonical keys (strings whose order is the order of
members), as columns for facts and as Python strings for bounds of slices. A
hierarchy has a key for each level; the key of a level is a prefix in time.
"""

from __future__ import annotations

import datetime
import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetcube.functions.aggregates import STANDARD, AggFunction, SummaryFunction
from facetcube.functions.codecs import cut_utf8


class ModelError(ValueError):
    """A model, or a query against it, that cannot be right."""


@dataclass(frozen=True)
class Member:
    """A member of a hierarchy at a level of its own, so that a slice can address months as such."""

    value: Any
    level: int


class Dimension:
    """SPI of a flat dimension. ``key`` encodes a column, ``bound`` a value, ``member`` decodes a key column."""

    name: str
    nullkey: Any = None
    depth = 0

    def key(self, c: Column, kind: T.DataType) -> Column:
        raise NotImplementedError

    def bound(self, value: Any) -> str:
        raise NotImplementedError

    def member(self, key: Column) -> Column:
        return key

    def key_or_error(self, c: Column, kind: T.DataType) -> Column:
        """The key; for null the null key, and an error where the dimension has none."""
        if self.nullkey is not None:
            return F.coalesce(self.key(c, kind), F.lit(self.bound(self.nullkey)))
        return F.coalesce(self.key(c, kind), F.raise_error(F.lit(f"dimension {self.name} is null and has no nullkey")))


@dataclass(frozen=True)
class HexDimension(Dimension):
    """Identifiers of ``keylen`` bytes as 2 * keylen upper-case hex digits, padded with zeros on the left.

    Columns: binary, integer (negative ones as two's complement, low bytes), or
    hex strings in any case. Too long or invalid values are errors.
    """

    name: str
    keylen: int
    nullkey: Any = None

    def key(self, c: Column, kind: T.DataType) -> Column:
        n = 2 * self.keylen
        bad = lambda why: F.raise_error(F.lit(f"dimension {self.name}: {why}"))
        if isinstance(kind, T.BinaryType):
            return F.when(F.length(c) > self.keylen, bad("value too long")).otherwise(F.lpad(F.hex(c), n, "0"))
        if isinstance(kind, T.StringType):
            return F.when(c.isNull(), F.lit(None)).when(F.length(c) > n, bad("value too long")).when(~c.rlike("^[0-9A-Fa-f]*$"), bad("no hex number")).otherwise(F.lpad(F.upper(c), n, "0"))
        if isinstance(kind, T.IntegralType):
            h = F.hex(c.cast("bigint"))
            fill = F.when(c < 0, "F").otherwise("0")
            long = F.concat(F.when(c.isNotNull(), F.repeat(fill, F.lit(max(0, n - 16)))), F.lpad(h, 16, "0"))
            return F.substring(long, -n, n) if n <= 16 else long
        raise ModelError(f"dimension {self.name}: {kind.simpleString()} columns are not supported")

    def bound(self, value: Any) -> str:
        n = 2 * self.keylen
        if isinstance(value, (bytes, bytearray)):
            text = bytes(value).hex()
        elif isinstance(value, bool) or not isinstance(value, (int, str)):
            raise ModelError(f"dimension {self.name}: {value!r} is no identifier")
        elif isinstance(value, int):
            text = f"{value & ((1 << 8 * self.keylen) - 1):x}"
        else:
            text = value
            if not all(ch in "0123456789abcdefABCDEF" for ch in text):
                raise ModelError(f"dimension {self.name}: {value!r} is no hex number")
        if len(text) > n:
            raise ModelError(f"dimension {self.name}: {value!r} is too long")
        return text.upper().rjust(n, "0")

    def member(self, key: Column) -> Column:
        return F.unhex(key)


@dataclass(frozen=True)
class UTF8CharDimension(Dimension):
    """Text of at most ``length`` UTF-8 bytes; longer text is cut before the code point that does not fit, or is an error."""

    name: str
    length: int
    auto_truncate: bool = True
    nullkey: Any = None

    def key(self, c: Column, kind: T.DataType) -> Column:
        c = F.rtrim(c.cast("string"), F.lit("\0"))
        if not self.auto_truncate:
            return F.when(F.octet_length(c) > self.length, F.raise_error(F.lit(f"dimension {self.name}: value too long"))).otherwise(c)
        return cut_utf8(c, self.length)

    def bound(self, value: Any) -> str:
        if not isinstance(value, str):
            raise ModelError(f"dimension {self.name}: {value!r} is no text")
        raw = value.rstrip("\0").encode()
        if len(raw) > self.length and not self.auto_truncate:
            raise ModelError(f"dimension {self.name}: {value!r} is too long")
        return raw[: self.length].decode(errors="ignore")


def to_datetime(value: Any) -> datetime.datetime:
    """UTC time of epoch milliseconds, a date, a datetime or an ISO string."""
    if isinstance(value, bool):
        raise ModelError(f"{value!r} is no time")
    if isinstance(value, (int, float)):
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=value)
    if isinstance(value, str):
        try:
            value = datetime.datetime.fromisoformat(value)
        except ValueError:
            raise ModelError(f"{value!r} is no time") from None
    if isinstance(value, datetime.datetime):
        return value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day)
    raise ModelError(f"{value!r} is no time")


def time_column(c: Column, kind: T.DataType) -> Column:
    """Timestamp without zone, in UTC, of epoch milliseconds or of a time column (the session's zone must be UTC)."""
    if isinstance(kind, T.NumericType):
        return F.timestamp_millis(c.cast("bigint")).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


@dataclass(frozen=True)
class Hierarchy(Dimension):
    """SPI of a hierarchy over time: ``formats`` has the key's pattern for each level from 1 on; level 0 is ALL."""

    name: str
    nullkey: Any = None
    formats: tuple[tuple[str, str, int], ...] = ()  # (Spark pattern, Python pattern, length)

    @property
    def depth(self) -> int:  # type: ignore[override]
        return len(self.formats)

    def level_key(self, c: Column, kind: T.DataType, level: int) -> Column:
        t = time_column(c, kind)
        if self.nullkey is not None:
            t = F.coalesce(t, F.lit(to_datetime(self.nullkey)).cast("timestamp_ntz"))
        else:
            t = F.coalesce(t, F.raise_error(F.lit(f"dimension {self.name} is null and has no nullkey")).cast("timestamp_ntz"))
        return F.date_format(t, self.formats[level - 1][0])

    def up(self, key: Column, level: int) -> Column:
        """The key of a coarser level, of a key of a finer one: its beginning."""
        return F.substring(key, 1, self.width(level)) if level else F.lit("")

    def bound(self, value: Any, level: int | None = None) -> str:
        level = self.depth if level is None else level
        if isinstance(value, Member):
            value, level = value.value, value.level
        return to_datetime(value).strftime(self.formats[level - 1][1]) if level else ""

    def width(self, level: int) -> int:
        return self.formats[level - 1][2] if level else 0

    def start(self, key: Column) -> Column:
        """Time at which the member of a key begins, for keys of any level from 1 on."""
        return F.coalesce(*(F.when(F.length(key) == n, F.to_timestamp_ntz(key, F.lit(spark))) for spark, _, n in reversed(self.formats)))

    member = start


def TimeHourHierarchy(name: str, nullkey: Any = None) -> Hierarchy:  # noqa: N802
    """[ALL].[year-month].[day-hour], UTC."""
    return Hierarchy(name, nullkey, (("yyyyMM", "%Y%m", 6), ("yyyyMMddHH", "%Y%m%d%H", 10)))


def DateHierarchy(name: str, nullkey: Any = None) -> Hierarchy:  # noqa: N802
    """[ALL].[date], UTC."""
    return Hierarchy(name, nullkey, (("yyyyMMdd", "%Y%m%d", 8),))


@dataclass(frozen=True)
class NumericMeasure:
    """A number, as double. Types other than integers and doubles are errors (floats, decimals and text among them)."""

    name: str
    samples = False

    def columns(self, c: Column, kind: T.DataType) -> dict[str, Column]:
        if not isinstance(kind, (T.IntegralType, T.DoubleType, T.NullType)):
            raise ModelError(f"measure {self.name}: {kind.simpleString()} is not supported")
        return {"x": c.cast("double")}


@dataclass(frozen=True)
class IrregularSampleMeasure:
    """A sample: struct of value and time in ms (its first two fields). Null if either is null."""

    name: str
    samples = True

    def columns(self, c: Column, kind: T.DataType) -> dict[str, Column]:
        if not isinstance(kind, T.StructType) or len(kind) < 2:
            raise ModelError(f"measure {self.name}: a struct of value and time is needed, not {kind.simpleString()}")
        x, t = (c[f.name].cast("double") for f in kind.fields[:2])
        ok = x.isNotNull() & t.isNotNull()
        return {"x": F.when(ok, x), "t": F.when(ok, t)}


Measure = NumericMeasure | IrregularSampleMeasure


@dataclass(frozen=True)
class Cuboid:
    """An ordered list of dimensions. ``ttl``: seconds that a cell is kept after its last write (0: for ever)."""

    dims: tuple[str, ...]
    ttl: int = 0
    compiler_group: str | None = None
    in_memory: bool = False
    max_versions: int = 1

    @property
    def path(self) -> str:
        return "/".join(self.dims)

    def table_name(self, cube: str) -> str:
        """Name of the cuboid's dataset: readable, and unique by a digest of the dimensions' names."""
        return f"{cube}_{''.join(d[0] + d[-1] for d in self.dims)}_{hashlib.md5(self.path.encode()).hexdigest()}"


@dataclass(frozen=True)
class Cube:
    """A cube model. ``functions`` are those of the model beside the standard ones."""

    name: str
    dimensions: dict[str, Dimension]
    cuboids: tuple[Cuboid, ...]
    measures: dict[str, Measure]
    functions: dict[str, AggFunction | SummaryFunction] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for c in self.cuboids:
            if unknown := [d for d in c.dims if d not in self.dimensions]:
                raise ModelError(f"cuboid {c.path}: unknown dimension {unknown[0]}")
            if len(set(c.dims)) < len(c.dims):
                raise ModelError(f"cuboid {c.path} names a dimension twice")
        if clash := set(self.functions) & set(STANDARD):
            raise ModelError(f"function {min(clash)} is a standard one")

    @classmethod
    def of(cls, name: str, dimensions: Sequence[Dimension], cuboids: Sequence[Sequence[str] | Cuboid], measures: Sequence[Measure], functions: Sequence[AggFunction | SummaryFunction] = ()) -> Cube:
        cs = tuple(c if isinstance(c, Cuboid) else Cuboid(tuple(c)) for c in cuboids)
        return cls(name, {d.name: d for d in dimensions}, cs, {m.name: m for m in measures}, {f.name: f for f in functions})

    def function(self, name: str) -> AggFunction | SummaryFunction:
        f = STANDARD.get(name) or self.functions.get(name)
        if f is None:
            raise ModelError(f"Unknown function {name}")
        return f

    def hierarchies(self, c: Cuboid) -> list[Hierarchy]:
        return [self.dimensions[d] for d in c.dims if self.dimensions[d].depth]

    def summaries(self, m: Measure) -> list[SummaryFunction]:
        """Summaries that a cell of the measure keeps."""
        return [f for f in self.functions.values() if isinstance(f, SummaryFunction)] if m.samples else []


def is_unbounded(value: Any) -> bool:
    """None and infinities are no bounds."""
    return value is None or (isinstance(value, float) and math.isinf(value))
