"""Distinct counts by mergeable set registers of a tunable logarithmic base.

A sketch has ``m`` registers. Every element gives register i a value
``1 - log_b h_i``, rounded down, where ``h_i`` is exponential with rate ``a``
and depends on the element and i alone; the register keeps the largest value.
So repeated elements change nothing, and the sketch of a union is the
register-wise maximum. The base ``b`` trades size against precision: b = 1.2
needs a byte a register for any set there can be, at a relative standard error
of ``sqrt(((b + 1) / (b - 1) * ln b - 1) / m)``, about 1.003 / sqrt(m).

Two ways make registers, with values of the same distribution (but different
ones, so states of one kind merge with each other only): ``early`` False takes m hashes an
element, which is less for sets of a few elements; True draws an element's values in ascending order, as
arrivals of a Poisson process over the registers, and stops when none can
change a register: some m log m draws a sketch, however large the set.

Two sketches together give union, intersection and Jaccard similarity by
maximum likelihood over how many registers are larger in the first, larger in
the second, or equal; the Fisher information there, with the error of the
estimated sizes that go in, states the error.

Partial states are small: a set of few elements is kept as their hashes, a
larger one as its registers. Splits build them for (group, day); these are
merged first by day, a large one by several tasks, then to months and to all
days.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetcube.arrow import binary_rows, chunks, column, folded, ragged, runs, whole_groups
from facetcube.operators.facts import char_member, day_key, day_number, hex_member, once
from facetcube.storage import materialize


#: Groups whose registers are made at once by early stopping; bounds the memory.
GROUPS_AT_ONCE = 128


def spread(z: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits, in place."""
    z ^= z >> np.uint64(33)
    z *= np.uint64(0xFF51AFD7ED558CCD)
    z ^= z >> np.uint64(33)
    z *= np.uint64(0xC4CEB9FE1A85EC53)
    z ^= z >> np.uint64(33)
    return z


@dataclass(frozen=True)
class SetSketch:
    """Parameters of the registers: number, base, rate. They count to sets of 1e18: a byte is enough from a base of about 1.19 on, below it two are taken."""

    m: int = 512
    b: float = 1.2
    a: float = 20.0
    early: bool = False

    def __post_init__(self) -> None:
        if self.early and (self.m > 4096 or self.m & self.m - 1):
            raise ValueError("early stopping takes a power of two of at most 4096 registers")

    @property
    def error(self) -> float:
        """Relative standard error of a cardinality estimate."""
        return float(np.sqrt(((self.b + 1) / (self.b - 1) * np.log(self.b) - 1) / self.m))

    @property
    def top(self) -> int:
        """Largest value of a register."""
        return 255 if self.a * 1e18 < self.b**254 else 65535

    @property
    def kind(self) -> type:
        return np.uint8 if self.top == 255 else np.uint16

    @property
    def width(self) -> int:
        """Bytes of a sketch."""
        return self.m * np.dtype(self.kind).itemsize

    @property
    def few(self) -> int:
        """Sets up to this size are kept as hashes, which take no more bytes than registers."""
        return self.width // 8

    def registers(self, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Registers of each group: ``groups`` numbers the groups of the hashes from 0, in order."""
        n = int(groups[-1]) + 1 if len(groups) else 0
        if self.early:
            edges = np.searchsorted(groups, np.arange(0, n + GROUPS_AT_ONCE, GROUPS_AT_ONCE))
            parts = [self._arrivals(hashes[s:e], groups[s:e] - i * GROUPS_AT_ONCE) for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
            return np.concatenate(parts) if parts else np.zeros((0, self.m), self.kind)
        # of each register only the largest uniform number matters; its logarithm is taken once, at the end
        best = np.zeros((n, self.m), np.uint64)
        salt = np.arange(1, self.m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        step = max(1, (1 << 17) // self.m)  # fits the cache
        for s in range(0, len(hashes), step):
            z = spread(hashes[s : s + step].astype(np.uint64)[:, None] + salt)
            g = groups[s : s + step]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            at = g[first]
            best[at] = np.maximum(best[at], np.maximum.reduceat(z, first, axis=0))
        with np.errstate(divide="ignore"):
            return self._levels(-np.log1p(-((~best).astype(np.float64) + 0.5) / 2.0**64) / self.a)

    def _levels(self, h: np.ndarray) -> np.ndarray:
        """Register values of least exponentials."""
        return np.clip(np.floor(1 - np.log(h) / np.log(self.b)), 0, self.top).astype(self.kind)

    def _arrivals(self, hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Registers by early stopping. An element's arrivals fall at rate m * a, each into a random register: the first in a register is exponential with rate a."""
        best = np.full((int(groups[-1]) + 1, self.m), np.inf)
        flat = best.reshape(-1)
        h, g, x = hashes.astype(np.uint64), groups.astype(np.int64), np.zeros(len(hashes))
        j, check = 0, 1
        while len(h):
            j += 1
            z = spread(h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            x -= np.log(((z >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / (self.m * self.a)
            np.minimum.at(flat, g * self.m + (z & np.uint64(self.m - 1)).astype(np.int64), x)
            if j >= check:
                alive = x <= best.max(axis=1)[g]
                h, g, x = h[alive], g[alive], x[alive]
                check = j + max(1, j // 8)
        return self._levels(best)

    def cardinality(self, registers: np.ndarray) -> np.ndarray:
        """Estimated size of each set (rows: sketches)."""
        powers = np.power(self.b, -np.arange(self.top + 1.0))
        return self.m * (1 - 1 / self.b) / (self.a * np.log(self.b) * powers[registers].sum(axis=1))

    def joint(self, u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        """Union, intersection and Jaccard similarity of pairs of sets, with the standard error of the last."""
        nu, nv = self.cardinality(u), self.cardinality(v)
        larger, smaller = (u > v).sum(axis=1), (u < v).sum(axis=1)
        equal = self.m - larger - smaller
        x, y = nu / (nu + nv), nv / (nu + nv)
        c = (self.b - 1) / self.b

        def p(z: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(z, 0, 1) * c) / np.log(self.b)

        def likelihood(j: np.ndarray) -> np.ndarray:
            up, down = p(x - y * j), p(y - x * j)
            tiny = 1e-300
            return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)

        low, high = np.zeros_like(x), np.minimum(x / y, y / x)
        golden = (np.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = high - golden * (high - low), low + golden * (high - low)
            left = likelihood(a) >= likelihood(b)
            low, high = np.where(left, low, a), np.where(left, b, high)
        j = (low + high) / 2
        up, down = p(x - y * j), p(y - x * j)
        d_up = -y * c / np.log(self.b) / (1 - np.clip(x - y * j, 0, 1) * c)
        d_down = -x * c / np.log(self.b) / (1 - np.clip(y - x * j, 0, 1) * c)
        with np.errstate(divide="ignore", invalid="ignore"):
            info = self.m * (d_up**2 / np.maximum(up, 1e-12) + d_down**2 / np.maximum(down, 1e-12) + (d_up + d_down) ** 2 / np.maximum(1 - up - down, 1e-12))
        return {"union": (nu + nv) / (1 + j), "intersection": (nu + nv) * j / (1 + j), "jaccard": j, "jaccard_error": np.sqrt(1 / info + (j * self.error) ** 2)}


STATE = "grp string, day int, n bigint, hashes binary, registers binary"


def split_states(batches: Iterator[pa.RecordBatch], sketch: SetSketch) -> Iterator[pa.RecordBatch]:
    """Partial states of a split sorted by (grp, day, h): for each group and day its rows and its set."""
    for t in chunks(batches, 1 << 18):
        grp, day, h = column(t, "grp"), column(t, "day").to_numpy(), column(t, "h").to_numpy().view(np.uint64)
        codes = grp.dictionary_encode().indices.to_numpy()
        new_group = np.r_[True, (codes[1:] != codes[:-1]) | (day[1:] != day[:-1])]
        new = new_group | np.r_[True, h[1:] != h[:-1]]
        starts = np.flatnonzero(new_group)
        rows = np.diff(np.r_[starts, len(day)])
        group = (np.cumsum(new_group) - 1)[new]
        hashes = h[new]
        sizes = np.bincount(group, minlength=len(starts))
        large = sizes > sketch.few
        dense = large[group]
        number = np.cumsum(large) - 1
        regs = sketch.registers(hashes[dense], number[group[dense]])
        kept = np.where(large, 0, sizes)
        payload = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(kept * 8)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(hashes[~dense]))])
        wide = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(large * sketch.width)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(regs).view(np.uint8))])
        yield pa.RecordBatch.from_arrays([grp.take(pa.array(starts)), pa.array(day[starts], pa.int32()), pa.array(rows), payload, wide], ["grp", "day", "n", "hashes", "registers"])


SPANS = "grp string, span string, span_key int, n bigint, estimate double, registers binary"


def _daily(t: pa.Table, sketch: SetSketch) -> pa.Table:
    """States sorted by (grp, day) merged: one row a group and day."""
    grp, day, n = column(t, "grp"), column(t, "day").to_numpy(), column(t, "n").to_numpy()
    codes = runs(grp)
    new = np.r_[True, (codes[1:] != codes[:-1]) | (day[1:] != day[:-1])]
    first, of_day = np.flatnonzero(new), np.cumsum(new) - 1
    data, h0, h1 = binary_rows(column(t, "hashes"))
    wide, r0, r1 = binary_rows(column(t, "registers"))
    lengths = h1 - h0
    hashes = data[ragged(h0, lengths)].view(np.uint64) if lengths.sum() else np.zeros(0, np.uint64)
    owner = np.repeat(of_day, lengths // 8)
    order = np.lexsort([hashes, owner])
    owner, hashes = owner[order], hashes[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(owner)]
    owner, hashes = owner[fresh], hashes[fresh]
    sizes = np.bincount(owner, minlength=len(first))
    dense = sizes > sketch.few
    dense[of_day[r1 > r0]] = True
    place = np.cumsum(dense) - 1
    regs = np.zeros((int(dense.sum()), sketch.m), sketch.kind)
    for i in np.flatnonzero(r1 > r0):
        at = place[of_day[i]]
        np.maximum(regs[at], wide[r0[i] : r1[i]].view(sketch.kind), out=regs[at])
    if (loose := dense[owner]).any():
        at, number = np.unique(place[owner[loose]], return_inverse=True)
        regs[at] = np.maximum(regs[at], sketch.registers(hashes[loose], number))
    return pa.table([grp.take(pa.array(first)), pa.array(day[first], pa.int32()), pa.array(np.add.reduceat(n, first)), _packed(np.where(dense, 0, sizes * 8), hashes[~dense[owner]]), _packed(dense * sketch.width, regs)], ["grp", "day", "n", "hashes", "registers"])


def _packed(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """Rows of bytes, of the given lengths, from the values of all rows."""
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).reshape(-1).view(np.uint8))])


def merge_days(batches: Iterator[pa.RecordBatch], sketch: SetSketch) -> Iterator[pa.RecordBatch]:
    """States sorted by (grp, day) merged while they are read: a day holds one state, however many come in."""
    return folded(batches, lambda t: _daily(t, sketch), rows=1 << 15)


def merge_spans(batches: Iterator[pa.RecordBatch], sketch: SetSketch, least: int) -> Iterator[pa.RecordBatch]:
    """Sketches of days, months and all days from states sorted by (grp, day), for spans of ``least`` rows or more. A group has few states a day."""
    for t in whole_groups(batches, "grp", 1 << 12):  # while registers are made, a span takes some tens of bytes for each
        t = _daily(t, sketch)
        grp, day, n = column(t, "grp"), column(t, "day").to_numpy(), column(t, "n").to_numpy()
        codes = runs(grp)
        kept = np.flatnonzero(np.bincount(codes, weights=n)[codes] >= least)
        if not len(kept):
            continue
        t = t.take(pa.array(kept))
        grp, codes, day, n = column(t, "grp"), codes[kept], day[kept], n[kept]
        data, h0, h1 = binary_rows(column(t, "hashes"))
        hashes = data[h0[0] : h1[-1]].view(np.uint64)
        owner = np.repeat(np.arange(len(day)), (h1 - h0) // 8)
        wide, r0, r1 = binary_rows(column(t, "registers"))
        dense = np.flatnonzero(r1 > r0)
        regs = wide[r0[dense][:, None] + np.arange(sketch.width)].view(sketch.kind)
        if not sketch.early and len(hashes):  # a register more costs as much as an element more: days first, larger spans from them
            sparse, number = np.unique(owner, return_inverse=True)
            dense, order = np.unique(np.r_[dense, sparse], return_index=True)
            regs = np.concatenate([regs, sketch.registers(hashes, number)])[order]
            hashes, owner = hashes[:0], owner[:0]
        dates = {x: datetime.date(1970, 1, 1) + datetime.timedelta(int(x)) for x in np.unique(day)}
        days = np.array([dates[x].year * 10000 + dates[x].month * 100 + dates[x].day for x in day], np.int64)
        for span, keys in (("day", days), ("month", days // 100), ("all", days * 0)):
            new = np.r_[True, (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])]
            change, of_span = np.flatnonzero(new), np.cumsum(new) - 1
            rows_in = np.add.reduceat(n, change)
            every = np.flatnonzero(rows_in >= least)
            for i in range(0, len(every), 1024):  # bounds the registers and the eight bytes that an estimate takes for each
                ok = every[i : i + 1024]
                number = np.full(len(change), -1)
                number[ok] = np.arange(len(ok))
                merged = np.zeros((len(ok), sketch.m), sketch.kind)
                to = number[of_span[dense]]
                at = np.flatnonzero(to >= 0)
                if len(at):
                    first = np.flatnonzero(np.r_[True, np.diff(to[at]) != 0])
                    merged[to[at][first]] = np.maximum.reduceat(regs[at], first, axis=0)
                own = number[of_span[owner]]
                mine = own >= 0
                if mine.any():
                    own, h = own[mine], hashes[mine]
                    order = np.lexsort([h, own])
                    own, h = own[order], h[order]
                    fresh = np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])]
                    has, at_once = np.unique(own[fresh], return_inverse=True)
                    merged[has] = np.maximum(merged[has], sketch.registers(h[fresh], at_once))
                yield pa.RecordBatch.from_arrays([grp.take(pa.array(change[ok])), pa.array([span] * len(ok)), pa.array(keys[change[ok]], pa.int32()), pa.array(rows_in[ok]), pa.array(sketch.cardinality(merged)), pa.array([x.tobytes() for x in merged], pa.binary())], ["grp", "span", "span_key", "n", "estimate", "registers"])


def span_sketches(rows: DataFrame, sketch: SetSketch, least: int = 1, salts: int = 16) -> DataFrame:
    """Sketches of every group and span with ``least`` rows: grp, span (day, month, all), span_key, n, estimate, registers.

    ``rows``: grp (string), day (day number), h (64-bit hash of the
    identifier), one for each record, without nulls. A split sends, for each
    group and day it holds, one small state. The states of a day are merged
    first, those of 16 rows or more by ``salts`` tasks, so that no group or day
    with most of the records meets in one; the group's spans then come from a
    few states for each day. Empty input, empty result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.select("grp", "day", "h").sortWithinPartitions("grp", "day", "h").mapInArrow(lambda it: split_states(it, sketch), STATE)
    salted = local.withColumn("_salt", F.when(F.col("n") >= 16, F.spark_partition_id() % salts).otherwise(0))
    daily = salted.repartition("grp", "day", "_salt").drop("_salt").sortWithinPartitions("grp", "day").mapInArrow(lambda it: merge_days(it, sketch), STATE)
    return daily.repartition(parts, "grp").sortWithinPartitions("grp", "day").mapInArrow(lambda it: merge_spans(it, sketch, least), SPANS)


def audience(facts: DataFrame) -> DataFrame:
    """charDim1 member, day and hashed dim1 member of each fact that has all three."""
    f = once(facts, grp=char_member(F.col("charDim1")), day=day_number(F.col("impressionTime")), h=F.xxhash64(hex_member(F.col("dim1"))), has=F.length("dim1") > 0)
    return f.filter("grp is not null and day is not null and has").select("grp", "day", "h")


def distinct_members(facts: DataFrame, sketch: SetSketch = SetSketch(), least: int = 40) -> DataFrame:
    """Estimated number of different dim1 members for each charDim1 member and span with ``least`` facts."""
    return span_sketches(audience(facts), sketch, least)


#: 2048 registers, 2.2 % standard error: fine enough to tell spans from the limits of ``narrow_and_wide``.
FINE = SetSketch(m=2048, early=True)


def judged(facts: DataFrame, narrow: float = 0.15, wide: float = 0.85, least: int = 40, sketch: SetSketch = FINE, sigmas: float = 4.0) -> DataFrame:
    """What the sketches say of each span that may be narrow or wide: grp, span_key, n, kind (null: too near to a limit).

    The number of members lies between estimate / (1 + e) and estimate / (1 - e)
    for ``sigmas`` standard errors e, and is n at most.
    """
    off = sigmas * sketch.error
    spans = distinct_members(facts, sketch, least)
    low, high = F.col("estimate") / (1 + off) / F.col("n"), F.least(F.col("estimate") / (1 - off) / F.col("n"), F.lit(1.0))
    kind = F.when(high <= narrow, F.lit("narrow")).when(low >= wide, F.lit("wide"))
    return spans.filter((low <= narrow) | (high >= wide)).select("grp", "span_key", "n", kind.alias("kind"))


def narrow_and_wide(facts: DataFrame, narrow: float = 0.15, wide: float = 0.85, least: int = 40, sketch: SetSketch = FINE, sigmas: float = 4.0) -> DataFrame:
    """Spans whose different dim1 members are few (narrow) or many (wide) for the facts they have.

    The rows come from the sketches; only spans that lie within ``sigmas``
    standard errors of a limit are counted exactly, in a second pass over the
    rows of their groups.
    """
    can = materialize(judged(facts, narrow, wide, least, sketch, sigmas), "spans")
    near = can.filter("kind is null").select("grp", "span_key", "n")
    of_group = near.groupBy("grp").agg(F.collect_set("span_key").alias("_open"))  # of a group's days, months and all
    raw = facts.select(char_member(F.col("charDim1")).alias("grp"), day_key(day_number(F.col("impressionTime"))).cast("int").alias("d"), hex_member(F.col("dim1")).alias("item")).dropna()
    spans = F.array_intersect(F.array(F.col("d"), F.floor(F.col("d") / 100).cast("int"), F.lit(0)), F.col("_open"))
    distinct = raw.join(of_group, "grp").select("grp", "item", F.explode(spans).alias("span_key")).distinct()
    counted = distinct.groupBy("grp", "span_key").agg(F.count(F.lit(1)).alias("x")).join(near, ["grp", "span_key"])
    x = F.col("x") * 1_000_000
    found = F.when(x <= F.col("n") * round(narrow * 1_000_000), F.lit("narrow")).when(x >= F.col("n") * round(wide * 1_000_000), F.lit("wide"))
    exact = counted.select("grp", "span_key", found.alias("kind"))
    return can.select("grp", "span_key", "kind").unionByName(exact).filter("kind is not null").select(F.col("grp").alias("chardim1"), "span_key", "kind")


def joint_months(spans: DataFrame, sketch: SetSketch = SetSketch()) -> DataFrame:
    """Union, intersection and Jaccard similarity of each group's sets in consecutive months."""
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    months = spans.filter("span = 'month'").select("grp", "span_key", "registers").repartition(parts, "grp").sortWithinPartitions("grp", "span_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp", 4096):
            group, month = runs(column(t, "grp")), column(t, "span_key").to_numpy()
            following = np.where(month % 100 == 12, month + 89, month + 1)
            first = np.flatnonzero((group[1:] == group[:-1]) & (month[1:] == following[:-1]))
            if not len(first):
                continue
            data, start, _ = binary_rows(column(t, "registers"))
            u, v = (data[start[i][:, None] + np.arange(sketch.width)].view(sketch.kind) for i in (first, first + 1))
            r = sketch.joint(u, v)
            yield pa.RecordBatch.from_arrays([column(t, "grp").take(pa.array(first)), pa.array(month[first]), *(pa.array(r[k]) for k in ("union", "intersection", "jaccard", "jaccard_error"))], ["grp", "month", "union", "intersection", "jaccard", "jaccard_error"])

    return months.mapInArrow(run, "grp string, month int, `union` double, intersection double, jaccard double, jaccard_error double")
