"""Percentiles by dyadic Count-sketches that merge by addition and take deletions.

Values are encoded by an order-preserving code with a bounded relative error
(a few leading bits and the exponent). For each binary resolution of the code
(nodes of 1, 2, 4, ... codes) a group has one signed Count-sketch: every node
adds its count, times a random sign, to one cell in each of ``depth`` rows; the
median over the rows estimates a node's count. A resolution with no more nodes
than a sketch has cells is kept as plain counters, one a node. A percentile
descends the levels: at each node the estimated count of the left half says
which half the rank falls into.

All of it is linear: states of splits, batches or days are added, and a
deletion is a count of -1. A state travels as its (code, count) pairs while
these take less room than the counters. That is an encoding only: before a
percentile is read the pairs are added to a sketch, and the answer is the
sketch's, whatever the group's size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetcube.arrow import binary_rows, chunks, column, folded, ragged, runs
from facetcube.operators.facts import hex_member, once
from facetcube.storage import materialize


@functools.cache
def _hashes(level: int, nodes: int, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of every node of a level in each row; fixed by level, width and depth, so that states can be added."""
    rng = np.random.default_rng([level, width, depth])
    mult, plus = rng.integers(1, 1 << 31, (2, depth, 2), dtype=np.int64)
    h = (np.arange(nodes)[:, None, None] * mult + plus) % ((1 << 31) - 1)
    return h[:, :, 0] % width, np.where((h[:, :, 1] >> 7) & 1, 1, -1)


@dataclass(frozen=True)
class Dyadic:
    """Parameters: leading bits kept of a value, cells a row, rows; ``sigmas`` of a rank's stated error."""

    bits: int = 6
    width: int = 512
    depth: int = 5
    sigmas: float = 4.0
    levels: int = field(init=False, default=0)
    exact_level: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        half = (62 - self.bits << self.bits) + (2 << self.bits)  # codes of the non-negative values
        levels = math.ceil(math.log2(2 * half))
        object.__setattr__(self, "levels", levels)
        object.__setattr__(self, "exact_level", max(0, levels - int(math.log2(self.width * self.depth))))

    @property
    def zero(self) -> int:
        """Code of the value 0: the middle."""
        return 1 << self.levels - 1

    @property
    def cells(self) -> int:
        """Counters of the sketched levels."""
        return self.exact_level * self.width * self.depth

    @property
    def size(self) -> int:
        """Counters of a sketched group."""
        return self.cells + (1 << self.levels - self.exact_level)

    @property
    def pairs(self) -> int:
        """As many (code, count) pairs as take the room of the counters."""
        return self.size * 8 // 12

    @property
    def value_error(self) -> float:
        """Largest relative error of a decoded value."""
        return 2.0**-self.bits

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Codes of int64 values; larger values never have smaller codes."""
        v = np.maximum(values.astype(np.int64), -(2**63) + 1)
        a = np.abs(v)
        top = np.zeros(len(a), np.int64)  # position of the leading bit
        x = a.copy()
        for s in (32, 16, 8, 4, 2, 1):
            big = x >> s > 0
            top += np.where(big, s, 0)
            x = np.where(big, x >> s, x)
        e = np.maximum(top - self.bits, 0)
        code = (e << self.bits) + (a >> e)
        return np.where(v < 0, self.zero - code, self.zero + code)

    def lowest(self, codes: np.ndarray) -> np.ndarray:
        """The smallest absolute value of each code, with its sign; exact for values below ``2 ** (bits + 1)``."""
        c = np.abs(codes.astype(np.int64) - self.zero)
        e = np.maximum((c >> self.bits) - 1, 0)
        v = (c - (e << self.bits)) << e
        return np.where(codes < self.zero, -v, v)

    def _level(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Counter (in a group's row) and sign of every node of a sketched level."""
        cell, sign = _hashes(level, 1 << self.levels - level, self.width, self.depth)
        return cell + (level * self.depth + np.arange(self.depth)) * self.width, sign

    def add(self, sketches: np.ndarray, group: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of codes to the rows ``group`` of ``sketches``."""
        flat, base = sketches.reshape(-1), group * self.size
        for level in range(self.exact_level):
            cell, sign = self._level(level)
            node = codes >> level
            np.add.at(flat, (base[:, None] + cell[node]).ravel(), (sign[node] * counts[:, None]).ravel())
        np.add.at(flat, base + self.cells + (codes >> self.exact_level), counts)

    def invert(self, sketches: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code at a rank (counted from 1) of each row of ``sketches``."""
        own = np.arange(len(sketches))
        plain = np.cumsum(sketches[:, self.cells :], axis=1)  # the levels of plain counters in one step
        node = np.minimum((plain < rank[:, None]).sum(axis=1), plain.shape[1] - 1)
        rank = rank - np.where(node > 0, plain[own, node - 1], 0)
        for level in range(self.exact_level - 1, -1, -1):
            cell, sign = self._level(level)
            node = 2 * node
            left = np.median(sketches[own[:, None], cell[node]] * sign[node], axis=1)
            right = rank > left
            rank = np.where(right, rank - np.maximum(left, 0), rank)
            node = node + right
        return np.minimum(node, (1 << self.levels) - 1)

    def rank_error(self, sketches: np.ndarray) -> np.ndarray:
        """Bound of the error of a rank in each row: every sketched level may be off by its norm over the root of the width.

        Counts are whole numbers: below 1, no rank is off.
        """
        cells = sketches[:, : self.cells].reshape(len(sketches), self.exact_level, self.depth, self.width).astype(np.float64)
        f2 = np.median((cells**2).sum(axis=3), axis=2)
        return np.floor(self.sigmas * np.sqrt((f2 / self.width).sum(axis=1) / self.depth))


STATE = "grp binary, series int, codes array<int>, counts array<bigint>, sketch binary"


def _states(d: Dyadic, grp: pa.Array, group: np.ndarray, codes: np.ndarray, counts: np.ndarray, series: np.ndarray, sketches: dict[int, np.ndarray]) -> pa.Table:
    """States of groups from sorted (group, code, count); those with too many pairs, or with a sketch already, become counters."""
    n = len(series)
    sizes = np.bincount(group, minlength=n)
    wide = sizes > d.pairs
    wide[list(sketches)] = True
    at = np.flatnonzero(wide)
    rows = np.zeros((len(at), d.size), np.int64)
    for i, g in enumerate(at):
        if g in sketches:
            rows[i] = sketches[g]
    dense = wide[group]
    d.add(rows, (np.cumsum(wide) - 1)[group[dense]], codes[dense], counts[dense])
    ends = pa.array(np.r_[0, np.cumsum(np.where(wide, 0, sizes))].astype(np.int32))
    binary: list[bytes | None] = [None] * n
    for i, g in enumerate(at):
        binary[g] = rows[i].tobytes()
    return pa.table([
        grp, pa.array(series.astype(np.int32)),
        pa.ListArray.from_arrays(ends, pa.array(codes[~dense].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts[~dense].astype(np.int64))),
        pa.array(binary, pa.binary()),
    ], ["grp", "series", "codes", "counts", "sketch"])


def _summed(group: np.ndarray, codes: np.ndarray, counts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added by (group, code), in order, without zeros."""
    key, inverse = np.unique(group << levels | codes, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, counts)
    key, total = key[total != 0], total[total != 0]
    return key >> levels, key & (1 << levels) - 1, total


def split_states(batches: Iterator[pa.RecordBatch], d: Dyadic) -> Iterator[pa.RecordBatch]:
    """Partial states of a split: (grp, series, value, weight) added up for each group."""
    for t in chunks(batches, 1 << 19):
        coded = column(t, "grp").dictionary_encode()
        key = coded.indices.to_numpy().astype(np.int64) << 8 | column(t, "series").to_numpy().astype(np.int64)
        present, group = np.unique(key, return_inverse=True)
        group, codes, counts = _summed(group, d.encode(column(t, "value").to_numpy()), column(t, "weight").to_numpy(), d.levels)
        yield from _states(d, coded.dictionary.take(pa.array(present >> 8)), group, codes, counts, present & 255, {}).to_batches()


def _merged(t: pa.Table, d: Dyadic) -> pa.Table:
    """States sorted by (grp, series) added up: one row a group and series."""
    grp, series = column(t, "grp"), column(t, "series").to_numpy()
    key = runs(grp) << 8 | series
    new = np.r_[True, key[1:] != key[:-1]]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    lists, numbers = column(t, "codes"), column(t, "counts")
    owner = np.repeat(group, lists.value_lengths().to_numpy())
    g, codes, counts = _summed(owner, lists.flatten().to_numpy().astype(np.int64), numbers.flatten().to_numpy(), d.levels)
    sketches: dict[int, np.ndarray] = {}
    data = column(t, "sketch")
    for i in np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)):
        x = np.frombuffer(data[i].as_py(), np.int64)
        sketches[group[i]] = sketches[group[i]] + x if group[i] in sketches else x
    return _states(d, grp.take(pa.array(first)), g, codes, counts, series[first], sketches)


def merge_states(batches: Iterator[pa.RecordBatch], d: Dyadic) -> Iterator[pa.RecordBatch]:
    """States sorted by (grp, series) added up while they are read: a group holds one state, however many come in."""
    return folded(batches, lambda t: _merged(t, d))


def states(rows: DataFrame, d: Dyadic = Dyadic()) -> DataFrame:
    """Mergeable states of every (grp, series), one row each.

    ``rows``: grp (binary), series (int below 256), value (bigint), weight
    (bigint; -1 deletes). Rows with nulls are left out. Splits pre-aggregate, so
    a group with most rows sends one state for each split. Empty in, empty out.
    """
    return add_states(rows.select("grp", "series", "value", "weight").dropna().mapInArrow(lambda it: split_states(it, d), STATE), d)


def add_states(partial: DataFrame, d: Dyadic = Dyadic(), salts: int = 16) -> DataFrame:
    """States of separate inputs (union them first) added up for each (grp, series).

    In two steps: the states of a group are first added by ``salts`` tasks, by
    the split that they come from, and the few that are left by one.
    """
    salted = partial.withColumn("_salt", F.spark_partition_id() % salts)
    some = salted.repartition("grp", "_salt").drop("_salt").sortWithinPartitions("grp", "series").mapInArrow(lambda it: merge_states(it, d), STATE)
    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # states are small, but take work: not to be coalesced
    return some.repartition(parts, "grp").sortWithinPartitions("grp", "series").mapInArrow(lambda it: merge_states(it, d), STATE)


def percentiles(merged: DataFrame, ps: Sequence[int], d: Dyadic = Dyadic()) -> DataFrame:
    """Estimates from states: grp, series, n, rank_error and, for each p, ``p<p>`` with ``lo<p>`` and ``hi<p>``.

    ``p<p>`` is the smallest value that at least p % of the values do not
    exceed, up to the relative error ``d.value_error``; ``lo`` and ``hi`` bound
    it when the rank is off by ``rank_error``. ``n`` is exact. Groups whose
    values have all been deleted give no row.
    """
    names = [f"{k}{p}" for p in ps for k in ("p", "lo", "hi")]
    at_once = max(1, (1 << 25) // (8 * d.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, at_once, exactly=True):
            lists = column(t, "codes")
            sketches = np.zeros((t.num_rows, d.size), np.int64)
            given = column(t, "sketch")
            for i in np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)):
                sketches[i] = np.frombuffer(given[i].as_py(), np.int64)
            d.add(sketches, np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64), column(t, "counts").flatten().to_numpy())
            total, error = sketches[:, d.cells :].sum(axis=1), d.rank_error(sketches)
            values = []
            for p in ps:
                rank = np.maximum(-(-p * total // 100), 1)
                mid, lo, hi = (d.invert(sketches, r) for r in (rank, np.maximum(rank - error, 1), np.minimum(rank + error, total)))
                values += [d.lowest(mid), d.lowest(lo), np.maximum(d.lowest(hi + 1) - 1, d.lowest(hi))]
            b = pa.RecordBatch.from_arrays([column(t, "grp"), column(t, "series"), pa.array(total), pa.array(error), *map(pa.array, values)], ["grp", "series", "n", "rank_error", *names])
            yield b.filter(pa.array(total > 0))

    return merged.mapInArrow(run, "grp binary, series int, n bigint, rank_error double, " + ", ".join(f"{n} bigint" for n in names))


# Series 0 and 1 are impCnt and click of compiler_input, 2 and 3 those of aggregation.


def fact_values(facts: DataFrame) -> DataFrame:
    """Values of impCnt and click of each dim2 member, a fact once."""
    f = once(facts, grp=hex_member(F.col("dim2")), i=F.col("impCnt"), c=F.col("click")).filter("grp is not null")
    pairs = F.array(F.struct(F.lit(0).alias("series"), F.col("i").alias("value")), F.struct(F.lit(1).alias("series"), F.col("c").alias("value")))
    return f.select("grp", F.explode(pairs).alias("x")).select("grp", "x.series", "x.value", F.lit(1).cast("bigint").alias("weight")).filter("value is not null")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Observations of the cells: big-endian 64-bit integers, a broken one at the end ignored."""
    for t in chunks(batches, 1 << 16):
        data, start, end = binary_rows(column(t, "state"))
        n = (end - start) // 8
        values = data[ragged(start, n * 8)].view(">i8").astype(np.int64)
        rows = pa.array(np.repeat(np.arange(t.num_rows), n))
        yield pa.RecordBatch.from_arrays([column(t, "grp").take(rows), column(t, "series").take(rows), pa.array(values), pa.array(np.ones(len(values), np.int64))], ["grp", "series", "value", "weight"])


def cell_values(cells: DataFrame) -> DataFrame:
    """Observations in ``customStates`` (ordinal 1) of the hour cells of each dim1, each cell key once.

    Redelivered cells agree in all columns. A null or short list, a null or
    empty state and a dim1 that is not hexadecimal hold no observations.
    """
    series = F.when(F.col("measure") == "impCnt", 2).when(F.col("measure") == "click", 3)
    c = cells.filter("time_level = 2").select("cuboid", hex_member(F.unhex("dim1")).alias("grp"), "time_key", "batch_id", series.alias("series"), F.get("customStates", F.lit(1)).alias("state"))
    c = c.filter("grp is not null and series is not null and state is not null").distinct()
    return c.select("grp", "series", "state").mapInArrow(_decode, "grp binary, series int, value bigint, weight bigint")


def value_rows(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """All values whose percentiles are asked for: grp, series, value, weight."""
    return fact_values(facts).unionByName(cell_values(cells))


def exact_percentiles(rows: DataFrame, ps: Sequence[int]) -> DataFrame:
    """n and ``p<p>`` of each (grp, series), counted value by value."""
    counted = rows.groupBy("grp", "series", "value").agg(F.sum("weight").alias("x")).filter("x != 0")
    own = Window.partitionBy("grp", "series")
    counted = counted.withColumn("up_to", F.sum("x").over(own.orderBy("value"))).withColumn("n", F.sum("x").over(own))
    at = lambda p: F.min(F.when(F.col("up_to") * 100 >= F.col("n") * p, F.col("value"))).alias(f"p{p}")
    return counted.groupBy("grp", "series", "n").agg(*map(at, ps))


def judged(facts: DataFrame, cells: DataFrame, least: int = 30, factor: int = 5, d: Dyadic = Dyadic()) -> DataFrame:
    """What the sketches say of each group that may have a heavy tail: grp, series, sure (true: it has one; false: too near to the limit).

    Groups that have none within the sketch's stated errors are left out.
    """
    est = percentiles(states(value_rows(facts, cells), d), (50, 90), d).filter(F.col("n") >= least)
    can = (F.col("hi50") >= 1) & (F.col("hi90") >= factor * F.greatest("lo50", F.lit(1)))
    sure = (F.col("lo50") >= 1) & (F.col("lo90") >= factor * F.col("hi50"))
    return est.filter(can).select("grp", "series", sure.alias("sure"))


def heavy_tails(facts: DataFrame, cells: DataFrame, least: int = 30, factor: int = 5, d: Dyadic = Dyadic()) -> DataFrame:
    """Groups with a median of 1 or more and a 90th percentile of ``factor`` times the median or more.

    The rows come from the sketches; only groups whose percentiles the stated
    errors leave on both sides of a limit are counted value by value, in a
    second pass over their rows.
    """
    can = materialize(judged(facts, cells, least, factor, d), "heavy-tails")
    near = can.filter("not sure").select("grp", "series")
    keys = near.select(F.col("grp").alias("_g")).distinct()
    raw_facts = facts.withColumn("_g", hex_member(F.col("dim2"))).join(keys, "_g", "left_semi")
    raw_cells = cells.withColumn("_g", hex_member(F.unhex("dim1"))).join(keys, "_g", "left_semi")
    exact = exact_percentiles(value_rows(raw_facts, raw_cells), (50, 90)).join(near, ["grp", "series"], "left_semi")
    exact = exact.filter((F.col("n") >= least) & (F.col("p50") >= 1) & (F.col("p90") >= factor * F.col("p50")))
    return named(can.filter("sure").select("grp", "series").unionByName(exact.select("grp", "series"))).select("src", "item", "measure")


def named(df: DataFrame) -> DataFrame:
    """Source, member and measure of (grp, series)."""
    src = F.when(F.col("series") < 2, "compiler_input").otherwise("aggregation")
    measure = F.when(F.col("series") % 2 == 0, "impCnt").otherwise("click")
    return df.withColumns({"src": src, "item": F.hex("grp"), "measure": measure})
