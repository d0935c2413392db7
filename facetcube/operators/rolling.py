"""Totals over trailing periods, kept as a versioned daily rolling state.

The state of an entity on a day is its total over each trailing period. The
next day's state is yesterday's, plus what arrives today, minus what expires
today (the amounts of the day that leaves the period). ``RollingStore`` keeps
daily amounts and daily states in files:

* ``advance`` makes the state of a day by one union and one aggregate of
  yesterday's totals, the day's arrivals and the expiring amounts. Several days
  are caught up in one job: entities are spread by their hash, and each task
  takes its entities from day to day by the same step, on arrays.
* ``correct`` takes amounts that arrive after their day has been closed, and
  writes the affected (entity, date) anew as a higher version. It reads the
  amounts of the affected entities around those dates and nothing else.

Readers take the highest version of each (entity, date). A step becomes visible
when the list of steps is published: one that fails leaves nothing behind, and
one that is run again replaces what it did before.

Entities without a fact in the longest period have no state rows, so a day's
state holds the active entities, not all there ever were.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetcube import storage
from facetcube.arrow import column, runs, whole_groups
from facetcube.operators.facts import day_key, day_number, day_of_key, deliveries, hex_member, once

PERIODS = (7, 30)
#: Rows that a task of a catch-up holds at a time: whole entities, which have some rows a day at most.
ROWS_A_CHUNK = 1 << 20
ARRIVED, TOUCHED, BEFORE = range(3)


def daily_amounts(facts: DataFrame, entity: Column, measures: Sequence[str]) -> DataFrame:
    """Facts (``n``) and amounts of each entity and UTC day: entity, day, late, n and the measures.

    ``late``: what arrived after the day. A fact is as late as its first
    delivery; one without ``arrived_at`` counts as punctual. A null measure adds
    nothing; a fact without entity or day is left out; a day whose facts have no
    measure keeps its row, with zeros. An empty input gives no rows.
    """
    fields = {"entity": entity, "day": day_number(F.col("impressionTime"))} | {m: F.col(m) for m in measures}
    if "arrived_at" in facts.columns:
        f = deliveries(facts, **fields, arrived_at=F.col("arrived_at")).filter("entity is not null and day is not null")
        f = f.groupBy("fact_id", "_lone", *fields).agg(F.min("arrived_at").alias("arrived_at"))
        late = F.coalesce(F.unix_date(F.to_date("arrived_at")) > F.col("day"), F.lit(False))
    else:
        f = once(facts, **fields).filter("entity is not null and day is not null")
        late = F.lit(False)
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in measures]
    return f.groupBy("entity", "day", late.alias("late")).agg(F.count(F.lit(1)).alias("n"), *sums)


def chain(batches: Iterator[pa.RecordBatch], first: int, last: int, periods: Sequence[int], width: int, warm: bool, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """States of the days from ``first`` to ``last`` from rows (entity, day, kind, x) sorted by entity.

    ``x`` holds the ``width`` amounts of a day (ARRIVED), the totals of the day
    before ``first`` (BEFORE), or nothing (TOUCHED: a corrected day). ``warm``:
    there are no earlier totals, they are made of the amounts of the days
    before. With TOUCHED rows only the dates that these affect come out, zeros
    included; else all entities that have a fact in the longest period.
    """
    longest, begin = max(periods), first
    if warm:
        begin = first - max(periods) + 1
    for t in whole_groups(batches, "entity", ROWS_A_CHUNK):
        entity, day, kind, x = column(t, "entity"), column(t, "day").to_numpy(), column(t, "kind").to_numpy(), column(t, "x")
        code = runs(entity)
        name = entity.take(pa.array(np.flatnonzero(np.r_[True, code[1:] != code[:-1]])))
        offsets, flat = np.r_[0, np.cumsum(x.value_lengths().to_numpy())], x.flatten().to_numpy()
        of = lambda at, n: flat[offsets[at][:, None] + np.arange(n)]
        totals = np.zeros((len(name), width, len(periods)), np.int64)
        before = np.flatnonzero(kind == BEFORE)
        totals[code[before]] = of(before, width * len(periods)).reshape(-1, width, len(periods))

        def by_day(which: int) -> dict[int, np.ndarray]:
            at = np.flatnonzero((kind == which) & ((day >= begin) | (not warm)))
            at = at[np.argsort(day[at], kind="stable")]
            days, starts = np.unique(day[at], return_index=True)
            return dict(zip(days.tolist(), np.split(at, starts[1:]), strict=True)) if len(at) else {}

        arrived, touched = by_day(ARRIVED), by_day(TOUCHED)
        until = np.full(len(name), -1)
        for d in range(begin, last + 1):
            if (at := arrived.get(d)) is not None:
                np.add.at(totals, code[at], of(at, width)[:, :, None])
            for i, p in enumerate(periods):
                if (at := arrived.get(d - p)) is not None:
                    np.subtract.at(totals[:, :, i], code[at], of(at, width))
            if touched:
                if (at := touched.get(d)) is not None:
                    until[code[at]] = d + longest - 1
                out = np.flatnonzero(until >= d)
            else:
                out = np.flatnonzero(totals[:, 0, periods.index(longest)] > 0)
            if d >= first and len(out):
                yield pa.RecordBatch.from_arrays([name.take(pa.array(out)), pa.array(np.full(len(out), d, np.int32)), *(pa.array(c) for c in totals[out].reshape(len(out), -1).T)], ["entity", "day", *names])


class RollingStore:
    """Rolling state in files below ``path``: ``amounts/<step>`` and ``state/<step>``, and the published list of steps.

    ``measures`` are those of the amounts; beside them ``n`` counts facts. The
    totals are ``<measure>_<period>``.
    """

    def __init__(self, spark: SparkSession, path: str, measures: Sequence[str], periods: Sequence[int] = PERIODS):
        self.spark, self.path, self.periods = spark, path.rstrip("/"), list(periods)
        self.longest, self.values = max(periods), ["n", *measures]
        self.totals = [f"{m}_{p}" for m in self.values for p in self.periods]
        self.amount_schema = "entity binary, day int, " + ", ".join(f"{m} bigint" for m in self.values)
        self.state_schema = "entity binary, day int, " + ", ".join(f"{t} bigint" for t in self.totals) + ", v int"

    # --- steps ----------------------------------------------------------------------------

    def steps(self) -> list[dict[str, Any]]:
        """Steps in force, oldest first: id, name (of a correction), version, days of the state and of the amounts."""
        return storage.published(self.spark, self.path, "steps")[1] or []

    @staticmethod
    def _days(steps: Sequence[dict[str, Any]]) -> dict[int, list[dict[str, Any]]]:
        """Steps with states in force, by day. An advance replaces all there was from its first day on."""
        out: dict[int, list[dict[str, Any]]] = {}
        for s in steps:
            if s["name"] is None:
                out = {d: x for d, x in out.items() if d < s["first"]} | {d: [s] for d in range(s["first"], s["last"] + 1)}
            else:
                for d in range(s["first"], s["last"] + 1):
                    if d in out:
                        out[d].append(s)
        return out

    def _publish(self, seen: int, steps: list[dict[str, Any]]) -> None:
        storage.publish(self.spark, self.path, "steps", seen + 1, steps)

    def _read(self, kind: str, step: dict[str, Any], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{step['id']}")

    # --- reading --------------------------------------------------------------------------

    def _amounts(self, steps: Sequence[dict[str, Any]], first: int, last: int) -> DataFrame:
        """Amounts of the days, one row for each step that has some."""
        parts, open_days = [], (first, last)
        for s in reversed(steps):
            low, high = max(open_days[0], s["from"]), min(open_days[1] if s["name"] is None else last, s["to"])
            if low <= high:
                parts.append(self._read("amounts", s, self.amount_schema).filter(F.col("day").between(low, high)))
            if s["name"] is None:  # what earlier advances had of these days and later ones counts no more
                open_days = (open_days[0], min(open_days[1], s["first"] - 1))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.amount_schema)

    def amounts(self, first: int, last: int) -> DataFrame:
        """Amounts of each entity and day, corrections included."""
        return self._amounts(self.steps(), first, last).groupBy("entity", "day").agg(*(F.sum(m).alias(m) for m in self.values))

    def history(self, first: int, last: int) -> DataFrame:
        """All versions of the states of the days: entity, day, totals, v (0: before any correction)."""
        held: dict[str, tuple[dict[str, Any], list[int]]] = {}
        for d, steps in self._days(self.steps()).items():
            if first <= d <= last:
                for s in steps:
                    held.setdefault(s["id"], (s, []))[1].append(d)
        parts = []
        for s, days in held.values():
            rows = self._read("state", s, self.state_schema)
            if len(days) < s["last"] - s["first"] + 1:
                rows = rows.filter(F.col("day").between(min(days), max(days)) if len(days) == max(days) - min(days) + 1 else F.col("day").isin(days))
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.state_schema)

    def state(self, first: int, last: int, where: Column | None = None) -> DataFrame:
        """Totals in force on the days, with their version; ``where``: a condition on them.

        Rows that meet the condition are kept unless a correction has a higher
        version of them: only those rows and the corrections' keys are joined.
        """
        rows = self.history(first, last)
        kept = rows.filter(F.col(f"n_{self.longest}") > 0)
        if where is not None:
            kept = kept.filter(where)
        if not any(s["name"] is not None and s["last"] >= first and s["first"] <= last for s in self.steps()):
            return kept
        newer = rows.filter("v > 0").select("entity", "day", F.col("v").alias("_v"))
        return kept.join(newer, (kept["entity"] == newer["entity"]) & (kept["day"] == newer["day"]) & (newer["_v"] > kept["v"]), "left_anti")

    def first_days(self) -> DataFrame:
        """The first day on which each entity has a fact."""
        steps = self.steps()
        days = [s[k] for s in steps for k in ("from", "to")]
        return self._amounts(steps, min(days, default=0), max(days, default=0)).groupBy("entity").agg(F.min("day").alias("first_day"))

    # --- steps forward --------------------------------------------------------------------

    def _store(self, kind: str, step: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/{step}")

    def _chained(self, rows: Sequence[DataFrame], first: int, last: int, warm: bool) -> DataFrame:
        periods, width, names = self.periods, len(self.values), self.totals
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = reduce(DataFrame.unionByName, rows).repartition(parts, "entity").sortWithinPartitions("entity")
        schema = "entity binary, day int, " + ", ".join(f"{n} bigint" for n in names)
        return spread.mapInArrow(lambda it: chain(it, first, last, periods, width, warm, names), schema)

    def _rows(self, df: DataFrame, kind: int, values: Sequence[str]) -> DataFrame:
        x = F.array(*(F.col(v).cast("bigint") for v in values)) if values else F.array().cast("array<bigint>")
        return df.select("entity", F.col("day").cast("int").alias("day"), F.lit(kind).alias("kind"), x.alias("x"))

    def advance(self, first: int, last: int, arrivals: DataFrame) -> None:
        """States of the days from ``first`` to ``last`` from the state of the day before and the arrivals (entity, day, n, measures).

        Days from ``first`` on that were there already are replaced, also their
        corrections' states (the corrections' amounts stay in).
        """
        seen, steps = storage.published(self.spark, self.path, "steps")
        steps, step = steps or [], uuid.uuid4().hex
        days = self._days(steps)
        if days and first > max(days) + 1:
            raise ValueError(f"the state ends on day {max(days)}: day {first} cannot follow")
        sums = [F.sum(m).cast("bigint").alias(m) for m in self.values]
        self._store("amounts", step, arrivals.filter(F.col("day").between(first, last)).groupBy("entity", F.col("day").cast("int").alias("day")).agg(*sums))
        entry = {"id": step, "name": None, "version": 0, "first": first, "last": last, "from": first, "to": last}
        amounts = self._amounts([*steps, entry], first - self.longest, last)
        before = self.state(first - 1, first - 1) if first - 1 in days else None
        if first == last:
            sign = lambda m, p: F.when(F.col("day") == first, F.col(m)).when(F.col("day") == first - p, -F.col(m)).otherwise(0)
            parts = [amounts.select("entity", *(sign(m, p).alias(f"{m}_{p}") for m in self.values for p in self.periods))]
            if before is not None:
                parts.append(before.select("entity", *self.totals))
            rows = reduce(DataFrame.unionByName, parts).groupBy("entity").agg(*(F.sum(t).cast("bigint").alias(t) for t in self.totals))
            rows = rows.filter(F.col(f"n_{self.longest}") > 0).withColumn("day", F.lit(first))
        else:
            parts = [self._rows(amounts, ARRIVED, self.values)]
            if before is not None:
                parts.append(self._rows(before, BEFORE, self.totals))
            rows = self._chained(parts, first, last, before is None)
        self._store("state", step, rows.withColumn("v", F.lit(0)))
        self._publish(seen, [*steps, entry])

    def correct(self, name: str, late: DataFrame) -> None:
        """Add late amounts (entity, day, n, measures) and write the affected dates anew, as the next version.

        A correction of the same name is replaced: the dates that it had
        affected are written again too. Amounts after the last day of the state
        are kept for the days to come.
        """
        seen, steps = storage.published(self.spark, self.path, "steps")
        steps, step = steps or [], uuid.uuid4().hex
        sums = [F.sum(m).cast("bigint").alias(m) for m in self.values]
        self._store("amounts", step, late.groupBy("entity", F.col("day").cast("int").alias("day")).agg(*sums))
        own = {"id": step, "name": name, "version": 1 + max((s["version"] for s in steps), default=0), "first": 0, "last": -1, "from": 0, "to": -1}
        touched = self._read("amounts", own, self.amount_schema).select("entity", "day")
        for old in (s for s in steps if s["name"] == name):
            touched = touched.unionByName(self._read("amounts", old, self.amount_schema).select("entity", "day"))
        span = touched.agg(F.min("day"), F.max("day")).first()
        if span[0] is None:
            return
        steps = [s for s in steps if s["name"] != name]
        days = self._days(steps)
        first, last = max(span[0], min(days, default=0)), min(span[1] + self.longest - 1, max(days, default=-1))
        own |= {"first": first, "last": last, "from": span[0], "to": span[1]}
        if first <= last:
            amounts = self._amounts([*steps, own], first - self.longest + 1, last).join(touched.select("entity").distinct(), "entity", "left_semi")
            rows = self._chained([self._rows(amounts, ARRIVED, self.values), self._rows(touched.distinct(), TOUCHED, ())], first, last, True)
            self._store("state", step, rows.withColumn("v", F.lit(own["version"])))
        self._publish(seen, [*steps, own])

    def vacuum(self, grace: float = 3600) -> list[str]:
        """Delete the folders of replaced and failed steps that have not changed for ``grace`` seconds; their names."""
        live, gone = {s["id"] for s in self.steps()}, []
        for kind in ("amounts", "state"):
            old = storage.folders(self.spark, f"{self.path}/{kind}", time.time() - grace)
            gone += [f"{kind}/{n}" for n in old if n not in live]
        for n in gone:
            storage.delete(self.spark, f"{self.path}/{n}")
        return gone


END_DAY = 20240330
MEASURES = ["impCnt", "click"]


def member_store(facts: DataFrame, end_day: int = END_DAY) -> tuple[RollingStore, int, int]:
    """Rolling state of impCnt and click for every dim1 member of ``compiler_input``, with its first and last day.

    What arrived in time advances the state from day to day; what arrived late
    is a correction of the days it belongs to.
    """
    spark, last = facts.sparkSession, day_of_key(end_day)
    store = RollingStore(spark, storage.scratch(spark, "rolling"), MEASURES)
    daily = storage.materialize(daily_amounts(facts, hex_member(F.col("dim1")), MEASURES).filter(F.col("day") <= last), "daily")
    first = daily.agg(F.min("day")).first()[0]
    if first is None:
        return store, last + 1, last
    store.advance(first, last, daily.filter("not late"))
    store.correct("late arrivals", daily.filter("late"))
    return store, first, last


def _named(day: str = "day") -> list[Column]:
    return [F.hex("entity").alias("dim1"), day_key(F.col(day)).cast("int").alias("on_day")]


def rolling_totals(facts: DataFrame, end_day: int = END_DAY) -> DataFrame:
    """Totals and daily averages over 7 and 30 days for each dim1 member and day since its first.

    The state has no rows where nothing has happened for 30 days: these days
    are filled with zeros, up to the member's next row.
    """
    store, first, last = member_store(facts, end_day)
    following = F.lead("day").over(Window.partitionBy("entity").orderBy("day"))
    rows = store.state(first, last).withColumn("_to", F.coalesce(following, F.lit(last + 1)) - 1)
    rows = rows.withColumn("on", F.explode(F.sequence("day", "_to")))
    total = lambda m, p: F.when(F.col("on") == F.col("day"), F.col(f"{m}_{p}")).otherwise(0)
    values = [x for m, n in (("impCnt", "imp"), ("click", "click")) for p in PERIODS for x in (total(m, p).cast("bigint").alias(f"{n}_{p}"), F.round(total(m, p) / p, 6).alias(f"avg_{n}_{p}"))]
    return rows.select(*_named("on"), *values)


def corrected_totals(facts: DataFrame, end_day: int = END_DAY) -> DataFrame:
    """Every (member, day) that a correction has written: its version, totals over 30 days, and those of version 0."""
    store, first, last = member_store(facts, end_day)
    rows = store.history(first, last)
    names = [f"{m}_30" for m in MEASURES]
    newest = rows.filter("v > 0").groupBy("entity", "day").agg(F.max("v").alias("version"), *(F.max_by(c, "v").alias(c) for c in names))
    old = rows.filter("v = 0").select("entity", "day", *(F.col(c).alias(f"v0_{c}") for c in names))
    both = newest.join(old, ["entity", "day"], "left")
    values = [x for c, n in zip(names, ("imp_30", "click_30"), strict=True) for x in (F.col(c).alias(n), F.coalesce(f"v0_{c}", F.lit(0)).alias(f"v0_{n}"))]
    return both.select(*_named(), "version", *values)


def surges_and_lulls(facts: DataFrame, end_day: int = END_DAY, imp_least: int = 60, click_least: int = 10, share: float = 0.6) -> DataFrame:
    """Days on which a member's week holds most of its month (imp_surge, click_surge) or nothing of it (lull).

    The conditions reach the scans of the states: only rows that meet one are
    joined with the corrections and with the members' first days.
    """
    store, first, last = member_store(facts, end_day)
    thousandths = round(share * 1000)
    kinds = [
        ("imp_surge", (F.col("impCnt_30") >= imp_least) & (F.col("impCnt_7") * 1000 >= F.col("impCnt_30") * thousandths)),
        ("click_surge", (F.col("click_30") >= click_least) & (F.col("click_7") * 1000 >= F.col("click_30") * thousandths)),
        ("lull", (F.col("impCnt_30") >= imp_least) & (F.col("impCnt_7") == 0)),
    ]
    held = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds)), lambda k: k.isNotNull())
    rows = store.state(first, last, reduce(lambda a, b: a | b, (c for _, c in kinds)))
    rows = rows.select("entity", "day", F.explode(held).alias("kind")).join(store.first_days(), "entity").filter(F.col("day") >= F.col("first_day") + 29)
    return rows.select(*_named(), "kind")
