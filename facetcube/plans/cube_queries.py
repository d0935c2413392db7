"""Queries of the cube engine over the test tables, through compile, cuboids and planner, with SQL over the raw tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetcube import storage
from facetcube.engine import Engine, to_frame, write_text
from facetcube.functions import codecs
from facetcube.functions.aggregates import AggFunction, Field, SummaryFunction, canny_avg, canny_rate, distinct, register, state_of_fact
from facetcube.functions.summarizers import Summarizer, parse_init, welford, welford_merge, welford_variance
from facetcube.model import Cube, Cuboid, DateHierarchy, HexDimension, IrregularSampleMeasure, NumericMeasure, TimeHourHierarchy, UTF8CharDimension
from facetcube.operators.compile import cell_schema, read_cells
from facetcube.sources.catalog import Catalog
from facetcube.sources.facts import sample_facts

WEEK = 604_800_000.0

EVENTS = Cube.of(
    "Events",
    [HexDimension("user_id", 8), UTF8CharDimension("event_type", 20), TimeHourHierarchy("ts")],
    [Cuboid(("event_type", "ts"), compiler_group="realtime"), ["user_id", "ts"], ["user_id", "event_type", "ts"], ["event_type"], ["user_id", "event_type"]],
    [NumericMeasure("value"), IrregularSampleMeasure("valueSeries")],
    [canny_avg("cannyAvg7d", 0, WEEK), canny_rate("cannyRate7d", 1, WEEK), SummaryFunction("expAvg7d", 2, Summarizer("exp_avg", WEEK)), SummaryFunction("expRate7d", 3, Summarizer("exp_rate", WEEK))],
)
SALES = Cube.of(
    "Sales",
    [HexDimension("suppkey", 8), UTF8CharDimension("returnflag", 1), UTF8CharDimension("linestatus", 1), UTF8CharDimension("priority", 20), TimeHourHierarchy("shipdate")],
    [["returnflag", "linestatus", "shipdate"], ["suppkey", "shipdate"], ["suppkey", "returnflag", "shipdate"], ["priority", "shipdate"]],
    [NumericMeasure(m) for m in ("quantity", "extendedprice", "discount", "tax")],
)
ORDERS = Cube.of(
    "Orders",
    [HexDimension("custkey", 8), UTF8CharDimension("status", 1), UTF8CharDimension("priority", 20), DateHierarchy("orderdate")],
    [["status", "priority", "orderdate"], ["custkey", "orderdate"]],
    [NumericMeasure("totalprice")],
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.withColumn("valueSeries", F.struct(F.col("value").alias("x"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t")))


def sales_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = line.join(orders, line.l_orderkey == orders.o_orderkey, "left")
    return j.select(F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("o_orderpriority").alias("priority"), F.col("l_shipdate").alias("shipdate"), *(F.col(f"l_{m}").alias(m) for m in SALES.measures))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("orderdate"), F.col("o_totalprice").alias("totalprice"))


_FACTS = {"Events": (EVENTS, event_facts), "Sales": (SALES, sales_facts), "Orders": (ORDERS, order_facts)}
_engines: dict[tuple[int, str, str], Engine] = {}


def new_engine(spark: SparkSession) -> Engine:
    """An engine over an empty warehouse in the shared folder."""
    return Engine(spark, storage.scratch(spark, "warehouse"))


def compiled(spark: SparkSession, sf_dir: str, *cubes: str) -> Engine:
    """An engine with the cubes compiled from a directory's tables, once a session, directory and cube."""
    key = (id(spark), sf_dir, "")
    if key not in _engines:
        _engines[key] = new_engine(spark)
    engine = _engines[key]
    for name in cubes:
        if (id(spark), sf_dir, name) not in _engines:
            cube, facts = _FACTS[name]
            engine.deploy(cube)
            engine.compile(cube, facts(spark, sf_dir), "all", spread=spark.sparkContext.defaultParallelism, keep=True)  # the test tables are single files
            _engines[(id(spark), sf_dir, name)] = engine
    return engine


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def dialect(name: str, cube: str, text: str, sql: str, *values: Any, digits: int = 4) -> None:
    """Register a query in the dialect."""
    query(name, sql)(lambda spark, d: rounded(compiled(spark, d, cube).sql(text, *values), digits))


# --- functions -----------------------------------------------------------------------------

dialect("count_by_type", "Events", "select event_type, COUNT(value) as c from Events group by event_type", "select event_type, count(value) c from events group by 1")
dialect("sum_by_type", "Events", "select event_type, SUM(value) as v from Events group by event_type", "select event_type, round(sum(value), 4) v from events group by 1")
dialect("avg_by_type", "Events", "select event_type, AVG(value) as v from Events group by event_type", "select event_type, round(avg(value), 4) v from events group by 1")
dialect("min_max_by_type", "Events", "select event_type, MIN(value) as lo, MAX(value) as hi from Events group by event_type", "select event_type, round(min(value), 4) lo, round(max(value), 4) hi from events group by 1")
dialect("sumsq_by_type", "Events", "select event_type, SUM_SQ(value) as v from Events group by event_type", "select event_type, round(sum(value * value), 2) v from events group by 1", digits=2)
dialect("var_sd_by_type", "Events", "select event_type, VAR(value) as var, SD(value) as sd from Events group by event_type", "select event_type, round(var_pop(value), 3) var, round(stddev_pop(value), 3) sd from events group by 1", digits=3)
_WIDE = [("COUNT", "quantity", "n"), ("SUM", "quantity", "sum_qty"), ("SUM", "extendedprice", "sum_price"), ("AVG", "quantity", "avg_qty"), ("AVG", "extendedprice", "avg_price"), ("AVG", "discount", "avg_disc"), ("MIN", "tax", "min_tax"), ("MAX", "tax", "max_tax"), ("VAR", "quantity", "var_qty"), ("SD", "discount", "sd_disc"), ("SUM_SQ", "quantity", "sq_qty")]
dialect(
    "all_functions_wide", "Sales", f"select returnflag, linestatus, {', '.join(f'{f}({m}) as {a}' for f, m, a in _WIDE)} from Sales group by returnflag, linestatus",
    "select l_returnflag returnflag, l_linestatus linestatus, count(l_quantity) n, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_price, round(avg(l_quantity), 2) avg_qty, round(avg(l_extendedprice), 2) avg_price, round(avg(l_discount), 2) avg_disc, round(min(l_tax), 2) min_tax, round(max(l_tax), 2) max_tax, round(var_pop(l_quantity), 2) var_qty, round(stddev_pop(l_discount), 2) sd_disc, round(sum(l_quantity * l_quantity), 2) sq_qty from lineitem group by 1, 2",
    digits=2,
)
dialect("global_total", "Events", "select SUM(value) as v, COUNT(value) as c from Events", "select round(sum(value), 3) v, count(value) c from events having count(*) > 0", digits=3)
dialect("global_empty_slice", "Events", "select SUM(value) as v, COUNT(value) as c from Events where ts in ['2031-01-01', '2031-02-01')", "select sum(value) v, count(value) c from events where ts >= timestamp '2031-01-01' and ts < timestamp '2031-02-01' having count(*) > 0")

# --- slices --------------------------------------------------------------------------------

_H = "date_trunc('hour', ts)"


def _event_slice(name: str, interval: str, where: str) -> None:
    dialect(name, "Events", f"select event_type, SUM(value) as v, COUNT(value) as c from Events where ts in {interval} group by event_type", f"select event_type, round(sum(value), 4) v, count(value) c from events where {where} group by 1")


_A, _B = "'2024-01-05 03:00'", "'2024-01-20 17:00'"
_event_slice("slice_half_open_hours", f"[{_A}, {_B})", f"{_H} >= timestamp {_A} and {_H} < timestamp {_B}".replace(":00'", ":00:00'"))
_event_slice("slice_closed_time", f"[{_A}, {_B}]", f"{_H} >= timestamp {_A} and {_H} <= timestamp {_B}".replace(":00'", ":00:00'"))
_event_slice("slice_open_time", f"({_A}, {_B})", f"{_H} > timestamp {_A} and {_H} < timestamp {_B}".replace(":00'", ":00:00'"))
_event_slice("slice_left_open_right_closed", f"({_A}, {_B}]", f"{_H} > timestamp {_A} and {_H} <= timestamp {_B}".replace(":00'", ":00:00'"))
_event_slice("slice_inf_right", f"[{_A}, inf)", f"{_H} >= timestamp {_A}".replace(":00'", ":00:00'"))
_event_slice("slice_point_hour", "['2024-01-10 05:30']", f"{_H} = timestamp '2024-01-10 05:00:00'")


@query("slice_unbounded_left", f"select event_type, round(sum(value), 4) v from events where {_H} < timestamp '2024-01-15 00:00:00' group by 1")
def _unbounded_left(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").add_half_open_slice("ts", None, "2024-01-15").add_group_by("event_type")
    return rounded(q.select_dimension("event_type").select("SUM", "value", "v").execute())


@query("slice_unbounded_right", f"select event_type, round(sum(value), 4) v from events where {_H} > timestamp '2024-01-15 06:00:00' group by 1")
def _unbounded_right(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").add_open_slice("ts", "2024-01-15 06:00", None).add_group_by("event_type")
    return rounded(q.select_dimension("event_type").select("SUM", "value", "v").execute())


dialect("slice_point_char", "Events", "select event_type, SUM(value) as v from Events where event_type in ['click'] group by event_type", "select event_type, round(sum(value), 4) v from events where event_type = 'click' group by 1")
dialect("slice_point_hex", "Events", "select event_type, SUM(value) as v from Events where user_id in [?] group by event_type", "select event_type, round(sum(value), 4) v from events where user_id = 7 group by 1", 7)
dialect("slice_char_range", "Events", "select event_type, COUNT(value) as c from Events where event_type in ['c', 'q') group by event_type", "select event_type, count(value) c from events where event_type >= 'c' and event_type < 'q' group by 1")
dialect("slice_hex_range", "Sales", "select suppkey, COUNT(quantity) as c from Sales where suppkey in [10, 50] group by suppkey".replace("10", "?").replace("50", "?"), "select lpad(upper(to_hex(l_suppkey)), 16, '0') suppkey, count(l_quantity) c from lineitem where l_suppkey between 10 and 50 group by 1", 10, 50)
dialect("slice_two_dims", "Events", f"select event_type, SUM(value) as v from Events where event_type in ['click', 'purchase'], ts in [{_A}, {_B}) group by event_type", f"select event_type, round(sum(value), 4) v from events where event_type between 'click' and 'purchase' and {_H} >= timestamp '2024-01-05 03:00:00' and {_H} < timestamp '2024-01-20 17:00:00' group by 1")
dialect("slice_three_dims", "Events", f"select event_type, SUM(value) as v from Events where user_id in [?, ?], event_type in ['click', 'view'], ts in [{_A}, {_B}) group by event_type", f"select event_type, round(sum(value), 4) v from events where user_id between 3 and 60 and event_type between 'click' and 'view' and {_H} >= timestamp '2024-01-05 03:00:00' and {_H} < timestamp '2024-01-20 17:00:00' group by 1", 3, 60)


def _sales_slice(name: str, a: str, b: str, closed: bool = False) -> None:
    op = "<=" if closed else "<"
    dialect(name, "Sales", f"select returnflag, SUM(quantity) as q, COUNT(quantity) as c from Sales where shipdate in ['{a}', '{b}'{']' if closed else ')'} group by returnflag", f"select l_returnflag returnflag, round(sum(l_quantity), 2) q, count(l_quantity) c from lineitem where l_shipdate >= timestamp '{a} 00:00:00' and l_shipdate {op} timestamp '{b} 00:00:00' group by 1", digits=2)


_sales_slice("decomp_multi_month", "1996-01-15", "1998-03-02")
_sales_slice("decomp_month_aligned", "1996-02-01", "1997-05-01")
_sales_slice("decomp_single_month", "1996-02-03", "1996-02-20")
_sales_slice("decomp_closed_end", "1996-01-15", "1998-03-01", closed=True)
dialect("group_prefix_two", "Sales", "select returnflag, linestatus, SUM(quantity) as q from Sales group by returnflag, linestatus", "select l_returnflag returnflag, l_linestatus linestatus, round(sum(l_quantity), 2) q from lineitem group by 1, 2", digits=2)
dialect("group_hex_member", "Sales", "select suppkey as s, SUM(quantity) as q from Sales group by suppkey", "select lpad(upper(to_hex(l_suppkey)), 16, '0') s, round(sum(l_quantity), 2) q from lineitem group by 1", digits=2)
dialect("degenerate_prefix", "Events", "select user_id, event_type, SUM(value) as v from Events where user_id in [?] group by event_type", "select lpad(upper(to_hex(user_id)), 16, '0') user_id, event_type, round(sum(value), 4) v from events where user_id = 5 group by 1, 2", 5)
dialect("join_preamble", "Sales", "select priority, SUM(quantity) as q, AVG(discount) as disc from Sales where shipdate in ['1996-01-01', '1997-01-01') group by priority", "select o_orderpriority priority, round(sum(l_quantity), 2) q, round(avg(l_discount), 2) disc from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' group by 1", digits=2)
dialect("date_hierarchy", "Orders", "select status, COUNT(totalprice) as c, MAX(totalprice) as hi from Orders where orderdate in ['1996-03-05', '1997-11-20'] group by status", "select o_orderstatus status, count(o_totalprice) c, round(max(o_totalprice), 2) hi from orders where cast(o_orderdate as date) between date '1996-03-05' and date '1997-11-20' group by 1", digits=2)


@query("cuboid_choice_smallest", "select event_type, count(value) c, 'event_type' as cuboid from events group by 1")
def _choice(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").add_group_by("event_type").select_dimension("event_type").select("COUNT", "value", "c")
    return q.execute().withColumn("cuboid", F.lit(q.cuboid().path))


# --- nulls and codecs ----------------------------------------------------------------------


def _variant(spark: SparkSession, facts: DataFrame, dim, measure: str = "value") -> Engine:
    cube = Cube.of("Variant", [dim], [[dim.name]], [NumericMeasure(measure)])
    engine = new_engine(spark)
    engine.deploy(cube)
    engine.compile(cube, facts, "all")
    return engine


@query("nullkey_dimension", "select coalesce(nullif(event_type, 'error'), '') k, count(value) c from events group by 1")
def _nullkey(spark: SparkSession, d: str) -> DataFrame:
    facts = _read(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("k"), "value")
    return _variant(spark, facts, UTF8CharDimension("k", 20, True, "")).sql("select k, COUNT(value) as c from Variant group by k")


@query("null_measure_group", "select event_type k, round(sum(case when event_type <> 'error' then value end), 4) v, count(case when event_type <> 'error' then value end) c from events group by 1")
def _null_measure(spark: SparkSession, d: str) -> DataFrame:
    facts = _read(spark, d, "events").select(F.col("event_type").alias("k"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rounded(_variant(spark, facts, UTF8CharDimension("k", 20)).sql("select k, SUM(value) as v, COUNT(value) as c from Variant group by k"))


@query("truncate_char", "select substr(event_type, 1, 3) k, count(value) c from events group by 1")
def _truncate(spark: SparkSession, d: str) -> DataFrame:
    return _variant(spark, _read(spark, d, "events").select(F.col("event_type").alias("k"), "value"), UTF8CharDimension("k", 3)).sql("select k, COUNT(value) as c from Variant group by k")


@query("hex_binary_member", "select lpad(hex(dim1), 32, '0') k, count(\"impCnt\") c from compiler_input where dim1 is not null group by 1")
def _hex_binary(spark: SparkSession, d: str) -> DataFrame:
    facts = _read(spark, d, "compiler_input").filter("dim1 is not null").select(F.col("dim1").alias("k"), F.col("impCnt").alias("value"))
    return _variant(spark, facts, HexDimension("k", 16)).sql("select k, COUNT(value) as c from Variant group by k")


@query("member_times", f"select {_H} as h, count(value) c from events where {_H} < timestamp '2024-01-03 00:00:00' group by 1")
def _member_times(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").group_by_level("ts", 2).add_half_open_slice("ts", None, "2024-01-03").members()
    return q.select_dimension("ts", "h").select("COUNT", "value", "c").execute()


# --- parameters, prepared queries, builder ----------------------------------------------------

dialect("param_values", "Events", "select event_type, SUM(value) as v from Events where ts in [?, ?) group by event_type", f"select event_type, round(sum(value), 4) v from events where {_H} >= timestamp '2024-01-08 00:00:00' and {_H} < timestamp '2024-01-09 00:00:00' group by 1", 1_704_672_000_000, 1_704_758_400_000)
dialect("param_identifiers", "Events", "select ?, ?(?) as v from ? where ? in [?, ?) group by ?", f"select event_type, round(sum(value), 4) v from events where {_H} >= timestamp '2024-01-08 00:00:00' and {_H} < timestamp '2024-01-12 00:00:00' group by 1", "event_type", "SUM", "value", "Events", "ts", "2024-01-08", "2024-01-12", "event_type")
dialect("param_aliases", "Events", "select event_type as ?, COUNT(value) as ? from Events group by event_type", "select event_type kind, count(value) n from events group by 1", "kind", "n")
dialect("comments_and_default_alias", "Events", "select event_type, // the group\n SUM(value) /* default\n alias */ from Events group by event_type", 'select event_type, round(sum(value), 4) "SUM_value" from events group by 1')


@query("prepared_reuse", f"select 'a' as tag, event_type, count(value) c from events where {_H} < timestamp '2024-01-10 00:00:00' group by 2 union all select 'b', event_type, count(value) from events where {_H} < timestamp '2024-01-20 00:00:00' group by 2")
def _prepared(spark: SparkSession, d: str) -> DataFrame:
    p = compiled(spark, d, "Events").prepare("select event_type, COUNT(value) as c from Events where ts in ['2000-01-01', ?) group by event_type")
    a, b = (p.set(0, t).execute().withColumn("tag", F.lit(k)) for k, t in (("a", "2024-01-10"), ("b", "2024-01-20")))
    return a.unionByName(b).select("tag", "event_type", "c")


@query("builder_api", SQL["slice_two_dims"])
def _builder(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").add_closed_slice("event_type", "click", "purchase").add_half_open_slice("ts", "2024-01-05 03:00", "2024-01-20 17:00")
    return rounded(q.add_group_by("event_type").select_dimension("event_type").select("SUM", "value", "v").execute())


@query("builder_all_functions", 'select event_type, count(value) "COUNT_value", round(sum(value), 2) "SUM_value", round(sum(value * value), 2) "SUM_SQ_value", round(avg(value), 2) "AVG_value", round(var_pop(value), 2) "VAR_value", round(stddev_pop(value), 2) "SD_value", round(min(value), 2) "MIN_value", round(max(value), 2) "MAX_value" from events group by 1')
def _builder_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compiled(spark, d, "Events").query("Events").add_group_by("event_type").select_dimension("event_type").add_measure("value").execute(), 2)


# --- incremental compile -----------------------------------------------------------------------

_SMALL = Cube.of("Small", [UTF8CharDimension("event_type", 20), TimeHourHierarchy("ts")], [Cuboid(("event_type", "ts"), compiler_group="realtime"), Cuboid(("event_type",), compiler_group="daily")], [NumericMeasure("value"), IrregularSampleMeasure("valueSeries")], [canny_avg("cannyAvg7d", 0, WEEK)])
_WHOLE_SQL = f"select event_type, round(sum(value), 4) v, count(value) c from events where {_H} >= timestamp '2024-01-03 04:00:00' group by 1"
_WHOLE = "select event_type, SUM(value) as v, COUNT(value) as c from Small where ts in ['2024-01-03 04:00', inf) group by event_type"


def _small(spark: SparkSession) -> Engine:
    engine = new_engine(spark)
    engine.deploy(_SMALL)
    return engine


def _quarters(spark: SparkSession, d: str) -> list[DataFrame]:
    facts = event_facts(spark, d)
    return [facts.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)]


@query("incremental_batches", _WHOLE_SQL)
def _incremental(spark: SparkSession, d: str) -> DataFrame:
    e = _small(spark)
    for i, part in enumerate(_quarters(spark, d)):
        e.compile("Small", part, f"b{i}")
    return rounded(e.sql(_WHOLE))


@query("batch_rerun_idempotent", _WHOLE_SQL)
def _rerun(spark: SparkSession, d: str) -> DataFrame:
    e = _small(spark)
    for i, part in [*enumerate(_quarters(spark, d)), (2, _quarters(spark, d)[2])]:
        e.compile("Small", part, f"b{i}")
    return rounded(e.sql(_WHOLE))


@query("late_data", _WHOLE_SQL)
def _late(spark: SparkSession, d: str) -> DataFrame:
    e, facts = _small(spark), event_facts(spark, d)
    for i, (a, b) in enumerate([("2024-01-20", "2025-01-01"), ("2024-01-10", "2024-01-20"), ("2000-01-01", "2024-01-10")]):
        e.compile("Small", facts.filter((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))), f"b{i}")
    return rounded(e.sql(_WHOLE))


@query("compaction", _WHOLE_SQL)
def _compaction(spark: SparkSession, d: str) -> DataFrame:
    e = _small(spark)
    for i, part in enumerate(_quarters(spark, d)):
        e.compile("Small", part, f"b{i}")
    e.compact("Small")
    e.compile("Small", _quarters(spark, d)[0], "b0", absorbed="skip")  # in there already
    return rounded(e.sql(_WHOLE))


@query("include_exclude_measures", f"select event_type, count(value) c, count(value) s, round(sum(value), 4) v from events where {_H} >= timestamp '2024-01-03 04:00:00' group by 1")
def _include(spark: SparkSession, d: str) -> DataFrame:
    e, facts = _small(spark), event_facts(spark, d)
    e.compile("Small", facts.drop("valueSeries"), "numbers", include=["value"])
    e.compile("Small", facts.drop("value"), "samples", exclude=["value"])
    return rounded(e.sql("select event_type, COUNT(value) as c, COUNT(valueSeries) as s, SUM(value) as v from Small where ts in ['2024-01-03 04:00', inf) group by event_type"))


@query("excluded_measure_is_empty", "select event_type, cast(0 as bigint) c, cast(null as double) v from events group by 1")
def _excluded(spark: SparkSession, d: str) -> DataFrame:
    e = _small(spark)
    e.compile("Small", event_facts(spark, d).drop("value"), "samples", exclude=["value"])
    return e.sql("select event_type, COUNT(value) as c, SUM(value) as v from Small group by event_type")


@query("compiler_group", _WHOLE_SQL)
def _group(spark: SparkSession, d: str) -> DataFrame:
    e = _small(spark)
    e.compile("Small", event_facts(spark, d), "all", groups=["realtime"])
    return rounded(e.sql(_WHOLE))


def _aged(spark: SparkSession, d: str) -> Engine:
    """A cube with a TTL of an hour and two batches, the second of which is made two hours older than it is."""
    cube = Cube.of("Small", _SMALL.dimensions.values(), [Cuboid(("event_type", "ts"), ttl=3600)], [NumericMeasure("value")])
    e, facts = new_engine(spark), event_facts(spark, d)
    e.deploy(cube)
    e.compile(cube, facts.filter(F.hour("ts") % 2 == 1), "new")
    e.compile(cube, facts.filter(F.hour("ts") % 2 == 0), "old")
    c = cube.cuboids[0]
    table, batches = e.catalog.table(cube, c), e.catalog.manifest(cube, c)
    old = batches["old"]
    spark.read.schema(cell_schema(cube, c, ["value"])).parquet(f"{table}/{old['path']}").withColumn("_written", F.col("_written") - 7200).write.partitionBy("ts_level").parquet(f"{table}/_attempt=older")
    e.catalog.update_manifest(cube, c, lambda m: m | {"old": old | {"path": "_attempt=older", "written": old["written"] - 7200}})
    return e


def _hours_left(e: Engine) -> DataFrame:
    # hour cells of the old batch are gone; a month's cell has been written by the new one too, so it stays whole
    hours = e.query("Small").add_group_by("event_type").group_by_level("ts", 2).select_dimension("event_type").select("COUNT", "value", "c").execute()
    return hours.groupBy("event_type").agg(F.sum("c").alias("c"))


_YOUNG = "select event_type, count(value) c from events where hour(ts) % 2 = 1 group by 1"


@query("ttl_on_read", _YOUNG)
def _ttl_read(spark: SparkSession, d: str) -> DataFrame:
    return _hours_left(_aged(spark, d))


@query("ttl_compaction", _YOUNG)
def _ttl(spark: SparkSession, d: str) -> DataFrame:
    e = _aged(spark, d)
    e.compact("Small", now=int(time.time()))
    return _hours_left(e)


@query("stream_foreach_batch", _WHOLE_SQL)
def _stream(spark: SparkSession, d: str) -> DataFrame:
    e = _small(spark)
    source = f"{e.catalog.warehouse}/incoming"
    raw = _read(spark, d, "events")
    for i in range(3):
        raw.filter(F.pmod("event_id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(source)
    facts = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(source)
    facts = facts.withColumn("valueSeries", F.struct(F.col("value").alias("x"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t")))
    e.compile_stream("Small", facts, "events", f"{e.catalog.warehouse}/checkpoint").awaitTermination()
    return rounded(e.sql(_WHOLE))


@query("multi_stream_ctr", "select lpad(upper(to_hex(user_id)), 16, '0') user_id, count(*) filter (event_type = 'click') clicks, count(*) filter (event_type = 'view') views from events group by 1 having count(*) filter (event_type in ('click', 'view')) > 0")
def _ctr(spark: SparkSession, d: str) -> DataFrame:
    cube = Cube.of("Ctr", [HexDimension("user_id", 8)], [["user_id"]], [NumericMeasure("clicks"), NumericMeasure("views")])
    e, facts = new_engine(spark), _read(spark, d, "events")
    e.deploy(cube)
    for kind, m in (("click", "clicks"), ("view", "views")):
        e.compile(cube, facts.filter(F.col("event_type") == kind).select("user_id", F.lit(1).alias(m)), m, include=[m])
    return e.sql("select user_id, COUNT(clicks) as clicks, COUNT(views) as views from Ctr group by user_id")


@query("two_hierarchies", "select k, count(value) c from (select event_type k, value, ts a, ts + interval 40 day b from events) where date_trunc('hour', a) >= timestamp '2024-01-05 00:00:00' and date_trunc('day', b) <= timestamp '2024-02-25 00:00:00' group by 1")
def _two(spark: SparkSession, d: str) -> DataFrame:
    cube = Cube.of("Two", [UTF8CharDimension("k", 20), TimeHourHierarchy("a"), DateHierarchy("b")], [["a", "k", "b"]], [NumericMeasure("value")])
    e = new_engine(spark)
    e.deploy(cube)
    ts = F.col("ts")
    e.compile(cube, _read(spark, d, "events").select(F.col("event_type").alias("k"), ts.alias("a"), (ts + F.expr("interval 40 days")).alias("b"), "value"), "all")
    return e.sql("select k, COUNT(value) as c from Two where a in ['2024-01-05', inf), b in [-inf, '2024-02-25'] group by k".replace("-inf", "'1990-01-01'"))


# --- summarizers -------------------------------------------------------------------------------

_TM = "with m as (select event_type, value x, epoch_ms(ts)::double t, max(epoch_ms(ts)::double) over (partition by event_type) tm, min(epoch_ms(ts)::double) over (partition by event_type) t0 from events)"
_A_EXP, _A_CAN = "(604800000 / -ln(0.01))", "(604800000 / ln(400))"
_EXPW, _CANW, _CANV = f"exp((t - tm) / {_A_EXP})", f"exp((t - tm) / {_A_CAN})", f"exp((t - tm) / {_A_CAN} * 4 / 3)"
for _name, _fn, _value in (
    ("exp_avg", "expAvg7d", f"sum(x * {_EXPW}) / sum({_EXPW})"),
    ("exp_rate", "expRate7d", f"sum(x * {_EXPW}) / ({_A_EXP} * (1 - exp(-(max(tm) - min(t0)) / {_A_EXP}))) * 1e6"),
    ("canny_avg", "cannyAvg7d", f"(4 * sum(x * {_CANW}) - 3 * sum(x * {_CANV})) / (4 * sum({_CANW}) - 3 * sum({_CANV}))"),
    ("canny_rate", "cannyRate7d", f"(4 * sum(x * {_CANW}) - 3 * sum(x * {_CANV})) / (4 * {_A_CAN} * (1 - exp(-(max(tm) - min(t0)) / {_A_CAN})) - 3 * {_A_CAN} * 0.75 * (1 - exp(-(max(tm) - min(t0)) / {_A_CAN} * 4 / 3))) * 1e6"),
):
    query(_name, f"{_TM} select event_type, round({_value}, 4) v from m group by 1")(
        lambda spark, d, fn=_fn, times=1e6 if _name.endswith("rate") else 1.0: rounded(compiled(spark, d, "Events").sql(f"select event_type, {fn}(valueSeries) as v from Events group by event_type").withColumn("v", F.col("v") * times))
    )

_SLICED = _TM.replace("from events", "from events where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-15 00:00:00'")


@query("summarizer_slice_merge", f"{_SLICED} select event_type, round((4 * sum(x * {_CANW}) - 3 * sum(x * {_CANV})) / (4 * sum({_CANW}) - 3 * sum({_CANV})), 4) v from m group by 1")
def _slice_merge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compiled(spark, d, "Events").sql("select event_type, cannyAvg7d(valueSeries) as v from Events where ts in ['2024-01-05', '2024-01-15') group by event_type"))


_EXP = parse_init("type=EXP_AVG dt=604800000")
_CANNY = parse_init("type=CANNY_AVG dt=604800000 m=0.01 k=4")


def _states(spark: SparkSession, d: str, s: Summarizer, where: str = "true", x: Callable[[], Column] | None = None) -> DataFrame:
    return s.summarize(_read(spark, d, "events").filter(where), ["event_type"], F.col("value") if x is None else x(), F.unix_millis(F.col("ts").cast("timestamp")))


@query("summarizer_combine", SQL["canny_avg"])
def _combine(spark: SparkSession, d: str) -> DataFrame:
    a, b = (_states(spark, d, _CANNY, f"event_id % 2 = {i}").withColumnRenamed("state", f"s{i}") for i in (0, 1))
    return rounded(a.join(b, "event_type", "full").select("event_type", _CANNY.value(_CANNY.combine(F.col("s0"), F.col("s1"))).alias("v")))


@query("summarizer_complement", _TM.replace("from events", "from events where event_id % 2 = 1") + f" select event_type, round(sum(x * {_EXPW}) / sum({_EXPW}), 4) v from m group by 1")
def _complement(spark: SparkSession, d: str) -> DataFrame:
    whole, half = _states(spark, d, _EXP).withColumnRenamed("state", "whole"), _states(spark, d, _EXP, "event_id % 2 = 0")
    return rounded(whole.join(half, "event_type").select("event_type", _EXP.value_of_parts(_EXP.complement(F.col("whole"), F.col("state"))).alias("v")))


_ONES = f"with e as (select *, (value > 50)::int y from events), m as (select event_type, y x, epoch_ms(ts)::double t, max(epoch_ms(ts)::double) over (partition by event_type) tm from e) select event_type, round(sum(x * {_EXPW}) / sum({_EXPW}), 4) v from m group by 1"


@query("binomial_ones", _ONES)
def _binomial_ones(spark: SparkSession, d: str) -> DataFrame:
    trials = _states(spark, d, _EXP, x=lambda: F.lit(0.0)).withColumnRenamed("state", "trials")
    ones = _states(spark, d, _EXP, "value > 50", lambda: F.lit(1.0))
    return rounded(trials.join(ones, "event_type", "left").select("event_type", _EXP.value(_EXP.ones(F.col("trials"), F.col("state"))).alias("v")))


_NOW = 1_706_745_600_000  # 2024-02-01
_BIAS = parse_init("type=EXP_BIASED_BINOMIAL dt=604800000 p0=0.25 epsilon=0.5")
_BW = f"exp((t - {_NOW}) / {_A_EXP})"


@query("binomial_biased_now", f"with m as (select event_type, (value > 50)::int x, epoch_ms(ts)::double t from events), b as (select (0.5 - 1) / ln(0.5) as unit) select event_type, round((max(unit) + sum(x * {_BW})) / (max(unit) + max(unit) * 0.75 / 0.25 + sum({_BW})), 4) v from m, b group by 1")
def _biased(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d, _BIAS, x=lambda: (F.col("value") > 50).cast("double"))
    return rounded(s.select("event_type", _BIAS.value_now(F.col("state"), F.lit(float(_NOW))).alias("v")))


@query("rate_now", f"{_TM} select event_type, round(sum(x * {_BW}) / ({_A_EXP} * (1 - exp(-({_NOW} - min(t0)) / {_A_EXP}))) * 1e6, 4) v from m group by 1")
def _rate_now(spark: SparkSession, d: str) -> DataFrame:
    rate = parse_init("type=EXP_RATE dt=604800000")
    return rounded(_states(spark, d, rate).select("event_type", (rate.value_now(F.col("state"), F.lit(float(_NOW))) * 1e6).alias("v")))


@query("welford", "select event_type, round(avg(value), 3) mean, round(var_pop(value), 3) var from events group by 1")
def _welford(spark: SparkSession, d: str) -> DataFrame:
    parts = _read(spark, d, "events").groupBy("event_type", (F.col("event_id") % 7).alias("part")).agg(welford(F.col("value")).alias("s"))
    merged = welford_merge(parts, ["event_type"], "s")
    return rounded(merged.select("event_type", F.col("s.mean").alias("mean"), welford_variance(F.col("s")).alias("var")), 3)


_SAMPLE = "irregular_sample where name is not null and x is not null and t is not null and not isnan(x) and not isnan(t)"


@query("irregular_streams", f"with s as (select distinct name, x, t from {_SAMPLE}), m as (select *, max(t) over (partition by name) tm from s) select name, count(*) n, round(sum(x * exp((t - tm) / (600000 / ln(400)))) / sum(exp((t - tm) / (600000 / ln(400)))), 6) w from m group by 1")
def _irregular(spark: SparkSession, d: str) -> DataFrame:
    s = Summarizer("canny_avg", 600_000.0)
    samples = _read(spark, d, "irregular_sample").dropna().distinct()
    states = s.summarize(samples, ["name"], F.col("x"), F.col("t"))
    counts = samples.filter("not isnan(x) and not isnan(t)").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return rounded(states.join(counts, "name").select("name", "n", (F.col("state.s") / F.col("state.w")).alias("w")), 6)


# --- algebra and extensions ----------------------------------------------------------------------


@query("complement_slice", f"select event_type, round(sum(value), 4) v, count(value) c from events where not ({_H} >= timestamp '2024-01-10 00:00:00' and {_H} < timestamp '2024-01-12 00:00:00') group by 1")
def _complement_slice(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").add_complement_slice("ts", "2024-01-10", "2024-01-12").add_group_by("event_type")
    return rounded(q.select_dimension("event_type").select("SUM", "value", "v").select("COUNT", "value", "c").execute())


@query("ext_group_by_month", "select l_returnflag returnflag, strftime(l_shipdate, '%Y%m') as month, count(l_quantity) c from lineitem group by 1, 2")
def _by_month(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Sales").query("Sales").add_group_by("returnflag").group_by_level("shipdate", 1)
    return q.select_dimension("returnflag").select_dimension("shipdate", "month").select("COUNT", "quantity", "c").execute()


@query("ext_multi_slice", "select event_type, count(value) c from events where ts >= timestamp '2024-01-03 00:00:00' and ts < timestamp '2024-01-05 00:00:00' or ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 00:00:00' group by 1")
def _multi(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").allow_several_slices().add_half_open_slice("ts", "2024-01-03", "2024-01-05").add_half_open_slice("ts", "2024-01-10", "2024-01-11")
    return q.add_group_by("event_type").select_dimension("event_type").select("COUNT", "value", "c").execute()


@query("ext_having", "select lpad(upper(to_hex(l_suppkey)), 16, '0') suppkey, count(l_quantity) c from lineitem group by 1 having count(l_quantity) > 610")
def _having(spark: SparkSession, d: str) -> DataFrame:
    return compiled(spark, d, "Sales").sql("select suppkey, COUNT(quantity) as c from Sales group by suppkey").filter("c > 610")


@query("ext_topk", "select lpad(upper(to_hex(l_suppkey)), 16, '0') suppkey, count(l_quantity) c from lineitem group by 1 order by c desc, suppkey limit 10")
def _topk(spark: SparkSession, d: str) -> DataFrame:
    return compiled(spark, d, "Sales").sql("select suppkey, COUNT(quantity) as c from Sales group by suppkey").orderBy(F.desc("c"), "suppkey").limit(10)


# --- functions and states of the model's own ------------------------------------------------------


@query("custom_function", "select event_type k, round(exp(avg(ln(value + 1))), 4) g from events group by 1")
def _custom(spark: SparkSession, d: str) -> DataFrame:
    geometric = register(AggFunction("GEOMEAN", ("cnt",), lambda p: F.exp(p["logs"] / p["cnt"]), (("logs", Field(lambda x: F.sum(F.log(x)), F.sum)),)))
    cube = Cube.of("Own", [UTF8CharDimension("k", 20)], [["k"]], [NumericMeasure("x")], [geometric])
    e = new_engine(spark)
    e.deploy(cube)
    for i, part in enumerate(_quarters(spark, d)):
        e.compile(cube, part.select(F.col("event_type").alias("k"), (F.col("value") + 1).alias("x")), f"b{i}")
    return rounded(e.sql("select k, GEOMEAN(x) as g from Own group by k"))


@query("distinct_function", "select event_type k, count(distinct user_id) > 0 as near from events group by 1")
def _distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users by a mergeable sketch as a cube's function: near the exact number within five standard errors."""
    users = register(distinct("USERS", 12))
    cube = Cube.of("Users", [UTF8CharDimension("k", 20), TimeHourHierarchy("ts")], [["k", "ts"]], [NumericMeasure("user")], [users])
    e, facts = new_engine(spark), _read(spark, d, "events").select(F.col("event_type").alias("k"), "ts", F.col("user_id").alias("user"))
    e.deploy(cube)
    e.compile(cube, facts, "all")
    exact = facts.groupBy("k").agg(F.count_distinct("user").alias("x"))
    return e.sql("select k, USERS(user) as n from Users group by k").join(exact, "k").select("k", (F.abs(F.col("n") - F.col("x")) <= 5 * 1.04 / 64 * F.col("x")).alias("near"))


@query("state_of_facts", "select event_type, count(value) cnt, round(sum(value), 4) s, round(sum(value * value), 2) sq, round(min(value), 4) lo, round(max(value), 4) hi from events group by 1")
def _state_of_facts(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "events").select("event_type", state_of_fact(F.col("value")).alias("s"))
    merged = s.groupBy("event_type").agg(F.sum("s.cnt").alias("cnt"), F.round(F.sum("s.sum"), 4).alias("s"), F.round(F.sum("s.sum_sq"), 2).alias("sq"), F.round(F.min("s.min"), 4).alias("lo"), F.round(F.max("s.max"), 4).alias("hi"))
    return merged


@query("summarizer_new", SQL["canny_avg"])
def _new_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_states(spark, d, _CANNY).select("event_type", _CANNY.value(_CANNY.combine(_CANNY.new(), F.col("state"), _CANNY.new())).alias("v")))


_CBIAS = parse_init("type=CANNY_BIASED_BINOMIAL dt=604800000 p0=0.75 epsilon=0.5")
_CBW, _CBV = (f"exp((t - {_NOW}) / {_A_CAN}{x})" for x in ("", " * 4 / 3"))


@query("canny_binomial_now", f"with m as (select event_type, (value > 50)::int x, epoch_ms(ts)::double t from events), b as (select (0.5 - 1) / ln(0.5) as unit) select event_type, round((max(unit) * 0.75 / 0.25 + 4 * sum(x * {_CBW}) - 3 * sum(x * {_CBV})) / (max(unit) + max(unit) * 0.75 / 0.25 + 4 * sum({_CBW}) - 3 * sum({_CBV})), 4) v from m, b group by 1")
def _canny_binomial(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d, _CBIAS, x=lambda: (F.col("value") > 50).cast("double"))
    return rounded(s.select("event_type", _CBIAS.value_now(F.col("state"), F.lit(float(_NOW))).alias("v")))


@query("rate_first_time", "select event_type, (epoch_us(min(ts)) // 1000)::double first_t, (epoch_us(max(ts)) // 1000)::double last_t from events group by 1")
def _first_time(spark: SparkSession, d: str) -> DataFrame:
    rate = parse_init("type=EXP_RATE dt=604800000")
    return _states(spark, d, rate).select("event_type", rate.first_time(F.col("state")).alias("first_t"), F.col("state.t").alias("last_t"))


@query("short_time_constant", "with m as (select event_type, value x, epoch_ms(ts)::double t, max(epoch_ms(ts)::double) over (partition by event_type) tm from events) select event_type, round(sum(x * exp((t - tm) / (5 / -ln(0.01)))) / sum(exp((t - tm) / (5 / -ln(0.01)))), 4) v from m group by 1")
def _short(spark: SparkSession, d: str) -> DataFrame:
    """An average with dt = 5 ms, through hour, month and ALL cells."""
    cube = Cube.of("Short", [UTF8CharDimension("event_type", 20), TimeHourHierarchy("ts")], [["event_type", "ts"]], [IrregularSampleMeasure("valueSeries")], [SummaryFunction("avg5", 0, Summarizer("exp_avg", 5.0))])
    e = new_engine(spark)
    e.deploy(cube)
    e.compile(cube, event_facts(spark, d), "all")
    return rounded(e.sql("select event_type, avg5(valueSeries) as v from Short group by event_type"))


# --- keys, models, sinks -------------------------------------------------------------------------


@query("codec_keys", "select distinct lpad(hex(dim1), 32, '0') h, regexp_full_match(hex(dim1), '[0-9A-Fa-f]{32}') as is_id, lpad(cast(octet_length(dim1) as varchar), 4, '0') n, lpad(cast(octet_length(dim1) as varchar), 4, '0') || lpad(hex(dim1), 32, '0') as key from compiler_input where dim1 is not null")
def _codecs(spark: SparkSession, d: str) -> DataFrame:
    f = _read(spark, d, "compiler_input").filter("dim1 is not null")
    h, n = codecs.hex_key(F.col("dim1"), 16), codecs.decimal_key(F.length("dim1"), 4)
    return f.select(h.alias("h"), codecs.is_hex_id(F.hex("dim1"), 16).alias("is_id"), n.alias("n"), codecs.composite_key(n, h).alias("key")).distinct()


@query("cuboid_consistency", "select p as cuboid, count(value) c, round(sum(value), 3) v from events, (select unnest(['event_type/ts', 'user_id/ts', 'user_id/event_type/ts', 'event_type', 'user_id/event_type']) p) group by 1")
def _consistency(spark: SparkSession, d: str) -> DataFrame:
    """Every cuboid of a cube holds the same facts."""
    e = compiled(spark, d, "Events")
    totals = []
    for c in EVENTS.cuboids:
        cells = read_cells(e.catalog, EVENTS, c)
        cells = cells.filter("ts_level = 0") if "ts" in c.dims else cells
        totals.append(cells.agg(F.sum("value__cnt").alias("c"), F.round(F.sum("value__sum"), 3).alias("v")).withColumn("cuboid", F.lit(c.path)))
    return reduce(DataFrame.unionByName, totals)


@query("text_sink", SQL["count_by_type"])
def _text(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "text")
    write_text(compiled(spark, d, "Events").sql("select event_type, COUNT(value) as c from Events group by event_type"), path)
    return spark.read.option("sep", "\t").schema("event_type string, c bigint").csv(path)


@query("frame_sink", "select hex(unhex(lpad(upper(to_hex(user_id)), 16, '0'))) user_id, round(sum(value), 4) v from events group by 1")
def _frame(spark: SparkSession, d: str) -> DataFrame:
    q = compiled(spark, d, "Events").query("Events").add_group_by("user_id").members().select_dimension("user_id").select("SUM", "value", "v")
    return rounded(spark.createDataFrame(to_frame(q.execute())))


@query("sample_application", "select lpad(to_hex(k), 32, '0') dim1, strftime(date '2011-09-01' + to_months(cast(m as integer)), '%Y%m') as month, sum(i + k + 1)::bigint n from range(2) a(k), range(10) b(m), range(120) c(i) group by 1, 2")
def _sample(spark: SparkSession, d: str) -> DataFrame:
    cube = Cube.of("Example", [HexDimension("dim1", 16), TimeHourHierarchy("impressionTime", 0)], [["dim1", "impressionTime"]], [NumericMeasure("impCnt")])
    e = new_engine(spark)
    e.deploy(cube)
    e.compile(cube, sample_facts(spark), "all")
    months = e.query("Example").add_group_by("dim1").group_by_level("impressionTime", 1).select_dimension("dim1").select_dimension("impressionTime", "month").select("COUNT", "impCnt", "n").execute()
    return months.filter("month <> '197001'").select("dim1", "month", "n")


@query("model_store", "select unnest(['v1', 'v2']) as version, true as equal, 0 as batches")
def _store(spark: SparkSession, d: str) -> DataFrame:
    """Models are kept in versions and survive a drop of the data."""
    e = _small(spark)
    e.drop("Small")
    e.deploy(_SMALL)
    again = Catalog(spark, e.catalog.warehouse)
    same = again.load_model("Small") == _SMALL
    batches = sum(len(again.manifest(_SMALL, c)) for c in _SMALL.cuboids)
    return spark.createDataFrame([(f"v{v}", same, batches) for v in again.versions("Small")], "version string, equal boolean, batches int")


_BAD = {"no cube": "select SUM(value) as v from Nowhere", "no measure": "select SUM(nothing) as v from Events", "no function": "select MEDIAN(value) as v from Events", "not grouped": "select user_id, SUM(value) as v from Events group by event_type", "no measures": "select event_type from Events group by event_type", "same alias": "select SUM(value) as v, COUNT(value) as v from Events", "no cuboid": "select SUM(value) as v from Events where value in [1]", "syntax": "select SUM(value as v from Events"}


@query("refused_queries", f"select unnest({list(_BAD)}) as why, true as refused")
def _refused(spark: SparkSession, d: str) -> DataFrame:
    e, out = compiled(spark, d, "Events"), []
    for why, text in _BAD.items():
        try:
            e.sql(text)
            out.append((why, False))
        except ValueError:  # ModelError and QuerySyntaxError
            out.append((why, True))
    return spark.createDataFrame(out, "why string, refused boolean")
