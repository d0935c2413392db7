"""Queries over ``compiler_input`` for rolling totals and for skewed keys, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetcube.operators.dense import holding_share, member_results
from facetcube.operators.rolling import corrected_totals, rolling_totals, surges_and_lulls
from facetcube.plans.fact_sql import FACTS, key_of_day


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/compiler_input.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surges_and_lulls(_facts(spark, sf_dir))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_totals(_facts(spark, sf_dir))


def p2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected_totals(_facts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holding_share(member_results(_facts(spark, sf_dir)), 0.02).select("field", F.hex("item").alias("item"))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = member_results(_facts(spark, sf_dir))
    return r.select("field", F.hex("item").alias("item"), "facts", "sum_impCnt", "n_impCnt", "sum_click", "n_click")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_totals, p2_versions, p4_found, p4_members)}

_DAILY = f"""with {FACTS},
 daily as (select d1, day, sum(coalesce(imp, 0)) i, sum(coalesce(clk, 0)) c from facts where d1 is not null and day is not null and day <= 19812 group by 1, 2),
 days as (select d1, unnest(range(min(day), 19813)) as day, min(day) as first_day from daily group by 1),
 rolled as (select d.d1, d.day, d.first_day,
   sum(coalesce(i, 0)) over w7 i7, sum(coalesce(i, 0)) over w30 i30, sum(coalesce(c, 0)) over w7 c7, sum(coalesce(c, 0)) over w30 c30
   from days d left join daily a on a.d1 = d.d1 and a.day = d.day
   window w7 as (partition by d.d1 order by d.day rows between 6 preceding and current row), w30 as (partition by d.d1 order by d.day rows between 29 preceding and current row))"""

SQL: dict[str, str] = {
    "p2_found": f"""{_DAILY}, late as (select * from rolled where day >= first_day + 29)
 select d1 as dim1, {key_of_day("day")} as on_day, kind from (
  select d1, day, 'imp_surge' as kind from late where i30 >= 60 and i7 >= 0.6 * i30
  union all select d1, day, 'click_surge' from late where c30 >= 10 and c7 >= 0.6 * c30
  union all select d1, day, 'lull' from late where i30 >= 60 and i7 = 0)""",
    "p2_totals": f"""{_DAILY} select d1 as dim1, {key_of_day("day")} as on_day,
  cast(i7 as bigint) imp_7, round(i7 / 7, 6) avg_imp_7, cast(i30 as bigint) imp_30, round(i30 / 30, 6) avg_imp_30,
  cast(c7 as bigint) click_7, round(c7 / 7, 6) avg_click_7, cast(c30 as bigint) click_30, round(c30 / 30, 6) avg_click_30 from rolled""",
    "p2_versions": f"""with {FACTS}, arrived as (select fact_id, min(arrived_at) as at from compiler_input group by 1),
 dated as (select f.d1, f.day, coalesce(f.imp, 0) i, coalesce(f.clk, 0) c, coalesce(cast(a.at as date) > date '1970-01-01' + f.day, false) late from facts f join arrived a using (fact_id) where d1 is not null and day is not null and day <= 19812),
 daily as (select d1, day, sum(i) i, sum(c) c, coalesce(sum(i) filter (late), 0) li, coalesce(sum(c) filter (late), 0) lc, count(*) filter (late) n from dated group by 1, 2),
 days as (select d1, unnest(range(min(day), 19813)) as day from daily group by 1),
 rolled as (select d.d1, d.day, coalesce(sum(i) over w, 0) i30, coalesce(sum(c) over w, 0) c30, coalesce(sum(li) over w, 0) li30, coalesce(sum(lc) over w, 0) lc30, sum(n) over w as fixes
  from days d left join daily a on a.d1 = d.d1 and a.day = d.day window w as (partition by d.d1 order by d.day rows between 29 preceding and current row))
 select d1 as dim1, {key_of_day("day")} as on_day, 1 as version, cast(i30 as bigint) imp_30, cast(i30 - li30 as bigint) v0_imp_30, cast(c30 as bigint) click_30, cast(c30 - lc30 as bigint) v0_click_30 from rolled where fixes > 0""",
    "p4_found": f"""with {FACTS}, m as (select 'dim1' field, d1 item from facts where d1 is not null union all select 'dim2', d2 from facts where d2 is not null)
 select field, item from (select field, item, count(*) n, sum(count(*)) over (partition by field) total from m group by 1, 2) where n >= 0.02 * total""",
    "p4_members": f"""with {FACTS}, m as (select 'dim1' field, d1 item, imp, clk from facts where d1 is not null union all select 'dim2', d2, imp, clk from facts where d2 is not null)
 select field, item, count(*) facts, cast(sum(coalesce(imp, 0)) as bigint) "sum_impCnt", count(imp) "n_impCnt", cast(sum(coalesce(clk, 0)) as bigint) "sum_click", count(clk) "n_click" from m group by 1, 2""",
}
