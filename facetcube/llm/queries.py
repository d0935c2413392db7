"""Queries of the operators in this subpackage, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetcube.llm import bpe, dyadic, heavy, language, leaks, setsketch, topn
from facetcube.operators.facts import day_key
from facetcube.plans.fact_sql import FACTS, key_of_day


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.frequent_members(_table(spark, sf_dir, "compiler_input")).select("field", "item")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.frequent_members(_table(spark, sf_dir, "compiler_input")).select("field", "item", "facts")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.narrow_and_wide(_table(spark, sf_dir, "compiler_input"))


def p3_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates with their stated error, for all spans."""
    s = setsketch.SetSketch()
    e = setsketch.distinct_members(_table(spark, sf_dir, "compiler_input"), s, least=1)
    return e.select(F.col("grp").alias("chardim1"), "span_key", "n", "estimate", (F.col("estimate") * s.error).alias("standard_error"))


def p3_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and Jaccard similarity of consecutive months of each charDim1 member."""
    return setsketch.joint_months(setsketch.distinct_members(_table(spark, sf_dir, "compiler_input"), least=1))


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of span: spans, and how many of their estimates lie within six standard errors of the exact count."""
    facts, s = _table(spark, sf_dir, "compiler_input"), setsketch.SetSketch()
    day = day_key(F.col("day"))
    keys = F.array(F.struct(F.lit("day").alias("span"), day.cast("int").alias("span_key")), F.struct(F.lit("month").alias("span"), F.floor(day / 100).cast("int").alias("span_key")), F.struct(F.lit("all").alias("span"), F.lit(0).alias("span_key")))
    exact = setsketch.audience(facts).distinct().select("grp", "h", F.explode(keys).alias("k")).groupBy("grp", "k.span", "k.span_key").agg(F.count_distinct("h").alias("x"))
    e = setsketch.distinct_members(facts, s, least=1).drop("registers").join(exact, ["grp", "span", "span_key"], "full")
    within = F.coalesce(F.abs(F.col("estimate") - F.col("x")) <= 6 * s.error * F.col("x"), F.lit(False))
    return e.groupBy("span").agg(F.count(F.lit(1)).alias("spans"), F.count_if(within).alias("near"))


def p3_joint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each month: its pairs with the next one, and how many unions, intersections and similarities lie within six standard errors of the exact ones."""
    facts, s = _table(spark, sf_dir, "compiler_input"), setsketch.SetSketch()
    sets = setsketch.audience(facts).select("grp", F.floor(day_key(F.col("day")) / 100).cast("int").alias("month"), "h").distinct()
    sizes = sets.groupBy("grp", "month").agg(F.count(F.lit(1)).alias("x"))
    before = F.when(F.col("month") % 100 == 1, F.col("month") - 89).otherwise(F.col("month") - 1)
    both = sets.join(sets.select("grp", "h", before.alias("month")), ["grp", "month", "h"]).groupBy("grp", "month").agg(F.count(F.lit(1)).alias("i"))
    exact = sizes.join(sizes.select("grp", before.alias("month"), F.col("x").alias("y")), ["grp", "month"]).join(both, ["grp", "month"], "left")
    e = setsketch.joint_months(setsketch.distinct_members(facts, s, least=1), s).join(exact, ["grp", "month"], "full").fillna(0, ["i"])
    u, stated = F.col("x") + F.col("y") - F.col("i"), F.greatest("jaccard_error", F.lit(0.01))  # the error vanishes for equal and for disjoint sets
    near = lambda c, x, error: F.count_if(F.coalesce(F.abs(F.col(c) - x) <= 6 * error, F.lit(False))).alias(c)
    # an intersection is a share of the union: it is as far off as both are
    return e.groupBy("month").agg(F.count(F.lit(1)).alias("pairs"), near("union", u, s.error * u), near("intersection", F.col("i"), stated * u + s.error * F.col("i")), near("jaccard", F.col("i") / u, stated))


def p5_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source and measure: groups, and in how many of them the exact percentiles lie within the stated bounds."""
    ps = (25, 50, 75, 90, 99)
    rows = dyadic.value_rows(_table(spark, sf_dir, "compiler_input"), _table(spark, sf_dir, "aggregation"))
    exact = dyadic.exact_percentiles(rows, ps).select("grp", "series", F.col("n").alias("x"), *(F.col(f"p{p}").alias(f"x{p}") for p in ps))
    e = dyadic.named(dyadic.percentiles(dyadic.states(rows), ps).join(exact, ["grp", "series"], "full"))
    within = lambda p: F.count_if(F.coalesce((F.col("n") == F.col("x")) & F.col(f"x{p}").between(F.col(f"lo{p}"), F.col(f"hi{p}")), F.lit(False))).alias(f"within_{p}")
    return e.groupBy("src", "measure").agg(F.count(F.lit(1)).alias("groups"), *map(within, ps))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dyadic.heavy_tails(_table(spark, sf_dir, "compiler_input"), _table(spark, sf_dir, "aggregation"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated quartiles, 90th and 99th percentile of every group, with their bounds."""
    rows = dyadic.value_rows(_table(spark, sf_dir, "compiler_input"), _table(spark, sf_dir, "aggregation"))
    return dyadic.named(dyadic.percentiles(dyadic.states(rows), (25, 50, 75, 90, 99))).drop("grp", "series")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.best_pairs(_table(spark, sf_dir, "compiler_input"))
    return best.select(F.hex("grp").alias("dim1"), F.hex("item").alias("dim2"), "place")


#: Folder of the public tokenizers.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), bpe.Vocabulary.load(f"{TOKENIZERS}/byte_bpe_50k.json"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = leaks.index_of(_table(spark, sf_dir, "eval_items"))
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), index).select("doc_id", "item_id")


def _model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.load(_table(spark, sf_dir, "lang_samples"), f"{TOKENIZERS}/piece_bpe_32k.model")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), _model(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(_languages(spark, sf_dir)).select("doc_id", "par_no", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and paragraph (null where none of the languages has nine tenths), its confidence, and that of none."""
    e = _languages(spark, sf_dir)
    return e.select("doc_id", "par_no", F.when(F.col("none") <= 0.9, F.col("lang")).alias("lang"), "confidence", F.col("none").alias("none_of_these"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the paragraphs that mix languages, with their confidence."""
    return language.mixed(_table(spark, sf_dir, "documents"), _model(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_estimates, p3_audit, p3_joint, p3_joint_audit, p5_found, p5_percentiles, p5_audit, p6_found, p7_ids, p8_found, p9_found, p9_languages, p9_segments)}

_CARRIED = f"""with {FACTS}, m as (select 'charDim1' field, c1 item from facts where c1 is not null union all select 'dim3', d3 from facts where d3 is not null),
 counted as (select field, item, count(*) facts, sum(count(*)) over (partition by field) total from m group by 1, 2)"""

_VALUES = f"""with {FACTS}, cells as (select distinct cuboid, dim1, time_key, measure, batch_id, hex(customStates[2]) h from aggregation where time_level = 2 and octet_length(customStates[2]) >= 8),
 v as (select 'compiler_input' src, d2 item, 'impCnt' measure, imp x from facts where d2 is not null and imp is not null
  union all select 'compiler_input', d2, 'click', clk from facts where d2 is not null and clk is not null
  union all select 'aggregation', upper(dim1), measure, cast('0x' || substr(h, 16 * i + 1, 16) as bigint) from (select *, unnest(range(cast(length(h) // 16 as bigint))) i from cells)),
 r as (select *, row_number() over (partition by src, item, measure order by x) k, count(*) over (partition by src, item, measure) n from v),
 p as (select src, item, measure, n, min(case when k * 100 >= n * 50 then x end) p50, min(case when k * 100 >= n * 90 then x end) p90 from r group by 1, 2, 3, 4)"""

SQL: dict[str, str] = {
    "p1_found": f"{_CARRIED} select field, item from counted where facts >= 0.02 * total",
    "p1_counts": f"{_CARRIED} select field, item, facts from counted where facts >= 0.02 * total",
    "p3_found": f"""with {FACTS}, k as (select c1, {key_of_day("day")} as d, d1 from facts where c1 is not null and day is not null and d1 is not null),
 s as (select c1, d as span_key, d1 from k union all select c1, d // 100, d1 from k union all select c1, 0, d1 from k),
 r as (select c1, span_key, count(*) n, count(distinct d1) x from s group by 1, 2 having count(*) >= 40)
 select c1 as chardim1, cast(span_key as integer) span_key, case when x <= 0.15 * n then 'narrow' else 'wide' end as kind from r where x <= 0.15 * n or x >= 0.85 * n""",
    "p3_audit": f"""with {FACTS}, k as (select c1, {key_of_day("day")} as d from facts where c1 is not null and day is not null and d1 is not null),
 s as (select 'day' span, c1, d as span_key from k union select 'month', c1, d // 100 from k union select 'all', c1, 0 from k)
 select span, count(*) spans, count(*) near from s group by 1""",
    "p3_joint_audit": f"""with {FACTS}, m as (select distinct c1, {key_of_day("day")} // 100 as y from facts where c1 is not null and day is not null and d1 is not null)
 select cast(a.y as integer) as month, count(*) pairs, count(*) "union", count(*) intersection, count(*) jaccard from m a join m b on a.c1 = b.c1 and b.y = case when a.y % 100 = 12 then a.y + 89 else a.y + 1 end group by 1""",
    "p5_audit": f"{_VALUES} select src, measure, count(*) groups, count(*) within_25, count(*) within_50, count(*) within_75, count(*) within_90, count(*) within_99 from p group by 1, 2",
    "p5_found": f"{_VALUES} select src, item, measure from p where n >= 30 and p50 >= 1 and p90 >= 5 * p50",
    "p6_found": f"""with {FACTS}, t as (select d1, d2, sum(clk) c from facts where d1 is not null and d2 is not null group by 1, 2 having sum(clk) >= 1)
 select dim1, dim2, cast(place as integer) place from (select d1 as dim1, d2 as dim2, row_number() over (partition by d1 order by c desc, d2) place from t) where place <= 3""",
}

