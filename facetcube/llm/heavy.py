"""Most frequent items, by the three-phase uniform threshold method.

A *node* is a slice of the facts by the hash of their id. Every node counts its
own slice (Spark's aggregate, which spills: memory does not grow with the
number of members). Then

1. each node names its ``k`` local leaders; the ``k``-th largest sum of the
   leaders' partial counts is a lower bound of the ``k``-th count,
2. each node sends every member whose local count reaches the bound's share
   ``T = bound / nodes``. A member that no node sends has a total below the
   bound. What was not sent is below ``T``, which gives each candidate a lower
   and an upper count; candidates whose upper count misses the bound go,
3. the exact local counts of the remaining candidates are fetched and added.

With ``share`` as the floor, the bound is at least ``share * N``, so at most
``nodes / share`` entries travel in phase 2, whatever the number of members.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetcube.operators.facts import char_member, hex_member
from facetcube.storage import materialize


#: Candidates that are sent to all executors, by the bound on their number; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def local_counts(facts: DataFrame, members: dict[str, Column], nodes: int) -> DataFrame:
    """(node, field, item, n): exact counts in each node's slice, a fact once.

    One shuffle, by node: it serves the removal of repeated deliveries and the
    counting. A row without ``fact_id`` is its own fact. Null members are none.
    """
    lone = F.when(F.col("fact_id").isNull(), F.monotonically_increasing_id())
    rows = facts.select("fact_id", lone.alias("_lone"), *(c.alias(k) for k, c in members.items()))
    rows = rows.withColumn("node", F.pmod(F.xxhash64("fact_id", "_lone"), F.lit(nodes)).cast("int"))
    rows = rows.repartitionById(nodes, F.col("node")).dropDuplicates(["node", *rows.columns[:-1]])
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("binary").alias("item")) for k in members))
    rows = rows.select("node", F.explode(pairs).alias("x")).select("node", "x.field", "x.item").filter("item is not null")
    return rows.groupBy("node", "field", "item").agg(F.count(F.lit(1)).alias("n"))


def threshold_top(counts: DataFrame, nodes: int, share: float) -> DataFrame:
    """Members that at least ``share`` of a field's facts carry: field, item, low, high, facts.

    ``low`` and ``high`` bound the count by what phase 2 sent, ``facts`` is the
    exact count of phase 3. ``counts`` is read three times and should be stored.
    """
    k = math.ceil(1 / share)
    # phase 1: local leaders and totals
    lead = Window.partitionBy("node", "field").orderBy(F.col("n").desc(), "item")
    leaders = counts.withColumn("_place", F.row_number().over(lead)).filter(F.col("_place") <= k)
    partial = leaders.groupBy("field", "item").agg(F.sum("n").alias("n"))
    kth = F.try_element_at(F.sort_array(F.collect_list("n"), asc=False), F.lit(k))  # of nodes * k numbers at most
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    bounds = {r.field: (max(r.kth or 0, math.ceil(r.total * share)), r.total) for r in partial.groupBy("field").agg(kth.alias("kth")).join(totals, "field").collect()}
    if not bounds:
        return counts.select("field", "item", F.col("n").alias("low"), F.col("n").alias("high"), F.col("n").alias("facts")).limit(0)
    of_field = lambda at: F.create_map(*(x for f, v in bounds.items() for x in (F.lit(f), F.lit(v[at]).cast("bigint"))))[F.col("field")]
    bound = of_field(0)
    # phase 2: everything at or above the bound's share; what is not sent is at most ceil(T) - 1
    sent = counts.filter(F.col("n") * nodes >= bound).groupBy("field", "item").agg(F.sum("n").alias("low"), F.count(F.lit(1)).alias("_from"))
    unsent = F.ceil(bound / F.lit(float(nodes))) - 1
    candidates = sent.withColumn("high", F.col("low") + (nodes - F.col("_from")) * unsent).filter(F.col("high") >= bound).drop("_from")
    # phase 3: exact counts of the candidates, of which there are at most nodes / share a field: sent to all while that is few
    if nodes * k * len(bounds) <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    exact = counts.join(candidates, ["field", "item"]).groupBy("field", "item", "low", "high").agg(F.sum("n").alias("facts"))
    return exact.filter(F.col("facts") * 1_000_000 >= of_field(1) * round(share * 1_000_000))


def frequent_members(facts: DataFrame, share: float = 0.02, nodes: int | None = None, fields: Sequence[str] = ("charDim1", "dim3")) -> DataFrame:
    """Members of ``charDim1`` and ``dim3`` that at least ``share`` of the facts with a member carry.

    Binary members are given in hex. Ties need no rule: all members at the
    share are kept. Empty tables and fields without members give no rows.
    """
    spark = facts.sparkSession
    nodes = nodes or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    members = {f: char_member(F.col(f)) if f.startswith("char") else hex_member(F.col(f)) for f in fields}
    counts = materialize(local_counts(facts, members, nodes), "local-counts")
    top = threshold_top(counts, nodes, share)
    text = F.when(F.col("field").startswith("char"), F.col("item").cast("string")).otherwise(F.hex("item"))
    return top.withColumn("item", text)
