"""Properties of the summarizer states, against step-by-step updates in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from facetcube.functions.folding import Plain, fold
from facetcube.functions.summarizers import Summarizer, parse_init, welford, welford_combine, welford_merge, welford_variance

KINDS = [Summarizer("exp_avg", 600_000.0), Summarizer("canny_avg", 600_000.0), Summarizer("exp_rate", 600_000.0), Summarizer("canny_rate", 600_000.0), Summarizer("exp_avg", 2_000.0), Summarizer("canny_avg", 2_000.0)]


def samples(n=300, seed=3):
    rng, t, out = random.Random(seed), 1_704_067_200_000.0, []
    for i in range(n):
        t += rng.choice([1, 1, 1, -1]) * 1000 + rng.gauss(0, 33)
        out.append((i, i % 2, float(rng.random() < 0.25), t))
    return out


def closed_form(s, rows):
    last, first = max(t for _, t in rows), min(t for _, t in rows)
    decay = lambda tau: [math.exp((t - last) / tau) for _, t in rows]
    p = {"w": sum(decay(s.alpha)), "s": sum(x * d for (x, _), d in zip(rows, decay(s.alpha), strict=True))}
    p |= {"v": sum(decay(s.beta)), "u": sum(x * d for (x, _), d in zip(rows, decay(s.beta), strict=True))}
    if s.rate:
        p["w"], p["v"] = s.alpha * (1 - math.exp((first - last) / s.alpha)), s.beta * (1 - math.exp((first - last) / s.beta))
    if s.canny:
        return (s.k * p["s"] - (s.k - 1) * p["u"]) / (s.k * p["w"] - (s.k - 1) * p["v"])
    return p["s"] / p["w"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([*samples(), (-1, 0, None, 5.0), (-2, 0, 1.0, None), (-3, 1, float("nan"), 5.0)], "id int, half int, x double, t double").cache()


@pytest.mark.parametrize("s", KINDS, ids=lambda s: f"{s.kind}-{s.dt:g}")
def test_value_and_combine(table, s):
    whole = s.summarize(table, [], F.col("x"), F.col("t")).select(s.value(F.col("state")).alias("v")).first().v
    assert whole == pytest.approx(closed_form(s, [(x, t) for _, _, x, t in samples()]), rel=1e-9)
    halves = s.summarize(table, ["half"], F.col("x"), F.col("t")).groupBy().pivot("half", [0, 1]).agg(F.first("state"))
    both = halves.select(s.value(s.combine(F.col("0"), F.col("1"), s.new())).alias("v"), s.value(s.combine(s.new())).alias("none")).first()
    assert both.v == pytest.approx(whole, rel=1e-9) and both.none is None


# a Canny average is not the same at a later time, which shows where the decay is as short as the samples' distance
@pytest.mark.parametrize("s", [k for k in KINDS if not k.rate and not (k.canny and k.dt < 10_000)], ids=lambda s: f"{s.kind}-{s.dt:g}")
def test_complement(table, s):
    halves = s.summarize(table, ["half"], F.col("x"), F.col("t")).groupBy().pivot("half", [0, 1]).agg(F.first("state"))
    whole = s.combine(F.col("0"), F.col("1"))
    r = halves.select(s.value_of_parts(s.complement(whole, F.col("0"), True)).alias("rest"), s.value(F.col("1")).alias("other"), s.complement(F.col("0"), whole).isNull().alias("later"), (F.col("0.t") >= whole["t"]).alias("same")).first()
    assert r.rest == pytest.approx(r.other, abs=1e-3) and r.later == (not r.same)


def test_rates_over_time(spark):
    s = Summarizer("canny_rate", 600_000.0)
    one = spark.createDataFrame([(1.0, 1e6)], "x double, t double")
    st = s.summarize(one, [], F.col("x"), F.col("t"))
    assert st.select(s.value(F.col("state"))).first()[0] == 0.0
    a, b = st.select(*(s.value_now(F.col("state"), F.lit(1e6 + d)) for d in (1e5, 1e6))).first()
    assert a > b > 0
    assert st.select(s.value_now(F.col("state"), F.lit(5.0))).first()[0] == 0.0  # the past is clamped
    assert st.select(s.first_time(F.col("state"))).first()[0] == 1e6


@pytest.mark.parametrize("kind", ["exp_biased_binomial", "canny_biased_binomial"])
def test_biased_binomials_return_to_p0(table, kind):
    s = Summarizer(kind, 600_000.0, p0=0.75)
    st = s.summarize(table, [], F.col("x"), F.col("t"))
    now, later, plain = st.select(s.biased_value(F.col("state")), s.value_now(F.col("state"), F.col("state.t") + 1e9), s.value(F.col("state"))).first()
    assert later == pytest.approx(0.75) and plain - 1e-9 < now < 0.75


def test_ones(table):
    s = KINDS[0]
    zeros = s.summarize(table, [], F.col("x") * 0, F.col("t")).withColumnRenamed("state", "z")
    ones = s.summarize(table.filter("x = 1"), [], F.col("x"), F.col("t"))
    v = zeros.crossJoin(ones).select(s.value(s.ones(F.col("z"), F.col("state")))).first()[0]
    assert v == pytest.approx(closed_form(s, [(x, t) for _, _, x, t in samples()]), rel=1e-9)


def test_welford(spark):
    rng = random.Random(1)
    xs = [rng.gauss(1, 5) for _ in range(10_000)]
    df = spark.createDataFrame([(i % 5, x) for i, x in enumerate(xs)] + [(9, None)], "g int, x double")
    parts = df.groupBy("g").agg(welford(F.col("x")).alias("s"))
    m = welford_merge(parts, [], "s").select("s.n", "s.mean", welford_variance(F.col("s")).alias("var")).first()
    assert m.n == 10_000 and abs(m.mean - 1) < 0.1 and abs(m["var"] - 25) < 2
    two = parts.filter("g < 2").groupBy().pivot("g", [0, 1]).agg(F.first("s"))
    exact = [x for i, x in enumerate(xs) if i % 5 < 2]
    mean = sum(exact) / len(exact)
    c = two.select(welford_combine(F.col("0"), F.col("1")).alias("s")).select("s.mean", welford_variance(F.col("s")).alias("var")).first()
    assert c.mean == pytest.approx(mean) and c["var"] == pytest.approx(sum((x - mean) ** 2 for x in exact) / len(exact))


def test_welford_of_large_means(spark):
    """Means near 1e9 and deviations near 1: nothing cancels; a null key is a group; n is capped."""
    rng = random.Random(2)
    xs = [1e9 + rng.gauss(0, 1) for _ in range(4000)]
    df = spark.createDataFrame([(i % 40, x) for i, x in enumerate(xs)], "part int, x double").withColumn("k", F.when(F.col("part") % 2 == 0, F.lit("a")))
    parts = df.groupBy("k", "part").agg(welford(F.col("x")).alias("s"))
    for k, var in {r.k: r["var"] for r in welford_merge(parts, ["k"], "s").select("k", welford_variance(F.col("s")).alias("var")).collect()}.items():
        own = [x - 1e9 for i, x in enumerate(xs) if (i % 2 == 0) == (k == "a")]
        mean = sum(own) / len(own)
        assert var == pytest.approx(sum((x - mean) ** 2 for x in own) / len(own), rel=1e-6)
    capped = welford_merge(parts, [], "s", most=100).select("s.n", welford_variance(F.col("s")).alias("var")).first()
    assert capped.n == 100 and capped["var"] == pytest.approx(1, rel=0.1)


@pytest.mark.parametrize("dt", [5.0, 600_000.0, 3e12])
@pytest.mark.parametrize("k", [1.01, 4.0])
def test_fold_takes_any_time_constant(spark, dt, k):
    """States from samples, and merged from parts at random, equal the plain sums at the latest time."""
    s, rng = Summarizer("canny_avg", dt, k=k), random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(4), rng.gauss(1, 1), 1.7e12 + rng.choice([0, 3e9, 4e9]) + rng.random() * dt * 3) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, part int, x double, t double")
    whole = {r.k: r.state for r in s.summarize(df, ["k"], F.col("x"), F.col("t")).collect()}
    parts = s.summarize(df, ["k", "part"], F.col("x"), F.col("t")).select("k", "state.*")
    merged = {r.k: r for r in fold(parts, ["k"], [Plain("n", F.count("w"), F.sum)], [s.of_states()]).collect()}
    for key, state in whole.items():
        own = [(x, t) for kk, _, x, t in rows if kk == key]
        last = max(t for _, t in own)
        for f in s.sums:
            exact = sum((x if f in "su" else 1) * math.exp((t - last) / s.tau(f)) for x, t in own)
            assert state[f] == pytest.approx(exact, rel=1e-9) and merged[key][f] == pytest.approx(exact, rel=1e-9)
        assert state["t"] == merged[key].t == last and merged[key].n == 4


def test_fold_of_several_times(spark):
    """Sums of different times and steps in one pass; keys without a sample keep their plain aggregates."""
    rng = random.Random(6)
    a, b = Summarizer("canny_rate", 10.0), Summarizer("exp_avg", 1e8)
    rows = [(rng.randrange(3), rng.random(), rng.random() * 1e5 if rng.random() < 0.7 else None, rng.random() * 1e9) for _ in range(300)] + [(9, 1.0, None, None)]
    df = spark.createDataFrame(rows, "k int, x double, t double, u double").withColumn("y", F.when(F.col("t").isNotNull(), F.col("x"))).withColumn("z", F.when(F.col("u").isNotNull(), F.col("x")))
    both = {r.k: r for r in fold(df, ["k"], [Plain("sum", F.sum("x"), F.sum)], [a.of_samples("y", "t", "a_"), b.of_samples("z", "u", "b_")]).collect()}
    for s, x, t, prefix in ((a, "y", "t", "a_"), (b, "z", "u", "b_")):
        alone = {r.k: r for r in fold(df, ["k"], [], [s.of_samples(x, t, prefix)]).collect()}
        assert all(both[k][c] == (None if r[c] is None else pytest.approx(r[c])) for k, r in alone.items() for c in [prefix + f for f in s.fields])
    assert both[9]["sum"] == 1.0 and both[9].a_t is None and both[9].b_w is None
    assert fold(df.limit(0), ["k"], [], [a.of_samples("y", "t")]).collect() == []


def test_init_strings():
    s = parse_init("type=CANNY_AVG dt=600000 m=0.02 k=3")
    assert (s.kind, s.dt, s.m, s.k) == ("canny_avg", 600000.0, 0.02, 3.0)
    for bad in ("", "type=EXP_AVG", "dt=1", "type=NO dt=1", "type=EXP_AVG dt=1 dt=2", "type=EXP_AVG dt", "type=EXP_AVG dt=1 z=2", "type=EXP_BIASED_BINOMIAL dt=1", "type=EXP_AVG dt=-1"):
        with pytest.raises(ValueError):
            parse_init(bad)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double, t double")
    assert KINDS[1].summarize(df, ["k"], F.col("x"), F.col("t")).collect() == []
