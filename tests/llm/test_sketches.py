"""Top-k, set sketches, percentiles and bisection against brute force, and their edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetcube.llm import dyadic, heavy, setsketch, topn
from tests.test_fact_operators import SCHEMA, deduped, member, some_facts


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(some_facts(900, 9, 40), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return [spark.createDataFrame([], SCHEMA), spark.createDataFrame([(None,) * 12] * 3, SCHEMA)]


# --- most frequent items


@pytest.mark.parametrize("nodes", [1, 3, 17])
@pytest.mark.parametrize("share", [0.02, 0.3])
def test_frequent_members(facts, nodes, share):
    rows, expected = deduped(some_facts(900, 9, 40)), set()
    for field, items in (("charDim1", [r[7] for r in rows if r[7]]), ("dim3", [member(r[3]).hex().upper() for r in rows if r[3]])):
        expected |= {(field, i, n) for i, n in Counter(items).items() if n >= share * len(items)}
    got = heavy.frequent_members(facts, share, nodes).collect()
    assert {(r.field, r.item, r.facts) for r in got} == expected
    assert all(r.low <= r.facts <= r.high for r in got)


def test_many_candidates_are_not_broadcast(facts, monkeypatch):
    expected = sorted(heavy.frequent_members(facts, 0.02, 3).collect())
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", 0)
    df = heavy.frequent_members(facts, 0.02, 3)
    assert sorted(df.collect()) == expected and "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_frequent_members_of_nothing(nothing):
    for df in nothing:
        assert heavy.frequent_members(df).count() == 0


def test_one_shuffle_serves_deduplication_and_counting(facts):
    plan = heavy.local_counts(facts, {"dim3": F.col("dim3")}, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# --- set sketches


@pytest.mark.parametrize("b", [1.05, 1.2, 2.0])
def test_cardinality_within_stated_error(b):
    s, rng = setsketch.SetSketch(1024, b), np.random.default_rng(1)
    for n in (1, 30, 1000, 50_000):
        h = rng.integers(0, 2**63, n, dtype=np.uint64)
        est = s.cardinality(s.registers(np.r_[h, h[: n // 2]], np.zeros(n + n // 2, np.int64)))[0]
        assert abs(est / n - 1) < 4 * s.error


def test_merging_is_the_maximum():
    s, rng = setsketch.SetSketch(256), np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (500, 900))
    one = lambda h: s.registers(h, np.zeros(len(h), np.int64))
    assert (np.maximum(one(a), one(b)) == one(np.r_[a, b])).all()
    both = s.registers(np.r_[a, b], np.r_[np.zeros(500, np.int64), np.ones(900, np.int64)])
    assert (both == np.vstack([one(a), one(b)])).all()
    assert s.registers(a[:0], np.zeros(0, np.int64)).shape == (0, 256)


def test_joint_estimates():
    s, rng = setsketch.SetSketch(4096), np.random.default_rng(3)
    h = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    for u, v in ((h[:20_000], h[10_000:]), (h[:1000], h[:1000]), (h[:5000], h[5000:9000]), (h, h[:3000])):
        reg = [s.registers(x, np.zeros(len(x), np.int64)) for x in (u, v)]
        r = s.joint(*reg)
        union, inter = len(np.union1d(u, v)), len(np.intersect1d(u, v))
        assert abs(r["jaccard"][0] - inter / union) < 5 * max(r["jaccard_error"][0], 0.002)
        assert abs(r["union"][0] / union - 1) < 5 * s.error


def brute_spans(rows):
    import datetime

    n, sets = Counter(), defaultdict(set)
    for r in deduped(rows):
        if r[7] and r[4] and r[1]:
            d = datetime.date(1970, 1, 1) + datetime.timedelta(r[4] // 86_400_000)
            key = d.year * 10000 + d.month * 100 + d.day
            for k in (key, key // 100, 0):
                n[r[7], k] += 1
                sets[r[7], k].add(member(r[1]))
    return n, sets


def test_distinct_members(facts, nothing):
    n, sets = brute_spans(some_facts(900, 9, 40))
    s = setsketch.SetSketch()
    got = {(r.grp, r.span_key): (r.n, r.estimate) for r in setsketch.distinct_members(facts, s, 1).collect()}
    assert {k: v for k, (v, _) in got.items()} == dict(n)
    assert all(abs(est / len(sets[k]) - 1) < 5 * s.error for k, (_, est) in got.items())
    for df in nothing:
        assert setsketch.distinct_members(df, s, 1).count() == setsketch.narrow_and_wide(df).count() == 0


@pytest.mark.parametrize(("narrow", "wide"), [(0.15, 0.85), (0.45, 0.8)])
def test_narrow_and_wide(facts, narrow, wide):
    n, sets = brute_spans(some_facts(900, 9, 40))
    expected = {(c, k, "narrow" if len(sets[c, k]) <= narrow * v else "wide") for (c, k), v in n.items() if v >= 20 and (len(sets[c, k]) <= narrow * v or len(sets[c, k]) >= wide * v)}
    for sketch in (setsketch.SetSketch(64), setsketch.FINE):  # the first leaves most spans to the exact pass
        got = setsketch.narrow_and_wide(facts, narrow, wide, 20, sketch).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert expected or narrow < 0.2


@pytest.mark.parametrize("s", [setsketch.SetSketch(), setsketch.SetSketch(b=1.01), setsketch.SetSketch(early=True), setsketch.FINE])
def test_dense_and_sparse_states_agree(spark, s):
    rows = spark.range(40_000).select(F.lit("g").alias("grp"), F.lit(19723).cast("int").alias("day"), F.xxhash64(F.col("id") % 9000).alias("h"))
    r = setsketch.span_sketches(rows.repartition(5), s).filter("span = 'day'").first()
    assert r.n == 40_000 and abs(r.estimate / 9000 - 1) < 4 * s.error
    months = setsketch.joint_months(setsketch.span_sketches(rows.unionByName(rows.withColumn("day", F.lit(19723 + 31))), s), s).first()
    assert months.month == 202401 and months.jaccard > 0.99


def test_registers_of_early_stopping():
    """Registers of a union are the maximum of the parts', and estimates keep the stated error for small and large sets."""
    s, rng = setsketch.SetSketch(m=1024, early=True), np.random.default_rng(9)
    h = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    one = lambda x: s.registers(x, np.zeros(len(x), np.int64))
    assert (np.maximum(one(h[:40]), one(h[30:])) == one(h)).all()
    sizes = [1, 5, 40, 700, 5000]
    ratios = []
    for k in sizes:
        sets = [rng.integers(0, 2**63, k).astype(np.uint64) for _ in range(12)]
        est = s.cardinality(s.registers(np.concatenate(sets), np.repeat(np.arange(12), k)))
        ratios += (est / k - 1).tolist()
    assert abs(np.mean(ratios)) < 4 * s.error / np.sqrt(len(ratios)) and 0.7 < np.std(ratios) / s.error < 1.3
    with pytest.raises(ValueError):
        setsketch.SetSketch(m=1000, early=True)


def test_a_day_in_many_states_is_folded():
    s = setsketch.SetSketch(m=64, early=True)
    h = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    batches = []
    for i in range(0, 2000, 4):
        batches += list(setsketch.split_states(iter([pa.RecordBatch.from_arrays([pa.array(["g"] * 6), pa.array([7] * 6, pa.int32()), pa.array(np.sort(np.r_[h[i : i + 4], h[:2]]).view(np.int64))], ["grp", "day", "h"])]), s))
    t = pa.Table.from_batches(list(setsketch.merge_days(iter(batches), s))).to_pylist()
    assert len(t) == 1 and t[0]["n"] == 3000 and not t[0]["hashes"]
    assert t[0]["registers"] == s.registers(h, np.zeros(2000, np.int64)).tobytes()


# --- percentiles


def test_code_keeps_order_and_bounds_errors():
    d = dyadic.Dyadic()
    v = np.unique(np.r_[np.arange(-3000, 3000), np.array([2**k + x for k in range(12, 63) for x in (-1, 0, 1)]), [-(2**63), 2**63 - 1, -(2**40)]]).astype(np.int64)
    c = d.encode(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << d.levels
    low = d.lowest(c)
    small = np.abs(v.astype(float)) < 2 << d.bits
    assert (low[small] == v[small]).all()
    assert (np.abs(low.astype(float) - v) <= d.value_error * np.abs(v.astype(float)) + 1).all()


def percentile(values, p):
    return sorted(values)[max(math.ceil(p * len(values) / 100), 1) - 1]


@pytest.mark.parametrize("d", [dyadic.Dyadic(), dyadic.Dyadic(bits=9, width=256)])
def test_sketch_is_linear_and_within_its_error(d):
    rng = np.random.default_rng(4)
    codes = d.encode(rng.geometric(0.001, 20_000))
    gone = codes[:5000]

    def one(c):
        out = np.zeros((1, d.size), np.int64)
        d.add(out, np.zeros(len(c), np.int64), c, np.ones(len(c), np.int64))
        return out

    s = one(codes) - one(gone)
    assert (s == one(codes[5000:])).all() and (one(codes[:7]) + one(codes[7:]) == one(codes)).all()
    rest = np.sort(codes[5000:])
    error = d.rank_error(s)[0]
    for p in (10, 50, 90, 99):
        rank = math.ceil(p * len(rest) / 100)
        got = d.invert(s, np.array([rank]))[0]
        low, high = np.searchsorted(rest, got, side="left"), np.searchsorted(rest, got, side="right")
        assert low - error <= rank <= high + error
    assert 0 < error < 0.1 * len(rest)


@pytest.mark.parametrize("most", [1, 300, 4000])
def test_percentiles_of_groups(spark, most):
    """Groups with up to ``most`` different values, with deletions: n exact, percentiles within their bounds, and one answer whatever the states' encoding."""

    class Wide(dyadic.Dyadic):
        pairs = 0  # every state as counters

    rng = random.Random(5)
    values = {(g, s): [rng.choice([0, 1, 2, 5, rng.randrange(3 * most) ** 2]) for _ in range(rng.randrange(1, 3 * most))] for g in (b"a", b"bb", b"ccc") for s in (0, 1)}
    rows = [(bytearray(g), s, x, 1) for (g, s), xs in values.items() for x in xs]
    extra = [(bytearray(b"a"), 0, x, w) for x in range(200) for w in (1, -1)] + [(bytearray(b"zz"), 0, 7, w) for w in (1, -1)] + [(None, 0, 1, 1), (bytearray(b"a"), 0, None, 1)]
    df = spark.createDataFrame(rows + extra, "grp binary, series int, value bigint, weight bigint").repartition(3)
    answers = []
    for d in (dyadic.Dyadic(), Wide()):
        parts = [dyadic.states(df.filter(c), d) for c in ("weight > 0 and value % 2 = 0", "weight < 0 or value % 2 = 1")]
        for merged in (dyadic.states(df, d), dyadic.add_states(parts[0].unionByName(parts[1]), d)):
            got = {(bytes(r.grp), r.series): r for r in dyadic.percentiles(merged, (50, 90), d).collect()}
            assert set(got) == set(values)
            for k, r in got.items():
                assert r.n == len(values[k])
                for p in (50, 90):
                    assert r[f"lo{p}"] <= percentile(values[k], p) <= r[f"hi{p}"] and r[f"lo{p}"] <= r[f"p{p}"] <= r[f"hi{p}"]
            answers.append(got)
    assert all(a == answers[0] for a in answers)


def test_states_are_folded_while_read():
    """A group in thousands of partial states, and one that goes on over many batches, come out as one row each."""
    d = dyadic.Dyadic()
    many = pa.RecordBatch.from_arrays([pa.array([b"g"] * 1000 + [b"h"], pa.binary()), pa.array([0] * 1001, pa.int32()), pa.array([[d.zero + 3]] * 1001, pa.list_(pa.int32())), pa.array([[2]] * 1001, pa.list_(pa.int64())), pa.array([None] * 1001, pa.binary())], ["grp", "series", "codes", "counts", "sketch"])
    reduced = []

    def reduce(t):
        reduced.append(t.num_rows)
        return dyadic._merged(t, d)

    from facetcube.arrow import folded

    out = pa.Table.from_batches(list(folded(iter([many.slice(0, 1000)] * 50 + [many]), reduce, rows=2000))).to_pylist()
    assert [(r["grp"], r["codes"], r["counts"]) for r in out] == [(b"g", [d.zero + 3], [102_000]), (b"h", [d.zero + 3], [2])]
    assert max(reduced) <= 3002


def test_heavy_tails(spark, facts, nothing):
    import struct

    cells = []
    rng = random.Random(6)
    values = defaultdict(list)
    for r in deduped(some_facts(900, 9, 40)):
        if r[2]:
            for at, m in ((5, "impCnt"), (6, "click")):
                if r[at] is not None:
                    values["compiler_input", member(r[2]).hex().upper(), m].append(r[at])
    for i in range(60):
        xs = [rng.choice([1, 2, 30]) for _ in range(rng.randrange(4))]
        state = struct.pack(f">{len(xs)}q", *xs) + b"\1\2\3"[: rng.randrange(4)]
        name, m, level = f"{i % 3:032X}", rng.choice(["impCnt", "click", "other"]), rng.choice([1, 2, 2])
        states = rng.choice([[b"x", state], [b"", state], [None, state], [b"x"], [], None])
        row = ("c", name, level, f"20231001{i:02d}", m, i, states)
        cells += [row, row] if rng.random() < 0.3 else [row]
        if level == 2 and m != "other" and states and len(states) > 1:
            values["aggregation", name, m] += xs
    schema = "cuboid string, dim1 string, time_level int, time_key string, measure string, batch_id int, customStates array<binary>"
    cells += [(None, None, 2, None, None, None, [b"x", b"y"]), ("c", "nothex", 2, "k", "click", 0, [b"", struct.pack(">q", 5)])]
    table = spark.createDataFrame([(*c[:6], None if c[6] is None else [None if x is None else bytearray(x) for x in c[6]]) for c in cells], schema)
    expected = {k for k, xs in values.items() if len(xs) >= 5 and percentile(xs, 50) >= 1 and percentile(xs, 90) >= 5 * percentile(xs, 50)}
    for d in (dyadic.Dyadic(), dyadic.Dyadic(width=16)):  # the second leaves most groups to the exact pass
        got = dyadic.heavy_tails(facts, table, least=5, d=d).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 3
    said = {tuple(r[:3]): r.sure for r in dyadic.named(dyadic.judged(facts, table, least=5)).select("src", "item", "measure", "sure").collect()}
    assert expected <= set(said) and {k for k, sure in said.items() if sure} <= expected
    for df in nothing:
        assert dyadic.heavy_tails(df, table.limit(0)).count() == 0


# --- top N


def test_bisection():
    rng = np.random.default_rng(7)
    for n in (1, 3, 10):
        g = np.sort(rng.integers(0, 30, 3000))
        _, g = np.unique(g, return_inverse=True)
        words = [rng.integers(0, 4, 3000).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64) // np.uint64(2**61)]
        keep = topn.bisect_top(g, words, n)
        for k in range(g.max() + 1):
            own = np.flatnonzero(g == k)
            codes = sorted(((int(words[0][i]), int(words[1][i])) for i in own), reverse=True)
            assert sorted(((int(words[0][i]), int(words[1][i])) for i in own if keep[i]), reverse=True) == codes[:n]
    assert topn.bisect_top(np.zeros(0, np.int64), [], 3).shape == (0,)


def test_codes_keep_order():
    x = np.array([-np.inf, -5.5, -1e-300, 0.0, 1e-300, 2.0, np.inf, np.nan])
    assert (np.diff(topn.word_of(x).astype(object)) > 0).all() and topn.word_of(np.array([-0.0]))[0] == topn.word_of(np.array([0.0]))[0]
    i = np.array([-(2**63), -1, 0, 1, 2**63 - 1])
    assert (np.diff(topn.word_of(i).astype(object)) > 0).all()
    ids = [b"", b"\0", b"\0\0", b"a", b"a\0", b"ab", b"b" * 30]
    words = list(zip(*(w.tolist() for w in topn.words_of_ids(pa.array(ids, pa.binary()), 30)), strict=True))
    assert words == sorted(words, reverse=True) and len(set(words)) == len(ids)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_top_items(spark, kind):
    rng = random.Random(8)
    rows = [(rng.choice([b"", b"g", b"gg", b"hot", b"hot", b"hot"]), bytes([rng.randrange(4)] * rng.randrange(3)), rng.randrange(-3, 4)) for _ in range(2000)]
    cast = float if kind == "double" else int
    df = spark.createDataFrame([(bytearray(g), bytearray(i), cast(s)) for g, i, s in rows] + [(None, bytearray(b"x"), cast(9)), (bytearray(b"g"), None, cast(9)), (bytearray(b"g"), bytearray(b"x"), None)], f"grp binary, item binary, score {kind}")
    got = defaultdict(dict)
    for r in topn.top_items(df.repartition(4), 5).collect():
        got[bytes(r.grp)][r.place] = (bytes(r.item), r.score)
    for g in {g for g, _, _ in rows}:
        best = sorted(((i, s) for x, i, s in rows if x == g), key=lambda t: (-t[1], t[0]))[:5]
        assert [got[g][p] for p in sorted(got[g])] == best
    assert topn.top_items(df.limit(0), 5).count() == 0


def test_best_pairs(facts, nothing):
    totals = Counter()
    for r in deduped(some_facts(900, 9, 40)):
        if r[1] and r[2] and r[6]:
            totals[member(r[1]), member(r[2])] += r[6]
    expected = set()
    for g in {g for g, _ in totals}:
        expected |= {(g, i, p) for p, (_, i) in enumerate(sorted((-s, i) for (x, i), s in totals.items() if x == g)[:3], 1)}
    assert {(bytes(r.grp), bytes(r.item), r.place) for r in topn.best_pairs(facts).collect()} == expected
    for df in nothing:
        assert topn.best_pairs(df).count() == 0
