"""Rolling totals and dense per-key results: brute force, edge cases, incremental form."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from facetcube.operators import dense, rolling
from facetcube.operators.facts import day_of_key

SCHEMA = "fact_id bigint, dim1 binary, dim2 binary, dim3 binary, impressionTime bigint, impCnt bigint, click bigint, charDim1 string, arrived_at timestamp_ntz, entity string, `_lone` int, day string"


def some_facts(n=600, seed=5, members=6):
    import datetime

    rng, out = random.Random(seed), []
    for i in range(n):
        ms = 1_704_067_200_000 + rng.randrange(80 * 86_400_000)
        late = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms, days=rng.choice([0, 0, 3, 20]))
        key = lambda: rng.choice([None, bytearray(), *(bytearray([0, m]) if rng.random() < 0.5 else bytearray([m]) for m in range(1, members))])
        row = (rng.choice([i, i, i, None]), key(), key(), key(), rng.choice([ms, ms, ms, ms, 0, None]), rng.choice([None, 0, 3, 50]), rng.choice([None, 0, 1, 7]), rng.choice([None, "", "a", "b"]), rng.choice([late, late, None]), "x", 1, "y")
        out.append(row)
        if row[0] is not None and rng.random() < 0.1:
            out.append((*row[:8], late, *row[9:]))
    return out


def deduped(rows):
    seen, out = set(), []
    for r in rows:
        if r[0] is None or r[0] not in seen:
            out.append(r)
            seen.add(r[0])
    return out


def member(b):
    return bytes(b).rjust(16, b"\0") if b else None


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(some_facts(), SCHEMA)


def brute_rolling(rows, end):
    daily = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in deduped(rows):
        if member(r[1]) and r[4]:
            d = daily[member(r[1]).hex().upper()][r[4] // 86_400_000]
            d[0] += r[5] or 0
            d[1] += r[6] or 0
    out = {}
    for m, days in daily.items():
        for d in range(min(days), end + 1):
            out[m, d] = tuple(sum(days[x][k] for x in range(d - p + 1, d + 1) if x in days) for k in (0, 1) for p in (7, 30))
    return out


def test_rolling_totals(facts):
    expected = brute_rolling(some_facts(), day_of_key(20240330))
    got = {(r.dim1, day_of_key(r.on_day)): (r.imp_7, r.imp_30, r.click_7, r.click_30) for r in rolling.rolling_totals(facts).collect()}
    assert got == expected
    assert {r.avg_imp_7 for r in rolling.rolling_totals(facts).filter("imp_7 = 3").collect()} == {round(3 / 7, 6)}


def test_surges(facts):
    rolled = brute_rolling(some_facts(), day_of_key(20240330))
    first = {}
    for m, d in rolled:
        first[m] = min(first.get(m, d), d)
    expected = set()
    for (m, d), (i7, i30, c7, c30) in rolled.items():
        if d >= first[m] + 29:
            expected |= {(m, d, k) for k, ok in (("imp_surge", i30 >= 60 and i7 >= 0.6 * i30), ("click_surge", c30 >= 10 and c7 >= 0.6 * c30), ("lull", i30 >= 60 and i7 == 0)) if ok}
    got = {(r.dim1, day_of_key(r.on_day), r.kind) for r in rolling.surges_and_lulls(facts).collect()}
    assert got == expected and expected


def test_versions_mark_what_corrections_touch(facts):
    late, dates = defaultdict(list), defaultdict(lambda: [0, 0])
    end = day_of_key(20240330)
    first_delivery = {}
    for r in some_facts():
        if r[0] is not None and r[8] is not None:
            first_delivery[r[0]] = min(r[8], first_delivery.get(r[0], r[8]))
    import datetime

    for r in deduped(some_facts()):
        at = first_delivery.get(r[0], r[8])
        if member(r[1]) and r[4] and at and (at - datetime.datetime(1970, 1, 1)).days > r[4] // 86_400_000:
            late[member(r[1]).hex().upper()].append((r[4] // 86_400_000, r[5] or 0, r[6] or 0))
    for m, rows in late.items():
        for d, i, c in rows:
            for x in range(d, min(d + 30, end + 1)):
                dates[m, x][0] += i
                dates[m, x][1] += c
    whole = brute_rolling(some_facts(), end)
    expected = {(m, x): (1, whole[m, x][1], whole[m, x][1] - i, whole[m, x][3], whole[m, x][3] - c) for (m, x), (i, c) in dates.items()}
    assert {(r.dim1, day_of_key(r.on_day)): (r.version, r.imp_30, r.v0_imp_30, r.click_30, r.v0_click_30) for r in rolling.corrected_totals(facts).collect()} == expected and expected


class Book:
    """Brute force beside a store of one measure: amounts by entity and day, as they stand."""

    def __init__(self, spark, path, days=(100, 120)):
        rng = random.Random(2)
        self.spark = spark
        self.amounts = {(e, d): rng.randrange(9) for e in (b"a", b"b", b"c") for d in range(*days) if rng.random() < 0.4}
        self.store = rolling.RollingStore(spark, "file://" + str(path), ["x"], (2, 5))
        self.fixes = {}

    def rows(self, amounts):
        return self.spark.createDataFrame([(bytearray(e), d, 1, x) for (e, d), x in amounts.items()], "entity binary, day int, n bigint, x bigint")

    def advance(self, first, last):
        self.store.advance(first, last, self.rows({k: x for k, x in self.amounts.items() if first <= k[1] <= last}))
        self.last = last

    def correct(self, name, late):
        self.store.correct(name, self.rows(late))
        self.fixes[name] = late

    def check(self, versions=None):
        total, n = Counter(), Counter()
        for amounts in (self.amounts, *self.fixes.values()):
            for (e, d), x in amounts.items():
                total[e, d] += x
                n[e, d] += 1
        expected = {}
        for e in {e for e, _ in n}:
            for d in range(100, self.last + 1):
                if sum(n[e, x] for x in range(d - 4, d + 1)):
                    expected[e, d] = tuple(sum(c[e, x] for x in range(d - p + 1, d + 1)) for c in (n, total) for p in (2, 5))
        rows = self.store.state(100, 200).collect()
        assert {(bytes(r.entity), r.day): (r.n_2, r.n_5, r.x_2, r.x_5) for r in rows} == expected and len(rows) == len(expected)
        return {(bytes(r.entity), r.day): r.v for r in rows if r.v}


def test_days_one_by_one_or_caught_up_are_the_same(spark, tmp_path):
    one, many = Book(spark, tmp_path / "one"), Book(spark, tmp_path / "many")
    for d in range(100, 106):
        one.advance(d, d)
    many.advance(100, 103)
    many.advance(104, 105)
    one.check()
    many.check()
    assert sorted(map(tuple, one.store.history(100, 105).collect())) == sorted(map(tuple, many.store.history(100, 105).collect()))
    assert {(bytes(r.entity), r.first_day) for r in one.store.first_days().collect()} == {(e, min(d for x, d in one.amounts if x == e and d <= 105)) for e in (b"a", b"b", b"c") if any(x == e and d <= 105 for x, d in one.amounts)}
    with pytest.raises(ValueError, match="cannot follow"):
        one.advance(108, 108)


def test_corrections_touch_their_dates_alone(spark, tmp_path):
    b = Book(spark, tmp_path / "s")
    b.advance(100, 106)
    for d in range(107, 113):
        b.advance(d, d)
    late = {(b"a", 105): 5, (b"c", 103): 2, (b"z", 106): 4, (b"z", 140): 9}
    b.correct("first", late)
    touched = {(e, x) for (e, d) in late for x in range(d, min(d + 5, 113))}
    assert b.check() == dict.fromkeys(touched, 1)
    # what was written and what was read: the touched dates, and files with days around them
    step = b.store.steps()[-1]
    assert {(bytes(r.entity), r.day) for r in b.store._read("state", step, b.store.state_schema).collect()} == touched
    read = b.store._amounts(b.store.steps(), 103 - 4, 110)
    untouched = [s["id"] for s in b.store.steps() if s["name"] is None and s["first"] > 110]
    assert len(untouched) == 2 and not any(i in f for f in read.inputFiles() for i in untouched)
    b.correct("second", {(b"a", 107): 1})
    got = b.check()
    assert {k for k, v in got.items() if v == 2} == {(b"a", x) for x in range(107, 112)}
    b.correct("first", {(b"a", 105): 6})  # again, with other amounts: nothing is added twice
    b.check()
    b.correct("nothing", {})
    b.check()


def test_an_advance_run_again_after_a_correction(spark, tmp_path):
    b = Book(spark, tmp_path / "s")
    b.advance(100, 110)
    b.correct("fix", {(b"a", 107): 3, (b"b", 109): 2})
    b.amounts = {k: x + 1 for k, x in b.amounts.items() if k[1] < 108} | {(b"a", 108): 7, (b"d", 109): 1}
    b.advance(100, 107)  # the days after the last one are gone until they are advanced again
    b.check()
    b.advance(108, 108)
    b.advance(109, 112)
    assert not b.check()  # the corrections are in the states of version 0 now
    b.correct("fix", {})
    b.check()


def test_a_failing_step_leaves_nothing(spark, tmp_path, monkeypatch):
    b = Book(spark, tmp_path / "s")
    b.advance(100, 104)

    def broken(*args):
        raise OSError("disk")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(b.store, "_publish", broken)
        b.store.correct("fix", b.rows({(b"a", 101): 100}))
    b.check()
    b.correct("fix", {(b"a", 101): 100})
    b.check()
    assert not b.store.vacuum() and len(b.store.vacuum(grace=-5)) == 2  # what the failed step has written
    b.check()


def test_per_member_results(facts):
    rows = deduped(some_facts())
    for field, at in (("dim1", 1), ("dim2", 2)):
        n, imp, clicks = Counter(), Counter(), Counter()
        for r in rows:
            if m := member(r[at]):
                n[m] += 1
                imp[m] += r[5] or 0
                clicks[m] += r[6] is not None
        got = {bytes(r.item): (r.facts, r.sum_impCnt, r.n_click) for r in dense.member_results(facts).filter(f"field = '{field}'").collect()}
        assert got == {m: (n[m], imp[m], clicks[m]) for m in n}
    assert dense.holding_share(dense.member_results(facts), 0.9).count() == 0
    assert dense.holding_share(dense.member_results(facts), 0.0).count() == dense.member_results(facts).count()


def test_blocks_are_folded_while_read():
    """50,000 splits send a block of 100 slots each, of a few hundred keys: five million slots are never held."""
    rng = np.random.default_rng(3)
    names = [b"k%d" % i for i in range(300)]
    exact, peak = np.zeros(300, np.int64), []

    def batches():
        for _ in range(500):
            picks = rng.integers(0, 300, (100, 100))
            picks.sort(axis=1)
            np.add.at(exact, picks.ravel(), 1)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, 10_001, 100), pa.int32()), pa.array([names[i] for i in picks.ravel()], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * 100), pa.array([7] * 100, pa.int32()), keys, pa.array([np.ones(100, np.int64).tobytes()] * 100, pa.binary())], ["field", "block", "keys", "arrays"])
            peak.append(pa.total_allocated_bytes())

    out = pa.Table.from_batches(list(dense.sum_blocks(batches(), 1, ["facts"], slots=20_000))).to_pylist()
    assert {r["item"]: r["facts"] for r in out} == {n: int(x) for n, x in zip(names, exact, strict=True)}
    assert max(peak[100:]) < 1.5 * max(peak[:100]) + 1_000_000


def test_per_key_of_uneven_splits(spark, facts):
    rows = facts.select("dim1", "impCnt").coalesce(1)
    one, many = (sorted(map(tuple, dense.per_key(rows, ["dim1"], ["impCnt"], spread=n).collect())) for n in (None, 5))
    assert one == many and one


def test_empty_and_null_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None,) * 12] * 3, SCHEMA)
    for df in (none, nulls):
        assert rolling.rolling_totals(df).count() == rolling.surges_and_lulls(df).count() == rolling.corrected_totals(df).count() == dense.member_results(df).count() == 0


def test_sums_are_exact():
    v = np.array([2**62 - 1, -(2**62), 7, -1], np.int64)
    assert dense.exact_bincount(np.array([0, 0, 1, 1]), v, 2).tolist() == [-1, 6]
    big = np.full(1 << 12, 2**50 + 1, np.int64)
    assert dense.exact_bincount(np.zeros(1 << 12, np.int64), big, 1)[0] == (1 << 12) * (2**50 + 1)


def test_blocks_depend_on_the_key_alone():
    keys = [b"", b"a", b"ab", b"b" * 40]
    one = dense.key_block(pa.array(keys, pa.binary()), 64)
    assert one.tolist() == [int(dense.key_block(pa.array([k], pa.binary()), 64)[0]) for k in keys]
    assert dense.key_block(pa.array([b"x", *keys], pa.binary()).slice(1), 64).tolist() == one.tolist()
