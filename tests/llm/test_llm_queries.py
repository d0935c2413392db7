"""Queries of the subpackage against their SQL; nothing outside imports it."""

import pathlib

import pytest

from facetcube.llm.language import label_names
from facetcube.llm.queries import QUERIES, SQL
from facetcube.llm.setsketch import SetSketch
from facetcube.plans.fact_sql import FACTS, key_of_day
from tests.oracle import SF, database, same


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        same(df, SQL[name], database())
    else:
        assert df.count() > 0


SETS = f"""with {FACTS}, k as (select c1, {key_of_day("day")} as d, d1 from facts where c1 is not null and day is not null and d1 is not null),
 s as (select c1, d as span_key, d1 from k union all select c1, d // 100, d1 from k union all select c1, 0, d1 from k)"""


def test_every_span_has_an_estimate(spark):
    exact = {r[:2]: r[2:] for r in database().execute(f"{SETS} select c1, span_key, count(*), count(distinct d1) from s group by 1, 2").fetchall()}
    got = {(r.chardim1, r.span_key): r for r in QUERIES["p3_estimates"](spark, SF).collect()}
    assert {k: r.n for k, r in got.items()} == {k: n for k, (n, _) in exact.items()}
    assert min(n for n, _ in exact.values()) == 1
    off = [(got[k].estimate - x) / got[k].standard_error for k, (_, x) in exact.items()]
    assert max(map(abs, off)) < 6 and sum(x * x for x in off) / len(off) < 1.5


def test_every_pair_of_months_is_compared(spark):
    sets = {}
    for c, k, d in database().execute(f"{SETS} select distinct c1, span_key, d1 from s where span_key between 190001 and 299912").fetchall():
        sets.setdefault((c, k), set()).add(d)
    pairs = {(c, k): (sets[c, k], sets[c, n]) for c, k in sets if (c, n := k + 89 if k % 100 == 12 else k + 1) in sets}
    got = {(r["grp"], r["month"]): r for r in QUERIES["p3_joint"](spark, SF).collect()}
    assert set(got) == set(pairs) and min(len(u | v) for u, v in pairs.values()) < 10
    for k, (u, v) in pairs.items():
        assert abs(got[k]["union"] / len(u | v) - 1) < 6 * SetSketch().error
        assert abs(got[k]["jaccard"] - len(u & v) / len(u | v)) < 6 * max(got[k]["jaccard_error"], 0.01)


def test_languages_agree_with_most_labels(spark):
    named = {r.doc_id: label_names(r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["p9_languages"](spark, SF).collect()
    docs = [r for r in rows if r.par_no == -1 and named[r.doc_id] and r.lang]
    assert len(docs) > 50 and sum(r.lang == named[r.doc_id] for r in docs) > 0.8 * len(docs)
    assert all(0 <= x <= 1 + 1e-9 for r in rows for x in (r.confidence, r.none_of_these))
    assert len({(r.doc_id, r.par_no) for r in rows}) == len(rows)


def test_segments_follow_each_other(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    by_paragraph = {}
    for r in sorted(QUERIES["p9_segments"](spark, SF).collect()):
        by_paragraph.setdefault((r.doc_id, r.par_no), []).append(r)
    assert by_paragraph
    for (doc, _), rows in by_paragraph.items():
        assert [r.seg_no for r in rows] == list(range(len(rows))) and len(rows) > 1
        assert all(a.ends <= b.begins and a.lang != b.lang for a, b in zip(rows, rows[1:], strict=False))
        assert all(0 <= r.begins < r.ends <= len(texts[doc]) for r in rows)


def test_nothing_outside_imports_it():
    root = pathlib.Path(__file__).parents[2]
    for p in (root / "facetcube").rglob("*.py"):
        assert "llm" in p.parts or "facetcube.llm" not in p.read_text()
