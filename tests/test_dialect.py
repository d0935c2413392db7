import pytest

from facetcube.model import Cube, HexDimension, ModelError, NumericMeasure, TimeHourHierarchy
from facetcube.plans.dialect import Param, QuerySyntaxError, parse


def test_full_query():
    t = parse("select d1 as x, SUM(m), COUNT(m) as c // note\n from Cube where d1 in [1, 5.5), t in ('a', inf], d2 in (-3) group by d1, d2 /* end */")
    assert [(i.name, i.function, i.alias) for i in t.items] == [("d1", None, "x"), ("m", "SUM", None), ("m", "COUNT", "c")]
    assert t.cube == "Cube" and t.groups == ["d1", "d2"]
    assert [(s.left, s.left_open, s.right, s.right_open) for s in t.slices] == [(1, False, 5.5, True), ("a", True, float("inf"), False), (-3, False, -3, False)]


def test_parameters_are_numbered_in_order():
    t = parse("select ?, ?(?) as ? from ? where ? in [?, ?) group by ?")
    assert t.params == 9 and t.items[1].function == Param(1) and t.items[1].alias == Param(3) and t.cube == Param(4) and t.groups == [Param(8)]


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        ("", 1), ("select", 1), ("SELECT a from b", 1), ("select a from b where", 1), ("select a from b group d", 1), ("select a b from c", 1),
        ("select SUM(a from b", 1), ("select a from b where d in 1, 2]", 2), ("select a from b where d in [1, 2", 1), ("select f(), g() from b", 2),
        ("select a from b where d in [x], e in ['y' group by 3", 3), ("select a from b;", 1), ("select a from b extra", 1), ("select a as select from b", 1), ("select a from b where d in [-'x']", 1),
    ],
)
def test_syntax_errors(text, errors):
    with pytest.raises(QuerySyntaxError) as e:
        parse(text)
    assert len(e.value.errors) == errors and all(x.startswith("line ") for x in e.value.errors)


@pytest.fixture
def small(spark, engine):
    cube = Cube.of("C", [HexDimension("d1", 2), HexDimension("d2", 2), TimeHourHierarchy("t", 0)], [["d1", "d2"], ["d1", "t"]], [NumericMeasure("m")])
    engine.deploy(cube)
    rows = [(1, 1, 0, 1.0), (1, 2, 3_600_000, 2.0), (2, 1, None, 3.0), (2, 2, 40 * 86_400_000, None)]
    engine.compile(cube, spark.createDataFrame(rows, "d1 int, d2 int, t bigint, m double"), "b1")
    return engine


def test_answers(small):
    assert [tuple(r) for r in small.sql("select d1, SUM(m), COUNT(m) from C group by d1").orderBy("d1").collect()] == [("0001", 3.0, 2), ("0002", 3.0, 1)]
    assert [tuple(r) for r in small.sql("select d1, SUM(m) as s, COUNT(m) as c from C where d2 in [2], d1 in [2] group by d1").collect()] == [("0002", None, 0)]
    assert small.sql("select SUM(m) as s from C where d1 in [9]").collect() == []
    assert small.sql("select SUM(m) as s from C where t in [0, 3600000)").first().s == 4.0  # the null key is hour 0
    assert small.sql("select SUM(m) as s from C where t in [?]", "1970-01-01 01:30").first().s == 2.0


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("select SUM(m) from Nope", "Unknown cube"), ("select SUM(nope) from C", "Unknown measure"), ("select sum(m) from C", "Unknown function"),
        ("select nope, SUM(m) from C group by nope", "Unknown dimension"), ("select SUM(m) as a, COUNT(m) as a from C", "Duplicate alias"), ("select d1 from C group by d1", "no measures"),
        ("select SUM(m) from C where d1 in [1], d1 in [2]", "more than one slice"), ("select SUM(m) from C group by t", "hierarchy"), ("select d2, SUM(m) from C group by d1", "neither grouped"),
        ("select SUM(m) from C where d1 in [?]", "parameter 0"), ("select SUM(m) from C where d2 in [1], t in [0]", "suitable"),
    ],
)
def test_semantic_errors(small, text, message):
    with pytest.raises(ModelError, match=message):
        small.sql(text)


def test_parameters_are_gone_after_a_run(small):
    p = small.prepare("select SUM(m) as s from C where d1 in [?]")
    assert p.execute(1).first().s == 3.0
    with pytest.raises(ModelError, match="parameter 0"):
        p.execute()
    with pytest.raises(ModelError):
        p.set(1, 0)


def test_builder(small):
    from facetcube.engine import rows, to_frame

    q = small.query("C").add_group_by("d1").select_dimension("d1").add_measure("m").members()
    assert q.aliases[0] == "d1" and "AVG_m" in q.aliases and "cuboid d1/d2" in q.explain()
    assert to_frame(q.execute()).d1.tolist() == ["0001", "0002"] or set(to_frame(q.execute()).d1) == {"0001", "0002"}
    assert {bytes(r.d1) for r in rows(q.execute())} == {b"\0\1", b"\0\2"}
    q = small.query("C").add_closed_slice("d1", 1, 1).select("SUM", "m").add_slice("d1", None, False, None, False)
    assert q.execute().first()["SUM_m"] == 6.0
    q = small.query("C").add_complement_slice("t", "1970-01-01", "1970-02-01").select("COUNT", "m", "c")
    assert q.execute().first().c == 0
    with pytest.raises(ModelError, match="complement"):
        q.select("MIN", "m").execute()
    with pytest.raises(ModelError, match="no level"):
        small.query("C").group_by_level("t", 3)
    with pytest.raises(ModelError, match="cut a member"):
        small.query("C").group_by_level("t", 1).add_closed_slice("t", "1970-01-02", None).select("SUM", "m").execute()


def test_drop_keeps_the_model(small):
    small.drop("C")
    with pytest.raises(ModelError, match="not deployed"):
        small.sql("select d1, SUM(m) as s from C group by d1")
    assert small.catalog.cubes() == ["C"]
