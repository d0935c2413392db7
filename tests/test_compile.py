import pytest
from pyspark.sql import functions as F

from facetcube.functions.aggregates import canny_avg
from facetcube.model import Cube, Cuboid, IrregularSampleMeasure, ModelError, NumericMeasure, TimeHourHierarchy, UTF8CharDimension

CUBE = Cube.of("K", [UTF8CharDimension("k", 8, True, "-"), TimeHourHierarchy("t", 0)], [Cuboid(("k", "t"), compiler_group="g"), ["k"], ["t", "k"]], [NumericMeasure("x"), IrregularSampleMeasure("s")], [canny_avg("avg1d", 0, 86_400_000)])


def facts(spark, n=400):
    t = F.when(F.col("id") % 17 != 0, F.lit(1_704_067_200_000) + F.col("id") * 5_000_000)
    x = F.when(F.col("id") % 5 != 0, (F.col("id") % 11).cast("double"))
    df = spark.range(n).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"), t.alias("t"), x.alias("x"))
    return df.withColumn("s", F.struct("x", "t")).withColumn("_written", F.lit("clash")).withColumn("t_level", F.lit("clash"))


TEXT = "select k, COUNT(x) as n, SUM(x) as total, MIN(x) as lo, SD(x) as sd, avg1d(s) as a, COUNT(s) as ns from K where t in ['2024-01-02', inf) group by k"


def answer(engine, text=TEXT):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in engine.sql(text).collect())


def test_any_partition_into_batches_gives_the_whole(spark, engine):
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "all")
    whole = answer(engine)
    assert len(whole) == 4 and whole[0][0] == "-"
    engine.drop("K")
    engine.deploy(CUBE)
    for i in (2, 0, 1):
        engine.compile("K", facts(spark).filter(F.pmod(F.hash("id"), F.lit(3)) == i), f"b{i}")
    assert answer(engine) == whole
    engine.compile("K", facts(spark).filter(F.pmod(F.hash("id"), F.lit(3)) == 1), "b1")
    assert answer(engine) == whole
    engine.compact("K")
    assert answer(engine) == whole
    with pytest.raises(ModelError, match="absorbed"):
        engine.compile("K", facts(spark), "b1")
    assert engine.compile("K", facts(spark), "b1", absorbed="skip") == []
    assert answer(engine) == whole
    for c in CUBE.cuboids:
        assert len(engine.catalog.manifest(CUBE, c)) == 1


def test_derived_cuboids_equal_compiled_ones(spark, engine):
    from facetcube.operators import compile as c

    cube = Cube.of("K", CUBE.dimensions.values(), [["k", "t"], ["k"], ["t"]], CUBE.measures.values(), CUBE.functions.values())
    assert [p and p.path for p in c.lattice(list(cube.cuboids)).values()] == [None, "k/t", "k/t"]
    engine.deploy(cube)
    engine.compile(cube, facts(spark), "all")
    encoded = c.encode(facts(spark), cube, cube.dimensions, cube.measures)
    for cuboid in cube.cuboids:
        keys = c.key_columns(cube, cuboid)
        lone = Cube.of("L", cube.dimensions.values(), [cuboid], cube.measures.values(), cube.functions.values())
        engine.deploy(lone)
        engine.compile(lone, facts(spark), "all")
        rows = [{tuple(r[k] for k in keys): tuple(round(r[x], 6) if isinstance(r[x], float) else r[x] for x in sorted(df.columns) if x not in (*keys, "_written", "_attempt")) for r in df.collect()} for df in (c.read_cells(engine.catalog, x, cuboid) for x in (cube, lone))]
        assert rows[0] == rows[1] and rows[0]


def test_intervals_add_up(spark, engine):
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "all")
    n = lambda a, b: engine.sql("select COUNT(x) as n from K where t in [?, ?)", a, b).first().n
    assert n("2024-01-02 05:00", "2024-01-17 09:00") == n("2024-01-02 05:00", "2024-01-09 01:00") + n("2024-01-09 01:00", "2024-01-17 09:00")


def test_groups_and_measures(spark, engine):
    engine.deploy(CUBE)
    assert engine.compile("K", facts(spark), "a", groups=["g"]) == ["k/t"]
    assert engine.query("K").add_group_by("k").select("SUM", "x").cuboid().path == "k/t"  # the complete one, not the smallest
    with pytest.raises(ModelError):
        engine.compile("K", facts(spark), "a", groups=["none"])
    with pytest.raises(ModelError):
        engine.compile("K", facts(spark), "a", include=["x"], exclude=["x"])
    with pytest.raises(ModelError):
        engine.compile("K", facts(spark), "a", include=["y"])
    with pytest.raises(ModelError):
        engine.compile("K", facts(spark).drop("k"), "a")
    with pytest.raises(ModelError):
        engine.compile("K", facts(spark), "_a")


def test_empty_batches(spark, engine):
    engine.deploy(CUBE)
    assert answer(engine) == []
    engine.compile("K", facts(spark).limit(0), "none")
    assert answer(engine) == [] and engine.sql("select SUM(x) as s from K").collect() == []
    engine.compact("K")
    assert answer(engine) == []


def test_plan_prunes_and_pushes_down(spark, engine):
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "all")
    df = engine.sql("select k, SUM(x) as s from K where t in ['2024-01-02', '2024-01-05') group by k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t_level)" in plan or "GreaterThanOrEqual(t_key,2024010200)" in plan
    assert "x__min" not in plan and "avg1d" not in plan


def test_model_versions(engine):
    engine.deploy(CUBE)
    engine.deploy(CUBE)
    assert engine.catalog.versions("K") == [1, 2]
    engine.catalog._cache.clear()
    assert engine.catalog.load_model("K") == CUBE
