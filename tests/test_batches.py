"""Batches, manifests and layout: what readers see between the steps, after failures, and how much they read."""

import pathlib
import threading

import pytest
from pyspark.sql import functions as F

from facetcube import storage
from facetcube.functions.aggregates import canny_avg, distinct, register
from facetcube.model import Cube, Cuboid, IrregularSampleMeasure, ModelError, NumericMeasure, TimeHourHierarchy, UTF8CharDimension
from facetcube.operators import compile as c
from tests.test_compile import CUBE, answer, facts


def test_documents_are_published_one_after_the_other(spark, tmp_path):
    at = "file://" + str(tmp_path / "m")
    assert storage.published(spark, at, "m") == (0, None)
    for n in range(1, 15):
        storage.publish(spark, at, "m", n, {"n": n})
        assert storage.published(spark, at, "m") == (n, {"n": n})
    with pytest.raises(storage.Published):
        storage.publish(spark, at, "m", 14, {})
    assert len(storage.names(spark, at)) == storage.KEPT
    # a writer died half through: readers keep the version before, the next writer goes on
    (tmp_path / "m" / "m-00000015.json").write_text('{"n": 1')
    assert storage.published(spark, at, "m")[0] == 14
    storage.publish(spark, at, "m", 15, {"n": 15})
    assert storage.published(spark, at, "m") == (15, {"n": 15})


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            isDefined = staticmethod(lambda: False)  # noqa: N815
            getCheckpointDir = staticmethod(lambda: Context._jsc)  # noqa: N815
            sc = staticmethod(lambda: Context._jsc)

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)
            set = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(Session)
    Context.master = "local[3]"
    assert storage.shared_dir(Session).startswith("file:///")
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_readers_see_the_old_batch_until_the_new_one_is_there(spark, engine, monkeypatch):
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "b")
    before, seen, write = answer(engine), [], c._write

    def slow(*args, **more):
        seen.append(answer(engine))
        write(*args, **more)
        seen.append(answer(engine))

    with monkeypatch.context() as m:
        m.setattr(c, "_write", slow)
        engine.compile("K", facts(spark, 200), "b", groups=["g"])
    assert len(seen) > 2 and all(x == before for x in seen)
    assert answer(engine) != before


def test_a_failing_attempt_changes_nothing(spark, engine, monkeypatch):
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "b")
    before, write = answer(engine), c._write

    def failing_after(writes):
        left = [writes]

        def failing(*args, **more):
            left[0] -= 1
            if left[0] < 0:
                raise OSError("disk")
            write(*args, **more)

        return failing

    for writes, again in ((1, lambda: engine.compile("K", facts(spark, 200), "b", groups=["g"])), (0, lambda: engine.compact("K"))):
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(c, "_write", failing_after(writes))
            again()
        assert answer(engine) == before


def test_two_writers_and_a_compaction(spark, engine, monkeypatch):
    engine.deploy(CUBE)
    parts = [facts(spark).filter(F.col("id") % 3 == i) for i in range(3)]
    jobs = [threading.Thread(target=engine.compile, args=("K", p, f"b{i}")) for i, p in enumerate(parts[:2])]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    cuboid = CUBE.cuboids[0]
    assert set(engine.catalog.manifest(CUBE, cuboid)) == {"b0", "b1"}
    write = c._write

    def meanwhile(batch, part):
        def inner(*args, **more):
            monkeypatch.setattr(c, "_write", write)
            engine.compile("K", part, batch)
            write(*args, **more)

        monkeypatch.setattr(c, "_write", inner)

    meanwhile("b2", parts[2])  # a new batch comes in while two are merged
    name = c.compact(engine.catalog, CUBE, cuboid)
    assert set(engine.catalog.manifest(CUBE, cuboid)) == {name, "b2"}
    engine.drop("K")
    engine.deploy(CUBE)
    for i, p in enumerate(parts):
        engine.compile("K", p, f"b{i}")
    whole = answer(engine)
    meanwhile("b1", parts[1])  # a merged batch is replaced meanwhile
    with pytest.raises(storage.Conflict):
        c.compact(engine.catalog, CUBE, cuboid)
    assert answer(engine) == whole


def test_vacuum_leaves_what_is_named(spark, engine):
    engine.deploy(CUBE)
    for n in (400, 200):
        engine.compile("K", facts(spark, n), "b")
    before = answer(engine)
    engine.vacuum("K", grace=3600)
    table = pathlib.Path(engine.catalog.table(CUBE, CUBE.cuboids[0]).removeprefix("file://"))
    assert len([p for p in table.iterdir() if p.is_dir()]) == 2
    engine.vacuum("K", grace=-5)
    assert len([p for p in table.iterdir() if p.is_dir()]) == 1 and answer(engine) == before
    engine.compact("K", grace=-5)
    assert len([p for p in table.iterdir() if p.is_dir()]) == 1 and answer(engine) == before


def test_a_cuboid_without_manifest_is_an_error(engine, spark):
    engine.deploy(CUBE)
    engine.drop("K")
    with pytest.raises(ModelError, match="not deployed"):
        engine.sql("select SUM(x) as s from K")
    with pytest.raises(ModelError, match="not deployed"):
        engine.compile("K", facts(spark), "b")


def test_names_of_absorbed_batches():
    a = c.gathered([], [*(f"s-{i}" for i in (0, 1, 2, 5)), "daily", "s-007"])
    assert a == {"s-": [[0, 2], [5, 5]], "daily": [], "s-007": []}
    a = c.gathered([a], ["s-3", "t-1"])
    assert a["s-"] == [[0, 3], [5, 5]] and a["t-"] == [[1, 1]]
    assert [c.holds(a, b) for b in ("s-3", "s-4", "daily", "s-007", "s-7", "t-1", "other")] == [True, False, True, True, False, True, False]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merges_combine_before_the_shuffle(spark, engine):
    """No window, and no single partition before the partial aggregates, also for a query without groups."""
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "b")
    for text in ("select avg1d(s) as a, SUM(x) as v from K", "select k, avg1d(s) as a from K group by k"):
        text_plan = plan(engine.sql(text))
        assert "Window" not in text_plan and "partial_sum" in text_plan
        single = text_plan.split("SinglePartition")
        assert all("partial_max" in part.split("Exchange")[0] for part in single[1:])
    read = c.read_cells(engine.catalog, CUBE, CUBE.cuboids[0])
    assert "Window" not in plan(c.merge_cells(read, c.key_columns(CUBE, CUBE.cuboids[0]), CUBE, CUBE.measures))


def bytes_read(spark, df):
    """Files of the scan after partition pruning, and their size."""
    import re

    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    files = [f for f in df.inputFiles()]
    return text, files, re.findall(r"PartitionFilters: \[([^\]]*)\]", text)


def test_a_slice_of_a_day_opens_its_batch_and_month(spark, engine):
    cube = Cube.of("D", [UTF8CharDimension("k", 8), TimeHourHierarchy("t")], [["k", "t"]], [NumericMeasure("x")])
    engine.deploy(cube)
    hours = spark.range(24 * 120).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("k"), (F.lit(1_704_067_200_000) + F.col("id") * 3_600_000).alias("t"), F.col("id").cast("double").alias("x"))
    for i in range(4):
        engine.compile("D", hours.filter(F.col("x").between(i * 720, i * 720 + 719)), f"b{i}")
    query = "select k, SUM(x) as v from D where t in ['2024-02-10', '2024-02-11') group by k"
    expected = {f"k{k}": sum(h for h in range(24 * 40, 24 * 41) if h % 5 == k) for k in range(5)}
    df = engine.sql(query)
    assert {r.k: r.v for r in df.collect()} == expected
    assert all("=b1-" in f for f in df.inputFiles())  # the other batches' time ranges do not meet it
    engine.compact("D")
    df = engine.sql(query)
    assert {r.k: r.v for r in df.collect()} == expected
    _, files, filters = bytes_read(spark, df)
    assert "t_month" in filters[0]
    table = pathlib.Path(engine.catalog.table(cube, cube.cuboids[0]).removeprefix("file://"))
    live = engine.catalog.manifest(cube, cube.cuboids[0]).popitem()[1]["path"]
    folders = {p.name for p in (table / live / "t_level=2").iterdir() if p.is_dir()}
    assert folders == {"t_month=202401", "t_month=202402", "t_month=202403", "t_month=202404"}
    metrics = {k: v for k, v in _scan_metrics(df).items()}
    assert metrics["numPartitions"] == 1 and metrics["numFiles"] == 1


def _scan_metrics(df):
    """Files and folders that the executed scan has read."""
    plan, out = df._jdf.queryExecution().executedPlan(), {}
    stack = [plan]
    while stack:
        p = stack.pop()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            for k in ("numFiles", "numPartitions"):
                out[k] = p.metrics().apply(k).value()
        for name in ("executedPlan", "plan"):
            try:
                stack.append(getattr(p, name)())
            except Exception:  # noqa: BLE001 - most nodes have no such method
                pass
        children = p.children()
        stack += [children.apply(i) for i in range(children.size())]
    return out


def test_expired_cells_answer_no_query(spark, engine):
    cube = Cube.of("T", [UTF8CharDimension("k", 8)], [Cuboid(("k",), ttl=100)], [NumericMeasure("x")])
    engine.deploy(cube)
    rows = lambda ks: spark.createDataFrame([(k, 1.0) for k in ks], "k string, x double")
    engine.compile("T", rows("ab"), "one")
    written = engine.catalog.manifest(cube, cube.cuboids[0])["one"]["written"]
    ask = lambda now: sorted(tuple(r) for r in engine.query("T").as_of(now).add_group_by("k").select_dimension("k").select("COUNT", "x", "n").execute().collect())
    assert ask(written + 90) == [("a", 1), ("b", 1)] and ask(written + 200) == []
    engine.compile("T", rows("b"), "two")
    assert ask(written + 90) == [("a", 1), ("b", 2)]


def test_custom_states_of_any_type(spark, engine):
    """Distinct counts as a cube function: a binary sketch that Spark aggregates, merged over batches and levels."""
    users = register(distinct("USERS"))
    cube = Cube.of("U", [UTF8CharDimension("k", 8), TimeHourHierarchy("t")], [["k", "t"], ["k"]], [NumericMeasure("user")], [users])
    engine.deploy(cube)
    rows = spark.range(6000).select((F.col("id") % 2).cast("string").alias("k"), (F.col("id") * 700_000 + 1_704_067_200_000).alias("t"), (F.col("id") % 1000).alias("user"))
    for i in range(2):
        engine.compile("U", rows.filter(F.col("id") % 3 == 0) if i else rows.filter(F.col("id") % 3 != 0), f"b{i}")
    exact = {"0": 500, "1": 500}
    for text in ("select k, USERS(user) as n from U group by k", "select k, USERS(user) as n from U where t in ['2024-01-01', inf) group by k"):
        assert all(abs(r.n / exact[r.k] - 1) < 0.08 for r in engine.sql(text).collect())
    engine.compact("U")
    assert all(abs(r.n / exact[r.k] - 1) < 0.08 for r in engine.sql("select k, USERS(user) as n from U group by k").collect())
    with pytest.raises(ModelError, match="complement"):
        engine.query("U").add_complement_slice("t", "2024-01-02", "2024-01-03").add_group_by("k").select("USERS", "user").execute()


def test_short_time_constants_in_a_cube(spark, engine):
    """The fixed samples of a Canny average with dt = 5, in one cell, in two batches, and over a merge of levels."""
    cube = Cube.of("C", [UTF8CharDimension("k", 8), TimeHourHierarchy("h")], [["k", "h"]], [IrregularSampleMeasure("s")], [canny_avg("a", 0, 5.0)])
    s = cube.functions["a"].summarizer
    engine.deploy(cube)
    rows = spark.createDataFrame([("x", 0, 1.0, 1.0), ("x", 0, 4.0, 2.0), ("y", 0, 1.0, 1.0), ("y", 7_200_000, 4.0, 7_200_002.0)], "k string, h bigint, v double, t double").select("k", "h", F.struct("v", "t").alias("s"))
    for i in range(2):
        engine.compile("C", rows.filter(F.col("s.v") == (4.0 if i else 1.0)), f"b{i}")
    import math

    w, v = math.exp(-1 / s.alpha), math.exp(-1 / s.beta)
    value = (s.k * (4 + w) - (s.k - 1) * (4 + v)) / (s.k * (1 + w) - (s.k - 1) * (1 + v))
    got = {r.k: r.a for r in engine.sql("select k, a(s) as a from C group by k").collect()}
    assert got["x"] == pytest.approx(value, rel=1e-10) and got["y"] == pytest.approx(4.0)
    assert engine.sql("select a(s) as a from C").first().a == pytest.approx(4.0)


def test_streams_compact_as_they_go(spark, engine, tmp_path):
    engine.deploy(CUBE)
    raw = facts(spark).drop("_written", "t_level", "s")
    for i in range(4):
        raw.filter(F.col("id") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("s", F.struct("x", "t"))
    engine.compile_stream("K", stream, "f", str(tmp_path / "cp"), compact_every=3).awaitTermination()
    batches = engine.catalog.manifest(CUBE, CUBE.cuboids[0])
    assert len(batches) == 2 and c.holds(next(b for n, b in batches.items() if n.startswith("compacted"))["absorbed"], "f-1")
    whole = answer(engine)
    engine.drop("K")
    engine.deploy(CUBE)
    engine.compile("K", facts(spark), "all")
    assert answer(engine) == whole
