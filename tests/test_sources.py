import pytest
from pyspark.sql import functions as F

from facetcube.functions import codecs
from facetcube.functions.aggregates import AggFunction, Field, register, state_of_fact
from facetcube.model import Cube, Cuboid, HexDimension, IrregularSampleMeasure, ModelError, NumericMeasure, TimeHourHierarchy, UTF8CharDimension
from facetcube.sources.facts import read_facts, sample_facts, with_samples
from facetcube.sources.yaml_model import dump_cube, load_cube


def test_sample_application(spark, engine):
    facts = with_samples(sample_facts(spark), {"impTimeSeries": "impCnt"}, "impressionTime")
    cube = Cube.of("Example1", [HexDimension("dim1", 16), TimeHourHierarchy("impressionTime", 0), UTF8CharDimension("charDim2", 20, True, "")], [Cuboid(("dim1", "impressionTime"), compiler_group="realtime")], [NumericMeasure("impCnt"), NumericMeasure("click"), IrregularSampleMeasure("impTimeSeries")])
    engine.deploy(cube)
    engine.compile("Example1", facts, "all")
    assert facts.count() == 146_401
    months = engine.query("Example1").add_group_by("dim1").group_by_level("impressionTime", 1).select_dimension("dim1").select_dimension("impressionTime", "m").select("COUNT", "impCnt", "n").select("COUNT", "impTimeSeries", "s").ordered().execute().collect()
    assert len(months) == 21 and [(int(r.dim1, 16), r.m) for r in months] == sorted((int(r.dim1, 16), r.m) for r in months)
    assert {(int(r.dim1, 16), r.n, r.s) for r in months if r.m != "197001"} == {(0, 7260, 7260), (1, 7380, 7380)}
    lone = engine.sql("select COUNT(impCnt) as n, SUM(click) as c from Example1 where impressionTime in [0]").collect()
    assert [tuple(r) for r in lone] == [(0, None)]
    clicks = engine.sql("select COUNT(click) as n from Example1").first().n
    assert abs(clicks / 146_400 - 0.25) < 0.01


def test_readers(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.range(3).write.json(path)
    assert read_facts(spark, path, "json", "id bigint").count() == 3
    assert read_facts(spark, path, "json", "id bigint", stream=True).isStreaming


def test_codecs(spark):
    df = spark.createDataFrame([(bytearray(b"\x0a"), "0a", 7), (None, "0A1", None), (bytearray(), "zz", 0)], "b binary, s string, n int")
    rows = df.select(codecs.hex_key(F.col("b"), 2), codecs.is_hex_id(F.col("s"), 1), codecs.decimal_key(F.col("n"), 3)).collect()
    assert [tuple(r) for r in rows] == [("000A", True, "007"), (None, False, None), ("0000", False, "000")]
    key = codecs.composite_key(codecs.decimal_key(F.lit(42), 4), codecs.hex_key(F.lit(b"\1"), 1))
    assert df.select(codecs.decimal_value(key, 0, 4), codecs.hex_bytes(F.substring(key, 5, 2))).first()[:] == (42, bytearray(b"\1"))
    with pytest.raises(Exception, match="width"):
        df.select(codecs.decimal_key(F.lit(1000), 3)).collect()
    assert codecs.decode_path(codecs.encode_path(["a", "b"])) == ["a", "b"]


def test_cut_between_code_points(spark):
    texts = ["", "abc", "abcde", "äöü", "a€€", "ab\U0001f600", "\U0001f600\U0001f600", "ab\ufffdcd", "\ufffd\ufffd\ufffd", "abc\ufffd", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 4, 5, 20):
        expected = [None if t is None else t.encode()[:n].decode(errors="ignore") for t in texts]
        assert [r.c for r in df.select(codecs.cut_utf8(F.col("t"), n).alias("c")).collect()] == expected


def test_custom_functions(spark, engine):
    geometric = register(AggFunction("GEOMEAN", ("cnt",), lambda p: F.exp(p["logs"] / p["cnt"]), (("logs", Field(lambda x: F.sum(F.log(x)), F.sum)),)))
    cube = Cube.of("G", [UTF8CharDimension("k", 5)], [["k"]], [NumericMeasure("x")], [geometric])
    assert load_cube(dump_cube(cube)) == cube and geometric.supports_complement
    engine.deploy(cube)
    for i, xs in enumerate(([1.0, 8.0], [27.0, None])):
        engine.compile("G", spark.createDataFrame([("a", x) for x in xs], "k string, x double"), f"b{i}")
    assert engine.sql("select GEOMEAN(x) as g from G group by k").first().g == pytest.approx(6.0)
    engine.compact("G")
    assert "GEOMEAN_x" in engine.query("G").add_group_by("k").add_measure("x").execute().columns
    with pytest.raises(ModelError, match="registered"):
        load_cube(dump_cube(cube).replace("GEOMEAN", "NOPE"))


def test_state_of_a_fact(spark):
    rows = spark.createDataFrame([(3,), (None,)], "x int").select(state_of_fact(F.col("x")).alias("s")).collect()
    assert rows[0].s.asDict() == {"cnt": 1, "sum": 3.0, "sum_sq": 9.0, "min": 3.0, "max": 3.0} and rows[1].s is None


def varint(x):
    x &= (1 << 64) - 1
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes(out) + bytes([x])


def test_protobuf_messages(spark):
    import random
    import struct

    from facetcube.sources import protobuf

    fields = {"dim1": (1, "bytes"), "impressionTime": (4, "uint64"), "impCnt": (5, "int64"), "delta": (6, "sint64"), "ratio": (7, "double"), "name": (8, "string"), "ok": (20, "bool"), "share": (9, "float")}
    rng, rows, messages = random.Random(3), [], []
    for _ in range(300):
        v = {"dim1": rng.randbytes(rng.randrange(200)), "impressionTime": rng.randrange(2**62), "impCnt": rng.randrange(-(2**62), 2**62), "delta": rng.randrange(-1000, 1000), "ratio": rng.random(), "name": rng.choice(["", "ä€", "x" * 300]), "ok": rng.random() < 0.5, "share": 0.25}
        v = {k: x for k, x in v.items() if rng.random() < 0.7}
        parts = []
        for k, x in [*v.items(), *((k, x) for k, x in v.items() if rng.random() < 0.1)]:
            n, kind = fields[k]
            wire = protobuf.KINDS[kind][1]
            raw = x.encode() if kind == "string" else x
            body = {0: lambda: varint((x << 1) ^ (x >> 63) if kind == "sint64" else int(x)), 1: lambda: struct.pack("<d", x), 5: lambda: struct.pack("<f", x), 2: lambda: varint(len(raw)) + raw}[wire]()
            parts.append(varint(n << 3 | wire) + body)
        parts.insert(0, varint(99 << 3 | 2) + varint(3) + b"abc")  # a field that nobody asks for
        messages.append(b"".join(parts))
        rows.append(tuple(bytearray(v[k]) if k == "dim1" and k in v else v.get(k) for k in fields))
    df = spark.createDataFrame([(bytearray(m),) for m in messages] + [(None,), (bytearray(),)], "value binary").coalesce(2)
    got = [tuple(r) for r in protobuf.read_messages(df, fields).collect()]
    assert got == [*rows, *[(None,) * len(fields)] * 2]
    for broken in (b"\x08", b"\x0a\x05ab", b"\x39\x01", b"\x0b", b"\x08" + b"\xff" * 11):
        with pytest.raises(protobuf.BrokenMessage):
            protobuf.parse(__import__("pyarrow").array([broken]), {"a": (1, "int64"), "d": (7, "double")})
    with pytest.raises(ValueError, match="kinds"):
        protobuf.read_messages(df, {"a": (1, "group")})


def test_the_package_can_be_sent_to_executors(tmp_path):
    """From another folder, workers do not see the package unless it is sent to them."""
    import pathlib
    import subprocess
    import sys

    script = f"""
import sys
sys.path.insert(0, {str(pathlib.Path(__file__).parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from facetcube.engine import ship
from facetcube.operators.dense import per_key
ship(spark)
ship(spark)
print("rows", per_key(spark.createDataFrame([(bytearray(b"a"), 1)], "k binary, x bigint"), ["k"], ["x"]).count())
"""
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 1" in out.stdout, out.stderr[-2000:]
