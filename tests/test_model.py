import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetcube.model import Cube, Cuboid, DateHierarchy, HexDimension, IrregularSampleMeasure, ModelError, NumericMeasure, TimeHourHierarchy, UTF8CharDimension, to_datetime
from facetcube.operators.facts import char_member, day_key, day_number, hex_member, once
from facetcube.sources.yaml_model import dump_cube, load_cube

YAML = """
- [Example]
- - &d1 !HexDimension [dim1, 16]
  - &t !SimpleTimeHourHierarchy [impressionTime, 0]
  - &c !UTF8CharDimension [charDim1, 20, true, '']
- - !SimpleCuboid [[*d1, *t]]
  - !SimpleCuboid {dimensions: [*c, *t], hbaseTTL: 60, compilerGroup: realtime}
- - !NumericMeasure [impCnt]
  - !IrregularSampleMeasure [series]
- - !FCannyAvgSum [avg7d, 0, 604800000]
""".replace("- [Example]", "- Example")


def test_yaml_round_trip():
    cube = load_cube(YAML)
    assert cube.name == "Example" and [c.path for c in cube.cuboids] == ["dim1/impressionTime", "charDim1/impressionTime"]
    assert cube.cuboids[0].ttl == 90 * 86400 and cube.cuboids[1].ttl == 60 and cube.cuboids[1].compiler_group == "realtime"
    assert load_cube(dump_cube(cube)) == cube


@pytest.mark.parametrize("text", ["a: 1", "[x, []]", "- x\n- - !Nothing [a]\n- []\n- []", "- x\n- - !HexDimension []\n- []\n- []"])
def test_bad_yaml(text):
    with pytest.raises(ModelError):
        load_cube(text)


def test_models_are_checked():
    dims = [HexDimension("a", 2)]
    with pytest.raises(ModelError):
        Cube.of("x", dims, [["a", "b"]], [])
    with pytest.raises(ModelError):
        Cube.of("x", dims, [["a", "a"]], [])
    name = Cuboid(("dim1", "time")).table_name("Cube")
    assert name.startswith("Cube_d1te_") and len(name) == len("Cube_d1te_") + 32


def test_hex_keys(spark):
    d = HexDimension("h", 8)
    df = spark.createDataFrame([(bytearray(b"\x01\xff"), 511, "1Ff"), (None, None, None)], "b binary, n bigint, s string")
    kinds = {f.name: f.dataType for f in df.schema}
    rows = df.select(*(d.key(F.col(c), kinds[c]).alias(c) for c in df.columns)).collect()
    assert set(rows[0]) == {"00000000000001FF"} and set(rows[1]) == {None}
    assert d.bound(511) == d.bound("1ff") == d.bound(b"\x01\xff") == "00000000000001FF"
    assert d.bound(-1) == "F" * 16
    assert df.select(d.key(F.lit(-1), T.LongType())).first()[0] == "F" * 16
    assert df.select(HexDimension("h", 16).key(F.lit(-2), T.LongType())).first()[0] == "F" * 31 + "E"
    assert df.select(HexDimension("h", 2).key(F.lit(0x12345), T.LongType())).first()[0] == "2345"
    for bad in ("xyz", "1" * 17, 1.5, True):
        with pytest.raises(ModelError):
            d.bound(bad)
    with pytest.raises(Exception, match="no hex number"):
        df.select(d.key(F.lit("zz"), T.StringType())).collect()
    with pytest.raises(Exception, match="too long"):
        df.select(HexDimension("h", 1).key(F.col("b"), T.BinaryType())).collect()


def test_char_keys(spark):
    d = UTF8CharDimension("c", 4)
    df = spark.createDataFrame([("abcdef",), ("aéé",), ("añañ",), ("日本",), ("",), (None,)], "c string")
    keys = [r[0] for r in df.select(d.key(F.col("c"), T.StringType())).collect()]
    assert keys == ["abcd", "aé", "aña", "日", "", None]
    assert [d.bound(r.c) for r in df.collect() if r.c is not None] == keys[:-1]
    with pytest.raises(Exception, match="too long"):
        df.select(UTF8CharDimension("c", 4, False).key(F.col("c"), T.StringType())).collect()


def test_null_keys(spark):
    df = spark.createDataFrame([(None,)], "c string")
    assert df.select(UTF8CharDimension("c", 4, True, "-").key_or_error(F.col("c"), T.StringType())).first()[0] == "-"
    with pytest.raises(Exception, match="no nullkey"):
        df.select(UTF8CharDimension("c", 4).key_or_error(F.col("c"), T.StringType())).collect()


def test_time_keys(spark):
    h, day = TimeHourHierarchy("t", 0), DateHierarchy("t")
    df = spark.createDataFrame([(1_704_067_200_000 + 3_600_000 * 5,), (None,)], "t bigint")
    rows = df.select(h.level_key(F.col("t"), T.LongType(), 1), h.level_key(F.col("t"), T.LongType(), 2)).collect()
    assert [tuple(r) for r in rows] == [("202401", "2024010105"), ("197001", "1970010100")]
    assert h.bound("2024-01-01 05:59") == h.bound(1_704_067_200_000 + 3_600_000 * 5) == "2024010105"
    assert day.bound(datetime.date(2024, 2, 29)) == "20240229" and day.depth == 1
    assert df.select(h.member(F.lit("202402")), h.member(F.lit("2024022913"))).first()[:] == (datetime.datetime(2024, 2, 1), datetime.datetime(2024, 2, 29, 13))
    assert to_datetime("2024-01-01T05:00:00+02:00") == datetime.datetime(2024, 1, 1, 3)
    for bad in (True, "soon", object()):
        with pytest.raises(ModelError):
            to_datetime(bad)


def test_measures():
    with pytest.raises(ModelError):
        NumericMeasure("m").columns(None, T.FloatType())
    with pytest.raises(ModelError):
        IrregularSampleMeasure("m").columns(None, T.DoubleType())


def test_fact_members(spark):
    df = spark.createDataFrame([(bytearray(b"\x01"), "pärla_slot/0004nj8é--b2", 0), (bytearray(b""), "", None), (None, None, 1_704_067_200_000), (bytearray(b"1" * 17), "x", -1)], "b binary, c string, t bigint")
    rows = df.select(F.hex(hex_member(F.col("b"))), char_member(F.col("c")), day_key(day_number(F.col("t")))).collect()
    assert [tuple(r) for r in rows] == [("00" * 15 + "01", "pärla_slot/0004nj8", None), (None, None, None), (None, None, 20240101), ("31" * 17, "x", 19691231)]


def test_facts_count_once(spark):
    rows = [(1, 5, 0), (1, 5, 1), (2, 5, 0), (None, 5, 0), (None, 5, 0)]
    df = spark.createDataFrame(rows, "fact_id bigint, x int, batch_id int")
    assert once(df, x=F.col("x")).count() == 4
    assert once(df.limit(0), x=F.col("x")).count() == 0
