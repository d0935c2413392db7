"""Sources of facts. Any DataFrame, batch or streaming, will do; these read and make the usual ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the sample application's facts.
FACT_SCHEMA = "dim1 binary, dim2 binary, dim3 binary, impressionTime bigint, impCnt bigint, click bigint, charDim1 string, charDim2 string, charDim3 string"


def read_facts(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, stream: bool = False, **options: str) -> DataFrame:
    """Facts from files of any format that Spark reads; streams need a schema."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def from_protobuf(records: DataFrame, message: str, descriptor: str, column: str = "value") -> DataFrame:
    """Facts from serialised protobuf messages in a binary column. ``descriptor``: path of a descriptor set; needs spark-protobuf on the class path. For flat messages ``protobuf.read_messages`` needs nothing."""
    from pyspark.sql.protobuf.functions import from_protobuf as decode

    return records.select(decode(F.col(column), message, descFilePath=descriptor).alias("m")).select("m.*")


def with_samples(facts: DataFrame, measures: dict[str, str], time: str) -> DataFrame:
    """Add sample columns: new name -> measure, each the struct of the measure and the time in ms."""
    return facts.withColumns({new: F.struct(F.col(m).cast("double").alias("x"), F.col(time).cast("double").alias("t")) for new, m in measures.items()})


def sample_facts(spark: SparkSession, months: int = 10, hours: int = 120, seed: int = 1) -> DataFrame:
    """Facts of the sample application: for the first ``hours`` hours of each month since 2011-09 and two ids k, hour + k + 1 facts.

    A quarter of them has a click (seeded). One more fact has dimensions only.
    """
    grid = spark.range(months * hours * 2).select((F.col("id") / (hours * 2)).cast("int").alias("month"), ((F.col("id") / 2) % hours).cast("int").alias("hour"), (F.col("id") % 2).cast("int").alias("k"))
    start = F.unix_millis(F.add_months(F.lit("2011-09-01").cast("date"), F.col("month")).cast("timestamp"))
    rows = grid.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("hour") + F.col("k") + 1)))
    key = lambda d: F.unhex(F.lpad(F.hex((F.col("k") + d).cast("bigint")), 32, "0"))
    clicked = F.pmod(F.xxhash64("month", "hour", "k", "n", F.lit(seed)), F.lit(4)) == 0
    facts = rows.select(*(key(d).alias(f"dim{i}") for i, d in enumerate((0, 10, 20), 1)), (start + F.col("hour") * 3_600_000).alias("impressionTime"), F.lit(1).cast("bigint").alias("impCnt"), F.when(clicked, F.lit(1).cast("bigint")).alias("click"), F.concat(F.lit("char"), F.col("k").cast("string")).alias("charDim1"), F.lit(None).cast("string").alias("charDim2"), F.lit("c").alias("charDim3"))
    lone = spark.range(1).select(*(F.unhex(F.lpad(F.hex(F.lit(d)), 32, F.lit("0"))).alias(f"dim{i}") for i, d in enumerate((0, 10, 20), 1)))
    return facts.unionByName(lone, allowMissingColumns=True)
