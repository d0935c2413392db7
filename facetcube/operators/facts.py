"""Facts as the operators see them: one row a fact, members and days in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetcube.functions.codecs import cut_utf8

MS_PER_DAY = 86_400_000


def hex_member(c: Column, keylen: int = 16) -> Column:
    """Member of a binary dimension as bytes: left-padded with zero bytes to ``keylen``; null for null and empty.

    Longer values are kept whole.
    """
    return F.when(F.length(c) > keylen, c).when(F.length(c) > 0, F.lpad(c, keylen, F.lit(bytes(1))))


def char_member(c: Column, keylen: int = 20) -> Column:
    """Member of a character dimension: the first ``keylen`` bytes of its UTF-8 text; null for null and empty.

    A code point that the cut falls into is left out.
    """
    return F.when(F.octet_length(c) > 0, cut_utf8(c, keylen))


def day_number(ms: Column) -> Column:
    """UTC days since 1970-01-01 of epoch milliseconds; null for null and 0."""
    return F.when(ms != 0, F.floor(ms / F.lit(float(MS_PER_DAY))).cast("int"))


def day_key(day: Column) -> Column:
    """yyyymmdd of a day number, as an integer."""
    d = F.date_from_unix_date(day)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def day_of_key(key: int) -> int:
    """Day number of a yyyymmdd integer."""
    import datetime

    return (datetime.date(key // 10000, key // 100 % 100, key % 100) - datetime.date(1970, 1, 1)).days


def deliveries(df: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of each delivery of a fact, with its key (fact_id, _lone).

    A row without ``fact_id`` cannot be matched to another one and counts as
    its own fact: ``_lone`` tells such rows apart.
    """
    lone = F.when(F.col("fact_id").isNull(), F.monotonically_increasing_id())
    return df.select("fact_id", lone.alias("_lone"), *(c.alias(k) for k, c in columns.items()))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of each fact, a fact once, however often it was delivered.

    Deliveries of a fact agree in all fields but batch and time of arrival, so
    the distinct rows of (fact_id, columns) are the facts; that needs one
    shuffle on keys that are spread evenly and no sort.
    """
    return deliveries(df, **columns).distinct()
