"""SQL over the raw ``compiler_input`` table that the queries of several operators are checked against."""

from __future__ import annotations

FACTS = """facts as (
  select distinct fact_id,
    case when octet_length(dim1) > 0 then lpad(hex(dim1), 32, '0') end as d1,
    case when octet_length(dim2) > 0 then lpad(hex(dim2), 32, '0') end as d2,
    case when octet_length(dim3) > 0 then lpad(hex(dim3), 32, '0') end as d3,
    case when octet_length(encode(charDim1)) > 20 then
      list_extract([left(charDim1, n) for n in range(20, 0, -1) if octet_length(encode(left(charDim1, n))) <= 20], 1)
      when charDim1 <> '' then charDim1 end as c1,
    case when impressionTime <> 0 then cast(floor(impressionTime / 86400000.0) as integer) end as day,
    impCnt as imp, click as clk
  from compiler_input)"""


def key_of_day(day: str) -> str:
    """SQL for the yyyymmdd integer of a day number."""
    return f"cast(strftime(date '1970-01-01' + cast({day} as integer), '%Y%m%d') as integer)"
