"""Segment, attempt, poll, line, track, key and URL rows made from the driver's tables, by one SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEG = """select cast(l_suppkey as string) as channel_id, cast(year(l_shipdate) as string) as period_id,
  case when l_linestatus='O' then '0' when l_returnflag='A' then '1' else '2' end as as_id,
  case when l_linestatus='O' then 'v' || cast(l_partkey % 2 as string) else 'a' || l_returnflag end as rep_id,
  case when l_linestatus='O' then 'video' else 'audio' end as media_type,
  cast(floor((dayofyear(l_shipdate)-1)/8) as bigint) as seg_no,
  cast(floor((dayofyear(l_shipdate)-1)/8)*720000 + (l_partkey % 5)*90000 as bigint) as start_pts,
  cast(floor((dayofyear(l_shipdate)-1)/8)*720000 + (l_partkey % 5)*90000 + floor(l_quantity)*14400 as bigint) as end_pts,
  cast(90000 as int) as timescale,
  cast(l_orderkey as bigint)*100000000 + cast(l_linenumber as bigint)*10000000 + cast(l_partkey as bigint) as commit_ord,
  (l_returnflag='R' and l_linenumber=1) as discontinuity,
  case when l_tax>0.04 then 'https://keys.example/' || cast(l_partkey % 10 as string) end as key_uri
from lineitem"""

ATT = """select cast(user_id as string) as channel_id, cast(event_id % 3 as string) as period_id, case when event_id % 2 = 0 then '0' else '1' end as as_id,
  case when event_id % 2 = 0 then 'v' else 'a' end as rep_id, event_id % 5 as seg_no, event_id, ts as attempt_at,
  case event_type when 'click' then 'ok' when 'view' then 'ok' when 'error' then 'error' when 'signup' then 'write_error' else 'gone' end as outcome,
  case event_type when 'error' then 500 when 'signup' then 200 when 'purchase' then 410 else 200 end as http_status,
  cast(floor(value*1000) as bigint) as bytes, value/1000 as duration_s
from events"""

POL = """select cast(user_id as string) as channel_id, event_type as rep_id, ts as poll_at, event_id,
  cast(floor(value) as bigint) as media_sequence, cast(floor(value) as bigint)+4 as last_seq,
  (event_id % 17 <> 0) as ok, (event_id % 101 = 0) as end_list
from events"""

LIN = """select conv_id as doc_id, turn as line_no,
  case role when 'system' then 'KEY' when 'user' then 'INF' else 'URI' end as tag, text
from conversations"""

TRK = """select cast(p_partkey as string) as rep_id, 'avc1.' || cast(p_size as string) || ', mp4a.' || p_type as codecs,
  cast(round(p_retailprice*1000) as bigint) as bandwidth, p_brand as lang,
  case when p_partkey % 3 = 0 then cast(null as int) else p_size end as rep_timescale, p_size*100 as as_timescale
from part"""

KEYREQ = "select distinct cast(o_custkey as string) as as_id, o_orderpriority as kid from orders where o_orderstatus <> 'F'"
KEYHELD = "select distinct cast(o_custkey as string) as as_id, o_orderpriority as kid from orders where o_orderstatus = 'F' or o_orderkey % 4 = 0"
URL = "select page_id, url, cast(page_id*7 as bigint) as number, 'rep/' || cast(page_id % 9 as string) as rep_id from pages"

ALL = {"seg": (SEG, "lineitem"), "att": (ATT, "events"), "pol": (POL, "events"), "lin": (LIN, "conversations"), "trk": (TRK, "part"), "keyreq": (KEYREQ, "orders"), "keyheld": (KEYHELD, "orders"), "url": (URL, "pages")}


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection over the table in sf_dir; nothing is registered in the session."""
    sql, source = ALL[name]
    return spark.sql(sql.replace(f"from {source}", "from {src}"), src=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


#: Rows of a table that one task sorts, at most: its memory does not grow with the table, whatever the session's number of partitions.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, keys, sf_dir: str, name: str) -> DataFrame:
    """df, made from the projection, by the hash of keys: as many partitions as shuffles have, or more where the table
    has over ROWS_A_TASK rows for each (its rows are counted in the files' footers). Windows by the keys or by keys and
    more need no other exchange."""
    n = -(-df.sparkSession.read.parquet(f"{sf_dir}/{ALL[name][1]}.parquet").count() // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def with_sql(body: str, *names: str) -> str:
    """The same rows as common table expressions in front of a query."""
    return "with " + ", ".join(f"{n} as ({ALL[n][0]})" for n in names) + "\n" + body
