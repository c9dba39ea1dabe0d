"""Pixel and metadata views over the star-schema tables; the SQL text is shared by Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PX = """select frame_id, cast(rn % 24 as int) as x, cast(floor(rn/24) as int) as y,
       l_extendedprice/1e3 as r, l_extendedprice*(1-l_discount)/1250e0 as g, l_quantity*(1+l_tax) as b
from (select l_suppkey as frame_id,
             row_number() over (partition by l_suppkey order by l_orderkey,l_linenumber,l_partkey,l_quantity,
               l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus)-1 as rn,
             count(*) over (partition by l_suppkey) as n,
             l_extendedprice, l_quantity, l_discount, l_tax from {lineitem}) o
where rn < floor(n/24)*24"""

STACK = """select frame_id as scene_id, exposure_idx, ev, x, y,
 cast(floor(least(1e0, (case when exposure_idx=2 and x<6 and y<6 then b else r end)/60e0*pow(2e0, ev))*255e0+5e-1) as double)/255e0 as r,
 cast(floor(least(1e0, g/60e0*pow(2e0, ev))*255e0+5e-1) as double)/255e0 as g,
 cast(floor(least(1e0, (case when exposure_idx=2 and x<6 and y<6 then r else b end)/60e0*pow(2e0, ev))*255e0+5e-1) as double)/255e0 as b
from {px} cross join (select 0 as exposure_idx, -2e0 as ev union all select 1, 0e0 union all select 2, 2e0) t"""

META = """select o_orderkey as file_id, o_custkey as folder_id,
 concat('IMG_', lpad(cast(o_orderkey as varchar(20)), 8, '0'), '.tif') as file,
 case when o_orderkey % 5 <> 0 then cast(1.0 as double)/(1+o_orderkey % 1000) end as exposure_time,
 case when o_orderkey % 10 <> 0 then cast(o_orderkey % 11 as double) - 2 end as shutter_speed_value,
 case when o_orderkey % 3 <> 0 then cast(1.4 as double)+(o_orderkey % 7) end as f_number,
 case when o_orderkey % 6 <> 0 then cast(o_orderkey % 9 as double) end as aperture_value,
 case when o_orderkey % 4 <> 0 then cast(100*(1+o_orderkey % 4) as double) end as iso,
 case o_orderkey % 4 when 0 then 1 when 1 then 3 when 2 then 6 else 8 end as orientation
from {orders}"""

SEQ = """select user_id as seq_id, event_id as frame_id, ts, value as lum,
       row_number() over (partition by user_id order by ts, event_id) as n from {events}"""

CTE = f"px as ({PX.format(lineitem='lineitem')}), stack as ({STACK.format(px='px')}), meta as ({META.format(orders='orders')}), seq as ({SEQ.format(events='events')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(frame_id, x, y, r, g, b): one frame per supplier."""
    return spark.sql(PX, lineitem=table(spark, sf_dir, "lineitem"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack(scene_id, exposure_idx, ev, x, y, r, g, b): three 8-bit exposures of each frame."""
    return spark.sql(STACK, px=px(spark, sf_dir))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(META, orders=table(spark, sf_dir, "orders"))


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEQ, events=table(spark, sf_dir, "events"))
