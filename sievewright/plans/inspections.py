"""An inspection-shaped projection of the driver's order tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COLUMNS = """o_orderkey inspection_id,
 case when o_orderkey%7=0 then c_name||' INC' when o_orderkey%7=1 then replace(c_name,'Customer#0000','CUSTOMER ') when o_orderkey%7=2 then 'Unit '||cast(o_orderkey%3 as string)||' Holdings' when o_orderkey%101=0 then null else c_name end dba_name,
 case when o_orderkey%5=0 then null else c_name end aka_name,
 case when o_orderkey%97=0 then null when o_orderkey%89=0 then 0 else o_custkey end license_no,
 case when o_orderkey%11=0 then null when o_orderkey%13=0 then 'Machinery ' else c_mktsegment end facility_type,
 case when o_orderkey%83=0 then null when o_orderkey%79=0 then 'All' when o_orderkey%23=0 then 'Risk 3 (Low)' when c_custkey%3=0 then 'Risk 1 (High)' when c_custkey%3=1 then 'Risk 2 (Medium)' else 'Risk 3 (Low)' end risk,
 case when o_orderkey%53=0 then null when o_orderkey%67=0 then 'ALT ' || cast(c_custkey%400 as string) || ' W MAIN ST' else cast(c_custkey%400 as string)||' W Main St' end address,
 case when o_orderkey%59=0 then null when o_orderkey%31=0 then 60700+c_nationkey else 60600+c_custkey%400%40 end zip,
 {date} inspection_date,
 case when o_orderkey%71=0 then null else 'Canvass' end inspection_type,
 case when o_orderkey%19=0 then 'Out of Business' when o_orderkey%37=0 then 'No Entry' when o_orderkey%41=0 then 'Not Ready' when o_orderkey%43=0 then 'Business Not Located' when o_orderstatus='F' then 'Fail' when o_orderstatus='P' then 'Pass' else 'Pass w/ Conditions' end results,
 v violations,
 case when o_orderkey%61=0 then null else cast(41.5 as double)+(c_custkey%400)/cast(1024 as double) + case when o_orderkey%7=2 then cast(0.03125 as double) else cast(0 as double) end end latitude,
 case when o_orderkey%61=0 then null else cast(-87.75 as double)+(c_custkey%400)/cast(2048 as double) end longitude"""
_CLAUSE = "lpad(cast(l_linenumber*3 + p_size%5 as string),2,'0')||'. '||upper(p_type)||' ITEM - Comments: QTY '||cast(cast(l_quantity as int) as string)||' FOUND', ' | '"
_ORDER = "order by l_linenumber, l_partkey, l_suppkey, l_quantity"

#: CTEs vio and insp for DuckDB.
INSP_SQL = f"""vio as materialized (select l_orderkey, string_agg({_CLAUSE} {_ORDER}) v from lineitem join part on l_partkey=p_partkey where l_returnflag='R' group by 1),
insp as materialized (select {_COLUMNS.format(date="strftime(o_orderdate,'%m/%d/%Y')")} from orders join customer on o_custkey=c_custkey left join vio on l_orderkey=o_orderkey)"""

_SPARK = f"""with vio as (select l_orderkey, listagg({_CLAUSE}) within group ({_ORDER}) v from {{lineitem}} join {{part}} on l_partkey=p_partkey where l_returnflag='R' group by 1)
select {_COLUMNS.replace("{date}", "date_format(o_orderdate,'MM/dd/yyyy')")} from {{orders}} join {{customer}} on o_custkey=c_custkey left join vio on l_orderkey=o_orderkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK, **{t: table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer")})
