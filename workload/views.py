"""Survey-target tables derived from the given tables. The same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.operators.ordered import TASK_ROWS

BASE = {"targets": "orders", "pointings": "supplier", "allocations": "lineitem", "registry": "events"}

SQL = {
    "targets": """
select o_orderkey as row_id, o_orderkey as obj_id,
 concat('ob_', lpad(cast(o_orderkey as varchar(20)), 8, '0')) as ob_code,
 cast(5 + 18*(o_custkey % 20) as double) + cast((o_orderkey*7919) % 2000 as double)/1e3 - 1e0 as ra,
 cast(5*(o_custkey % 20) - 30 as double) + cast((o_orderkey*104729) % 2000 as double)/1e3 - 1e0 as dec,
 cast(900*(1 + o_orderkey % 4) - 100*(o_orderkey % 3) as double) as exptime,
 cast((13*o_orderkey + o_custkey) % 10 as int) as priority,
 case o_orderstatus when 'F' then 'L' when 'O' then 'M' when 'P' then case when o_orderkey % 2 = 0 then 'L' else 'M' end end as resolution,
 case when o_orderkey % 3 = 0 then 'b' when o_orderkey % 3 = 1 then 'n' when o_orderstatus = 'F' or (o_orderstatus='P' and o_orderkey % 2 = 0) then 'r' else 'm' end as reference_arm,
 case when o_orderkey % 5 <> 0 then o_totalprice end as g_hsc,
 case when o_orderkey % 10 = 1 then o_totalprice*1e-2 end as g_hsc_error,
 case when o_orderkey % 3 = 0 then o_totalprice*2e0 end as g_ps1,
 case when o_orderkey % 7 = 0 then o_totalprice*3e0 end as r2_hsc,
 case when o_orderkey % 35 = 0 then o_totalprice*4e0 end as i2_hsc,
 o_orderdate as submitted_at, cast(o_custkey % 10 as int) as list_no
from {orders}""",
    "targets_dirty": """
select row_id, case when row_id % 101 = 1 then obj_id - 1 else obj_id end as obj_id,
 case when row_id % 97 = 1 then concat('bad code ', cast(row_id as varchar(20))) when row_id % 89 = 1 then 'ob_dup' else ob_code end as ob_code,
 case when row_id % 83 = 1 then ra + 36e1 when row_id % 79 = 1 then null else ra end as ra,
 case when row_id % 73 = 1 then -9.1e1 else dec end as dec,
 case when row_id % 71 = 1 then 0e0 else exptime end as exptime,
 case when row_id % 67 = 1 then 10 else priority end as priority,
 case when row_id % 61 = 1 then 'H' when row_id % 101 = 1 then 'L' when row_id % 101 = 0 then 'L' else resolution end as resolution,
 case when row_id % 59 = 1 then 'm' when row_id % 53 = 1 then 'x' else reference_arm end as reference_arm,
 g_hsc, g_ps1, r2_hsc, list_no
from {targets}""",
    "pointings": """
select s_suppkey as ppc_no, concat('Point_', cast(s_suppkey as varchar(20))) as ppc_code,
 cast(5 + 18*(s_suppkey % 20) as double) + cast((s_suppkey*37) % 100 as double)/1e2 - 5e-1 as ppc_ra,
 cast(5*(s_suppkey % 20) - 30 as double) + cast((s_suppkey*61) % 100 as double)/1e2 - 5e-1 as ppc_dec,
 cast((s_suppkey*15) % 60 as double) as ppc_pa, case when s_suppkey % 2 = 0 then 'L' else 'M' end as ppc_resolution
from {supplier}""",
    "allocations": """
select distinct concat('Point_', cast(l_suppkey as varchar(20))) as ppc_code, concat('ob_', lpad(cast(l_orderkey as varchar(20)), 8, '0')) as ob_code from {lineitem}""",
    "registry": """
select substring(md5(cast(case when event_id % 50 = 49 then event_id - 1 else event_id end as varchar(20))), 1, 16) as upload_id, ts as upload_at, user_id from {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a table in fewer pieces than there are cores is spread out once; a large one is left as it is
    cores = spark.sparkContext.defaultParallelism
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _pieces:
        files = len(df.inputFiles())
        _pieces[key] = files if files >= cores else df.rdd.getNumPartitions()
    return df.repartition(cores) if _pieces[key] < cores else df


_pieces: dict[tuple[str, str, str], int] = {}
_rows: dict[tuple[str, str, str], int] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables as a DataFrame."""
    if name == "targets_dirty":
        return spark.sql(SQL[name], targets=view(spark, sf_dir, "targets"))
    base = BASE[name]
    rows = table(spark, sf_dir, base)
    if name == "allocations":
        rows = _in_small_pieces(spark, sf_dir, base, rows, "l_orderkey", "l_suppkey")
    return spark.sql(SQL[name], **{base: rows})


def _in_small_pieces(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Pieces of a file are bounded in bytes, of which two keys take few: the hash tables that find copies would hold
    millions of rows. Such a table is dealt by key, copies together."""
    cores = spark.sparkContext.defaultParallelism
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if _pieces[key] < cores:
        return rows  # table() has dealt it already
    if key not in _rows:
        _rows[key] = rows.count()  # from the ends of the files
    pieces = -(-_rows[key] // TASK_ROWS)
    return rows.repartition(pieces, *keys) if pieces > _pieces[key] else rows


def cte(*names: str) -> str:
    """``with`` clause that defines the named tables in DuckDB."""
    wanted = list(names)
    if "targets_dirty" in wanted and "targets" not in wanted:
        wanted.insert(0, "targets")
    order = [n for n in SQL if n in wanted]
    texts = []
    for n in order:
        base = "targets" if n == "targets_dirty" else BASE[n]
        texts.append(f"{n} as ({SQL[n].replace('{' + base + '}', base)})")
    return "with " + ",\n".join(texts)
