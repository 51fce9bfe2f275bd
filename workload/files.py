"""Queries of the sources, sinks and parsers, and the same results in DuckDB SQL.

Texts are made from the orders by SQL that both engines read alike; files are written below the scratch folder and
loaded again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions import parsing
from skyloom.operators import checks, registry, reports
from skyloom.schema import NA_TEXTS
from skyloom.session import scratch_dir
from skyloom.sources import lists, snapshots, submissions
from skyloom.sources.textfiles import cell, records, tables
from workload.views import table

FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FILE_ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        FILE_QUERIES[f.__name__] = f
        FILE_ORACLES[f.__name__] = oracle
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf: str, *sql: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*sql)


# --- cells ---------------------------------------------------------------------------

CELL = """case o_orderkey % 11 when 0 then '' when 1 then 'None' when 2 then '3.0' when 3 then '99999999999999999999'
 when 4 then concat(' ', cast(o_orderkey as string), ' ') when 5 then 'nan' when 6 then 'abc' when 7 then '-12' when 8 then '1.5e3'
 when 9 then 'N/A' else cast(o_orderkey as string) end"""
_NA = ", ".join(f"'{t}'" for t in NA_TEXTS)


@query(f"""with c as (select o_orderkey, {CELL} as cell from orders),
i as (select *, case when regexp_full_match(trim(cell), '[+-]?[0-9]+') then try_cast(trim(cell) as bigint) end as whole,
 trim(cell) in ('', 'None') as nothing, trim(cell) in ({_NA}) as na from c)
select o_orderkey, whole as strict, whole is null as strict_bad, case when not nothing then whole end as loose,
 not nothing and whole is null as loose_bad, case when not na then try_cast(trim(cell) as double) end as number,
 not na and try_cast(trim(cell) as double) is null as number_bad, case when cell not in ({_NA}) then cell end as word from i""")
def parse_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Integers, integers or None, numbers and texts from cells of every kind."""
    rows = _orders(spark, sf, "o_orderkey", f"{CELL} as cell")
    c = F.col("cell")
    out = {"strict": parsing.strict_int(c), "loose": parsing.int_or_none(c), "number": parsing.number(c)}
    return rows.select(
        "o_orderkey", *[v.alias(k) for k, (v, _) in out.items()],
        *[e.isNotNull().alias(f"{k}_bad") for k, (_, e) in out.items()], parsing.text_or_missing(c)[0].alias("word"),
    )


# --- lines ---------------------------------------------------------------------------

# seven files; the last has another format
PATH = "concat('/in/f', cast(o_orderkey % 7 as string), case when o_orderkey % 7 = 6 then '.txt' else '.csv' end)"
WORD = "concat(o_orderpriority, '#\"')"
QUOTES = '"' * 3  # an escaped quote and the closing one
ROW = f"""concat(cast(o_orderkey as string), ',"', o_orderpriority, '#{QUOTES},', cast(o_custkey as string),
 case when o_orderkey % 5 = 0 then ' # a note' else '' end)"""


def _with_head(spark: SparkSession, body: DataFrame, head: list[str]) -> DataFrame:
    heads = body.select("path").distinct().select("path", F.posexplode(F.array(*map(F.lit, head))).alias("_at", "line"))
    lines = heads.select("path", (F.col("_at") - 1000).cast("bigint").alias("row_id"), "line").unionByName(body.select("path", "row_id", "line"))
    return lines.withColumn("file_size", F.lit(0).cast("bigint"))


# a note in one to four lines; those after the first have a quote or a # inside, and the last a comment with a quote
NOTE_LINES = [
    "concat(cast(o_orderkey as string), ',\"', o_orderpriority)", "concat('\"\"# ', cast(o_custkey as string))", "''",
    "concat('end\",', cast(o_custkey as string), ' # a \" more')",
]


@query("""select concat('/in/f', o_orderkey % 7, '.csv') as path, o_orderkey * 64 as row_id, cast(o_orderkey as varchar) as key,
 o_orderpriority || case o_orderkey % 4 when 0 then '' when 1 then chr(10) || '"# ' || o_custkey when 2 then chr(10) || '"# ' || o_custkey || chr(10) else chr(10) end
 || chr(10) || 'end' as note, cast(o_custkey as varchar) || ' ' as last, false as unclosed from orders
union all select concat('/in/f', f, '.csv'), 1::bigint << 40, '0', '"not closed', null, true from range(7) t(f)""")
def multiline_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted cells over up to four lines, in files whose last quote is not closed."""
    parts = [F.struct(F.lit(i).alias("i"), F.expr(text).alias("line")) for i, text in enumerate(NOTE_LINES)]
    # which of the lines a note has
    chosen = F.array(*[F.array(*map(F.lit, c)) for c in ([0, 3], [0, 1, 3], [0, 1, 2, 3], [0, 2, 3])])
    rows = _orders(spark, sf, "o_orderkey", "o_custkey", "o_orderpriority", "concat('/in/f', cast(o_orderkey % 7 as string), '.csv') as path")
    some = F.element_at(chosen, (F.col("o_orderkey") % 4 + 1).cast("int"))
    body = rows.withColumn("_p", F.explode(F.filter(F.array(*parts), lambda p: F.array_contains(some, p["i"])))).select(
        "path", (F.col("o_orderkey") * 64 + F.col("_p.i")).alias("row_id"), F.col("_p.line").alias("line")
    )
    ends = body.select("path").distinct().withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "path", (F.lit(1 << 40) + F.col("_p")).alias("row_id"), F.when(F.col("_p") == 0, '0,"not closed').otherwise("1,2").alias("line")
    )
    table_of = tables(records(_with_head(spark, body.unionByName(ends), ["key,note,last"])))
    return table_of.select("path", "row_id", cell("key").alias("key"), cell("note").alias("note"), cell("last").alias("last"), F.col("_unclosed").alias("unclosed"))


@query(f"""select {PATH} as path, o_orderkey as row_id, cast(o_orderkey as varchar) as key, {WORD} as word, cast(null as varchar) as absent,
 cast(3 as integer) as n_cells from orders where o_orderkey % 13 <> 0""")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of CSV lines with quotes, comments, blank lines and comment lines."""
    body = _orders(spark, sf, f"{PATH} as path", "o_orderkey as row_id", f"case when o_orderkey % 13 = 0 then '# nothing' else {ROW} end as line")
    rows = tables(_with_head(spark, body, ["# a comment", "", "key, word ,number # header"]))
    return rows.select("path", "row_id", cell("key").alias("key"), cell("word").alias("word"), cell("absent").alias("absent"), F.size("values").alias("n_cells"))


TARGET = """concat(case when o_orderkey % 1000 = 1 and o_orderkey % 7 < 3 then '3.0' else cast(o_orderkey as string) end, ',ob_', cast(o_orderkey as string), ',',
 cast(o_orderkey % 360 as string), ',', cast(o_orderkey % 90 as string), ',', case when o_orderkey % 1500 = 7 and o_orderkey % 7 = 1 then 'abc' else '900.0' end, ',',
 cast(o_orderkey % 10 as string), ',', case when o_orderkey % 2 = 0 then 'L' else 'M' end, ',', case when o_orderkey % 4 = 0 then 'None' else cast(o_orderkey as string) end)"""
TARGET_HEAD = ["obj_id,ob_code,ra,dec,exptime,priority,resolution,tract"]
_BAD = """with o as (select *, {path} as path, o_orderkey % 1000 = 1 and o_orderkey % 7 < 3 as bad_id,
 o_orderkey % 1500 = 7 and o_orderkey % 7 = 1 as bad_time from orders),
report as (select path, path not like '%.txt' and not bool_or(bad_id or bad_time) as status,
 case when path like '%.txt' then 'neither CSV nor ECSV' when bool_or(bad_id or bad_time)
  then arg_min(case when bad_id then 'not an integer: 3.0' else 'not a number: abc' end, o_orderkey) filter (bad_id or bad_time) end as error,
 case when path like '%.txt' then 0 else count(*) filter (bad_id or bad_time) end as n_errors, case when path like '%.txt' then 0 else count(*) end as n_rows
 from o group by path)""".format(path=PATH)


def _target_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _with_head(spark, _orders(spark, sf, f"{PATH} as path", "o_orderkey as row_id", f"{TARGET} as line"), TARGET_HEAD)


@query(_BAD + " select path as upload_id, status, error, n_errors, n_rows from report")
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """Status, first error and counts of each list, files of another format included."""
    return lists.parse_targets(_target_lines(spark, sf))[1]


@query(_BAD + """ select path as upload_id, o_orderkey as row_id, o_orderkey as obj_id, 'ob_' || o_orderkey as ob_code, cast(o_orderkey % 360 as double) as ra,
 cast(o_orderkey % 90 as double) as dec, 900e0 as exptime, cast(o_orderkey % 10 as integer) as priority, case when o_orderkey % 2 = 0 then 'L' else 'M' end as resolution,
 case when o_orderkey % 4 <> 0 then o_orderkey end as tract, cast(null as varchar) as reference_arm from o join report using (path) where status""")
def parse_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Typed targets of the lists without a bad cell."""
    targets, _ = lists.parse_targets(_target_lines(spark, sf))
    return targets.select("upload_id", "row_id", "obj_id", "ob_code", "ra", "dec", "exptime", "priority", "resolution", "tract", "reference_arm")


@query("""with o as (select o_orderkey as k, o_orderkey % 6 as f from orders),
e as (select k, f, case when f in (2, 3) and k % 7 = 1 then 'declared int64, not an integer: 900.5' when f in (4, 5) then 'declared float64, not an integer: ' || k end as error from o)
select '/in/e' || f || '.ecsv' as upload_id, count(error) = 0 as status, arg_min(error, k) as error, count(error) as n_errors, count(*) as n_rows,
 case when count(error) = 0 then count(*) else 0 end as n_loaded, cast(case when count(error) = 0 then sum(k) end as bigint) as id_sum from e group by f""")
def ecsv_types(spark: SparkSession, sf: str) -> DataFrame:
    """ECSV files with commas and with blanks, whose headers declare types that some cells do not have."""
    rows = _orders(spark, sf, "o_orderkey as k", "o_orderkey % 6 as f")
    def joined(*parts):
        return F.when(F.col("f") % 2 == 0, F.concat_ws(",", *parts)).otherwise(F.concat_ws(" ", *parts))

    path = F.concat(F.lit("/in/e"), "f", F.lit(".ecsv")).alias("path")
    time = F.when(F.col("f").isin(2, 3) & (F.col("k") % 7 == 1), "900.5").otherwise("900")
    body = rows.select(path, F.col("k").alias("row_id"), joined("k", F.lit('"a, b"'), F.lit("1.5"), time).alias("line"))
    names = [("obj_id", F.when(F.col("f") < 4, "int64").otherwise("float64")), ("ob_code", F.lit("string")), ("ra", F.lit("float32")), ("exptime", F.lit("int64"))]
    head = F.array(
        F.lit("# %ECSV 1.0"), F.when(F.col("f") % 2 == 0, "# delimiter: ','").otherwise("# ---"),
        *[F.concat(F.lit(f"# - {{name: {n}, datatype: "), kind, F.lit("}")) for n, kind in names],
        joined(*[F.lit(n) for n, _ in names]),
    )
    heads = rows.select("f").distinct().select(path, F.posexplode(head).alias("_at", "line")).select("path", (F.col("_at") - 1000).cast("bigint").alias("row_id"), "line")
    targets, report = lists.parse_targets(heads.unionByName(body).withColumn("file_size", F.lit(0).cast("bigint")))
    loaded = targets.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n_loaded"), F.sum("obj_id").alias("id_sum"))
    return report.join(loaded, "upload_id", "left").fillna(0, ["n_loaded"])


@query(f"""with o as (select *, {PATH} as path from orders)
select path as upload_id, o_orderkey as row_id, 'Point_' || (row_number() over (partition by path order by o_orderkey) - 1) as ppc_code,
 cast(o_orderkey % 360 as double) as ppc_ra, cast(o_orderkey % 90 as double) as ppc_dec, 0e0 as ppc_pa, 'L' as ppc_resolution, 0e0 as ppc_priority
from o where path not like '%.txt'""")
def parse_pointings(spark: SparkSession, sf: str) -> DataFrame:
    """Pointing lists without codes, angles and priorities: the defaults stand in."""
    body = _orders(spark, sf, f"{PATH} as path", "o_orderkey as row_id", "concat(cast(o_orderkey % 360 as string), ',', cast(o_orderkey % 90 as string), ',L') as line")
    return lists.parse_pointings(_with_head(spark, body, ["ppc_ra,ppc_dec,ppc_resolution"]))[0]


@query("""select cast(o_orderkey as varchar) as path, o_orderpriority || '.csv' as original_filename, 'u' || o_orderkey as upload_id,
 case when o_orderkey % 3 <> 0 then '900' end as single_exptime from orders""")
def header_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of ECSV headers: plain, quoted and null values, unknown keys."""
    lines = _orders(spark, sf, """cast(o_orderkey as string) as path""", """explode(array('# %ECSV 1.0', concat('# - {original_filename: ', o_orderpriority, '.csv}'),
     concat("# - {upload_id: 'u", o_orderkey, "'}"), concat('# - {single_exptime: ', if(o_orderkey % 3 = 0, 'null', '900'), '}'), '# - {other: 1}', 'a,b')) as line""")
    return submissions.header_metadata(lines).select("path", "original_filename", "upload_id", "single_exptime")


# --- what is written -----------------------------------------------------------------

SUBMITTED = "concat('u', cast(o_custkey % 50 as string))"


QUOTED = "'" + '"a ""b"" c"' + "'"


@query(f"""select {SUBMITTED} as upload_id, o_orderkey as line_no, o_orderkey || ',' || case when o_orderkey % 3 = 0 then {QUOTED} else 'c' end || ',' ||
 case when o_orderkey % 4 = 0 then '' else '2.5' end as value from orders
union all select u, n, v from (select distinct {SUBMITTED} as u from orders), (values (-1000000, '# %ECSV 1.0'), (-999999, '# ---'), (-999998, '# delimiter: '','''),
 (-999997, '# datatype:'), (-999996, '# - {{name: ''key'', datatype: int64}}'), (-999995, '# - {{name: ''word'', datatype: string}}'),
 (-999994, '# - {{name: ''size'', datatype: float64}}'), (-999993, '# schema: astropy-2.0'), (-999992, 'key,word,size')) as h(n, v)""")
def ecsv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one ECSV file per list."""
    rows = _orders(spark, sf, f"{SUBMITTED} as upload_id", "o_orderkey as row_id", "o_orderkey as key", "if(o_orderkey % 3 = 0, 'a \"b\" c', 'c') as word", "if(o_orderkey % 4 = 0, null, 2.5D) as size")
    return submissions.ecsv_lines(rows)


@query(f"select {SUBMITTED} as upload_id, o_orderkey, 'o' || o_orderkey as word from orders")
def ecsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Lists written as ECSV in parts and loaded again."""
    rows = _orders(spark, sf, f"{SUBMITTED} as upload_id", "o_orderkey as row_id", "o_orderkey as obj_id", "concat('o', o_orderkey) as ob_code")
    folder = _folder(spark)
    submissions.write_ecsv(submissions.ecsv_lines(rows), folder)
    targets, _ = lists.load_targets(spark, f"{folder}/upload_id=*")
    return targets.select(F.regexp_extract("upload_id", "=(.*)$", 1).alias("upload_id"), F.col("obj_id").alias("o_orderkey"), F.col("ob_code").alias("word"))


@query(f"""select {SUBMITTED} as upload_id, o_orderkey as ppc_code, o_totalprice as ppc_priority from orders where o_custkey % 50 < 40
union all select distinct {SUBMITTED}, cast(null as bigint), -1e0 from orders where o_custkey % 50 >= 40""")
def placeholder_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An empty pointing for every list without one."""
    every = _orders(spark, sf, f"{SUBMITTED} as upload_id")
    some = table(spark, sf, "orders").where("o_custkey % 50 < 40").selectExpr(f"{SUBMITTED} as upload_id", "o_orderkey as ppc_code", "o_totalprice as ppc_priority")
    return submissions.placeholder_rows(every, some, "ppc")


MONTHS = f"""with s as (select distinct {SUBMITTED} as upload_id, cast(o_custkey % 50 as integer) as k from orders)"""
_STAMP = dt.datetime(2024, 1, 15)


def _submissions(spark: SparkSession, sf: str, more: str = "true") -> DataFrame:
    rows = table(spark, sf, "orders").where(more).selectExpr(f"{SUBMITTED} as upload_id", "cast(o_custkey % 50 as int) as k").distinct()
    return rows.withColumn("upload_at", F.lit(_STAMP) + F.make_interval(F.lit(0), F.col("k") % 5))


@query(MONTHS + f""" select upload_id, o_orderkey as n, 2024 as year, k % 5 + 1 as month from s join (select {SUBMITTED} as upload_id, o_orderkey from orders) using (upload_id)""")
def save_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions saved by month, some of them twice, and read again: each is there once."""
    rows = _orders(spark, sf, f"{SUBMITTED} as upload_id", "o_orderkey as n")
    folder = _folder(spark)
    submissions.save_submissions({"rows": rows}, _submissions(spark, sf), folder)
    again = _submissions(spark, sf, "o_custkey % 50 < 9")
    submissions.save_submissions({"rows": rows.join(again, "upload_id", "left_semi")}, again, folder)
    return spark.read.parquet(f"{folder}/rows")


@query(MONTHS + " select upload_id, case when k % 4 = 0 then 2 else 1 end as version, 2024 as year, k % 5 + 1 as month from s")
def save_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Allocations of all lists, then new ones of a fourth of them: the others keep theirs."""
    rows = _submissions(spark, sf).select("upload_id", "k", F.year("upload_at").alias("year"), F.month("upload_at").alias("month"))
    folder = _folder(spark)
    for version, part in ((1, rows), (2, rows.where("k % 4 = 0"))):
        kept = part.select("upload_id", F.lit(version).alias("version"), "year", "month")
        submissions.save_allocation(kept, kept, folder)
    return spark.read.parquet(f"{folder}/tac_ppc")


MOVED = "case when k < 9 then (k + 1) % 5 + 1 else k % 5 + 1 end"


def _store(spark: SparkSession, sf: str) -> str:
    """A store with two versions: all submissions, then some of them again, a month later and without their even rows."""
    rows = _orders(spark, sf, f"{SUBMITTED} as upload_id", "o_orderkey as n")
    folder = _folder(spark)
    submissions.save_submissions({"rows": rows}, _submissions(spark, sf), folder, versioned=True)
    again = _submissions(spark, sf, "o_custkey % 50 < 9").withColumn("upload_at", F.lit(_STAMP) + F.make_interval(F.lit(0), (F.col("k") + 1) % 5))
    submissions.save_submissions({"rows": rows.where("n % 2 = 1").join(again, "upload_id", "left_semi")}, again, folder, versioned=True)
    return folder


@query(MONTHS + f""", r as (select {SUBMITTED} as upload_id, o_orderkey as n from orders)
select 2 as version, upload_id, n, 2024 as year, {MOVED} as month from s join r using (upload_id) where k >= 9 or n % 2 = 1
union all select 1, upload_id, n, 2024, k % 5 + 1 from s join r using (upload_id)""")
def snapshot_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A table of submissions as of two versions; those sent again have moved and lost rows in the second."""
    folder = _store(spark, sf)
    old, new = (snapshots.read(spark, folder, "rows", v).withColumn("version", F.lit(v)) for v in (1, 2))
    return new.unionByName(old).select("version", "upload_id", "n", "year", "month")


@query(MONTHS + f""" select upload_id, n, {MOVED} as month from s join (select {SUBMITTED} as upload_id, o_orderkey as n from orders) using (upload_id)
where upload_id in ('u3', 'u8', 'u41') and (k >= 9 or n % 2 = 1)""")
def snapshot_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three submissions through the index of ids."""
    return snapshots.of_ids(spark, _store(spark, sf), "rows", ["u3", "u8", "u41", "absent"]).select("upload_id", "n", "month")


@query(f"select {SUBMITTED} as upload_id, o_orderkey as n from orders where o_custkey % 50 < 10")
def export_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of chosen submissions written apart; ids without rows and null ids are skipped."""
    rows = _orders(spark, sf, f"{SUBMITTED} as upload_id", "o_orderkey as n")
    chosen = table(spark, sf, "customer").selectExpr("if(c_custkey % 60 = 59, null, concat('u', c_custkey % 60)) as upload_id", "c_custkey % 60 as k").where("k < 10 or k >= 50")
    folder = _folder(spark)
    submissions.export_selected(rows, chosen, f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


@query("select 'c' || (c_custkey % 100) as upload_id, count(*) as n from customer group by 1")
def registry_append(spark: SparkSession, sf: str) -> DataFrame:
    """Ids from a CSV file put into a new registry, repeats included."""
    folder = _folder(spark)
    ids = table(spark, sf, "customer").selectExpr("concat('c', c_custkey % 100) as upload_id", "c_name")
    ids.write.csv(f"{folder}/ids", header=True)
    registry.create(spark, f"{folder}/registry")
    registry.append(lists.load_ids(spark, f"{folder}/ids"), f"{folder}/registry")
    return spark.read.parquet(f"{folder}/registry").groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct 'c' || (c_custkey % 100) as upload_id, 'p' || (c_custkey % 100) as proposal, 'PI, ' || (c_custkey % 100) as pi, (c_custkey % 100) / 4e0 as rank from customer")
def load_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """A table of proposals from CSV with quoted cells."""
    folder = _folder(spark)
    rows = table(spark, sf, "customer").selectExpr("c_custkey % 100 as k").distinct().selectExpr(
        "concat('c', k) as `Upload ID`", "concat('p', k) as `proposal ID`", "concat('PI, ', k) as `PI name`", "k / 4D as rank"
    )
    rows.write.csv(f"{folder}/proposals", header=True)
    return lists.load_proposals(spark, f"{folder}/proposals").toDF("upload_id", "proposal", "pi", "rank")


# --- small filters -------------------------------------------------------------------


@query("select o_orderkey, o_totalprice as tel_fiber_usage_frac from orders where o_orderkey % 3 = 0")
def drop_empty_pointings(spark: SparkSession, sf: str) -> DataFrame:
    """Pointings without a target go."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "case o_orderkey % 3 when 0 then o_totalprice when 1 then 0D end as tel_fiber_usage_frac")
    return reports.drop_empty_pointings(rows)


@query("select o_orderkey, o_totalprice as flux_g from orders")
def drop_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that are null in every row go."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice as flux_g", "cast(null as double) as flux_r")
    return checks.drop_empty_columns(rows)


@query("select o_orderkey, coalesce(o_orderkey % 3 = 0, false) as ok from orders where o_orderkey % 2 = 0")
def date_order(spark: SparkSession, sf: str) -> DataFrame:
    """Visible rows, and whether their first date precedes the last."""
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 2 = 0 as ok_visible", "date'2026-02-01' as a",
        "case o_orderkey % 3 when 0 then date'2026-02-02' when 1 then date'2026-01-31' else date'2026-02-01' end as b",
    )
    return checks.visible_only(rows).select("o_orderkey", checks.date_order_ok("a", "b").alias("ok"))
