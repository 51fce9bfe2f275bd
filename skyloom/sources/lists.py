"""Loading of target lists, pointing lists, proposal tables and id lists from text files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.functions import parsing
from skyloom.operators.ordered import join_back, rank_rows
from skyloom.schema import FILTER_NAMES, POINTING_REQUIRED, POINTING_TYPES
from skyloom.session import stage
from skyloom.sources.textfiles import has, read_lines, records, tables

_INTEGERS = ["obj_id", "priority"]
_INTEGERS_OR_NONE = ["tract", "patch"]
_TEXTS = ["ob_code", "resolution", "equinox", "comment"]
_OPTIONAL_TEXTS = ["reference_arm"]
_NUMBERS = ["ra", "dec", "exptime", "pmra", "pmdec", "parallax"]
TARGET_COLUMNS = [
    "obj_id", "ob_code", "ra", "dec", "priority", "exptime", "resolution", "reference_arm",
    "pmra", "pmdec", "parallax", "tract", "patch",
]
KNOWN = set(_INTEGERS + _INTEGERS_OR_NONE + _TEXTS + _OPTIONAL_TEXTS + _NUMBERS) | {
    c for n in FILTER_NAMES for c in (n, f"{n}_error")
}
FORMATS = ["csv", "ecsv"]


def _extension(path: Column) -> Column:
    """Format that a name tells. A folder of parts, one list as Spark wrote it, holds ECSV."""
    told = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(path.rlike(r"/[^/=]+=[^/]+$"), "ecsv").otherwise(told)


def _declared_error(names: Sequence[str]) -> Column:
    """The first cell of a row that is not of the type its ECSV header declares; empty cells are of any type.

    Columns of whole numbers may not be declared as floats either: their numbers would carry a fraction.
    """
    whole = F.array(*[F.lit(n in _INTEGERS + _INTEGERS_OR_NONE) for n in names])

    def error(text: Column, i: Column) -> Column:
        kind = F.get("_kinds", i)
        wrong = F.when(kind.rlike("^u?int") & ~text.rlike(r"^\s*[+-]?\d+\s*$"), "an integer")
        wrong = wrong.when(kind.startswith("float") & F.get(whole, i), "an integer")
        wrong = wrong.when(kind.startswith("float") & F.trim(text).try_cast("double").isNull(), "a number")
        wrong = wrong.when((kind == "bool") & ~F.trim(text).isin("True", "False"), "True or False")
        return F.when(F.trim(text) != "", F.concat(F.lit("declared "), kind, F.lit(", not "), wrong, F.lit(": "), text))

    found = F.filter(F.transform("_cells", error), lambda e: e.isNotNull())
    return F.when(F.col("_kinds").isNotNull(), F.get(found, F.lit(0)))


def _typed(lines: DataFrame, list_col: str, parsers: dict[str, Callable[[Column], tuple[Column, Column]]]) -> DataFrame:
    """Apply parsers to the cells of each named column; ``_error`` is the first failure of a row.

    Records are cut into cells, parsed once and stored: the report and the rows are both made from the values.
    """
    rows = tables(records(lines), names=list(parsers)).withColumnRenamed("path", list_col)
    parsed = {name: parse(F.try_element_at("values", F.col("_at")[i])) for i, (name, parse) in enumerate(parsers.items())}
    there = {name: F.col("_at")[i] > 0 for i, name in enumerate(parsers)}
    values = {name: F.when(there[name], value) for name, (value, _) in parsed.items()}
    unclosed = F.when(F.col("_unclosed"), "a quote is not closed")
    failures = [unclosed, _declared_error(list(parsers)), *[F.when(there[name], error) for name, (_, error) in parsed.items()]]
    typed = rows.withColumns({**values, "_error": F.coalesce(*failures)}).drop("_at", "_kinds", "_cells", "_unclosed")
    return stage(typed, "typed")[0]


def _report(rows: DataFrame, lines: DataFrame, list_col: str) -> DataFrame:
    """Status and first error per file; files of another format are refused."""
    # numbers first and the text of one row per file after that: with texts in the aggregate Spark would sort all rows
    wrong = F.col("_error").isNotNull()
    counted = rows.groupBy(list_col).agg(
        F.min(F.when(wrong, F.col("row_id"))).alias("_first"), F.count_if(wrong).alias("n_errors"), F.count(F.lit(1)).alias("n_rows")
    )
    at = [list_col, "_first"]
    bad = rows.where(wrong).select(list_col, F.col("row_id").alias("_first"), "_error")
    first = bad.join(counted.select(*at), at, "left_semi").groupBy(*at).agg(F.min("_error").alias("error"))
    failed = join_back(counted, first, at)
    files = lines.select(F.col("path").alias(list_col)).distinct().withColumn("format", _extension(F.col(list_col)))
    known = F.col("format").isin(FORMATS)
    return files.join(failed, list_col, "left").select(
        list_col,
        (known & (F.coalesce("n_errors", F.lit(0)) == 0)).alias("status"),
        F.when(~known, "neither CSV nor ECSV").otherwise(F.col("error")).alias("error"),
        F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
    )


def load_targets(
    spark: SparkSession, paths: str | Sequence[str], list_col: str = "upload_id", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Target lists from CSV and ECSV files, one list per file: (targets, load report).

    Targets carry the file as ``list_col``, ``row_id`` in file order, the typed known columns (null where a
    file lacks one), the ``header`` of their file, which decides on the leftmost flux, and unknown columns in
    the map ``extras``. A list with any bad cell loads nothing; in an ECSV file that is also one which is not of the type
    that the header declares for its column. ``strict`` refuses empty ``tract`` and
    ``patch`` cells.
    """
    return parse_targets(read_lines(spark, paths), list_col, strict)


def parse_targets(lines: DataFrame, list_col: str = "upload_id", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`load_targets` for lines (``path``, ``row_id``, ``line``) from any source."""
    readable = lines.where(_extension(F.col("path")).isin(FORMATS))
    parsers = dict.fromkeys(_INTEGERS, parsing.strict_int)
    parsers |= dict.fromkeys(_TEXTS, parsing.plain_text)
    parsers |= dict.fromkeys(_OPTIONAL_TEXTS, parsing.text_or_missing)
    parsers |= dict.fromkeys(_NUMBERS, parsing.number)
    parsers |= dict.fromkeys(_INTEGERS_OR_NONE, partial(parsing.int_or_none, allow_empty=not strict))
    parsers |= {c: parsing.number for n in FILTER_NAMES for c in (n, f"{n}_error")}
    typed = _typed(readable, list_col, parsers).withColumn("priority", F.col("priority").cast("int"))
    extras = F.map_filter(
        F.map_from_arrays("header", F.slice(F.concat("values", F.array_repeat(F.lit(None).cast("string"), F.size("header"))), F.lit(1), F.size("header"))),
        lambda k, _: ~k.isin(sorted(KNOWN)),
    )
    report = _report(typed, lines, list_col)
    good = report.where("status").select(list_col)
    fluxes = [c for n in FILTER_NAMES for c in (n, f"{n}_error")]
    targets = typed.withColumn("extras", extras).join(good, list_col, "left_semi").select(
        list_col, "row_id", *TARGET_COLUMNS, *fluxes, "header", "extras"
    )
    return targets, report


def load_pointings(
    spark: SparkSession, paths: str | Sequence[str], list_col: str = "upload_id"
) -> tuple[DataFrame, DataFrame]:
    """Pointing lists with defaults filled in, and the load report with the missing columns."""
    return parse_pointings(read_lines(spark, paths), list_col)


def parse_pointings(lines: DataFrame, list_col: str = "upload_id") -> tuple[DataFrame, DataFrame]:
    """:func:`load_pointings` for lines (``path``, ``row_id``, ``line``) from any source."""
    readable = lines.where(_extension(F.col("path")).isin(FORMATS))
    parsers = {c: parsing.number if t.simpleString() == "double" else parsing.text_or_missing for c, t in POINTING_TYPES.items()}
    typed = _typed(readable, list_col, parsers)
    report = _report(typed, lines, list_col)
    columns = typed.groupBy(list_col).agg(F.max("header").alias("_header")).select(
        list_col, F.array_except(F.array(*[F.lit(c) for c in POINTING_REQUIRED]), "_header").alias("missing")
    )
    nothing = F.array().cast("array<string>")
    report = report.join(columns, list_col, "left").withColumn("missing", F.coalesce("missing", nothing)).withColumn(
        "status", F.col("status") & (F.size("missing") == 0)
    )
    good = typed.join(report.where("status").select(list_col), list_col, "left_semi")
    return pointing_defaults(good, [list_col]).select(list_col, "row_id", *POINTING_TYPES), report


def pointing_defaults(pointings: DataFrame, list_cols: Sequence[str]) -> DataFrame:
    """Defaults for absent columns: angle 0, priority 0 and ``Point_<row>`` counted from 0."""
    absent = {c: ~has(c) if "header" in pointings.columns else F.lit(c not in pointings.columns) for c in ("ppc_pa", "ppc_priority", "ppc_code")}
    for c, kind in (("ppc_pa", "double"), ("ppc_priority", "double"), ("ppc_code", "string")):
        if c not in pointings.columns:
            pointings = pointings.withColumn(c, F.lit(None).cast(kind))
    numbered = rank_rows(pointings, list_cols, [F.col("row_id")], "_no")
    return numbered.withColumns(
        {
            "ppc_pa": F.when(absent["ppc_pa"], 0.0).otherwise(F.col("ppc_pa")),
            "ppc_priority": F.when(absent["ppc_priority"], 0.0).otherwise(F.col("ppc_priority")),
            "ppc_code": F.when(absent["ppc_code"], F.concat(F.lit("Point_"), (F.col("_no") - 1).cast("string"))).otherwise(F.col("ppc_code")),
        }
    ).drop("_no")


def load_proposals(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Proposal information by ``Upload ID``."""
    schema = "`Upload ID` string, `proposal ID` string, `PI name` string, rank double"
    return spark.read.schema(schema).csv(paths, header=True, comment="#", enforceSchema=False)


def load_ids(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A list of upload ids from a CSV file with an ``upload_id`` column."""
    return spark.read.csv(paths, header=True).select(F.col("upload_id").cast("string"))
