"""The validation of target lists: columns, strings, values, then flux, visibility and uniqueness.

A list stops at the first failing stage of columns, strings and values; later flags of that list are null.
All lists share one plan, so that stopping is a mask per list and not a branch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.operators.checks import (
    VALUE_COLUMNS,
    date_order_ok,
    keep_registered,
    string_flags,
    unique_flags,
    value_flags,
    with_column_check,
)
from skyloom.operators.flux import resolve_flux, used_filters
from skyloom.operators.ordered import join_back
from skyloom.operators.visibility import visibility_flags
from skyloom.schema import LIST_COLS, PIXEL_NSIDE, REQUIRED, SINGLE_EXPTIME
from skyloom.session import stage

LATE_FLAGS = ["ok_flux", "ok_visible", "ok_code", "ok_pair", "ok_unique"]
VALUE_FLAGS = [f"ok_{c}" for c in VALUE_COLUMNS] + ["ok_values"]


@dataclass
class Validation:
    """``rows`` with flags, ``status`` (one row per list) and ``report`` (one row per list and check)."""

    rows: DataFrame
    status: DataFrame
    report: DataFrame

    def cleaned(self, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
        """Rows with the registered columns only."""
        return keep_registered(self.rows, [*list_cols, "row_id"])


def flag_rows(
    targets: DataFrame,
    date_begin,
    date_end,
    list_cols: Sequence[str] = LIST_COLS,
    header: str | None = None,
    single_exptime: float = SINGLE_EXPTIME,
    grouping: str = "pixel",
    nside: int = PIXEL_NSIDE,
    calendar: str = "all",
    arm_scope: str = "row",
) -> DataFrame:
    """All row flags, whatever the stage a list reaches."""
    checked = value_flags(string_flags(targets), list_cols, arm_scope)
    resolved = resolve_flux(checked, header)
    seen = visibility_flags(
        resolved, date_begin, date_end, list_cols, grouping, single_exptime, nside, calendar, source=targets
    )
    return unique_flags(seen, list_cols, source=targets)


def list_results(
    flagged: DataFrame, header: Column, list_cols: Sequence[str] = LIST_COLS, lists: DataFrame | None = None,
    dates_ok: Column | None = None,
) -> DataFrame:
    """One row per list: status of every stage (null if not reached), counts and the overall label.

    ``header`` gives the array of a list's column names as an aggregate. One pass over the rows yields
    everything. ``lists`` adds lists that have no row; they fail. ``dates_ok`` tells of each row whether the dates of its
    list are in order; a list whose dates are not fails by ``status_dates``.
    """
    in_order = F.coalesce(F.bool_and(F.lit(True) if dates_ok is None else dates_ok), F.lit(True))
    flags = ["ok_str", *VALUE_FLAGS, *LATE_FLAGS]
    aggs, names = used_filters() if "filter_g" in flagged.columns else ([], F.array().cast("array<string>"))
    counted = flagged.groupBy(*list_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        header.alias("header"),
        in_order.alias("status_dates"),
        *[F.count_if(~F.col(f)).alias(f"n_bad_{f.removeprefix('ok_')}") for f in flags],
        *aggs,
    ).withColumn("filters", names)
    if lists is not None:
        counted = lists.select(*list_cols, F.col("header").alias("_given")).join(counted, list(list_cols), "left").withColumn(
            "header", F.coalesce("header", "_given")
        )
    base = with_column_check(counted)
    have = F.coalesce(F.col("n_rows"), F.lit(0)) > 0

    def stage_status(reached: Column, ok: Column) -> Column:
        return F.when(reached, ok)

    def none_bad(name: str) -> Column:
        return F.coalesce(F.col(f"n_bad_{name}"), F.lit(0)) == 0

    out = base.withColumn("status_str", stage_status(F.col("required_ok"), none_bad("str")))
    out = out.withColumn("status_values", stage_status(F.col("status_str"), none_bad("values")))
    late = F.col("status_values")
    out = out.withColumns(
        {
            "status_flux": stage_status(late, none_bad("flux")),
            "status_visible": stage_status(late, have & (F.col("n_bad_visible") < F.col("n_rows"))),
            "status_unique": stage_status(late, have & none_bad("unique")),
        }
    )
    parts = ["status_str", "status_values", "status_flux", "status_visible", "status_unique"]
    out = out.withColumn("status_dates", F.coalesce("status_dates", F.lit(True)))
    overall = F.col("required_ok") & F.col("status_dates")
    for p in parts:
        overall = overall & F.coalesce(F.col(p), F.lit(False))
    return out.withColumn("status", overall).withColumn(
        "label",
        F.when(~F.col("status"), "failed")
        .when(F.col("optional_ok") & F.col("status_visible"), "success")
        .otherwise("success_with_warnings"),
    )


def mask_rows(flagged: DataFrame, results: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Null the flags of stages that a list did not reach."""
    reach = results.select(
        *list_cols,
        F.col("required_ok").alias("_str"),
        F.coalesce("status_str", F.lit(False)).alias("_values"),
        F.coalesce("status_values", F.lit(False)).alias("_late"),
    )
    rows = join_back(flagged, reach, list_cols)
    masks = {f: F.when(F.col("_values"), F.col(f)) for f in VALUE_FLAGS}
    masks |= {f: F.when(F.col("_late"), F.col(f)) for f in LATE_FLAGS}
    masks |= {f: F.when(F.col("_str"), F.col(f)) for f in flagged.columns if f.startswith("ok_str")}
    return rows.withColumns(masks).drop("_str", "_values", "_late")


def report_rows(results: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """The report in long form: check, severity (error, warning, info), status, n_bad and detail."""
    rows = results

    def entry(check: str, severity: Column, status: Column, n_bad: Column, detail: Column) -> Column:
        return F.when(
            status.isNotNull(),
            F.struct(
                F.lit(check).alias("check"),
                severity.alias("severity"),
                status.alias("status"),
                n_bad.cast("bigint").alias("n_bad"),
                detail.alias("detail"),
            ),
        )

    def plain(ok: Column) -> Column:
        return F.when(ok, "info").otherwise("error")

    bad_values = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(f"n_bad_{c}") > 0, F.lit(c)) for c in VALUE_COLUMNS])), ","
    )
    used = F.array_join(F.coalesce("filters", F.array().cast("array<string>")), ",")
    n_invisible = F.col("n_bad_visible")
    entries = F.array(
        entry("required_columns", plain(F.col("required_ok")), F.col("required_ok"), F.size("required_missing"), F.array_join("required_missing", ",")),
        entry(
            "optional_columns", F.when(F.col("optional_ok"), "info").otherwise("warning"), F.col("optional_ok"),
            F.size("optional_missing"), F.array_join("optional_missing", ","),
        ),
        entry("strings", plain(F.col("status_str")), F.col("status_str"), F.coalesce("n_bad_str", F.lit(0)), F.lit("")),
        entry("values", plain(F.col("status_values")), F.col("status_values"), F.coalesce("n_bad_values", F.lit(0)), bad_values),
        entry("flux", plain(F.col("status_flux")), F.col("status_flux"), F.coalesce("n_bad_flux", F.lit(0)), used),
        entry(
            "visibility",
            F.when(~F.col("status_visible"), "error").when(n_invisible > 0, "warning").otherwise("info"),
            F.col("status_visible"), F.coalesce(n_invisible, F.lit(0)), F.lit(""),
        ),
        entry("unique", plain(F.col("status_unique")), F.col("status_unique"), F.coalesce("n_bad_unique", F.lit(0)), F.lit("")),
        # told only if they are not in order
        F.when(~F.col("status_dates"), entry("dates", F.lit("error"), F.col("status_dates"), F.lit(1), F.lit("the first date does not precede the last one"))),
    )
    return rows.select(*list_cols, F.inline(F.array_compact(entries)))


def validate(
    targets: DataFrame,
    date_begin,
    date_end,
    list_cols: Sequence[str] = LIST_COLS,
    header: str | None = None,
    lists: DataFrame | None = None,
    **options,
) -> Validation:
    """Validate every list of ``targets``.

    ``header`` names an array column with the columns of each list. ``lists`` (list columns and ``header``)
    names the lists to report on even if they have no row. The dates may be dates, or columns that give every list its own;
    a list whose first date does not precede the last fails.
    """
    names = [c for c in targets.columns if c not in list_cols]
    of_list = F.max(header) if header else F.max(F.array(*[F.lit(c) for c in names]))
    lacking = [c for c in REQUIRED if c not in targets.columns]
    if lacking:  # no list can get past the first stage, and the flags have no columns to stand on
        flagged = targets.withColumns(
            {f: F.lit(None).cast("boolean") for f in ["ok_str", *VALUE_FLAGS, *LATE_FLAGS]}
        )
    else:
        flagged = flag_rows(targets, date_begin, date_end, list_cols, header, **options)
    # one row per list; the masks, the status and the report all start from it
    first, last = (F.col(d) if isinstance(d, str) else d if isinstance(d, Column) else F.lit(d) for d in (date_begin, date_end))
    results, _ = stage(list_results(flagged, of_list, list_cols, lists, date_order_ok(first, last)), "results")
    return Validation(mask_rows(flagged, results, list_cols), results, report_rows(results, list_cols))
