"""Summaries of target lists and of planned pointings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.timing import frames_in_hours, request_hours, shown_hours
from skyloom.operators.checks import drop_empty_columns
from skyloom.operators.completion import completion_curve, rank_pointings, wide_curve, with_required_exposure
from skyloom.operators.ordered import dealt, join_back
from skyloom.schema import LIST_COLS, MAX_REQUEST_HOURS, N_FIBERS, SINGLE_EXPTIME

# --- fixed values: report labels and columns ---
RESOLUTION_NAMES = {"L": "low", "M": "medium"}
USAGE = "Fiber usage fraction (%)"
LOW_USAGE = 30.0
SUMMARY_ROWS = [*[str(p) for p in range(10)], "Other", "Total"]
SUMMARY_COLUMNS = [
    "N_ppc",
    "Texp (h)",
    "Texp (fiberhour)",
    "Request time (h)",
    "Used fiber fraction (%)",
    "Fraction of PPC < 30% (%)",
]
COMPLETION_COLUMNS = ["P_all", *[f"P_{p}" for p in range(10)]]


def resolution_name(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == "L", "low").when(c == "M", "medium")


def target_summary(targets: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Counts and hours by priority (0-9, Other, Total) and resolution: 12 rows per list."""
    lists = list(list_cols)
    in_range = F.col("priority").between(0, 9)
    label = F.when(in_range, F.col("priority").cast("int").cast("string")).otherwise("Other")

    def of(resolution: str, value) -> Column:
        return F.when(F.col("resolution") == resolution, value)

    counted = (
        targets.select(*lists, F.explode(F.array(F.coalesce(label, F.lit("Other")), F.lit("Total"))).alias("Priority"), "resolution", "exptime")
        .groupBy(*lists, "Priority")
        .agg(
            F.count(of("L", F.lit(1))).alias("N (L)"),
            F.sum(of("L", F.col("exptime"))).alias("_l"),
            F.count(of("M", F.lit(1))).alias("N (M)"),
            F.sum(of("M", F.col("exptime"))).alias("_m"),
        )
    )
    empty = targets.select(*lists).distinct() if lists else counted.where("Priority = 'Total'").select()
    frame = empty.select(
        *lists, F.posexplode(F.array(*[F.lit(x) for x in SUMMARY_ROWS])).alias("row_no", "Priority")
    )
    zero = F.lit(0).cast("bigint")
    return frame.join(counted, [*lists, "Priority"], "left").select(
        *lists,
        "row_no",
        "Priority",
        F.coalesce("N (L)", zero).alias("N (L)"),
        (F.coalesce("_l", F.lit(0.0)) / 3600.0).alias("Texp (L)"),
        F.coalesce("N (M)", zero).alias("N (M)"),
        (F.coalesce("_m", F.lit(0.0)) / 3600.0).alias("Texp (M)"),
    )


def pointing_statistics(
    bridge: DataFrame, weights: DataFrame, list_cols: Sequence[str] = LIST_COLS, n_fibers: int = N_FIBERS,
    distinct_links: int | None = None,
) -> DataFrame:
    """Per pointing: assigned targets, fibre usage in per cent and priority (1 / summed weight).

    ``distinct_links`` as for :func:`completion_curve`.
    """
    lists = list(list_cols)
    key = [*lists, "ob_code"]
    pairs = bridge.select(*key, "ppc_code")
    pairs = pairs.distinct() if distinct_links is None else pairs
    linked = dealt(pairs, key, distinct_links).join(dealt(weights.select(*key, "weight"), key, distinct_links), key, "left")
    return linked.groupBy(*lists, "ppc_code").agg(
        F.count(F.lit(1)).alias("n_assigned"),
        (F.count(F.lit(1)) / float(n_fibers) * 100.0).alias("tel_fiber_usage_frac"),
        (1.0 / F.sum("weight")).alias("ppc_priority"),
    )


def add_allocated_targets(pointings: DataFrame, bridge: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """The nested output form: a sorted ``allocated_targets`` array per pointing (at most one per fibre)."""
    lists = list(list_cols)
    held = bridge.groupBy(*lists, "ppc_code").agg(F.array_sort(F.collect_set("ob_code")).alias("allocated_targets"))
    empty = F.array().cast("array<string>")
    return join_back(pointings, held, [*lists, "ppc_code"]).withColumn(
        "allocated_targets", F.coalesce("allocated_targets", empty)
    )


def report_guard(pointings: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Lists for which there is something to report: no resolution has only empty pointings."""
    lists = list(list_cols)
    per_mode = pointings.groupBy(*lists, "ppc_resolution").agg(
        F.bool_or(F.col("tel_fiber_usage_frac") > 0).alias("_any")
    )
    return per_mode.groupBy(*lists).agg(F.bool_and("_any").alias("has_result"))


def drop_empty_pointings(pointings: DataFrame) -> DataFrame:
    return pointings.where(F.col("tel_fiber_usage_frac") > 0)


def pointing_list(pointings: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Pointings in observing order per resolution, with new codes and priorities scaled to 1000.

    Both resolutions share the result, so that the combined list needs no union.
    """
    keys = [*list_cols, "ppc_resolution"]
    ranked = rank_pointings(pointings, keys)
    top = ranked.groupBy(*keys).agg(F.max("ppc_priority").alias("_top"))
    scaled = join_back(ranked, top, keys)
    return scaled.select(
        *list_cols,
        F.col("ppc_id").cast("bigint").alias("PPC_id"),
        F.concat_ws("_", F.lit("Point"), resolution_name("ppc_resolution"), F.col("ppc_id").cast("string")).alias("ppc_code"),
        F.col("ppc_code").alias("source_code"),
        "ppc_ra",
        "ppc_dec",
        "ppc_pa",
        "ppc_resolution",
        (F.col("ppc_priority") / F.col("_top") * 1000.0).alias("ppc_priority"),
        F.col("tel_fiber_usage_frac").alias(USAGE),
    )


def pointing_summary(
    ranked: DataFrame,
    curve: DataFrame,
    cut: DataFrame | int | None = None,
    single_exptime: float = SINGLE_EXPTIME,
    list_cols: Sequence[str] = LIST_COLS,
) -> DataFrame:
    """One row per resolution over the first ``n`` pointings.

    ``ranked`` has ``ppc_resolution, ppc_id, n_assigned, tel_fiber_usage_frac``; ``curve`` is the
    completion curve with the key ``ppc_resolution``. ``cut`` is a number, a table with ``n_ppc`` per
    list and resolution, or None for all pointings. With ``n = 0`` all figures are zero.
    """
    keys = [*list_cols, "ppc_resolution"]
    if isinstance(cut, DataFrame):
        limited = join_back(ranked, cut.select(*keys, "n_ppc"), keys)
    else:
        limited = ranked.withColumn("n_ppc", F.lit(cut).cast("bigint"))
    kept = F.col("n_ppc").isNull() | (F.col("ppc_id") <= F.col("n_ppc"))
    figures = limited.groupBy(*keys).agg(
        F.count_if(kept).alias("n"),
        F.coalesce(F.sum(F.when(kept, F.col("n_assigned"))), F.lit(0)).alias("_fibers"),
        F.coalesce(F.avg(F.when(kept, F.col("tel_fiber_usage_frac"))), F.lit(0.0)).alias("_mean"),
        F.count_if(kept & (F.col("tel_fiber_usage_frac") < LOW_USAGE)).alias("_low"),
    )
    hours = F.lit(single_exptime / 3600.0)
    shares = wide_curve(curve, "fh_pct", keys).withColumnRenamed("ppc_id", "n")
    out = figures.join(shares, [*keys, "n"], "left")
    none = F.col("n") == 0
    return out.select(
        *list_cols,
        resolution_name("ppc_resolution").alias("resolution"),
        F.col("n").alias("N_ppc"),
        (F.col("n") * hours).alias("Texp (h)"),
        (F.col("_fibers") * hours).alias("Texp (fiberhour)"),
        request_hours(F.col("n"), single_exptime).alias("Request time (h)"),
        F.col("_mean").alias("Used fiber fraction (%)"),
        F.when(none, 0.0).otherwise(F.col("_low") / F.greatest(F.col("n"), F.lit(1)) * 100.0).alias("Fraction of PPC < 30% (%)"),
        *[F.when(none, 0.0).otherwise(F.col(c)).alias(c) for c in COMPLETION_COLUMNS],
    )


def with_total_row(summary: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Append a Total row per list: sums up to the mean usage (which is summed too), then nulls."""
    lists = list(list_cols)
    summed = SUMMARY_COLUMNS[:5]
    total = summary.groupBy(*lists).agg(*[F.sum(c).alias(c) for c in summed]).withColumn("resolution", F.lit("Total"))
    rest = {c: F.lit(None).cast("double") for c in [SUMMARY_COLUMNS[5], *COMPLETION_COLUMNS]}
    return summary.unionByName(total.withColumns(rest))


def compact_summary(summary: DataFrame) -> DataFrame:
    """Summary without the columns that are null in every row."""
    return drop_empty_columns(summary, [SUMMARY_COLUMNS[5], *COMPLETION_COLUMNS])


def request_status(
    lists: DataFrame, hours: str = "rot", status: str = "status", has_result: str = "has_result",
    limit: float = MAX_REQUEST_HOURS,
) -> DataFrame:
    """Shown request time and outcome of a run, per row of ``lists``.

    ``status`` is 999 for automatic pointings, 1 when time ran out and 2 for a user's pointing list.
    """
    result = F.col(has_result)
    shown = F.when(result, shown_hours(hours)).otherwise(0.0)
    s = F.col(status)
    return lists.withColumns(
        {
            "shown_hours": shown,
            "outcome": F.when((s == 999) & (shown > limit), "warning")
            .when(s == 1, "error_timeout")
            .when((s == 2) & ~result, "error_no_assignment")
            .otherwise("success"),
            "over_limit": shown > limit,
        }
    )


def pointing_status_label(status: str | Column) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == 2, "user").when(s == 0, "skip").otherwise("auto")


def observation_rule(lists: DataFrame) -> DataFrame:
    """Only classical programmes keep their own exposure time and pointing list."""
    classical = F.col("obs_type") == "classical"
    return lists.withColumns(
        {
            "single_exptime": F.when(classical, F.col("single_exptime")).otherwise(SINGLE_EXPTIME),
            "use_pointing_list": F.coalesce(classical, F.lit(False)),
        }
    )


def run_facts(summary_with_total: DataFrame, single_exptime: float = SINGLE_EXPTIME, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """The facts of a run as text, one row per list; halves are shown as the even digit."""
    total = F.col("resolution") == "Total"

    def of_total(column: str) -> Column:
        return F.max(F.when(total, F.col(column)))

    facts = summary_with_total.groupBy(*list_cols).agg(
        of_total("N_ppc").alias("n"),
        of_total("Texp (fiberhour)").alias("fh"),
        of_total("Texp (h)").alias("h"),
        shown_hours(of_total("Request time (h)")).alias("rot"),
        *[
            F.max(F.when(F.col("resolution") == name, F.col("P_all"))).alias(f"_{name}")
            for name in RESOLUTION_NAMES.values()
        ],
    )
    minutes = single_exptime / 60.0
    lines = [
        F.format_string("pointings: %d", F.col("n")),
        F.format_string("fiber hours: %.1f", F.bround("fh", 1)),
        F.format_string(f"exposure hours without overhead: %.1f (%d x {minutes:.2f} min)", F.bround("h", 1), F.col("n")),
        F.format_string("hours with overhead: %.1f", F.col("rot")),
    ]
    for name in RESOLUTION_NAMES.values():
        lines.append(
            F.when(
                F.col(f"_{name}").isNotNull(),
                F.format_string(f"completed, {name}: %.0f%%", F.bround(f"_{name}")),
            )
        )
    return facts.select(*list_cols, "n", "fh", "h", "rot", F.concat_ws("\n", *lines).alias("facts"))


def reproduce_report(
    targets: DataFrame,
    pointings: DataFrame,
    bridge: DataFrame,
    summary: DataFrame,
    allocation: DataFrame | None = None,
    hours: DataFrame | None = None,
    single_exptime: float = SINGLE_EXPTIME,
    list_cols: Sequence[str] = LIST_COLS,
    distinct_links: int | None = None,
) -> DataFrame:
    """Rebuild the summary of stored submissions at a chosen request time.

    The cut per list and resolution is the allocated number of pointings if there is one, else the
    number in the stored ``summary``; a row of ``hours`` (``request_hours``) replaces both. Lists whose
    stored pointings lack a code are left out. ``distinct_links`` as for :func:`completion_curve`.
    """
    lists = list(list_cols)
    keys = [*lists, "ppc_resolution"]
    refused = pointings.groupBy(*lists).agg(F.bool_or(F.col("ppc_code").isNull()).alias("_bad"))
    usable = join_back(pointings, refused, lists).where("not _bad").drop("_bad")
    ranked = rank_pointings(usable, keys)

    def by_mode(table: DataFrame, column: str, name: str) -> DataFrame:
        mode = F.when(F.col("resolution") == "low", "L").when(F.col("resolution") == "medium", "M")
        return table.select(*lists, mode.alias("ppc_resolution"), F.col(column).alias(name)).where("ppc_resolution is not null")

    cut = by_mode(summary, "N_ppc", "_user")
    if allocation is not None:
        cut = cut.join(by_mode(allocation, "N_ppc", "_given"), keys, "left")
    else:
        cut = cut.withColumn("_given", F.lit(None).cast("bigint"))
    n = F.coalesce(F.when(F.col("_given") > 0, F.col("_given")), F.col("_user"))
    # the chosen time of a run goes through hours, as the stored number does
    if hours is not None:
        cut = cut.join(hours.select(*keys, "request_hours"), keys, "left")
        n = F.coalesce(frames_in_hours("request_hours", single_exptime), n)
    cut = cut.select(*keys, n.cast("bigint").alias("n_ppc"))
    moded = with_required_exposure(targets, single_exptime).withColumn("ppc_resolution", F.col("resolution"))
    curve = completion_curve(moded, ranked, bridge.select(*lists, "ppc_code", "ob_code"), single_exptime, keys, distinct_links)
    return pointing_summary(ranked, curve, cut, single_exptime, list_cols)
