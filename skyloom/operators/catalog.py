"""The catalog of submissions: one row per submission, filters, totals and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.timing import semester_label
from skyloom.schema import SINGLE_EXPTIME

# --- fixed values: catalog columns, in order ---
CATALOG_COLUMNS = [
    "Upload ID", "TAC_done", "n_obj", "Exptime_tgt (FH)",
    "Exptime_sci_L (h)", "Exptime_sci_M (h)", "Exptime_sci_L (FH)", "Exptime_sci_M (FH)",
    "Time_tot_L (h)", "Time_tot_M (h)",
    "TAC_FH_L", "TAC_FH_M", "TAC_nppc_L", "TAC_nppc_M", "TAC_ROT_L", "TAC_ROT_M",
    "Filename", "filesize", "timestamp",
    "fullpath_tgt", "fullpath_ppc", "fullpath_ppc_tac", "fullpath_psl",
    "single_exptime", "observation_type", "pointing_status", "Filename_pointing", "semester",
]
RANGE_COLUMNS = {
    "n_obj": "n_obj", "fiberhours": "Exptime_tgt (FH)", "rot_low": "Time_tot_L (h)", "rot_medium": "Time_tot_M (h)",
}


def wide_modes(table: DataFrame, names: dict[str, str], key: str = "upload_id") -> DataFrame:
    """Low and medium rows of a summary table side by side: ``names`` maps input column to prefix.

    The result has ``<prefix>_L`` and ``<prefix>_M``.
    """
    aggs = []
    for mode, suffix in (("low", "L"), ("medium", "M")):
        for column, prefix in names.items():
            aggs.append(F.max(F.when(F.col("resolution") == mode, F.col(column))).alias(f"{prefix}_{suffix}"))
    return table.groupBy(key).agg(*aggs)


def request_time_column(table: DataFrame) -> DataFrame:
    """``Request time (h)``, taken from its older name where a file still uses that."""
    new, old = "Request time (h)", "Request time 1 (h)"
    names = [F.col(f"`{c}`") for c in (new, old) if c in table.columns]
    return table.withColumn(new, F.coalesce(*names)).drop(old)


def object_totals(
    submissions: DataFrame, summaries: DataFrame | None, targets: DataFrame | None, key: str = "upload_id"
) -> DataFrame:
    """``n_obj`` and ``hours`` from the Total row of the summary, else counted from the target list."""
    out = submissions.select(key)
    if summaries is not None:
        total = summaries.where(F.col("Priority") == "Total").groupBy(key).agg(
            F.max(F.col("N (L)") + F.col("N (M)")).cast("bigint").alias("_n"),
            F.max(F.col("Texp (L)") + F.col("Texp (M)")).alias("_h"),
        )
        out = out.join(total, key, "left")
    else:
        out = out.withColumns({"_n": F.lit(None).cast("bigint"), "_h": F.lit(None).cast("double")})
    if targets is not None:
        counted = targets.groupBy(key).agg(
            F.count(F.lit(1)).alias("_cn"), (F.sum("exptime") / 3600.0).alias("_ch")
        )
        out = out.join(counted, key, "left")
    else:
        out = out.withColumns({"_cn": F.lit(None).cast("bigint"), "_ch": F.lit(None).cast("double")})
    return out.select(key, F.coalesce("_n", "_cn").alias("n_obj"), F.coalesce("_h", "_ch").alias("hours"))


def build_catalog(
    submissions: DataFrame,
    summaries: DataFrame | None,
    targets: DataFrame | None,
    psl: DataFrame,
    tac_psl: DataFrame | None = None,
) -> DataFrame:
    """One row per submission with the fixed catalog columns and ``is_complete``.

    ``submissions`` has ``upload_id`` and, each of them optional, the metadata columns
    ``original_filename, original_filename_ppc, upload_at, single_exptime, observation_type, ppc_status``
    and the file columns ``filesize, target_path, ppc_path, psl_path, tac_ppc_path``. Missing tables leave
    zeros, and without a pointing summary only the object totals are known; a submission without objects or without a pointing summary is marked incomplete.
    """
    key = "upload_id"

    def given(name: str, kind: str, default=None) -> Column:
        value = F.col(name).cast(kind) if name in submissions.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value

    psl_wide = wide_modes(
        request_time_column(psl),
        {"Texp (h)": "_sci_h", "Texp (fiberhour)": "_sci_fh", "Request time (h)": "_rot"},
    ).withColumn("_has_psl", F.lit(True))
    joined = submissions.join(object_totals(submissions, summaries, targets), key, "left").join(psl_wide, key, "left")
    if tac_psl is not None:
        tac = wide_modes(
            request_time_column(tac_psl),
            {"Texp (fiberhour)": "_tac_fh", "N_ppc": "_tac_n", "Request time (h)": "_tac_rot"},
        ).withColumn("_tac", F.lit(True))
        joined = joined.join(tac, key, "left")
    else:
        nothing = {f"_tac_{k}_{s}": F.lit(None).cast("double") for k in ("fh", "n", "rot") for s in "LM"}
        joined = joined.withColumns({**nothing, "_tac": F.lit(None).cast("boolean")})
    complete = F.col("_has_psl").isNotNull() & F.col("n_obj").isNotNull()

    def zero(name: str) -> Column:
        return F.when(complete, F.coalesce(F.col(name).cast("double"), F.lit(0.0))).otherwise(0.0)

    def tac_zero(kind: str, suffix: str) -> Column:
        # an allocation counts only for a mode that was requested
        return F.when(F.col(f"_rot_{suffix}").isNotNull(), zero(f"_tac_{kind}_{suffix}")).otherwise(0.0)

    def when_complete(value: Column) -> Column:
        return F.when(complete, value)

    stamp = when_complete(given("upload_at", "timestamp"))
    columns = {
        "Upload ID": when_complete(F.col(key)),
        "TAC_done": complete & F.col("_tac").isNotNull(),
        "n_obj": F.coalesce("n_obj", F.lit(0).cast("bigint")),
        "Exptime_tgt (FH)": F.coalesce("hours", F.lit(0.0)),
        "Exptime_sci_L (h)": zero("_sci_h_L"), "Exptime_sci_M (h)": zero("_sci_h_M"),
        "Exptime_sci_L (FH)": zero("_sci_fh_L"), "Exptime_sci_M (FH)": zero("_sci_fh_M"),
        "Time_tot_L (h)": zero("_rot_L"), "Time_tot_M (h)": zero("_rot_M"),
        "TAC_FH_L": tac_zero("fh", "L"), "TAC_FH_M": tac_zero("fh", "M"),
        "TAC_nppc_L": tac_zero("n", "L").cast("bigint"), "TAC_nppc_M": tac_zero("n", "M").cast("bigint"),
        "TAC_ROT_L": tac_zero("rot", "L"), "TAC_ROT_M": tac_zero("rot", "M"),
        "Filename": when_complete(given("original_filename", "string")),
        "filesize": F.when(complete, given("filesize", "double", 0.0)).otherwise(0.0),
        "timestamp": stamp,
        "fullpath_tgt": when_complete(given("target_path", "string")),
        "fullpath_ppc": when_complete(given("ppc_path", "string")),
        "fullpath_ppc_tac": F.when(complete & F.col("_tac").isNotNull(), given("tac_ppc_path", "string")),
        "fullpath_psl": when_complete(given("psl_path", "string")),
        "single_exptime": F.when(complete, given("single_exptime", "int", int(SINGLE_EXPTIME))).otherwise(int(SINGLE_EXPTIME)),
        "observation_type": when_complete(given("observation_type", "string")),
        "pointing_status": when_complete(given("ppc_status", "string")),
        "Filename_pointing": when_complete(given("original_filename_ppc", "string")),
        "semester": semester_label(stamp),
    }
    return joined.select(*[c.alias(name) for name, c in columns.items()], complete.alias("is_complete"))


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.col("timestamp").desc_nulls_last(), F.col("Upload ID"))


def with_proposals(catalog: DataFrame, proposals: DataFrame, key: str = "Upload ID") -> DataFrame:
    """Attach proposal information; submissions without any are left out."""
    return catalog.join(proposals, key)


def visible_columns(catalog: DataFrame, chosen: Sequence[str]) -> DataFrame:
    return catalog.select(*[f"`{c}`" for c in catalog.columns if c in set(chosen)])


def in_semester(catalog: DataFrame, semester: str | None) -> DataFrame:
    return catalog if semester in (None, "None") else catalog.where(F.col("semester") == semester)


def semesters(catalog: DataFrame) -> DataFrame:
    return catalog.select("semester").where("semester is not null").distinct().orderBy("semester")


def in_ranges(catalog: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Keep rows inside inclusive ranges of ``n_obj``, ``fiberhours``, ``rot_low``, ``rot_medium``."""
    for name, (low, high) in ranges.items():
        catalog = catalog.where(F.col(f"`{RANGE_COLUMNS[name]}`").between(low, high))
    return catalog


def range_bounds(catalog: DataFrame) -> DataFrame:
    """Whole-number bounds for the range filters; counts in steps of ten."""
    aggs = []
    for name, column in RANGE_COLUMNS.items():
        c = F.col(f"`{column}`")
        step = 10 if name == "n_obj" else 1
        aggs += [
            (F.floor(F.min(c) / step) * step).cast("bigint").alias(f"{name}_min"),
            (F.ceil(F.max(c) / step) * step).cast("bigint").alias(f"{name}_max"),
        ]
    return catalog.agg(*aggs)


def allocation_totals(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Allocated programmes, and fibre-hours, pointings and hours by resolution."""
    return catalog.groupBy(*by).agg(
        F.count_if((F.col("TAC_nppc_L") > 0) | (F.col("TAC_nppc_M") > 0)).alias("n_allocated"),
        *[F.sum(f"TAC_{k}_{s}").alias(f"{k}_{s}") for k in ("FH", "nppc", "ROT") for s in "LM"],
    )


def merge_allocation(catalog: DataFrame, tac_psl: DataFrame) -> DataFrame:
    """Update the allocation columns from new allocation summaries; other rows stay as they are."""
    new = wide_modes(
        tac_psl, {"Texp (fiberhour)": "_new_FH", "N_ppc": "_new_nppc", "Request time (h)": "_new_ROT"}
    ).withColumnRenamed("upload_id", "Upload ID")
    joined = catalog.join(new, "Upload ID", "left")
    any_new = F.coalesce("_new_nppc_L", "_new_nppc_M").isNotNull()
    updates = {"TAC_done": F.col("TAC_done") | any_new}
    for k in ("FH", "nppc", "ROT"):
        for s in "LM":
            name = f"TAC_{k}_{s}"
            kind = catalog.schema[name].dataType
            updates[name] = F.coalesce(F.col(f"_new_{k}_{s}").cast(kind), F.col(name))
    return joined.withColumns(updates).select(*[f"`{c}`" for c in catalog.columns])


def ambiguous_ids(directories: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Upload ids that do not resolve to exactly one directory, with the number of directories."""
    counts = directories.groupBy("upload_id").agg(F.count_distinct("directory").alias("n_directories"))
    if candidates is not None:
        counts = candidates.select("upload_id").distinct().join(counts, "upload_id", "left").withColumn(
            "n_directories", F.coalesce("n_directories", F.lit(0))
        )
    return counts.where("n_directories <> 1")


def of_submission(table: DataFrame, upload_id: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of one submission; the year and month of its stamp prune the partitions read."""
    if year is not None:
        table = table.where(F.col("year") == year)
    if month is not None:
        table = table.where(F.col("month") == month)
    return table.where(F.col("upload_id") == upload_id)
