"""One query per operator over the derived tables. Every query reads its whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.sky import sky_pixel
from skyloom.functions.timing import frames_in_hours, request_hours, semester_begin, semester_end, semester_label
from skyloom.operators import allocation, catalog, checks, cluster, completion, density, flux, registry, reports, spatial, visibility
from skyloom.plans import pointing_plan, validation
from skyloom.session import by_key, stage
from workload.files import FILE_QUERIES
from workload.views import table, view

LISTS = ["list_no"]
T = 900.0
SPRING = (dt.date(2026, 2, 1), dt.date(2026, 7, 31))  # a whole semester

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(FILE_QUERIES)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`").cast("bigint") for n in names})


# --- completion ---------------------------------------------------------------------


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Targets with frames, density and weight; the table as one list per resolution."""
    return pointing_plan.weighted_targets(view(spark, sf, "targets"), T, ["list_no", "resolution"])


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The given allocations, stored once for all that reads them, and their number; the view has no copies."""
    links, seen = stage(view(spark, sf, "allocations"), "allocations", n=F.count(F.lit(1)))
    return links, seen["n"]


def _stored_pointings(spark: SparkSession, sf: str, links: DataFrame | None = None, n_links: int | None = None) -> DataFrame:
    """The given pointings with usage and priority from the given allocations."""
    if links is None:
        links, n_links = _links(spark, sf)
    weights = density.local_density(completion.with_required_exposure(view(spark, sf, "targets"), T), []).withColumn(
        "weight", density.target_weight(F.col("priority"), F.col("exptime_req"), F.col("local_count"), T)
    )
    stats = reports.pointing_statistics(links, weights, [], distinct_links=n_links)
    return view(spark, sf, "pointings").join(rounded(stats, 12, "ppc_priority", "tel_fiber_usage_frac"), "ppc_code")


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    targets = completion.with_required_exposure(view(spark, sf, "targets"), T)
    links, n_links = _links(spark, sf)
    ranked = completion.rank_pointings(_stored_pointings(spark, sf, links, n_links), [])
    return completion.completion_curve(targets, ranked, links, T, [], n_links)


@query
def completion_curve_fh(spark, sf):
    return rounded(_curve(spark, sf).select("ppc_id", "priority", "fh", "fh_pct"), 6, "fh", "fh_pct")


@query
def completion_curve_n(spark, sf):
    return rounded(_curve(spark, sf).select("ppc_id", "priority", "n", "n_pct"), 6, "n_pct")


@query
def assigned_exposure(spark, sf):
    out = completion.assigned_exposure(
        completion.with_required_exposure(view(spark, sf, "targets"), T), view(spark, sf, "allocations"), T, []
    )
    return out.select("ob_code", "exptime_req", "exptime_assign")


@query
def target_weights(spark, sf):
    return rounded(_weighted(spark, sf).select("row_id", "exptime_req", "local_count", "weight"), 9, "weight")


# --- checks -------------------------------------------------------------------------


@query
def column_report(spark, sf):
    out = checks.check_columns(checks.list_headers(view(spark, sf, "targets"), LISTS), LISTS)
    return out.select(
        "list_no", "required_ok", "optional_ok",
        F.array_join("required_found", ",").alias("required_found"),
        F.array_join("required_missing", ",").alias("required_missing"),
        F.array_join("optional_missing", ",").alias("optional_missing"),
    )


@query
def check_strings(spark, sf):
    out = checks.string_flags(view(spark, sf, "targets_dirty"))
    return out.select("row_id", "ok_str_ob_code", "ok_str_resolution", "ok_str_reference_arm", "ok_str")


@query
def check_values(spark, sf):
    out = checks.value_flags(view(spark, sf, "targets_dirty"), LISTS)
    return out.select("row_id", *[f"ok_{c}" for c in checks.VALUE_COLUMNS], "ok_values")


@query
def check_values_list_scope(spark, sf):
    out = checks.value_flags(view(spark, sf, "targets_dirty"), LISTS, arm_scope="list")
    status = checks.list_status(out, ["ok_reference_arm", "ok_values"], LISTS)
    return longs(status, "n_rows", "n_bad_reference_arm", "n_bad_values")


@query
def check_unique(spark, sf):
    out = checks.unique_flags(view(spark, sf, "targets_dirty"), LISTS)
    return out.select("row_id", "list_no", "ok_code", "ok_pair", "ok_unique")


@query
def unique_status(spark, sf):
    flagged = checks.unique_flags(view(spark, sf, "targets_dirty"), LISTS)
    return checks.unique_status(flagged, LISTS, view(spark, sf, "targets").select("list_no"))


@query
def size_notice(spark, sf):
    return longs(checks.size_notice(view(spark, sf, "targets"), LISTS, threshold=1500), "n_rows")


@query
def registered_columns(spark, sf):
    kept = checks.with_object_text(checks.keep_registered(view(spark, sf, "targets"), ["row_id"]))
    return checks.fill_optional(kept)


@query
def validation_flags(spark, sf):
    dirty = view(spark, sf, "targets_dirty")
    # half of the lists are the clean ones, so that the later stages are reached as well
    mixed = dirty.where("list_no % 2 = 1").unionByName(view(spark, sf, "targets").where("list_no % 2 = 0").select(*dirty.columns))
    result = validation.validate(mixed, *SPRING, LISTS)
    return result.rows.select("row_id", "ok_str", "ok_values", "ok_flux", "ok_visible", "ok_unique")


@query
def validation_report(spark, sf):
    dirty = view(spark, sf, "targets_dirty")
    mixed = dirty.where("list_no % 2 = 1").unionByName(view(spark, sf, "targets").where("list_no % 2 = 0").select(*dirty.columns))
    return validation.validate(mixed, *SPRING, LISTS).report


@query
def validation_status(spark, sf):
    result = validation.validate(view(spark, sf, "targets"), *SPRING, LISTS)
    return longs(
        result.status.select("list_no", "status_str", "status_values", "status_flux", "status_visible", "status_unique", "status", "label", "n_rows"),
        "n_rows",
    )


@query
def validation_dates(spark, sf):
    """Every list with its own dates, those of one list reversed: it fails, and the report says why."""
    begin, end = (F.lit(d) for d in SPRING)
    reversed_ = F.col("list_no") == 3
    targets = view(spark, sf, "targets").withColumns(
        {"date_begin": F.when(reversed_, end).otherwise(begin), "date_end": F.when(reversed_, begin).otherwise(end)}
    )
    result = validation.validate(targets, "date_begin", "date_end", LISTS)
    told = result.report.where("check = 'dates'").select("list_no", "severity", "n_bad")
    rows = result.status.select("list_no", "n_rows", "status_dates", "status", "status_visible").join(told, "list_no", "left")
    return longs(rows.select("list_no", "n_rows", "status_dates", (F.col("status") & ~F.col("status_dates")).alias("passed_reversed"), "severity", "n_bad"), "n_rows", "n_bad")


@query
def offending_rows(spark, sf):
    dirty = view(spark, sf, "targets_dirty")
    flagged = flux.resolve_flux(checks.unique_flags(checks.value_flags(checks.string_flags(dirty), LISTS), LISTS))
    return checks.offending_rows(flagged, ["row_id", "list_no"])


# --- flux ---------------------------------------------------------------------------


@query
def flux_resolve(spark, sf):
    out = flux.resolve_flux(view(spark, sf, "targets"))
    names = [f"{k}_{b}" for b in "gri" for k in ("filter", "flux", "flux_error")]
    return out.select("row_id", *names, "ok_flux")


@query
def flux_status(spark, sf):
    return longs(flux.flux_status(flux.resolve_flux(view(spark, sf, "targets")), LISTS), "n_no_flux")


@query
def flux_filters_in_use(spark, sf):
    out = flux.filters_in_use(flux.resolve_flux(view(spark, sf, "targets")), LISTS)
    return out.select("list_no", F.array_join("filters", ",").alias("filters"))


@query
def flux_skipped(spark, sf):
    return flux.skipped_fluxes(flux.resolve_flux(view(spark, sf, "targets")), ["row_id"])


@query
def flux_bands_kept(spark, sf):
    out = flux.band_presence(flux.resolve_flux(view(spark, sf, "targets")), LISTS)
    return out.select("list_no", F.array_join("columns", ",").alias("columns"))


# --- reports ------------------------------------------------------------------------


@query
def target_summary(spark, sf):
    out = reports.target_summary(view(spark, sf, "targets"), LISTS).drop("row_no")
    return rounded(out, 6, "Texp (L)", "Texp (M)")


@query
def request_time(spark, sf):
    counts = view(spark, sf, "allocations").join(view(spark, sf, "pointings"), "ppc_code").groupBy("ppc_code").agg(
        F.count(F.lit(1)).alias("n_frames")
    )
    return counts.select(
        "ppc_code", "n_frames",
        F.round(request_hours("n_frames", T), 6).alias("rot"),
        F.round(request_hours("n_frames", 450.0), 6).alias("rot_short"),
    )


@query
def frames_from_time(spark, sf):
    out = view(spark, sf, "targets").withColumn("hours", F.col("exptime") / 360.0)
    return out.select("row_id", frames_in_hours("hours", T).alias("frames"), frames_in_hours("hours", 450.0).alias("frames_short"))


@query
def pointing_list(spark, sf):
    out = reports.pointing_list(_stored_pointings(spark, sf), [])
    return rounded(out, 6, "ppc_ra", "ppc_dec", "ppc_priority", reports.USAGE)


@query
def pointing_statistics(spark, sf):
    return rounded(
        _stored_pointings(spark, sf).select("ppc_code", "n_assigned", "tel_fiber_usage_frac", "ppc_priority"), 9,
        "tel_fiber_usage_frac", "ppc_priority",
    )


def _modes(spark, sf):
    """Targets and stored pointings by resolution, and the links with their number."""
    targets = completion.with_required_exposure(view(spark, sf, "targets"), T).withColumn("ppc_resolution", F.col("resolution"))
    links = _links(spark, sf)
    return targets, _stored_pointings(spark, sf, *links), links


def _summary(spark, sf, cut=None):
    targets, pointings, (links, n_links) = _modes(spark, sf)
    ranked = completion.rank_pointings(pointings, ["ppc_resolution"])
    curve = completion.completion_curve(targets, ranked, links, T, ["ppc_resolution"], n_links)
    return reports.with_total_row(reports.pointing_summary(ranked, curve, cut, T, []), [])


SUMMARY_FIGURES = [*reports.SUMMARY_COLUMNS[1:], *reports.COMPLETION_COLUMNS]


@query
def pointing_summary(spark, sf):
    return rounded(_summary(spark, sf, 4), 6, *SUMMARY_FIGURES)


@query
def request_status(spark, sf):
    per_list = view(spark, sf, "targets").groupBy("list_no").agg(F.count(F.lit(1)).alias("_n"))
    lists = per_list.select(
        "list_no",
        request_hours(F.col("_n") % 211, T).alias("rot"),
        F.when(F.col("list_no") % 3 == 0, 999).when(F.col("list_no") % 3 == 1, 2).otherwise(1).alias("status"),
        (F.col("list_no") % 4 != 1).alias("has_result"),
    )
    out = reports.request_status(lists)
    return out.select("list_no", F.round("shown_hours", 6).alias("shown_hours"), "outcome", "over_limit", reports.pointing_status_label("status").alias("label"))


@query
def run_facts(spark, sf):
    return reports.run_facts(_summary(spark, sf), T, []).select("n", "facts")


@query
def report_guard(spark, sf):
    return reports.report_guard(_stored_pointings(spark, sf).withColumn("list_no", F.col("ppc_no") % 10), LISTS)


@query
def observation_rule(spark, sf):
    lists = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "classical").when(F.col("c_custkey") % 3 == 1, "queue").otherwise("filler").alias("obs_type"),
        (F.col("c_custkey") % 7 * 100.0 + 300.0).alias("single_exptime"),
    )
    return reports.observation_rule(lists)


# --- catalog ------------------------------------------------------------------------


def _catalog_tables(spark, sf):
    """Submissions, summaries and allocations that stand for stored files, from the targets of each list."""
    targets = view(spark, sf, "targets")
    with_id = targets.withColumn("upload_id", F.concat(F.lit("u"), F.col("list_no").cast("string")))
    submissions = with_id.groupBy("upload_id").agg(
        F.max("submitted_at").cast("timestamp").alias("upload_at"),
        F.concat(F.lit("list_"), F.max("list_no").cast("string"), F.lit(".csv")).alias("original_filename"),
        F.when(F.max("list_no") % 2 == 0, "queue").otherwise("classical").alias("observation_type"),
        F.when(F.max("list_no") % 5 == 0, F.lit(450)).alias("single_exptime"),
    )
    summaries = reports.target_summary(with_id, ["upload_id"]).where("upload_id not in ('u3', 'u7')")
    psl = with_id.groupBy("upload_id", "resolution").agg(F.count(F.lit(1)).alias("_n")).select(
        "upload_id", reports.resolution_name("resolution").alias("resolution"), F.col("_n").alias("N_ppc"),
        (F.col("_n") * 0.25).alias("Texp (h)"), (F.col("_n") * 2.5).alias("Texp (fiberhour)"),
        F.when(F.col("upload_id") != "u4", F.col("_n") * 0.375).alias("Request time (h)"),
        F.when(F.col("upload_id") == "u4", F.col("_n") * 0.5).alias("Request time 1 (h)"),
    ).where("upload_id <> 'u9'")
    tac = psl.where("upload_id in ('u1', 'u2', 'u5')").select(
        "upload_id", "resolution", F.floor(F.col("N_ppc") / 2).alias("N_ppc"),
        (F.col("Texp (fiberhour)") / 2).alias("Texp (fiberhour)"), (F.col("Request time (h)") / 2).alias("Request time (h)"),
    )
    return submissions, summaries, with_id, psl, tac


def _catalog(spark, sf):
    submissions, summaries, targets, psl, tac = _catalog_tables(spark, sf)
    return catalog.build_catalog(submissions, summaries, targets, psl, tac)


FIGURES = [c for c in catalog.CATALOG_COLUMNS if c.startswith(("Exptime", "Time_tot", "TAC_FH", "TAC_ROT"))]


@query
def catalog_rows(spark, sf):
    names = ["Upload ID", "TAC_done", "n_obj", *FIGURES, "TAC_nppc_L", "TAC_nppc_M", "Filename", "single_exptime", "observation_type", "semester", "is_complete"]
    return rounded(catalog.newest_first(_catalog(spark, sf)).select(*[f"`{n}`" for n in names]), 6, *FIGURES)


@query
def catalog_totals(spark, sf):
    out = catalog.allocation_totals(_catalog(spark, sf))
    return rounded(out, 6, "FH_L", "FH_M", "ROT_L", "ROT_M")


@query
def catalog_filter(spark, sf):
    rows = _catalog(spark, sf)
    hit = catalog.in_ranges(rows, n_obj=(1, 10**9), fiberhours=(1.0, 1e9), rot_low=(1.0, 1e9), rot_medium=(1.0, 1e9))
    return catalog.visible_columns(hit, ["Upload ID", "n_obj", "semester"])


@query
def catalog_bounds(spark, sf):
    return catalog.range_bounds(_catalog(spark, sf))


@query
def catalog_semesters(spark, sf):
    return catalog.semesters(view(spark, sf, "targets").select(semester_label("submitted_at").alias("semester")))


@query
def catalog_in_semester(spark, sf):
    rows = view(spark, sf, "targets").select("row_id", semester_label("submitted_at").alias("semester"))
    return catalog.in_semester(rows, "S98A")


@query
def catalog_merge_allocation(spark, sf):
    submissions, summaries, targets, psl, tac = _catalog_tables(spark, sf)
    old = catalog.build_catalog(submissions, summaries, targets, psl, None)
    out = catalog.merge_allocation(old, tac).select("Upload ID", "TAC_done", "TAC_FH_L", "TAC_FH_M", "TAC_nppc_L", "TAC_nppc_M", "TAC_ROT_L", "TAC_ROT_M")
    return rounded(out.where("`Upload ID` is not null"), 6, "TAC_FH_L", "TAC_FH_M", "TAC_ROT_L", "TAC_ROT_M")


@query
def catalog_proposal_join(spark, sf):
    lists = view(spark, sf, "targets").groupBy("list_no").agg(F.count(F.lit(1)).alias("n_obj")).withColumnRenamed("list_no", "Upload ID")
    proposals = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 10).cast("int").alias("Upload ID"), F.col("c_name").alias("PI name"), F.col("c_acctbal").alias("rank")
    ).where("rank > 0")
    return catalog.with_proposals(lists, proposals)


@query
def ambiguous_ids(spark, sf):
    directories = view(spark, sf, "registry").select("upload_id", F.concat_ws("-", F.col("user_id").cast("string"), "upload_id").alias("directory"))
    return catalog.ambiguous_ids(directories)


@query
def submission_lookup(spark, sf):
    rows = view(spark, sf, "targets").select(
        "row_id", F.concat(F.lit("u"), F.col("list_no").cast("string")).alias("upload_id"), F.year("submitted_at").alias("year"), F.month("submitted_at").alias("month"), "exptime"
    )
    return catalog.of_submission(rows, "u4", 1997, 5).select("row_id", "upload_id", "exptime")


@query
def semester_labels(spark, sf):
    return view(spark, sf, "targets").select("row_id", semester_label("submitted_at").alias("semester"))


@query
def semester_range(spark, sf):
    days = view(spark, sf, "targets").select("row_id", F.to_date("submitted_at").alias("d"))
    return days.select(
        "row_id",
        semester_begin("d", "current").alias("this_begin"), semester_end("d", "current").alias("this_end"),
        semester_begin("d").alias("next_begin"), semester_end("d").alias("next_end"),
    )


# --- registry -----------------------------------------------------------------------


def _candidates(spark, sf):
    events = table(spark, sf, "events")
    return events.select(F.substring(F.md5((F.col("event_id") * 2).cast("string")), 1, 16).alias("upload_id"))


@query
def registry_repeats(spark, sf):
    return registry.repeated_ids(view(spark, sf, "registry"))


@query
def registry_dedup(spark, sf):
    return registry.without_repeats(view(spark, sf, "registry"))


@query
def registry_existing(spark, sf):
    return registry.existing(_candidates(spark, sf), view(spark, sf, "registry"))


@query
def registry_anti(spark, sf):
    return registry.missing(_candidates(spark, sf), view(spark, sf, "registry"))


@query
def registry_assign(spark, sf):
    submissions = table(spark, sf, "orders").select("o_orderkey")
    # ids that the first draw would give to every seventh key are taken already
    taken = submissions.where("o_orderkey % 7 = 0").select(
        F.substring(F.sha2(F.concat_ws("|", F.lit("0"), F.col("o_orderkey").cast("string")), 256), 1, 16).alias("upload_id")
    )
    return registry.assign_ids(submissions, taken, "o_orderkey")


# --- sky ----------------------------------------------------------------------------


@query
def sky_pixels(spark, sf):
    return view(spark, sf, "targets").select("row_id", sky_pixel("ra", "dec").alias("pixel"))


@query
def pixel_groups(spark, sf):
    return rounded(visibility.pixel_groups(view(spark, sf, "targets"), LISTS), 9, "ra", "dec")


@query
def local_density(spark, sf):
    targets = view(spark, sf, "targets")
    both = density.local_density(targets, LISTS).select("row_id", "list_no", "ra", "dec", F.col("local_count").alias("wrapped"))
    return density.local_density(both, LISTS, wrap=False).select("row_id", "wrapped", F.col("local_count").alias("plain"))


@query
def field_outline(spark, sf):
    out = spatial.field_outline(view(spark, sf, "pointings"))
    return rounded(out.withColumn("vertex", F.col("vertex").cast("bigint")), 9, "vertex_ra", "vertex_dec")


@query
def targets_in_field(spark, sf):
    return spatial.targets_in_fields(view(spark, sf, "targets"), view(spark, sf, "pointings"), [])


@query
def targets_in_field_by_mode(spark, sf):
    pointings = view(spark, sf, "pointings").withColumnRenamed("ppc_resolution", "resolution")
    return spatial.targets_in_fields(view(spark, sf, "targets"), pointings, ["resolution"])


@query
def group_coverage(spark, sf):
    grouped = cluster.group_pointings(view(spark, sf, "pointings"), list_cols=[], row_id="ppc_no")
    return spatial.covered_targets(view(spark, sf, "targets"), grouped, [])


@query
def sky_extent(spark, sf):
    pointings = view(spark, sf, "pointings").withColumn("list_no", (F.col("ppc_no") % 10).cast("int"))
    return rounded(spatial.sky_extent(view(spark, sf, "targets"), pointings, LISTS), 6, "ra_min", "ra_max", "dec_min", "dec_max")


# --- visibility ---------------------------------------------------------------------


def _ranges(spark, sf):
    lists = view(spark, sf, "targets").select("list_no").distinct()
    return lists.select(
        "list_no", F.lit(dt.date(2026, 2, 1)).alias("date_begin"), F.date_add(F.lit(dt.date(2026, 7, 20)), F.col("list_no")).alias("date_end")
    )


@query
def night_calendar(spark, sf):
    return visibility.night_calendar(_ranges(spark, sf)).select("list_no", "night", "begin_utc", "end_utc")


@query
def night_calendar_split(spark, sf):
    nights = visibility.night_calendar(_ranges(spark, sf), calendar="split_time")
    return nights.groupBy("list_no").agg(F.count(F.lit(1)).alias("n_nights"), F.sum(F.date_diff("night", F.lit(dt.date(2026, 2, 1)))).alias("day_sum"))


@query
def observable_seconds(spark, sf):
    pixels = visibility.pixel_groups(view(spark, sf, "targets"), LISTS)
    nights = visibility.observable_seconds(pixels, dt.date(2026, 2, 1), dt.date(2026, 2, 20))
    # whole minutes: the last second of a stretch may differ between two sine functions
    return nights.select("list_no", "pixel", "night", F.round(F.col("seconds") / 60.0).alias("minutes"))


@query
def target_visibility(spark, sf):
    out = visibility.visibility_flags(view(spark, sf, "targets"), *SPRING, LISTS)
    return out.select("row_id", "ok_visible")


@query
def target_visibility_exact(spark, sf):
    out = visibility.visibility_flags(view(spark, sf, "targets"), *SPRING, LISTS, grouping="target")
    return out.select("row_id", "ok_visible")


@query
def visibility_status(spark, sf):
    flagged = visibility.visibility_flags(view(spark, sf, "targets"), *SPRING, LISTS)
    return longs(visibility.visibility_status(flagged, LISTS), "n_invisible")


@query
def visibility_ranges(spark, sf):
    """Half-year ranges, another one for each list, from one table of prefix sums over the year."""
    targets = view(spark, sf, "targets")
    positions = visibility.pixel_groups(targets, [])
    sums, _ = stage(visibility.visibility_sums(positions, dt.date(2026, 1, 1), dt.date(2026, 12, 31)), "night-sums")
    ranges = targets.withColumns({
        "date_begin": F.date_add(F.lit(dt.date(2026, 2, 1)), F.col("list_no") * 17),
        "date_end": F.date_add(F.lit(dt.date(2026, 7, 31)), F.col("list_no") * 16),
    })
    told = visibility.visibility_by_sums(ranges, sums, "date_begin", "date_end", LISTS)
    return told.select("list_no", "pixel", "max_exptime", "seconds", "ok_visible")


# --- density ------------------------------------------------------------------------

MODES = ["list_no", "resolution"]


@query
def density_map(spark, sf):
    out = density.density_map(_weighted(spark, sf), MODES)
    return longs(rounded(out, 6, "ra", "dec", "z"), "ix", "iy")


@query
def density_peak(spark, sf):
    out = density.density_peak(_weighted(spark, sf), MODES, digits=6)
    return rounded(out, 6, "peak_ra", "peak_dec", "significance")


# --- clusters -----------------------------------------------------------------------


@query
def target_clusters(spark, sf):
    return cluster.cluster_targets(view(spark, sf, "targets"), list_cols=LISTS).select("row_id", "cluster")


@query
def cluster_order(spark, sf):
    clustered = cluster.cluster_targets(_weighted(spark, sf), list_cols=MODES)
    out = cluster.order_clusters(clustered, MODES, digits=6)
    return longs(out, "cluster_rank")


@query
def near_duplicates(spark, sf):
    return cluster.drop_near_duplicates(view(spark, sf, "targets"), list_cols=LISTS).select("row_id", "list_no")


@query
def pointing_groups(spark, sf):
    out = cluster.group_pointings(view(spark, sf, "pointings"), list_cols=[], row_id="ppc_no")
    return out.select("ppc_no", "group_id")


# --- planning -----------------------------------------------------------------------


def _flat_weights(spark, sf):
    counted = density.local_density(completion.with_required_exposure(view(spark, sf, "targets"), T), [])
    return counted.withColumn(
        "weight", F.round(density.target_weight(F.col("priority"), F.col("exptime_req"), F.col("local_count"), T), 9)
    )


@query
def topk_allocation(spark, sf):
    weighted, _ = stage(_flat_weights(spark, sf).select("ob_code", "ra", "dec", "priority", "weight"), "weighted")
    out = allocation.fill_positions(weighted, view(spark, sf, "pointings"), [], capacity=100, n_targets=table(spark, sf, "orders").count())
    return out.select("ppc_code", "ob_code", F.col("rank").cast("bigint").alias("rank"))


@query
def shifted_pointings(spark, sf):
    # the given fields moved off their targets in declination, so that some of them need a shift
    off = view(spark, sf, "pointings").withColumn("ppc_dec", F.col("ppc_dec") + F.when(F.col("ppc_no") % 2 == 0, 1.62).otherwise(-1.62))
    targets = view(spark, sf, "targets")
    filled = spatial.occupied_pointings(targets, off, []).select("ppc_code").distinct()
    empty = off.join(filled, "ppc_code", "left_anti")
    out = allocation.shift_empty_pointings(empty, targets, [])
    return rounded(longs(out.select("ppc_code", "shift_no", "ppc_ra", "ppc_dec"), "shift_no"), 6, "ppc_ra", "ppc_dec")


def _every_list(spark, sf):
    """The given pointings for each list."""
    return view(spark, sf, "pointings").withColumn("list_no", F.explode(F.sequence(F.lit(0), F.lit(9))))


@query
def user_pointing_plan(spark, sf):
    """Given pointings, all-or-nothing assignment: no pointing is looked for."""
    plan = pointing_plan.plan_pointings(view(spark, sf, "targets"), _every_list(spark, sf), LISTS, T)
    return rounded(plan.pointings.select("list_no", "ppc_code", "resolution", "n_assigned", "tel_fiber_usage_frac"), 6, "tel_fiber_usage_frac")


@query
def plan_pointings(spark, sf):
    plan = pointing_plan.plan_pointings(view(spark, sf, "targets"), None, LISTS, T)
    return plan.pointings.select("list_no", "resolution", "ppc_code", "ppc_ra", "ppc_dec", "n_assigned", "tel_fiber_usage_frac", "ppc_priority")


def _invariants(plan: pointing_plan.Plan, capacity: int) -> DataFrame:
    """What every plan has to keep, per list and resolution: frames placed and left over, and counts of what breaks it.

    ``n_would_fit`` are targets left out though enough of the pointings that cover them have room.
    """
    keys = [*LISTS, "resolution"]
    bridge, targets = plan.bridge, plan.targets
    # targets inside the fields of each position; pointings at one position are counted
    at = [*keys, *spatial.POSITION]
    spots = plan.pointings.select(*at, "ppc_code")
    places, _ = stage(spots.select(*at).distinct(), "places")
    inside = spatial.targets_in_fields(targets, places, keys, pointing_keep=spatial.POSITION, copies=False)
    inside, _ = stage(inside.distinct(), "inside")
    got = bridge.groupBy(*keys, "ob_code").agg(F.count(F.lit(1)).alias("got"))
    used = bridge.groupBy(*keys, "ppc_code").agg(F.count(F.lit(1)).alias("n"))
    left = targets.select(*keys, "ob_code", "frames").join(got, [*keys, "ob_code"], "left_anti")
    roomy = spots.join(used.where(F.col("n") >= capacity), [*keys, "ppc_code"], "left_anti").groupBy(*at).agg(F.count(F.lit(1)).alias("n_roomy"))
    room = inside.join(left, [*keys, "ob_code"]).join(roomy, at)
    broken = {
        "n_outside": bridge.join(by_key(spots, plan.pointings.count()), [*keys, "ppc_code"], "left").join(inside, [*at, "ob_code"], "left_anti"),
        "n_repeated": bridge.groupBy(*keys, "ppc_code", "ob_code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "n_over_capacity": used.where(F.col("n") > capacity),
        "n_partial": got.join(targets.select(*keys, "ob_code", "frames"), [*keys, "ob_code"]).where("got <> frames"),
        "n_would_fit": room.groupBy(*keys, "ob_code", "frames").agg(F.sum("n_roomy").alias("n")).where("n >= frames"),
        "n_placed": got,
        "n_left": plan.ledger,
        "frames_placed": bridge,
    }
    out = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_targets"), F.sum("frames").cast("bigint").alias("frames_asked"))
    out = out.join(plan.ledger.groupBy(*keys).agg(F.sum("frames_left").alias("frames_left")), keys, "left")
    for name, rows in broken.items():
        out = out.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    return out.select(
        *keys, "n_targets", "frames_asked", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("frames_left", *broken)]
    )


@query
def user_plan_invariants(spark, sf):
    """The given pointings again: every target that lies in enough of them is placed whole, nothing else."""
    return _invariants(pointing_plan.plan_pointings(view(spark, sf, "targets"), _every_list(spark, sf), LISTS, T), pointing_plan.CAPACITY)


@query
def plan_invariants(spark, sf):
    """A plan of all lists: every frame is placed, and fields, capacity and whole targets are kept."""
    return _invariants(pointing_plan.plan_pointings(view(spark, sf, "targets"), None, LISTS, T), pointing_plan.CAPACITY)


@query
def plan_ledger(spark, sf):
    """Frames of the targets that the given pointings leave out, with the reason."""
    plan = pointing_plan.plan_pointings(view(spark, sf, "targets"), _every_list(spark, sf), LISTS, T)
    return plan.ledger.select("list_no", "resolution", "ob_code", *[F.col(c).cast("bigint").alias(c) for c in ("frames", "frames_left", "n_fields", "n_free")], "reason")


# --- reproduction -------------------------------------------------------------------


@query
def reproduce_report(spark, sf):
    targets, pointings, (links, n_links) = _modes(spark, sf)
    n = pointings.groupBy("ppc_resolution").agg(F.count(F.lit(1)).alias("_n")).select(
        reports.resolution_name("ppc_resolution").alias("resolution"), F.col("_n").alias("N_ppc")
    )
    given = n.select("resolution", F.when(F.col("resolution") == "low", F.floor(F.col("N_ppc") / 2)).otherwise(0).cast("bigint").alias("N_ppc"))
    stored = reports.reproduce_report(targets, pointings, links, n, given, None, T, [], n_links)
    return rounded(reports.with_total_row(stored, []), 6, *SUMMARY_FIGURES)
