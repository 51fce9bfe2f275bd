"""Documented good and bad cases of the row checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyloom.operators import checks, flux
from skyloom.plans import validation


def uniq(spark, rows):
    df = spark.createDataFrame(rows, "list_no int, ob_code string, obj_id long, resolution string")
    flagged = checks.unique_flags(df, ["list_no"])
    status = {r.list_no: r.status for r in checks.unique_status(flagged, ["list_no"]).collect()}
    return {(r.list_no, r.ob_code): r.ok_unique for r in flagged.collect()}, status


def test_uniqueness_cases(spark):
    rows = [
        (1, "ob_1", 1, "L"), (1, "ob_2", 2, "L"),  # good
        (2, "ob_1_L_1", 1, "L"), (2, "ob_1_L_2", 1, "L"),  # same object and resolution
        (3, "ob_1_L", 1, "L"), (3, "ob_1_M", 1, "M"),  # good: two resolutions
        (4, "ob", 1, "L"), (4, "ob", 2, "L"), (4, "other", 3, "L"),  # repeated code
        (5, "ob_1", None, "L"), (5, "ob_2", None, "L"), (5, "ob_3", 1, None),  # nulls repeat each other
    ]
    flags, status = uniq(spark, rows)
    assert status == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert not flags[(2, "ob_1_L_1")] and not flags[(2, "ob_1_L_2")]
    assert not flags[(4, "ob")] and flags[(4, "other")]
    assert not flags[(5, "ob_1")] and not flags[(5, "ob_2")] and flags[(5, "ob_3")]


def test_empty_list_fails_uniqueness(spark):
    df = spark.createDataFrame([(1, "a", 1, "L")], "list_no int, ob_code string, obj_id long, resolution string")
    lists = spark.createDataFrame([(1,), (2,)], "list_no int")
    out = {r.list_no: r for r in checks.unique_status(checks.unique_flags(df, ["list_no"]), ["list_no"], lists).collect()}
    assert out[1].status and not out[2].status
    assert out[2].description.endswith("no rows")


VALUE_SCHEMA = "row_id long, list_no int, ra double, dec double, priority int, exptime double, resolution string, reference_arm string"


def test_value_rules(spark):
    good = (0.0, -90.0, 0, 1.0, "L", "b")
    bad = {
        "ra": [(-0.1, 0.0, 0, 1.0, "L", "b"), (360.1, 0.0, 0, 1.0, "L", "b"), (None, 0.0, 0, 1.0, "L", "b"), (float("nan"), 0.0, 0, 1.0, "L", "b")],
        "dec": [(0.0, 90.1, 0, 1.0, "L", "b")],
        "priority": [(0.0, 0.0, 10, 1.0, "L", "b"), (0.0, 0.0, -1, 1.0, "L", "b")],
        "exptime": [(0.0, 0.0, 0, 0.0, "L", "b"), (0.0, 0.0, 0, float("nan"), "L", "b")],
        "resolution": [(0.0, 0.0, 0, 1.0, "H", "b"), (0.0, 0.0, 0, 1.0, None, "b")],
        "reference_arm": [(0.0, 0.0, 0, 1.0, "L", "m"), (0.0, 0.0, 0, 1.0, "M", "r"), (0.0, 0.0, 0, 1.0, "L", "x"), (0.0, 0.0, 0, 1.0, "L", None)],
    }
    rows, want = [(0, 0, *good), (1, 0, 360.0, 90.0, 9, 1.0, "M", "m")], {0: None, 1: None}
    for column, cases in bad.items():
        for case in cases:
            want[len(rows)] = column
            rows.append((len(rows), 0, *case))
    out = checks.value_flags(spark.createDataFrame(rows, VALUE_SCHEMA), ["list_no"]).collect()
    for r in out:
        failed = [c for c in checks.VALUE_COLUMNS if not r[f"ok_{c}"]]
        assert failed == ([want[r.row_id]] if want[r.row_id] else []), r
        assert r.ok_values == (not failed)


def test_arm_scope(spark):
    rows = [(0, 1, 0.0, 0.0, 0, 1.0, "L", "m"), (1, 1, 0.0, 0.0, 0, 1.0, "L", "b"), (2, 2, 0.0, 0.0, 0, 1.0, "L", "b")]
    df = spark.createDataFrame(rows, VALUE_SCHEMA)
    flag = {s: {r.row_id: r.ok_reference_arm for r in checks.value_flags(df, ["list_no"], s).collect()} for s in ("row", "list")}
    assert flag["row"] == {0: False, 1: True, 2: True}
    assert flag["list"] == {0: False, 1: False, 2: True}
    with pytest.raises(ValueError):
        checks.value_flags(df, ["list_no"], "table")


def test_strings(spark):
    df = spark.createDataFrame(
        [("a_b+c-d.1", "L", "b"), ("a b", "L", "b"), ("", "L", "b"), ("ok", None, "b"), ("é", "L", "b")],
        "ob_code string, resolution string, reference_arm string",
    )
    assert [r.ok_str for r in checks.string_flags(df).collect()] == [True, False, False, False, False]


FLUX_SCHEMA = "ob_code int, g_hsc double, g_hsc_error double, i2_hsc double, i2_hsc_error double, g_ps1 double, g_ps1_error double"


def test_flux_cases(spark):
    df = spark.createDataFrame(
        [
            (1, 10000.0, 100.0, None, None, None, None),
            (2, 20000.0, 200.0, 20000.0, None, None, None),
            (3, 35000.0, 350.0, None, None, 30000.0, 300.0),
            (4, None, None, None, None, 30000.0, float("nan")),
            (5, float("inf"), None, float("nan"), None, None, None),
        ],
        FLUX_SCHEMA,
    )
    out = {r.ob_code: r for r in flux.resolve_flux(df).collect()}
    assert (out[1].filter_g, out[1].flux_g, out[1].flux_error_g) == ("g_hsc", 10000.0, 100.0)
    assert (out[2].filter_i, out[2].flux_i, out[2].flux_error_i) == ("i2_hsc", 20000.0, None)
    assert (out[3].filter_g, out[3].flux_g) == ("g_hsc", 35000.0)
    assert (out[4].filter_g, out[4].flux_error_g) == ("g_ps1", None)
    assert not out[5].ok_flux and all(out[i].ok_flux for i in (1, 2, 3, 4))
    skipped = flux.skipped_fluxes(flux.resolve_flux(df), ["ob_code"]).collect()
    assert [tuple(r) for r in skipped] == [(3, "g", "g_hsc", "g_ps1")]
    kept = flux.prune_bands(flux.resolve_flux(df)).columns
    assert "filter_g" in kept and "flux_error_g" in kept and "filter_i" in kept
    assert "flux_error_i" not in kept and "filter_r" not in kept and "flux_z" not in kept


def test_leftmost_follows_the_header_of_each_list(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0, ["g_hsc", "g_ps1"]), (2, 1.0, 2.0, ["g_ps1", "g_hsc"]), (3, 1.0, 2.0, ["g_ps1"])],
        "ob_code int, g_hsc double, g_ps1 double, header array<string>",
    )
    out = {r.ob_code: r.filter_g for r in flux.resolve_flux(df, "header").collect()}
    assert out == {1: "g_hsc", 2: "g_ps1", 3: "g_ps1"}


def test_columns_and_defaults(spark):
    df = spark.createDataFrame([(1, 7, "x")], "list_no int, obj_id long, comment string")
    r = checks.check_columns(checks.list_headers(df, ["list_no"]), ["list_no"]).first()
    assert r.required_found == ["obj_id"] and "reference_arm" in r.required_missing and not r.required_ok
    assert "optional, absent: parallax, filled with 1e-07" in r.messages
    assert checks.keep_registered(df, ["list_no"]).columns == ["list_no", "obj_id"]
    assert checks.with_object_text(df).columns == ["list_no", "obj_id", "obj_id_str", "comment"]
    filled = checks.fill_optional(df).first()
    assert (filled.pmra, filled.parallax, filled.tract) == (0.0, 1e-7, None)
    assert "comment" not in checks.drop_empty_columns(df.withColumn("comment", F.lit(None).cast("string"))).columns


def test_validation_stops_at_the_first_failing_stage(spark, targets):
    days = (dt.date(2026, 4, 10), dt.date(2026, 4, 12))
    some = targets.where("list_no in (0, 1, 2)").withColumn(
        "ob_code", F.when((F.col("list_no") == 0) & (F.col("row_id") % 50 == 0), "bad code").otherwise(F.col("ob_code"))
    ).withColumn("exptime", F.when(F.col("list_no") == 1, 0.0).otherwise(F.col("exptime")))
    v = validation.validate(some, *days, ["list_no"])
    by_list = {r.list_no: r for r in v.status.collect()}
    n_bad = some.where("ob_code = 'bad code'").count()
    assert n_bad and by_list[0].status_str is False and by_list[0].n_bad_str == n_bad and by_list[0].status_values is None
    assert by_list[1].status_values is False and by_list[1].status_flux is None
    assert by_list[2].status_flux is False and by_list[2].label == "failed"
    rows = v.rows
    assert rows.where("list_no = 0 and ok_values is not null").count() == 0
    assert rows.where("list_no = 1 and ok_flux is not null").count() == 0
    assert rows.where("list_no = 2 and ok_unique is null").count() == 0
    checks_of = lambda n: [r.check for r in v.report.where(F.col("list_no") == n).collect()]
    assert checks_of(0) == ["required_columns", "optional_columns", "strings"]
    assert len(checks_of(2)) == 7
    assert "list_no" in v.cleaned(["list_no"]).columns and "g_hsc" not in v.cleaned(["list_no"]).columns


def test_validation_without_required_column(spark, targets):
    v = validation.validate(targets.drop("reference_arm"), dt.date(2026, 4, 10), dt.date(2026, 4, 12), ["list_no"])
    report = v.report.where("list_no = 3").collect()
    assert [(r.check, r.severity, r.detail) for r in report][0] == ("required_columns", "error", "reference_arm")
    assert len(report) == 2


def test_clean_list_succeeds(spark, targets):
    clean = targets.where("g_hsc is not null or g_ps1 is not null or r2_hsc is not null")
    v = validation.validate(checks.fill_optional(clean), dt.date(2026, 2, 1), dt.date(2026, 7, 31), ["list_no"])
    assert {r.label for r in v.status.collect()} == {"success"}
    v = validation.validate(clean, dt.date(2026, 2, 1), dt.date(2026, 7, 31), ["list_no"])
    assert {r.label for r in v.status.collect()} == {"success_with_warnings"}
