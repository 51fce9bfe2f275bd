"""Planning invariants, and results that do not depend on partitions or on other lists."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skyloom.operators import allocation, checks, cluster, completion, density, flux, ordered, reports, spatial, visibility
from skyloom.plans import pointing_plan, validation

LISTS = ["list_no"]


@pytest.fixture(scope="module")
def plan(targets):
    return pointing_plan.plan_pointings(targets.where("list_no in (0, 1)"), None, LISTS, capacity=8)


def test_plan_completes_every_target(plan, targets):
    assert plan.status == 999 and plan.n_unfinished == 0
    need = {r.ob_code: math.ceil(r.exptime / 900) for r in targets.where("list_no in (0, 1)").collect()}
    links = [(r.ppc_code, r.list_no, r.resolution, r.ob_code) for r in plan.bridge.collect()]
    assert len(set(links)) == len(links)
    got = {}
    for link in links:
        got[link[3]] = got.get(link[3], 0) + 1
    assert got == need


def test_plan_respects_capacity_and_field(plan, targets):
    keys = ["list_no", "resolution"]
    held = plan.bridge.groupBy(*keys, "ppc_code").count()
    assert held.where("count > 8").count() == 0
    stats = plan.pointings.join(held, [*keys, "ppc_code"]).collect()
    assert all(r.n_assigned == r["count"] and abs(r.tel_fiber_usage_frac - r["count"] / 2394 * 100) < 1e-9 for r in stats)
    assert plan.pointings.where("n_assigned = 0").count() == 0
    inside = spatial.targets_in_fields(plan.targets, plan.pointings, keys)
    assert plan.bridge.join(inside, [*keys, "ppc_code", "ob_code"], "left_anti").count() == 0


def test_plan_curves(plan):
    final = pointing_plan.plan_completion(plan, list_cols=LISTS)
    best = final.groupBy("list_no", "resolution", "priority").agg(F.max("n_pct").alias("n"), F.max("fh_pct").alias("f"))
    assert all(r.n == 100.0 and abs(r.f - 100.0) < 1e-9 for r in best.collect())
    progress = pointing_plan.plan_progress(plan, list_cols=LISTS).where("priority = 'all'").orderBy("list_no", "resolution", "ppc_id").collect()
    for a, b in zip(progress, progress[1:]):
        if (a.list_no, a.resolution) == (b.list_no, b.resolution):
            assert b.n >= a.n and b.fh >= a.fh


def test_round_pointings_are_apart(targets):
    weighted = pointing_plan.weighted_targets(targets.where("list_no = 3"), 900.0, LISTS)
    peaks = pointing_plan.separate_peaks(weighted.withColumn("cluster", F.lit(0)), [*LISTS, "cluster"])
    rows = peaks.select("ppc_ra", "ppc_dec").collect()
    assert rows
    from tests.test_sky import sep

    assert all(sep(a, b) > 1.38 for i, a in enumerate(rows) for b in rows[:i])


def test_all_or_nothing(spark):
    t = spark.createDataFrame(
        [(1, "two", 10.0, 0.0, 0, 1.0, 2), (1, "three", 10.1, 0.0, 5, 1.0, 3), (1, "one", 10.0, 0.1, 9, 1.0, 1), (1, "away", 50.0, 0.0, 0, 1.0, 1)],
        "g int, ob_code string, ra double, dec double, priority int, weight double, frames int",
    )
    p = spark.createDataFrame([(1, f"p{i}", 10.0, 0.0, 0.0) for i in range(2)], "g int, ppc_code string, ppc_ra double, ppc_dec double, ppc_pa double")
    got = lambda cap: sorted((r.ob_code, r.ppc_code) for r in allocation.assign_visits(t, p, ["g"], cap).collect())
    full = got(10)
    assert [c for c, _ in full].count("two") == 2 and not any(c == "three" for c, _ in full) and [c for c, _ in full].count("one") == 1
    assert [c for c, _ in got(1)] == ["two", "two"]  # the costly target takes both fibres


def test_user_pointings(targets, pointings):
    mine = targets.where("list_no = 3")
    given = pointings.withColumn("list_no", F.lit(3))
    plan = pointing_plan.plan_pointings(mine, given, LISTS)
    assert plan.status == 2
    assert plan.pointings.count() == pointings.count()
    assert plan.pointings.where("n_assigned > 0").count() > 0
    need = plan.targets.select("ob_code", "frames")
    partial = plan.bridge.groupBy("ob_code").count().join(need, "ob_code").where("count <> frames")
    assert partial.count() == 0


def test_empty_pointing_is_shifted(spark):
    t = spark.createDataFrame([("a", 10.0, 0.72)], "ob_code string, ra double, dec double")
    p = spark.createDataFrame([("p", 10.0, 0.0, 0.0), ("q", 100.0, 0.0, 0.0)], "ppc_code string, ppc_ra double, ppc_dec double, ppc_pa double")
    out = {r.ppc_code: r for r in allocation.shift_empty_pointings(p, t, []).collect()}
    assert out["p"].shift_no == 2 and out["p"].ppc_dec == 0.15
    assert out["q"].shift_no is None and out["q"].ppc_ra == 100.0


def test_completion_against_a_loop(spark, targets, pointings):
    from workload.queries import _stored_pointings
    from workload.views import view

    sf = "/root/testdata/sf0.001"
    need = completion.with_required_exposure(targets, 900.0)
    ranked = completion.rank_pointings(_stored_pointings(spark, sf), [])
    bridge = view(spark, sf, "allocations")
    curve = {(r.ppc_id, r.priority): r for r in completion.completion_curve(need, ranked, bridge, 900.0, []).collect()}
    info = {r.ob_code: (r.priority, r.exptime_req) for r in need.collect()}
    held = {}
    for r in bridge.collect():
        held.setdefault(r.ppc_code, set()).add(r.ob_code)
    given = dict.fromkeys(info, 0.0)
    for r in ranked.orderBy("ppc_id").collect():
        for code in held[r.ppc_code]:
            if code in given:
                given[code] += 900.0
        for p in ["all", *map(str, range(10))]:
            codes = [c for c, (q, _) in info.items() if p in ("all", str(q))]
            fh = sum(given[c] for c in codes) / 3600
            done = sum(given[c] >= info[c][1] for c in codes)
            row = curve[(r.ppc_id, p)]
            assert row.n == done and abs(row.fh - fh) < 1e-9
            assert abs(row.fh_pct - fh / (sum(info[c][1] for c in codes) / 3600) * 100) < 1e-9
    assert len(curve) == ranked.count() * 11


def test_links_are_told_apart_once(spark):
    """The summary reads stored allocations: no table of millions of links is made again to find copies."""
    from workload.queries import _summary

    plan = _summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "lineitem" in x]
    assert not [x for x in plan if "Aggregate [" in x and "ob_code" in x.split("], [")[0] and "ppc_code" in x.split("], [")[0]]


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks are bounded in links, and the curve is that of undealt links, with or without copies."""
    keys = ["g", "ppc_resolution"]
    need = spark.sql(
        "select cast(id % 2 as int) as g, if(id % 3 = 0, 'L', 'M') as ppc_resolution, concat('t', id) as ob_code, cast(id % 4 as int) as priority, "
        "cast(1 + id % 3 as int) as frames, 900D * (1 + id % 3) as exptime_req from range(60)"
    )
    spots = spark.sql("select cast(id % 2 as int) as g, m as ppc_resolution, concat('p', id % 10) as ppc_code, 1D + id as ppc_priority from range(20) lateral view explode(array('L', 'M')) as m")
    ranked = completion.rank_pointings(spots, keys)
    links = spark.sql("select cast(t.id % 2 as int) as g, concat('p', p.id) as ppc_code, concat('t', t.id) as ob_code from range(60) t join range(10) p on (t.id * 7 + p.id) % 3 = 0")
    want = rows(completion.completion_curve(need, ranked, links.join(spots, ["g", "ppc_code"]).select(*keys, "ppc_code", "ob_code"), 900.0, keys))
    monkeypatch.setattr(ordered, "TASK_ROWS", 20)
    seen, dealt = [], completion.dealt
    monkeypatch.setattr(completion, "dealt", lambda df, *a: seen.append(dealt(df, *a)) or seen[-1])
    assert rows(completion.completion_curve(need, ranked, links, 900.0, keys, links.count())) == want
    assert [df.rdd.getNumPartitions() for df in seen] == [10, 10]
    assert rows(completion.completion_curve(need, ranked, links.union(links), 900.0, keys)) == want
    assert max(r.n for r in completion.completion_curve(need, ranked, links, 900.0, keys, links.count()).collect()) > 0


def test_allocations_are_told_apart_in_small_tasks(spark, monkeypatch, tmp_path):
    """Files of many short rows: their pieces are bounded in rows, not only in bytes."""
    from workload import views

    whole = "/root/testdata/sf0.001"
    spark.read.parquet(f"{whole}/lineitem.parquet").repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    links = views.view(spark, str(tmp_path), "allocations")
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "RepartitionByExpression [l_orderkey" in x and x.rstrip().endswith(", 12")]
    assert rows(links) == rows(views.view(spark, whole, "allocations"))


def test_no_pointings_no_curve(targets, spark):
    need = completion.with_required_exposure(targets, 900.0)
    nothing = spark.createDataFrame([], "ppc_code string, ppc_id long")
    links = spark.createDataFrame([], "ppc_code string, ob_code string")
    assert completion.completion_curve(need, nothing, links, 900.0, []).count() == 0


def test_zero_pointings_report(spark, targets):
    from workload.queries import _modes
    from workload.views import view

    sf = "/root/testdata/sf0.001"
    t, p, _ = _modes(spark, sf)
    stored = spark.createDataFrame([("low", 0), ("medium", 2)], "resolution string, N_ppc long")
    rows = {r.resolution: r for r in reports.reproduce_report(t, p, view(spark, sf, "allocations"), stored, None, None, 900.0, []).collect()}
    assert rows["low"].N_ppc == 0 and rows["low"]["Used fiber fraction (%)"] == 0.0 and rows["low"].P_all == 0.0
    assert rows["medium"].N_ppc == 2 and rows["medium"].P_all > 0
    hours = spark.createDataFrame([("L", 0.4), ("M", 0.4)], "ppc_resolution string, request_hours double")
    cut = reports.reproduce_report(t, p, view(spark, sf, "allocations"), stored, None, hours, 900.0, []).collect()
    assert {r.N_ppc for r in cut} == {1}


DAYS = (dt.date(2026, 4, 10), dt.date(2026, 4, 12))


def operators(t):
    """Results of operators on many lists, as comparable frames."""
    w = pointing_plan.weighted_targets(t, 900.0, LISTS)
    fields = t.where("row_id % 97 = 0").select(
        "list_no", F.col("ob_code").alias("ppc_code"), F.col("ra").alias("ppc_ra"), F.col("dec").alias("ppc_dec"), F.lit(0.0).alias("ppc_pa"), "row_id"
    )
    return {
        "unique": checks.unique_flags(t.withColumn("ob_code", F.when(F.col("row_id") % 3 == 0, "same").otherwise(F.col("ob_code"))), LISTS).select("row_id", "ok_unique"),
        "values": checks.value_flags(t, LISTS, "list").select("row_id", "ok_values"),
        "flux": flux.filters_in_use(flux.resolve_flux(t), LISTS),
        "summary": reports.target_summary(t, LISTS).select("list_no", "Priority", "N (L)", "N (M)"),
        "visible": visibility.visibility_flags(t, *DAYS, LISTS).select("row_id", "ok_visible"),
        "report": validation.validate(t, *DAYS, LISTS).report,
        "weight": w.select("row_id", F.round("weight", 9).alias("w")),
        "peak": density.density_peak(w, LISTS, digits=6).select("list_no", F.round("peak_ra", 6).alias("x"), F.round("peak_dec", 6).alias("y")),
        "clusters": cluster.cluster_targets(t, list_cols=LISTS).select("row_id", "cluster"),
        "duplicates": cluster.drop_near_duplicates(t, list_cols=LISTS).select("row_id"),
        "groups": cluster.group_pointings(fields, list_cols=LISTS).select("row_id", "group_id"),
        "fields": spatial.targets_in_fields(t, fields, LISTS),
    }


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lists_are_independent_and_partitions_do_not_matter(targets):
    some = targets.where("list_no in (4, 5)")
    together = {k: rows(v) for k, v in operators(some).items()}
    apart = [operators(targets.where(F.col("list_no") == n)) for n in (4, 5)]
    for name, want in together.items():
        assert sorted(sum((rows(a[name]) for a in apart), [])) == want, name
    for n in (1, 37):
        shuffled = operators(some.orderBy(F.xxhash64("row_id")).repartition(n))
        for name, want in together.items():
            assert rows(shuffled[name]) == want, (name, n)
