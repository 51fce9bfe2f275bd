"""Geometry, clusters, density and visibility against plain Python on small inputs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.sky import cells_around, cell_of, sky_pixel
from skyloom.functions import timing
from skyloom.operators import allocation, cluster, density, ordered, spatial, visibility


def sep(a, b):
    r1, d1, r2, d2 = map(math.radians, (*a, *b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


def components(points, eps, strict=False):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            d = sep(points[i], points[j])
            if d < eps or (d == eps and not strict):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def frame(spark, points):
    return spark.createDataFrame([(i, float(r), float(d)) for i, (r, d) in enumerate(points)], "row_id long, ra double, dec double")


def cloud(kind, rng, n=250):
    if kind == "sphere":
        return [(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(4 * n)]
    if kind == "pole":
        return [(rng.uniform(0, 360), 90 - abs(rng.gauss(0, 4))) for _ in range(n)]
    if kind == "border":
        return [(rng.gauss(0, 3) % 360, rng.uniform(-6, 6)) for _ in range(n)]
    if kind == "chain":
        return [(0.9 * i % 360, 30 + 0.01 * i) for i in range(n)]
    # dense spots whose gaps are close to the limit
    spots = [(10.0, 0.0), (12.3, 0.0), (14.62, 0.3), (10.0, 2.35), (20.0, 5.0)]
    return [(r + rng.uniform(-0.46, 0.46), d + rng.uniform(-0.46, 0.46)) for r, d in spots for _ in range(n)]


@pytest.mark.parametrize("kind", ["sphere", "pole", "border", "chain", "spots"])
def test_components_match_brute_force(spark, kind):
    points = cloud(kind, random.Random(kind))
    eps = 3.0 if kind == "sphere" else 1.38
    got = cluster.components(frame(spark, points), eps, [])
    assert [r.cluster for r in got.orderBy("row_id").collect()] == components(points, eps)


def test_undecided_cells_are_refined(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PAIR_WORK", 16)
    rng = random.Random(5)
    points = [(r + rng.uniform(0, 0.4), rng.uniform(0, 0.4)) for r in (10.0, 11.75, 13.51, 15.4) for _ in range(120)]
    got = cluster.components(frame(spark, points), 1.38, [])
    assert [r.cluster for r in got.orderBy("row_id").collect()] == components(points, 1.38)


def test_near_duplicates_keep_the_first_row(spark):
    s = 1 / 3600.0
    points = [(10, 0), (10 + 1.5 * s, 0), (10 + 3 * s, 0), (10 + 8 * s, 0), (10, 0), (11, 60), (11 + 2.0 * s / math.cos(math.radians(60)) * 1.001, 60)]
    kept = cluster.drop_near_duplicates(frame(spark, points), list_cols=[]).collect()
    assert sorted(r.row_id for r in kept) == [0, 3, 5, 6]


def test_cells_miss_no_pair(spark):
    rng = random.Random(1)
    points = cloud("sphere", rng, 100) + cloud("pole", rng, 60) + cloud("border", rng, 60)
    df = frame(spark, points)
    for eps in (0.69, 5.0):
        left = df.select(F.col("row_id").alias("i"), F.col("ra").alias("l_ra"), F.col("dec").alias("l_dec"))
        right = df.select(F.col("row_id").alias("j"), F.col("ra").alias("r_ra"), F.col("dec").alias("r_dec"))
        got = {(r.i, r.j) for r in spatial.near_pairs(left, right, eps, []).where("i < j").collect()}
        want = {(i, j) for j in range(len(points)) for i in range(j) if sep(points[i], points[j]) <= eps}
        assert got == want
    assert df.select(F.size(cells_around("ra", "dec", 50.0)).alias("n"), cell_of("ra", "dec", 50.0)).where("n > 9").count() == 0


def test_pixels_have_equal_area(spark):
    rng = np.random.default_rng(3)
    n = 200_000
    pts = spark.createDataFrame(
        [(float(a), float(d)) for a, d in zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))))], "ra double, dec double"
    )
    counts = [r["count"] for r in pts.groupBy(sky_pixel("ra", "dec", 8).alias("p")).count().collect()]
    assert len(counts) == 12 * 64
    mean = n / 768
    assert abs(np.std(counts) / math.sqrt(mean) - 1) < 0.15


def test_outline_is_a_hexagon(spark, pointings):
    rows = spatial.field_outline(pointings).join(pointings, "ppc_code").collect()
    by_code = {}
    for r in rows:
        assert abs(sep((r.vertex_ra, r.vertex_dec), (r.ppc_ra, r.ppc_dec)) - 0.69) < 1e-9
        by_code.setdefault(r.ppc_code, {})[r.vertex] = (r.vertex_ra, r.vertex_dec)
    for v in by_code.values():
        for k in range(6):
            assert abs(sep(v[k], v[(k + 1) % 6]) - 0.69) < 1e-4


def test_field_across_the_border(spark):
    targets = spark.createDataFrame([("w", 359.7, 0.0), ("e", 0.3, 0.0), ("far", 1.0, 0.0)], "ob_code string, ra double, dec double")
    field = spark.createDataFrame([("p", 0.0, 0.0, 0.0)], "ppc_code string, ppc_ra double, ppc_dec double, ppc_pa double")
    hits = lambda **k: sorted(r.ob_code for r in spatial.targets_in_fields(targets, field, [], **k).collect())
    assert hits() == ["e", "w"]
    assert hits(wrap=False) == ["e"]


def test_density_of_a_small_field_matches_a_dense_grid(spark):
    rng = random.Random(2)
    rows = [(1, rng.uniform(100, 102), rng.uniform(-1, 1), rng.uniform(1, 3)) for _ in range(60)] + [(2, 50.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, ra double, dec double, weight double")
    field = [r for r in rows if r[0] == 1]
    ra = [r[1] for r in field]
    dec = [r[2] for r in field]
    xs = np.linspace(min(min(ra) * 0.9, min(ra) - 1), max(max(ra) * 1.1, max(ra) + 1), 101)
    ys = np.linspace(min(min(dec) * 0.9, min(dec) - 1), max(max(dec) * 1.1, max(dec) + 1), 101)
    z = np.zeros((101, 101))
    for _, r, d, w in field:
        dist = np.array([[sep((r, d), (x, y)) for y in ys] for x in xs])
        z += w * np.maximum(0, 1 - dist / 0.69)
    got = {(r.ix, r.iy): r.z for r in density.density_map(df, ["g"]).where("g = 1").collect()}
    for i in range(101):
        for j in range(101):
            assert abs(got.get((i, j), 0.0) - z[i, j]) < 1e-9
    peak = {r.g: r for r in density.density_peak(df, ["g"]).collect()}
    sig = (z - z.mean()) / z.std()
    i, j = np.unravel_index(sig.argmax(), sig.shape)
    assert abs(peak[1].peak_ra - xs[i]) < 1e-9 and abs(peak[1].peak_dec - ys[j]) < 1e-9
    assert abs(peak[1].significance - sig.max()) < 1e-6
    assert (peak[2].peak_ra, peak[2].peak_dec, peak[2].significance) == (50.0, 5.0, None)


def test_observable_time_against_sampling(spark):
    rng = random.Random(4)
    day = dt.date(2026, 5, 3)
    points = [(rng.uniform(0, 360), rng.uniform(-60, 85)) for _ in range(60)]
    out = visibility.observable_seconds(frame(spark, points), day, day, mode="sum", single_exptime=0.0).collect()
    phi, lon = 19.8255, -155.4761
    begin = dt.datetime(2026, 5, 4, 4, 30, tzinfo=dt.timezone.utc).timestamp()
    for r in out:
        good = 0
        for minute in range(660):
            jd = (begin + 60 * minute + 30) / 86400 + 2440587.5
            h = math.radians(280.46061837 + 360.98564736629 * (jd - 2451545.0) + lon - r.ra)
            alt = math.degrees(math.asin(
                math.sin(math.radians(phi)) * math.sin(math.radians(r.dec)) + math.cos(math.radians(phi)) * math.cos(math.radians(r.dec)) * math.cos(h)
            ))
            good += 30 <= alt <= 85
        assert abs(r.seconds / 60 - good) <= 2.5


def test_calendars(spark):
    ranges = spark.createDataFrame([(dt.date(2026, 2, 1), dt.date(2026, 7, 31)), (dt.date(2026, 8, 1), dt.date(2027, 1, 31))], "date_begin date, date_end date")

    def missing(calendar, begin):
        every = {r.night for r in visibility.night_calendar(ranges).where(F.col("date_begin") == begin).collect()}
        return sorted(every - {r.night for r in visibility.night_calendar(ranges, calendar=calendar).where(F.col("date_begin") == begin).collect()})

    assert missing("split", dt.date(2026, 2, 1)) == [dt.date(2026, 5, 2)]
    assert missing("split_time", dt.date(2026, 8, 1)) == [dt.date(2026, 10, 31), dt.date(2027, 1, 31)]
    first = visibility.night_calendar(ranges).where("night = date'2026-02-01'").select(
        F.date_format("begin_utc", "yyyy-MM-dd HH:mm").alias("b"), F.date_format("end_utc", "yyyy-MM-dd HH:mm").alias("e")
    ).first()
    assert tuple(first) == ("2026-02-02 04:30", "2026-02-02 15:30")


def test_request_time_anchors(spark):
    df = spark.createDataFrame([(1,), (10,), (105,)], "n int").withColumn("rot", timing.request_hours("n", 900.0))
    rows = df.withColumn("back", timing.frames_in_hours("rot", 900.0)).collect()
    assert [round(r.rot, 6) for r in rows] == [0.378788, 3.787879, 39.772727]
    assert [r.back for r in rows] == [1, 10, 105]


def test_semesters(spark):
    days = {
        "2024-01-31": "S23B", "2024-02-01": "S24B", "2024-03-15": "S24B", "2024-03-16": "S24A", "2024-07-31": "S24A",
        "2024-08-01": "S25A", "2024-09-15": "S25A", "2024-09-16": "S24B",
    }
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", timing.semester_label(F.col("d").cast("timestamp")).alias("s"))
    assert {r.d: r.s for r in df.collect()} == days
    r = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d date").select(
        timing.semester_begin("d"), timing.semester_end("d"), timing.semester_begin("d", "current"), timing.semester_end("d", "current")
    ).first()
    assert tuple(r) == (dt.date(2024, 2, 1), dt.date(2024, 7, 31), dt.date(2023, 8, 1), dt.date(2024, 1, 31))


def test_distributed_rank_and_running_sum_equal_the_window(spark):
    rng = random.Random(9)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 5), float(rng.randrange(20)), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, i int, w int")
    order = [F.col("v").desc(), F.col("i")]
    small = ordered.rank_rows(df, ["g"], order, "pos")
    large = ordered.rank_rows(df, ["g"], order, "pos", window_rows=10)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(small.columns).collect()))
    one = ordered.running_sum(small, ["g"], "pos", {"w": "s"}, top=3000)
    two = ordered.running_sum(small, ["g"], "pos", {"w": "s"}, block=37)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(one.columns).collect()))
    a = ordered.top_rows(df, ["g"], order, 7, "i", spread=1)
    b = ordered.top_rows(df, ["g"], order, 7, "i", spread=16)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_a_reversed_range_has_no_nights(spark):
    df = spark.sql("select 1 as k, date'2026-03-05' as a, date'2026-03-01' as b union all select 2, date'2026-03-01', date'2026-03-03' union all select 3, null, date'2026-03-03'")
    for calendar, n in (("all", 3), ("split", 2), ("split_time", 2)):
        nights = {r.k: r.n for r in df.select("k", F.size(visibility.night_dates(F.col("a"), F.col("b"), calendar)).alias("n")).collect()}
        assert nights == {1: 0, 2: n, 3: 0}


@pytest.mark.parametrize("calendar", ["all", "split", "split_time"])
def test_prefix_sums_equal_the_sum_night_by_night(spark, targets, calendar):
    first, last = dt.date(2026, 1, 30), dt.date(2026, 4, 20)
    positions = visibility.pixel_groups(targets, [])
    sums = visibility.visibility_sums(positions, first, last)
    assert {len(r.sums) for r in sums.select("sums").collect()} == {82}  # 81 nights and the start
    ranges = [(first, last), (first, first), (dt.date(2026, 2, 3), dt.date(2026, 3, 4)), (dt.date(2026, 2, 3), dt.date(2026, 3, 5)), (last, first)]
    for begin, end in ranges:
        got = positions.select("pixel").join(sums, "pixel").select("pixel", visibility.seconds_in_range(F.lit(begin), F.lit(end), calendar).alias("s"))
        nights = visibility.observable_seconds(positions, begin, end, calendar).groupBy("pixel").agg(F.sum("seconds").alias("s"))
        want = {r.pixel: r.s for r in nights.collect()}
        assert {r.pixel: r.s for r in got.collect()} == {r.pixel: want.get(r.pixel, 0) for r in positions.collect()}


def test_flags_from_prefix_sums(spark, targets):
    one = targets.where("list_no = 3")
    begin, end = dt.date(2026, 2, 1), dt.date(2026, 2, 9)
    sums = visibility.visibility_sums(visibility.pixel_groups(one, []), dt.date(2026, 1, 1), dt.date(2026, 3, 1))
    want = visibility.visibility_flags(one, begin, end, ["list_no"]).select("row_id", "ok_visible")
    got = visibility.visibility_flags(one, begin, end, ["list_no"], sums=sums).select("row_id", "ok_visible")
    assert sorted(got.collect()) == sorted(want.collect())
    assert 0 < want.where("ok_visible").count()
    # a pixel without sums is invisible, a null date too; a range outside of the calendar is an error
    assert visibility.visibility_flags(one, begin, end, ["list_no"], sums=sums.limit(0)).where("ok_visible").count() == 0
    undated = one.withColumns({"b": F.lit(None).cast("date"), "e": F.lit(end)})
    assert visibility.visibility_flags(undated, "b", "e", ["list_no"], sums=sums).where("ok_visible").count() == 0
    for bad in ((dt.date(2025, 12, 31), end), (begin, dt.date(2026, 3, 2))):
        with pytest.raises(Exception, match="leaves the calendar"):
            visibility.visibility_by_sums(one, sums, *bad, ["list_no"]).collect()
    with pytest.raises(ValueError):
        visibility.visibility_sums(one, end, begin, key="row_id")


def test_equal_positions_are_decided_once(spark, monkeypatch):
    rows = [(i, 10.0 + i % 4, 20.0 * (i % 3), 900.0 * (1 + i % 2), day) for i in range(240) for day in (dt.date(2026, 2, 1),)]
    targets = spark.createDataFrame([*rows, (900, None, 0.0, 900.0, None), (901, 10.0, 0.0, None, dt.date(2026, 2, 1))], "row_id long, ra double, dec double, exptime double, b date")
    seen, whole = [], visibility.with_total_seconds
    want = {}
    for begin in (dt.date(2026, 2, 1), "b", F.col("b")):
        plain = whole(targets, begin, dt.date(2026, 2, 9), "all", "exptime", "first", "s")
        want[str(begin)] = {r.row_id: r.s is not None and r.exptime is not None and r.s >= r.exptime for r in plain.collect()}

    def counted(positions, *args, **site):
        seen.append(positions.count())
        return whole(positions, *args, **site)

    monkeypatch.setattr(visibility, "with_total_seconds", counted)
    for begin in (dt.date(2026, 2, 1), "b", F.col("b")):
        out = visibility.visibility_flags(targets, begin, dt.date(2026, 2, 9), [], grouping="target")
        assert out.columns == [*targets.columns, "ok_visible"]
        assert {r.row_id: r.ok_visible for r in out.collect()} == want[str(begin)]
    assert max(seen) <= 14


def test_pointings_at_one_position_are_tested_once(spark, monkeypatch):
    """Pairs, coverage, shifts and first targets of pointings that share positions, against each pointing by itself."""
    rng = random.Random(3)
    targets = spark.createDataFrame([(f"t{i}", 20 + rng.uniform(-1, 1), rng.uniform(-1, 1), i % 4, rng.random()) for i in range(120)], "ob_code string, ra double, dec double, priority int, weight double")
    spots = [(20.0, 0.0, 0.0), (20.3, 0.4, 15.0), (20.9, 1.6, 0.0), (60.0, 60.0, 0.0), (None, 0.0, 0.0)]
    given = [(f"p{i}_{k}", *p, i // 2) for i, p in enumerate(spots) for k in range(4)]
    pointings = spark.createDataFrame(given, "ppc_code string, ppc_ra double, ppc_dec double, ppc_pa double, group_id int")
    inside = {}
    for code, *_ in given:
        pairs = spatial.targets_in_fields(targets, pointings.where(F.col("ppc_code") == code), [], target_keep=("ob_code", "priority", "weight"))
        inside[code] = [(r.priority, -r.weight, r.ob_code) for r in pairs.collect()]
    stored, plain = {}, spatial.stage

    def counted(df, label, **metrics):
        out, seen = plain(df, label, **metrics)
        stored[label] = out.count()
        return out, seen

    monkeypatch.setattr(spatial, "stage", counted)
    monkeypatch.setattr(allocation, "stage", counted)
    got = spatial.targets_in_fields(targets, pointings, []).collect()
    assert sorted((r.ppc_code, r.ob_code) for r in got) == sorted((c, t[2]) for c, ts in inside.items() for t in ts)
    assert stored.pop("positions") == 5
    first = allocation.fill_positions(targets, pointings, [], capacity=7).collect()
    assert sorted((r.ppc_code, r["rank"], r.ob_code) for r in first) == sorted((c, k, t[2]) for c, ts in inside.items() for k, t in enumerate(sorted(ts)[:7], 1))
    assert stored.pop("positions") == 5
    assert {r.ppc_code for r in spatial.occupied_pointings(targets, pointings, []).collect()} == {c for c, ts in inside.items() if ts}
    covered = {(r.group_id, r.ob_code) for r in spatial.covered_targets(targets, pointings, []).collect()}
    assert covered == {(g, t[2]) for c, *_, g in given for t in inside[c]} and stored["covered"] <= 240
    moved = allocation.shift_empty_pointings(pointings.drop("group_id"), targets, []).collect()
    assert len(moved) == 20 and stored["tried"] == 40
    assert len({(r.ppc_code[:2], r.shift_no, r.ppc_ra, r.ppc_dec) for r in moved}) == 5
    assert {r.shift_no for r in moved if r.ppc_code[:2] in ("p3", "p4")} == {None}


def test_pairs_of_repeated_positions_are_tested_once(spark, monkeypatch):
    """Targets at one position go into its pairs by name: the test meets positions of both sides only."""
    spots = [(10.0, 0.0), (10.1, 0.1), (359.9, 0.0), (None, 0.0), (-0.0, 0.0), (0.0, 0.0)]
    targets = spark.createDataFrame([(f"{c}-{i}", m, *p) for i, p in enumerate(spots) for c in range(30) for m in "LM"], "ob_code string, mode string, ra double, dec double")
    fields = [(10.0, 0.0, 0.0), (10.0, 0.0, 30.0), (0.0, 0.0, 0.0)]
    pointings = spark.createDataFrame([(f"{c}-{i}", "L", *p) for i, p in enumerate(fields) for c in range(20)], "ppc_code string, mode string, ppc_ra double, ppc_dec double, ppc_pa double")
    sizes, stage = {}, spatial.stage

    def counted(df, label, **metrics):
        staged = stage(df, label, **metrics)
        sizes[label] = staged[0].count()
        return staged

    monkeypatch.setattr(spatial, "stage", counted)
    got = spatial.targets_in_fields(targets, pointings, ["mode"])
    assert sizes == {"positions": 3, "held": 6}
    held = {(0, 0), (1, 0), (0, 1), (1, 1), (2, 2), (4, 2), (5, 2)}  # place in spots, place in fields
    want = {("L", f"{p}-{j}", f"{c}-{i}") for i, j in held for c in range(30) for p in range(20)}
    rows = [(r["mode"], r.ppc_code, r.ob_code) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
