"""Which targets are observable in a range of nights.

The time above the elevation limit has a closed form per night, so that no ephemeris is tabulated: the
night is an interval of hour angle, and so is the part of the sky path between the limits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.sky import num, sky_pixel
from skyloom.operators.ordered import join_back, look_up
from skyloom.schema import (
    ELEVATION,
    LIST_COLS,
    NIGHT_END,
    NIGHT_START,
    PIXEL_NSIDE,
    SINGLE_EXPTIME,
    SITE_LATITUDE,
    SITE_LONGITUDE,
    SITE_TIMEZONE,
)
from skyloom.session import stage

SIDEREAL_RATE = 15.0410686  # degrees of hour angle per hour


def _day(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _at(day: Column, clock: str, timezone: str) -> Column:
    h, m, s = clock.split(":")
    return F.make_timestamp(
        F.year(day), F.month(day), F.dayofmonth(day), F.lit(int(h)), F.lit(int(m)), F.lit(int(s)), F.lit(timezone)
    )


def night_dates(begin: Column, end: Column, calendar: str = "all") -> Column:
    """Array of the dates whose nights count, first and last included; empty for a range that ends before it begins.

    ``split`` leaves out the middle night, as a range cut into two halves by dates does; ``split_time``
    also leaves out the last night of a range with an odd number of days, as halves cut by the clock do.
    """
    days = F.when(begin <= end, F.sequence(begin, F.greatest(begin, end), F.expr("interval 1 day"))).otherwise(
        F.array().cast("array<date>")
    )
    if calendar == "all":
        return days
    span = F.date_diff(end, begin)
    middle = F.date_add(begin, F.floor(span / 2).cast("int"))
    kept = F.filter(days, lambda d: d != middle)
    if calendar == "split":
        return kept
    if calendar == "split_time":
        return F.filter(kept, lambda d: (d != end) | (span % 2 == 0))
    raise ValueError("calendar must be 'all', 'split' or 'split_time'")


def night_calendar(
    ranges: DataFrame, begin="date_begin", end="date_end", calendar: str = "all", timezone: str = SITE_TIMEZONE
) -> DataFrame:
    """One row per row of ``ranges`` and night, with ``night``, ``begin_utc`` and ``end_utc``."""
    out = ranges.withColumn("night", F.explode(night_dates(_day(begin), _day(end), calendar)))
    return out.withColumns(
        {
            "begin_utc": _at(F.col("night"), NIGHT_START, timezone),
            "end_utc": _at(F.date_add("night", 1), NIGHT_END, timezone),
        }
    )


def crossing_angles(
    dec: str, elevation: tuple[float, float] = ELEVATION, latitude: float = SITE_LATITUDE
) -> tuple[str, str]:
    """SQL texts: hour angles at which a position crosses the elevations, 0 if never above, 180 if never below."""
    phi = math.radians(latitude)

    def limit(angle: float) -> str:
        ratio = (
            f"({num(math.sin(math.radians(angle)))} - {num(math.sin(phi))} * sin(radians({dec})))"
            f" / ({num(math.cos(phi))} * cos(radians({dec})))"
        )
        return f"degrees(acos(greatest(-1D, least(1D, {ratio}))))"

    return limit(elevation[0]), limit(elevation[1])


def night_seconds(
    ra: str,
    dec: str,
    begin: str,
    end: str,
    single_exptime: float | str = SINGLE_EXPTIME,
    mode: str = "first",
    elevation: tuple[float, float] = ELEVATION,
    latitude: float = SITE_LATITUDE,
    longitude: float = SITE_LONGITUDE,
    crossings: tuple[str, str] | None = None,
) -> str:
    """SQL text: whole seconds of a night in which a position is between the elevation limits.

    ``begin`` and ``end`` are in seconds since 1970. ``first`` counts the first stretch of at least one
    exposure; ``sum`` counts all stretches. ``crossings`` may name the columns that hold :func:`crossing_angles`.
    """
    low_angle, high_angle = crossings or crossing_angles(dec, elevation, latitude)
    julian = f"({begin} / 86400D + 2440587.5D)"
    sidereal = f"280.46061837D + 360.98564736629D * ({julian} - 2451545D) + {num(longitude)}"
    start = f"(pmod({sidereal} - {ra} + 180, 360D) - 180)"
    # bind the crossing angles and the night once; the path is [-lo, lo] without the zone (-hi, hi),
    # seen on this transit and on the next one
    path = f"named_struct('lo', {low_angle}, 'hi', {high_angle}, 'a', {start})"
    night = f"({end} - {begin}) / 3600D * {num(SIDEREAL_RATE)}"

    def stretch(low: str, high: str) -> str:
        hours = f"greatest(0D, least({high}, p.a + {night}) - greatest({low}, p.a)) / {num(SIDEREAL_RATE)}"
        return f"floor({hours} * 3600)"

    stretches = []
    for turn in ("0D", "360D"):
        stretches.append(stretch(f"{turn} - p.lo", f"if(p.hi > 0, {turn} - p.hi, {turn} + p.lo)"))
        stretches.append(stretch(f"{turn} + p.hi", f"if(p.hi > 0, {turn} + p.lo, {turn} + p.hi)"))
    pieces = f"transform(array({path}), p -> array({', '.join(stretches)}))[0]"
    if mode == "first":
        least_run = single_exptime if isinstance(single_exptime, str) else num(single_exptime)
        return f"coalesce(try_element_at(filter({pieces}, s -> s >= {least_run}), 1), 0L)"
    if mode == "sum":
        return f"aggregate({pieces}, 0L, (t, s) -> t + s)"
    raise ValueError("mode must be 'first' or 'sum'")


def pixel_groups(
    targets: DataFrame,
    list_cols: Sequence[str] = LIST_COLS,
    nside: int = PIXEL_NSIDE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per sky pixel: the longest exposure and the position of the first target."""
    return (
        targets.withColumn("pixel", sky_pixel("ra", "dec", nside))
        .groupBy(*list_cols, "pixel")
        .agg(
            F.max("exptime").alias("max_exptime"),
            F.min_by(F.struct("ra", "dec"), "row_id").alias("_first"),
            *[F.max(c).alias(c) for c in carry],
        )
        .select(
            *list_cols, "pixel", "max_exptime", F.col("_first.ra").alias("ra"), F.col("_first.dec").alias("dec"), *carry
        )
    )


def observable_seconds(
    positions: DataFrame, begin, end, calendar: str = "all", single_exptime: float = SINGLE_EXPTIME,
    mode: str = "first", **site,
) -> DataFrame:
    """One row per position and night with the observable ``seconds``."""
    nights = night_calendar(positions.withColumns({"_b": _day(begin), "_e": _day(end)}), "_b", "_e", calendar)
    return nights.withColumn(
        "seconds",
        F.expr(night_seconds("ra", "dec", "unix_seconds(begin_utc)", "unix_seconds(end_utc)", single_exptime, mode, **site)),
    ).drop("_b", "_e", "begin_utc", "end_utc")


def with_total_seconds(
    positions: DataFrame, begin, end, calendar: str = "all", single_exptime: float | str = SINGLE_EXPTIME,
    mode: str = "first", out: str = "seconds", timezone: str = SITE_TIMEZONE, **site,
) -> DataFrame:
    """Add the observable seconds summed over a range of nights, inside each row.

    No row is made per night and nothing is shuffled. What depends on the position alone or, between two given dates, on
    the night alone is found once.
    """
    nights = F.transform(
        night_dates(_day(begin), _day(end), calendar),
        lambda d: F.struct(
            F.unix_seconds(_at(d, NIGHT_START, timezone)).alias("b"),
            F.unix_seconds(_at(F.date_add(d, 1), NIGHT_END, timezone)).alias("e"),
        ),
    )
    seconds = night_seconds("ra", "dec", "d.b", "d.e", single_exptime, mode, **site, crossings=("_low", "_high"))
    angles = crossing_angles("dec", site.get("elevation", ELEVATION), site.get("latitude", SITE_LATITUDE))
    rows = positions.withColumns({c: F.expr(x) for c, x in zip(("_low", "_high"), angles)})
    if isinstance(begin, date) and isinstance(end, date):
        calendar_row, _ = stage(positions.sparkSession.range(1).select(nights.alias("_nights")), "nights")
        rows = rows.crossJoin(F.broadcast(calendar_row))
    else:
        rows = rows.withColumn("_nights", nights)
    return rows.withColumn(out, F.expr(f"aggregate(transform(_nights, d -> {seconds}), 0L, (t, s) -> t + s)")).drop(
        "_nights", "_low", "_high"
    )


def visibility_sums(
    positions: DataFrame, first: date, last: date, key: str = "pixel", single_exptime: float = SINGLE_EXPTIME,
    mode: str = "first", timezone: str = SITE_TIMEZONE, **site,
) -> DataFrame:
    """Prefix sums over a calendar: one row per key with ``first_night`` and ``sums``.

    ``sums[k]`` is the observable time of the first k nights, so that the time of any range of nights is the difference of
    two entries, whoever asks for it. ``positions`` has one row per key with ``ra`` and ``dec``. The table is as large as
    the sky in pixels times the nights, whatever the number of targets; nothing is shuffled to make it.
    """
    if last < first:
        raise ValueError("the calendar ends before it begins")
    nights = F.transform(
        night_dates(F.lit(first), F.lit(last)),
        lambda d: F.struct(
            F.unix_seconds(_at(d, NIGHT_START, timezone)).alias("b"),
            F.unix_seconds(_at(F.date_add(d, 1), NIGHT_END, timezone)).alias("e"),
        ),
    )
    seconds = night_seconds("ra", "dec", "d.b", "d.e", single_exptime, mode, **site)
    summed = f"aggregate(transform(_nights, d -> {seconds}), array(0L), (s, x) -> array_append(s, element_at(s, -1) + x))"
    return (
        positions.select(key, "ra", "dec").withColumn("_nights", nights)
        .select(key, F.lit(first).alias("first_night"), F.expr(summed).alias("sums"))
    )


def seconds_in_range(begin, end, calendar: str = "all", first: str = "first_night", sums: str = "sums") -> Column:
    """Observable seconds between two dates from the row of :func:`visibility_sums`; 0 for a range that ends before it begins.

    Null without such a row, or if a date is null; a range that leaves the calendar of the table is an error.
    """
    begin, end = _day(begin), _day(end)

    def upto(day: Column) -> Column:
        return F.get(sums, F.date_diff(day, F.col(first)))

    def night(day: Column) -> Column:
        return upto(F.date_add(day, 1)) - upto(day)

    span = F.date_diff(end, begin)
    total = upto(F.date_add(end, 1)) - upto(begin)
    if calendar in ("split", "split_time"):
        total = total - night(F.date_add(begin, F.floor(span / 2).cast("int")))
        if calendar == "split_time":
            total = total - F.when(span % 2 == 1, night(end)).otherwise(0)
    elif calendar != "all":
        raise ValueError("calendar must be 'all', 'split' or 'split_time'")
    outside = (begin < F.col(first)) | (F.date_diff(end, F.col(first)) + 2 > F.size(sums))
    return F.when(begin > end, F.lit(0).cast("bigint")).when(
        outside, F.raise_error(F.lit("the range of nights leaves the calendar of the table")).cast("bigint")
    ).otherwise(total)


def visibility_by_sums(
    targets: DataFrame, sums: DataFrame, begin: date | Column | str, end: date | Column | str,
    list_cols: Sequence[str] = LIST_COLS, nside: int = PIXEL_NSIDE, calendar: str = "all",
) -> DataFrame:
    """Per list and sky pixel: ``max_exptime``, observable ``seconds`` and ``ok_visible``, from a table of prefix sums.

    ``sums`` is a stored table of :func:`visibility_sums`; all lists and ranges share it. A pixel that it lacks is an
    invisible one, with null seconds. Dates given as names of columns have to be the same in all rows of a list.
    """
    carry = [c for c in (begin, end) if isinstance(c, str)]
    groups = pixel_groups(targets, list_cols, nside, carry).drop("ra", "dec")
    told = join_back(groups, sums, ["pixel"]).withColumn("seconds", seconds_in_range(begin, end, calendar))
    return told.drop("first_night", "sums").withColumn(
        "ok_visible", F.coalesce(F.col("seconds") >= F.col("max_exptime"), F.lit(False))
    )


def visibility_flags(
    targets: DataFrame,
    begin: date | Column | str,
    end: date | Column | str,
    list_cols: Sequence[str] = LIST_COLS,
    grouping: str = "pixel",
    single_exptime: float = SINGLE_EXPTIME,
    nside: int = PIXEL_NSIDE,
    calendar: str = "all",
    mode: str = "first",
    source: DataFrame | None = None,
    sums: DataFrame | None = None,
    **site,
) -> DataFrame:
    """Add ``ok_visible``: is a target observable long enough between two dates.

    ``pixel`` decides once per sky pixel, with the longest exposure in it; ``target`` decides for every
    position with its own exposure, which is then also the shortest stretch that counts in a night.
    ``begin`` and ``end`` may be columns, so that every list has its own range. ``source`` may name the
    plain rows behind ``targets``, for a cheaper grouping. With a table of :func:`visibility_sums` no night is
    looked at again: pixels take the time of the position that the table has for them.
    """
    if sums is not None and grouping != "pixel":
        raise ValueError("a table of sums knows pixels only")
    if grouping == "target":
        # equal positions with equal exposures and dates are decided once
        dates = {f"_{i}": d for i, d in enumerate((begin, end)) if not isinstance(d, date)}
        dated = targets.withColumns({name: _day(d) for name, d in dates.items()}) if dates else targets
        by = ["ra", "dec", "exptime", *dates]
        spots, _ = stage(dated.select(*by).distinct(), "spots")
        tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        first, last = (d if isinstance(d, date) else F.col(f"_{i}") for i, d in enumerate((begin, end)))
        seen = with_total_seconds(spots.repartition(tasks, *by), first, last, calendar, "exptime", mode, "_seen", **site)
        verdict = seen.select(*by, (F.col("_seen") >= F.col("exptime")).alias("ok_visible"))
        told = look_up(dated.drop("ok_visible"), verdict, by, null_safe=True)
        return told.select(*[c for c in targets.columns if c != "ok_visible"], F.coalesce("ok_visible", F.lit(False)).alias("ok_visible"))
    if grouping != "pixel":
        raise ValueError("grouping must be 'pixel' or 'target'")
    rows = targets.withColumn("pixel", sky_pixel("ra", "dec", nside))
    if sums is not None:
        told = visibility_by_sums(targets if source is None else source, sums, begin, end, list_cols, nside, calendar)
        found = look_up(rows, told.select(*list_cols, "pixel", "ok_visible"), [*list_cols, "pixel"])
        return found.withColumn("ok_visible", F.coalesce("ok_visible", F.lit(False))).drop("pixel")
    carry = [c for c in (begin, end) if isinstance(c, str)]
    pixels = pixel_groups(targets if source is None else source, list_cols, nside, carry)
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pixels = pixels.repartition(tasks, *list_cols, "pixel")  # few rows with much work each
    seen = with_total_seconds(pixels, begin, end, calendar, single_exptime, mode, "_seen", **site)
    verdict = seen.select(*list_cols, "pixel", (F.col("_seen") >= F.col("max_exptime")).alias("ok_visible"))
    return (
        look_up(rows, verdict, [*list_cols, "pixel"])
        .withColumn("ok_visible", F.coalesce("ok_visible", F.lit(False)))
        .drop("pixel")
    )


def visibility_status(flagged: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Per list: ``all``, ``some`` (still a pass) or ``none`` visible."""
    return flagged.groupBy(*list_cols).agg(
        F.count_if(~F.col("ok_visible")).alias("n_invisible"),
        F.when(F.bool_and("ok_visible"), "all").when(F.bool_or("ok_visible"), "some").otherwise("none").alias("visible"),
        F.bool_or("ok_visible").alias("status"),
    )
