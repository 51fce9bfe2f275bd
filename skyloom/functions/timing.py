"""Dates, semesters and observing-time arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: time charged per frame and per night ---
NIGHT_HOURS = 10.0
SHARED_OVERHEAD_HOURS = 1.2
FRAME_OVERHEAD_MISC = 120.0  # s
FRAME_OVERHEAD_FIBERS = 180.0  # s


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def request_hours(
    n_frames,
    single_exptime,
    night_hours: float = NIGHT_HOURS,
    misc: float = FRAME_OVERHEAD_MISC,
    fibers: float = FRAME_OVERHEAD_FIBERS,
    shared_hours: float = SHARED_OVERHEAD_HOURS,
) -> Column:
    """Hours charged for ``n_frames`` exposures, with frame and shared night overheads."""
    on_sky = (_c(single_exptime) + misc + fibers) * _c(n_frames)
    shared = on_sky / (night_hours - shared_hours) * shared_hours
    return (on_sky + shared) / 3600.0


def frames_in_hours(
    hours,
    single_exptime,
    night_hours: float = NIGHT_HOURS,
    misc: float = FRAME_OVERHEAD_MISC,
    fibers: float = FRAME_OVERHEAD_FIBERS,
    shared_hours: float = SHARED_OVERHEAD_HOURS,
) -> Column:
    """Number of frames that a charged time pays for; halves go to the even number."""
    usable = _c(hours) / (night_hours / (night_hours - shared_hours)) * 3600.0
    return F.rint(usable / (_c(single_exptime) + misc + fibers)).cast("int")


def shown_hours(hours) -> Column:
    """Charged hours as shown to users: rounded up to a tenth."""
    return F.ceil(_c(hours) * 10.0) / 10.0


def _day(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def semester_begin(day, which: str = "next") -> Column:
    """First day of the half-year semester (February to July, August to January)."""
    m, y = F.month(_c(day)), F.year(_c(day))
    current = (
        F.when(m == 1, _day(y - 1, 8, 1)).when(m <= 7, _day(y, 2, 1)).otherwise(_day(y, 8, 1))
    )
    if which == "current":
        return current
    if which == "next":
        return F.add_months(current, 6)
    raise ValueError("which must be 'current' or 'next'")


def semester_end(day, which: str = "next") -> Column:
    return F.date_sub(F.add_months(semester_begin(day, which), 6), 1)


def semester_label(ts) -> Column:
    """Label of the semester a submission time belongs to, such as ``S24A``.

    The call for A runs from 1 August to 15 September, the call for B from 1 February to 15 March;
    between the calls a submission belongs to the call before it.
    """
    ts = _c(ts).cast("timestamp")
    y = F.year(ts)

    def moment(month: int, day: int) -> Column:
        return _day(y, month, day).cast("timestamp")

    def label(year: Column, half: str) -> Column:
        return F.concat(F.lit("S"), F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0"), F.lit(half))

    return (
        F.when(ts < moment(2, 1), label(y - 1, "B"))
        .when(ts <= moment(3, 15), label(y, "B"))
        .when(ts < moment(8, 1), label(y, "A"))
        .when(ts <= moment(9, 15), label(y + 1, "A"))
        .when(ts.isNotNull(), label(y, "B"))
    )
