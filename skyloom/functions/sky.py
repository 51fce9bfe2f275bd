"""Geometry on the sky as Column expressions. All angles are degrees.

Arguments are column names or SQL texts. The expressions are written as SQL text, which Spark parses in
one call however long they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skyloom.schema import FIELD_RADIUS, PIXEL_NSIDE


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def separation_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    return (
        f"degrees(2 * asin(sqrt(least(1D, pow(sin(radians({dec2} - {dec1}) / 2), 2)"
        f" + cos(radians({dec1})) * cos(radians({dec2})) * pow(sin(radians({ra2} - {ra1}) / 2), 2)))))"
    )


def separation(ra1: str, dec1: str, ra2: str, dec2: str) -> Column:
    """Great-circle distance (haversine)."""
    return F.expr(separation_sql(ra1, dec1, ra2, dec2))


def sky_pixel(ra: str, dec: str, nside: int = PIXEL_NSIDE) -> Column:
    """Equal-area pixel number, ring order (Gorski et al. 2005)."""
    n = nside
    z = f"sin(radians({dec}))"
    t = f"(pmod({ra}, 360D) / 90)"
    # equatorial belt
    jp = f"floor({n} * (0.5D + {t}) - {num(0.75 * n)} * {z})"
    jm = f"floor({n} * (0.5D + {t}) + {num(0.75 * n)} * {z})"
    ring = f"({n + 1} + {jp} - {jm})"
    shift = f"(1 - pmod({ring}, 2))"
    belt = (
        f"{2 * n * (n - 1)} + ({ring} - 1) * {4 * n}"
        f" + pmod(floor(({jp} + {jm} - {n} + {shift} + 1) / 2), {4 * n})"
    )
    # polar caps
    u = f"({t} - floor({t}))"
    v = f"({n} * sqrt(3 * (1 - abs({z}))))"
    cap_ring = f"(floor({u} * {v}) + floor((1 - {u}) * {v}) + 1)"
    cap_phi = f"pmod(floor({t} * {cap_ring}), 4 * {cap_ring})"
    cap = (
        f"case when {z} > 0 then 2 * {cap_ring} * ({cap_ring} - 1) + {cap_phi}"
        f" else {12 * n * n} - 2 * {cap_ring} * ({cap_ring} + 1) + {cap_phi} end"
    )
    return F.expr(f"cast(case when abs({z}) <= {num(2 / 3)} then {belt} else {cap} end as bigint)")


# --- cells for distance joins -------------------------------------------------
# A cell is (band, bin): bands of declination are ``size`` high, and every band is cut into as many
# right-ascension bins as fit with a width of at least ``size``. Two points within ``size`` of each
# other are then always in touching cells.


def _band(dec: str, size: float) -> str:
    return f"cast(floor({dec} / {num(size)}) as bigint)"


def _bins(band: str, size: float) -> str:
    """Number of right-ascension bins of a band."""
    top = f"(greatest(abs({band}), abs({band} + 1)) * {num(size)})"
    width = f"degrees(asin(least(1D, {num(math.sin(math.radians(size)))} / cos(radians({top})))))"
    return (
        f"cast(case when {top} >= {num(90 - size)} then 1 else greatest(1, floor(360 / {width})) end as bigint)"
    )


def _bin(ra: str, n: str) -> str:
    return f"cast(least(floor(pmod({ra}, 360D) / 360 * {n}), {n} - 1) as bigint)"


def cell_of(ra: str, dec: str, size: float) -> Column:
    band = _band(dec, size)
    return F.expr(f"named_struct('band', {band}, 'bin', {_bin(ra, _bins(band, size))})")


def cells_around(ra: str, dec: str, size: float) -> Column:
    """Array of the distinct cells that can hold a point within ``size``."""
    bands = f"transform(array(-1L, 0L, 1L), s -> {_band(dec, size)} + s)"
    rows = f"transform({bands}, b -> named_struct('b', b, 'n', {_bins('b', size)}))"
    cells = (
        f"transform({rows}, r -> transform(array(-1L, 0L, 1L), k -> "
        f"named_struct('band', r.b, 'bin', pmod({_bin(ra, 'r.n')} + k, r.n))))"
    )
    return F.expr(f"array_distinct(flatten({cells}))")


# --- the hexagonal field --------------------------------------------------------


def field_corners(ra: str, dec: str, pa: str, radius: float = FIELD_RADIUS, unwrap: bool = True) -> Column:
    """Array of the six corners (``x``, ``y``) of a field, at bearings 30 + 60 k + pa.

    With ``unwrap`` the corners of a field on the 0/360 border follow the centre past that border.
    """
    sin_r, cos_r = num(math.sin(math.radians(radius))), num(math.cos(math.radians(radius)))
    bearings = f"transform(array(30D, 90D, 150D, 210D, 270D, 330D), k -> radians({pa} + k))"
    lat = f"radians({dec})"
    first = (
        f"transform({bearings}, b -> named_struct('b', b, 's', sin({lat}) * {cos_r} + cos({lat}) * {sin_r} * cos(b)))"
    )
    turn = f"degrees(atan2(sin(c.b) * {sin_r} * cos({lat}), {cos_r} - sin({lat}) * c.s))"
    corners = (
        f"transform({first}, c -> named_struct('x', pmod({ra} + {turn}, 360D), 'y', degrees(asin(c.s))))"
    )
    if unwrap:
        corners = f"transform({corners}, c -> named_struct('x', {near_sql('c.x', ra)}, 'y', c.y))"
    return F.expr(corners)


def near_sql(ra: str, centre: str) -> str:
    """``ra`` moved by a full turn when it lies more than half a turn from ``centre``."""
    return (
        f"(case when {ra} - {centre} > 180 then {ra} - 360"
        f" when {ra} - {centre} < -180 then {ra} + 360 else {ra} end)"
    )


def polygon_sides(corners: str, prefix: str, sides: int = 6) -> dict[str, Column]:
    """The sides of a polygon as plain columns: start (x, y) and inverse slope (s), null if level."""
    out = {}
    for k in range(sides):
        a, b = f"{corners}[{k}]", f"{corners}[{(k + 1) % sides}]"
        out[f"{prefix}x{k}"] = F.expr(f"{a}.x")
        out[f"{prefix}y{k}"] = F.expr(f"{a}.y")
        out[f"{prefix}s{k}"] = F.expr(f"({b}.x - {a}.x) / nullif({b}.y - {a}.y, 0D)")
    return out


def in_polygon(x: str, y: str, prefix: str, sides: int = 6) -> Column:
    """Ray crossing test of a point against the closed polygon of :func:`polygon_sides`."""
    crossings = []
    for k in range(sides):
        xk, yk, sk = (f"{prefix}{c}{k}" for c in "xys")
        following = f"{prefix}y{(k + 1) % sides}"
        # a level side has no slope, and cannot straddle
        crossings.append(
            f"case when ({yk} > {y}) <> ({following} > {y}) and {x} < {xk} + ({y} - {yk}) * {sk} then 1 else 0 end"
        )
    return F.expr(f"({' + '.join(crossings)}) % 2 = 1")
