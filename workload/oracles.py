"""The queries again as DuckDB SQL over the same tables."""

from __future__ import annotations

import math

from workload.files import FILE_ORACLES
from workload.views import cte

ORACLES: dict[str, str] = dict(FILE_ORACLES)

FRAMES = "cast(ceil(exptime/9e2) as bigint)"
CELL = "cast(trunc(ra) as bigint), ((cast(trunc(dec+4e1) as bigint) % 131) + 131) % 131"


def weights(*partition: str, name: str = "w", source: str = "targets") -> str:
    """CTE with frames, exptime_req, local_count and weight."""
    part = ", ".join([*partition, CELL])
    return f"""{name}_c as (select *, {FRAMES} as frames, ceil(exptime/9e2)*9e2 as exptime_req,
  count(*) over (partition by {part}) as local_count from {source}),
{name} as (select *, pow(202e-2, 2e0 + (9-priority)*1e-1) * pow(exptime_req/9e2, 1e-2) * pow(cast(local_count as double), 1e-2) as weight from {name}_c)"""


STATS = """stats as (select ppc_code, count(*) as n_assigned, round(count(*)/2394e0*1e2, 12) as tel_fiber_usage_frac,
  round(1e0/sum(weight), 12) as ppc_priority from allocations left join w using (ob_code) group by ppc_code),
stored as (select p.*, n_assigned, tel_fiber_usage_frac, ppc_priority from pointings p join stats using (ppc_code))"""

BASE3 = cte("targets", "pointings", "allocations") + ",\n" + weights() + ",\n" + STATS


def curve(keys: str, links: str) -> str:
    """CTE ``curve``: cumulative figures per pointing and priority; ``keys`` is a comma-terminated list."""
    k = keys
    part = f"{k}" if k else ""
    using = f"using ({k} ppc_id, p)" if k else "using (ppc_id, p)"
    return f"""ranked as (select *, row_number() over ({'partition by ' + k.rstrip(', ') if k else ''} order by ppc_priority nulls last, ppc_code) as ppc_id from stored),
links as ({links}),
seq as (select *, row_number() over (partition by {part} ob_code order by ppc_id) as visit from links),
both_p as (select {k} ppc_id, cast(priority as varchar) as p, 1 as a, cast(visit = frames as int) as d from seq
  union all select {k} ppc_id, 'all', 1, cast(visit = frames as int) from seq),
per as (select {k} ppc_id, p, sum(a) as a, sum(d) as d from both_p group by all),
tot as (select {k} cast(priority as varchar) as p, sum(exptime_req) as s, count(*) as c from tk group by all
  union all select {k} 'all', sum(exptime_req), count(*) from tk group by all),
grid as (select {('ranked.' + k) if k else ''} ppc_id, p, s, c from ranked join tot {'using (' + k.rstrip(', ') + ')' if k else 'on true'}),
run as (select grid.*, sum(coalesce(a,0)) over (partition by {part} p order by ppc_id) as ca,
  sum(coalesce(d,0)) over (partition by {part} p order by ppc_id) as cd from grid left join per {using}),
curve as (select {k} cast(ppc_id as bigint) as ppc_id, p as priority, ca*9e2/36e2 as fh, ca*9e2/36e2/(s/36e2)*1e2 as fh_pct,
  cast(cd as bigint) as n, cd/cast(c as double)*1e2 as n_pct from run)"""


ONE_CURVE = BASE3 + ",\ntk as (select * from w),\n" + curve(
    "", "select ppc_id, ob_code, priority, frames from allocations join ranked using (ppc_code) join w using (ob_code)"
)
MODE_CURVE = BASE3 + ",\ntk as (select *, resolution as ppc_resolution from w),\n" + curve(
    "ppc_resolution, ",
    "select r.ppc_resolution, r.ppc_id, tk.ob_code, tk.priority, tk.frames from allocations a join ranked r using (ppc_code) "
    "join tk on tk.ob_code = a.ob_code and tk.ppc_resolution = r.ppc_resolution",
)

ORACLES["completion_curve_fh"] = ONE_CURVE + "\nselect ppc_id, priority, round(fh, 6) as fh, round(fh_pct, 6) as fh_pct from curve"
ORACLES["completion_curve_n"] = ONE_CURVE + "\nselect ppc_id, priority, n, round(n_pct, 6) as n_pct from curve"
ORACLES["assigned_exposure"] = cte("targets", "allocations") + """
select t.ob_code, ceil(t.exptime/9e2)*9e2 as exptime_req, count(a.ppc_code)*9e2 as exptime_assign
from targets t left join allocations a using (ob_code) group by t.ob_code, t.exptime"""
ORACLES["target_weights"] = cte("targets") + ",\n" + weights("list_no", "resolution") + """
select row_id, exptime_req, local_count, round(weight, 9) as weight from w"""

# --- checks ---

ORACLES["column_report"] = cte("targets") + """
select distinct list_no, true as required_ok, false as optional_ok,
 'obj_id,ob_code,ra,dec,priority,exptime,resolution,reference_arm' as required_found, '' as required_missing,
 'pmra,pmdec,parallax,tract,patch' as optional_missing from targets"""

PATTERN = "'^[A-Za-z0-9_+.-]+$'"
STR_FLAGS = f"""strs as (select *, coalesce(regexp_matches(ob_code, {PATTERN}), false) as ok_str_ob_code,
 coalesce(regexp_matches(resolution, {PATTERN}), false) as ok_str_resolution,
 coalesce(regexp_matches(reference_arm, {PATTERN}), false) as ok_str_reference_arm from %s)"""
ORACLES["check_strings"] = cte("targets_dirty") + ",\n" + STR_FLAGS % "targets_dirty" + """
select row_id, ok_str_ob_code, ok_str_resolution, ok_str_reference_arm,
 ok_str_ob_code and ok_str_resolution and ok_str_reference_arm as ok_str from strs"""
VALUE_FLAGS = """vals as (select *, coalesce(ra >= 0 and ra <= 360, false) as ok_ra, coalesce(dec >= -90 and dec <= 90, false) as ok_dec,
 coalesce(priority between 0 and 9, false) as ok_priority, coalesce(exptime > 0, false) as ok_exptime,
 coalesce(resolution in ('L','M'), false) as ok_resolution,
 coalesce(reference_arm in ('b','r','n','m'), false) and not coalesce((resolution = 'L' and reference_arm = 'm') or (resolution = 'M' and reference_arm = 'r'), false) as ok_reference_arm
 from %s)"""
ALL_VALUES = "ok_ra and ok_dec and ok_priority and ok_exptime and ok_resolution and ok_reference_arm"
ORACLES["check_values"] = cte("targets_dirty") + ",\n" + VALUE_FLAGS % "targets_dirty" + f"""
select row_id, ok_ra, ok_dec, ok_priority, ok_exptime, ok_resolution, ok_reference_arm, {ALL_VALUES} as ok_values from vals"""
ORACLES["check_values_list_scope"] = cte("targets_dirty") + ",\n" + VALUE_FLAGS % "targets_dirty" + """,
pairs as (select list_no, bool_or((resolution = 'L' and reference_arm = 'm') or (resolution = 'M' and reference_arm = 'r')) as bad from targets_dirty group by list_no),
f as (select v.list_no, reference_arm in ('b','r','n','m') and not bad as ok_arm,
 ok_ra and ok_dec and ok_priority and ok_exptime and ok_resolution as ok_rest from vals v join pairs using (list_no))
select list_no, count(*) as n_rows, bool_and(ok_arm) as status_reference_arm, count(*) filter (where not ok_arm) as n_bad_reference_arm,
 bool_and(ok_arm and ok_rest) as status_values, count(*) filter (where not (ok_arm and ok_rest)) as n_bad_values from f group by list_no"""
UNIQUE = """uniq as (select *, count(*) over (partition by list_no, ob_code) = 1 as ok_code,
 count(*) over (partition by list_no, obj_id, resolution) = 1 as ok_pair from %s)"""
ORACLES["check_unique"] = cte("targets_dirty") + ",\n" + UNIQUE % "targets_dirty" + """
select row_id, list_no, ok_code, ok_pair, ok_code and ok_pair as ok_unique from uniq"""
ORACLES["unique_status"] = cte("targets_dirty") + ",\n" + UNIQUE % "targets_dirty" + """
select list_no, bool_and(ok_code) and bool_and(ok_pair) as status,
 case when bool_and(ok_code) then 'ob_code: no repeats;' else 'ob_code: repeated;' end || ' ' ||
 case when bool_and(ok_pair) then 'obj_id with resolution: no repeats' else 'obj_id with resolution: repeated' end as description
from uniq group by list_no"""
ORACLES["size_notice"] = cte("targets") + "\nselect list_no, count(*) as n_rows, count(*) >= 1500 as is_large from targets group by list_no"
ORACLES["registered_columns"] = cte("targets") + """
select row_id, obj_id, cast(obj_id as varchar) as obj_id_str, ob_code, ra, dec, exptime, priority, resolution, reference_arm,
 0e0 as pmra, 0e0 as pmdec, 1e-7 as parallax, cast(null as bigint) as tract, cast(null as bigint) as patch from targets"""

# --- visibility ---

PHI = math.radians(19.8255)
RATE = "150410686e-7"


def limit(angle: float) -> str:
    s = f"{math.sin(math.radians(angle))!r}::double"
    return (
        f"degrees(acos(greatest(-1e0, least(1e0, ({s} - {math.sin(PHI)!r}::double * sin(radians(dec))) / "
        f"({math.cos(PHI)!r}::double * cos(radians(dec)))))))"
    )


def seconds(source: str, least_run: str = "9e2", name: str = "sec") -> str:
    """CTE with the first long enough stretch of every night of ``source`` (ra, dec, night)."""
    sid = f"28046061837e-8 + 36098564736629e-11 * (b/864e2 + 24405875e-1 - 2451545e0) - 1554761e-4 - ra + 18e1"

    def stretch(lo: str, hi: str) -> str:
        return f"floor(greatest(0e0, least({hi}, a + night_len) - greatest({lo}, a)) / {RATE} * 36e2)"

    s = []
    for turn in ("0e0", "36e1"):
        s.append(stretch(f"{turn} - lo", f"case when hi > 0 then {turn} - hi else {turn} + lo end"))
        s.append(stretch(f"{turn} + hi", f"case when hi > 0 then {turn} + lo else {turn} + hi end"))
    first = " ".join(f"when s{i} >= {least_run} then s{i}" for i in range(4))
    return f"""{name}_1 as (select *, epoch(cast(night as timestamp) + interval '28 hours' + interval '30 minutes') as b,
  epoch(cast(night as timestamp) + interval '39 hours' + interval '30 minutes') as e, {limit(30.0)} as lo, {limit(85.0)} as hi from {source}),
{name}_2 as (select *, ({sid}) - 36e1*floor(({sid})/36e1) - 18e1 as a, (e - b)/36e2*{RATE} as night_len from {name}_1),
{name}_3 as (select *, {', '.join(f'{x} as s{i}' for i, x in enumerate(s))} from {name}_2),
{name} as (select *, case {first} else 0 end as seconds from {name}_3)"""


def pixel(source: str, name: str = "px") -> str:
    """CTE that adds ``pixel`` (ring order, 32)."""
    n = 32
    return f"""{name}_1 as (select *, sin(radians(dec)) as z, (ra - 36e1*floor(ra/36e1))/9e1 as t from {source}),
{name}_2 as (select *, floor({n}*(5e-1+t) - {n}*75e-2*z) as jp, floor({n}*(5e-1+t) + {n}*75e-2*z) as jm,
  floor((t-floor(t))*{n}*sqrt(3*(1-abs(z)))) as cp, floor((1-(t-floor(t)))*{n}*sqrt(3*(1-abs(z)))) as cm from {name}_1),
{name}_3 as (select *, {n}+1+jp-jm as ring, cp+cm+1 as cap from {name}_2),
{name}_4 as (select *, floor((jp+jm-{n}+(1-(ring-2*floor(ring/2)))+1)/2) as q, floor(t*cap) as cq from {name}_3),
{name} as (select *, cast(case when abs(z) <= 2e0/3e0 then 2*{n}*({n}-1)+(ring-1)*4*{n}+(q-4*{n}*floor(q/(4*{n})))
  when z > 0 then 2*cap*(cap-1)+(cq-4*cap*floor(cq/(4*cap)))
  else 12*{n}*{n}-2*cap*(cap+1)+(cq-4*cap*floor(cq/(4*cap))) end as bigint) as pixel from {name}_4)"""


GROUPS = """grp as (select list_no, pixel, max(exptime) as max_exptime, arg_min(ra, row_id) as ra, arg_min(dec, row_id) as dec from px group by list_no, pixel)"""
SPRING = "unnest(generate_series(date '2026-02-01', date '2026-07-31', interval 1 day)) as night"
PIXEL_VISIBLE = (
    pixel("%s") + ",\n" + GROUPS + f",\nnights as (select *, {SPRING} from grp),\n" + seconds("nights") + """,
verdict as (select list_no, pixel, sum(seconds) >= max(max_exptime) as ok_visible from sec group by list_no, pixel)"""
)
VISIBLE = cte("targets") + ",\n" + PIXEL_VISIBLE.replace("%s", "targets")

ORACLES["sky_pixels"] = cte("targets") + ",\n" + pixel("targets") + "\nselect row_id, pixel from px"
ORACLES["pixel_groups"] = cte("targets") + ",\n" + pixel("targets") + ",\n" + GROUPS + """
select list_no, pixel, max_exptime, round(ra, 9) as ra, round(dec, 9) as dec from grp"""
NIGHTS = """lists as (select distinct list_no from targets),
cal as (select list_no, cast(unnest(generate_series(date '2026-02-01', date '2026-07-20' + list_no, interval 1 day)) as date) as night,
  date '2026-07-20' + list_no as last from lists)"""
ORACLES["night_calendar"] = cte("targets") + ",\n" + NIGHTS + """
select list_no, night, cast(night as timestamp) + interval '28 hours' + interval '30 minutes' as begin_utc,
 cast(night as timestamp) + interval '39 hours' + interval '30 minutes' as end_utc from cal"""
ORACLES["night_calendar_split"] = cte("targets") + ",\n" + NIGHTS + """,
k as (select list_no, night - date '2026-02-01' as k, last - date '2026-02-01' as span from cal)
select list_no, count(*) as n_nights, cast(sum(k) as bigint) as day_sum from k
where k <> cast(floor(span/2e0) as bigint) and not (span % 2 = 1 and k = span) group by list_no"""
ORACLES["observable_seconds"] = cte("targets") + ",\n" + pixel("targets") + ",\n" + GROUPS + """,
nights as (select *, cast(unnest(generate_series(date '2026-02-01', date '2026-02-20', interval 1 day)) as date) as night from grp),
""" + seconds("nights") + "\nselect list_no, pixel, night, round(seconds/6e1) as minutes from sec"
ORACLES["target_visibility"] = VISIBLE + "\nselect row_id, ok_visible from px join verdict using (list_no, pixel)"
ORACLES["target_visibility_exact"] = cte("targets") + f",\nnights as (select *, {SPRING} from targets),\n" + seconds(
    "nights", "exptime"
) + "\nselect row_id, sum(seconds) >= max(exptime) as ok_visible from sec group by row_id"
ORACLES["visibility_status"] = VISIBLE + """
select list_no, count(*) filter (where not ok_visible) as n_invisible,
 case when bool_and(ok_visible) then 'all' when bool_or(ok_visible) then 'some' else 'none' end as visible, bool_or(ok_visible) as status
from px join verdict using (list_no, pixel) group by list_no"""

ORACLES["visibility_ranges"] = cte("targets") + ",\n" + pixel("targets") + """,
grp as (select pixel, arg_min(ra, row_id) as ra, arg_min(dec, row_id) as dec from px group by pixel),
year as (select *, cast(unnest(generate_series(date '2026-02-01', date '2026-12-31', interval 1 day)) as date) as night from grp),
""" + seconds("year") + """,
asked as (select list_no, pixel, max(exptime) as max_exptime, date '2026-02-01' + list_no*17 as b0, date '2026-07-31' + list_no*16 as e0 from px group by all)
select list_no, pixel, max_exptime, cast(sum(seconds) as bigint) as seconds, sum(seconds) >= max_exptime as ok_visible
from asked join sec using (pixel) where night between b0 and e0 group by list_no, pixel, max_exptime"""

# --- flux ---

FLUX = """flux as (select *, case when g_hsc is not null then 'g_hsc' when g_ps1 is not null then 'g_ps1' end as filter_g,
 case when g_hsc is not null then g_hsc else g_ps1 end as flux_g, %s as flux_error_g,
 case when r2_hsc is not null then 'r2_hsc' end as filter_r, r2_hsc as flux_r, cast(null as double) as flux_error_r,
 %s as filter_i, %s as flux_i, cast(null as double) as flux_error_i from %s)"""
CLEAN_FLUX = cte("targets") + ",\n" + FLUX % (
    "case when g_hsc is not null then g_hsc_error end", "case when i2_hsc is not null then 'i2_hsc' end", "i2_hsc", "targets"
)
OK_FLUX = "(filter_g is not null or filter_r is not null or filter_i is not null)"
ORACLES["flux_resolve"] = CLEAN_FLUX + f"""
select row_id, filter_g, flux_g, flux_error_g, filter_r, flux_r, flux_error_r, filter_i, flux_i, flux_error_i, {OK_FLUX} as ok_flux from flux"""
ORACLES["flux_status"] = CLEAN_FLUX + f"""
select list_no, bool_and({OK_FLUX}) as status, count(*) filter (where not {OK_FLUX}) as n_no_flux from flux group by list_no"""
ORACLES["flux_filters_in_use"] = CLEAN_FLUX + """,
long as (select list_no, unnest([filter_g, filter_r, filter_i]) as f from flux)
select list_no, string_agg(f, ',' order by f) as filters from (select distinct list_no, f from long where f is not null) group by list_no"""
ORACLES["flux_skipped"] = CLEAN_FLUX + """
select row_id, 'g' as band, 'g_hsc' as used, 'g_ps1' as skipped from flux where g_hsc is not null and g_ps1 is not null"""
ORACLES["flux_bands_kept"] = CLEAN_FLUX + """,
c as (select list_no, count(filter_g) g, count(filter_r) r, count(filter_i) i, count(flux_error_g) eg from flux group by list_no)
select list_no, concat_ws(',', case when g > 0 then 'filter_g' end, case when r > 0 then 'filter_r' end, case when i > 0 then 'filter_i' end,
 case when g > 0 then 'flux_g' end, case when r > 0 then 'flux_r' end, case when i > 0 then 'flux_i' end,
 case when g > 0 and eg > 0 then 'flux_error_g' end) as columns from c"""

# --- validation ---


def validation(source: str) -> str:
    no_i = ("cast(null as double)", "cast(null as varchar)", "cast(null as double)")
    return (
        PIXEL_VISIBLE.replace("%s", source) + ",\n" + STR_FLAGS % source + ",\n" + VALUE_FLAGS % "strs" + ",\n" + UNIQUE % "vals" + ",\n"
        + FLUX % (*no_i, "uniq") + f""",
flags as (select f.*, ok_str_ob_code and ok_str_resolution and ok_str_reference_arm as ok_str, {ALL_VALUES} as ok_values, {OK_FLUX} as ok_flux,
 coalesce(v.ok_visible, false) as ok_visible, ok_code and ok_pair as ok_unique
 from flux f left join px on px.row_id = f.row_id left join verdict v on v.list_no = px.list_no and v.pixel = px.pixel),
lists as (select list_no, bool_and(ok_str) as s, bool_and(ok_values) as v, count(*) as n,
 count(*) filter (where not ok_str) as n_str, count(*) filter (where not ok_values) as n_values, count(*) filter (where not ok_flux) as n_flux,
 count(*) filter (where not ok_visible) as n_vis, count(*) filter (where not ok_unique) as n_uni,
 concat_ws(',', case when bool_or(not ok_ra) then 'ra' end, case when bool_or(not ok_dec) then 'dec' end, case when bool_or(not ok_priority) then 'priority' end,
  case when bool_or(not ok_exptime) then 'exptime' end, case when bool_or(not ok_resolution) then 'resolution' end,
  case when bool_or(not ok_reference_arm) then 'reference_arm' end) as bad_columns,
 concat_ws(',', case when bool_or(filter_g = 'g_hsc') then 'g_hsc' end, case when bool_or(filter_g = 'g_ps1') then 'g_ps1' end,
  case when count(filter_i) > 0 then 'i2_hsc' end, case when count(filter_r) > 0 then 'r2_hsc' end) as used from flags group by list_no)"""
    )


MIXED = cte("targets", "targets_dirty") + """,
mixed as (select * from targets_dirty where list_no % 2 = 1 union all
 select row_id, obj_id, ob_code, ra, dec, exptime, priority, resolution, reference_arm, g_hsc, g_ps1, r2_hsc, list_no from targets where list_no % 2 = 0),
"""
ORACLES["validation_flags"] = MIXED.replace(
    "select * from targets_dirty", "select row_id, obj_id, ob_code, ra, dec, exptime, priority, resolution, reference_arm, g_hsc, g_ps1, r2_hsc, list_no from targets_dirty"
) + validation("mixed") + """
select row_id, ok_str, case when s then ok_values end as ok_values, case when s and v then ok_flux end as ok_flux,
 case when s and v then ok_visible end as ok_visible, case when s and v then ok_unique end as ok_unique from flags join lists using (list_no)"""
ORACLES["validation_report"] = ORACLES["validation_flags"][: ORACLES["validation_flags"].rindex("\nselect row_id")] + """,
rep as (
 select list_no, 'required_columns' as "check", 'info' as severity, true as status, 0 as n_bad, '' as detail from lists
 union all select list_no, 'optional_columns', 'warning', false, 5, 'pmra,pmdec,parallax,tract,patch' from lists
 union all select list_no, 'strings', case when s then 'info' else 'error' end, s, n_str, '' from lists
 union all select list_no, 'values', case when v then 'info' else 'error' end, v, n_values, bad_columns from lists where s
 union all select list_no, 'flux', case when n_flux = 0 then 'info' else 'error' end, n_flux = 0, n_flux, used from lists where s and v
 union all select list_no, 'visibility', case when n_vis = n then 'error' when n_vis > 0 then 'warning' else 'info' end, n_vis < n, n_vis, '' from lists where s and v
 union all select list_no, 'unique', case when n_uni = 0 then 'info' else 'error' end, n_uni = 0, n_uni, '' from lists where s and v)
select list_no, "check", severity, status, cast(n_bad as bigint) as n_bad, detail from rep"""
ORACLES["validation_status"] = cte("targets") + ",\n" + validation("targets").replace(
    "cast(null as varchar) as filter_i", "case when i2_hsc is not null then 'i2_hsc' end as filter_i"
) + """
select list_no, s as status_str, case when s then v end as status_values, case when s and v then n_flux = 0 end as status_flux,
 case when s and v then n_vis < n end as status_visible, case when s and v then n_uni = 0 end as status_unique,
 s and v and n_flux = 0 and n_vis < n and n_uni = 0 as status,
 case when s and v and n_flux = 0 and n_vis < n and n_uni = 0 then 'success_with_warnings' else 'failed' end as label, n as n_rows from lists"""
ORACLES["offending_rows"] = cte("targets_dirty") + ",\n" + STR_FLAGS % "targets_dirty" + ",\n" + VALUE_FLAGS % "strs" + ",\n" + UNIQUE % "vals" + ",\n" + FLUX % (
    "cast(null as double)", "cast(null as varchar)", "cast(null as double)", "uniq"
) + f"""
select row_id, list_no, 'str' as "check" from flux where not (ok_str_ob_code and ok_str_resolution and ok_str_reference_arm)
union all select row_id, list_no, 'values' from flux where not ({ALL_VALUES})
union all select row_id, list_no, 'flux' from flux where not {OK_FLUX}
union all select row_id, list_no, 'unique' from flux where not (ok_code and ok_pair)"""

# --- reports ---

ORACLES["target_summary"] = cte("targets") + """,
lab as (select list_no, resolution, exptime, case when priority between 0 and 9 then cast(priority as varchar) else 'Other' end as p from targets
 union all select list_no, resolution, exptime, 'Total' from targets),
frame as (select list_no, unnest(['0','1','2','3','4','5','6','7','8','9','Other','Total']) as p from (select distinct list_no from targets))
select f.list_no, f.p as "Priority", count(*) filter (where resolution = 'L') as "N (L)",
 round(coalesce(sum(exptime) filter (where resolution = 'L'), 0)/36e2, 6) as "Texp (L)", count(*) filter (where resolution = 'M') as "N (M)",
 round(coalesce(sum(exptime) filter (where resolution = 'M'), 0)/36e2, 6) as "Texp (M)"
from frame f left join lab l on l.list_no = f.list_no and l.p = f.p group by f.list_no, f.p"""
ROT = "(({t}+3e2)*{n} + ({t}+3e2)*{n}/88e-1*12e-1)/36e2"
ORACLES["request_time"] = cte("pointings", "allocations") + f"""
select ppc_code, n_frames, round({ROT.format(t='9e2', n='n_frames')}, 6) as rot, round({ROT.format(t='45e1', n='n_frames')}, 6) as rot_short
from (select ppc_code, count(*) as n_frames from allocations join pointings using (ppc_code) group by ppc_code)"""
ORACLES["frames_from_time"] = cte("targets") + """
select row_id, cast(round_even(exptime/36e1/(1e1/88e-1)*36e2/12e2, 0) as int) as frames,
 cast(round_even(exptime/36e1/(1e1/88e-1)*36e2/75e1, 0) as int) as frames_short from targets"""
ORACLES["pointing_list"] = BASE3 + """,
ranked as (select *, row_number() over (partition by ppc_resolution order by ppc_priority nulls last, ppc_code) as k,
 max(ppc_priority) over (partition by ppc_resolution) as top from stored)
select k as "PPC_id", concat('Point_', case ppc_resolution when 'L' then 'low' else 'medium' end, '_', cast(k as varchar)) as ppc_code, ppc_code as source_code,
 round(ppc_ra, 6) as ppc_ra, round(ppc_dec, 6) as ppc_dec, ppc_pa, ppc_resolution, round(ppc_priority/top*1e3, 6) as ppc_priority,
 round(tel_fiber_usage_frac, 6) as "Fiber usage fraction (%)" from ranked"""
ORACLES["pointing_statistics"] = BASE3 + """
select ppc_code, n_assigned, round(tel_fiber_usage_frac, 9) as tel_fiber_usage_frac, round(ppc_priority, 9) as ppc_priority from stored"""
P = ", ".join(f"max(case when priority = '{p}' then fh_pct end) as \"P_{p}\"" for p in ["all", *range(10)])
P_ROUND = ", ".join(f'round("P_{p}", 6) as "P_{p}"' for p in ["all", *range(10)])
P_NULL = ", ".join(f'cast(null as double) as "P_{p}"' for p in ["all", *range(10)])


def summary(cut: str, final: str = "select * from full_rep") -> str:
    """Summary of the first pointings of every resolution; ``cut`` gives the number by resolution."""
    rot = ROT.format(t="9e2", n="n")
    return MODE_CURVE + f""",
cut as ({cut}),
fig as (select r.ppc_resolution, count(*) as n, sum(n_assigned) as fibers, avg(tel_fiber_usage_frac) as mean, count(*) filter (where tel_fiber_usage_frac < 30) as low
 from ranked r join cut c on c.ppc_resolution = r.ppc_resolution and r.ppc_id <= c.k group by r.ppc_resolution),
wide as (select ppc_resolution, ppc_id, {P} from curve group by ppc_resolution, ppc_id),
rep as (select case fig.ppc_resolution when 'L' then 'low' else 'medium' end as resolution, n as "N_ppc", n*25e-2 as "Texp (h)", fibers*25e-2 as "Texp (fiberhour)",
 {rot} as "Request time (h)", mean as "Used fiber fraction (%)", low/cast(n as double)*1e2 as "Fraction of PPC < 30% (%)", wide.* exclude (ppc_resolution, ppc_id)
 from fig join wide on wide.ppc_resolution = fig.ppc_resolution and wide.ppc_id = fig.n),
full_rep as (select * from rep union all
 select 'Total', cast(sum("N_ppc") as bigint), sum("Texp (h)"), sum("Texp (fiberhour)"), sum("Request time (h)"), sum("Used fiber fraction (%)"), null, {P_NULL} from rep)
{final}"""


ROUND_SUMMARY = f"""select resolution, "N_ppc", round("Texp (h)", 6) as "Texp (h)", round("Texp (fiberhour)", 6) as "Texp (fiberhour)", round("Request time (h)", 6) as "Request time (h)",
 round("Used fiber fraction (%)", 6) as "Used fiber fraction (%)", round("Fraction of PPC < 30% (%)", 6) as "Fraction of PPC < 30% (%)", {P_ROUND} from full_rep"""
ORACLES["pointing_summary"] = summary("select distinct ppc_resolution, 4 as k from stored", ROUND_SUMMARY)
ORACLES["reproduce_report"] = summary(
    "select ppc_resolution, case when ppc_resolution = 'L' and count(*) >= 2 then count(*)//2 else count(*) end as k from stored group by 1", ROUND_SUMMARY
)
ORACLES["run_facts"] = summary(
    "select ppc_resolution, count(*) as k from stored group by 1",
    """select max("N_ppc") filter (where resolution = 'Total') as n,
 printf('pointings: %d', max("N_ppc") filter (where resolution = 'Total')) || chr(10) ||
 printf('fiber hours: %.1f', max("Texp (fiberhour)") filter (where resolution = 'Total')) || chr(10) ||
 printf('exposure hours without overhead: %.1f (%d x 15.00 min)',
   max("Texp (h)") filter (where resolution = 'Total'), max("N_ppc") filter (where resolution = 'Total')) || chr(10) ||
 printf('hours with overhead: %.1f', ceil(max("Request time (h)") filter (where resolution = 'Total')*1e1)/1e1) || chr(10) ||
 printf('completed, low: %.0f%%', max("P_all") filter (where resolution = 'low')) || chr(10) ||
 printf('completed, medium: %.0f%%', max("P_all") filter (where resolution = 'medium')) as facts from full_rep""",
)
ORACLES["request_status"] = cte("targets") + f""",
l as (select list_no, count(*) % 211 as m from targets group by list_no),
s as (select list_no, case when list_no % 4 <> 1 then ceil({ROT.format(t='9e2', n='m')}*1e1)/1e1 else 0e0 end as h,
 case list_no % 3 when 0 then 999 when 1 then 2 else 1 end as status, list_no % 4 <> 1 as has_result from l)
select list_no, round(h, 6) as shown_hours, case when status = 999 and h > 35 then 'warning' when status = 1 then 'error_timeout'
 when status = 2 and not has_result then 'error_no_assignment' else 'success' end as outcome, h > 35 as over_limit,
 case status when 2 then 'user' when 0 then 'skip' else 'auto' end as label from s"""
ORACLES["report_guard"] = BASE3 + """,
m as (select cast(ppc_no % 10 as bigint) as list_no, ppc_resolution, bool_or(tel_fiber_usage_frac > 0) as any_used from stored group by all)
select list_no, bool_and(any_used) as has_result from m group by list_no"""
ORACLES["observation_rule"] = """
select c_custkey, case c_custkey % 3 when 0 then 'classical' when 1 then 'queue' else 'filler' end as obs_type,
 case when c_custkey % 3 = 0 then c_custkey % 7 * 1e2 + 3e2 else 9e2 end as single_exptime, c_custkey % 3 = 0 as use_pointing_list from customer"""

# --- catalog ---

SEM = """case when {t} < make_timestamp(year({t}),2,1,0,0,0) then printf('S%02dB', (year({t})-1) % 100)
 when {t} <= make_timestamp(year({t}),3,15,0,0,0) then printf('S%02dB', year({t}) % 100)
 when {t} < make_timestamp(year({t}),8,1,0,0,0) then printf('S%02dA', year({t}) % 100)
 when {t} <= make_timestamp(year({t}),9,15,0,0,0) then printf('S%02dA', (year({t})+1) % 100)
 when {t} is not null then printf('S%02dB', year({t}) % 100) end"""


def sem(t: str) -> str:
    return SEM.format(t=f"cast({t} as timestamp)")


CATALOG = cte("targets") + f""",
m as (select list_no, resolution, count(*) as n, sum(exptime)/36e2 as h from targets group by all),
cat0 as (select list_no, max(case when resolution = 'L' then n end) as nl, max(case when resolution = 'M' then n end) as nm, sum(n) as n_obj, sum(h) as h from m group by list_no),
meta as (select list_no, max(submitted_at) as ts from targets group by list_no),
cat as (select concat('u', list_no) as id, list_no <> 9 as ok, list_no in (1, 2, 5) as tac, cat0.*, meta.ts from cat0 join meta using (list_no))"""
ORACLES["catalog_rows"] = CATALOG + f"""
select case when ok then id end as "Upload ID", tac as "TAC_done", cast(n_obj as bigint) as n_obj, round(h, 6) as "Exptime_tgt (FH)",
 case when ok then round(nl*25e-2, 6) else 0e0 end as "Exptime_sci_L (h)", case when ok then round(nm*25e-2, 6) else 0e0 end as "Exptime_sci_M (h)",
 case when ok then round(nl*25e-1, 6) else 0e0 end as "Exptime_sci_L (FH)", case when ok then round(nm*25e-1, 6) else 0e0 end as "Exptime_sci_M (FH)",
 case when list_no = 4 then round(nl*5e-1, 6) when ok then round(nl*375e-3, 6) else 0e0 end as "Time_tot_L (h)", case when list_no = 4 then round(nm*5e-1, 6) when ok then round(nm*375e-3, 6) else 0e0 end as "Time_tot_M (h)",
 case when tac then round(nl*125e-2, 6) else 0e0 end as "TAC_FH_L", case when tac then round(nm*125e-2, 6) else 0e0 end as "TAC_FH_M",
 case when tac then nl//2 else 0 end as "TAC_nppc_L", case when tac then nm//2 else 0 end as "TAC_nppc_M",
 case when tac then round(nl*1875e-4, 6) else 0e0 end as "TAC_ROT_L", case when tac then round(nm*1875e-4, 6) else 0e0 end as "TAC_ROT_M",
 case when ok then concat('list_', list_no, '.csv') end as "Filename", case when ok and list_no % 5 = 0 then 450 else 900 end as single_exptime,
 case when ok then case when list_no % 2 = 0 then 'queue' else 'classical' end end as observation_type,
 case when ok then {sem('ts')} end as semester, ok as is_complete from cat"""
ORACLES["catalog_totals"] = CATALOG + """
select count(*) filter (where tac) as n_allocated, round(sum(case when tac then nl*125e-2 else 0 end), 6) as "FH_L", round(sum(case when tac then nm*125e-2 else 0 end), 6) as "FH_M",
 cast(sum(case when tac then nl//2 else 0 end) as bigint) as "nppc_L", cast(sum(case when tac then nm//2 else 0 end) as bigint) as "nppc_M",
 round(sum(case when tac then nl*1875e-4 else 0 end), 6) as "ROT_L", round(sum(case when tac then nm*1875e-4 else 0 end), 6) as "ROT_M" from cat"""
ORACLES["catalog_filter"] = CATALOG + f"""
select id as "Upload ID", cast(n_obj as bigint) as n_obj, {sem('ts')} as semester from cat where ok and h >= 1 and nl*(case when list_no = 4 then 5e-1 else 375e-3 end) >= 1 and nm*(case when list_no = 4 then 5e-1 else 375e-3 end) >= 1"""
ORACLES["catalog_bounds"] = CATALOG + """,
b as (select n_obj, h, case when list_no = 4 then nl*5e-1 when ok then nl*375e-3 else 0 end as l, case when list_no = 4 then nm*5e-1 when ok then nm*375e-3 else 0 end as m from cat)
select cast(floor(min(n_obj)/1e1)*10 as bigint) as n_obj_min, cast(ceil(max(n_obj)/1e1)*10 as bigint) as n_obj_max, cast(floor(min(h)) as bigint) as fiberhours_min,
 cast(ceil(max(h)) as bigint) as fiberhours_max, cast(floor(min(l)) as bigint) as rot_low_min, cast(ceil(max(l)) as bigint) as rot_low_max,
 cast(floor(min(m)) as bigint) as rot_medium_min, cast(ceil(max(m)) as bigint) as rot_medium_max from b"""
ORACLES["catalog_semesters"] = cte("targets") + f"\nselect distinct {sem('submitted_at')} as semester from targets"
ORACLES["semester_labels"] = cte("targets") + f"\nselect row_id, {sem('submitted_at')} as semester from targets"
ORACLES["catalog_in_semester"] = cte("targets") + f"\nselect * from (select row_id, {sem('submitted_at')} as semester from targets) where semester = 'S98A'"
ORACLES["catalog_merge_allocation"] = CATALOG + """
select id as "Upload ID", tac as "TAC_done", case when tac then round(nl*125e-2, 6) else 0e0 end as "TAC_FH_L", case when tac then round(nm*125e-2, 6) else 0e0 end as "TAC_FH_M",
 case when tac then nl//2 else 0 end as "TAC_nppc_L", case when tac then nm//2 else 0 end as "TAC_nppc_M",
 case when tac then round(nl*1875e-4, 6) else 0e0 end as "TAC_ROT_L", case when tac then round(nm*1875e-4, 6) else 0e0 end as "TAC_ROT_M" from cat where ok"""
ORACLES["catalog_proposal_join"] = cte("targets") + """
select l.list_no as "Upload ID", l.n_obj, c_name as "PI name", c_acctbal as rank from (select list_no, count(*) as n_obj from targets group by list_no) l
join customer on c_custkey % 10 = l.list_no where c_acctbal > 0"""
ORACLES["ambiguous_ids"] = cte("registry") + """
select upload_id, count(distinct user_id) as n_directories from registry group by upload_id having count(distinct user_id) <> 1"""
ORACLES["submission_lookup"] = cte("targets") + """
select row_id, concat('u', list_no) as upload_id, exptime from targets where list_no = 4 and year(submitted_at) = 1997 and month(submitted_at) = 5"""
HALF = """case when month(d) = 1 then make_date(year(d)-1,8,1) when month(d) <= 7 then make_date(year(d),2,1) else make_date(year(d),8,1) end"""
ORACLES["semester_range"] = cte("targets") + f""",
s as (select row_id, d, {HALF} as b from (select row_id, cast(submitted_at as date) as d from targets))
select row_id, b as this_begin, cast(b + interval 6 month - interval 1 day as date) as this_end, cast(b + interval 6 month as date) as next_begin,
 cast(b + interval 12 month - interval 1 day as date) as next_end from s"""

# --- registry ---

CANDIDATES = "cand as (select substring(md5(cast(event_id*2 as varchar)), 1, 16) as upload_id from events)"
ORACLES["registry_repeats"] = cte("registry") + "\nselect upload_id, count(*) - 1 as n_extra from registry group by upload_id having count(*) > 1"
ORACLES["registry_dedup"] = cte("registry") + "\nselect distinct upload_id from registry"
ORACLES["registry_existing"] = cte("registry") + f",\n{CANDIDATES}\nselect upload_id from cand where upload_id in (select upload_id from registry)"
ORACLES["registry_anti"] = cte("registry") + f",\n{CANDIDATES}\nselect upload_id from cand where upload_id not in (select upload_id from registry)"
ORACLES["registry_assign"] = """
select o_orderkey, substring(sha256(concat(case when o_orderkey % 7 = 0 then '1|' else '0|' end, o_orderkey)), 1, 16) as upload_id from orders"""

# --- sky ---

ORACLES["local_density"] = cte("targets") + f"""
select row_id, count(*) over (partition by list_no, {CELL}) as wrapped, count(*) over (partition by list_no, cast(trunc(ra) as bigint), floor(dec)) as plain from targets"""
R = math.radians(0.69)


def corners(source: str) -> str:
    """CTE ``corner``: six vertices of every field of ``source``, moved next to the centre."""
    return f"""corner_1 as (select *, radians(30e0 + 60e0*vertex + ppc_pa) as b from (select *, unnest(range(6)) as vertex from {source})),
corner_2 as (select *, sin(radians(ppc_dec))*{math.cos(R)!r}::double + cos(radians(ppc_dec))*{math.sin(R)!r}::double*cos(b) as s from corner_1),
corner_3 as (select *, ppc_ra + degrees(atan2(sin(b)*{math.sin(R)!r}::double*cos(radians(ppc_dec)), {math.cos(R)!r}::double - sin(radians(ppc_dec))*s)) as x0, degrees(asin(s)) as y from corner_2),
corner_4 as (select *, x0 - 36e1*floor(x0/36e1) as x1 from corner_3),
corner as (select *, case when x1 - ppc_ra > 180 then x1 - 360 when x1 - ppc_ra < -180 then x1 + 360 else x1 end as x from corner_4)"""


SEP = "degrees(2*asin(sqrt(least(1e0, pow(sin(radians({d2}-{d1})/2),2) + cos(radians({d1}))*cos(radians({d2}))*pow(sin(radians({r2}-{r1})/2),2)))))"


def in_field(source: str, targets: str = "targets") -> str:
    """CTE ``inside``: pairs of a target and a field that contains it."""
    sides = " + ".join(
        f"(case when (y[{k+1}] > dec) <> (y[{(k+1)%6+1}] > dec) and rx < x[{k+1}] + (dec - y[{k+1}])*(x[{(k+1)%6+1}] - x[{k+1}])/nullif(y[{(k+1)%6+1}] - y[{k+1}], 0) then 1 else 0 end)"
        for k in range(6)
    )
    return corners(source) + f""",
hex as (select ppc_no, ppc_code, ppc_ra, ppc_dec, ppc_resolution, list(x order by vertex) as x, list(y order by vertex) as y from corner group by all),
near_field as (select h.*, t.*, case when ra - ppc_ra > 180 then ra - 360 when ra - ppc_ra < -180 then ra + 360 else ra end as rx
 from hex h join {targets} t on t.dec between h.ppc_dec - 1 and h.ppc_dec + 1),
inside as (select * from near_field where ({sides}) % 2 = 1)"""


ORACLES["field_outline"] = cte("pointings") + ",\n" + corners("pointings") + """
select ppc_code, vertex, round(x, 9) as vertex_ra, round(y, 9) as vertex_dec from corner"""
ORACLES["targets_in_field"] = cte("targets", "pointings") + ",\n" + in_field("pointings") + "\nselect ppc_code, ob_code from inside"
ORACLES["targets_in_field_by_mode"] = cte("targets", "pointings") + ",\n" + in_field("pointings") + """
select resolution, ppc_code, ob_code from inside where ppc_resolution = resolution"""
ORACLES["sky_extent"] = cte("targets", "pointings") + """,
b as (select list_no, ra, dec from targets union all select cast(ppc_no % 10 as int), ppc_ra, ppc_dec from pointings)
select list_no, round(min(ra) - 138e-2, 6) as ra_min, round(max(ra) + 138e-2, 6) as ra_max, round(min(dec) - 138e-2, 6) as dec_min, round(max(dec) + 138e-2, 6) as dec_max from b group by list_no"""


def components(points: str, keys: list[str], eps: str, compare: str = "<=", steps: int = 7) -> str:
    """CTE ``comp`` (keys, id, label): smallest id linked by steps within ``eps``; labels double their reach per step."""
    on = "".join(f" and a.{k} = b.{k}" for k in keys)
    ks = "".join(f"a.{k}, " for k in keys)
    names = "".join(f"{k}, " for k in keys)
    text = f"""pair as materialized (select {ks} a.id as a, b.id as b from {points} a join {points} b on abs(a.dec - b.dec) {compare} {eps}{on}
 and {SEP.format(r1='a.ra', d1='a.dec', r2='b.ra', d2='b.dec')} {compare} {eps}),
lab0 as (select {names} a as id, min(b) as label from pair group by all)"""
    for i in range(steps):
        text += f""",
hop{i} as materialized (select {ks} a.a as id, min(l.label) as label from pair a join lab{i} l on l.id = a.b{''.join(f' and l.{k} = a.{k}' for k in keys)} group by all),
lab{i+1} as materialized (select {ks} a.id, least(a.label, l.label) as label from hop{i} a join hop{i} l on l.id = a.label{''.join(f' and l.{k} = a.{k}' for k in keys)})"""
    return text + f",\ncomp as (select * from lab{steps})"


TARGET_POINTS = "pts as (select *, row_id as id from targets)"
ORACLES["target_clusters"] = cte("targets") + f",\n{TARGET_POINTS},\n" + components("pts", ["list_no"], "138e-2") + """
select id as row_id, label as cluster from comp"""
ORACLES["cluster_order"] = cte("targets") + ",\n" + weights("list_no", "resolution") + ",\npts as (select *, row_id as id from w),\n" + components(
    "pts", ["list_no", "resolution"], "138e-2"
) + """,
s as (select c.list_no, c.resolution, c.label as cluster, count(*) as n_targets, round(sum(w.weight), 6) as total_weight from comp c join w on w.row_id = c.id and w.list_no = c.list_no group by all)
select *, row_number() over (partition by list_no, resolution order by total_weight desc, cluster) as cluster_rank from s"""
ORACLES["near_duplicates"] = cte("targets") + f",\n{TARGET_POINTS},\n" + components("pts", ["list_no"], "(2e0/36e2)", "<") + """
select id as row_id, list_no from comp where id = label"""
POINTING_POINTS = "ppts as (select ppc_no as id, ppc_ra as ra, ppc_dec as dec from pointings)"
ORACLES["pointing_groups"] = cte("pointings") + f",\n{POINTING_POINTS},\n" + components("ppts", [], "138e-2") + """
select id as ppc_no, label as group_id from comp"""
ORACLES["group_coverage"] = cte("targets", "pointings") + f",\n{POINTING_POINTS},\n" + components("ppts", [], "138e-2") + ",\n" + in_field("pointings") + """
select distinct label as group_id, ob_code from inside join comp on comp.id = ppc_no"""

# --- density ---

DENSITY = cte("targets") + ",\n" + weights("list_no", "resolution") + f""",
ext as (select list_no, resolution, min(ra) as r0, max(ra) as r1, min(dec) as d0, max(dec) as d1, count(*) as n_targets from w group by all),
par as (select *, case when (r1-r0)/1e2 < 5e-1 then least(r0*9e-1, r0-1) else 0e0 end as x0, case when (r1-r0)/1e2 < 5e-1 then greatest(r1*11e-1, r1+1) else 360e0 end as x1,
 case when (d1-d0)/1e2 < 5e-1 then least(d0*9e-1, d0-1) else -40e0 end as y0, case when (d1-d0)/1e2 < 5e-1 then greatest(d1*11e-1, d1+1) else 90e0 end as y1,
 case when (r1-r0)/1e2 < 5e-1 then 100 else 720 end as nx, case when (d1-d0)/1e2 < 5e-1 then 100 else 260 end as ny from ext),
rows_y as (select w.list_no, w.resolution, w.ra, w.dec, w.weight, par.* exclude (list_no, resolution), unnest(range(ny+1)) as iy from w join par using (list_no, resolution)),
near_y as (select *, y0 + iy*(y1-y0)/ny as gy from rows_y where abs(y0 + iy*(y1-y0)/ny - dec) < 69e-2),
cell_x as (select *, unnest(range(nx+1)) as ix from near_y),
kern as (select *, x0 + ix*(x1-x0)/nx as gx from cell_x),
val as (select list_no, resolution, ix, iy, gx, gy, weight*(1 - {SEP.format(r1='ra', d1='dec', r2='gx', d2='gy')}/69e-2) as z from kern),
dens as (select list_no, resolution, ix, iy, gx, gy, sum(z) as z from val where z > 0 group by all)"""
ORACLES["density_map"] = DENSITY + """
select list_no, resolution, ix, iy, round(gx, 6) as ra, round(gy, 6) as dec, round(z, 6) as z from dens"""
ORACLES["density_peak"] = DENSITY + """,
st as (select list_no, resolution, sum(z)/max((nx+1)*(ny+1)) as mean, sqrt(sum(z*z)/max((nx+1)*(ny+1)) - pow(sum(z)/max((nx+1)*(ny+1)), 2)) as dev
 from dens join par using (list_no, resolution) group by all),
top as (select *, max(round(z, 6)) over (partition by list_no, resolution) as zmax from dens),
tie as (select *, row_number() over (partition by list_no, resolution order by ix, iy) - 1 as i, count(*) over (partition by list_no, resolution) as m from top where round(z, 6) = zmax)
select list_no, resolution, n_targets, round(case when n_targets = 1 then r0 else gx end, 6) as peak_ra, round(case when n_targets = 1 then d0 else gy end, 6) as peak_dec,
 round(case when n_targets > 1 then (z - mean)/dev end, 6) as significance
from tie join st using (list_no, resolution) join par using (list_no, resolution) where i = cast(round_even(m*5e-1, 0) as bigint)"""

# --- planning ---

ORACLES["topk_allocation"] = cte("targets", "pointings") + ",\n" + weights() + ",\n" + in_field("pointings", "w") + """,
r as (select ppc_code, ob_code, row_number() over (partition by ppc_code order by priority, round(weight, 9) desc, ob_code) as rank from inside)
select * from r where rank <= 100"""
SHIFTS = [(0.15, 0.0), (0.0, 0.15), (-0.15, 0.0), (0.0, -0.15), (0.3, 0.3), (-0.3, 0.3), (-0.3, -0.3), (0.3, -0.3)]
TRIES = " union all ".join(f"select {i + 1} as no, {a!r}::double as da, {d!r}::double as dd" for i, (a, d) in enumerate(SHIFTS))
ORACLES["shifted_pointings"] = cte("targets", "pointings") + f""",
off as (select ppc_no, ppc_code, ppc_ra, ppc_dec + case when ppc_no % 2 = 0 then 162e-2 else -162e-2 end as ppc_dec, ppc_pa, ppc_resolution from pointings),
tries as (select 0 as no, 0e0 as da, 0e0 as dd union all {TRIES}),
moved as (select ppc_no*10 + no as ppc_no, ppc_code, ppc_ra + da - 36e1*floor((ppc_ra + da)/36e1) as ppc_ra, ppc_dec + dd as ppc_dec, ppc_pa, ppc_resolution from off join tries on true),
""" + in_field("moved") + """,
hit as (select distinct ppc_code, ppc_no, ppc_ra, ppc_dec from inside),
first_hit as (select ppc_code, min(ppc_no % 10) as no, arg_min(ppc_ra, ppc_no) as ra, arg_min(ppc_dec, ppc_no) as dec from hit group by ppc_code)
select o.ppc_code, f.no as shift_no, round(coalesce(f.ra, o.ppc_ra), 6) as ppc_ra, round(coalesce(f.dec, o.ppc_dec), 6) as ppc_dec
from off o left join first_hit f using (ppc_code) where f.no is null or f.no > 0"""

# a plan may differ in its pointings, but not in what it keeps
COVERED = cte("targets", "pointings") + ",\n" + in_field("pointings") + """,
need as (select *, cast(ceil(exptime / 900) as bigint) as frames from targets),
fields as (select ob_code, count(*) as n_fields from inside where ppc_resolution = resolution group by ob_code),
placed as (select n.*, coalesce(n_fields, 0) as n_fields, coalesce(n_fields, 0) >= frames as whole from need n left join fields using (ob_code))"""
INVARIANTS = "0::bigint as n_outside, 0::bigint as n_repeated, 0::bigint as n_over_capacity, 0::bigint as n_partial, 0::bigint as n_would_fit"
ORACLES["plan_invariants"] = cte("targets") + f"""
select list_no, resolution, count(*) as n_targets, sum(cast(ceil(exptime / 900) as bigint))::bigint as frames_asked, 0::bigint as frames_left, {INVARIANTS},
 count(*) as n_placed, 0::bigint as n_left, sum(cast(ceil(exptime / 900) as bigint))::bigint as frames_placed from targets group by all"""
# no pointing is filled up by these tables, so that a target is placed if it lies in enough fields
ORACLES["user_plan_invariants"] = COVERED + f"""
select list_no, resolution, count(*) as n_targets, sum(frames)::bigint as frames_asked, coalesce(sum(frames) filter (not whole), 0)::bigint as frames_left,
 {INVARIANTS}, count(*) filter (whole) as n_placed, count(*) filter (not whole) as n_left,
 coalesce(sum(frames) filter (whole), 0)::bigint as frames_placed from placed group by all"""
ORACLES["plan_ledger"] = COVERED + """
select list_no, resolution, ob_code, frames, frames as frames_left, n_fields, n_fields as n_free,
 case when n_fields = 0 then 'no field' else 'all or nothing' end as reason from placed where not whole"""

ORACLES["validation_dates"] = cte("targets") + """
select list_no, count(*) as n_rows, list_no <> 3 as status_dates, false as passed_reversed, case when list_no = 3 then 'error' end as severity,
 case when list_no = 3 then 1::bigint end as n_bad from targets group by list_no"""
