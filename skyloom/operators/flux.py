"""Photometry columns to bands: at most one flux per band, the leftmost finite one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.schema import BAND_OF, FILTERS, LIST_COLS


def band_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Filter columns of a table by band, in column order."""
    found: dict[str, list[str]] = {band: [] for band in FILTERS}
    for name in columns:
        if name in BAND_OF:
            found[BAND_OF[name]].append(name)
    return found


def _finite(name: str) -> Column:
    # a NaN sorts above infinity, so that one comparison covers both
    return F.coalesce(F.abs(F.col(name).cast("double")) < F.lit(float("inf")), F.lit(False))


def _entry(name: str, columns: Sequence[str]) -> Column:
    error = f"{name}_error"
    error_value = (
        F.when(_finite(error), F.col(error).cast("double"))
        if error in columns
        else F.lit(None).cast("double")
    )
    return F.struct(
        F.lit(name).alias("name"),
        F.col(name).cast("double").alias("flux"),
        error_value.alias("error"),
    )


def _chosen(names: Sequence[str], columns: Sequence[str], order: str | None) -> Column:
    nothing = F.lit(None).cast("struct<name:string,flux:double,error:double>")
    entries = [F.when(_finite(n), _entry(n, columns)) for n in names]
    if not entries:
        return nothing
    if order is None:
        return F.coalesce(*entries, nothing)
    # every list has its own column order: the smallest position in its header wins
    placed = F.array(
        *[
            F.when(
                _finite(n) & (F.array_position(F.col(order), n) > 0),
                F.struct(F.array_position(F.col(order), n).alias("at"), _entry(n, columns).alias("entry")),
            )
            for n in names
        ]
    )
    return F.array_min(F.array_compact(placed))["entry"]


def resolve_flux(df: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``filter_b``, ``flux_b``, ``flux_error_b`` for every band, and ``ok_flux``.

    ``order`` names an array column with the header of each row's list; without it the column order
    of ``df`` decides which flux is leftmost.
    """
    bands = band_columns(df.columns)
    picked = df.withColumns({f"_pick_{b}": _chosen(n, df.columns, order) for b, n in bands.items()})
    out = {}
    for kind, field in (("filter", "name"), ("flux", "flux"), ("flux_error", "error")):
        for band in bands:
            out[f"{kind}_{band}"] = F.col(f"_pick_{band}")[field]
    any_flux = F.coalesce(*[F.col(f"_pick_{b}")["name"] for b in bands]).isNotNull()
    return picked.withColumns({**out, "ok_flux": any_flux}).drop(*[f"_pick_{b}" for b in bands])


def flux_status(resolved: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Per list: do all rows have a flux, and how many do not."""
    return resolved.groupBy(*list_cols).agg(
        F.bool_and("ok_flux").alias("status"), F.count_if(~F.col("ok_flux")).alias("n_no_flux")
    )


def _used(name: str) -> Column:
    return F.max(F.when(F.col(f"filter_{BAND_OF[name]}") == name, name))


def used_filters() -> tuple[list[Column], Column]:
    """Aggregates, one maximum per known filter, and the sorted array of names made of them.

    The state is bounded, and combined before the shuffle.
    """
    names = list(BAND_OF)
    aggs = [_used(n).alias(f"_used_{n}") for n in names]
    return aggs, F.array_sort(F.array_compact(F.array(*[F.col(f"_used_{n}") for n in names])))


def filters_in_use(resolved: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Sorted names of the filters that were chosen at least once in a list."""
    aggs, names = used_filters()
    return resolved.groupBy(*list_cols).agg(*aggs).select(*list_cols, names.alias("filters"))


def skipped_fluxes(resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finite fluxes that lost against another filter of the same band, one row each."""
    rows = []
    for band, names in band_columns(resolved.columns).items():
        for name in names:
            lost = _finite(name) & F.col(f"filter_{band}").isNotNull() & (F.col(f"filter_{band}") != name)
            rows.append(
                F.when(
                    lost,
                    F.struct(
                        F.lit(band).alias("band"),
                        F.col(f"filter_{band}").alias("used"),
                        F.lit(name).alias("skipped"),
                    ),
                )
            )
    if not rows:
        return resolved.limit(0).select(
            *keys, *[F.lit(None).cast("string").alias(c) for c in ("band", "used", "skipped")]
        )
    return resolved.select(*keys, F.inline(F.array_compact(F.array(*rows))))


def band_presence(resolved: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Resolved columns that hold a value somewhere in a list, in order: the ones to export.

    A band without any filter name loses its three columns; otherwise an empty flux or, failing that,
    an empty error column is left out.
    """
    counts = resolved.groupBy(*list_cols).agg(
        *[
            F.count(f"{kind}_{b}").alias(f"{kind}_{b}")
            for b in FILTERS
            for kind in ("filter", "flux", "flux_error")
        ]
    )
    kept = []
    for kind in ("filter", "flux", "flux_error"):
        for b in FILTERS:
            name = f"{kind}_{b}"
            keep = F.col(f"filter_{b}") > 0
            if kind != "filter":
                keep = keep & (F.col(name) > 0)
            if kind == "flux_error":
                # only one of the two columns is dropped, the flux first
                keep = (F.col(f"filter_{b}") > 0) & ((F.col(name) > 0) | (F.col(f"flux_{b}") == 0))
            kept.append(F.when(keep, F.lit(name)))
    return counts.select(*list_cols, F.array_compact(F.array(*kept)).alias("columns"))


def prune_bands(resolved: DataFrame) -> DataFrame:
    """Drop the resolved columns that are empty in the whole table (export of one list)."""
    keep = set(band_presence(resolved, []).first()["columns"])
    names = [f"{kind}_{b}" for kind in ("filter", "flux", "flux_error") for b in FILTERS]
    return resolved.drop(*[n for n in names if n not in keep])
