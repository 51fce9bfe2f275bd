"""Row and list checks (schema, strings, values, uniqueness) on many target lists at once.

Flags are boolean columns named ``ok_*``; true means that the row passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.operators.ordered import look_up
from skyloom.schema import (
    ARMS,
    FORBIDDEN_ARMS,
    LARGE_LIST,
    LIST_COLS,
    OPTIONAL,
    OPTIONAL_DEFAULTS,
    REGISTERED,
    REQUIRED,
    RESOLUTIONS,
    STRING_PATTERN,
    TARGET_TYPES,
)

STRING_COLUMNS = [c for c in REQUIRED + OPTIONAL if TARGET_TYPES[c].simpleString() == "string"]
VALUE_COLUMNS = ["ra", "dec", "priority", "exptime", "resolution", "reference_arm"]


def _true(condition: Column) -> Column:
    """Nulls (missing values) fail a check."""
    return F.coalesce(condition, F.lit(False))


# --- columns ----------------------------------------------------------------------


def list_headers(df: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """One row per list with the array of its column names, in file order."""
    names = [c for c in df.columns if c not in list_cols]
    lists = df.select(*list_cols).distinct() if list_cols else df.limit(1).select()
    return lists.withColumn("header", F.array(*[F.lit(c) for c in names]))


def check_columns(headers: DataFrame, list_cols: Sequence[str] = LIST_COLS, header: str = "header") -> DataFrame:
    """Required and optional columns of every list: status, found and missing names, messages."""
    return with_column_check(headers.select(*list_cols, F.col(header).alias("header"))).drop("header")


def with_column_check(lists: DataFrame) -> DataFrame:
    """Add the column check of the array ``header`` to a table of lists."""

    def names(xs):
        return F.array(*[F.lit(x) for x in xs])

    def sentences(column, pattern):
        return F.transform(F.col(column), lambda c: F.format_string(pattern, c))

    default = F.create_map(
        *[F.lit(x) for c in OPTIONAL for x in (c, _default_text(OPTIONAL_DEFAULTS[c]))]
    )
    have = F.col("header")
    found = lists.withColumns(
        {
            "required_found": F.array_intersect(names(REQUIRED), have),
            "required_missing": F.array_except(names(REQUIRED), have),
            "optional_found": F.array_intersect(names(OPTIONAL), have),
            "optional_missing": F.array_except(names(OPTIONAL), have),
        }
    )
    return found.withColumns(
        {
            "required_ok": F.size("required_missing") == 0,
            "optional_ok": F.size("optional_missing") == 0,
            "messages": F.concat(
                sentences("required_found", "required, present: %s"),
                sentences("required_missing", "required, absent: %s"),
                sentences("optional_found", "optional, present: %s"),
                F.transform(
                    F.col("optional_missing"),
                    lambda c: F.format_string(
                        "optional, absent: %s, filled with %s",
                        c,
                        F.element_at(default, c),
                    ),
                ),
            ),
        }
    )


def _default_text(value) -> str:
    return str(int(value)) if value == 0 else f"{value}"


def fill_optional(df: DataFrame) -> DataFrame:
    """Add the optional columns that are absent and fill in their announced defaults."""
    filled = {}
    for name in OPTIONAL:
        default = F.lit(OPTIONAL_DEFAULTS[name]).cast(TARGET_TYPES[name])
        filled[name] = F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumns(filled)


def keep_registered(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Drop columns outside the required, optional and resolved flux columns."""
    keep = set(REGISTERED) | set(extra)
    return df.select(*[c for c in df.columns if c in keep])


def with_object_text(df: DataFrame) -> DataFrame:
    """``obj_id`` as text right after it, for readers that cannot hold 64-bit integers."""
    at = df.columns.index("obj_id") + 1
    columns = df.columns[:at] + ["obj_id_str"] + df.columns[at:]
    return df.withColumn("obj_id_str", F.col("obj_id").cast("string")).select(*columns)


def drop_empty_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns that are null in every row; one aggregation pass decides."""
    candidates = list(candidates or df.columns)
    counts = df.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return df.drop(*[c for c in candidates if counts[c] == 0])


# --- strings and values -----------------------------------------------------------


def string_flags(df: DataFrame) -> DataFrame:
    """``ok_str_<column>`` per string column and ``ok_str`` for all of them."""
    flags = {
        f"ok_str_{c}": _true(F.col(c).rlike(STRING_PATTERN)) for c in STRING_COLUMNS if c in df.columns
    }
    combined = F.lit(True)
    for flag in flags.values():
        combined = combined & flag
    return df.withColumns({**flags, "ok_str": combined})


def value_flags(
    df: DataFrame, list_cols: Sequence[str] = LIST_COLS, arm_scope: str = "row"
) -> DataFrame:
    """``ok_<column>`` for the six value rules and ``ok_values`` for all of them.

    ``arm_scope="list"`` lets one forbidden pair of resolution and arm flag its whole list.
    """
    bad_pair = F.lit(False)
    for resolution, arm in FORBIDDEN_ARMS:
        bad_pair = bad_pair | (
            F.col("resolution").eqNullSafe(resolution) & F.col("reference_arm").eqNullSafe(arm)
        )
    known_arm = _true(F.col("reference_arm").isin(ARMS))
    if arm_scope == "list":
        pairs = df.groupBy(*list_cols).agg(F.bool_or(bad_pair).alias("_bad_pair"))
        df = look_up(df, pairs, list_cols)
        bad_pair = F.coalesce(F.col("_bad_pair"), F.lit(False))
    elif arm_scope != "row":
        raise ValueError("arm_scope must be 'row' or 'list'")
    flags = {
        "ok_ra": _true(F.col("ra").between(0.0, 360.0)),
        "ok_dec": _true(F.col("dec").between(-90.0, 90.0)),
        "ok_priority": _true(F.col("priority").between(0, 9)),
        "ok_exptime": _true((F.col("exptime") > 0.0) & ~F.isnan(F.col("exptime").cast("double"))),
        "ok_resolution": _true(F.col("resolution").isin(RESOLUTIONS)),
        "ok_reference_arm": known_arm & ~bad_pair,
    }
    out = df.withColumns(flags)
    combined = F.lit(True)
    for name in flags:
        combined = combined & F.col(name)
    return out.withColumn("ok_values", combined).drop("_bad_pair")


# --- uniqueness -------------------------------------------------------------------


def unique_flags(
    df: DataFrame, list_cols: Sequence[str] = LIST_COLS, source: DataFrame | None = None
) -> DataFrame:
    """Flag all rows of a repeated ``ob_code`` and of a repeated (``obj_id``, ``resolution``).

    The copies are counted with a partial aggregation before any shuffle, and only the repeated keys
    come back to the rows, so that a key with very many copies never gathers in one task. Nulls are equal to
    each other here: two rows without an ``obj_id`` repeat a key. ``source`` may
    name the plain rows behind ``df``, for a cheaper count.
    """
    source = df if source is None else source
    code = [*list_cols, "ob_code"]
    pair = [*list_cols, "obj_id", "resolution"]

    def repeated(keys, flag):
        return (
            source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            .select(*keys, F.lit(True).alias(flag))
        )

    out = look_up(df, repeated(code, "_dup_code"), code, null_safe=True)
    out = look_up(out, repeated(pair, "_dup_pair"), pair, null_safe=True)
    return out.withColumns(
        {
            "ok_code": F.col("_dup_code").isNull(),
            "ok_pair": F.col("_dup_pair").isNull(),
            "ok_unique": F.col("_dup_code").isNull() & F.col("_dup_pair").isNull(),
        }
    ).drop("_dup_code", "_dup_pair")


def unique_status(
    flagged: DataFrame, list_cols: Sequence[str] = LIST_COLS, lists: DataFrame | None = None
) -> DataFrame:
    """Status and description per list. Lists in ``lists`` without a row fail as empty."""
    out = flagged.groupBy(*list_cols).agg(
        F.bool_and("ok_code").alias("codes_unique"), F.bool_and("ok_pair").alias("pairs_unique")
    )
    if lists is not None:
        out = lists.select(*list_cols).distinct().join(out, list(list_cols), "left")
    code_text = F.when(F.col("codes_unique"), "ob_code: no repeats;").otherwise("ob_code: repeated;")
    pair_text = F.when(F.col("pairs_unique"), "obj_id with resolution: no repeats").otherwise(
        "obj_id with resolution: repeated"
    )
    return out.select(
        *list_cols,
        F.coalesce(F.col("codes_unique") & F.col("pairs_unique"), F.lit(False)).alias("status"),
        F.when(
            F.col("codes_unique").isNull(),
            "the list has no rows",
        ).otherwise(F.concat_ws(" ", code_text, pair_text)).alias("description"),
    )


# --- list level -------------------------------------------------------------------


def list_status(df: DataFrame, flags: Sequence[str], list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """Per list: whether all rows pass each flag, and how many do not."""
    aggs = []
    for flag in flags:
        aggs += [
            F.bool_and(flag).alias(f"status_{flag.removeprefix('ok_')}"),
            F.count_if(~F.col(flag)).alias(f"n_bad_{flag.removeprefix('ok_')}"),
        ]
    return df.groupBy(*list_cols).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def size_notice(df: DataFrame, list_cols: Sequence[str] = LIST_COLS, threshold: int = LARGE_LIST) -> DataFrame:
    """Number of rows per list and whether the list counts as very large."""
    return df.groupBy(*list_cols).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) >= threshold).alias("is_large")
    )


def date_order_ok(begin, end) -> Column:
    """The first date has to precede the last one."""
    return _true(F.col(begin) < F.col(end)) if isinstance(begin, str) else _true(begin < end)


def visible_only(df: DataFrame, flag: str = "ok_visible") -> DataFrame:
    return df.where(F.col(flag))


def offending_rows(
    flagged: DataFrame,
    keys: Sequence[str],
    checks: Sequence[str] = ("str", "values", "flux", "visible", "unique"),
) -> DataFrame:
    """Rows that fail a check, once per failed check, in long form with a ``check`` column."""
    failed = F.array_compact(
        F.array(*[F.when(~F.col(f"ok_{c}"), F.lit(c)) for c in checks if f"ok_{c}" in flagged.columns])
    )
    return flagged.select(*keys, F.explode(failed).alias("check"))
