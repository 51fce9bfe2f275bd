"""How far a set of pointings completes a target list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyloom.operators.ordered import WINDOW_ROWS, dealt, join_back, rank_rows, running_sum
from skyloom.schema import LIST_COLS, SINGLE_EXPTIME


def with_required_exposure(targets: DataFrame, single_exptime: float = SINGLE_EXPTIME) -> DataFrame:
    """Round the exposure up to whole frames: ``exptime_req`` (s) and ``frames``."""
    frames = F.ceil(F.col("exptime") / single_exptime)
    return targets.withColumns(
        {"frames": frames.cast("int"), "exptime_req": frames * F.lit(float(single_exptime))}
    )


def rank_pointings(pointings: DataFrame, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """``ppc_id`` 1..n by ``ppc_priority`` (small is important, missing is last), then by code."""
    return rank_rows(
        pointings, list_cols, [F.col("ppc_priority").asc_nulls_last(), F.col("ppc_code")], "ppc_id"
    )


def assigned_exposure(
    targets: DataFrame,
    bridge: DataFrame,
    single_exptime: float = SINGLE_EXPTIME,
    list_cols: Sequence[str] = LIST_COLS,
) -> DataFrame:
    """Add ``exptime_assign``: one frame per pointing that holds the target."""
    key = [*list_cols, "ob_code"]
    # partial counts per (target, pointing), then per target: a pointing counts once
    frames = (
        bridge.groupBy(*key, "ppc_code").agg(F.lit(1).alias("_once"))
        .groupBy(*key).agg(F.sum("_once").alias("_frames"))
    )
    return (
        join_back(targets, frames, key)
        .withColumn("exptime_assign", F.coalesce(F.col("_frames"), F.lit(0)) * F.lit(float(single_exptime)))
        .drop("_frames")
    )


def completion_curve(
    targets: DataFrame,
    pointings: DataFrame,
    bridge: DataFrame,
    single_exptime: float = SINGLE_EXPTIME,
    list_cols: Sequence[str] = LIST_COLS,
    distinct_links: int | None = None,
) -> DataFrame:
    """Completion after each further pointing, per priority and for ``all``.

    ``targets`` needs ``frames`` and ``exptime_req``; ``pointings`` needs ``ppc_code`` and ``ppc_id``;
    ``bridge`` links ``ppc_code`` to ``ob_code``. Gives fibre-hours (``fh``, not capped at the request),
    the number of complete targets (``n``) and both in per cent of the list. No pointings, no rows.
    A column of ``list_cols`` that ``bridge`` lacks is that of the pointing. ``distinct_links`` is the
    number of links if it is known that none is repeated; otherwise copies are taken out first.
    """
    lists = list(list_cols)
    top = pointings.agg(F.max("ppc_id")).first()[0]  # ranked pointings are a staged table
    key = [*lists, "ob_code"]
    need = targets.select(*key, "priority", "frames")
    place = [c for c in [*lists, "ppc_code"] if c in bridge.columns]
    pairs = bridge.select(*place, "ob_code")
    links = (
        (pairs.distinct() if distinct_links is None else pairs)
        .join(pointings.select(*lists, "ppc_code", "ppc_id"), place)
        .select(*key, "ppc_id", F.lit(1).alias("_one"))
    )
    # a target is complete with its visit number ``frames``; the order of visits is an order of targets, too, so that the
    # links are sorted once
    visits = running_sum(dealt(links, key, distinct_links), key, "ppc_id", {"_one": "_visit"}, top, WINDOW_ROWS)
    steps = visits.join(dealt(need, key, distinct_links), key).groupBy(*lists, "ppc_id", "priority").agg(
        F.count(F.lit(1)).alias("a"), F.count_if(F.col("_visit") == F.col("frames")).alias("d")
    )

    # all further tables have at most (pointings x priorities) rows
    per_class = targets.groupBy(*lists, "priority").agg(
        F.sum("exptime_req").alias("_s"), F.count(F.lit(1)).alias("_c")
    )
    own_and_all = F.explode(F.array(F.col("priority").cast("string"), F.lit("all"))).alias("priority")
    totals = per_class.select(*lists, own_and_all, "_s", "_c").groupBy(*lists, "priority").agg(
        F.sum("_s").alias("_s"), F.sum("_c").alias("_c")
    )
    zero = F.lit(0).cast("bigint")
    classes = totals.groupBy(*lists).agg(F.collect_set("priority").alias("_p"))
    grid = join_back(pointings.select(*lists, "ppc_id"), classes, lists).select(
        *lists, "ppc_id", F.explode("_p").alias("priority"), zero.alias("a"), zero.alias("d")
    )
    dense = grid.unionByName(steps.select(*lists, "ppc_id", own_and_all, "a", "d")).groupBy(
        *lists, "ppc_id", "priority"
    ).agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    summed = running_sum(dense, [*lists, "priority"], "ppc_id", {"a": "_a", "d": "_d"}, top)
    hours = F.col("_a") * F.lit(float(single_exptime)) / 3600.0
    return summed.join(totals, [*lists, "priority"]).select(
        *lists,
        F.col("ppc_id").cast("bigint").alias("ppc_id"),
        "priority",
        hours.alias("fh"),
        (hours / (F.col("_s") / 3600.0) * 100.0).alias("fh_pct"),
        F.col("_d").cast("bigint").alias("n"),
        (F.col("_d") / F.col("_c") * 100.0).alias("n_pct"),
    )


def wide_curve(curve: DataFrame, value: str, list_cols: Sequence[str] = LIST_COLS) -> DataFrame:
    """One row per pointing with the columns ``P_all``, ``P_0`` ... ``P_9``."""
    names = ["all", *[str(p) for p in range(10)]]
    return curve.groupBy(*list_cols, "ppc_id").agg(
        *[F.max(F.when(F.col("priority") == p, F.col(value))).alias(f"P_{p}") for p in names]
    )
