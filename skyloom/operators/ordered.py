"""Ranks, running sums and lookups that stay distributed when one group is huge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyloom.session import stage

WINDOW_ROWS = 1_000_000
TASK_ROWS = 500_000
SPREAD = 256
BLOCK = 65_536


def join_back(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join of ``rows`` with a table that has one row per key.

    ``per_key`` comes from an aggregation that was combined before its shuffle. Spark broadcasts it
    when its measured size allows; otherwise adaptive execution splits the partitions of ``rows`` that
    a frequent key makes too large, each part meeting the single row of that key. ``null_safe`` lets
    null keys meet.
    """
    if not keys:
        return rows.crossJoin(F.broadcast(per_key))  # exactly one row
    if not null_safe:
        return rows.join(per_key, list(keys), "left")
    other = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(other, on, "left").drop(*[f"_key_{k}" for k in keys])


def dealt(rows: DataFrame, keys: Sequence[str], n_rows: int | None) -> DataFrame:
    """``rows`` dealt by key to tasks of some ``TASK_ROWS`` rows, if there are known to be more (``n_rows``).

    Adaptive execution goes by bytes in the shuffle, and short codes take several times that in the sorts and hash tables of a
    task. Tables that meet are dealt with the same number; of two joined tables it is that of the larger one.
    """
    if n_rows is None or n_rows <= TASK_ROWS:
        return rows
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)), *keys)


def look_up(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """:func:`join_back` with a table that is usually far smaller than ``rows``.

    The table is computed and stored first, from the few columns it needs. Spark then knows its size when
    it plans the join: a table below the broadcast threshold goes to the rows, which are not shuffled at
    all, and a larger one is merged by key.
    """
    return join_back(rows, stage(per_key, "lookup")[0], keys, null_safe)


def rank_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Add the 1-based position of every row in its group. ``order`` has to be unique in a group.

    The rows are staged and counted in one job. Up to ``window_rows`` rows a window does the work; beyond
    that the rows are range-partitioned over all groups, so that a group spreads over many tasks, and the
    position follows from the row counts of the partitions.
    """
    staged, seen = stage(df, "unranked", n=F.count(F.lit(1)))
    if seen["n"] <= window_rows:
        return staged.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = [F.col(c) for c in by]
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered, _ = stage(
        staged.repartitionByRange(int(parts), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns({"_part": F.spark_partition_id(), "_at": in_partition}),
        "ranked",
    )
    # one row per partition: small whatever the size of the data
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    placed = ordered.join(F.broadcast(offsets), "_part").withColumn("_global", F.col("_before") + F.col("_at"))
    first = placed.groupBy(*by).agg(F.min("_global").alias("_first"))
    return (
        join_back(placed, first, by)
        .withColumn(out, (F.col("_global") - F.col("_first") + 1))
        .drop("_part", "_at", "_before", "_global", "_first")
    )


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    values: Mapping[str, str],
    top: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Running sums along an integer ``position``: ``values`` maps input to output column.

    Positions are cut into blocks; the sum before a block comes from the block totals, so that a window
    task holds at most one block of one group, or one row per block. ``top`` is the largest position if
    it is known: no more than a block of positions needs one window only. Positions have to be unique in
    a group.
    """
    if top is not None and top <= block:
        along = W.partitionBy(*by).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({o: F.sum(v).over(along) for v, o in values.items()})
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(*by, "_block").agg(*[F.sum(v).alias(f"_t_{i}") for i, v in enumerate(values)])
        .select(
            *by,
            "_block",
            *[F.coalesce(F.sum(f"_t_{i}").over(before), F.lit(0)).alias(f"_b_{i}") for i in range(len(values))],
        )
    )
    inside = W.partitionBy(*by, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    out = blocked.withColumns({f"_i_{i}": F.sum(v).over(inside) for i, v in enumerate(values)}).join(
        totals, [*by, "_block"]
    )
    return out.withColumns(
        {o: F.col(f"_b_{i}") + F.col(f"_i_{i}") for i, o in enumerate(values.values())}
    ).drop("_block", *[f"_{k}_{i}" for k in "bi" for i in range(len(values))])


def spread_for(n_rows: int | None) -> int:
    """Parts into which a group of at most ``n_rows`` rows is cut; unknown sizes get the most parts."""
    return SPREAD if n_rows is None else max(1, min(SPREAD, -(-n_rows // WINDOW_ROWS)))


def top_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    spread_on: str,
    spread: int = SPREAD,
    bound: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group. ``order`` has to be unique in a group.

    A group is first cut into ``spread`` parts that each keep their first rows, so that the final
    ranking of a group sees at most ``spread`` times the limit however large the group is; with
    ``spread=1`` groups are known to be moderate. ``bound`` is a constant upper limit when ``k`` is a
    column.
    """
    limit = bound if bound is not None else int(k)
    last = F.col("rank") <= (k if isinstance(k, Column) else F.lit(k))
    if spread == 1:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(last)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(spread)))
    local = salted.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order))
    ).where(F.col("_rank") <= limit)
    final = local.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return final.where(last).drop("_salt", "_rank")
