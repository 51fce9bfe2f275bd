"""Local counts, weights and the weighted density map with its peak."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyloom.functions.sky import num
from skyloom.operators.ordered import join_back, look_up
from skyloom.session import stage
from skyloom.schema import FIELD_RADIUS, LIST_COLS, SINGLE_EXPTIME, WEIGHTS

# --- fixed values: the count cells cover declinations from -40 in 131 rows; the wide grids ---
COUNT_DEC_ORIGIN = 40
COUNT_DEC_ROWS = 131
WIDE_SPAN = 50.0
STEPS = 100
WIDE_RA = (0.0, 360.0, 720)
WIDE_DEC = (-40.0, 90.0, 260)


def count_cell(ra: Column, dec: Column, wrap: bool = True) -> Column:
    """1 x 1 degree cell; rows south of the origin wrap around to the far end."""
    if wrap:
        row = F.pmod((dec + COUNT_DEC_ORIGIN).cast("int"), F.lit(COUNT_DEC_ROWS))
    else:
        row = F.floor(dec).cast("int")
    return F.struct(ra.cast("int").alias("x"), row.alias("y"))


def local_density(
    targets: DataFrame, list_cols: Sequence[str] = LIST_COLS, wrap: bool = True, staged: bool = True
) -> DataFrame:
    """Add ``local_count``: the number of targets in the same 1 x 1 degree cell.

    The counts are stored first (see :func:`look_up`), unless the rows are few enough to be joined at once.
    """
    rows = targets.withColumn("_cell", count_cell(F.col("ra"), F.col("dec"), wrap))
    counts = rows.groupBy(*list_cols, "_cell").agg(F.count(F.lit(1)).alias("local_count"))
    attach = look_up if staged else join_back
    return attach(rows.drop("local_count"), counts, [*list_cols, "_cell"]).drop("_cell")


def target_weight(
    priority: Column,
    exptime_left: Column,
    local_count: Column,
    single_exptime: float = SINGLE_EXPTIME,
    exponents: tuple[float, float, float] = WEIGHTS,
) -> Column:
    """Larger for an urgent target, a long remaining exposure and a dense surrounding."""
    grade, time_power, density_power = exponents
    return (
        F.pow(F.lit(grade), 2.0 + 0.1 * (9 - priority))
        * F.pow(exptime_left / single_exptime, F.lit(time_power))
        * F.pow(local_count.cast("double"), F.lit(density_power))
    )


def grid_parameters(targets: DataFrame, groups: Sequence[str], min_step: float = 0.0) -> DataFrame:
    """Per group the map grid: origin, step and number of steps in both directions.

    A narrow extent is padded and cut into 100 steps, a wide one (50 degrees or more) uses the fixed
    half-degree grid of the whole sky; both directions decide for themselves, as only a group that is
    wide in one direction keeps the padded grid in the other. ``min_step`` makes padded grids coarser.
    """
    ext = targets.groupBy(*groups).agg(
        F.min("ra").alias("r0"), F.max("ra").alias("r1"), F.min("dec").alias("d0"), F.max("dec").alias("d1"),
        F.count(F.lit(1)).alias("n_targets"),
    )

    def axis(lo: str, hi: str, wide: tuple[float, float, int], name: str) -> dict[str, Column]:
        a = F.least(F.col(lo) * 0.9, F.col(lo) - 1.0)
        b = F.greatest(F.col(hi) * 1.1, F.col(hi) + 1.0)
        narrow = (F.col(hi) - F.col(lo)) / STEPS < WIDE_SPAN / STEPS
        steps = F.lit(STEPS)
        if min_step:
            steps = F.greatest(F.lit(1), F.least(steps, F.floor((b - a) / min_step)))
        return {
            f"{name}_origin": F.when(narrow, a).otherwise(wide[0]),
            f"{name}_step": F.when(narrow, (b - a) / steps).otherwise((wide[1] - wide[0]) / wide[2]),
            f"{name}_n": F.when(narrow, steps + 1).otherwise(wide[2] + 1).cast("bigint"),
        }

    columns = {**axis("r0", "r1", WIDE_RA, "x"), **axis("d0", "d1", WIDE_DEC, "y")}
    return ext.select(*groups, "n_targets", *[c.alias(k) for k, c in columns.items()])


def _with_grid_lines(rows: DataFrame, out: str, centres: Sequence[str], reach: str, axis: str) -> DataFrame:
    """Add the array ``out``: indices of the grid lines of an axis within ``reach`` of one of the coordinates (may be empty)."""
    ends, parts = {}, []
    for i, centre in enumerate(centres):
        first, last = f"_{axis}a{i}", f"_{axis}b{i}"
        ends[first] = F.expr(f"cast(greatest(0, ceil(({centre} - {reach} - {axis}_origin) / {axis}_step)) as int)")
        ends[last] = F.expr(f"cast(least({axis}_n - 1, floor(({centre} + {reach} - {axis}_origin) / {axis}_step)) as int)")
        parts.append(f"if({first} <= {last}, sequence({first}, greatest({first}, {last})), array())")
    every = parts[0] if len(parts) == 1 else f"array_distinct(concat({', '.join(parts)}))"
    return rows.withColumns(ends).withColumn(out, F.expr(every)).drop(*ends)


SPOTS = 16  # parts of one place of the sky among the tasks that spread positions over the grid


def spread(spots: DataFrame, groups: Sequence[str], grid: DataFrame, bandwidth: float) -> DataFrame:
    """Each row of ``spots`` with every grid point within the bandwidth: ``ix, iy``, the point's ``gx, gy`` and the kernel
    ``k`` (1 - d / bandwidth, above 0).

    Targets of one place share their points and mostly are in one task, so that an aggregation of the result is combined
    before its shuffle; a dense place is dealt to several tasks.
    """
    tasks = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [F.floor(F.col(c) / bandwidth) for c in ("ra", "dec")]
    h = num(bandwidth)
    reach = (
        f"if(abs(dec) + {h} >= 90, 180D, degrees(asin(least(1D, {num(math.sin(math.radians(bandwidth)))}"
        f" / cos(radians(dec)))))) + 1e-9D"
    )
    # the grid lines of a spot are found ahead of the shuffle: their long terms in the loop over the points would make it
    # too long a method for the JVM to compile
    rows = _with_grid_lines(join_back(spots, grid, groups), "_ys", ["dec"], f"({h} + 1e-9D)", "y").withColumn("_reach", F.expr(reach))
    rows = _with_grid_lines(rows, "_xs", [f"(ra {turn})" for turn in ("- 360", "+ 0", "+ 360")], "_reach", "x").drop("_reach")
    # as every row is about to become hundreds, the few rows are spread over tasks that are not merged again
    rows = rows.repartition(tasks, *groups, *place, F.pmod(F.xxhash64("ra", "dec"), F.lit(SPOTS)))
    # (an inner explode would work the arrays out twice, once to see that they are not empty)
    # what a grid line and a spot share is worked out before the points of the line; the terms are those of separation_sql
    lines = rows.withColumn("iy", F.explode_outer("_ys")).withColumn("gy", F.expr("y_origin + iy * y_step"))
    lines = lines.withColumns(
        {"_up": F.expr("pow(sin(radians(gy - dec) / 2), 2)"), "_cos": F.expr("cos(radians(dec)) * cos(radians(gy))")}
    )
    met = lines.withColumn("ix", F.explode_outer("_xs")).withColumn("gx", F.expr("x_origin + ix * x_step"))
    kernel = F.expr(f"1 - degrees(2 * asin(sqrt(least(1D, _up + _cos * pow(sin(radians(gx - ra) / 2), 2))))) / {h}")
    return met.withColumn("k", kernel).drop("_up", "_cos", "_ys", "_xs").where("k > 0")


def density_map(
    targets: DataFrame, groups: Sequence[str], weight: str = "weight", bandwidth: float = FIELD_RADIUS,
    grid: DataFrame | None = None, collapse: bool = True,
) -> DataFrame:
    """Weighted density on the grid of every group: sum of w (1 - d / bandwidth) over near targets.

    Only grid points near a target get a row. The work grows with the targets, and a dense group does not gather anywhere.
    """
    grid = grid if grid is not None else grid_parameters(targets, groups)
    spots = targets.select(*groups, "ra", "dec", F.col(weight).alias("_w"))
    if collapse:  # copies of a position count once
        spots = spots.groupBy(*groups, "ra", "dec").agg(F.sum("_w").alias("_w"))
    points = spread(spots, groups, grid, bandwidth).groupBy(*groups, "ix", "iy")
    return points.agg(F.min("gx").alias("ra"), F.min("gy").alias("dec"), F.expr("sum(_w * k)").alias("z"))


def updated_map(density: DataFrame | None, changes: DataFrame, groups: Sequence[str], grid: DataFrame, bandwidth: float = FIELD_RADIUS) -> DataFrame:
    """A map (``ix, iy, ra, dec, z, n``) after changes of weight: only the changed targets are spread over the grid.

    ``changes`` has ``ra, dec, dw`` (change of weight) and ``dn`` (-1 for a target that goes, 1 for one that comes, else
    0). ``n`` counts the targets near a point, so that a point that no target is left at goes, whatever the rounding of z.
    Without a map it is that of the changes alone.
    """
    # copies of a position change the map together
    spots = changes.groupBy(*groups, "ra", "dec").agg(F.sum("dw").alias("dw"), F.sum("dn").alias("dn"))
    parts = spread(spots, groups, grid, bandwidth).select(
        *groups, "ix", "iy", F.col("gx").alias("ra"), F.col("gy").alias("dec"), F.expr("dw * k").alias("z"), F.col("dn").cast("bigint").alias("n")
    )
    return (
        (parts if density is None else density.unionByName(parts)).groupBy(*groups, "ix", "iy")
        .agg(F.min("ra").alias("ra"), F.min("dec").alias("dec"), F.sum("z").alias("z"), F.sum("n").alias("n"))
        .where("n > 0")
    )


def map_significance(
    density: DataFrame, grid: DataFrame, groups: Sequence[str]
) -> DataFrame:
    """Add ``significance``: (z - mean) / deviation over all points of the grid, empty ones included."""
    sums = density.groupBy(*groups).agg(F.sum("z").alias("_s"), F.sum(F.col("z") * F.col("z")).alias("_q"))
    cells = grid.select(*groups, (F.col("x_n") * F.col("y_n")).alias("_cells"))
    stats = (sums.join(cells, list(groups)) if groups else sums.crossJoin(F.broadcast(cells))).select(
        *groups,
        (F.col("_s") / F.col("_cells")).alias("_mean"),
        F.sqrt(F.col("_q") / F.col("_cells") - F.pow(F.col("_s") / F.col("_cells"), 2)).alias("_dev"),
    )
    return (
        join_back(density, stats, groups)
        .withColumn("significance", (F.col("z") - F.col("_mean")) / F.col("_dev"))
        .drop("_mean", "_dev")
    )


def density_peak(
    targets: DataFrame, groups: Sequence[str], weight: str = "weight", bandwidth: float = FIELD_RADIUS, digits: int = 9
) -> DataFrame:
    """Position and significance of the highest grid point of every group.

    Among equal points (to ``digits`` decimals) the middle one in (ra, dec) order is taken. A group of
    one target peaks at that target, without a significance.
    """
    grid, _ = stage(grid_parameters(targets, groups), "grid")
    density = density_map(targets, groups, weight, bandwidth, grid)
    density, _ = stage(density, "density")  # read three times below, and at most a grid per group
    marked = map_significance(density, grid, groups).withColumn("_z", F.round("z", digits))
    top = marked.groupBy(*groups).agg(F.max("_z").alias("_max"))
    ties = join_back(marked, top, groups).where(F.col("_z") == F.col("_max"))
    # equal points of one group: at most the grid itself
    w = W.partitionBy(*groups)
    chosen = (
        ties.withColumns(
            {"_i": F.row_number().over(w.orderBy("ix", "iy")) - 1, "_m": F.count(F.lit(1)).over(w)}
        )
        .where(F.col("_i") == F.rint(F.col("_m") * 0.5).cast("int"))
        .select(*groups, F.col("ra").alias("_px"), F.col("dec").alias("_py"), "significance")
    )
    alone = targets.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_targets"), F.max("ra").alias("_r"), F.max("dec").alias("_d")
    )
    single = F.col("n_targets") == 1
    return join_back(alone, chosen, groups).select(
        *groups,
        "n_targets",
        F.when(single, F.col("_r")).otherwise(F.col("_px")).alias("peak_ra"),
        F.when(single, F.col("_d")).otherwise(F.col("_py")).alias("peak_dec"),
        F.when(~single, F.col("significance")).alias("significance"),
    )
