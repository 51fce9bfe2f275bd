"""Connected components of the "closer than epsilon" graph, without listing its edges.

Points are first collapsed to small cells whose points are all connected. Two cells are connected for
sure, surely apart, or undecided from their centres and radii alone; only undecided pairs between
different components are cut into finer cells, and the last few are settled point by point. The work
follows the number of occupied cells, so that a dense spot costs no more than a sparse one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.sky import cell_of, cells_around, num, separation
from skyloom.operators.ordered import join_back, rank_rows
from skyloom.schema import FIELD_DIAMETER, LIST_COLS
from skyloom.session import stage

PAIR_WORK = 256  # point pairs of one undecided cell pair that are compared directly
REFINE = 4
SURE, OPEN = 1, 0


def connected_labels(edges: DataFrame, list_cols: Sequence[str], max_rounds: int = 64) -> DataFrame:
    """Smallest node of the component for every node that has an edge (columns ``u``, ``v``).

    Each round a node takes the smallest label around it, hands it on to the node it was labelled by,
    and follows labels of labels, so that long chains close in a logarithmic number of rounds.
    """
    lists = list(list_cols)
    both = edges.select(*lists, "u", "v").unionByName(
        edges.select(*lists, F.col("v").alias("u"), F.col("u").alias("v"))
    ).distinct()
    both, _ = stage(both, "edges")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    labels = both.groupBy(*lists, "u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
    labels, seen = stage(labels.withColumnRenamed("u", "id"), "labels", total=total)
    for _ in range(max_rounds):
        last = seen["total"]
        if last is None:
            return labels
        of_label = labels.select(*lists, F.col("id").alias("label"), F.col("label").alias("top"))
        hop = labels.join(of_label, [*lists, "label"])
        around = (
            both.join(hop.select(*lists, F.col("id").alias("v"), "top"), [*lists, "v"])
            .groupBy(*lists, "u").agg(F.min("top").alias("around"))
            .withColumnRenamed("u", "id")
        )
        seen_by = hop.join(around, [*lists, "id"])
        offers = seen_by.select(*lists, "id", F.least("top", "around").alias("label")).unionByName(
            seen_by.select(*lists, F.col("label").alias("id"), F.col("around").alias("label"))
        )
        labels, seen = stage(offers.groupBy(*lists, "id").agg(F.min("label").alias("label")), "labels", total=total)
        if seen["total"] == last:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fine_cell(size: float) -> tuple[Column, Column, Column, Column]:
    """Band, bin and centre of a cell at most ``size`` wide and high."""
    band = f"floor(dec / {num(size)})"
    # the parallel of the band that is nearest to the equator
    inner = f"(case when {band} >= 0 then {band} else -({band} + 1) end * {num(size)})"
    n = f"greatest(1, ceil(360 * cos(radians({inner})) / {num(size)}))"
    bin_ = f"least(floor(pmod(ra, 360D) / 360 * {n}), {n} - 1)"
    return (
        F.expr(f"cast({band} as bigint)"),
        F.expr(f"cast({bin_} as bigint)"),
        F.expr(f"({bin_} + 0.5D) * 360 / {n}"),
        F.expr(f"({band} + 0.5D) * {num(size)}"),
    )


def _cells(points: DataFrame, size: float, keys: Sequence[str]) -> DataFrame:
    """Occupied cells: smallest row, number of points, centre and radius around the centre."""
    band, bin_, cx, cy = _fine_cell(size)
    return (
        points.withColumns({"_band": band, "_bin": bin_, "cx": cx, "cy": cy})
        .groupBy(*keys, "_band", "_bin", "cx", "cy")
        .agg(
            F.min("row_id").alias("id"),
            F.count(F.lit(1)).alias("n"),
            (F.max(separation("ra", "dec", "cx", "cy")) + 1e-9).alias("radius"),
        )
    )


def _verdict(eps: float, strict: bool) -> Column:
    """SURE, OPEN or null (apart) for two cells ``a`` and ``b``."""
    d = separation("a_x", "a_y", "b_x", "b_y")
    r = F.col("a_r") + F.col("b_r")
    return F.when(d + r < eps, SURE).when(d - r <= eps, OPEN)


def _side(cells: DataFrame, side: str, keep: Sequence[str], extra: dict[str, str]) -> DataFrame:
    names = {"id": side, "cx": f"{side}_x", "cy": f"{side}_y", "radius": f"{side}_r", "n": f"{side}_n", **extra}
    return cells.select(*keep, *[F.col(k).alias(v) for k, v in names.items()])


def components(
    points: DataFrame,
    eps: float = FIELD_DIAMETER,
    list_cols: Sequence[str] = LIST_COLS,
    out: str = "cluster",
    strict: bool = False,
) -> DataFrame:
    """Add ``out``: the smallest ``row_id`` of the points linked to a point by steps within ``eps``.

    With ``strict`` a step has to be shorter than ``eps``. ``points`` needs ``row_id, ra, dec``.
    """
    lists = list(list_cols)
    size = eps / (2.0 * math.sqrt(2.0))
    band, bin_, *_ = _fine_cell(size)
    cells, _ = stage(_cells(points, size, lists), "cells")

    # pairs of cells that can hold linked points; a coarse cell holds a bounded number of fine ones
    reach = eps * 1.5 + 1e-6
    left = _side(cells, "a", lists, {}).withColumn("_key", F.explode(cells_around("a_x", "a_y", reach)))
    right = _side(cells, "b", lists, {}).withColumn("_key", cell_of("b_x", "b_y", reach))
    pairs = (
        left.join(right, [*lists, "_key"]).where("a < b").drop("_key")
        .withColumn("verdict", _verdict(eps, strict)).where("verdict is not null")
    )
    pairs, _ = stage(pairs, "cell-pairs")
    sure = pairs.where(F.col("verdict") == SURE).select(*lists, F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_labels(sure, lists)

    def label_of(side: str, name: str) -> DataFrame:
        return labels.select(*lists, F.col("id").alias(side), F.col("label").alias(name))

    undecided = join_back(
        join_back(pairs.where(F.col("verdict") == OPEN), label_of("a", "_la"), [*lists, "a"]),
        label_of("b", "_lb"), [*lists, "b"],
    ).withColumns({"la": F.coalesce("_la", "a"), "lb": F.coalesce("_lb", "b")}).where("la <> lb")
    undecided, seen = stage(
        undecided.select(*lists, "a", "b", "la", "lb", (F.col("a_n") * F.col("b_n")).alias("work")),
        "undecided", n=F.count(F.lit(1)),
    )
    found = None
    if seen["n"]:
        celled = points.select(*lists, "row_id", "ra", "dec", band.alias("_band"), bin_.alias("_bin"))
        parents = cells.select(*lists, "_band", "_bin", F.col("id").alias("parent"))
        found = _settle(celled, parents, undecided, eps, size, lists, strict)
    if found is not None:
        merged = connected_labels(found, lists).select(
            *lists, F.col("id").alias("first"), F.col("label").alias("second")
        )
    cell_label = join_back(cells.select(*lists, "_band", "_bin", "id"), labels, [*lists, "id"]).withColumn(
        "first", F.coalesce("label", "id")
    )
    if found is not None:
        cell_label = join_back(cell_label, merged, [*lists, "first"]).withColumn("first", F.coalesce("second", "first"))
    cell_label = cell_label.select(*lists, "_band", "_bin", F.col("first").alias(out))
    rows = points.drop(out).withColumns({"_band": band, "_bin": bin_})
    return join_back(rows, cell_label, [*lists, "_band", "_bin"]).drop("_band", "_bin")


def _settle(
    points: DataFrame, parents: DataFrame, undecided: DataFrame, eps: float, size: float, lists: list[str], strict: bool,
    max_levels: int = 16,
) -> DataFrame:
    """Links (``u``, ``v``) between component labels found among undecided cell pairs."""
    # the points of undecided cells, each under its cell
    involved = undecided.select(*lists, F.col("a").alias("parent")).unionByName(
        undecided.select(*lists, F.col("b").alias("parent"))
    ).distinct()
    cells = parents.join(involved, [*lists, "parent"])
    members, _ = stage(
        points.join(cells, [*lists, "_band", "_bin"]).drop("_band", "_bin")
        .groupBy(*lists, "parent", "ra", "dec").agg(F.min("row_id").alias("row_id")),
        "members",
    )
    found = undecided.limit(0).select(*lists, F.col("la").alias("u"), F.col("lb").alias("v"))
    for level in range(max_levels):
        small = undecided.where((F.col("work") <= PAIR_WORK) | F.lit(level == max_levels - 1))
        one = small.join(
            members.select(*lists, F.col("parent").alias("a"), F.col("ra").alias("_ax"), F.col("dec").alias("_ay")),
            [*lists, "a"],
        )
        two = one.join(
            members.select(*lists, F.col("parent").alias("b"), F.col("ra").alias("_bx"), F.col("dec").alias("_by")),
            [*lists, "b"],
        )
        d = separation("_ax", "_ay", "_bx", "_by")
        hits = two.where(d < eps if strict else d <= eps).select(*lists, F.col("la").alias("u"), F.col("lb").alias("v"))
        large = undecided.where(F.col("work") > PAIR_WORK) if level < max_levels - 1 else undecided.limit(0)
        # the large pairs, cut finer
        size = size / REFINE
        fine_members = members.select(*lists, F.col("parent"), "row_id", "ra", "dec")
        fine = _cells(fine_members, size, [*lists, "parent"])
        fine_a = _side(fine, "a", lists, {"parent": "_pa"})
        fine_b = _side(fine, "b", lists, {"parent": "_pb"})
        cut = (
            large.select(*lists, F.col("a").alias("_pa"), F.col("b").alias("_pb"), "la", "lb")
            .join(fine_a, [*lists, "_pa"]).join(fine_b, [*lists, "_pb"])
            .withColumn("verdict", _verdict(eps, strict)).where("verdict is not null")
        )
        cut, _ = stage(
            cut.select(*lists, "a", "b", "la", "lb", (F.col("a_n") * F.col("b_n")).alias("work"), "verdict"), "cut"
        )
        sure = cut.where(F.col("verdict") == SURE).select(*lists, F.col("la").alias("u"), F.col("lb").alias("v"))
        found, _ = stage(found.unionByName(hits).unionByName(sure).distinct(), "links")
        # pairs of components already linked need no further look
        linked = found.select(*lists, F.col("u").alias("la"), F.col("v").alias("lb"))
        undecided, seen = stage(
            cut.where(F.col("verdict") == OPEN).drop("verdict").join(linked, [*lists, "la", "lb"], "left_anti"),
            "undecided", n=F.count(F.lit(1)),
        )
        if not seen["n"]:
            return found
        band, bin_, *_ = _fine_cell(size)
        fine_ids = fine.select(*lists, "parent", "_band", "_bin", F.col("id").alias("_new"))
        members, _ = stage(
            members.withColumns({"_band": band, "_bin": bin_})
            .join(fine_ids, [*lists, "parent", "_band", "_bin"])
            .select(*lists, F.col("_new").alias("parent"), "row_id", "ra", "dec"),
            "members",
        )
    return found


def cluster_targets(
    targets: DataFrame, eps: float = FIELD_DIAMETER, list_cols: Sequence[str] = LIST_COLS
) -> DataFrame:
    """Add ``cluster``: targets linked by steps within one field diameter."""
    return components(targets, eps, list_cols)


def order_clusters(
    clustered: DataFrame, list_cols: Sequence[str] = LIST_COLS, weight: str = "weight", digits: int = 9
) -> DataFrame:
    """One row per cluster with its size, summed weight and rank (heaviest first)."""
    sums = clustered.groupBy(*list_cols, "cluster").agg(
        F.count(F.lit(1)).alias("n_targets"), F.round(F.sum(weight), digits).alias("total_weight")
    )
    return rank_rows(sums, list_cols, [F.col("total_weight").desc(), F.col("cluster")], "cluster_rank")


def drop_near_duplicates(
    targets: DataFrame, eps: float = 2.0 / 3600.0, list_cols: Sequence[str] = LIST_COLS
) -> DataFrame:
    """Keep the first row of every group of targets closer than ``eps`` (by steps)."""
    return components(targets, eps, list_cols, "_group", strict=True).where(F.col("row_id") == F.col("_group")).drop("_group")


def group_pointings(
    pointings: DataFrame, eps: float = FIELD_DIAMETER, list_cols: Sequence[str] = LIST_COLS, row_id: str = "row_id"
) -> DataFrame:
    """Add ``group_id`` to pointings: fields linked by steps within one field diameter."""
    points = pointings.withColumns({"ra": F.col("ppc_ra"), "dec": F.col("ppc_dec"), "row_id": F.col(row_id)})
    added = [c for c in ("ra", "dec", "row_id") if c not in pointings.columns]
    return components(points, eps, list_cols, "group_id").drop(*added)
