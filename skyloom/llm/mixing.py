"""Mixing sources to target weights by Pareto order sampling. DataFrame expressions only.

A source's target is shared out to its documents as expected copies, in proportion to an importance. The whole part of
them is certain. For the rest every document draws an order key, its random odds over its inclusion odds, and the
documents of smallest key are taken until the source's words are reached: a sample of fixed size and unequal
probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from skyloom.operators.ordered import join_back, look_up, rank_rows, running_sum
from skyloom.session import stage

WORDS = r"[^\x20\x09-\x0D]+"
#: Cells of the order keys of a source. Sums per cell find the cell that the last document taken is in.
CELLS = 65_536
CELL_BLOCK = 256


def bits(size: Column) -> Column:
    """How many binary digits a document's number of words has: longer documents count for more, but only slowly."""
    return F.length(F.bin(size)).cast("bigint")


def measured(docs: DataFrame, seed: int = 2024, importance=bits) -> DataFrame:
    """(doc_id, source, text, origin, size, importance, u): what the mix has to know about each document.

    ``size`` is its number of words, ``u`` a random number between 0 and 1 that depends on the seed, the id and the text
    alone. A null text has no words. ``origin`` is the source as a key that is never null.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORDS)).cast("bigint")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    origin = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return (
        docs.select("doc_id", "source", "text", origin.alias("origin"), size.alias("size"), u.alias("u"))
        .withColumn("importance", importance(F.col("size")))
    )


def fill(rows: DataFrame, by: Sequence[str], total: str, weight: str, cap: str, out: str) -> DataFrame:
    """Share out ``total`` of each group by ``weight``; nobody gets more than ``cap``, the excess is shared out again.

    With the rows in order of cap over weight, those that reach their cap come first: a row does if what the rows before
    it leave, shared by the weights from it on, is more than its cap. So sums along that order replace the repeated
    sharing.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0))
    placed = rank_rows(rows.withColumn("_ratio", ratio), by, [F.col("_ratio"), *_ties(rows, by)], "_place")
    summed = running_sum(placed, by, "_place", {cap: "_caps", weight: "_weights"})
    all_weights = summed.groupBy(*by).agg(F.max("_weights").alias("_all")) if by else summed.agg(F.max("_weights").alias("_all"))
    known = join_back(summed, all_weights, by)
    left = F.col(total) - (F.col("_caps") - F.col(cap))
    share = F.col("_all") - (F.col("_weights") - F.col(weight))
    judged = known.withColumn("_full", (F.col(weight) <= 0) | (left * F.col(weight) > F.col(cap).cast("double") * share))
    full = [F.sum(F.when(F.col("_full"), F.col(c)).otherwise(0)).alias(n) for c, n in ((cap, "_c"), (weight, "_w"))]
    sums = judged.groupBy(*by).agg(*full) if by else judged.agg(*full)
    level = (F.col(total) - F.col("_c")) / (F.col("_all") - F.col("_w"))
    value = F.when(F.col("_full"), F.col(cap).cast("double")).otherwise(F.col(weight) * level)
    return join_back(judged, sums, by).withColumn(out, value).select(*rows.columns, out)


def _ties(rows: DataFrame, by: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ("origin", "importance") if c in rows.columns and c not in by]


def order_key(u: Column, p: Column) -> Column:
    """The Pareto key, odds of u over odds of p, mapped to 0 to 1: k / (1 + k)."""
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def plan(narrow: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """(origin, importance, source_size, target, whole, p, last_key, last_words, last_size), a row per source and importance.

    ``whole`` copies are certain, a further one has the inclusion probability ``p``. Documents whose key is below
    ``last_key`` get it; those at it share ``last_words`` of their ``last_size`` words.
    """
    classes, _ = stage(narrow.groupBy("origin", "source", "importance").agg(F.sum("size").alias("class_size")), "classes")
    ranked = rank_rows(classes.groupBy("origin", "source").agg(F.sum("class_size").alias("source_size")), [], [F.col("source").asc_nulls_last()], "_rank")
    total = ranked.agg((F.sum("source_size") * F.lit(float(share))).alias("total"))
    turn = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighted = join_back(ranked.withColumn("weight", turn), total, []).withColumn("most", F.col("source_size") * max_copies)
    targets = fill(weighted, [], "total", "weight", "most", "target").select("origin", "source_size", "target")
    shared = join_back(classes, targets, ["origin"]).withColumns({
        "weight": F.col("importance") * F.col("class_size"), "most": F.col("class_size") * max_copies,
    })
    expected = fill(shared, ["origin"], "target", "weight", "most", "words")
    copies = F.when(F.col("class_size") > 0, F.least(F.col("words") / F.col("class_size"), F.lit(float(max_copies)))).otherwise(0.0)
    chances, _ = stage(
        expected.withColumn("_copies", copies)
        .withColumns({"whole": F.floor("_copies"), "p": F.col("_copies") - F.floor("_copies")})
        .select("origin", "importance", "class_size", "source_size", "target", "whole", "p"),
        "chances",
    )
    keyed = _keyed(narrow, chances).where("key is not null and size > 0")
    budget = chances.groupBy("origin").agg((F.max(F.floor(F.col("target") + 0.5)) - F.sum(F.col("whole") * F.col("class_size"))).alias("budget"))
    # the cell of the last document: one row per source and cell, summed up by blocks of cells
    cells = keyed.groupBy("origin", _cell().alias("cell")).agg(F.sum("size").alias("words"))
    cells = running_sum(cells, ["origin"], "cell", {"words": "upto"}, block=CELL_BLOCK)
    at = (
        join_back(cells, budget, ["origin"]).where("upto >= budget and upto - words < budget")
        .select("origin", "cell", (F.col("budget") - F.col("upto") + F.col("words")).alias("room"))
    )
    at, _ = stage(at, "cells")
    inside = join_back(keyed.withColumn("_cell", _cell()), at, ["origin"]).where("_cell = cell")
    along = W.partitionBy("origin").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    last = (
        inside.groupBy("origin", "key").agg(F.sum("size").alias("last_size"), F.max("room").alias("room"))
        .withColumn("upto", F.sum("last_size").over(along))
        .where("upto >= room and upto - last_size < room")
        .select("origin", F.col("key").alias("last_key"), (F.col("room") - F.col("upto") + F.col("last_size")).alias("last_words"), "last_size")
    )
    done = join_back(join_back(chances, budget, ["origin"]), last, ["origin"])
    # no such document: nothing to take, or all of them
    return done.withColumn("last_key", F.coalesce("last_key", F.when(F.col("budget") <= 0, -1.0).otherwise(2.0))).drop("budget", "class_size")


def _cell() -> Column:
    return F.least(F.floor(F.col("key") * CELLS), F.lit(CELLS - 1))


def _keyed(documents: DataFrame, chances: DataFrame) -> DataFrame:
    known = join_back(documents, chances, ["origin", "importance"])
    return known.withColumn("key", F.when(F.col("p") > 0, order_key(F.col("u"), F.col("p"))))


def _taken(documents: DataFrame, decided: DataFrame) -> DataFrame:
    extra = (
        F.when(F.col("key") < F.col("last_key"), F.col("size"))
        .when(F.col("key") == F.col("last_key"), F.floor(F.col("size") * F.col("last_words") / F.col("last_size")))
        .otherwise(F.lit(0)).cast("bigint")
    )
    return _looked_up(documents, decided).withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def _looked_up(documents: DataFrame, decided: DataFrame) -> DataFrame:
    known = look_up(documents, decided, ["origin", "importance"])
    return known.withColumn("key", F.when(F.col("p") > 0, order_key(F.col("u"), F.col("p"))))


def allocate(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 2024, importance=bits,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, extra, taken): how many words of each document the mix takes.

    Sources in order of code points, a null source last, have the ``weights`` in turn and share ``share`` times all words
    by them; a target stops at ``max_copies`` times its source's words, and the excess is shared out again. Within a source
    the expected copies of a document are proportional to its ``importance`` (a positive integer from its size, by default
    its binary digits) and stop at ``max_copies``. ``whole`` copies are certain; ``extra`` words come from the order
    sampling: all of a document, none, or, for the last one taken, as many of its first words as the target leaves. A
    source's taken words are its target to the nearest word; documents of exactly equal keys (repeated rows) share the
    last place evenly, each a whole number of words, so that up to a word for each of them is left.

    Each document is decided from its own row and the table of its source, so that no source is ever gathered: sums per
    cell of keys find the last cell of a source, and only that cell's documents, one in 65,536, are put in order.

    A null or empty text has size 0 and is not taken; a null doc_id stays null; repeated rows count as often as they come;
    a source without words has the target 0. A very long document may be cut as the last one. An empty table gives none.
    Other columns are not read.
    """
    narrow, decided = _decide(docs, weights, share, max_copies, seed, importance)
    return _taken(narrow, decided).select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "taken")


def _decide(docs, weights, share, max_copies, seed, importance) -> tuple[DataFrame, DataFrame]:
    narrow, _ = stage(measured(docs, seed, importance).drop("text"), "measured")
    return narrow, plan(narrow, weights, share, max_copies)


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 2024, importance=bits,
) -> DataFrame:
    """(doc_id, source, copy, text): the mixed texts, a row for each copy of a document by :func:`allocate`.

    Copies count from 0. A copy cut at the target holds its first words, joined by one space.
    """
    _, decided = _decide(docs, weights, share, max_copies, seed, importance)
    taken = _taken(measured(docs, seed, importance), decided)
    n = F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)
    copies = taken.where((n > 0) & (F.col("size") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    cut = (F.col("copy") == F.col("whole")) & (F.col("extra") < F.col("size"))
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")
    return copies.select("doc_id", "source", "copy", F.when(cut, start).otherwise(F.col("text")).alias("text"))
