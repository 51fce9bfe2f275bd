"""What the operators of this package share: texts as flat bytes, held-out rows, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.session import stage

#: Bytes that separate words: the space and 0x09 to 0x0D. No byte of a longer UTF-8 sequence is among them.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that nothing is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands the memory it has freed back to the system at its end.

    Workers go on from task to task; what a large batch took would otherwise stay with each of them, beside what the
    next operator needs.
    """

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch one after the other, and where each begins (one more at the end).

    A null counts as an empty text.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive items that hold up to ``limit`` in sum, one item at least."""
    total, i = np.concatenate([[0], np.cumsum(sizes)]), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit integers over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def keys_table(n: int, seed: int) -> np.ndarray:
    """n odd random 64-bit integers, the same in every task."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Forest:
    """Sets of a few integers that are merged; the smallest member names a set."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        """True if i and j were apart until now."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return above
            self.up = above


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest node reachable from each node of ``links`` (a, b); nodes without links are not in it.

    Alternates two steps until nothing moves: every larger neighbour of a node is hung under the node's
    smallest neighbour, then every smaller-or-equal neighbour is. Both are a minimum per node (combined
    before the shuffle) and a join, which adaptive execution may split, so that a hub with any number of
    links passes. The number of rounds grows with the logarithm of the longest chain; a table is written per
    round.
    """
    edges, seen = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links", n=F.count(F.lit(1)), total=F.sum(F.col("v").cast("decimal(38,0)")),
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("least").alias("v")),
            )).alias("e")).select("e.*").where("u <> v").distinct()
        )
        before = seen
        edges, seen = stage(small, "links", n=F.count(F.lit(1)), total=F.sum(F.col("v").cast("decimal(38,0)")))
        # the sum of the parents falls with every step that moves a node
        if seen == before:
            roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("v"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
