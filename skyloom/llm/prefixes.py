"""Prefix trie of conversations from padded matrices of turn ids, built by range shards and joined at their boundaries.

In order of their turn ids all conversations that share a prefix stand together. A shard of that order is a matrix with
a row per conversation and a column per turn, padded to the longest. Where a row differs from the one above it in any
column so far, a node of that depth starts; sums between starts are the node's figures. Only prefixes of a shard's first
and last row may go on in other shards: those come in parts, which are put together from two rows per shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from skyloom.operators.ordered import look_up
from skyloom.session import stage

#: Columns of one matrix. Longer conversations go on in further matrices that only hold the rows that are long enough, so
#: that padding never takes more than this many cells a row.
TILE = 64
#: Ids of members that are written as one text.
BLOCK = 1024
#: Turns that a shard holds on average.
SHARD_TURNS = 200_000
NO_END = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A node's parent on the first (0) or last (1) row of its shard, if it is known later only.
SHARD_ROWS = (
    f"{NODES}, shard long, side int, ids array<long>, chars array<long>, shared long, part_convs array<long>, part_first array<long>, "
    "part_children array<long>, part_leaves array<long>, part_saved array<long>, part_ends array<string>"
)
NODE_NAMES = [c.split()[0] for c in NODES.split(", ")]


# --- conversations as sequences of turn ids ---------------------------------------------


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as array<struct<hi, lo, chars>>: 128 bits of a digest of role
    and text, and the text's length in code points.

    Turns are ordered by number, null numbers first, equal numbers by role and text. Null roles and texts count as empty;
    rows without a conv_id are left out. Texts are sorted outside memory and stay behind: what is collected is 24 bytes for
    each turn of one conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    half = lambda at: F.conv(F.substring(F.col("digest"), at, 16), 16, -10).cast("long")
    ids = rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.char_length("text").cast("long").alias("chars")).select(
        "conv_id", F.struct("place", half(1).alias("hi"), half(17).alias("lo"), "chars").alias("turn")
    )
    return ids.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["chars"].alias("chars"))).alias("turns")
    )


def grafted(sequences: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, turns): each conversation's first turns replaced by those of the first of its family.

    The first h turns of conversation c come from c - c % family (as many as it has, none if it is absent), c's own turns
    after its first h follow; h is crc32 of c as decimal text modulo ``most`` + 1.
    """
    whole, _ = stage(sequences, "sequences")
    heads = whole.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("first_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = whole.withColumns({"head": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(heads, "head", "left")
    begun = F.coalesce(F.slice("first_turns", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(begun, own).alias("turns"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(ids, chars, n, conv_id, ends): each distinct sequence once, with the number of its conversations, their smallest id
    and the digest of all their ids in order.

    ``ids`` holds two integers a turn. Copies are taken together by blocks of ids before their shuffle; a task then reads
    the blocks of one sequence in order, as a stream, since a digest of a text is computed from its start to its end.
    """
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["hi"], t["lo"])))
    chars = F.transform("turns", lambda t: t["chars"])
    block = F.floor(F.col("conv_id") / BLOCK)
    blocks = (
        sequences.select("conv_id", ids.alias("ids"), chars.alias("chars"), block.alias("block"))
        .groupBy("ids", "block")
        .agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("conv_id")).alias("members"))
        .select(
            F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")).alias("sequence"), "block", "ids", "chars", "n",
            F.element_at("members", 1).alias("conv_id"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "chars", "n", "conv_id", "ends"]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        now, row, digest = None, None, None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            columns = [b.column(i).to_pylist() for i in (0, 4, 5, 6)]
            for i, (sequence, n, conv_id, members) in enumerate(zip(*columns, strict=True)):
                if sequence == now:
                    row[2] += n
                    digest.update(b"," + members.encode())
                    continue
                if now is not None:
                    out.append((*row, digest.hexdigest()))
                now, digest = sequence, hashlib.sha256(members.encode())
                row = [b.column(2)[i].as_py(), b.column(3)[i].as_py(), n, conv_id]
            if len(out) > 5000:
                yield batch()
        if now is not None:
            out.append((*row, digest.hexdigest()))
        yield batch()

    return blocks.repartition("sequence").sortWithinPartitions("sequence", "block").mapInArrow(
        run, "ids array<long>, chars array<long>, n long, conv_id long, ends string"
    )


# --- the matrix ---------------------------------------------------------------------------


@dataclass
class Level:
    """The nodes of one depth. ``rows`` are the conversations long enough, in order; ``first`` the places in ``rows`` at
    which nodes start; ``parent`` each node's place in the level above; ``node`` the node of each conversation."""

    rows: np.ndarray
    first: np.ndarray
    parent: np.ndarray
    node: np.ndarray

    def add(self, values: np.ndarray) -> np.ndarray:
        """Values of all conversations, in sum for each node."""
        return np.add.reduceat(values[self.rows], self.first)

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.rows], self.first)

    def to_parents(self, values: np.ndarray, n_parents: int) -> np.ndarray:
        """Values of the nodes, in sum for each node of the level above. Children of one parent stand together."""
        out = np.zeros(n_parents, np.int64)
        if len(self.parent):
            starts = np.flatnonzero(np.concatenate([[True], self.parent[1:] != self.parent[:-1]]))
            out[self.parent[starts]] = np.add.reduceat(values, starts)
        return out


def dense(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Ranks from 1 of pairs of integers; equal pairs have equal ranks."""
    if not len(hi):
        return np.zeros(0, np.int32)
    order = np.lexsort((lo, hi))
    new = np.concatenate([[True], (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])])
    out = np.empty(len(hi), np.int32)
    out[order] = np.cumsum(new)
    return out


def levels(ids: np.ndarray, at: np.ndarray) -> list[Level]:
    """The nodes of every depth of at least one sequence. Sequence i holds ids[at[i]:at[i + 1]], all above 0."""
    lengths = np.diff(at)
    n = len(lengths)
    rows, node = np.arange(n), np.zeros(n, np.int64)
    out: list[Level] = []
    for begin in range(0, max(1, int(lengths.max())), TILE):
        alive = np.flatnonzero(lengths > begin) if begin else np.arange(n)
        width = min(TILE, int(lengths.max()) - begin)
        column = np.arange(begin, begin + width)
        there = column[None, :] < lengths[alive][:, None]
        matrix = np.zeros(there.shape, np.int32)
        matrix[there] = ids[(at[alive][:, None] + column)[there]]
        group = node[alive]
        order = np.lexsort((*matrix.T[::-1], group))
        rows, matrix, there, group = alive[order], matrix[order], there[order], group[order]
        if not begin:
            out.append(Level(rows, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(n, np.int64)))
        change = np.ones((len(rows), width), bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, :1] |= (group[1:] != group[:-1])[:, None]
        starts = np.logical_or.accumulate(change, axis=1)
        for k in range(width):
            here = rows[there[:, k]]
            begins = starts[there[:, k], k]
            first = np.flatnonzero(begins)
            above = out[-1].node
            new = np.full(n, -1, np.int64)
            new[here] = np.cumsum(begins) - 1
            out.append(Level(here, first, above[here[first]], new))
        node = out[-1].node
    return out


def _shard(ids: np.ndarray, at: np.ndarray, chars: np.ndarray, n: np.ndarray, conv: np.ndarray, ends: list[str], shard: int) -> Iterator[dict]:
    """Columns of SHARD_ROWS: the finished nodes of a shard, then its first and last row with the parts of their nodes."""
    ranks, lengths = dense(ids[0::2], ids[1::2]), np.diff(at)
    tree = levels(ranks, at)
    edge = tree[0].rows[[0, -1]]
    below: dict = {}
    found = []
    for depth in range(len(tree) - 1, -1, -1):
        level = tree[depth]
        head = level.rows[level.first]
        convs, least = level.add(n), level.least(conv)
        on_edge = np.isin(np.arange(len(head)), level.node[edge])
        # what comes from children inside the shard; rows at the edge are for later
        children, leaves, saved = (below.get(k, np.zeros(len(head), np.int64)) for k in ("children", "leaves", "saved"))
        own = (convs - 1) * chars[at[head] + depth - 1] if depth else np.zeros(1, np.int64)
        inside = ~on_edge
        whole_leaves = np.where(children == 0, 1, leaves)
        whole_saved = saved + own
        end = [ends[r] if lengths[r] == depth else NO_END for r in head]
        found.append((convs, least, children, leaves, saved, end))
        if inside.any():
            parents = tree[depth - 1]
            up = level.parent[inside]
            known = ~np.isin(up, parents.node[edge])
            side = np.where(up == parents.node[edge[0]], 0, 1)
            above = parents.least(conv)[up]
            yield {
                "conv_id": least[inside], "depth": np.full(inside.sum(), depth), "parent_conv_id": pa.array(above, mask=~known),
                "n_convs": convs[inside], "n_children": children[inside], "n_leaves": whole_leaves[inside], "saved_tokens": whole_saved[inside],
                "ends_sha256": [e for e, i in zip(end, inside, strict=True) if i], "shard": np.full(inside.sum(), shard),
                "side": pa.array(side.astype(np.int32), mask=known),
            }
        if depth:
            size = len(tree[depth - 1].first)
            below = {
                k: level.to_parents(np.where(inside, v, 0), size)
                for k, v in (("children", np.ones(len(head), np.int64)), ("leaves", whole_leaves), ("saved", whole_saved))
            }
    found.reverse()
    same = int(np.sum([level.node[edge[0]] == level.node[edge[1]] >= 0 for level in tree]))
    for side, r in enumerate(edge if edge[0] != edge[1] else edge[:1]):
        nodes = [level.node[r] for level in tree[: lengths[r] + 1]]
        columns = [[f[k][i] for f, i in zip(found, nodes, strict=False)] for k in range(6)]
        yield {
            "shard": [shard], "side": pa.array([side], pa.int32()), "ids": [ids[2 * at[r] : 2 * at[r + 1]]], "chars": [chars[at[r] : at[r + 1]]],
            # depths below this are those of the first row
            "shared": [same if side else 0], "part_convs": [columns[0]], "part_first": [columns[1]], "part_children": [columns[2]],
            "part_leaves": [columns[3]], "part_saved": [columns[4]], "part_ends": [columns[5]],
        }


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    size = len(next(iter(columns.values())))
    arrays = [
        c if isinstance(c := columns.get(name), pa.Array) else pa.nulls(size, _KINDS[kind]) if c is None else pa.array(list(c), _KINDS[kind])
        for name, kind in fields
    ]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and where each list begins (one more at the end)."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], at.astype(np.int64) - at[0]


def _by_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    get = lambda name: table.column(name).chunk(0)
    (ids, at), (chars, _) = _lists(get("ids")), _lists(get("chars"))
    n, conv = get("n").to_numpy(), get("conv_id").to_numpy()
    for columns in _shard(ids, at // 2, chars, n, conv, get("ends").to_pylist(), TaskContext.get().partitionId()):
        yield _batch(SHARD_ROWS, columns)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of which shards hold parts, whole; for each row and depth that shards sent the node's id."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    get = lambda name: table.column(name).chunk(0)
    (ids, at), (chars, _) = _lists(get("ids")), _lists(get("chars"))
    at = at // 2
    shard, side, shared = (get(c).to_numpy() for c in ("shard", "side", "shared"))
    parts = {c: _lists(get(f"part_{c}"))[0] for c in ("convs", "first", "children", "leaves", "saved")}
    ends = get("part_ends").values
    part_at = np.concatenate([[0], np.cumsum(np.diff(at) + 1)])
    tree = levels(dense(ids[0::2], ids[1::2]), at)
    least = []
    for depth, level in enumerate(tree):
        mine = np.where(shared <= depth, 1, 0)
        place = np.minimum(part_at[:-1] + depth, part_at[1:] - 1)
        least.append(level.least(np.where(mine == 1, parts["first"][place], np.iinfo(np.int64).max)))
    below: dict = {}
    for depth in range(len(tree) - 1, -1, -1):
        level = tree[depth]
        head = level.rows[level.first]
        mine, place = np.where(shared <= depth, 1, 0), np.minimum(part_at[:-1] + depth, part_at[1:] - 1)
        sums = {c: level.add(parts[c][place] * mine) for c in ("convs", "children", "leaves", "saved")}
        zero = np.zeros(len(head), np.int64)
        children = sums["children"] + below.get("children", zero)
        leaves = np.where(children == 0, 1, sums["leaves"] + below.get("leaves", zero))
        own = (sums["convs"] - 1) * chars[at[head] + depth - 1] if depth else zero
        saved = own + sums["saved"] + below.get("saved", zero)
        end = [NO_END] * len(head)
        for r in level.rows:
            if mine[r] and (e := ends[int(place[r])].as_py()) != NO_END:
                end[level.node[r]] = e
        parent = pa.array(least[depth - 1][level.parent]) if depth else pa.nulls(1, pa.int64())
        yield _batch(NODES + ", shard long, side int", {
            "conv_id": least[depth], "depth": np.full(len(head), depth), "parent_conv_id": parent, "n_convs": sums["convs"],
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": end,
        })
        yield _batch(NODES + ", shard long, side int", {
            "conv_id": least[depth][level.node[level.rows]], "depth": np.full(len(level.rows), depth), "shard": shard[level.rows],
            "side": pa.array(side[level.rows].astype(np.int32)),
        })
        if depth:
            size = len(tree[depth - 1].first)
            below = {k: level.to_parents(v, size) for k, v in (("children", np.ones(len(head), np.int64)), ("leaves", leaves), ("saved", saved))}


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    A node is a distinct sequence of the first d turns of a conversation of ``sequences`` (conv_id, turns as
    array<struct<hi, lo, chars>>, as by :func:`turn_sequences`); the root has none. ``conv_id`` is the smallest
    conversation that begins with it, ``parent_conv_id`` that of its parent (null for the root), ``n_convs`` their number.
    ``n_leaves`` counts the childless nodes of its subtree, itself included; ``saved_tokens`` sums over its subtree what
    sharing the node's last turn saves, its code points times (n_convs - 1). ``ends_sha256`` is the digest of the ids of
    the conversations that end there, ascending, joined by commas.

    Each conv_id comes once. A conversation without turns is a member of the root only. Equal conversations are taken
    together before they are put in order, so that any number of copies is one row of a shard; a first turn that most
    conversations share is cut by the shards like any other stretch of the order. A shard holds its own sequences, 24
    bytes a turn. The task that puts boundary nodes together holds two sequences a shard. A long conversation has a node
    per turn and its own matrices. An empty table gives no nodes. Other columns are not read.
    """
    distinct, seen = stage(
        distinct_sequences(sequences), "distinct", n=F.count(F.lit(1)), turns=F.coalesce(F.sum(F.size("chars")), F.lit(0)),
    )
    spark = sequences.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen["turns"] + seen["n"]) // SHARD_TURNS))
    rows, _ = stage(distinct.repartitionByRange(shards, "ids").mapInArrow(_by_shards, SHARD_ROWS), "shards")
    edges, _ = stage(
        rows.where("ids is not null").repartition(1).mapInArrow(_joined, NODES + ", shard long, side int"), "edges",
    )
    parents = edges.where("shard is not null").select("shard", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    inner = rows.where("ids is null").select(*NODE_NAMES, "shard", "side")
    found = look_up(inner, parents, ["shard", "side", "depth"])
    inside = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return inside.select(*NODE_NAMES).unionByName(edges.where("shard is null").select(*NODE_NAMES))
