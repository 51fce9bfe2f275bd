"""Finding what recurs within and across documents: the steps that word and byte windows have in common.

A *window* is a fixed number of units (words or bytes) of one document. Each window is represented by its *anchor*,
the gram of the window with the smallest hash; equal windows have equal anchors. Consecutive windows with the same
anchor form a *stretch*. Only stretches whose anchor recurs can hold a repeated window, so that the texts of those
alone are brought together, by anchor, and examined there by the method of the operator.

Hashes choose which texts are compared, and 128-bit digests stand for texts in two places: for equal stretches of a
batch, and for the windows of hot anchors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import flat, groups_of, keys_table, mix, tidy
from skyloom.session import stage

SLICE = 1 << 20
LOW = np.uint64((1 << 22) - 1)
#: Text of a batch that is taken apart at a time, and texts of a batch that are expanded at a time.
GROUP_BYTES, GROUP_TEXTS = 2 << 20, 500
PLACE = 128  # more windows than any stretch has
#: A single anchor with more text than this is dealt out again by window.
HOT_BYTES = 32 << 20
#: A single anchor with more distinct text than this in one batch of documents is hot from the start: its stretches are
#: spread over all tasks.
SPREAD_BYTES = 128 << 10
#: Rows of an outgoing batch, about.
OUT_ROWS = 50_000


@dataclass(frozen=True)
class Units:
    """What a document is cut into.

    ``split`` gives, for the flat bytes of a batch and the offsets of its documents, where each unit begins and ends
    and the index of each document's first unit (one more at the end). ``grams`` gives a hash of the ``gram`` units
    from each unit on. ``clean`` brings a stretch of bytes to the form in which stretches are compared. ``locate``
    gets distinct stretches, the number of windows in each and which of them have copies, and gives the (stretch,
    window, bucket) of all windows that it found more than once, where equal buckets hold equal windows.
    """

    window: int
    gram: int
    shard_bytes: int
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    clean: Callable[[bytes], bytes]
    locate: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def squeezed(text: Column) -> Column:
    """Texts compressed one by one, for a shuffle; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3).compress
        for texts in batches:
            yield pa.array([None if t is None else press(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return F.arrow_udf(tidy(run), "binary")(text)


def expanded(column: pa.Array) -> pa.Array:
    """The texts again, as bytes."""
    from zstandard import ZstdDecompressor

    expand = ZstdDecompressor().decompress
    return pa.array([None if t is None else expand(t) for t in column.to_pylist()], pa.large_binary())


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut smaller, so that fewer texts are expanded at a time."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def stretches(g: np.ndarray, left: np.ndarray, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, anchor) of each stretch. left: units from here to the end of the document."""
    width = units.window - units.gram + 1
    for a in range(0, len(left), SLICE):
        b = min(len(left), a + SLICE)
        ok = left[a:b] >= units.window
        if not ok.any():
            continue
        h = g[a : b + width - 1] | LOW
        if len(h) < b - a + width - 1:
            h = np.concatenate([h, np.full(b - a + width - 1 - len(h), ~np.uint64(0))])
        h ^= LOW
        h |= np.arange(len(h), dtype=np.uint64)
        p = (sliding_min(h, width) & LOW).astype(np.int64)
        turn = p[1:] != p[:-1]
        first, last = ok.copy(), ok.copy()
        first[1:] &= turn | ~ok[:-1]
        last[:-1] &= turn | ~ok[1:]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        yield a + first, last - first + 1, a + p[first]


def _anchors(units: Units) -> Callable:
    """Stretches of all documents of a batch: (route, key, doc_id, place).

    Anchors that recur within the batch are known to recur: their stretches are spread over all tasks, and one row
    without a doc_id speaks for them where other batches' stretches of that anchor arrive. No anchor sends more than
    one row of a batch to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = flat(b.column(1))
            found = []
            for i, j in groups_of(np.diff(offsets), GROUP_BYTES):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                begin, end, first_unit = units.split(own, at)
                left = np.repeat(first_unit[1:], np.diff(first_unit)) - np.arange(len(begin))
                g = units.grams(own, begin, end)
                for start, count, anchor in stretches(g, left, units):
                    doc = np.searchsorted(first_unit, start, "right") - 1
                    found.append((g[anchor], all_ids[i + doc], (start - first_unit[doc]) * PLACE + count))
            if not found:
                continue
            key, ids, place = (np.concatenate(x) for x in zip(*found, strict=True))
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            known = times[back] > 1
            spread = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
            route = np.where(known, spread, key)
            speak = np.unique(key[known])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([route, speak]).view(np.int64)),
                    pa.array(np.concatenate([key, speak]).view(np.int64)),
                    pa.array(np.concatenate([ids, np.zeros(len(speak), np.int64)]), mask=np.arange(len(ids) + len(speak)) >= len(ids)),
                    pa.array(np.concatenate([place, np.zeros(len(speak), np.int64)])),
                ],
                ["route", "key", "doc_id", "place"],
            )

    return run


def _keep_recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by route: those whose anchor has another row, or is known to recur."""
    kept, before = None, False

    def out(x: list[np.ndarray], again: np.ndarray) -> pa.RecordBatch:
        ok = (again | (x[0] != x[1])) & x[3]
        return pa.RecordBatch.from_arrays([pa.array(x[i][ok]) for i in (1, 2, 4)], ["key", "doc_id", "place"])

    for b in batches:
        if not len(b):
            continue
        there = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        x = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).fill_null(0).to_numpy(), there, b.column(3).to_numpy()]
        if kept is not None:
            x = [np.concatenate(c) for c in zip(kept, x, strict=True)]
        same = (x[0][1:] == x[0][:-1]) & (x[0] == x[1])[1:] & (x[0] == x[1])[:-1]
        again = np.concatenate([[before], same])
        before = bool(again[-1])
        again[:-1] |= same
        kept = [c[-1:] for c in x]
        yield out([c[:-1] for c in x], again[:-1])
    if kept is not None:
        yield out(kept, np.array([before]))


def joined(parts: list[tuple[int, int, int]]) -> list[tuple[None, int, int, int, None]]:
    """Parts (doc_id, start, end) of documents with those that touch made one, as rows without key and piece; the
    fourth column is their length."""
    out: list[list] = []
    for doc_id, start, end in sorted(parts):
        if out and out[-1][0] == doc_id and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([doc_id, start, end])
    return [(None, doc_id, start, end - start, None) for doc_id, start, end in out]


STRETCH = "key long, doc_id long, start long, n long, piece binary"


def _pieces(units: Units) -> Callable:
    """Texts of the stretches of a batch of documents: (key, doc_id, start, n, piece).

    Of equal stretches in a batch only the earliest keeps its text; the others are repeats whatever is found for it.
    They have neither key nor piece, and n is their length in units. Stretches of anchors that are hot have a negative
    n; a row with the key alone says so where other batches' stretches of that anchor arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4000):
            ids = b.column(0).to_pylist()
            lists = b.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values
            keys, places = inner.field(0).to_numpy(), inner.field(1).to_numpy()
            first: dict[bytes, int] = {}
            rows: list[tuple[int, int, int, int, bytes | None]] = []
            for i, j in groups_of(np.ones(len(b), np.int64), GROUP_TEXTS):
                own, offsets = flat(expanded(b.column(1).slice(i, j - i)))
                begin, end, first_unit = units.split(own, offsets)
                whole = memoryview(own)
                for d in range(i, j):
                    doc_id, at = ids[d], slice(bounds[d], bounds[d + 1])
                    start, n = places[at] // PLACE, places[at] % PLACE
                    a = begin[first_unit[d - i] + start]
                    z = end[first_unit[d - i] + start + n + (units.window - 2)]
                    for key, s, m, x, y in zip(keys[at].tolist(), start.tolist(), n.tolist(), a.tolist(), z.tolist(), strict=True):
                        piece = units.clean(bytes(whole[x:y]))
                        digest = blake2b(piece, digest_size=16).digest()
                        k = first.setdefault(digest, len(rows))
                        if k == len(rows):
                            rows.append((key, doc_id, s, m, piece))
                        elif (old := rows[k])[1:3] == (doc_id, s):
                            continue  # the same row again
                        elif old[1:3] < (doc_id, s):
                            rows.append((key, doc_id, s, m, None))
                        else:
                            rows.append((*old[:4], None))
                            rows[k] = (key, doc_id, s, m, piece)
            weight: Counter[int] = Counter()
            for r in rows:
                if r[4] is not None:
                    weight[r[0]] += len(r[4])
            wide = {k for k, size in weight.items() if size > SPREAD_BYTES}
            texts = [(k, d, s, -m, p) if k in wide else (k, d, s, m, p) for k, d, s, m, p in rows if p is not None]
            rows = texts + [(k, None, None, None, None) for k in wide] + joined([(d, s, s + m + units.window - 1) for _, d, s, m, p in rows if p is None])
            for k in range(0, len(rows), OUT_ROWS):
                part = list(zip(*rows[k : k + OUT_ROWS], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in part[:4]), pa.array(part[4], pa.binary())],
                    ["key", "doc_id", "start", "n", "piece"],
                )

    return run


def _shards(units: Units) -> Callable:
    """Of stretches sorted by anchor and doc_id: (doc_id, start, units, piece) of the parts that repeat an earlier one.

    Anchors are taken together up to ``shard_bytes``. Stretches of hot anchors are passed on with their texts, units
    being the number of their windows: those that come spread, and all of an anchor that is said to be hot or has more
    than HOT_BYTES of distinct texts here.
    """
    window = units.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, bytes | None]] = []
        shard: dict[bytes, list] = {}  # piece: doc_id, start, n, copies
        group: dict[bytes, list] = {}
        sizes = [0, 0]
        current, hot = None, False

        def take(into: dict, piece: bytes, doc_id: int, start: int, n: int) -> int:
            old = into.get(piece)
            if old is None:
                into[piece] = [doc_id, start, n, False]
                return len(piece)
            if (doc_id, start) != (old[0], old[1]):
                old[3] = True
                if (doc_id, start) < (old[0], old[1]):
                    doc_id, start, old[0], old[1] = old[0], old[1], doc_id, start
                out.append((doc_id, start, n + window - 1, None))
            return 0

        def examine() -> None:
            if not shard:
                return
            pieces, rows = list(shard), list(shard.values())
            n = np.array([r[2] for r in rows])
            which, at, bucket = units.locate(pieces, n, np.array([r[3] for r in rows]))
            if len(which):
                doc = np.array([r[0] for r in rows])[which]
                start = np.array([r[1] for r in rows])[which] + at
                order = np.lexsort((start, doc, bucket))
                which, at, bucket, doc, start = (x[order] for x in (which, at, bucket, doc, start))
                head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
                lead = np.flatnonzero(head)[np.cumsum(head) - 1]
                later = (doc != doc[lead]) | (start != start[lead])
                doc, start = doc[later], start[later]
                order = np.lexsort((start, doc))
                doc, start = doc[order], start[order]
                if len(doc):
                    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])
                    lead = np.flatnonzero(head)
                    tail = np.append(lead[1:], len(doc)) - 1
                    out.extend(zip(doc[lead].tolist(), start[lead].tolist(), (start[tail] - start[lead] + window).tolist(), [None] * len(lead), strict=True))
            shard.clear()
            sizes[0] = 0

        def close() -> None:
            if sizes[0] + sizes[1] > units.shard_bytes:
                examine()
            shard.update(group)
            group.clear()
            sizes[0] += sizes[1]
            sizes[1] = 0

        def batch() -> pa.RecordBatch:
            part = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in part[:3]), pa.array(part[3], pa.binary())],
                ["doc_id", "start", "units", "piece"],
            )

        for b in batches:
            for key, doc_id, start, n, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(out) >= OUT_ROWS:
                    yield batch()
                if doc_id is not None and (piece is None or n < 0):
                    out.append((doc_id, start, abs(n), piece))
                    continue
                if key != current:
                    close()
                    current, hot = key, False
                if doc_id is None:
                    hot = True
                elif hot:
                    out.append((doc_id, start, n, piece))
                else:
                    sizes[1] += take(group, piece, doc_id, start, n)
                    if sizes[1] > HOT_BYTES:
                        for p, r in group.items():
                            out.append((*r[:3], p))
                            if len(out) >= OUT_ROWS:
                                yield batch()
                        group.clear()
                        sizes[1], hot = 0, True
            if out:
                yield batch()
        close()
        examine()
        yield batch()

    return run


def _windows(units: Units) -> Callable:
    """The windows of stretches one by one: (doc_id, start, units, digest)."""
    window = units.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, bytes]] = []

        def batch() -> pa.RecordBatch:
            part = list(zip(*out, strict=True)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in part[:3]), pa.array(part[3], pa.binary())],
                ["doc_id", "start", "units", "digest"],
            )

        for b in batches:
            for doc_id, start, n, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = np.frombuffer(piece, np.uint8)
                begin, end, _ = units.split(data, np.array([0, len(data)]))
                for k in range(n):
                    text = piece[begin[k] : end[k + window - 1]]
                    out.append((doc_id, start + k, window, blake2b(text, digest_size=16).digest()))
                if len(out) >= OUT_ROWS:
                    yield batch()
        yield batch()

    return run


def repeats(docs: DataFrame, units: Units) -> DataFrame:
    """(doc_id, start, units): parts of the documents covered by windows that also start earlier.

    Earlier is a smaller doc_id, or a smaller start in the same document. Parts may overlap. Texts are shuffled once
    (to the stretches found in them), anchors once, and texts of stretches with a recurring anchor once. Stretches of
    hot anchors are shuffled once more, over all tasks, and their windows by digest.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    kept = (
        texts.mapInArrow(tidy(_anchors(units)), "route long, key long, doc_id long, place long")
        .repartition("route").sortWithinPartitions("route")
        .mapInArrow(tidy(_keep_recurring), "key long, doc_id long, place long")
    )
    by_doc = kept.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place")).alias("found"))
    packed = texts.select("doc_id", squeezed(F.col("text")).alias("text"))
    pieces = packed.join(by_doc, "doc_id").select("doc_id", "text", "found").mapInArrow(tidy(_pieces(units)), STRETCH)
    # repeats found already need not meet anything, and stretches of hot anchors meet by window
    apart = F.col("doc_id").isNotNull() & (F.col("piece").isNull() | (F.col("n") < 0))
    found, seen = stage(
        pieces.withColumn("key", F.when(apart, F.xxhash64("doc_id", "start")).otherwise(F.col("key")))
        .repartition("key").sortWithinPartitions("key", "doc_id")
        .mapInArrow(tidy(_shards(units)), "doc_id long, start long, units long, piece binary"),
        "repeats", n_hot=F.count("piece"),
    )
    parts = found.where("piece is null").select("doc_id", "start", "units")
    if not seen["n_hot"]:
        return parts
    single, _ = stage(
        found.where("piece is not null").repartition("doc_id", "start")
        .mapInArrow(tidy(_windows(units)), "doc_id long, start long, units long, digest binary"),
        "windows",
    )
    least = single.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    later = single.join(least, "digest").where("struct(doc_id, start) > least")
    return parts.unionByName(later.select("doc_id", "start", "units"))


def cut(docs: DataFrame, parts: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over (doc_id, text, parts): the text squeezed, parts the list of (start, units) of a document or null."""
    by_doc = parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "units")).alias("parts"))
    packed = docs.select("doc_id", squeezed(F.col("text")).alias("text"))
    return packed.join(by_doc, "doc_id", "left").select("doc_id", "text", "parts").mapInArrow(tidy(run), schema)


def marks(parts: list | None, n: int) -> np.ndarray:
    """Which of n units a document's parts cover."""
    edge = np.zeros(n + 1, np.int32)
    for p in parts or ():
        edge[min(p["start"], n)] += 1
        edge[min(p["start"] + p["units"], n)] -= 1
    return np.cumsum(edge[:-1]) > 0


LETTERS = keys_table(256, 7)
WEIGHTS = keys_table(1 << 16, 11)
