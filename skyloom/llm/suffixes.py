"""Removal of repeated byte strings: suffixes are put in order by refining buckets with bucket pointers.

Stretches whose anchor recurs (see ``recurring``) are dealt out by anchor. In a shard the positions of all stretches
are put in buckets by their first bytes, in order. Then buckets are refined one run of neighbours after the other: a
bucket's positions are sorted on the buckets that hold the positions some bytes later, again and again until each is alone
or shares a window with the others. Later runs point to buckets that earlier ones have refined, and so take few steps.
Equal windows are then side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.common import flat, groups_of
from skyloom.llm.recurring import LETTERS, Units, cut, expanded, marks, repeats, sliced

WINDOW = 100
GRAM = 32
FIRST = 8  # bytes of the first buckets
RUN = 1 << 15  # positions of the buckets that are refined together


def each_byte(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data))
    return at, at + 1, offsets


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on, by doubling. Positions too near to the end get what there is."""
    out = np.zeros(len(data), np.uint64)
    step = 1 << 18
    for a in range(0, len(data), step):
        h = LETTERS[data[a : a + step + GRAM - 1]]
        short = GRAM - 1 if a + step + GRAM - 1 > len(data) else 0
        h = np.concatenate([h, np.zeros(short, np.uint64)])
        k = 1
        while k < GRAM:
            h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
            k *= 2
        out[a : a + step] = h[: len(out[a : a + step])]
    return out


def refine(data: np.ndarray, left: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, group) of all windows that occur more than once; equal windows have equal groups.

    left: bytes from a position to its text's end. A window has ``FIRST`` bytes at least. A bucket is named by the rank of
    its first position, and ``depth`` says how many bytes its positions share: positions of other buckets share fewer with
    them. Beyond the end stand zeros, all of which are position ``n``.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
    code = np.zeros(n + 1, np.uint64)
    for k in range(FIRST):
        code = (code << np.uint64(8)) | padded[k : n + 1 + k]
    ranked = np.argsort(code)
    first = np.flatnonzero(np.append(True, code[ranked[1:]] != code[ranked[:-1]]))
    sizes = np.diff(np.append(first, n + 1))
    bucket = np.empty(n + 1, np.int64)
    bucket[ranked] = np.repeat(first, sizes)
    depth = np.full(n + 1, FIRST, np.int64)
    several = sizes > 1
    ranked = ranked[np.repeat(several, sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes[several])])
    for i, j in groups_of(sizes[several], RUN):
        _refine_run(ranked[ends[i] : ends[j]], bucket, depth, window)
    # buckets may be finer than windows: equal windows stand side by side, and their own bytes decide
    at = ranked[np.append(left, 0)[ranked] >= window]
    at = at[np.argsort(bucket[at])]
    equal = np.arange(len(at) - 1)
    for k in [*range(0, window - FIRST, FIRST), window - FIRST]:
        equal = equal[code[at[equal] + k] == code[at[equal + 1] + k]]
    again = np.zeros(len(at) + 1, bool)
    again[equal + 1] = True
    some = again[:-1] | again[1:]
    return at[some], np.cumsum(~again[:-1])[some]


def _refine_run(at: np.ndarray, bucket: np.ndarray, depth: np.ndarray, window: int) -> None:
    """Refine some neighbouring buckets until each holds one position or shares a window; ``bucket`` and ``depth`` change.

    Each step sorts the positions of a bucket on the buckets of the positions ``depth`` bytes later, as they are by then, and so
    adds the depth of these. Refined buckets are pointed to at once, by the next step and by all later runs.
    """
    beyond = len(bucket) - 1
    while len(at):
        key = bucket[at] << 32 | bucket[np.minimum(at + depth[bucket[at]], beyond)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        own = key >> 32
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        opens = np.append(True, own[1:] != own[:-1])
        fresh = own[head] + head - np.flatnonzero(opens)[np.cumsum(opens)[head] - 1]
        reached = depth[own[head]] + depth[key[head] & 0xFFFFFFFF]
        sizes = np.diff(np.append(head, len(at)))
        depth[fresh] = reached
        bucket[at] = np.repeat(fresh, sizes)
        at = at[np.repeat((sizes > 1) & (reached < window), sizes)]


def locate(pieces: list[bytes], n: np.ndarray, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    at, bucket = refine(data, np.repeat(ends, sizes) - np.arange(len(data)))
    which = np.searchsorted(ends, at, "right")
    return which, at - (ends - sizes)[which], bucket


UNITS = Units(WINDOW, GRAM, 2 << 20, each_byte, grams, bytes, locate)


def _kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        data, offsets = flat(expanded(b.column(1)))
        total, removed, spans, kept = np.diff(offsets), [], [], []
        for i, parts in enumerate(b.column(2).to_pylist()):
            own = data[offsets[i] : offsets[i + 1]]
            if parts:
                gone = marks(parts, len(own))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                own = own[~gone]
            else:
                removed.append(0)
                spans.append(0)
            kept.append(own.tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row per document: the bytes left when repeated ones are removed.

    A byte goes if a string of 100 bytes that covers it begins earlier too, in a document of smaller doc_id or before
    in the same one; such strings may overlap, are judged on the input and never cross documents. ``n_spans`` counts
    the maximal removed runs.

    Null and empty texts have no bytes. Texts below 100 bytes stay. Rows without a doc_id stay whole and repeat
    nothing. doc_id is a key: repeated equal rows give repeated rows, and neither is earlier than the other. An empty
    table gives no rows. Other columns are not read.
    """
    return cut(docs, repeats(docs, UNITS), _kept_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
