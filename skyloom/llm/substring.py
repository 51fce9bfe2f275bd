"""Removal of repeated passages of words: confirmed passages are compiled into Aho-Corasick automata.

Stretches of all documents whose anchor recurs (see ``recurring``) are dealt out by anchor. A shard counts the windows
of its stretches, compiles those met more than once into one automaton and streams every stretch through it, which
gives each place where a passage stands. Words are written with two letters, so that an automaton's nodes keep few
edges and a window is forty letters whatever the length of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.common import IS_SPACE, flat, mix
from skyloom.llm.recurring import LETTERS, WEIGHTS, Units, cut, expanded, marks, repeats, sliced

WINDOW = 20
GRAM = 8


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in flat texts, and the index of each text's first word."""
    inside = ~IS_SPACE[data]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[edges] = inside[edges]
    end[offsets[1:][np.diff(offsets) > 0] - 1] = inside[offsets[1:][np.diff(offsets) > 0] - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, of the bytes and their places in it."""
    out = np.zeros(len(begin), np.uint64)
    step = 1 << 17
    for i in range(0, len(begin), step):
        b, e = begin[i : i + step], end[i : i + step]
        length = e - b
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        inner = np.arange(int(length.sum())) - np.repeat(first, length)
        values = LETTERS[data[np.repeat(b, length) + inner]] * WEIGHTS[inner & 0xFFFF]
        out[i : i + step] = np.add.reduceat(values, first)
    return mix(out)


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = word_hashes(data, begin, end)
    g = np.zeros_like(h)
    for k in range(min(GRAM, len(h))):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g[: len(h) - k] += h[k:]
    return mix(g)


def clean(piece: bytes) -> bytes:
    return b" ".join(piece.split())


def locate(pieces: list[bytes], n: np.ndarray, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows that stand in a shard more than once, copies of a stretch included."""
    import ahocorasick

    split = [p.split() for p in pieces]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s))}
    base = int(len(known) ** 0.5) + 1
    # first and second letters are of different ranges, so that no match begins within a word
    letters = {w: chr(0xE000 + i // base) + chr(0x20 + i % base) for w, i in known.items()}
    texts = ["".join(map(letters.__getitem__, s)) for s in split]
    width = 2 * WINDOW
    times: Counter[str] = Counter()
    for text, m, more in zip(texts, n.tolist(), copied.tolist(), strict=True):
        own = [text[2 * k : 2 * k + width] for k in range(m)]
        times.update(own)
        if more:
            times.update(own)
    automaton = ahocorasick.Automaton()
    for i, (text, c) in enumerate(times.items()):
        if c > 1:
            automaton.add_word(text, i)
    if not len(automaton):
        return (np.zeros(0, np.int64),) * 3
    automaton.make_automaton()
    out = [(i, end // 2 - WINDOW + 1, k) for i, text in enumerate(texts) for end, k in automaton.iter(text)]
    return tuple(np.array(x) for x in zip(*out, strict=True))


UNITS = Units(WINDOW, GRAM, 1 << 19, words, grams, clean, locate)


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        data, offsets = flat(expanded(b.column(1)))
        total, removed, kept = [], [], []
        for i, parts in enumerate(b.column(2).to_pylist()):
            own = data[offsets[i] : offsets[i + 1]].tobytes().split()
            total.append(len(own))
            if parts:
                gone = marks(parts, len(own))
                removed.append(int(gone.sum()))
                own = compress(own, (~gone).tolist())
            else:
                removed.append(0)
            kept.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), a row per document: words left when repeated windows are removed.

    A word goes if a window of 20 words that covers it stands earlier too, in a document of smaller doc_id or before
    in the same one. Windows are judged on the input, and never cross documents. ``kept`` holds the other words, one
    space between them.

    Null and empty texts have no words. Texts below 20 words stay. Rows without a doc_id stay whole and repeat
    nothing. doc_id is a key: repeated equal rows give repeated rows, and neither is earlier than the other. An empty
    table gives no rows. Other columns are not read.
    """
    return cut(docs, repeats(docs, UNITS), _kept_words, "doc_id long, n_words long, n_removed long, kept string")
