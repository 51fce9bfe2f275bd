"""Benchmark passages in documents: the q-gram lemma in diagonal bands, verified by banded alignment.

Passages of the benchmark of up to ``PASSAGE`` bytes are searched in whole texts with an edit budget of a share of their
length, and so are overlapping ones of ``SHORT`` bytes every ``STRIDE``, for quotes that hold no longer one. An occurrence of ``m`` bytes with ``k`` edits shares at least ``m + 1 - q - k q`` of its grams of ``q`` bytes, all
on diagonals (place in the text less place in the passage) at most ``k`` apart. Diagonals are put into bands of ``2 k + 1``
that overlap by half, so that one band holds all of them. Bands with enough shared grams are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import IS_SPACE, flat, groups_of, tidy
from skyloom.llm.recurring import LETTERS

Q = 12
PASSAGE = 200
#: Any quote of SHORT + STRIDE - 1 bytes holds a whole short passage.
SHORT, STRIDE = 100, 25
#: Up to this length edits count against the whole item: its short passages have to stand there verbatim.
WHOLE = 150
SHARE = 0.05
#: Items below this are searched verbatim and at word bounds, those with no gram not at all.
LEAST = 24
#: Benchmark text that one pass over the documents takes; a byte of it stands in up to six passages.
BLOCK_BYTES = 2 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[IS_SPACE] = 32
BITS = 22
#: Bytes of words, after folding.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each place on; the last Q - 1 places have none."""
    h1 = LETTERS[data]
    c = np.uint64(0x9E3779B97F4A7C15)
    h2 = h1[:-1] * c + h1[1:]
    h4 = h2[:-2] * (c + np.uint64(2)) + h2[2:]
    h8 = h4[:-4] * (c + np.uint64(4)) + h4[4:]
    return h8[:-4] * (c + np.uint64(6)) + h4[8:]


@dataclass
class Index:
    """Grams of all passages, sorted, each with the passages and places where it stands."""

    item: np.ndarray
    row: np.ndarray
    passages: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    table: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        item, row, passages, verbatim = [], [], [], []
        for r, (item_id, text) in enumerate(items):
            data = FOLD[np.frombuffer(text.encode(), np.uint8)]
            if len(data) < Q:
                continue
            for size, stride in [(PASSAGE, PASSAGE), (SHORT, STRIDE)] if len(data) > SHORT else [(PASSAGE, PASSAGE)]:
                # the last passage ends with the text
                for a in dict.fromkeys(min(a, max(0, len(data) - size)) for a in range(0, len(data), stride)):
                    item.append(item_id)
                    row.append(r)
                    passages.append(data[a : a + size])
                    verbatim.append(len(data) < LEAST or size == SHORT and len(data) <= WHOLE)
        size = np.array([len(p) for p in passages], np.int64)
        budget = np.where(verbatim, 0, np.minimum((size * SHARE).astype(np.int64), (size - Q) // Q))
        hashes = [gram_hashes(p) for p in passages]
        gram = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        table = np.zeros(1 << BITS, bool)
        table[grams >> np.uint64(64 - BITS)] = True
        return cls(
            np.array(item, object), np.array(row, np.int64), passages, budget, size + 1 - Q - budget * Q, table, grams, np.append(first, len(gram)),
            np.repeat(np.arange(len(passages), dtype=np.int32), [len(h) for h in hashes])[order],
            np.concatenate([np.arange(len(h), dtype=np.int16) for h in hashes] or [np.zeros(0, np.int16)])[order],
        )

    def bands(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(passage, first diagonal of the band) of all bands with enough shared grams."""
        if len(text) < Q:
            return []
        h = gram_hashes(text)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - BITS)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        there = self.grams[k] == h[at]
        at, k = at[there], k[there]
        # more places than entries are fine: a text's places are taken some at a time and counted together
        keys, counts = [], []
        times = self.first[k + 1] - self.first[k]
        for i, j in groups_of(times, 1 << 20):
            n = times[i:j]
            entry = np.repeat(self.first[k[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            passage = self.passage[entry].astype(np.int64)
            diagonal = np.repeat(at[i:j], n) - self.place[entry] + PASSAGE
            half = self.budget[passage] + 1
            band = diagonal // half
            both = np.concatenate([passage << 36 | band + 1, passage << 36 | band])
            key, count = np.unique(both, return_counts=True)
            keys.append(key)
            counts.append(count)
        if not keys:
            return []
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts))
        passage, band = key >> 36, (key & (1 << 36) - 1) - 1
        ok = count >= self.needed[passage]
        first = band[ok] * (self.budget[passage[ok]] + 1) - PASSAGE
        return list(zip(passage[ok].tolist(), first.tolist(), strict=True))

    def places(self, text: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(passage, start, end, edits) of passages found in a text within their budget.

        A short passage does not count where a longer one of its item is found.
        """
        out = set()
        longer: dict[int, list[tuple[int, int]]] = {}
        for short, p, first in sorted((len(self.passages[p]) == SHORT, p, first) for p, first in self.bands(text)):
            found = self.place_of(p, first, text)
            if found is None:
                continue
            start, end, _ = found
            covers = longer.setdefault(int(self.row[p]), [])
            if not short:
                covers.append((start, end))
            elif any(a < end and start < z for a, z in covers):
                continue
            out.add((p, *found))
        return out

    def place_of(self, p: int, first: int, text: np.ndarray) -> tuple[int, int, int] | None:
        """(start, end, edits) of a passage in the band that begins with a diagonal, if within its budget."""
        passage, k = self.passages[p], int(self.budget[p])
        low, width = first - k, 4 * k + 3
        region = max(0, low)
        near, sought = text[region : low + width + len(passage)].tobytes(), passage.tobytes()
        at = near.find(sought)
        while at >= 0:
            start, end = region + at, region + at + len(passage)
            if len(passage) >= LEAST or at_word_bounds(text, start, end):
                return start, end, 0
            at = near.find(sought, at + 1)
        if not k:
            return None
        found = align(passage, text, low, width, None)
        if found is None or found[1] > k:
            return None
        end, edits = found
        back = align(passage[::-1], text[:end][::-1], -k, 2 * k + 1, 0)
        return end - back[0], end, edits

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, set[tuple[int, int, int, int]]]]:
        """Of flat texts: (text, places) where there are any.

        Texts where no stretch of a passage's length has grams enough of any passage are passed over.
        """
        if not self.passages:
            return
        reach, least = PASSAGE + int(self.budget.max()), int(self.needed.min())
        for i, j in groups_of(np.diff(offsets), 1 << 20):
            text = FOLD[data[offsets[i] : offsets[j]]]
            if len(text) < Q:
                continue
            seen = np.concatenate([[0], np.cumsum(self.table[gram_hashes(text) >> np.uint64(64 - BITS)], dtype=np.int32)])
            dense = np.flatnonzero(seen[np.minimum(np.arange(len(seen)) + reach, len(seen) - 1)] - seen >= least)
            for t in np.unique(np.searchsorted(offsets[i : j + 1] - offsets[i], dense, "right") - 1 + i).tolist():
                yield t, self.places(text[offsets[t] - offsets[i] : offsets[t + 1] - offsets[i]])


def at_word_bounds(text: np.ndarray, start: int, end: int) -> bool:
    """Whether no word of a folded text goes on beyond either end of a part of it."""
    inner, word = start > 0 and IN_WORD[text[start]], end < len(text) and IN_WORD[text[end - 1]]
    return not (inner and IN_WORD[text[start - 1]] or word and IN_WORD[text[end]])


def align(passage: np.ndarray, text: np.ndarray, low: int, width: int, start: int | None) -> tuple[int, int] | None:
    """(end, edits) of the best alignment of the whole passage on diagonals low to low + width - 1 of a text.

    It may begin at any place, or only at ``start``. None if the band lies outside the text. Of equal ends the first.
    """
    far = 1 << 20
    steps = np.arange(width)
    column = low + steps  # place in the text that a diagonal has reached
    best = np.where((column >= 0) & (column <= len(text)), 0 if start is None else np.abs(column - start), far)
    if start is not None:
        best[column < start] = far
    padded = np.concatenate([np.zeros(max(0, -low), np.uint8), text[max(0, low) : max(0, low + width + len(passage))]])
    padded = np.concatenate([padded, np.zeros(max(0, width + len(passage) - len(padded)), np.uint8)])
    for i, letter in enumerate(passage):
        column = low + i + 1 + steps
        new = best + (padded[i : i + width] != letter)
        new[column - 1 < 0] = far
        new[:-1] = np.minimum(new[:-1], best[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        new[(column < 0) | (column > len(text))] = far
        best = new
    c = int(best.argmin())
    return (low + len(passage) + c, int(best[c])) if best[c] < far else None


def indexes(benchmark: DataFrame) -> list[Index]:
    """An index for each block of the benchmark of about BLOCK_BYTES; one pass over the documents per block."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = ceil(total / BLOCK_BYTES) or 1
    return [
        Index.of([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()])
        for b in range(blocks)
    ]


def _leaks(index: Index):
    names = ["doc_id", "item_id", "start", "end", "edits", "n_places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple[int, int], list] = {}
            for t, places in index.search(*flat(b.column(1))):
                for p, start, end, edits in places:
                    rows.setdefault((t, index.item[p]), []).append((edits, start, end))
            out = [(b.column(0)[t].as_py(), item, *min(v)[1:], min(v)[0], len(set(v))) for (t, item), v in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits, n_places): a row for each document and benchmark item found in it.

    An item is found if one of its passages stands in the text with edits of at most a twentieth of the passage's length.
    Passages are 200 bytes, one after the other, the last ending with the item (the item itself if it is shorter), and,
    of items above 100 bytes, 100 bytes every 25, the last ending with the item, so that any verbatim quote of 124 bytes
    is found. Of items up to 150 bytes edits count against the whole item: these short passages have to be verbatim.
    Items below 24 bytes have to stand in the text verbatim and at word bounds. Letters A-Z count as
    a-z and all ASCII white space as blanks; places and edits are in bytes of UTF-8. The place is that with the fewest
    edits, the first of equals; n_places counts all places of passages, short ones only where no longer one is found.

    Null and empty texts hold nothing. Null item texts and items below 12 bytes are not searched: they have no gram and
    cannot be told from ordinary text. A null doc_id or item_id stays null; repeated rows give repeated rows; equal items are all
    reported. An empty table on either side gives no rows. Other columns are not read.
    """
    schema = "doc_id long, item_id long, start long, end long, edits long, n_places long"
    parts = [docs.select("doc_id", "text").mapInArrow(tidy(_leaks(index)), schema) for index in indexes(benchmark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holds_any(text: Column, index: Index) -> Column:
    """Whether a text holds an item of the index; never null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.zeros(len(texts), bool)
            for t, places in index.search(*flat(texts)):
                found[t] |= bool(places)
            yield pa.array(found)

    return F.arrow_udf(tidy(run), "boolean")(text)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item (see ``leaks``)."""
    for index in indexes(benchmark):
        docs = docs.where(~holds_any(F.col("text"), index))
    return docs
