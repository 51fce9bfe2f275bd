"""Packing of documents into sequences of a fixed length: the sum-of-squares rule over an array of levels.

A window is described by its fill level alone. A piece of ``s`` tokens goes to the level that keeps the sum of the
squared counts of partially filled windows smallest, which keeps windows of every level about and so lets most pieces
complete a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skyloom.llm.common import IS_SPACE, flat, groups_of, keys_table, mix, tidy

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)
#: Text whose chunks are found and told apart at a time, and the part of it that is hashed or compared at a time.
SLICE, STEP = 4 << 20, 1 << 20
#: Distinct chunks that are encoded as one text.
LINE = 1 << 18
WEIGHTS = keys_table(4096, 7)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def space_before(data: np.ndarray) -> np.ndarray:
    """For each place in bytes of UTF-8, the end too: is the character before it white space to the tokenizer?"""
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[: len(data) - k + 1]])[: len(data) + 1] for k in (1, 2, 3))
    # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    space = IS_SPACE[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    space |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    space |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    return space | ((one == 0x80) & (((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))))


def chunk_starts(data: np.ndarray, texts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts that begin at ``texts``: at each text, at white space after anything else,
    and at an ASCII sign after a Latin letter.

    The tokenizer's splitting pattern never joins what stands before such a place to what comes after it, and looks ahead
    only whether white space ends, so that a text's ids are those of its chunks, one after the other.
    """
    one, two = (np.concatenate([np.zeros(k, np.uint8), data[: len(data) - k]])[: len(data)] for k in (1, 2))
    letter = _LETTER[one] | (two == 0xC4) | (two == 0xC5) | ((two == 0xC3) & (one != 0x97) & (one != 0xB7))
    cut = (IS_SPACE[data] & ~space[:-1]) | (_SIGN[data] & letter)
    cut[texts[texts < len(data)]] = True
    return np.flatnonzero(cut)


def _positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def distinct_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the number of each distinct chunk's first copy, and for every chunk the place in ``first``.

    Hashes only propose equal chunks; every chunk's bytes are compared with those of the copy it is said to equal.
    """
    lengths = np.diff(np.append(starts, len(data)))
    hashes = np.empty(len(starts), np.uint64)
    for i, j in groups_of(lengths, STEP):
        lo, hi = starts[i], starts[j - 1] + lengths[j - 1]
        place = np.arange(hi - lo) - np.repeat(starts[i:j] - lo, lengths[i:j])
        hashes[i:j] = np.add.reduceat((data[lo:hi].astype(np.uint64) + np.uint64(1)) * WEIGHTS[place & 4095], starts[i:j] - lo)
    _, first, which = np.unique(mix(hashes) ^ lengths.astype(np.uint64), return_index=True, return_inverse=True)
    other = first[which]
    wrong = lengths != lengths[other]
    for i, j in groups_of(lengths, STEP):
        lo, hi = starts[i], starts[j - 1] + lengths[j - 1]
        pick = np.where(wrong[i:j], 0, lengths[i:j])
        mine, theirs = _positions(starts[i:j], pick), _positions(starts[other[i:j]], pick)
        unlike = np.concatenate([[0], np.cumsum(data[mine] != data[theirs])])
        ends = np.cumsum(pick)
        wrong[i:j] |= unlike[ends] != unlike[ends - pick]
    if wrong.any():  # a collision: these few are told apart by their bytes
        own: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(wrong):
            text = data[starts[k] : starts[k] + lengths[k]].tobytes()
            if text not in own:
                own[text] = len(first) + len(extra)
                extra.append(k)
            which[k] = own[text]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, which


class TextIds:
    """Ids of texts by a byte-level vocabulary: distinct chunks of many texts are encoded once and put together by place.

    Nothing is kept from one call to the next. Texts with an added token's own string are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # every character of a token stands for one byte
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, as 32-bit integers. A null counts as an empty text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        for i, j in groups_of(sizes, SLICE):
            ids, at = self._chunked(*flat(column.slice(i, j - i)))
            for k in range(i, j):
                if whole[k]:
                    yield np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, "<u4")
                else:
                    yield ids[at[k - i] : at[k - i + 1]]

    def _chunked(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each text begin (one more at the end)."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        space = space_before(data)
        starts = chunk_starts(data, texts[:-1], space)
        first, which = distinct_chunks(data, starts)
        begin, stop = starts[first], np.append(starts, len(data))[first + 1]
        table, counts = self._encoded(data, begin, stop, IS_SPACE[data[begin]] & ~space[stop])
        at = np.cumsum(counts) - counts
        upto = np.concatenate([[0], np.cumsum(counts[which])])
        return table[_positions(at[which], counts[which])], upto[np.searchsorted(starts, texts)]

    def _encoded(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has.

        Chunks that ``join`` begin with white space and end with something else: in a row they are cut apart again, and
        their ids are told apart by the bytes they stand for. The others, which end a text or are signs, are encoded one
        by one.
        """
        lengths = stop - begin
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        ids, ends = [], []
        rows = [data[_positions(begin[c], lengths[c])].tobytes().decode() for c in (order[i:j] for i, j in groups_of(lengths[order[:n]], LINE))]
        for (i, j), e in zip(groups_of(lengths[order[:n]], LINE), self._batch(rows), strict=True):
            found = np.fromiter(e, "<u4", len(e))
            bytes_upto, chunks_upto = np.cumsum(self.sizes[found]), np.cumsum(lengths[order[i:j]])
            last = np.searchsorted(bytes_upto, chunks_upto)
            if not np.array_equal(bytes_upto[np.minimum(last, len(found) - 1)], chunks_upto):
                raise ValueError("a token of the vocabulary reaches over the start of a chunk")
            ids.append(found)
            ends.append(np.diff(last + 1, prepend=0))
        singles = self._batch([data[begin[c] : stop[c]].tobytes().decode() for c in order[n:].tolist()])
        ids.append(np.fromiter(chain.from_iterable(singles), "<u4"))
        ends.append(np.fromiter(map(len, singles), np.int64))
        counts = np.empty(len(begin), np.int64)
        counts[order] = np.concatenate(ends)
        # back into the order of the chunks
        flat_ids, sorted_counts = np.concatenate(ids), counts[order]
        at = np.empty(len(begin), np.int64)
        at[order] = np.cumsum(sorted_counts) - sorted_counts
        return flat_ids[_positions(at, counts)], counts

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def text_ids(path: str) -> TextIds:
    """A worker reads a vocabulary file once; nothing grows with the texts it meets."""
    return TextIds(path)


class Levels:
    """Open windows by fill level. ``counts[h]`` windows hold h of ``size`` ids; level 0 is a new window."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]

    def place(self, piece: tuple) -> list | None:
        """Put a piece (its length last) into a window; the window's pieces if it is full now."""
        s = piece[-1]
        # a window that leaves level h takes 2 N(h) - 1 from the sum, one that arrives at h + s adds 2 N(h + s) + 1;
        # windows of level 0 and of the full level count for nothing
        change = 2 * self.counts[s:] + 1
        change[-1] = 0
        change[1:] -= 2 * self.counts[1 : self.size - s + 1] - 1
        change[1:][self.counts[1 : self.size - s + 1] == 0] = np.iinfo(np.int64).max
        # of equal levels the highest
        h = int(self.size - s - np.argmin(change[::-1]))
        window = self.open[h].pop() if h else []
        self.counts[h] -= h > 0
        window.append(piece)
        if h + s == self.size:
            return window
        self.open[h + s].append(window)
        self.counts[h + s] += 1
        return None

    def rest(self) -> Iterator[list]:
        """The windows still open at the end, without padding.

        A window filled to a power of two stays. The pieces of the others are cut and poured one after the other into
        full windows, and what is left into windows of powers of two.
        """
        left = []
        for level, windows in enumerate(self.open):
            for window in windows:
                if level & (level - 1) == 0:
                    yield window
                else:
                    left += window
        todo = sum(p[-1] for p in left)
        window, room = [], 0
        for *where, start, length in left:
            while length:
                if not room:
                    room = self.size if todo >= self.size else 1 << (todo.bit_length() - 1)
                take = min(length, room)
                window.append((*where, start, take))
                start, length, room, todo = start + take, length - take, room - take, todo - take
                if not room:
                    yield window
                    window = []


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens), a row per piece.

    A document's ids are those of its text and then ``end_id``. Whole windows are cut off first; the remainder is
    placed by the sum-of-squares rule. Each task packs the documents of its own partition in one pass, with no shuffle,
    and pours together what is open at its end, so that no sequence is padded: each holds ``size`` ids or a power of two.
    A task holds the ids of the pieces in its open windows, of which the rule leaves few.

    A null or empty text is the single ``end_id``. Repeated rows are packed as often as they come; a null doc_id
    stays null. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, levels = text_ids(vocabulary), Levels(size)
        first = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        n = 0

        def close(window: list) -> None:
            nonlocal n
            offset, filled = 0, sum(p[-1] for p in window)
            for doc_id, total, base, ids, start, length in window:
                crc = zlib.crc32(memoryview(ids)[4 * (start - base) : 4 * (start - base + length)])
                out.append((doc_id, start, length, crc, total, first + n, offset, filled))
                offset += length
            n += 1

        def batch() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 8
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for doc_id, found in zip(b.column(0).to_pylist(), ids_of.of(b.column(1)), strict=True):
                ids = found.tobytes() + end
                total = len(ids) // 4
                whole = total // size * size
                for start in range(0, whole, size):
                    close([(doc_id, total, 0, ids, start, size)])
                if whole < total:
                    full = levels.place((doc_id, total, whole, ids[4 * whole :], whole, total - whole))
                    if full:
                        close(full)
                if len(out) >= 20_000:
                    yield batch()
        for window in levels.rest():
            close(window)
        yield batch()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
