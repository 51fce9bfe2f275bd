"""Language identification by a convolutional network over bytes, written and trained in numpy.

A text is cut into windows of a fixed number of bytes. Filters of several widths slide over a window's bytes, the
largest answer of each filter is kept, and a softmax layer turns these into languages. Since the input is one byte per
place, a filter is a table of one number per byte and place, so that the network is a few look-ups and sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import flat, held_out, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"


@dataclass
class Network:
    """``filters[i]`` is (width, byte, filter); ``weights`` is (feature, language)."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, languages: list[str], seed: int) -> Network:
        rnd = np.random.default_rng(seed)
        filters = [rnd.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        weights = rnd.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        return cls(languages, filters, np.zeros(len(weights), np.float32), weights, np.zeros(len(languages), np.float32))

    def answers(self, windows: np.ndarray) -> list[np.ndarray]:
        """(window, place, filter) of each width for windows of bytes."""
        out = []
        for table in self.filters:
            n = windows.shape[1] - len(table) + 1
            total = np.take(table[0], windows[:, :n], axis=0)
            for k in range(1, len(table)):
                total += np.take(table[k], windows[:, k : k + n], axis=0)
            out.append(total)
        return out

    def log_shares(self, windows: np.ndarray) -> np.ndarray:
        """Logarithms of the languages' probabilities of each window."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        step = 64
        for i in range(0, len(windows), step):
            top = np.concatenate([x.max(axis=1) for x in self.answers(windows[i : i + step])], axis=1)
            z = np.maximum(top + self.bias, 0) @ self.weights + self.offset
            z -= z.max(axis=1, keepdims=True)
            out[i : i + step] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of flat texts (the last of a text filled up with spaces), each one's text and bytes."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[text] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[text + 1] - begin)
    padded = np.concatenate([data, np.full(WINDOW, 0x20, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    for i in np.flatnonzero(length < WINDOW):
        out[i, length[i] :] = 0x20
    return out, text, length


def train(windows: np.ndarray, languages: np.ndarray, names: list[str], epochs: int = 6, seed: int = 1) -> Network:
    """Adam over minibatches; every language counts the same in sum. The same rows give the same network."""
    net = Network.start(names, seed)
    rnd = np.random.default_rng(seed)
    share = len(languages) / (len(names) * np.maximum(np.bincount(languages, minlength=len(names)), 1))
    params = [*net.filters, net.bias, net.weights, net.offset]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, batch = 0, 128
    for _ in range(epochs):
        order = rnd.permutation(len(windows))
        for i in range(0, len(order), batch):
            x, y = windows[order[i : i + batch]], languages[order[i : i + batch]]
            answers = net.answers(x)
            best = [a.argmax(axis=1) for a in answers]
            top = np.concatenate([np.take_along_axis(a, b[:, None], 1)[:, 0] for a, b in zip(answers, best, strict=True)], axis=1)
            seen = np.maximum(top + net.bias, 0)
            z = seen @ net.weights + net.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z *= (share[y] / len(y))[:, None].astype(np.float32)
            back = (z @ net.weights.T) * (seen > 0)
            slopes = []
            for j, (table, b) in enumerate(zip(net.filters, best, strict=True)):
                slope = np.zeros_like(table)
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(table)):
                    np.add.at(slope[k], (np.take_along_axis(x, b + k, 1), np.arange(FILTERS)[None, :]), part)
                slopes.append(slope)
            slopes += [back.sum(axis=0), seen.T @ z, z.sum(axis=0)]
            t += 1
            for p, g, m, s in zip(params, slopes, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def sample(docs: DataFrame, per_language: int = 1000, max_rows: int = 20_000, windows: int = 4) -> DataFrame:
    """Labelled rows to learn from: (lang, pieces), about ``per_language`` of each language, ``max_rows`` in all at most.

    Languages are counted, and of each the share of rows is taken, by a hash of the id, that gives so many. The places
    of a text's pieces are chosen by a hash too, over whole texts. Held-out rows, null languages and texts without
    letters are left out.
    """
    n = "cast(ceil(octet_length(text) / {0}) as bigint)".format(WINDOW)
    pieces = (
        f"transform(sequence(1, {windows}), j -> "
        f"substring(encode(text, 'utf-8'), cast(pmod(xxhash64(doc_id, j), {n}) * {WINDOW} + 1 as int), {WINDOW}))"
    )
    known = docs.select("doc_id", "lang", "text").where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    # one row for each of the thousand commonest languages at most, which go to the rows
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(1000)
    shares = F.broadcast(counts.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("share")))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(shares, "lang").where(place < F.col("share")).select("doc_id", "lang", F.expr(pieces).alias("pieces"))
    return chosen.orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "lang", "pieces").limit(max_rows).select("lang", "pieces")


def fit(docs: DataFrame, per_language: int = 1000, max_rows: int = 20_000, windows: int = 4) -> Network | None:
    """A network learned from a bounded sample of labelled rows; None if there are none."""
    rows = sample(docs, per_language, max_rows, windows).collect()
    names = sorted({r.lang for r in rows})
    if not names:
        return None
    texts = [bytes(p) for r in rows for p in r.pieces]
    labels = np.array([names.index(r.lang) for r in rows for _ in r.pieces])
    data = np.frombuffer(b"".join(texts), np.uint8)
    x, _, _ = windows_of(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return train(x, labels, names)


def language(text: Column, net: Network | None) -> Column:
    """struct(lang, score) of a text: the likeliest language over all its windows and its probability.

    Windows count by their bytes; the score is the mean of the windows' logarithms made a probability again. A text
    that is null or has no letter, and any text for a network without languages, gets ``und`` and 0.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lettered in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            use = np.flatnonzero(lettered.fill_null(False).to_numpy(zero_copy_only=False))
            if net is not None and len(use):
                data, offsets = flat(texts.take(pa.array(use)))
                # some texts at a time, so that windows of long batches stay small
                for i in range(0, len(use), 200):
                    j = min(len(use), i + 200)
                    x, text, length = windows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    total = np.zeros((j - i, len(net.languages)))
                    np.add.at(total, text, net.log_shares(x) * length[:, None])
                    total /= np.diff(offsets[i : j + 1])[:, None]
                    total = np.exp(total - total.max(axis=1, keepdims=True))
                    total /= total.sum(axis=1, keepdims=True)
                    lang[use[i:j]] = np.array(net.languages, object)[total.argmax(axis=1)]
                    score[use[i:j]] = total.max(axis=1)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return F.arrow_udf(tidy(run), "lang string, score double")(text, text.rlike(r"\p{L}"))


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per document, of its whole text.

    Null texts and texts without letters are ``und`` with score 0; a null doc_id stays null and is not held out; of
    equal scores the language first in the alphabet wins; repeated rows give repeated rows, an empty table none.
    Columns other than doc_id and text are not read.
    """
    found = docs.select("doc_id", language(F.col("text"), net).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def recognised(docs: DataFrame, net: Network | None, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose language is known with a score of ``least`` or more."""
    found = language(F.col("text"), net)
    return docs.where((found["lang"] != UNKNOWN) & (found["score"] >= least))
