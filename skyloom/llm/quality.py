"""Quality of documents by gradient-boosted trees on histograms of text statistics, written and trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import flat, groups_of, held_out
from skyloom.llm.substring import word_hashes, words
from skyloom.session import stage

# Classes of bytes; the last is that of all bytes above ASCII and of control characters.
CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "quote", "bar", "mark", "sign", "other"]
CLASS = np.full(256, CLASSES.index("other"))
for _name, _bytes in {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "blank": b" \t", "line": b"\n\r\v\f", "stop": b".,;:", "quote": b"'\"-()[]{}", "bar": b"|/\\_", "mark": b"!?",
    "sign": b"#$%&*+<=>@^`~",
}.items():
    CLASS[list(_bytes)] = CLASSES.index(_name)
FEATURES = [
    *(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "bytes_per_word", "upper_of_letters", "distinct_words",
    "commonest_word", "word_again", "short_words", "long_words", "words_per_line",
]
LEAST_SCORE = 0.3


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, feature) of flat texts; all zero for an empty one."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    k = len(CLASSES)
    for i, j in groups_of(np.diff(offsets), 1 << 20):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        sizes = np.diff(at)
        count = np.bincount(CLASS[own] + k * np.repeat(np.arange(j - i), sizes), minlength=k * (j - i)).reshape(-1, k)
        begin, end, first = words(own, at)
        n = np.diff(first)
        h, length = word_hashes(own, begin, end), end - begin
        again = np.zeros(len(h))
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][n > 0]] = 0
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (length, again, length <= 3, length > 12)]
        total, repeated, short, long = (s[first[1:]] - s[first[:-1]] for s in sums)
        distinct, most = np.zeros(j - i), np.zeros(j - i)
        for d in np.flatnonzero(n):
            times = np.unique(h[first[d] : first[d + 1]], return_counts=True)[1]
            distinct[d], most[d] = len(times), times.max()
        per = np.maximum(n, 1)
        letters = count[:, 0] + count[:, 1]
        out[i:j] = np.column_stack([
            count / np.maximum(sizes, 1)[:, None], np.log1p(sizes), np.log1p(n), total / per,
            count[:, 1] / np.maximum(letters, 1), distinct / per, most / per, repeated / per, short / per, long / per,
            n / (1 + count[:, CLASSES.index("line")]),
        ])
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(*flat(b.column(1)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
            ["doc_id", "x"],
        )


@dataclass
class Trees:
    """Complete trees of one depth as arrays: the children of node ``i`` are ``2 i + 1`` and ``2 i + 2``.

    ``feature`` and ``limit`` are (tree, inner node), ``value`` is (tree, leaf); a row goes right if it is above the
    limit. A node that was not split has an infinite limit.
    """

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15) -> Trees:
    """Trees for the logistic loss. Features are put into ``bins`` by their quantiles; a node's best split is found
    from the sums of slopes and curvatures per bin. No rows give 0.5 for everything; rows of one label alone a constant."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    total = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            own = node - first
            gain, at = np.zeros(width), np.zeros(width, np.int64)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                m = len(cut) + 1
                g, c = (np.bincount(own * m + binned[:, f], w, width * m).reshape(width, m) for w in (slope, curve))
                left_g, left_c = np.cumsum(g, 1)[:, :-1], np.cumsum(c, 1)[:, :-1]
                all_g, all_c = g.sum(1)[:, None], c.sum(1)[:, None]
                better = left_g**2 / (left_c + 1) + (all_g - left_g) ** 2 / (all_c - left_c + 1) - all_g**2 / (all_c + 1)
                better[(left_c < 1) | (all_c - left_c < 1)] = 0
                k = better.argmax(1)
                best = better[np.arange(width), k]
                new = best > gain + 1e-9
                gain[new], at[new], feature[first : first + width][new] = best[new], k[new], f
            split = gain > 0
            limit[first : first + width] = [cuts[f][k] if s else np.inf for f, k, s in zip(feature[first : first + width], at, split, strict=True)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + 1)
        total += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(base, np.array(features), np.array(limits), np.array(values))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document, of its whole text.

    Statistics of all texts are written once; the trees learn from those of at most ``max_rows`` labelled documents,
    chosen by a hash of the id, none of them held out. Only doc_id and quality of ``labels`` are read, only doc_id and
    text of ``docs``.

    Null and empty texts have statistics of zero and a score. Null labels are not learned from; a document with two
    labels is learned twice. Without labels every score is 0.5. A null doc_id stays null and is not held out; repeated
    rows give repeated rows, an empty table none.
    """
    found, _ = stage(docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics")
    known = (
        found.where(~held_out(F.col("doc_id")))
        .join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(max_rows).select("x", "quality").toArrow()
    )
    x = known["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    trees = boost(x, known["quality"].to_numpy().astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(rows))], ["doc_id", "score"])

    scored = found.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted")
    )
