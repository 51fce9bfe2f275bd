"""Importance resampling towards a target: hashed n-grams found by overlapped scanning, log ratios, a Gumbel draw."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.ordered import rank_rows
from skyloom.session import stage

#: Lower case for A to Z, a space for every ASCII byte that is neither letter nor digit; all other bytes stay.
FOLDED = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else 0x20 for i in range(256)
)
SPACES = re.compile(rb"  +")
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def span_patterns(longest: int) -> list:
    """For each n up to ``longest`` the pattern of n words between single spaces. Its lookarounds admit word bounds only,
    so that with overlapped matches every run of n words is found once, at its first byte."""
    return [regex.compile(rb"(?<![^ ])[^ ]+" + rb" [^ ]+" * (n - 1) + rb"(?![^ ])") for n in range(1, longest + 1)]


def crcs(text: bytes, patterns: list) -> list[np.ndarray]:
    """CRC-32 of every n-gram of a text, by n, repeats included."""
    line = SPACES.sub(b" ", text.translate(FOLDED))
    return [np.fromiter(map(zlib.crc32, map(itemgetter(0), p.finditer(line, overlapped=True))), np.uint32) for p in patterns]


def hashed(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the bucket of every n-gram of each text, as bytes of unsigned integers."""
    patterns, kind = span_patterns(longest), _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = crcs((text.as_py() or "").encode(), patterns)
                places = (np.concatenate(found) % np.uint32(buckets)).astype(kind).tobytes()
                out.append((doc_id, len(found[0]), sum(map(len, found)), places))
                held += len(places)
                if held > 16 << 20:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"]
    )


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each document's begin (one more at the end)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    step = np.dtype(kind).itemsize
    return np.frombuffer(memoryview(data)[at[0] : at[-1]], kind), (at - at[0]) // step


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams fall into each bucket. Tasks add up their own counts first; ``buckets`` rows come to the driver."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0), kind)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target over corpus, rounded down."""
    n = float(len(corpus))
    ratio = (target + 1.0) * (corpus.sum() + n) / ((corpus + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains of a document's n-grams in sum."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, at = _flat(b.column(3), kind)
            upto = np.concatenate([[0], np.cumsum(gain[places])])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(upto[at[1:]] - upto[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): documents drawn in proportion to how the target would weigh them.

    Features of a text are its runs of 1 to ``longest`` words (A to Z folded; a word is a run of letters, digits and
    non-ASCII characters), hashed by CRC-32 into ``buckets``. A bucket's gain compares its smoothed share of all features
    of ``target`` with that of all features of ``docs``. A document's score is its features' gains and a Gumbel number from
    its id, so that the highest scores are a draw without replacement with weights exp(gains). Of the documents of at least
    ``least_words`` words ``percent`` % are drawn; rank counts them from 1, equal scores by smaller id. The others have a
    null rank.

    Each text is scanned once; buckets, 2 bytes a feature, are written to the shared folder and read twice. Ranks come
    from a range partitioning by score. Nothing but the counts of the buckets passes the driver.

    A null or empty text has no features and the weight 0; a null doc_id counts as an empty one for the Gumbel number and
    comes last among equal scores; repeated rows are drawn each for itself; a long text is scanned as a whole, at 2 bytes a
    feature. An empty target has equal gains per document feature; an empty table gives no rows. Other columns are not read.
    """
    features, seen = stage(
        hashed(docs, longest, buckets), "features", n=F.coalesce(F.sum((F.col("n_words") >= least_words).cast("long")), F.lit(0)),
    )
    aims = hashed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aims, buckets))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored, _ = stage(weighted(features, gain).withColumn("score", F.col("weight") + gumbel), "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = rank_rows(scored.where(F.col("n_words") >= least_words), [], order, "rank", window_rows=0)
    draws = seen["n"] * percent // 100
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """The drawn documents with all their columns; every row of a drawn id, a null id too."""
    chosen = scored.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_drawn"]), "left_semi")
