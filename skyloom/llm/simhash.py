"""Near-duplicate groups by fingerprints, joined on neighbouring codewords of the binary Golay code.

A fingerprint of 64 bits is cut into three segments of at most 23 bits. Two fingerprints that differ in four bits or
fewer differ, on some two of the segments, in two bits or fewer. Segments that differ in up to two bits have a codeword
in common within four bits of both: the word halfway between them is within three bits of a codeword, since the code is
perfect. A segment has one or six codewords within four bits, so that a fingerprint gets a few keys per pair of
segments, each the index numbers of two codewords, and near fingerprints share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import components, flat, Forest, groups_of, tidy
from skyloom.session import stage

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: The generator polynomial of the binary Golay code of length 23, and the first bit and length of the segments.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: A key with more fingerprints than this is compared in blocks, each pair of blocks in a task of its own.
BLOCK = 4096
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


# Fingerprints


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of flat texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in groups_of(np.diff(offsets), 1 << 20):
        hashes: list[int] = []
        count = np.zeros(j - i, np.int64)
        folded = FOLD[data[offsets[i] : offsets[j]]].tobytes()
        for k in range(i, j):
            words = folded[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]].split()
            if not words:
                continue
            text = b" ".join(words)
            blank = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
            begin = [0, *(blank + 1).tolist()]
            end = [*blank.tolist(), len(text)]
            last = end[SHINGLE - 1 :] or end[-1:]
            hashes += [xxh64_intdigest(text[a:z], SEED) for a, z in zip(begin, last)]  # noqa: B905
            count[k - i] = len(last)
        some = np.flatnonzero(count)
        if not len(some):
            continue
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(count) - count)[some]
        for k, a in zip(some.tolist(), first.tolist(), strict=True):
            votes = bits[a : a + count[k]].sum(axis=0, dtype=np.int64)
            out[i + k] = np.packbits(2 * votes > count[k], bitorder="little").view("<u8")[0]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = fingerprints_of(*flat(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): bit b of fp is set if it is in over half of the hashes of a text's shingles of four words."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_fingerprint), "doc_id long, fp long")


# Codewords


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the error of up to three bits, the five errors of four bits (for errors of
    three), and the remainders of all numbers of 12 bits shifted by 11."""

    def remainder(x: int) -> int:
        for shift in range(22, 10, -1):
            if x >> shift & 1:
                x ^= GENERATOR << (shift - 11)
        return x

    single = [remainder(1 << b) for b in range(23)]
    near = np.zeros(2048, np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= single[p]
            error = sum(1 << p for p in places)
            if weight < 4:
                near[syndrome] = error
            else:
                far[syndrome].append(error)
    wide = np.array([(f + [-1] * 5)[:5] for f in far])
    upper = np.array([remainder(i << 11) for i in range(4096)])
    return near, wide, upper


def neighbours(words: np.ndarray) -> np.ndarray:
    """(word, up to 6): index numbers of the codewords within four bits of 23-bit words; -1 fills up."""
    near, wide, upper = golay()
    syndrome = upper[words >> 11] ^ (words & 2047)
    error = np.concatenate([near[syndrome][:, None], wide[syndrome]], axis=1)
    # the code is systematic: the upper 12 bits of a codeword are its index
    return np.where(error < 0, -1, (words[:, None] ^ error) >> 11)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = b.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(values), 20_000):
            fp = values[i : i + 20_000]
            near = [neighbours(((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
            for p, (x, y) in enumerate(PAIRS):
                key = (near[x][:, :, None] << 12 | near[y][:, None, :]) | p << 24
                ok = (near[x] >= 0)[:, :, None] & (near[y] >= 0)[:, None, :]
                which, *_ = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[ok].astype(np.int32)), pa.array(fp[which].view(np.int64))], ["key", "fp"]
                )


# Comparison


def spanning(fp: np.ndarray, run: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together all fingerprints of equal run within the distance; runs are consecutive.

    Compares each with its next, then with the one after, and so on until no run is that long. Links between what is
    connected already are left out, so that a run gives fewer links than it has members. With ``side``, only pairs of
    different sides are compared.
    """
    forest, label = Forest(len(fp)), np.arange(len(fp))
    out_a, out_b = [], []
    at = np.arange(len(fp))
    d = 1
    while True:
        at = at[at < len(fp) - d]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        far = np.bitwise_count(fp[at] ^ fp[at + d]) <= DISTANCE
        far &= label[at] != label[at + d]
        if side is not None:
            far &= side[at] != side[at + d]
        linked = False
        for i in at[far].tolist():
            if forest.link(i, i + d):
                out_a.append(i)
                out_b.append(i + d)
                linked = True
        if linked:
            label = forest.labels()
        d += 1
    return fp[np.array(out_a, np.int64)], fp[np.array(out_b, np.int64)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, fp) sorted by key: links (a, b), and (a, key) of all fingerprints of keys that have over BLOCK."""

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key.astype(np.int64))],
            ["a", "b", "hot"],
        )

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, hot = 0, None

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, run, size = np.unique(key, return_inverse=True, return_counts=True)
        big = size[run] > BLOCK
        if big.any():
            yield out(fp[big], None, key[big])
        if not big.all():
            yield out(*spanning(fp[~big], run[~big]), None)

    for batch in batches:
        if not len(batch):
            continue
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if hot is not None:
            k = int(np.searchsorted(key, hot, "right"))
            if k:
                yield out(fp[:k], None, key[:k])
            key, fp = key[k:], fp[k:]
            if not len(key):
                continue
            hot = None
        held.append((key, fp))
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        k = int(np.searchsorted(key, key[-1], "left"))
        if k:
            yield from settle(key[:k], fp[:k])
        held = [(key[k:], fp[k:])]
        if len(key) - k > BLOCK:
            hot = key[-1]
            yield out(fp[k:], None, key[k:])
            held = []
    if held:
        yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _compare_blocks(table: pa.Table) -> pa.Table:
    fp = table["fp"].to_numpy().view(np.uint64)
    order = np.argsort(fp)
    a, b = spanning(fp[order], np.zeros(len(fp), np.int64))
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (fp) which differ in four bits or fewer."""
    found, seen = stage(
        distinct.mapInArrow(tidy(_keys), "key int, fp long").repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(tidy(_compare), "a long, b long, hot long"),
        "near", hot=F.count("hot"),
    )
    links = found.where("b is not null").select("a", "b").distinct()
    if not seen["hot"]:
        return links
    members = found.where("hot is not null").select("hot", F.col("a").alias("fp"))
    blocks = members.groupBy("hot").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).alias("blocks"))
    own = members.join(blocks, "hot").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    pairs = own.select(
        "hot", "fp", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda other: F.struct(F.least("own", other).alias("x"), F.greatest("own", other).alias("y")),
        )).alias("pair"),
    ).select("hot", "fp", "pair.*")
    more = pairs.groupBy("hot", "x", "y").applyInArrow(_compare_blocks, "a long, b long")
    return links.unionByName(more).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), a row per document: groups of documents linked by near fingerprints.

    Texts count with A-Z in lower case. A text with fewer than four words is one shingle of all of them; a null text
    or one without words has the fingerprint 0. Documents link if their fingerprints differ in four bits or fewer;
    ``component_id`` is the smallest doc_id reachable. Equal fingerprints are taken together first, so that a group of
    exact copies is one fingerprint whatever its size. Repeated rows give repeated rows. Rows without a doc_id are left
    out: they could not be named. An empty table gives no rows. Other columns are not read.
    """
    prints, _ = stage(fingerprints(docs.where("doc_id is not null")), "fingerprints")
    classes, _ = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots, _ = stage(components(near_links(classes.select("fp"))), "groups")
    named = classes.join(roots, classes["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose doc_id is the smallest of its group. Rows without one stay."""
    gone = near_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
