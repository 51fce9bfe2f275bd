"""Near-duplicate vectors by product quantisation: coarse lists, codes of the residuals, exact cosines of what is left.

Vectors are scaled to length one. Each belongs to the list of its nearest coarse centre; what remains of it is coded by
one of some codewords per subspace. A vector looks into the lists of its nearest centres, where a table of its products
with all codewords gives the products with the members by look-up. A member's own coding error bounds how far such a
product is off, so that no member within the threshold is passed over in a list that is looked into. The rest is
compared exactly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Forest, components
from skyloom.session import stage

LEAST = 0.9
SUBSPACE = 8  # dimensions
CODEWORDS = 64
LIST = 256  # classes aimed at per list
MAX_LISTS = 1024
SAMPLE = 16_384
PROBES = 16
MEMBERS, QUERIES = 2048, 16_384  # of a list, in one task


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    centres = x[np.sort(rnd.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = count > 0
        centres[some] = sums[some] / count[some, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """(row, n): index numbers of the nearest centres, the nearest first."""
    out = np.empty((len(x), min(n, len(centres))), np.int64)
    for i in range(0, len(x), 4096):
        far = (centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T
        out[i : i + 4096] = np.argsort(far, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


@dataclass
class Quantiser:
    centres: np.ndarray
    codewords: list[np.ndarray]
    cuts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 1) -> Quantiser:
        centres = kmeans(x, lists, 8, seed)
        rest = x - centres[nearest(x, centres, 1)[:, 0]]
        cuts = [slice(i, i + SUBSPACE) for i in range(0, x.shape[1], SUBSPACE)]
        return cls(centres, [kmeans(rest[:, c], CODEWORDS, 6, seed) for c in cuts], cuts)

    def encode(self, x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the ``lists`` nearest lists, codes, length of the coding error) of each row."""
        probes = nearest(x, self.centres, lists)
        rest = x - self.centres[probes[:, 0]]
        codes = np.column_stack([nearest(rest[:, c], w, 1)[:, 0] for c, w in zip(self.cuts, self.codewords, strict=True)])
        guess = np.concatenate([w[codes[:, j]] for j, w in enumerate(self.codewords)], axis=1)
        return probes, codes.astype(np.uint8), np.sqrt(((rest - guess) ** 2).sum(1))

    def products(self, q: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """(query, member): products of queries with the coded members of a list, by look-up."""
        out = np.repeat((q @ self.centres[of])[:, None], len(codes), 1)
        for j, (c, w) in enumerate(zip(self.cuts, self.codewords, strict=True)):
            out += np.take(q[:, c] @ w.T, codes[:, j], axis=1)
        return out


NAMES = ["list", "id", "n", "x", "probes", "codes", "error"]


def _entries(quantiser: Quantiser, dim: int, probed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            probes, codes, error = quantiser.encode(unit(b.column(2), dim), probed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(probes[:, 0].astype(np.int32)), b.column(0), b.column(1), b.column(2),
                    pa.array(list(probes.astype(np.int32)), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                ],
                NAMES,
            )

    return run


def _links(quantiser: Quantiser, dim: int):
    """Of entries sorted by (list, part of it, role): what each found, (a, null, n), and links (a, b, null).

    A pair is met twice if each looks into the other's list; then the smaller id counts it for both. Links that
    connect nothing new in a part are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, state = None, [], None

        def out(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), *(none if v is None else pa.array(np.asarray(v, np.int64)) for v in (b, n))], ["a", "b", "n"])

        def columns(b: pa.RecordBatch) -> dict:
            probes = b.column("probes")
            return {
                "id": b.column("id").to_numpy(), "n": b.column("n").to_numpy(), "x": unit(b.column("x"), dim), "own": b.column("list").to_numpy(),
                "probes": probes.flatten().to_numpy().reshape(len(b), -1), "error": b.column("error").to_numpy(),
                "codes": np.array([np.frombuffer(c, np.uint8) for c in b.column("codes").to_pylist()]).reshape(len(b), -1),
            }

        def ready() -> dict | None:
            parts = [columns(m) for m in members]
            if not parts:
                return None
            m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            m["found"], m["forest"], m["label"] = np.zeros(len(m["id"]), np.int64), Forest(len(m["id"])), np.arange(len(m["id"]))
            return m

        def meet(q: dict, m: dict, where: int) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(q["id"]), 512):
                part = {k: v[i : i + 512] for k, v in q.items()}
                near = quantiser.products(part["x"], where, m["codes"]) + m["error"] >= LEAST - 1e-9
                y, z = np.nonzero(near)
                both = (part["probes"][y] == m["own"][z][:, None]).any(1) & (m["probes"][z] == part["own"][y][:, None]).any(1)
                ok = (part["id"][y] != m["id"][z]) & (~both | (part["id"][y] < m["id"][z]))
                y, z = y[ok], z[ok]
                close = [np.einsum("ij,ij->i", part["x"][y[k : k + 65_536]], m["x"][z[k : k + 65_536]]) >= LEAST for k in range(0, len(y), 65_536)]
                ok = np.concatenate(close) if close else np.zeros(0, bool)
                y, z = y[ok], z[ok]
                m["found"] += np.bincount(z, part["n"][y], len(m["id"])).astype(np.int64)
                found = np.bincount(y, m["n"][z], len(part["id"])).astype(np.int64)
                yield out(part["id"][found > 0], None, found[found > 0])
                # each query is linked to its first member, and other members to that one if they were apart
                lead = np.concatenate([[True], y[1:] != y[:-1]]) if len(y) else np.zeros(0, bool)
                first = z[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(y) else z
                apart = np.flatnonzero(m["label"][first] != m["label"][z])
                new = [k for k in apart.tolist() if m["forest"].link(int(first[k]), int(z[k]))]
                if new:
                    m["label"] = m["forest"].labels()
                yield out(np.concatenate([part["id"][y[lead]], m["id"][first[new]]]), np.concatenate([m["id"][first[lead]], m["id"][z[new]]]), None)

        for b in batches:
            key = np.stack([b.column(k).to_numpy() for k in ("at", "part", "turn", "role")])
            edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(b)]]) if len(b) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                own, rows = tuple(key[:3, s].tolist()), b.slice(s, e - s)
                if own != current:
                    if state is not None:
                        yield out(state["id"], None, state["found"])
                    current, members, state = own, [], None
                if key[3, s] == 0:
                    members.append(rows)
                else:
                    state = state or ready()
                    if state is not None:
                        yield from meet(columns(rows), state, own[0])
        if state is not None:
            yield out(state["id"], None, state["found"])

    return run


def class_links(classes: DataFrame, dim: int, probes: int | None = PROBES) -> DataFrame:
    """(a, b, n): of classes (id, n, x) of unequal vectors, links (a, b, null) that connect all near ones, and
    (a, null, n) with parts of the number of vectors that each is linked to. ``probes`` lists are looked into; for None there is only one."""
    count = classes.count()
    lists = 1 if probes is None else int(np.clip(round(count / LIST), 1, MAX_LISTS))
    rows = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
    quantiser = Quantiser.fit(unit(rows["x"].combine_chunks(), dim), lists)
    kind = classes.schema["x"].dataType.simpleString()
    entry = f"list int, id long, n long, x {kind}, probes array<int>, codes binary, error double"
    probed = min(probes or 1, lists)
    entries, _ = stage(classes.select("id", "n", "x").mapInArrow(_entries(quantiser, dim, probed), entry), "entries")
    asked = entries.select(F.explode("probes").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("asked"))
    sizes = (
        entries.groupBy(F.col("list").alias("at")).agg(F.count(F.lit(1)).alias("held")).join(asked, "at", "full")
        .select("at", F.ceil(F.coalesce("held", F.lit(1)) / MEMBERS).alias("parts"), F.ceil(F.coalesce("asked", F.lit(1)) / QUERIES).alias("turns"))
    )
    # every part of a list meets every turn of those that look into it
    members = (
        entries.withColumn("at", F.col("list")).join(sizes, "at").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).withColumn("role", F.lit(0))
    )
    queries = (
        entries.withColumn("at", F.explode("probes")).join(sizes, "at").withColumn("turn", F.pmod(F.xxhash64("id"), "turns"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("role", F.lit(1))
    )
    names = ["at", "part", "turn", "role", *NAMES]
    return (
        members.select(names).unionByName(queries.select(names)).repartition("at", "part", "turn")
        .sortWithinPartitions("at", "part", "turn", "role").mapInArrow(_links(quantiser, dim), "a long, b long, n long")
    )


def near_vectors(embeddings: DataFrame, probes: int | None = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector: links are cosines of 0.9 or more in double precision.

    Equal vectors form a class, which is compared once and counts as many links as it has members. ``component_id`` is
    the smallest vec_id reachable. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Components keep their precision: floats stay floats, anything else is
    taken as doubles. Each vector looks into the ``probes`` lists nearest to it; with None all are in one list, in parts of bounded
    size, so that no link is lost, at a cost that grows with the square of the table. The index is fitted to at most 16,384 classes chosen by a hash of
    the id, and holds all of them.

    Repeated rows count as vectors of their own and give repeated rows. Rows without a vec_id are left out: they could
    not be named. An empty table gives no rows. Other columns are not read.
    """
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.where("vec_id is not null").select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("x"))
    good = f"size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < {kind}('infinity')) and exists(x, v -> v <> 0)"
    classes, _ = stage(rows.where(good).groupBy("x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")
    dims = [r.dim for r in classes.select(F.size("x").alias("dim")).distinct().collect()]
    parts = [class_links(classes.where(F.size("x") == dim), dim, probes) for dim in dims]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found, _ = stage(found, "links")
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("found"))
    named = (
        classes.join(counts, F.col("id") == F.col("v"), "left").drop("v")
        .join(roots, F.col("id") == F.col("v"), "left").drop("v")
        .select("x", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    )
    return rows.join(named, "x", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"),
    )
