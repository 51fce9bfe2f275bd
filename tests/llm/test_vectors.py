import numpy as np
import pytest

from skyloom.llm import vectors
from skyloom.llm.queries import op9_embedding_neardup

SMALL = "/root/testdata/sf0.1"


def brute(rows):
    """({vec_id: partners}, {vec_id: smallest reachable}) by all pairs."""
    good = {i: np.array(v, np.float64) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = {i: i for i, _ in rows}
    links = {i: set() for i, _ in rows}
    for k, i in enumerate(ids):
        links[i] = {ids[j] for j in np.flatnonzero(near[k])}
    moved = True
    while moved:
        moved = False
        for i in links:
            least = min([root[i], *(root[j] for j in links[i])])
            moved |= least != root[i]
            root[i] = least
    return links, root


def test_whole_table(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    links, root = brute(data)
    got = {r.vec_id: r for r in op9_embedding_neardup(spark, SMALL).collect()}
    assert set(got) == set(links)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * sum(map(len, links.values())) <= found <= sum(map(len, links.values()))
    assert np.mean([got[i].component_id == root[i] for i in root]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("sizes", [(2048, 16_384), (3, 5)])
def test_odd_rows(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "MEMBERS", sizes[0])
    monkeypatch.setattr(vectors, "QUERIES", sizes[1])
    monkeypatch.setattr(vectors, "LIST", 10)
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=20).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 7][1]) * (1 + i) + rnd.normal(size=20) * 0.1).astype(np.float32).tolist()) for i in range(40)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, None), (301, []), (302, [0.0] * 20), (303, [None] * 20), (304, [float("nan")] * 20), (305, [float("inf")] + [1.0] * 19), (306, [1.0] * 3), (307, [2.0] * 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n int, label string")
    links, root = brute([r for r in rows if r[0] < 306])
    links |= {306: {307}, 307: {306}}
    root |= {306: 306, 307: 306}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (len(links[i]), root[i]) for i, _ in rows}
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.near_vectors(df.where("vec_id = 302")).collect()[0].kept


def test_repeated_rows_and_null_id(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_vectors(df).collect()) == [(1, 1, 1, True)] * 2


def test_doubles_keep_their_precision(spark):
    """Components beyond or below what a float holds, and cosines that differ from 0.9 by less than a float can tell."""
    angle = np.arccos(0.9)
    rows = [(1, [1e300, 0.0]), (2, [2e300, 1e299]), (3, [1e-200, 0.0]), (4, [0.0, -1e-200])]
    rows += [(10 + i, [0.0, 0.0, float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate((0.0, angle - 1e-10, -angle - 1e-10, np.pi))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (0, 13)}


@pytest.mark.parametrize(("size", "count", "probes", "least"), [(10, 2500, 16, 980), (4, 3596, 16, 940), (10, 2500, None, 1000)])
def test_recall_with_more_lists_than_probes(spark, monkeypatch, size, count, probes, least):
    """Planted pairs of cosine 0.90 to 0.92 in 300 and in 1,024 lists, of which 16 are looked into; all of them are exact."""
    monkeypatch.setattr(vectors, "LIST", size)
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(count, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rnd.normal(size=(500, 64))
    side -= (side * x[:500]).sum(1, keepdims=True) * x[:500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rnd.uniform(0.901, 0.92, size=(500, 1))
    rows = list(enumerate(np.concatenate([x, cosine * x[:500] + np.sqrt(1 - cosine**2) * side]).astype(np.float32).tolist()))
    links, _ = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, probes).collect()}
    assert sum(map(len, links.values())) == 1000 and all(got[i] <= len(links[i]) for i in links)
    print("links found", sum(got.values()))
    assert sum(got.values()) >= least
