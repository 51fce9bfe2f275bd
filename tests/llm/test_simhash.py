import random
import re

import numpy as np
import pytest
import xxhash

from skyloom.llm import simhash
from skyloom.llm.queries import op6_simhash_neardup

SMALL = "/root/testdata/sf0.001"


def print_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Of {id: fingerprint}, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_code():
    near, wide, upper = simhash.golay()
    assert sorted(map(int.bit_count, near.tolist())) == [0] + [1] * 23 + [2] * 253 + [3] * 1771
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 23, 3000)
    keys = [set(k[k >= 0].tolist()) for k in simhash.neighbours(words)]
    assert {len(k) for k in keys} == {1, 6}
    for w, k in zip(words.tolist(), keys):
        a, b = rnd.integers(0, 23, 2).tolist()
        other = simhash.neighbours(np.array([w ^ (1 << a | 1 << b)]))[0]
        assert k & set(other[other >= 0].tolist())


@pytest.mark.parametrize("block", [4096, 8])
def test_links_of_random_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(3)
    prints = {}
    for i in range(300):
        fp = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 12 if i < 20 else 1])):
            prints[len(prints)] = fp
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                fp ^= 1 << b
    df = spark.createDataFrame([((v ^ 1 << 63) - (1 << 63),) for v in set(prints.values())], "fp long")
    from skyloom.llm.common import components as connect

    got = {r.v & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in connect(simhash.near_links(df)).collect()}
    want = components(prints)
    together = {}
    for i, fp in prints.items():
        together.setdefault(want[i], set()).add(got.get(fp, fp))
    assert all(len(v) == 1 for v in together.values()) and len({min(v) for v in together.values()}) == len(together)


def test_whole_table(spark):
    prints = {r.doc_id: print_of(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op6_simhash_neardup(spark, SMALL).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == components(prints)


def test_odd_rows(spark):
    docs = [(5, None), (3, ""), (9, " \n"), (7, "One"), (8, "one"), (8, "one"), (None, "one"), (1, "A b C d e"), (2, "w " * 60_000)]
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, fp int, root string")
    rows = simhash.near_groups(df).collect()
    prints = {i: print_of(t) for i, t in docs if i is not None}
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted([*components(prints).items(), (8, components(prints)[8])])
    assert simhash.near_groups(df.limit(0)).count() == 0
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, *components(prints).values()}
