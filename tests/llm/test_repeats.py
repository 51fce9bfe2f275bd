import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from zstandard import ZstdCompressor

from skyloom.llm import recurring, substring, suffixes
from skyloom.llm.queries import op5_substring_dedup, op8_suffix_dedup

SMALL = "/root/testdata/sf0.001"


def brute(docs, window, units_of):
    """{doc_id: (units, gone)} by a table of all windows."""
    first, units = {}, {}
    for doc_id, text in sorted(docs):
        u = units[doc_id] = units_of(text or "")
        for i in range(len(u) - window + 1):
            first.setdefault(tuple(u[i : i + window]), (doc_id, i))
    out = {}
    for doc_id, u in units.items():
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i : i + window])] < (doc_id, i):
                gone[i : i + window] = [True] * window
        out[doc_id] = (u, gone)
    return out


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def bytes_of(text):
    return text.encode()


def check_words(rows, docs):
    want = brute(docs, 20, words_of)
    assert len(rows) == len(docs)
    for r in rows:
        u, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(u), sum(gone)), r.doc_id
        assert r.kept == " ".join(w for w, g in zip(u, gone) if not g)


def check_bytes(rows, docs):
    want = brute(docs, 100, bytes_of)
    assert len(rows) == len(docs)
    for r in rows:
        u, gone = want[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(u), sum(gone)), r.doc_id
        assert r.n_spans == sum(g and not p for p, g in zip([False, *gone], gone))
        assert bytes(r.kept) == bytes(x for x, g in zip(u, gone) if not g)


def fixture():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "漢字", "x" * 90]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, other = line(60), line(31)
    docs = [(0, None), (1, ""), (2, "one two"), (3, "a " * 500), (4, "b" * 1000), (5, " \t\n"), (6, other)]
    for i in range(7, 60):
        k = rnd.randrange(0, 40)
        part = " ".join(passage.split()[k : k + rnd.randrange(15, 40)])
        docs.append((i, f"{line(rnd.randrange(0, 60))}\n{part}\t {line(5)} {other if i % 3 else ''} {line(rnd.randrange(0, 40))}"))
    docs += [(100 + i, docs[20][1]) for i in range(5)] + [(-1, docs[30][1]), (200, f"{passage} {passage}"), (201, line(30_000))]
    return docs


@pytest.mark.parametrize("hot", [False, True])
def test_small(spark, monkeypatch, hot):
    docs = fixture()
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, key string, start long")
    if hot:  # every anchor counts as hot
        monkeypatch.setattr(recurring, "HOT_BYTES", 0)
    check_words(substring.remove_passages(df).collect(), docs)
    check_bytes(suffixes.remove_strings(df).collect(), docs)


def test_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {d: (len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for d, (u, g) in brute(docs, 20, words_of).items()}
    assert {r.doc_id: tuple(r)[1:] for r in op5_substring_dedup(spark, SMALL).collect()} == want
    want = {d: (len(u), sum(g), hashlib.sha256(bytes(w for w, x in zip(u, g) if not x)).hexdigest()) for d, (u, g) in brute(docs, 100, bytes_of).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in op8_suffix_dedup(spark, SMALL).collect()} == want


def test_empty_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    for f, n in ((substring.remove_passages, 40), (suffixes.remove_strings, len(text))):
        assert f(df.limit(0)).count() == 0
        assert sorted((r.doc_id or 0, r.n_removed) for r in f(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, n)]


@pytest.mark.parametrize("spread", [0, 2000])
def test_spread_anchors(spark, monkeypatch, spread):
    """Anchors that are hot in all batches, and in some batches only."""
    docs = fixture()
    rnd = random.Random(6)
    line = "a line of some length that stands in many documents " * 3
    docs += [(1000 + i, f"{rnd.random()} {line}{rnd.random()}" if i % 3 < 1 or i < 60 else f"{rnd.random()}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(4, "doc_id")
    monkeypatch.setattr(recurring, "SPREAD_BYTES", spread)
    check_words(substring.remove_passages(df).collect(), docs)
    check_bytes(suffixes.remove_strings(df).collect(), docs)


def stretches_of_one_anchor(n):
    rnd = random.Random(7)
    pieces = [rnd.randbytes(165) for _ in range(n)]
    return pa.RecordBatch.from_arrays(
        [pa.array([5] * n), pa.array(range(n)), pa.array([0] * n), pa.array([66] * n), pa.array(pieces, pa.binary())],
        ["key", "doc_id", "start", "n", "piece"],
    )


def test_hot_anchors_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(recurring, "HOT_BYTES", 1 << 20)
    out = list(recurring._shards(suffixes.UNITS)(iter([stretches_of_one_anchor(10_000)])))
    assert max(len(b) for b in out) <= 60_000
    windows = list(recurring._windows(suffixes.UNITS)(iter(out)))
    assert max(len(b) for b in windows) <= 60_000
    assert sum(len(b) for b in windows) == 660_000


def test_a_common_line_is_spread_before_the_shuffle():
    rnd = random.Random(8)
    line = bytes(rnd.choices(b"abcdefgh ", k=60))
    texts = [bytes(rnd.choices(b"abcdefgh ", k=100)) + line + bytes(rnd.choices(b"abcdefgh ", k=100)) for _ in range(2000)]
    packed = pa.array([ZstdCompressor().compress(t) for t in texts], pa.binary())
    found = pa.array([[{"key": 9, "place": 80 * recurring.PLACE + 60}]] * 2000, pa.list_(pa.struct({"key": pa.int64(), "place": pa.int64()})))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), packed, found], ["doc_id", "text", "found"])
    rows = [r for b in recurring._pieces(suffixes.UNITS)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert sum(r["doc_id"] is not None and r["n"] < 0 for r in rows) == 2000


@pytest.mark.parametrize("run", [1, 40, suffixes.RUN])
@pytest.mark.parametrize("window", [8, 13, 100])
def test_refined_buckets_against_a_table_of_windows(monkeypatch, run, window):
    monkeypatch.setattr(suffixes, "RUN", run)
    rnd = random.Random(window)
    for letters in ["a", "ab", "\0a", "abcdefghijklmnop"]:
        known = "".join(rnd.choice(letters) for _ in range(300))
        pieces = ["", "a", known[:40] * 6, known[:150], known[100:], known, known[::-1], "a" * 230, "\0" * 130]
        for _ in range(8):
            k = rnd.randrange(200)
            pieces.append("".join(rnd.choice(letters) for _ in range(rnd.randrange(90))) + known[k : k + rnd.randrange(140)])
        rnd.shuffle(pieces)
        data = "".join(pieces).encode()
        left = np.array([len(p) - i for p in pieces for i in range(len(p))])
        want = {}
        for i, n in enumerate(left.tolist()):
            if n >= window:
                want.setdefault(data[i : i + window], []).append(i)
        got = {}
        for at, group in zip(*(x.tolist() for x in suffixes.refine(np.frombuffer(data, np.uint8), left, window)), strict=True):
            got.setdefault(group, []).append(at)
        assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)
    none = suffixes.refine(np.zeros(0, np.uint8), np.zeros(0, np.int64), window)
    assert [len(x) for x in none] == [0, 0]
