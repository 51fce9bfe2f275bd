import zlib

import numpy as np
import public_tokenizers
import pytest

from skyloom.llm.packing import pack
from skyloom.llm.queries import op3_packing

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    pieces = sorted((r.doc_id, r.start, r) for r in rows)
    covered = dict.fromkeys(ids, 0)
    for doc_id, start, r in pieces:
        assert start == covered[doc_id] and r.length > 0
        covered[doc_id] += r.length
        part = np.array(ids[doc_id][start : start + r.length], "<u4").tobytes()
        assert (zlib.crc32(part), len(ids[doc_id])) == (r.ids_crc32, r.doc_tokens)
    assert covered == {k: len(v) for k, v in ids.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or (end < 1024 and end & (end - 1) == 0)
    return sequences


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(op3_packing(spark, SMALL).collect(), texts)


@pytest.mark.parametrize("partitions", [1, 3])
def test_odd_texts(spark, partitions):
    texts = {
        1: None, 2: "", 3: " ", 4: "\n\n a\n b  c\t\x1cd\x85e ", 5: "it's <|endoftext|> we'll", 6: "x" * 70_000,
        7: "Zürich — été ’s 12,5 €　漢字", 8: "a b " * 3000,
    }
    docs = spark.createDataFrame([(k, t, t) for k, t in texts.items()], "doc_id long, text string, length string")
    check(pack(docs.repartition(partitions), PATH).collect(), texts)
    assert pack(docs.limit(0), PATH).count() == 0


def test_repeated_rows_and_null_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = pack(docs, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * 3
    assert sum(r.length for r in rows if r.doc_id is None) == 2


def test_ids_equal_the_tokenizers(monkeypatch):
    """Random strings of letters, signs and every kind of white space; also if all hashes collide."""
    import random

    import pyarrow as pa

    from skyloom.llm import packing

    ids = packing.TextIds(PATH)
    r = random.Random(5)
    some = "abcé'ßÀ×÷ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0   ​    　,.!\"#@[`{~019àĀſƀ中😀"
    texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(30_000)] + ["it's we'll I'd'", "a <|endoftext|> b", "", None]
    want = [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in ids.of(pa.array(texts))] == want
    monkeypatch.setattr(packing, "SLICE", 50)
    assert [g.tolist() for g in ids.of(pa.array(texts[:3000]))] == want[:3000]
    monkeypatch.setattr(packing, "SLICE", 1 << 20)
    monkeypatch.setattr(packing, "STEP", 1000)
    monkeypatch.setattr(packing, "WEIGHTS", np.zeros(4096, np.uint64))
    assert [g.tolist() for g in ids.of(pa.array(texts[:3000]))] == want[:3000]


def test_placing_keeps_the_sum_of_squares_smallest():
    import random

    from skyloom.llm.packing import Levels

    size, r = 32, random.Random(3)
    levels, counts = Levels(size), [0] * (size + 1)
    for n in range(3000):
        s = r.randrange(1, size)
        sums = {}
        for h in range(size - s + 1):
            if h == 0 or counts[h]:
                after = counts.copy()
                after[h] -= h > 0
                after[h + s] += 1
                sums[h] = sum(c * c for c in after[1:size])
        full = levels.place((n, s))
        now = [int(c) for c in levels.counts[: size]]
        moved = min(sums.values())
        assert sum(c * c for c in now[1:size]) == moved
        counts = [0, *now[1:], 0]
        assert full is None or sum(p[-1] for p in full) == size
