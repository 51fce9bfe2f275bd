import hashlib
import math
import re
import zlib
from collections import Counter

from skyloom.llm.resampling import crcs, drawn, resample, span_patterns

FIELDS = "doc_id long, text string, rank string, weight string"


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, longest, buckets, least, percent):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(place(g) for x in texts for g in grams(x, longest)) for texts in ([d[1] for d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found = grams(text, longest)
        weight = sum(gain[place(g)] for g in found)
        rows.append((i, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=str)


DOCS = [(i, " ".join(f"W{(i * j) % 37}é,b{j % (i % 9 + 1)}" for j in range(i % 60))) for i in range(400)]
ODD = [(None, None), (None, "x " * 30), (7, ""), (7, "..."), (8, "same text " * 15), (8, "same text " * 15), (9, "ÀÉ ß_word" * 9000), (10, "A-B_c'd\x00e 1２"), (11, "x y " * 200_000)]
TARGET = ["w1é b0 w5é", "b1 b2 b3 W7É", None, "", "same text"]


def test_against_a_plain_computation(spark):
    for longest, buckets, least, percent in ((1, 10_000, 20, 10), (3, 64, 5, 50), (2, 100_000, 1, 100)):
        docs = spark.createDataFrame([(*d, "r", "w") for d in DOCS + ODD], FIELDS).repartition(3)
        target = spark.createDataFrame([(t,) for t in TARGET], "text string")
        got = sorted(map(tuple, resample(docs, target, longest, buckets, least, percent).collect()), key=str)
        assert got == by_hand(DOCS + ODD, TARGET, longest, buckets, least, percent)


def test_spans():
    for text in ("", " ", "a", "Hello,  wörld! it's x2", "--a--b--", "é é"):
        found = crcs(text.encode(), span_patterns(4))
        for n in range(1, 5):
            w = words(text)
            assert list(found[n - 1]) == [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]


def test_empty_tables_and_drawn_rows(spark):
    docs = spark.createDataFrame([(*d, "r", "w") for d in DOCS], FIELDS)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert resample(docs.limit(0), target).count() == 0
    scored = resample(docs, target.limit(0))
    n = scored.where("rank is not null").count()
    assert n == sum(len(words(t)) >= 20 for _, t in DOCS) // 10
    rows = drawn(docs, scored).collect()
    assert len(rows) == n and rows[0].asDict().keys() == {"doc_id", "text", "rank", "weight"}
