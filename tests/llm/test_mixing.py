import math
import re
from collections import defaultdict

from skyloom.llm.mixing import allocate, mix
from skyloom.llm.oracles import MIX

FIELDS = "doc_id long, text string, source string, size string, origin long, target string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, s, "x", 7, "y") for i, t, s in data], FIELDS)


def words(text):
    return re.findall("[^ \t-\r]+", text or "")


def poured(total, parties):
    """{name: share} by repeated sharing; parties: name -> (weight, cap)."""
    out, left = {}, dict(parties)
    while left:
        level = (total - sum(out.values())) / sum(w for w, _ in left.values())
        over = [k for k, (w, c) in left.items() if w * level > c]
        if not over:
            return out | {k: w * level for k, (w, _) in left.items()}
        for k in over:
            out[k] = float(left.pop(k)[1])
    return out


def test_targets_and_copies(spark):
    data = [(100 * s + i, " ".join(["w"] * (1 + (7 * i * (s + 1)) % 40)), f"s{s}") for s in range(7) for i in range(30 - 4 * s)]
    data += [(5000 + i, "a b c", None) for i in range(10)] + [(6000, None, "empty"), (6001, " \n", "empty"), (6002, "long " * 30_000, "s3")]
    got = allocate(rows(spark, data)).collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    live = {s: ([5, 2, 1][i % 3], 2 * sizes[s]) for i, s in enumerate(order)}
    want = poured(1.5 * sum(sizes.values()), live)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.size <= r.source_size and 0 <= r.taken <= 2 * r.size and r.taken == r.whole * r.size + r.extra
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes if s is not None)
    # equal texts of one size have keys of their own, as their ids differ
    assert abs(taken[None] - want[None]) <= 1
    texts = mix(rows(spark, data)).collect()
    assert sum(len(words(r.text)) for r in texts) == sum(taken.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, allocate(rows(spark, data[::-1]).repartition(5)).collect()), key=str)


def test_repeated_and_odd_rows(spark):
    data = [(None, "same words here", "a")] * 40 + [(1, "same words here", "a")] * 40 + [(2, "one two", "b")] * 9 + [(None, None, None), (3, "", "a")]
    got = allocate(rows(spark, data)).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for s, part in by.items():
        # rows that nothing tells apart share the last place, a whole number of words each
        assert abs(sum(r.taken for r in part) - part[0].target) <= len(part)
    assert allocate(rows(spark, data).limit(0)).count() == 0
    assert allocate(rows(spark, [(1, None, None)])).collect()[0].target == 0


def test_inclusion_follows_the_odds(spark):
    """Over many documents of two sizes the share that gets a copy is proportional to their importance."""
    data = [(i, "w " * (3 if i % 2 else 60), "a") for i in range(4000)] + [(9000 + i, "w " * 100, "b") for i in range(4000)]
    got = allocate(rows(spark, data), weights=(1, 9), share=0.5).where("source = 'a'").collect()
    share = {n: sum(r.taken > 0 for r in got if r.size == n) / 2000 for n in (3, 60)}
    assert abs(share[60] / share[3] - 3) < 0.4  # 6 binary digits against 2


def test_sql_of_odd_rows(spark):
    import duckdb

    data = [(i, "word " * (i % 50), None if i % 3 == 0 else f"s{i % 4}") for i in range(300)] + [(None, "a b", "s1")] * 5
    df = rows(spark, data)
    got = allocate(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", data)
    want = con.sql(f"select doc_id, source, size, source_size, target, taken from ({MIX})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
