import duckdb

from skyloom.llm.oracles import ORACLES
from skyloom.llm.preferences import branched_replies, conversations_of, format_pairs
from skyloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def text_of(turns):
    return "".join(f"<|{r}|>{t}<|end|>\n" for r, t in turns)


def by_hand(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    masks = []
    for side in (a[n:], b[n:]):
        at, mask = 0, []
        for role, text in side:
            end = at + len(text_of([(role, text)]))
            mask += [(at + len(role) + 4, end)] if role == "assistant" else []
            at = end
        masks.append(mask)
    return (n, text_of(a[:n]), text_of(a[n:]), text_of(b[n:]), *masks)


def test_pairs(spark):
    u, a, s = ("user", "hi\n"), ("assistant", "héllo"), ("system", "")
    pairs = [(1, [s, u, a], [s, u, ("assistant", "no")]), (2, [u, a], [u, a]), (3, [u], [u, a, u, a]), (4, [], [u, a]), (5, [u, a, u, a, s], [u, ("assistant", ""), u, a]), (6, [a] * 300, [a] * 299 + [u]), (None, [u, a], [a, u])]
    rows = [(k, x, y, "n") for k, x, y in pairs]
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(rows + [(7, None, [u], "n"), (5, *pairs[4][1:], "n")], f"pair_id long, chosen {turns}, rejected {turns}, prompt string")
    got = format_pairs(df).collect()
    assert len(got) == len(pairs) + 2
    want = {k: by_hand(x, y) for k, x, y in pairs} | {7: by_hand([], [u])}
    for r in got:
        assert (r.n_common, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask], [tuple(m) for m in r.rejected_mask]) == want[r.pair_id]
        assert all(r.chosen[m.start : m.end].endswith("<|end|>\n") for m in r.chosen_mask)
    assert format_pairs(df.limit(0)).count() == 0


def test_turns_in_order(spark):
    rows = [(1, 2, "user", "c"), (1, 0, None, "a"), (1, 1, "assistant", None), (1, 0, None, "a"), (None, 0, "user", "x"), (2, None, "user", "y")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in conversations_of(df).collect()}
    assert got == {1: [("", "a"), ("", "a"), ("assistant", ""), ("user", "c")], 2: [("user", "y")]}


def test_branches(spark):
    u, a, b, v = ("user", "hi"), ("assistant", "one"), ("assistant", "two"), ("user", "more")
    talks = {-1: [u, a, v, b], 0: [u, a, v, b], 1: [u, a, v, b], 2: [u, v], 3: [], 4: [a], 5: [u, b, v], 1000: [u, a, u], 1999: [u, a, u]}
    df = spark.createDataFrame([(c, t, 0) for c, t in talks.items()], "conv_id long, turns array<struct<role:string,text:string>>, chosen int")

    def before(c):
        at = [i for i, t in enumerate(talks[c]) if t[0] == "assistant"]
        return at[c % len(at)] if at else len(talks[c])

    got = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in branched_replies(df).collect()}
    follows = {-1: -1, 0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 0, 1000: 1999, 1999: 1000}
    assert got == {c: (talks[c], talks[c][: before(c)] + talks[o][before(o) :]) for c, o in follows.items()}
    assert branched_replies(df.limit(0)).count() == 0


def test_pairs_of_the_table_part_at_all_depths_and_lose_no_turn(spark):
    talks = conversations_of(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    rows = {r.pair_id: r for r in QUERIES["op2_preference_format"](spark, SMALL).collect()}
    assert len({r.n_common for r in rows.values()}) > 3
    assert any("<|user|>" in r.chosen and r.chosen_spans for r in rows.values()) and any("," in r.rejected_spans for r in rows.values())
    assert {r.conv_id: text_of(r.turns) for r in talks.collect()} == {k: r.prompt + r.chosen for k, r in rows.items()}


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SMALL)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, con.sql(f"select {', '.join(names)} from ({sql})").fetchall()))
