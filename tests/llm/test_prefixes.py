import hashlib
import random
import zlib

from skyloom.llm import prefixes
from skyloom.llm.prefixes import grafted, prefix_trie, turn_sequences

FIELDS = "conv_id long, turn long, role string, text string, depth string, ids long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, turns):
    return spark.createDataFrame([(*t, "d", 1) for t in turns], FIELDS)


def sequences(turns):
    out = {}
    for c, n, role, text in turns:
        if c is not None:
            out.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def graft(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(convs):
    members, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        parts = [below[k] for k in kids.get(path, [])]
        below[path] = (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))
    rows = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path))
        rows.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids.get(path, [])), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def nodes(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def random_turns(n, seed, longest=9):
    r = random.Random(seed)
    return [(c, k, r.choice("ua"), r.choice(["", "x", "yé", "zzz"])) for c in range(n) for k in range(r.randrange(1, longest))]


def odd_turns():
    turns = [(None, 0, "u", "x"), (1, None, None, None), (1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (5, 3, "u", "late")]
    # a long conversation, and ones that part from it late
    turns += [(300 + c, k, "u", f"t{k}" if k < 150 or not c else f"{c}-{k}") for c in range(4) for k in range(150 + 17 * c)]
    # thousands of copies, turnless ones after the graft, a prefix of another
    turns += [(1000 + c, k, "u", "copy") for c in range(2500) for k in range(2)]
    return turns + [(4000 + c, k, "u", "first") for c in range(300) for k in range(1 + c % 3)]


def test_against_plain_tries(spark, monkeypatch):
    for turns in (random_turns(300, 1), odd_turns(), random_turns(1, 3), random_turns(40, 2, 3)):
        df = table(spark, turns).repartition(3)
        assert nodes(prefix_trie(grafted(turn_sequences(df)))) == trie(graft(sequences(turns)))
    # every conversation is a shard of its own, the matrices are narrow, blocks of ids small
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 8)
    monkeypatch.setattr(prefixes, "BLOCK", 2)
    monkeypatch.setattr(prefixes, "TILE", 2)
    for turns in (random_turns(60, 4), random_turns(25, 5, 30)):
        assert nodes(prefix_trie(turn_sequences(table(spark, turns)))) == trie(sequences(turns))


def test_order_of_turns_and_empty_table(spark):
    turns = [(1, 2, "u", "c"), (1, 0, None, "a"), (1, 1, "a", None), (1, None, "u", "first"), (None, 0, "u", "x")]
    got = turn_sequences(table(spark, turns)).collect()
    assert [t.chars for t in got[0].turns] == [5, 1, 0, 1] and len(got) == 1
    assert prefix_trie(turn_sequences(table(spark, turns).limit(0))).count() == 0
