import random

import numpy as np

from skyloom.llm.decontaminate import FOLD, Index, align, leaks, without_leaks
from skyloom.llm.queries import op4_decontamination

SMALL = "/root/testdata/sf0.01"


def fold(text):
    return FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes()


def edits(passage, text):
    """Least edits of the passage against any part of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_exact_passages_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in op4_decontamination(spark, SMALL).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if fold(i.text) in fold(d.text)}
    assert exact and exact <= got
    for doc_id, item_id in got - exact:  # near ones are within their budget
        text, item = (next(fold(x.text) for x in t if x[0] == k) for t, k in ((docs, doc_id), (items, item_id)))
        parts = {item[min(a, max(0, len(item) - 200)) :][:200] for a in range(0, len(item), 200)}
        assert any(edits(p, text) <= len(p) // 20 for p in parts)


def test_edits_against_the_full_table():
    rnd = random.Random(2)
    letters = "abcdefgh "
    item = "".join(rnd.choice(letters) for _ in range(150))
    index = Index.of([(7, item)])
    for n in [0, 1, 3, 6, 7, 9, 20] * 4:
        text = list(item)
        for _ in range(n):
            k = rnd.randrange(len(text))
            text[k : k + 1] = rnd.choice([[], [rnd.choice(letters)], [text[k], "x"]])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(300))) + "".join(text) + "yes" * rnd.randrange(9)
        data = np.frombuffer(text.encode(), np.uint8)
        found = [p for _, places in index.search(data, np.array([0, len(data)])) for p in places]
        least = edits(item, text)
        assert bool(found) == (least <= 7)
        assert not found or min(e for *_, e in found) == least
        for _, a, z, e in found:
            assert edits(item, text[a:z]) <= e
    assert align(np.zeros(5, np.uint8), np.zeros(0, np.uint8), 10, 3, None) is None


def test_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away."
    docs = [(1, None), (2, ""), (3, "clean text " * 20_000), (4, "x " * 9000 + item.replace(" ", "\n").upper() + " y"), (None, item), (5, item), (5, item), (6, "short")]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, item_id string, edits int")
    bench = spark.createDataFrame([(1, None), (2, "short"), (3, item), (4, item), (None, item + "!" * 30)], "item_id long, text string")
    rows = leaks(df, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 3), (0, 4), (4, 3), (4, 4), (5, 3), (5, 3), (5, 4), (5, 4)]
    assert all((r.start, r.end, r.edits) == ((18_000, 18_000 + len(item), 0) if r.doc_id == 4 else (0, len(item), 0)) for r in rows)
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    assert leaks(df, bench.limit(0)).count() == leaks(df.limit(0), bench).count() == 0
    assert without_leaks(df, bench.limit(0)).count() == len(docs)


def quoted(rnd, quote):
    """A text of other letters around a quote, at any place."""
    return "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(300))) + "\n" + quote + "\n" + "7" * rnd.randrange(50)


def found_in(index, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return [p for _, places in index.search(data, np.array([0, len(data)])) for p in places]


def test_partial_quotes_at_any_place():
    rnd = random.Random(4)
    for size in [124, 130, 151, 200, 233, 900] * 4:
        item = "".join(rnd.choice("abcdefgh ") for _ in range(size))
        index = Index.of([(7, item)])
        for n in {124, 150, size * 9 // 10, size * 8 // 10}:
            if 124 <= n <= size:
                a = rnd.randrange(size - n + 1)
                text = quoted(rnd, item[a : a + n])
                places = found_in(index, text)
                assert places, (size, n, a)
                for p, start, end, e in places:
                    assert edits(index.passages[p].tobytes(), fold(text)[start:end]) <= e <= len(index.passages[p]) // 20
        text = list(item)
        text[size // 2] = "x"
        assert {e for *_, e in found_in(index, "".join(text))} <= {0, 1}
        assert not found_in(index, quoted(rnd, item[:90]))
    # a whole item counts once for each longer passage, its short passages do not
    assert len(found_in(Index.of([(7, item)]), item)) == 5


def test_short_items_verbatim_at_word_bounds():
    index = Index.of([(1, "What is a quokka?"), (2, "blue whale songs"), (3, "tiny")])
    assert {index.item[p] for p, *_ in found_in(index, "Q: what is\ta Quokka? A: no. Blue whale songs, tiny")} == {1, 2}
    assert not found_in(index, "what is a quokkas? blue whale songster xblue whale songs what is a quoka?")
    assert [s for _, s, *_ in found_in(index, "xblue whale songs blue whale songs")] == [18]
