import zlib

import numpy as np

from skyloom.llm.quality import FEATURES, boost, score, statistics
from skyloom.llm.queries import op7_quality

SMALL = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = op7_quality(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == q for _, p, q in held]) > 0.95
    good, bad = ([s for s, _, q in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_statistics():
    texts = [b"Aa bb BB. bb", b"", "é 1|#!\n".encode()]
    x = statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    row = dict(zip(FEATURES, x[0]))
    assert (row["share_upper"], row["share_stop"], row["distinct_words"], row["commonest_word"]) == (3 / 12, 1 / 12, 3 / 4, 2 / 4)
    assert row["upper_of_letters"] == 3 / 8 and row["bytes_per_word"] == 9 / 4 and not x[1].any()
    assert dict(zip(FEATURES, x[2]))["share_other"] == 2 / 8


def test_boosting_by_hand():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0.6)).astype(float)
    trees = boost(x[:3000], y[:3000])
    assert np.mean((trees.score(x[3000:]) > 0.5) == y[3000:]) > 0.97
    for row in x[:20]:  # one row at a time, node by node
        total = trees.base
        for f, limit, value in zip(trees.feature, trees.limit, trees.value):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > limit[i] else 1)
            total += value[i - len(f)]
        assert np.isclose(1 / (1 + np.exp(-total)), trees.score(row[None])[0])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "word " * 100_000), (None, "some text"), (4, "text"), (4, "text")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, None, 0), (3, 1, 0), (None, 1, 1), (4, 0, 0), (9, 1, 1)], "doc_id long, quality int, x int")
    rows = score(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score(df, labels.limit(0)).collect()} == {0.5}
    assert score(df.limit(0), labels).count() == 0
