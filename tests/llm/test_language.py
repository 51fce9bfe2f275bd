import zlib

from skyloom.llm.language import fit, identify, language, recognised
from skyloom.llm.queries import op1_language_id

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score int, found string"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op1_language_id(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    docs = [(i, f"the and of number{i} with those words " * 5, "en") for i in range(40)]
    docs += [(i, f"der und die zahl{i} mit wörtern überall " * 5, "de") for i in range(40, 80)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 34 !", None), (None, "the words with those", None), (103, "the and of " * 50_000, "en"), (103, "the and of " * 50_000, "en")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs + odd], SCHEMA)
    net = fit(df)
    rows = {r.doc_id: r for r in identify(df, net).collect()}
    assert identify(df, net).count() == len(docs) + len(odd)
    assert [(rows[i].lang_pred, rows[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert rows[None].lang_pred == rows[103].lang_pred == "en" and rows[None].held_out is False
    assert recognised(df, net).columns == df.columns and recognised(df, net).count() == len(docs) + 3
    # the labels of held-out rows and other columns make no difference
    other = df.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'xx', lang) lang")
    assert {(r.doc_id, r.score) for r in identify(df, fit(other)).collect()} == {(k, r.score) for k, r in rows.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = fit(df)
    assert net is None and identify(df, net).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert one.select(language(one.text, None).alias("x")).first().x.lang == "und"
