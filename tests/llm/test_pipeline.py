import importlib

import corpus_pipeline
from corpus_pipeline import STAGES, run
from tests.llm.test_packing import check
from tests.llm.test_repeats import brute, words_of
from tests.llm.test_simhash import components, print_of

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    fold = lambda t: " ".join(t.lower().split())
    for name, stage in STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(before) - set(after) <= {k for k, r in before.items() if sum(c.isalpha() for c in r.text) < 0.5 * len(r.text)}
            assert all(any(c.isalpha() for c in r.text) for r in after.values())
        elif name == "simhash_neardup":
            roots = components({k: print_of(r.text) for k, r in before.items()})
            assert set(after) == set(roots.values())
        elif name == "substring_dedup":
            for k, (words, gone) in brute([(k, r.text) for k, r in before.items()], 20, words_of).items():
                kept = " ".join(w for w, g in zip(words, gone) if not g)
                if not any(gone):
                    assert after[k] == before[k]
                elif kept:
                    assert after[k].text == kept and after[k].n_chars == len(kept)
                else:
                    assert k not in after
        elif name == "decontamination":
            held = {k for k, r in before.items() if any(fold(i) in fold(r.text) for i in items)}
            assert held and not held & set(after)
            assert len(before) - len(after) <= len(held) + 2
        else:
            check(docs.collect(), {k: r.text for k, r in before.items()})
            whole = run(spark, SMALL)
            key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            assert sum(r.length for r in whole.collect()) == sum(r.length for r in docs.collect())
            assert {(r.doc_id, r.doc_tokens) for r in whole.collect()} == {(r.doc_id, r.doc_tokens) for r in docs.select(*key).collect()}


def test_odd_rows(spark):
    docs = [(1, None, "en", 1), (2, "", None, None), (3, "the and of " * 30_000, None, 3), (None, "with the and of", "en", 4), (4, "the and words", "en", 5), (4, "the and words", "en", 5)]
    df = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, lang string, n_chars long, kept string, score double")
    for name, stage in STAGES:
        out = stage(spark, df, SMALL)
        assert out.count() > 0 and stage(spark, df.limit(0), SMALL).count() == 0
        if name != "packing":
            assert out.columns == df.columns


def test_entry_without_these_folders(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def gone(name, *args, **kwargs):
        if name == "corpus_pipeline" or name == "skyloom.llm":
            raise ModuleNotFoundError(name=name)
        return real(name, *args, **kwargs)

    assert "pipeline" in entry.queries()
    monkeypatch.setattr(builtins, "__import__", gone)
    assert not [k for k in importlib.reload(entry).queries() if k.startswith("op") or k == "pipeline"]
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(entry).queries()
    assert corpus_pipeline.ORACLE_SQL is None
