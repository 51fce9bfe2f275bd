"""Stores of submissions: whole commits or none, and look-ups that read the files of their ids."""

import pytest
from pyspark.sql import functions as F

from skyloom.sources import snapshots, submissions


def rows_of(df, *names):
    return sorted(df.select(*names).collect(), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "upload_id string, n long, year int, month int")


def test_replaced_ids_move_and_others_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "store")
    first = table(spark, [("a", 1, 2026, 1), ("a", 2, 2026, 1), ("b", 3, 2026, 1), ("c", 4, 2026, 2), (None, 5, 2026, 2)])
    assert snapshots.commit(spark, root, {"t": first}) == 1
    before = snapshots._state(spark, root)[1]["tables"]["t"]["parts"]
    # b moves to a third month, d joins the second, a row without an id is added
    assert snapshots.commit(spark, root, {"t": table(spark, [("b", 6, 2026, 3), ("d", 7, 2026, 2), (None, 8, 2026, 2)])}) == 2
    after = snapshots._state(spark, root)[1]["tables"]["t"]["parts"]
    assert set(before["year=2026/month=2"]) < set(after["year=2026/month=2"])  # nothing replaced: not rewritten
    assert not set(before["year=2026/month=1"]) & set(after["year=2026/month=1"])
    want = [(None, 5, 2), (None, 8, 2), ("a", 1, 1), ("a", 2, 1), ("b", 6, 3), ("c", 4, 2), ("d", 7, 2)]
    assert rows_of(snapshots.read(spark, root, "t"), "upload_id", "n", "month") == sorted(want, key=lambda r: repr(spark_row(r)))
    assert rows_of(snapshots.read(spark, root, "t", 1), "upload_id", "n", "year", "month") == rows_of(first, "upload_id", "n", "year", "month")
    # a month whose only submission leaves is gone
    snapshots.commit(spark, root, {"t": table(spark, [("b", 9, 2026, 1)])})
    assert "year=2026/month=3" not in snapshots._state(spark, root)[1]["tables"]["t"]["parts"]
    assert rows_of(snapshots.of_ids(spark, root, "t", ["b"]), "n", "month") == [(9, 1)]
    assert rows_of(snapshots.of_ids(spark, root, "t", ["b"], 2), "n", "month") == [(6, 3)]


def spark_row(values):
    from pyspark.sql import Row

    return Row(upload_id=values[0], n=values[1], month=values[2])


@pytest.mark.parametrize("lost_in", ["_publish", "_leaves"])
def test_a_lost_job_changes_nothing(spark, tmp_path, monkeypatch, lost_in):
    root = str(tmp_path / "store")
    old = table(spark, [("a", 1, 2026, 1), ("b", 2, 2026, 1)])
    snapshots.commit(spark, root, {"t": old, "u": old})

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, lost_in, lost)
        with pytest.raises(RuntimeError, match="lost"):
            snapshots.commit(spark, root, {"t": table(spark, [("a", 9, 2026, 1)]), "u": table(spark, [("c", 9, 2026, 1)])})
    for name in "tu":
        assert rows_of(snapshots.read(spark, root, name), "upload_id", "n") == [("a", 1), ("b", 2)]
    assert snapshots.clean(spark, root) >= 1  # what the lost job left
    assert snapshots.commit(spark, root, {"t": table(spark, [("a", 9, 2026, 1)])}) == 2
    assert rows_of(snapshots.read(spark, root, "t"), "upload_id", "n") == [("a", 9), ("b", 2)]
    assert rows_of(snapshots.read(spark, root, "u"), "upload_id", "n") == [("a", 1), ("b", 2)]


def test_of_two_commits_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    snapshots.commit(spark, root, {"t": table(spark, [("a", 1, 2026, 1)])})
    real = snapshots._publish

    def late(spark, root, version, content):
        real(spark, root, version, {"tables": snapshots._state(spark, root)[1]["tables"]})  # another one was faster
        real(spark, root, version, content)

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_publish", late)
        with pytest.raises(Exception, match="(?i)exist"):
            snapshots.commit(spark, root, {"t": table(spark, [("a", 2, 2026, 1)])})
    assert rows_of(snapshots.read(spark, root, "t"), "n") == [(1,)]


def test_a_look_up_reads_as_many_files_in_a_large_table(spark, tmp_path):
    root, counts = str(tmp_path / "store"), []
    for year in (2024, 2025, 2026):
        rows = spark.range(3000).selectExpr(
            f"concat('u{year}-', id % 60) as upload_id", "id as n", f"{year} as year", "cast(id % 60 % 12 + 1 as int) as month"
        )
        snapshots.commit(spark, root, {"t": rows})
        found = snapshots.of_ids(spark, root, "t", ["u2024-7"])
        assert rows_of(found, "n") == [(n,) for n in sorted((7 + 60 * k for k in range(50)), key=lambda n: repr(spark_n(n)))]
        counts.append((len(found.inputFiles()), len(snapshots.read(spark, root, "t").inputFiles())))
    few, all_files = zip(*counts)
    assert len(set(few)) == 1 and few[0] <= 2
    assert all_files[0] < all_files[1] < all_files[2]
    index = snapshots.read(spark, root, snapshots.INDEX)
    one = index.where(F.col("bucket") == index.where("id = 'u2024-7'").first()["bucket"])
    assert one.inputFiles() and len({f.rsplit("/", 2)[-2] for f in index.inputFiles()}) > 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def spark_n(n):
    from pyspark.sql import Row

    return Row(n=n)


def test_odd_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    assert snapshots.versions(spark, root) == []
    with pytest.raises(ValueError, match="no table"):
        snapshots.read(spark, root, "t")
    empty = table(spark, [])
    snapshots.commit(spark, root, {"t": empty})
    assert snapshots.read(spark, root, "t").count() == 0 and snapshots.of_ids(spark, root, "t", ["a"]).count() == 0
    # a column that comes later is null in older rows, and one left out in newer rows; names of the index clash with nothing
    wide = spark.createDataFrame([("a", 1, "x", 2026, 1)], "upload_id string, n long, part string, year int, month int")
    snapshots.commit(spark, root, {"t": table(spark, [("b", 2, 2026, 1)])})
    snapshots.commit(spark, root, {"t": wide})
    snapshots.commit(spark, root, {"t": table(spark, [("c", 3, 2026, 1)])})
    assert {tuple(r) for r in snapshots.read(spark, root, "t").select("upload_id", "part").collect()} == {("a", "x"), ("b", None), ("c", None)}
    assert snapshots.of_ids(spark, root, "t", []).count() == 0
    # whole numbers take the stored type, other kinds are refused
    snapshots.commit(spark, root, {"t": table(spark, [("b", 2, 2026, 1)]).withColumn("n", F.col("n").cast("int"))})
    with pytest.raises(ValueError, match="stored as bigint"):
        snapshots.commit(spark, root, {"t": table(spark, [("b", 2, 2026, 1)]).withColumn("n", F.lit(1.5))})
    # an empty commit leaves all as it is
    snapshots.commit(spark, root, {"t": empty})
    assert snapshots.read(spark, root, "t").count() == 3
    with pytest.raises(ValueError, match="index"):
        snapshots.commit(spark, root, {snapshots.INDEX: empty})
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, root, "t", 99)
    assert snapshots.clean(spark, root, keep=1) > 0
    assert snapshots.read(spark, root, "t").count() == 3 and len(snapshots.versions(spark, root)) == 1


def test_submissions_in_a_store(spark, tmp_path):
    root = str(tmp_path / "store")
    subs = spark.sql("select 'u' || id as upload_id, timestamp'2026-01-05' + make_interval(0, cast(id as int)) as upload_at from range(3)")
    psl = spark.sql("select 'u' || id as upload_id, id as n from range(3)")
    submissions.save_submissions({"psl": psl}, subs, root, versioned=True)
    submissions.save_submissions({"psl": psl.where("n = 1").withColumn("n", F.lit(10))}, subs.where("upload_id = 'u1'"), root, versioned=True)
    assert rows_of(snapshots.read(spark, root, "psl"), "upload_id", "n") == [("u0", 0), ("u1", 10), ("u2", 2)]
    assert snapshots.read(spark, root, "submissions").count() == 3
    tac = snapshots.read(spark, root, "psl").withColumn("n", F.col("n") + 1)
    submissions.save_allocation(tac, tac, root, versioned=True)
    assert snapshots.versions(spark, root) == [1, 2, 3]
    assert rows_of(snapshots.of_ids(spark, root, "tac_ppc", ["u1", "u2"]), "n") == [(11,), (3,)]
