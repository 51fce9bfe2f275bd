"""Loading from and writing to files: round trips on temporary folders."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from skyloom.operators import catalog, flux, registry, reports
from skyloom.plans import validation
from skyloom.sources import lists, submissions, textfiles
from skyloom.sources.textfiles import read_lines, records

HEAD = "obj_id,ob_code,ra,dec,priority,exptime,resolution,reference_arm,comment,g_ps1,g_hsc,g_hsc_error,tract\n"


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_target_csv(spark, tmp_path):
    write(tmp_path, "good.csv", "# a comment line\n" + HEAD
          + '9223372036854775807,ob_1,10.5,-3,1,900,L,b,"a ""#"" sign, quoted",,100,10,None\n'
          + "2,ob_2,11.5,NaN,2,1800,M,m,plain,200,300,,12 # tail, with a comma\n\n")
    write(tmp_path, "float.csv", HEAD + "1,ob_1,10,0,3.0,900,L,b,,1,1,1,1\n")
    write(tmp_path, "empty.csv", HEAD + "1,ob_1,10,0,,900,L,b,,1,1,1,1\n")
    write(tmp_path, "big.csv", HEAD + "1,ob_0,10,0,1,900,L,b,,1,1,1,1\n9223372036854775808,ob_1,10,0,1,900,L,b,,1,1,1,1\n")
    write(tmp_path, "word.csv", HEAD + "1,ob_1,ten,0,1,900,L,b,,1,1,1,1\n")
    write(tmp_path, "list.txt", HEAD + "1,ob_1,10,0,1,900,L,b,,1,1,1,1\n")
    targets, report = lists.load_targets(spark, str(tmp_path))
    status = {r.upload_id.split("/")[-1]: r for r in report.collect()}
    assert {k: r.status for k, r in status.items()} == {
        "good.csv": True, "float.csv": False, "empty.csv": False, "big.csv": False, "word.csv": False, "list.txt": False,
    }
    assert status["float.csv"].error == "not an integer: 3.0"
    assert status["big.csv"].n_errors == 1 and status["list.txt"].error == "neither CSV nor ECSV"
    a, b = targets.orderBy("row_id").collect()
    assert (a.obj_id, a.ob_code, a.dec, a.priority, a.tract) == (9223372036854775807, "ob_1", -3.0, 1, None)
    assert "extras" in targets.columns and b.dec is None and b.tract == 12 and b.g_hsc_error is None
    resolved = flux.resolve_flux(targets, "header").orderBy("row_id").collect()
    assert [(r.filter_g, r.flux_g) for r in resolved] == [("g_hsc", 100.0), ("g_ps1", 200.0)]
    v = validation.validate(targets, dt.date(2026, 2, 1), dt.date(2026, 2, 3), header="header")
    assert v.status.first().status_str and not v.status.first().status_values  # a missing declination


def test_strict_tract(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "1,ob_1,10,0,1,900,L,b,,1,1,1,\n")
    assert lists.load_targets(spark, str(tmp_path))[1].first().status
    assert not lists.load_targets(spark, str(tmp_path), strict=True)[1].first().status


def test_missing_column_is_reported(spark, tmp_path):
    # no reference_arm, a comment column
    write(tmp_path, "example.csv", "obj_id,ob_code,ra,dec,priority,exptime,resolution,comment,g_hsc,g_hsc_error\n"
          "11,red_a,201.5,12.25,1,2700,L,,10,\n12,red_b,202.5,12.5,2,2700,L,,20,2\n"
          "13,blue_a,203.125,-1.75,3,1800,L,,30,3\n14,blue_b,10.0625,-2.5,9,1800,M,,40,4\n"
          "15,blue_c,77,81,9,1800,M,,50,\n")
    targets, report = lists.load_targets(spark, str(tmp_path))
    assert report.first().status and targets.count() == 5
    v = validation.validate(targets, dt.date(2026, 2, 1), dt.date(2026, 7, 31), header="header")
    first = v.report.where("check = 'required_columns'").first()
    assert (first.severity, first.detail) == ("error", "reference_arm")
    assert v.status.first().label == "failed"


def test_row_ids_follow_a_split_file(spark, tmp_path):
    path = write(tmp_path, "long.csv", "".join(f"line{i}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in sorted(rows, key=lambda r: r.row_id)] == [f"line{i}" for i in range(20000)]
    assert len({r.row_id for r in rows}) == 20000


def joined_by_hand(lines):
    """(first line's number, text, unclosed) of the records of a file, a character at a time."""
    out, open_at, now = [], None, []
    for n, line in enumerate(lines):
        inside, hidden = open_at is not None, False
        for c in line:
            if c == '"' and not hidden:
                inside = not inside
            hidden |= c == "#" and not inside
        start = open_at if open_at is not None else n
        now.append(line)
        if inside:
            open_at = start
        else:
            out.append((start, "\n".join(now), False))
            open_at, now = None, []
    return out + ([(open_at, now[0], True)] if now else [])


def test_records_over_lines_and_blocks(spark, tmp_path):
    r = random.Random(8)
    files = {f"f{i}": ["".join(r.choice('ab,"# ') for _ in range(r.randrange(6))) for _ in range(40 + 30 * i)] for i in range(8)} | {"plain": ["a,b", "1,2"], "long": ['x,"y'] + ["z"] * 50 + ['"']}
    rows = [(f, 1, n, line) for f, lines in files.items() for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "path string, file_size long, row_id long, line string").repartition(3)
    for block in (1, 7, 1000):
        got = {}
        for x in records(df, block).collect():
            got.setdefault(x.path, []).append((x.row_id, x.line, x._unclosed))
        assert {f: sorted(v) for f, v in got.items()} == {f: joined_by_hand(lines) for f, lines in files.items()}
    # a file in many splits, and one whose quote is never closed
    text = HEAD.replace("\n", "\n") + "".join(f'{i},ob_{i},10,0,1,900,L,b,"note{chr(10) * (i % 3)} # {i}",1,1,1,1\n' for i in range(900))
    write(tmp_path, "many.csv", text)
    write(tmp_path, "bad.csv", HEAD + '1,ob_1,10,0,1,900,L,b,"x,1,1,1,1\n2,ob_2,10,0,1,900,L,b,,1,1,1,1\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        targets, report = lists.load_targets(spark, str(tmp_path))
        status = {x.upload_id.split("/")[-1]: (x.status, x.error, x.n_rows) for x in report.collect()}
        assert status == {"many.csv": (True, None, 900), "bad.csv": (False, "a quote is not closed", 1)}
        assert {x.ob_code for x in targets.collect()} == {f"ob_{i}" for i in range(900)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pointing_list(spark, tmp_path):
    write(tmp_path, "full.csv", "ppc_code,ppc_ra,ppc_dec,ppc_pa,ppc_resolution,ppc_priority\nField_7,120.25,-8.5,0.0,L,0.0\n")
    write(tmp_path, "short.csv", "ppc_ra,ppc_dec,ppc_resolution\n1,2,L\n3,4,M\n")
    write(tmp_path, "bad.csv", "ppc_ra,ppc_dec\n1,2\n")
    pointings, report = lists.load_pointings(spark, str(tmp_path))
    out = {r.upload_id.split("/")[-1]: r for r in report.collect()}
    assert out["bad.csv"].missing == ["ppc_resolution"] and not out["bad.csv"].status
    rows = sorted((r.ppc_code, r.ppc_pa, r.ppc_priority) for r in pointings.collect())
    assert rows == [("Field_7", 0.0, 0.0), ("Point_0", 0.0, 0.0), ("Point_1", 0.0, 0.0)]


def test_proposals_and_ids(spark, tmp_path):
    p = write(tmp_path, "p.csv", "Upload ID,proposal ID,PI name,rank\n00aa11bb22cc33dd,P-17,A B,9\n")
    i = write(tmp_path, "i.csv", "upload_id\n00aa11bb22cc33dd\n0123456789abcdef\n")
    assert lists.load_proposals(spark, p).first()["rank"] == 9.0
    assert lists.load_ids(spark, i).count() == 2


def ecsv(columns, rows, meta=()):
    head = ["# %ECSV 1.0", "# ---", "# delimiter: ','", "# datatype:"] + [f"# - {{name: '{c}', datatype: float64}}" for c in columns]
    if meta:
        head += ["# meta: !!omap"] + [f"# - {{{k}: {v}}}" for k, v in meta]
    quoted = [f'"{c}"' if " " in c else c for c in columns]
    return "\n".join([*head, "# schema: astropy-2.0", ",".join(quoted), *[",".join(map(str, r)) for r in rows]]) + "\n"


def tree(folder):
    ids = [f"{i:016x}" for i in range(1, 6)]
    summary = ["Priority", "N (L)", "Texp (L)", "N (M)", "Texp (M)"]
    psl = ["resolution", "N_ppc", "Texp (h)", "Texp (fiberhour)", "Request time (h)"]
    target = ["ob_code", "obj_id", "ra", "dec", "exptime", "priority", "resolution"]
    for k, i in enumerate(ids):
        d = f"2024/0{k + 1}/20240{k + 1}10-101112-{i}"
        meta = [("original_filename", f"f{k}.csv"), ("original_filename_ppc", "null"), ("upload_id", i), ("upload_at", f"2024-0{k + 1}-10 10:11:12+00:00"),
                ("single_exptime", 450), ("observation_type", "classical"), ("ppc_status", "user")]
        if k == 4:
            meta = []
        write(folder, f"{d}/target_{i}.ecsv", ecsv(target, [("a", 1, 10, 0, 1800, 1, "L"), ("b", 2, 10, 0, 1800, 2, "M")], meta))
        if k != 1:  # one directory without a summary
            write(folder, f"{d}/target_summary_{i}.ecsv", ecsv(summary, [(0, 5, 1.5, 2, 0.5), ("Total", 5, 1.5, 2, 0.5)], meta))
        columns = [c if k != 3 else c.replace("Request time (h)", "Request time 1 (h)") for c in psl]
        if k != 2:  # one without a pointing summary
            write(folder, f"{d}/psl_{i}.ecsv", ecsv(columns, [("low", 8, 2.0, 20.0, 3.0), ("medium", 4, 1.0, 10.0, 1.5), ("Total", 12, 3.0, 30.0, 4.5)], meta))
        write(folder, f"{d}/ppc_{i}.ecsv", ecsv(["ppc_code", "ppc_ra"], [("Point_low_1", 10)], meta))
        if k == 0:
            write(folder, f"{d}/TAC_psl_{i}.ecsv", ecsv(psl, [("low", 4, 1.0, 9.0, 1.25), ("medium", 0, 0.0, 0.0, 0.0)], meta))
            write(folder, f"{d}/TAC_ppc_{i}.ecsv", ecsv(["ppc_code", "ppc_ra"], [("Point_low_1", 10)], meta))
    return ids


def test_catalog_of_a_tree(spark, tmp_path):
    ids = tree(tmp_path)
    found = submissions.submission_ids(spark, str(tmp_path))
    assert sorted(r.upload_id for r in found.collect()) == ids
    assert catalog.ambiguous_ids(found).count() == 0
    rows = [r.asDict() for r in catalog.newest_first(submissions.catalog_of_tree(spark, str(tmp_path))).collect()]
    by_tgt = {(r["Upload ID"] or "none"): r for r in rows}
    a = by_tgt[ids[0]]
    assert a["TAC_done"] and a["TAC_nppc_L"] == 4 and a["TAC_FH_L"] == 9.0 and a["TAC_nppc_M"] == 0
    assert a["single_exptime"] == 450 and a["Filename"] == "f0.csv" and a["Filename_pointing"] is None and a["pointing_status"] == "user"
    assert (a["n_obj"], a["Exptime_tgt (FH)"], a["Time_tot_L (h)"], a["semester"]) == (7, 2.0, 3.0, "S23B")
    assert a["fullpath_ppc_tac"].endswith(f"TAC_ppc_{ids[0]}.ecsv") and a["filesize"] > 0
    b = by_tgt[ids[1]]  # counted from the target list
    assert (b["n_obj"], b["Exptime_tgt (FH)"], b["semester"], b["TAC_done"]) == (2, 1.0, "S24B", False)
    assert by_tgt[ids[3]]["Time_tot_M (h)"] == 1.5  # the older column name
    c = by_tgt["none"]  # without a pointing summary only the object totals
    assert (c["n_obj"], c["Time_tot_L (h)"], c["timestamp"], c["is_complete"]) == (7, 0.0, None, False)
    last = by_tgt[ids[4]]
    assert last["single_exptime"] == 900 and last["timestamp"] is None and last["observation_type"] is None
    assert rows[-1]["timestamp"] is None
    assert [r.semester for r in catalog.semesters(submissions.catalog_of_tree(spark, str(tmp_path))).collect()] == ["S23B", "S24A", "S24B"]


def test_ecsv_round_trip(spark, tmp_path, targets):
    some = flux.resolve_flux(targets.where("list_no < 3")).withColumn("upload_id", F.concat(F.lit("id"), F.col("list_no").cast("string")))
    columns = ["obj_id", "ob_code", "ra", "dec", "priority", "exptime", "resolution", "reference_arm", "filter_g", "flux_g", "filter_z", "flux_z"]
    meta = some.select("upload_id").distinct().withColumns({"original_filename": F.lit("x y.csv"), "single_exptime": F.lit(900)})
    out = str(tmp_path / "out")
    submissions.write_ecsv(submissions.ecsv_lines(some, meta, columns=columns), out)
    # several parts per list, read as they are
    assert len(list((tmp_path / "out").glob("upload_id=*/part-*"))) > len(list((tmp_path / "out").glob("upload_id=*")))
    back, report = lists.load_targets(spark, f"{out}/upload_id=*")
    assert all(r.status for r in report.collect())
    key = ["obj_id", "ob_code", "ra", "dec", "priority", "exptime", "resolution", "reference_arm"]
    want = sorted(tuple(r) for r in some.select(*key).collect())
    assert sorted(tuple(r) for r in back.select(*key).collect()) == want
    header = back.first().header
    assert "flux_g" in header and "flux_z" not in header
    info = submissions.header_metadata(read_lines(spark, f"{out}/upload_id=*")).collect()
    assert {(r.original_filename, r.single_exptime) for r in info} == {("x y.csv", "900")}


def test_parquet_submissions(spark, tmp_path, targets):
    root = str(tmp_path / "store")
    subs = spark.createDataFrame(
        [("u1", dt.datetime(2024, 3, 1)), ("u2", dt.datetime(2024, 3, 5)), ("u3", dt.datetime(2024, 4, 1))], "upload_id string, upload_at timestamp"
    )
    psl = spark.createDataFrame([("u1", "low", 3, 1.0)], "upload_id string, resolution string, N_ppc long, `Texp (h)` double")
    full = submissions.placeholder_rows(subs, psl, "psl")
    assert full.where("resolution is null").count() == 2
    submissions.save_submissions({"psl": full}, subs, root)
    stored = spark.read.parquet(f"{root}/psl")
    assert catalog.of_submission(stored, "u1", 2024, 3).count() == 1
    tac = spark.createDataFrame([("u1", "low", 2, 2024, 3)], "upload_id string, resolution string, N_ppc long, year int, month int")
    other = spark.createDataFrame([("u2", "low", 7, 2024, 3), ("u3", "low", 9, 2024, 4)], tac.schema)
    for rows in (tac, other, tac.withColumn("N_ppc", F.lit(5).cast("long"))):
        submissions.save_allocation(rows, rows, root)
    got = {r.upload_id: r.N_ppc for r in spark.read.parquet(f"{root}/tac_psl").collect()}
    assert got == {"u1": 5, "u2": 7, "u3": 9}
    chosen = spark.createDataFrame([("u2",), (None,)], "upload_id string")
    submissions.export_selected(spark.read.parquet(f"{root}/tac_ppc"), chosen, str(tmp_path / "export"))
    assert [r.upload_id for r in spark.read.parquet(str(tmp_path / "export")).collect()] == ["u2"]


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry.create(spark, path)
    registry.append(spark.createDataFrame([("a",), ("b",), ("b",)], "upload_id string"), path)
    registry.create(spark, path)
    table = spark.read.parquet(path)
    assert table.count() == 3
    candidates = spark.createDataFrame([("a",), ("z",)], "upload_id string")
    assert registry.existing(candidates, table).first().upload_id == "a"
    assert registry.missing(candidates, table).first().upload_id == "z"
    clean = str(tmp_path / "clean")
    assert [tuple(r) for r in registry.clean(spark, path, clean, dry_run=True).collect()] == [("b", 1)]
    assert not (tmp_path / "clean").exists()
    registry.clean(spark, path, clean)
    assert sorted(r.upload_id for r in spark.read.parquet(clean).collect()) == ["a", "b"]
    keys = spark.range(50).withColumnRenamed("id", "key")
    first = registry.assign_ids(keys, table, "key")
    again = registry.assign_ids(keys, first.where("key < 10"), "key")
    a = {r.key: r.upload_id for r in first.collect()}
    b = {r.key: r.upload_id for r in again.collect()}
    assert len(set(b.values())) == 50 and all(len(x) == 16 for x in b.values())
    assert all(b[k] != a[k] for k in range(10)) and all(b[k] == a[k] for k in range(10, 50))


def test_target_summary_rows(spark, targets):
    out = reports.target_summary(targets.withColumn("priority", F.when(F.col("row_id") % 7 == 0, 11).otherwise(F.col("priority"))), ["list_no"])
    rows = {r.Priority: r for r in out.where("list_no = 2").collect()}
    assert len(rows) == 12
    assert rows["Total"]["N (L)"] == sum(rows[p]["N (L)"] for p in rows if p != "Total")
    assert rows["Other"]["N (M)"] > 0


@pytest.mark.parametrize("mark", [",", " "])
def test_types_that_an_ecsv_header_declares(spark, tmp_path, mark):
    """Cells have to be of the declared type, whatever their column would take in a CSV file."""
    names = ["obj_id", "ob_code", "ra", "dec", "exptime", "priority", "resolution", "tract"]
    kinds = dict.fromkeys(names, "string") | {"obj_id": "int64", "ra": "float64", "dec": "float64", "exptime": "float32", "priority": "int16", "tract": "int32"}
    good = ["7", '"o, 7"', "1.5", "-2", "900", "1", "L", '""']
    cases = {
        "good": ({}, {}, None),
        "text": ({}, {"obj_id": "string"}, None),  # as texts, whole numbers are still read
        "quoted": ({"obj_id": '"8"'}, {}, None),
        "nan": ({"exptime": "nan"}, {}, None),
        "fraction": ({"exptime": "900.5"}, {"exptime": "int64"}, "declared int64, not an integer: 900.5"),
        "word": ({"ra": "abc"}, {}, "declared float64, not a number: abc"),
        "float_id": ({}, {"obj_id": "float64"}, "declared float64, not an integer: 7"),
        "none": ({"tract": "None"}, {}, "declared int32, not an integer: None"),
        "flag": ({}, {"resolution": "bool"}, "declared bool, not True or False: L"),
    }
    for case, (cells, other, _) in cases.items():
        row = dict(zip(names, good)) | cells
        head = ["# %ECSV 1.0", "# ---", *(["# delimiter: ','"] if mark == "," else []), "# datatype:"]
        head += [f"# - {{name: '{n}', unit: deg, datatype: {k}}}".replace("unit: deg, ", "") for n, k in (kinds | other).items()]
        lines = [*head, "# schema: astropy-2.0", mark.join(names), mark.join(good), mark.join(row.values())]
        (tmp_path / f"{case}.ecsv").write_text("\n".join(lines) + "\n")
    targets, report = lists.load_targets(spark, f"{tmp_path}/*.ecsv")
    got = {r.upload_id.rsplit("/", 1)[1].removesuffix(".ecsv"): r for r in report.collect()}
    assert {k: r.error for k, r in got.items()} == {k: error for k, (_, _, error) in cases.items()}
    assert all(r.n_rows == 2 and r.status == (r.error is None) for r in got.values())
    assert targets.count() == 2 * sum(error is None for _, _, error in cases.values())
    assert {r.ob_code for r in targets.collect()} == {"o, 7"}


def test_register_a_tree(spark, tmp_path):
    ids, path = tree(tmp_path / "tree"), str(tmp_path / "registry")
    registry.create(spark, path)
    registry.append(spark.createDataFrame([(ids[1],), ("other",)], "upload_id string"), path)
    new = submissions.register_tree(spark, str(tmp_path / "tree"), path)
    assert sorted(r.upload_id for r in new.collect()) == sorted({*ids} - {ids[1]})
    write(tmp_path / "tree", f"2025/01/20250110-101112-{ids[0]}/target_{ids[0]}.ecsv", "# empty")  # a second directory of an id
    assert submissions.register_tree(spark, str(tmp_path / "tree"), path).count() == 0
    assert sorted(r.upload_id for r in spark.read.parquet(path).collect()) == sorted([*ids, "other"])


def test_scan_opens_changed_directories_only(spark, tmp_path):
    folder, store = tmp_path / "tree", str(tmp_path / "store")
    tree(folder)

    def rows(df):
        return sorted(df.drop("fullpath_tgt", "fullpath_ppc", "fullpath_ppc_tac", "fullpath_psl").collect(), key=repr)

    def agrees():
        assert rows(submissions.catalog_of_store(spark, store)) == rows(submissions.catalog_of_tree(spark, str(folder)))

    assert submissions.scan_tree(spark, str(folder), store) == 1
    agrees()
    assert submissions.scan_tree(spark, str(folder), store) == 1  # nothing has changed
    first = rows(submissions.catalog_of_store(spark, store))
    summaries = sorted(folder.glob("*/*/*/target_summary_*.ecsv"))
    unread, other = summaries[0], summaries[2]
    # one file differs, but neither in size nor in time: it is not opened; the other one is
    was, text = unread.stat(), unread.read_text()
    unread.write_text(text.replace("Total,5", "Total,9"))
    os.utime(unread, ns=(was.st_atime_ns, was.st_mtime_ns))
    other.write_text(other.read_text().replace("Total,5", "Total,50"))
    assert submissions.scan_tree(spark, str(folder), store) == 2
    counts = {r["Upload ID"]: r["n_obj"] for r in submissions.catalog_of_store(spark, store).collect()}
    assert counts[unread.stem[-16:]] == 7 and counts[other.stem[-16:]] == 52
    assert rows(submissions.catalog_of_store(spark, store, 1)) == first
    unread.write_text(text)
    # a file and a whole directory go
    next(folder.glob("*/*/*/TAC_psl_*.ecsv")).unlink()
    shutil.rmtree(other.parent)
    assert submissions.scan_tree(spark, str(folder), store) == 3
    agrees()
    # the last change is a directory alone that goes
    shutil.rmtree(unread.parent)
    assert submissions.scan_tree(spark, str(folder), store) == 4
    agrees()


def _plans(monkeypatch):
    """Labels and plans of all that is stored from here on."""
    stored, plain = [], textfiles.stage

    def noted(df, label, **metrics):
        stored.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, label, **metrics)

    monkeypatch.setattr(textfiles, "stage", noted)
    monkeypatch.setattr(lists, "stage", noted)
    return stored


def test_lines_are_stored_once_and_never_sorted_by_file(spark, monkeypatch):
    """Records over several lines: the source is read once, by the table of lines, and no aggregate carries texts."""
    body = ["# %ECSV 1.0", "# delimiter: ','", "# - {name: key, datatype: int64}", " # none", "\r", "key,note # head", '1,"a', 'b"" # c', 'd" # e', "2,x#y", '3,"z']
    lines = spark.createDataFrame([(f"/in/{f}.csv", i * 10, t) for f in "ab" for i, t in enumerate(body if f == "a" else body[:6] + ["4,w\r", ""])], "path string, row_id long, line string")
    stored = _plans(monkeypatch)
    rows = textfiles.tables(textfiles.records(lines, block=20), names=["note", "key"])
    got = sorted((r.path, r.row_id, r._cells, r._kinds, r._unclosed) for r in rows.collect())
    kinds = [None, "int64"]
    assert got == [
        ("/in/a.csv", 60, ['a\nb" # c\nd', "1"], kinds, False), ("/in/a.csv", 90, ["x", "2"], kinds, False),
        ("/in/a.csv", 100, ['"z', "3"], kinds, True), ("/in/b.csv", 60, ["w", "4"], kinds, False),
    ]
    labels = [label for label, _ in stored]
    assert labels[0] == "lines" and {"records", "first-lines", "headers"} <= set(labels)
    assert all("ExistingRDD" not in plan for _, plan in stored[1:])
    assert "SortAggregate" not in dict(stored)["first-lines"]
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()


def test_report_parses_each_record_once(spark, monkeypatch):
    """Values and errors are stored together; the report takes the first error of a file without sorting rows by it."""
    text = ["obj_id,ob_code,ra,dec,exptime,priority,resolution", "1,a,1,2,900,0,L", "2,b,1,x,900,0,L", "3.0,c,1,y,900,0,L"]
    lines = spark.createDataFrame([(p, i, t) for p in ("/in/f.csv", "/in/g.txt") for i, t in enumerate(text)] + [("/in/h.csv", i, t) for i, t in enumerate(text[:2])], "path string, row_id long, line string")
    stored = _plans(monkeypatch)
    targets, report = lists.parse_targets(lines)
    assert sorted(tuple(r) for r in report.collect()) == [
        ("/in/f.csv", False, "not a number: x", 2, 3), ("/in/g.txt", False, "neither CSV nor ECSV", 0, 0), ("/in/h.csv", True, None, 0, 1),
    ]
    assert [(r.upload_id, r.obj_id, r.dec) for r in targets.collect()] == [("/in/h.csv", 1, 2.0)]
    assert stored[-1][0] == "typed"
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "try_cast" not in plan.lower()
