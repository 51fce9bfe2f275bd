"""Submissions on disk: trees of ECSV files, and the Parquet tables that replace them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.functions import parsing
from skyloom.operators import registry
from skyloom.operators.catalog import build_catalog
from skyloom.operators.flux import band_presence
from skyloom.operators.ordered import join_back
from skyloom.schema import RESOLVED_FLUX
from skyloom.session import stage
from skyloom.sources import snapshots
from skyloom.sources.textfiles import cell, read_lines, tables

# --- fixed values: names in a submission tree ---
DIRECTORY_GLOB = "????/??/????????-??????-????????????????"
FLAT_GLOB = "????????-??????-????????????????"
KINDS = ["target_summary", "target", "psl", "ppc", "TAC_psl", "TAC_ppc"]
META_KEYS = [
    "original_filename", "original_filename_ppc", "upload_id", "upload_at", "single_exptime",
    "observation_type", "ppc_status",
]
SLOTS = 64  # partitions of a scanned tree: a changed submission rewrites the rows of one
_PATH = r"/([^/]*-([^/-]+))/(" + "|".join(KINDS) + r")_([^/]+)\.ecsv$"
EMPTY_PSL = ["Texp (h)", "Texp (fiberhour)", "Request time (h)", "Used fiber fraction (%)", "Fraction of PPC < 30% (%)", "P_all", "P_0"]


def _place(path: Column) -> dict[str, Column]:
    return {
        "directory": F.regexp_extract(path, r"^(.*)/[^/]+$", 1),
        "upload_id": F.regexp_extract(path, _PATH, 2),
        "kind": F.regexp_extract(path, _PATH, 3),
    }


def submission_ids(spark: SparkSession, root: str, flat: bool = False) -> DataFrame:
    """Upload ids and directories of a submission tree, from its paths alone."""
    pattern = f"{root}/{FLAT_GLOB if flat else DIRECTORY_GLOB}/*"
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(
        F.regexp_extract("path", r"-([^/-]+)/[^/]+$", 1).alias("upload_id"),
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"),
    ).distinct()


def header_metadata(lines: DataFrame, key: str = "path") -> DataFrame:
    """The known metadata keys of ECSV headers, one row per file; absent keys are null."""
    entry = lines.where(F.col("line").rlike(r"^# *- *\{ *\w+:")).select(
        key,
        F.regexp_extract("line", r"\{ *(\w+):", 1).alias("_key"),
        F.trim(F.regexp_extract("line", r"\{ *\w+: *(.*?) *\} *$", 1)).alias("_value"),
    )
    text = F.regexp_replace(F.regexp_replace("_value", r"^!!\S+ +", ""), r"^(['\"])(.*)\1$", "$2")
    value = F.when(~F.col("_value").isin("null", "~", ""), text)
    return entry.where(F.col("_key").isin(META_KEYS)).groupBy(key).agg(
        *[F.max(F.when(F.col("_key") == k, value)).alias(k) for k in META_KEYS]
    )


def load_tree(
    spark: SparkSession, root: str, flat: bool = False, directories: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The catalog tables of a submission tree, or of some of its directories; each table reads the files of its kind alone.

    ``submissions`` has one row per directory with metadata, paths and size; ``target_summary``,
    ``target``, ``psl``, ``ppc``, ``TAC_psl`` and ``TAC_ppc`` have the rows of the files of that kind.
    """
    pattern = f"{root}/{FLAT_GLOB if flat else DIRECTORY_GLOB}" if directories is None else list(directories)

    def lines_of(kind: str) -> DataFrame:
        # only the files of a kind are opened; names that begin alike are told apart by the path
        return read_lines(spark, pattern, f"{kind}_*.ecsv").withColumns(_place(F.col("path"))).where(F.col("kind") == kind)

    by_kind = {kind: lines_of(kind) for kind in KINDS}
    rows = {kind: tables(lines) for kind, lines in by_kind.items()}
    out = {"target_summary": _numbers(rows["target_summary"], ["Priority"], ["N (L)", "Texp (L)", "N (M)", "Texp (M)"])}
    figures = [*EMPTY_PSL[:3], "Request time 1 (h)", *EMPTY_PSL[3:6], *[f"P_{p}" for p in range(10)]]
    for kind in ("psl", "TAC_psl"):
        out[kind] = _numbers(rows[kind], ["resolution"], ["N_ppc", *figures])
    for kind in ("ppc", "TAC_ppc"):
        out[kind] = _numbers(
            rows[kind], ["ppc_code", "ppc_resolution", "allocated_targets"],
            ["ppc_ra", "ppc_dec", "ppc_pa", "ppc_priority", "Fiber usage fraction (%)"],
        )
    out["target"] = _numbers(
        rows["target"], ["ob_code", "resolution", "reference_arm"], ["ra", "dec", "exptime"], ["obj_id", "priority"]
    )
    meta = header_metadata(by_kind["target_summary"].unionByName(by_kind["target"]))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ecsv").load(pattern)
    files = found.select("path", F.col("length").alias("_size")).withColumns(_place(F.col("path"))).where("kind <> ''")
    described = files.join(meta.drop("upload_id"), "path", "left")  # the directory decides on the id
    # metadata of the summary, or of the target list where there is no summary
    per_directory = described.groupBy("directory", F.col("upload_id").alias("directory_id")).agg(
        *[
            F.when(F.max((F.col("kind") == "target_summary").cast("int")) == 1, F.max(F.when(F.col("kind") == "target_summary", F.col(k))))
            .otherwise(F.max(F.when(F.col("kind") == "target", F.col(k)))).alias(k)
            for k in META_KEYS if k != "upload_id"
        ],
        F.max(F.when(F.col("kind") == "target", F.col("_size"))).alias("_size"),
        *[
            F.max(F.when(F.col("kind") == kind, F.col("path"))).alias(name)
            for kind, name in (("target", "target_path"), ("ppc", "ppc_path"), ("psl", "psl_path"), ("TAC_ppc", "tac_ppc_path"))
        ],
    )
    out["submissions"] = per_directory.select(
        "directory",
        F.col("directory_id").alias("upload_id"),
        *[k for k in META_KEYS if k not in ("upload_id", "upload_at", "single_exptime")],
        F.try_to_timestamp(F.col("upload_at")).alias("upload_at"),
        F.col("single_exptime").try_cast("double").cast("int").alias("single_exptime"),
        (F.col("_size") / 1000.0).alias("filesize"),
        "target_path", "ppc_path", "psl_path", "tac_ppc_path",
    )
    return out


def _numbers(rows: DataFrame, texts: Sequence[str], doubles: Sequence[str], longs: Sequence[str] = ()) -> DataFrame:
    return rows.select(
        "upload_id", "row_id",
        *[cell(c).alias(c) for c in texts],
        *[parsing.number(cell(c))[0].alias(c) for c in doubles],
        *[parsing.strict_int(cell(c))[0].alias(c) for c in longs],
    )


def catalog_of_tree(spark: SparkSession, root: str, flat: bool = False) -> DataFrame:
    """The submission catalog of a tree of ECSV files."""
    t = load_tree(spark, root, flat)
    return build_catalog(t["submissions"], t["target_summary"], t["target"], t["psl"], t["TAC_psl"])


def scan_tree(spark: SparkSession, root: str, store: str, flat: bool = False) -> int:
    """Bring a store of :mod:`skyloom.sources.snapshots` up to date with a tree of ECSV files; returns its version.

    The table ``files`` of the store has the path, size and time of every file as of the last scan. The tree is listed, and
    only directories of ids with a file that is new, gone, or of another size or time are opened. Their rows replace what the
    tables had of these ids, in one commit; if nothing has changed, no file is opened and no version is made. Two directories
    of one id are opened together. The names of the directories to open come to the driver, as those of a listing do.
    """
    pattern = f"{root}/{FLAT_GLOB if flat else DIRECTORY_GLOB}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ecsv").load(pattern)
    listed = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))
    listed, _ = stage(listed.withColumns(_place(F.col("path"))).where("kind <> ''"), "listing")
    version = (snapshots.versions(spark, store) or [0])[-1]
    if version:
        known = snapshots.read(spark, store, "files").select("path", "upload_id", F.struct("size", "changed_at").alias("_old"))
        both = listed.select("path", "upload_id", F.struct("size", "changed_at").alias("_new")).join(known, ["path", "upload_id"], "full")
        changed = both.where(~F.equal_null("_old", "_new")).select("upload_id").distinct()
        changed, seen = stage(changed, "changed-ids", n=F.count(F.lit(1)))
        if not seen["n"]:
            return version
        files = listed.join(changed, "upload_id", "left_semi")
        directories = [r[0] for r in files.select("directory").distinct().collect()]
    else:
        changed, files, directories = None, listed, None
    # without a directory left there is nothing to read: the empty tables of the store say what columns there are
    if directories == []:
        read = {kind: snapshots.read(spark, store, kind).limit(0) for kind in [*KINDS, "submissions"]}
    else:
        read = load_tree(spark, root, flat, directories)
    slot = F.pmod(F.crc32(F.col("upload_id").cast("binary")), F.lit(SLOTS)).cast("int")
    tables_of = {name: table.withColumn("slot", slot) for name, table in {**read, "files": files}.items()}
    return snapshots.commit(spark, store, tables_of, ["slot"], gone=changed)


def register_tree(spark: SparkSession, root: str, path: str, flat: bool = False) -> DataFrame:
    """Put the ids of a submission tree into the registry at ``path``, which is made if there is none; returns the new ones.

    Ids that the registry has are not added again, and an id with several directories is added once.
    """
    registry.create(spark, path)
    known = spark.read.schema("upload_id string").parquet(path)
    found = submission_ids(spark, root, flat).select("upload_id").distinct()
    new, _ = stage(registry.missing(found, known), "new-ids")
    registry.append(new, path)
    return new


def catalog_of_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The submission catalog of a store kept by :func:`scan_tree`, as of a version."""
    t = {name: snapshots.read(spark, store, name, version).drop("slot") for name in ("submissions", "target_summary", "target", "psl", "TAC_psl")}
    return build_catalog(t["submissions"], t["target_summary"], t["target"], t["psl"], t["TAC_psl"])


# --- Parquet tables -----------------------------------------------------------------


def placeholder_rows(lists: DataFrame, results: DataFrame, kind: str, key: str = "upload_id") -> DataFrame:
    """``results`` plus one empty row for every list without a simulation (``psl`` or ``ppc``)."""
    without = lists.select(key).distinct().join(results.select(key), key, "left_anti")
    fixed = {"ppc_priority": F.lit(-1.0)} if kind == "ppc" else {}
    empty = without.select(
        key,
        *[
            fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in results.schema.fields if f.name != key
        ],
    )
    return results.unionByName(empty)


def save_submissions(
    tables_by_kind: dict[str, DataFrame], submissions: DataFrame, root: str, versioned: bool = False
) -> None:
    """Add submissions to one Parquet table per kind, partitioned by year and month; a known id is replaced.

    ``submissions`` has ``upload_id``, ``upload_at`` and the metadata columns, which become columns of the
    table ``submissions``. With ``versioned`` all tables change in one step, in a store of
    :mod:`skyloom.sources.snapshots`; without, months are overwritten in place.
    """
    stamped = submissions.withColumns(
        {"year": F.year("upload_at"), "month": F.month("upload_at")}
    )
    when = stamped.select("upload_id", "year", "month")
    if versioned:
        placed = {kind: join_back(table, when, ["upload_id"]) for kind, table in tables_by_kind.items()}
        snapshots.commit(submissions.sparkSession, root, {"submissions": stamped, **placed})
        return
    _merge(stamped, f"{root}/submissions")
    for kind, table in tables_by_kind.items():
        _merge(join_back(table, when, ["upload_id"]), f"{root}/{kind}")


def save_allocation(tac_psl: DataFrame, tac_ppc: DataFrame, root: str, versioned: bool = False) -> None:
    """Write back allocated summaries and pointings; months without a change keep their files.

    The tables hold one version per submission: rows of other submissions in a touched month are kept. With
    ``versioned`` both tables change in one step, as in :func:`save_submissions`.
    """
    if versioned:
        snapshots.commit(tac_psl.sparkSession, root, {"tac_psl": tac_psl, "tac_ppc": tac_ppc})
        return
    for name, new in (("tac_psl", tac_psl), ("tac_ppc", tac_ppc)):
        _merge(new, f"{root}/{name}")


def _write(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).partitionBy("year", "month").parquet(path)


def _merge(new: DataFrame, path: str) -> None:
    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        _write(new, path, "append")
        return
    touched = new.select("year", "month").distinct()
    kept = old.join(touched, ["year", "month"], "left_semi").join(new.select("upload_id"), "upload_id", "left_anti")
    merged, _ = stage(kept.select(*new.columns).unionByName(new), "allocation")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def export_selected(table: DataFrame, selected: DataFrame, path: str, key: str = "upload_id") -> None:
    """Write the rows of selected submissions; ids without rows are skipped."""
    table.join(selected.select(key).where(F.col(key).isNotNull()), key, "left_semi").write.mode("errorifexists").parquet(path)


def ecsv_lines(
    table: DataFrame, metadata: DataFrame | None = None, list_col: str = "upload_id", order: str = "row_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Text lines (``line_no``, ``value``) of one ECSV file per list, with a metadata header.

    Resolved flux columns that are empty in a list are left out of its file.
    """
    columns = list(columns or [c for c in table.columns if c not in (list_col, order)])
    kinds = {"bigint": "int64", "int": "int32", "double": "float64", "string": "string", "boolean": "bool"}
    types = {f.name: kinds.get(f.dataType.simpleString(), "string") for f in table.schema.fields}
    flux = [c for c in columns if c in RESOLVED_FLUX]
    if flux and all(c in table.columns for c in RESOLVED_FLUX):
        kept = band_presence(table, [list_col]).withColumn(
            "_columns", F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: ~c.isin(flux) | F.array_contains("columns", c))
        ).select(list_col, "_columns")
    else:
        kept = table.select(list_col).distinct().withColumn("_columns", F.array(*[F.lit(c) for c in columns]))
    kind_of = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    if metadata is None:
        entries = F.array().cast("array<string>")
        heads = kept
    else:
        keys = [c for c in metadata.columns if c != list_col]
        heads = join_back(kept, metadata, [list_col])
        entries = F.array(
            *[F.concat(F.lit(f"# - {{{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("null")), F.lit("}")) for k in keys],
            F.concat(F.lit("# - {" + list_col + ": "), F.col(list_col), F.lit("}")),
        )
    typed = F.transform(
        "_columns", lambda c: F.concat(F.lit("# - {name: '"), c, F.lit("', datatype: "), F.element_at(kind_of, c), F.lit("}"))
    )
    head = F.concat(
        F.array(F.lit("# %ECSV 1.0"), F.lit("# ---"), F.lit("# delimiter: ','"), F.lit("# datatype:")),
        typed,
        F.array(F.lit("# meta: !!omap")) if metadata is not None else F.array().cast("array<string>"),
        entries,
        F.array(F.lit("# schema: astropy-2.0"), F.array_join(F.transform("_columns", _quoted), ",")),
    )
    head_lines = heads.select(list_col, F.posexplode(head).alias("_p", "value")).select(
        list_col, (F.col("_p") - 1_000_000).cast("bigint").alias("line_no"), "value"
    )
    cells = F.create_map(*[x for c in columns for x in (F.lit(c), _quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))))])
    body = join_back(table, kept, [list_col]).select(
        list_col, F.col(order).cast("bigint").alias("line_no"),
        F.array_join(F.transform("_columns", lambda c: F.element_at(cells, c)), ",").alias("value"),
    )
    return head_lines.unionByName(body)


def _quoted(text: Column) -> Column:
    needs = text.rlike(r'[",\s#]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_ecsv(lines: DataFrame, path: str, list_col: str = "upload_id") -> None:
    """Write lines as text, one directory per list, which ``load_targets`` reads as one list.

    The lines are range-partitioned by list and position: a long list becomes several part files whose
    names sort in order, so that joined together they are the ECSV file, and no task holds a whole list.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        lines.repartitionByRange(parts, list_col, "line_no").sortWithinPartitions(list_col, "line_no")
        .select(list_col, "value").write.mode("errorifexists").partitionBy(list_col).text(path)
    )
