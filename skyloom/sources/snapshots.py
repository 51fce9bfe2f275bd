"""Tables of submissions that change as a whole: readers see all of a commit or nothing of it.

A store is a folder. Rows lie in Parquet files below ``<table>/commit=<id>/<partition>``, and no file is ever changed. A small
JSON file per version names the folders that every partition of every table consists of. A commit writes its rows first and
publishes that file last, by a rename: a job lost before has changed nothing, and its folders are left over for :func:`clean`.

An index of submission ids says in which partition and files the rows of an id are. So a commit rewrites only partitions that
hold an id it replaces, and the look-up of an id opens its own files alone, however large the table is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, NullType, NumericType, StructField, StructType

VERSIONS = "_versions"
INDEX = "id_index"
BUCKETS = 64  # folders of the index; a look-up reads one


# --- files ---------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Partition folders below ``path``, relative to it."""
    fs, at = _files(spark, path + "/*" * depth)
    found = fs.globStatus(at) or []
    names = ["/".join(str(s.getPath()).split("/")[-depth:]) for s in found if s.isDirectory()]
    return sorted(n for n in names if not n.startswith("_"))


def _publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Write the file of a version under another name and rename it; fails if that version is there already."""
    jvm = spark.sparkContext._jvm
    final, temporary = f"{root}/{VERSIONS}/{version:012d}.json", f"{root}/{VERSIONS}/.{uuid.uuid4().hex}"
    fs, at = _files(spark, temporary)
    out = fs.create(at)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context.rename(at, jvm.org.apache.hadoop.fs.Path(final), options)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    return [int(n.removesuffix(".json")) for n in _children(spark, f"{root}/{VERSIONS}") if n.endswith(".json") and n[0] != "."]


def _state(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    known = versions(spark, root)
    if version is not None and version not in known:
        raise ValueError(f"{root} has no version {version}")
    if not known:
        return 0, {"tables": {}}
    chosen = known[-1] if version is None else version
    text = spark.read.text(f"{root}/{VERSIONS}/{chosen:012d}.json", wholetext=True).first()[0]
    return chosen, json.loads(text)


# --- reading -------------------------------------------------------------------------


def _load(spark: SparkSession, root: str, name: str, about: dict, paths: Sequence[str]) -> DataFrame:
    schema = StructType.fromJson(about["schema"])
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/{p}" for p in paths])
    return rows.select(*[f"`{c}`" for c in schema.names])


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the latest if none is given. Partition columns prune what is read."""
    _, state = _state(spark, root, version)
    if name not in state["tables"]:
        raise ValueError(f"{root} has no table {name!r}")
    about = state["tables"][name]
    return _load(spark, root, name, about, [f for folders in about["parts"].values() for f in folders])


def _bucket(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(BUCKETS)).cast("int")


def of_ids(spark: SparkSession, root: str, name: str, ids: Sequence[str], version: int | None = None) -> DataFrame:
    """Rows of a few submissions, from their own files alone.

    The index is read in the folders of these ids only; what comes to the driver is the names of their files. Unknown ids
    have no rows.
    """
    _, state = _state(spark, root, version)
    about = state["tables"][name]
    index = read(spark, root, INDEX, version)
    keys = [F.lit(i) for i in ids]
    if not keys:
        return _load(spark, root, name, about, [])
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*[_bucket(k) for k in keys]))).distinct().collect()]
    hits = index.where(F.col("bucket").isin(buckets) & F.col("id").isin(list(ids)) & (F.col("table") == name))
    files = [r[0] for r in hits.select("file").distinct().collect()]
    return _load(spark, root, name, about, sorted(files)).where(F.col(about["id"]).isin(list(ids)))


# --- writing -------------------------------------------------------------------------


def _write(rows: DataFrame, root: str, name: str, keys: Sequence[str], id_col: str) -> str:
    """Rows into a new folder, in order of partition and id: few files hold rows of one id."""
    folder = f"commit={uuid.uuid4().hex}c"  # the letter keeps it a text
    ordered = rows.repartitionByRange(*keys, id_col).sortWithinPartitions(*keys, id_col)
    ordered.write.mode("errorifexists").partitionBy(*keys).parquet(f"{root}/{name}/{folder}")
    return folder


def _as_stored(field: StructField, known: StructType, name: str) -> Column:
    """A column in the type that the table has for it; whole numbers widen or are checked, others have to agree."""
    column = F.col(f"`{field.name}`")
    if field.name not in known.names or known[field.name].dataType == field.dataType:
        return column
    stored = known[field.name].dataType
    if isinstance(field.dataType, NullType) or isinstance(field.dataType, IntegralType) and isinstance(stored, NumericType):
        return column.cast(stored).alias(field.name)
    raise ValueError(f"column {field.name!r} of table {name!r} is stored as {stored.simpleString()}, not {field.dataType.simpleString()}")


def commit(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], keys: Sequence[str] = ("year", "month"),
    id_col: str = "upload_id", gone: DataFrame | None = None,
) -> int:
    """Add rows to several tables in one step; returns the version.

    An id that a table has already is replaced in it, also if it moves to another partition; rows without an id are added.
    Ids of ``gone`` (a column ``id_col``) leave the given tables, also where no new rows come for them.
    ``keys`` are whole numbers or dates. Each table is computed once. Partitions without a replaced id keep their files and
    get further ones. Columns may come and go; one that is stored keeps its type, and a commit whose column is of another
    kind is refused. Of two commits at a time one fails, without an effect.
    """
    before, state = _state(spark, root)
    content = {"tables": dict(state["tables"])}
    fresh, rewritten = [], []  # entries of the index, and partitions whose entries go
    index = read(spark, root, INDEX) if INDEX in state["tables"] else None
    for name, new in tables.items():
        if name == INDEX:
            raise ValueError(f"{INDEX} is the name of the index")
        data = new.select(*[c for c in new.columns if c not in keys], *keys)
        about = {"schema": data.schema.jsonValue(), "id": id_col, "keys": list(keys)}
        old = state["tables"].get(name)
        if old and (old["keys"], old["id"]) != (about["keys"], id_col):
            raise ValueError(f"table {name!r} is stored by {old['keys']} and {old['id']}")
        if old:
            # columns that either lacks are null there
            known = StructType.fromJson(old["schema"])
            more = [f for f in known if f.name not in data.columns]
            have = [_as_stored(f, known, name) for f in data.schema if f.name not in keys]
            data = data.select(*have, *[F.lit(None).cast(f.dataType).alias(f.name) for f in more], *keys)
            about["schema"] = data.schema.jsonValue()
        parts = dict(old["parts"]) if old else {}
        written = [_write(data, root, name, keys, id_col)]
        if old and index is not None:
            ids = _load(spark, root, name, about, [written[0]]).select(F.col(id_col).cast("string").alias("id"))
            if gone is not None:
                ids = ids.unionByName(gone.select(F.col(id_col).cast("string").alias("id")))
            ids = ids.distinct()
            replaced = index.where(F.col("table") == name).join(ids, "id", "left_semi").select("part").distinct()
            hit = sorted(r[0] for r in replaced.collect())  # at most the partitions that the version file names
            if hit:
                stored = _load(spark, root, name, about, [f for p in hit for f in parts[p]])
                kept = stored.join(ids.withColumnRenamed("id", "_id"), F.col(id_col).cast("string") == F.col("_id"), "left_anti")
                written.append(_write(kept, root, name, keys, id_col))
                rewritten += [(name, p) for p in hit]
                parts = {p: f for p, f in parts.items() if p not in hit}
        for folder in written:
            for part in _leaves(spark, f"{root}/{name}/{folder}", len(keys)):
                parts[part] = [*parts.get(part, []), f"{folder}/{part}"]
        content["tables"][name] = {**about, "parts": parts}
        place = rf".*/{name}/(commit=[^/]+/(.*)/[^/]+)$"
        for folder in written:
            path = F.col("_metadata.file_path")
            raw = spark.read.schema(data.schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/{folder}")
            fresh.append(
                raw.where(F.col(id_col).isNotNull())
                .select(
                    F.col(id_col).cast("string").alias("id"), F.lit(name).alias("table"), F.regexp_extract(path, place, 2).alias("part"),
                    F.regexp_extract(path, place, 1).alias("file"),
                ).distinct()
            )
    if fresh:
        entries = fresh[0]
        for f in fresh[1:]:
            entries = entries.unionByName(f)
        entries = entries.withColumn("bucket", _bucket(F.col("id")))
        if index is not None:
            if rewritten:
                left = spark.createDataFrame(rewritten, "table string, part string")
                index = index.join(F.broadcast(left), ["table", "part"], "left_anti")  # one row per partition at most
            entries = index.select(*entries.columns).unionByName(entries)
        folder = f"commit={uuid.uuid4().hex}c"
        entries.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{INDEX}/{folder}")
        places = {p: [f"{folder}/{p}"] for p in _leaves(spark, f"{root}/{INDEX}/{folder}", 1)}
        content["tables"][INDEX] = {"schema": entries.schema.jsonValue(), "id": "id", "keys": ["bucket"], "parts": places}
    _publish(spark, root, before + 1, content)
    return before + 1


def clean(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete folders that none of the last ``keep`` versions names, and older versions; returns the number of folders.

    Not while a commit is under way: its folders are not named yet.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    known = versions(spark, root)
    named: set[tuple[str, str]] = set()
    for v in known[-keep:]:
        for name, about in _state(spark, root, v)[1]["tables"].items():
            named |= {(name, f.split("/")[0]) for folders in about["parts"].values() for f in folders}
    for v in known[:-keep]:
        fs, at = _files(spark, f"{root}/{VERSIONS}/{v:012d}.json")
        fs.delete(at, False)
    removed = 0
    for name in _children(spark, root):
        for folder in _children(spark, f"{root}/{name}") if name != VERSIONS else []:
            if folder.startswith("commit=") and (name, folder) not in named:
                fs, at = _files(spark, f"{root}/{name}/{folder}")
                fs.delete(at, True)
                removed += 1
    return removed
