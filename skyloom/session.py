"""Session settings and the one way in which loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

BROADCAST_ROWS = 50_000  # rows of a stored table that may be broadcast

_own_scratch: dict[str, str] = {}
_scope: ContextVar[list[str] | None] = ContextVar("staged tables of the scope", default=None)


def session(app: str = "skyloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "4096")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of its own, because every executor of a
    cluster has to see the files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_scratch:
        _own_scratch[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_scratch[context.applicationId]


def stage(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` to the shared folder and read it back: its lineage ends here.

    The table survives the loss of an executor, the plan of the next round starts at a scan, and the
    ``metrics`` (aggregate columns) are gathered while writing, so that a loop needs no extra job to
    decide whether it goes on.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/skyloom/{label}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    seen: dict = {}
    if metrics:
        observation = Observation(f"{label}-{uuid.uuid4().hex[:8]}")
        df.observe(observation, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
        seen = observation.get
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen


def by_key(table: DataFrame, n_rows: int | None) -> DataFrame:
    """A stored ``table`` as the side of a join, not to be broadcast if it has many rows.

    Spark goes by the size of the files. Codes and numbers are packed so well in them that a table just below the broadcast
    threshold takes more than ten times as much when the driver makes it a hash table.
    """
    return table.hint("merge") if n_rows is None or n_rows > BROADCAST_ROWS else table


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside are deleted at the end, if it is reached without an error.

    What leaves the scope has to be staged by :func:`stage_result`; other frames may still read the deleted tables.
    """
    token = _scope.set([])
    try:
        yield _scope.get()
        done = list(_scope.get())
    finally:
        _scope.reset(token)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in done:
        path = hadoop.Path(name)
        path.getFileSystem(conf).delete(path, True)


def stage_result(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`stage` for a table that outlives the scope it is made in (and belongs to none)."""
    token = _scope.set(None)
    try:
        return stage(df, label, **metrics)
    finally:
        _scope.reset(token)
