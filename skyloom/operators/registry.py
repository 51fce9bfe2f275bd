"""The registry of upload ids: a one-column table with appends, membership tests and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.session import stage

ID_LENGTH = 16


def create(spark: SparkSession, path: str) -> None:
    """An empty registry, unless there is one."""
    spark.createDataFrame([], "upload_id string").write.mode("ignore").parquet(path)


def append(ids: DataFrame, path: str) -> None:
    """Insert ids, repeats included: the registry has no unique constraint."""
    ids.select(F.col("upload_id").cast("string")).write.mode("append").parquet(path)


def existing(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates that are already registered."""
    return candidates.join(registry.select("upload_id"), "upload_id", "left_semi")


def missing(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates that are not registered yet."""
    return candidates.join(registry.select("upload_id"), "upload_id", "left_anti")


def repeated_ids(registry: DataFrame) -> DataFrame:
    """Dry run of the clean-up: repeated ids with the number of superfluous rows."""
    return (
        registry.groupBy("upload_id").agg((F.count(F.lit(1)) - 1).alias("n_extra")).where("n_extra > 0")
    )


def without_repeats(registry: DataFrame) -> DataFrame:
    return registry.select("upload_id").distinct()


def clean(spark: SparkSession, path: str, cleaned_path: str, dry_run: bool = False) -> DataFrame:
    """Write a version without repeats next to the old one, which stays as the backup.

    Gives the table of repeated ids; a dry run writes nothing.
    """
    registry = spark.read.schema("upload_id string").parquet(path)
    if not dry_run:
        without_repeats(registry).write.mode("errorifexists").parquet(cleaned_path)
    return repeated_ids(registry)


def _token(salt: int, key: str):
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(salt)), F.col(key).cast("string")), 256), 1, ID_LENGTH)


def assign_ids(
    submissions: DataFrame, taken: DataFrame, key: str, salt: str = "", max_tries: int = 8
) -> DataFrame:
    """Give every row of ``submissions`` (unique ``key``) a 16-digit hexadecimal ``upload_id``.

    Ids are not in ``taken`` and differ from each other. Only rows whose id clashes are tried again
    with another salt, so that one pass is the rule.
    """
    free, todo, done = None, submissions.select(key), None
    for attempt in range(max_tries):
        drawn = todo.withColumn("upload_id", _token(f"{salt}{attempt}", key))
        # of several rows that drew the same id, the smallest key keeps it
        first = drawn.groupBy("upload_id").agg(F.min(key).alias(key))
        used = taken.select("upload_id") if done is None else taken.select("upload_id").unionByName(done.select("upload_id"))
        free = first.join(used, "upload_id", "left_anti").select(key, "upload_id")
        done = free if done is None else done.unionByName(free)
        done, _ = stage(done, "ids")
        todo, seen = stage(todo.join(done.select(key), key, "left_anti"), "clashes", n=F.count(F.lit(1)))
        if not seen["n"]:
            return submissions.join(done, key)
    raise RuntimeError(f"ids still clash after {max_tries} tries")
