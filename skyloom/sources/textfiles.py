"""CSV and ECSV files as lines with a position, and lines as cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skyloom.operators.ordered import join_back
from skyloom.session import by_key, stage

# everything up to the first # outside quotes; possessive, so that long lines need no backtracking
_BEFORE_COMMENT = r'^((?:[^"#]++|"[^"]*+"?)*+)#.*$'
_PART = r"/part-(\d+)[^/]*$"
# what a line leaves behind that begins outside, or inside, a quoted cell: a quote that is not closed
_OPENED = r'^(?:[^"#]++|"[^"]*+")*+"[^"]*+$'
_STILL_OPEN = r'^[^"]*+$|^[^"]*+"(?:[^"#]++|"[^"]*+")*+"[^"]*+$'
BLOCK = 65_536  # row ids whose lines are put in order by one window
# a column of an ECSV header: its name, quoted or not, and its type
_DECLARED = r"""^# *- *\{ *name: *['"]?([^,'"}]+?)['"]? *, *datatype: *(\w+)"""
_CELL = r',("(?:[^"]|"")*+"|[^,]*+)'
_CELL_SPACE = r' ("(?:[^"]|"")*+"|[^ ]*+)'


def read_lines(spark: SparkSession, paths: str | Sequence[str], names: str = "*") -> DataFrame:
    """Lines of text files with ``path``, ``line`` and ``row_id``, the order of the lines in a file.

    Large files are split over tasks. ``row_id`` is the byte offset of the split plus the position of the
    line in its task: a task reads at most one split's worth of bytes and every line has at least one, so
    that the numbers grow along a file without repeats, but with gaps.

    Files named ``part-<number>...`` are parts of one text: their folder stands for them as ``path``, and the
    numbers grow from part to part. ``names`` is a pattern that file names have to match.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    file = F.col("_metadata.file_path")
    part = F.regexp_extract(file, _PART, 1)
    return spark.read.option("pathGlobFilter", names).schema("value string").text(paths).select(
        F.when(part != "", F.regexp_replace(file, _PART, "")).otherwise(file).alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.coalesce(part.try_cast("bigint"), F.lit(0)) * F.lit(1 << 44) + F.col("_metadata.file_block_start") + in_task).alias("row_id"),
        F.col("value").alias("line"),
    )


def records(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lines joined to records: a quoted cell may go on over line ends. Adds ``_unclosed``.

    Whether a line begins inside a quoted cell follows from all lines before it: a line keeps that state, turns it around
    or, as a # may hide a quote, ends in the same state whatever it began in. So the state after any lines is that of the
    last such line, turned around once for each turning line since. Blocks of lines are summed up first and put
    together by file, so that no file is read by one task. Only files with a line that leaves a quote open take part; the
    lines of all others stay as they are. A record has the ``row_id`` and other columns of its first line. A quote that
    is never closed is no record: its first line alone stays, marked as ``_unclosed``.
    """
    quoted = F.contains(F.col("line"), F.lit('"'))
    ends_open = quoted & F.col("line").rlike(_OPENED)
    # lines are made or read once: all that follows goes over what is stored
    lines, _ = stage(lines.withColumn("_from0", ends_open.cast("int")), "lines")
    by_path = lines.groupBy("path").agg(F.coalesce(F.max("_from0"), F.lit(0)).alias("_open"))
    files, seen = stage(by_path, "open-files", n=F.count(F.lit(1)), n_open=F.count_if(F.col("_open") == 1))
    single = lines.drop("_from0").withColumn("_unclosed", F.lit(False))
    if not seen["n_open"]:
        return single
    files = by_key(files.where("_open = 1").select("path"), seen["n"])
    stays_open = ~quoted | F.col("line").rlike(_STILL_OPEN)
    marked = lines.join(files, "path", "left_semi").withColumns({"_block": F.floor(F.col("row_id") / block), "_from1": stays_open.cast("int")})
    # numbers before names in all keys, as Spark sorts by the first one quickly
    by_block = W.partitionBy("_block", "path").orderBy("row_id")
    upto = by_block.rowsBetween(W.unboundedPreceding, 0)
    fixed = F.col("_from0") == F.col("_from1")
    turns = F.sum((F.col("_from0") > F.col("_from1")).cast("int")).over(upto)
    told = marked.withColumn("_turns", turns).withColumn("_fixed", F.last(F.when(fixed, F.struct(F.col("_from0").alias("state"), "_turns")), True).over(upto))
    # after a line: a state, or null where the block's first state decides, and the turns since
    known = F.when(F.col("_fixed").isNotNull(), (F.col("_fixed.state") + F.col("_turns") - F.col("_fixed._turns")) % 2)
    told = told.withColumns({"_known": known, "_turned": F.col("_turns") % 2}).drop("_fixed", "_turns")
    told, _ = stage(told, "quoted-lines")
    blocks = told.groupBy("path", "_block").agg(F.max_by(F.struct("_known", "_turned"), "row_id").alias("_end"))
    by_file = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    sums = blocks.withColumn("_t", F.sum(F.when(F.col("_end._known").isNull(), F.col("_end._turned")).otherwise(0)).over(by_file)).withColumn(
        "_f", F.last(F.when(F.col("_end._known").isNotNull(), F.struct(F.col("_end._known").alias("state"), "_t")), True).over(by_file)
    )
    state = F.coalesce((F.col("_f.state") + F.col("_t") - F.col("_f._t")) % 2, F.col("_t") % 2)
    begin = sums.select("path", "_block", state.alias("_after")).withColumn(
        "_begin", F.coalesce(F.lag("_after").over(W.partitionBy("path").orderBy("_block")), F.lit(0))
    ).drop("_after")
    stated = join_back(told, begin, ["path", "_block"]).withColumn("_after", F.coalesce("_known", (F.col("_begin") + F.col("_turned")) % 2))
    inside = F.coalesce(F.lag("_after").over(by_block), F.col("_begin"))
    stated = stated.withColumn("_inside", inside).withColumn("_first", F.last(F.when(F.col("_inside") == 0, F.col("row_id")), True).over(upto))
    stated, _ = stage(stated.drop("_known", "_turned", "_begin", "_from0", "_from1"), "stated-lines")
    carried = stated.groupBy("path", "_block").agg(F.max("_first").alias("_last"), F.max_by("_after", "row_id").alias("_open"))
    before = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = carried.withColumns({"_carried": F.max("_last").over(before), "_final": F.last("_open").over(W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
                                   "_end": F.max("_last").over(W.partitionBy("path"))})
    placed = join_back(stated, carried.select("path", "_block", "_carried", "_final", "_end"), ["path", "_block"]).withColumn("_record", F.coalesce("_first", "_carried"))
    unclosed = (F.col("_final") == 1) & (F.col("_record") == F.col("_end"))
    placed = placed.withColumn("_unclosed", unclosed).where(~unclosed | (F.col("row_id") == F.col("_record")))
    others = [c for c in single.columns if c not in ("path", "row_id", "line", "_unclosed")]
    whole = placed.where("_inside = 0 and (_after = 0 or _unclosed)").select(*single.columns)
    parts = placed.where("(_inside = 1 or _after = 1) and not _unclosed").groupBy("_record", "path").agg(
        *[F.min_by(c, "row_id").alias(c) for c in others], F.sort_array(F.collect_list(F.struct("row_id", "line"))).alias("_lines")
    ).select(
        "path", F.col("_record").alias("row_id"), *others, F.array_join(F.col("_lines.line"), "\n").alias("line"), F.lit(False).alias("_unclosed")
    )
    # joined once and stored: what comes next reads records more than once
    joined, _ = stage(whole.unionByName(parts), "records")
    return joined if seen["n_open"] == seen["n"] else single.join(files, "path", "left_anti").unionByName(joined)


def without_comment(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("#")), F.regexp_replace(line, _BEFORE_COMMENT, "$1")).otherwise(line)


def cells(line: Column, space: Column | None = None) -> Column:
    """Cells of a CSV line, unquoted. Where ``space`` is true the delimiter is a blank."""

    def split(text: Column, delimiter: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit(delimiter), text), F.lit(pattern), F.lit(1))
        unquoted = F.transform(
            found,
            lambda c: F.when(
                c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
                F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
            ).otherwise(c),
        )
        return F.when(F.contains(text, F.lit('"')), unquoted).otherwise(F.split(text, delimiter, -1))

    by_comma = split(line, ",", _CELL)
    return by_comma if space is None else F.when(space, split(line, " ", _CELL_SPACE)).otherwise(by_comma)


def _declared_types(line: Column) -> Column:
    """Aggregate of the lines of a file: the columns that its header declares, as array<struct<name, kind>>, a few per file."""
    kind = F.regexp_extract(line, _DECLARED, 2)
    return F.array_sort(F.collect_set(F.when(kind != "", F.struct(F.trim(F.regexp_extract(line, _DECLARED, 1)).alias("name"), kind.alias("kind")))))


def tables(lines: DataFrame, key: str = "path", names: Sequence[str] = ()) -> DataFrame:
    """Body rows of comment-free CSV or ECSV text as ``header`` and ``values`` arrays.

    The first line of a file that is neither blank nor a comment is its header. For many ``names`` their places are
    looked up once per file: ``_at`` has the place of each name (0 if absent), ``_kinds`` the type that an ECSV header
    declares for it (null if none) and ``_cells`` the cells in that order.
    """
    text = without_comment(F.col("line"))
    body_text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r$", "")).otherwise(text)
    split = lines.withColumn("_body", F.when(F.trim(body_text) != "", body_text))
    # one pass finds the place of the header line and the format of every file, from numbers alone: with texts Spark would
    # sort all lines. A second one fetches the few lines that count
    comment = F.col("line").startswith("#")
    firsts = split.groupBy(key).agg(
        F.bool_or(F.col("line").startswith("# %ECSV")).alias("_ecsv"),
        F.bool_or(comment & F.col("line").rlike(r"^# *delimiter: *','")).alias("_comma"),
        F.min(F.when(F.col("_body").isNotNull(), F.col("row_id"))).alias("_first"),
    ).where(F.col("_first").isNotNull())
    firsts, seen = stage(firsts, "first-lines", n=F.count(F.lit(1)))
    is_head = F.col("row_id") == F.col("_first")
    counts = is_head | (comment & F.col("line").rlike(_DECLARED)) if names else is_head
    heads = split.join(by_key(firsts, seen["n"]), key).where(counts).groupBy(key, "_first", "_ecsv", "_comma").agg(
        F.min(F.when(is_head, F.col("_body"))).alias("_head"),
        *([_declared_types(F.col("line")).alias("_declared")] if names else []),
    )
    space = F.col("_ecsv") & ~F.col("_comma")
    body = split.where(F.col("_body").isNotNull()).withColumn("line", F.col("_body")).drop("_body")
    info = heads.select(
        key,
        "_first",
        space.alias("_space"),
        cells(F.col("_head"), space).alias("header"),
        *(["_declared", "_ecsv"] if names else []),
    )
    info = info.withColumn("header", F.transform("header", lambda c: F.trim(c)))
    if names:
        places = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position(F.col("header"), n).cast("int"))
        kinds = F.transform(F.array(*map(F.lit, names)), lambda n: F.get(F.filter("_declared", lambda d: d["name"] == n), F.lit(0))["kind"])
        info = info.withColumn("_at", places).withColumn("_kinds", F.when(F.col("_ecsv"), kinds)).drop("_declared", "_ecsv")
    # one row per file, stored so that Spark knows its size: it goes to the lines, which are not shuffled, if there are few files
    info, _ = stage(info, "headers")
    rows = (
        body.join(by_key(info, seen["n"]), key).where(F.col("row_id") > F.col("_first"))
        .select(
            *[c for c in body.columns if c != "line"], "header", *(["_at", "_kinds"] if names else []),
            cells(F.col("line"), F.col("_space")).alias("values"),
        )
    )
    if names:
        rows = rows.withColumn("_cells", F.transform("_at", lambda at: F.when(at > 0, F.try_element_at(F.col("values"), at))))
    return rows


def cell(name: str) -> Column:
    """Text of a named cell; null where the file has no such column or the line is short."""
    at = F.array_position("header", name)
    return F.when(at > 0, F.try_element_at(F.col("values"), at.cast("int")))


def has(name: str) -> Column:
    return F.array_contains("header", name)
