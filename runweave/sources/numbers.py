"""Number files: one integer per line, no header."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from runweave.operators.groups import attach_group_totals
from runweave.storage import cut_lineage, file_system

#: Columns that restore the order of lines across files and file splits.
LINE_ORDER = ["src_file", "src_block", "src_row"]
# White space at either end of a line, beyond ASCII too.
MARGIN = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
# What is left must be digits; a cast alone would forgive control characters.
INTEGER = r"^[+-]?[0-9]+$"
# Names of local files come with and without their empty host.
EMPTY_HOST = r"^([^:/]+):///"


def read_numbers(
    spark: SparkSession, path: str, mode: str = "strict", line_order: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Numbers of the file or directory ``path`` as ``v bigint``.

    Blank lines are skipped.  ``strict``: one bad line fails whatever job
    reads the result, even a bare count.  ``permissive``: returns the numbers
    and, as a second table, the rejected lines.  ``line_order`` adds the
    LINE_ORDER columns.
    """
    order = []
    if line_order:
        order = [
            F.col("_metadata.file_path").alias(LINE_ORDER[0]),
            F.col("_metadata.file_block_start").alias(LINE_ORDER[1]),
            F.monotonically_increasing_id().alias(LINE_ORDER[2]),
        ]
    kept = LINE_ORDER if line_order else []
    lines = _parsed(spark, path, order, kept)
    good = F.col("v").isNotNull()
    if mode == "permissive":
        return lines.where(good).select("v", *kept), lines.where(~good).select("line", *kept)
    if mode != "strict":
        raise ValueError("mode is 'strict' or 'permissive'")
    bad = F.raise_error(F.concat(F.lit("not an integer: "), F.col("line"))).cast("boolean")
    # A filter, because a projection nobody reads would be pruned unchecked.
    return lines.where(F.when(good, True).otherwise(bad)).select("v", *kept)


def _parsed(spark: SparkSession, path: str, order: list, kept: list[str]) -> DataFrame:
    """Lines that are not blank, with their number or null."""
    text = spark.read.text(path).select(F.regexp_replace("value", MARGIN, "").alias("line"), *order)
    number = F.when(F.col("line").rlike(INTEGER), F.expr("try_cast(line AS bigint)")).alias("v")
    return text.where(F.col("line") != "").select("line", number, *kept)


def read_number_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Numbers of the good files of ``path``, file by file, and a report.

    A file with a line that is no number gives nothing; one without any line that
    is not blank is ``blank``.  Numbers are ``file, v``; the report has a row per file:
    ``file, status`` (``good``, ``blank``, ``bad``), ``numbers`` it gives, lines
    ``rejected`` and the ``first_rejected``.

    Lines are read twice.  Files of any size: their verdicts are joined to the
    lines as totals of groups are.
    """
    file, block, row = LINE_ORDER
    order = [
        F.regexp_replace("_metadata.file_path", EMPTY_HOST, "$1:/").alias(file),
        F.struct(F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(row)).alias("__at"),
    ]
    lines = _parsed(spark, path, order, [file, "__at"])
    bad = F.col("v").isNull()
    totals = lines.groupBy(F.col(file).alias("file")).agg(
        F.count("*").alias("__lines"),
        F.count_if(bad).alias("rejected"),
        F.min(F.when(bad, F.struct("__at", "line"))).getField("line").alias("first_rejected"),
    )
    totals = cut_lineage(totals, "files")
    # Scans leave out files without a byte, so names come from the driver's list of files.
    listed = [(re.sub(EMPTY_HOST, r"\1:/", f),) for f in spark.read.text(path).inputFiles()]
    names = spark.createDataFrame(listed, "file string")
    status = F.when(F.col("__lines").isNull(), "blank").when(F.col("rejected") > 0, "bad").otherwise("good")
    none = F.lit(0).cast("bigint")
    report = names.join(totals, "file", "left").select(
        "file", status.alias("status"), F.when(status == "good", F.col("__lines")).otherwise(none).alias("numbers"),
        F.coalesce("rejected", none).alias("rejected"), "first_rejected",
    )
    verdicts = totals.select("file", "__lines", "rejected")
    judged = attach_group_totals(lines.select(F.col(file).alias("file"), "v"), verdicts, "file", "__lines")
    return judged.where("rejected = 0").select("file", "v"), report


def number_lines(lines: DataFrame) -> DataFrame:
    """Replace the LINE_ORDER columns of lines as read by ``pos``, their 0-based
    place in file name and line order.

    A file split is read by one task in order, so a line's place is the lines
    of all earlier splits plus its own place in its split.  Only the splits are
    counted and put in order, one row each; no line is shuffled.  Lines are read
    twice; should the second reading split the files in another way, it fails.
    """
    file, block, _ = LINE_ORDER
    split, row = "__split", "__row"
    # A fresh counter: lines left out so far leave no gaps.
    lines = lines.select(
        *[c for c in lines.columns if c not in LINE_ORDER],
        F.struct(file, block).alias(split),
        F.monotonically_increasing_id().alias(row),
    )
    splits = lines.groupBy(split).agg(F.count("*").alias("__n"), F.min(row).alias("__first"))
    before = F.sum("__n").over(W.orderBy(split).rowsBetween(W.unboundedPreceding, -1))
    starts = splits.withColumn("__start", F.coalesce(before, F.lit(0)))
    placed = attach_group_totals(lines, starts, split, "__n", how="left")
    moved = F.raise_error(F.lit("file splits changed between two readings")).cast("bigint")
    pos = F.coalesce("__start", moved) + F.col(row) - F.col("__first")
    return placed.select(pos.alias("pos"), *[c for c in lines.columns if c not in (split, row)])


def write_numbers(df: DataFrame, path: str, col: str = "v", mode: str = "overwrite") -> int:
    """Write one value per line, in the order of ``df``'s partitions: the name
    order of the part files is the order of the values.  Returns the number of
    lines; an empty table leaves a file with a single newline.  What was at
    ``path`` is replaced, unless ``mode`` (as of a DataFrame writer) says otherwise:
    the new files are written beside it and take its place when all are there, so a
    job that dies leaves the old ones, and ``df`` may read what it replaces.
    """
    spark = df.sparkSession
    if mode != "overwrite":
        return _write_lines(df, path, col, mode)
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        n = _write_lines(df, staged, col, "error")
        _replace(spark, staged, path, old)
    finally:
        files, left = file_system(spark, staged)
        files.delete(left, True)
    return n


def _write_lines(df: DataFrame, path: str, col: str, mode: str) -> int:
    seen = Observation()
    lines = df.select(F.col(col).cast("string").alias("value"))
    lines.observe(seen, F.count("*").alias("n")).write.mode(mode).text(path)
    n = seen.get.get("n", 0)
    if n == 0:
        df.sparkSession.createDataFrame([("",)], "value string").write.mode("append").text(path)
    return n


def _replace(spark: SparkSession, staged: str, path: str, old: str) -> None:
    """Put ``staged`` in the place of ``path``; what was there comes back if that fails."""
    files, target = file_system(spark, path)
    new, aside = (file_system(spark, p)[1] for p in (staged, old))
    had = files.exists(target)
    if had and not files.rename(target, aside):
        raise OSError(f"cannot replace {path}")
    if not files.rename(new, target):
        if had:
            files.rename(aside, target)
        raise OSError(f"cannot write {path}")
    if had:
        files.delete(aside, True)
