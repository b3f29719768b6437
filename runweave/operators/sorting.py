"""Global sort, sorted runs, merging of runs, global positions."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from runweave.operators.groups import attach_group_totals
from runweave.operators.layout import (
    PLACE,
    PLACE_BITS,
    Layout,
    numbered_rows,
    ordered_rows,
    place_to_position,
    plan_layout,
    ranged_rows,
)
from runweave.operators.ranges import assign_range, literal_array
from runweave.storage import cut_lineage

# Folder column of a directory of runs.
RUN_ID = "run_id"
# Types (and decimals) whose text form is read back as the same value; keys of any
# other are left to Spark's own ranges.
PLACEABLE = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "string"}


def _names(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def global_sort(
    df: DataFrame, keys: str | list[str], num_partitions: int | None = None
) -> DataFrame:
    """``df`` in ascending order of ``keys``, spread over its partitions.

    A bounded sample places the ranges and decides how they are filled: directly
    where no key stands out; by counts where a key is hot (its rows would meet in
    one task) or where rows are bare keys that repeat (counting replaces sorting).
    Reads ``df`` again for the sort, so its rows must not change in between.
    A result that has rows has ``num_partitions`` partitions if that is given; where
    distinct keys are few, some are empty.
    """
    keys = _names(keys)
    return _sorted_by(plan_layout(df, keys, num_partitions), num_partitions)


def _sorted_by(layout: Layout, num_partitions: int | None) -> DataFrame:
    if layout.crowded or layout.collapsible:
        return ordered_rows(layout, num_partitions)
    df, keys = layout.source, layout.keys
    if all(dict(df.dtypes)[k] in PLACEABLE or dict(df.dtypes)[k].startswith("decimal") for k in keys):
        return ranged_rows(layout, num_partitions or layout.n_ranges)
    if num_partitions is None:
        return df.orderBy(*keys)
    return df.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)


def global_position(
    df: DataFrame, keys: str | list[str], num_ranges: int | None = None
) -> DataFrame:
    """Add ``pos``: each row's 0-based position in ascending order of ``keys``.

    Rows with equal keys are ordered by a hash of their other columns, so the
    result does not depend on partitioning; fully equal rows are
    interchangeable.
    """
    return numbered_rows(plan_layout(df, _names(keys), num_ranges))


def position_in_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """Add ``rn`` (0-based position within ``group``, by ``key``) and
    ``group_rows``.  Groups of any size: positions are global ones less the
    group's first, never a window over a group."""
    sizes = cut_lineage(df.groupBy(group).agg(F.count("*").alias("group_rows")), "group-sizes")
    # A group begins where the groups before it end: one row per group.
    before = W.orderBy(F.asc(group)).rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.withColumn("__first", F.coalesce(F.sum("group_rows").over(before), F.lit(0)))
    placed = global_position(df, [group, key])
    joined = attach_group_totals(placed, totals, group, "group_rows")
    return joined.withColumn("rn", F.col("pos") - F.col("__first")).drop("pos", "__first")


def index_rows(df: DataFrame) -> DataFrame:
    """Number the rows as they lie: partition by partition, in row order.

    The rows are written to shared storage with their partition and place, so
    the numbers and the rows come from one run of the plan.
    """
    stored = cut_lineage(df.withColumn(PLACE, F.monotonically_increasing_id()), "indexed")
    part = F.shiftright(PLACE, PLACE_BITS).alias("part")
    # One row per partition of the plan.
    sizes = {r["part"]: r["n"] for r in stored.groupBy(part).agg(F.count("*").alias("n")).collect()}
    starts = [0]
    for i in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(i, 0))
    return stored.select(place_to_position(starts).alias("pos"), *df.columns)


def sorted_runs(chunked: DataFrame, key: str = "v", chunk: str = "chunk_id") -> DataFrame:
    """Each chunk sorted on its own and kept together under its id.

    The range exchange is on (chunk, key): a chunk larger than a task is
    continued in the next partition, and where rows that agree in both are more
    than a task's worth they are split too.
    """
    return global_sort(chunked, [chunk, key])


def _union(runs: list[DataFrame | None]) -> DataFrame | None:
    runs = [r for r in runs if r is not None]
    return reduce(DataFrame.unionByName, runs) if runs else None


def merge_runs(
    runs: list[DataFrame | None] | str,
    key: str = "v",
    num_partitions: int | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """One ascending sequence from many sorted runs.

    ``runs`` is a list (missing runs are skipped) or a directory with a
    ``run_id=...`` folder per run.  No runs give an empty result, one run is returned as it is.
    """
    spark = spark or SparkSession.getActiveSession()
    if isinstance(runs, str):
        try:
            stored = spark.read.parquet(runs).drop(RUN_ID)
        except AnalysisException as e:
            # A folder without a run yet.
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return spark.createDataFrame([], f"{key} bigint")
        return global_sort(stored, key, num_partitions)
    present = [r for r in runs if r is not None]
    if not present:
        return spark.createDataFrame([], f"{key} bigint")
    if len(present) == 1:
        return present[0]
    return global_sort(_union(present), key, num_partitions)


def range_merge(
    runs: list[DataFrame | None] | DataFrame,
    key: str,
    p: int,
    pivots: list | None = None,
) -> DataFrame:
    """Merge runs range by range: rows in ascending order with their
    ``bucket``.

    The bucket is a label worked out from the key, not the task: a range that
    holds more than its share of the rows (a hot key, uneven pivots) spans as
    many tasks as it needs.  No pivots given: ``p`` ranges of a sample.  No runs
    give an empty result, one run of a list is returned in its own order.
    """
    if isinstance(runs, DataFrame):
        df, ordered = runs, None
    else:
        present = [r for r in runs if r is not None]
        df = _union(present)
        if df is None:
            spark = SparkSession.getActiveSession()
            return spark.createDataFrame([], f"{key} bigint, bucket int")
        ordered = df if len(present) == 1 else None
    # One sample serves the sort and the labels.
    layout = plan_layout(df, [key], p) if pivots is None or ordered is None else None
    if pivots is None:
        drawn = layout.ranges.drawn
        typed = literal_array([t[0] for t in drawn], dict(df.dtypes)[key])
        pivots = df.sparkSession.range(1).select(typed.alias("a")).first()["a"] if drawn else []
    return assign_range(_sorted_by(layout, p) if ordered is None else ordered, key, pivots)
