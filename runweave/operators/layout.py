"""Exact range layout: which task gets which rows, known before the shuffle.

Rows are cut into value ranges by sampled pivots and counted per range in one
pass that shuffles only the counts.  From the counts every range knows the
global position of its first row, so positions and ordered output need one
shuffle of the rows and no single-task step.

Keys that hold a range's worth of rows or more show up as repeated pivots.
Their rows are then placed by their other columns too.  Rows equal in those as
well are carried as a count and written out again by as many tasks as they need.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from runweave.functions.rows import row_hash
from runweave.operators.ranges import (
    SampledRanges,
    default_ranges,
    is_hot,
    literal_array,
    range_number,
    sample_ranges,
)

# Names of helper columns.
TIE, RANGE, HOT, PART = "__tie", "__range", "__hot", "__part"
COPIES, START, BLOCK, PLACE = "__n", "__start", "__block", "__place"
# monotonically_increasing_id(): the partition, then 33 bits of row number.
PLACE_BITS = 33
# Longest array one row is expanded through.
COPIES_PER_ARRAY = 65_536
# Copies of a hot row written by one input row of the expansion.
COPIES_PER_BLOCK = 1_048_576


@dataclass(frozen=True)
class Layout:
    source: DataFrame
    columns: list[str]
    keys: list[str]
    #: Columns that place a row: the keys and, where a key is crowded, a hash
    #: of all other columns, so that its rows can still be told apart.
    split: list[str]
    n_rows: int
    n_ranges: int
    ranges: SampledRanges
    #: Some key has about a range's worth of rows or more.
    crowded: bool

    @cached_property
    def ranged(self) -> DataFrame:
        return range_number(self.source, self.split, self.ranges.pivots, RANGE)

    @property
    def rest(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    @property
    def skewed(self) -> bool:
        """As many rows are equal in all of `split`."""
        return bool(self.ranges.hot)

    @property
    def collapsible(self) -> bool:
        """Rows are nothing but their key, and keys repeat: counts per key
        describe the data in far fewer rows."""
        return not self.rest and self.ranges.repetitive


def plan_layout(
    df: DataFrame, keys: list[str], n_ranges: int | None = None
) -> Layout:
    """Sample the keys; only where one is crowded are other columns read."""
    columns = list(df.columns)
    rest = [c for c in columns if c not in keys]
    n_rows = df.count()
    p = n_ranges or default_ranges(df, n_rows)
    source, split = df, list(keys)
    ranges = sample_ranges(source, split, n_rows, p)
    crowded = bool(ranges.hot)
    if crowded and rest:
        source, split = df.withColumn(TIE, row_hash(df, rest)), [*keys, TIE]
        ranges = sample_ranges(source, split, n_rows, p)
    return Layout(source, columns, list(keys), split, n_rows, p, ranges, crowded)


@dataclass(frozen=True)
class Slots:
    """Tasks and start positions per range; one number per range each."""

    part_of_range: list[int]
    start_of_part: list[int]
    n_parts: int
    hot: DataFrame | None


def _slots(layout: Layout) -> Slots:
    """Count rows per range (hot rows apart) and number the tasks in order.

    The counts have one row per range and hot row, so the driver's share is
    bounded by the number of ranges whatever the data.
    """
    spark = layout.source.sparkSession
    ranged = layout.ranged
    if layout.skewed:
        row = F.when(is_hot(ranged, layout.ranges, RANGE), F.struct(*layout.columns))
    else:
        row = F.lit(None).cast("int")
    totals = (
        ranged.select(RANGE, row.alias(HOT)).groupBy(RANGE, HOT).agg(F.count("*").alias(COPIES))
    )
    values = [F.col(HOT)[c].alias(c) for c in layout.columns] if layout.skewed else []
    counts = totals.select(RANGE, COPIES, F.col(HOT).isNotNull().alias("is_hot"), *values)
    ordered = counts.toArrow().sort_by([(RANGE, "ascending"), ("is_hot", "descending")])
    numbers = ordered.column(RANGE).to_pylist()
    copies = ordered.column(COPIES).to_pylist()
    hot_flags = ordered.column("is_hot").to_pylist()

    size = max(1, ceil(layout.n_rows / layout.n_ranges))
    part_of_range = [0] * (len(layout.ranges.pivots) + 1)
    start_of_part: list[int] = []
    hot_start, hot_part, hot_block = [], [], []
    position = 0
    for number, n, hot in zip(numbers, copies, hot_flags):
        if hot:
            parts = ceil(n / size)
            block = ceil(n / parts)
            hot_start.append(position)
            hot_part.append(len(start_of_part))
            hot_block.append(block)
            start_of_part += [position + i * block for i in range(parts)]
        else:
            part_of_range[number] = len(start_of_part)
            start_of_part.append(position)
        position += n

    hot_rows = None
    if hot_start:
        picked = ordered.filter(ordered.column("is_hot"))
        for name, values in ((START, hot_start), (PART, hot_part), (BLOCK, hot_block)):
            picked = picked.append_column(name, [values])
        hot_rows = spark.createDataFrame(picked).select(
            *layout.columns, COPIES, START, PART, BLOCK
        )
    return Slots(part_of_range, start_of_part, max(1, len(start_of_part)), hot_rows)


def _cold(layout: Layout, slots: Slots) -> DataFrame:
    """Every row that is not hot, with the task it belongs to."""
    df = layout.ranged
    if slots.hot is not None:
        df = df.where(~is_hot(df, layout.ranges, RANGE))
    part = F.get(literal_array(slots.part_of_range, "int"), F.col(RANGE))
    return df.withColumn(PART, part).drop(RANGE)


def _collapsed(layout: Layout, slots: Slots) -> DataFrame:
    """One row per key with its number of copies; the copies of a key are
    added up before and after the exchange."""
    return (
        _cold(layout, slots)
        .groupBy(PART, *layout.split)
        .agg(F.count("*").alias(COPIES))
    )


def _hot_blocks(slots: Slots) -> DataFrame:
    """Hot rows cut into blocks of copies, each naming its task."""
    keep = [c for c in slots.hot.columns if c not in (COPIES, START, PART, BLOCK)]
    parts = slots.hot.withColumn(
        "__p", F.explode(F.expr(f"sequence(0L, ({COPIES} - 1) div {BLOCK})"))
    ).withColumn("__base", F.col("__p") * F.col(BLOCK))
    parts = parts.withColumn("__len", F.least(F.col(BLOCK), F.col(COPIES) - F.col("__base")))
    blocks = parts.withColumn(
        "__at", F.explode(F.expr(f"sequence(0L, __len - 1, {COPIES_PER_BLOCK}L)"))
    )
    return blocks.select(
        *keep,
        (F.col(START) + F.col("__base") + F.col("__at")).alias(START),
        (F.col(PART) + F.col("__p")).cast("int").alias(PART),
        F.least(F.lit(COPIES_PER_BLOCK), F.col("__len") - F.col("__at")).alias(COPIES),
    )


def _expand(df: DataFrame, position: str | None = None) -> DataFrame:
    """Write each row COPIES times, in place; positions count up from START."""
    keep = [c for c in df.columns if c not in (COPIES, START)]
    df = df.withColumn(
        "__lo", F.explode(F.expr(f"sequence(0L, {COPIES} - 1, {COPIES_PER_ARRAY}L)"))
    )
    hi = F.least(F.col("__lo") + (COPIES_PER_ARRAY - 1), F.col(COPIES) - 1)
    df = df.withColumn("__i", F.explode(F.sequence(F.col("__lo"), hi)))
    if position is None:
        return df.select(*keep)
    return df.select((F.col(START) + F.col("__i")).alias(position), *keep)


def _spread(blocks: DataFrame) -> DataFrame:
    """Hand the blocks of hot rows to all tasks before they are expanded."""
    return blocks.repartition(PART, START)


def _sorted_parts(
    layout: Layout, rows: DataFrame, n_parts: int, part: str = PART, ties: bool = False
) -> DataFrame:
    """Rows in their tasks and in order there; a task holds one part, so it
    need not sort by part.  ``ties`` also puts rows with equal keys in an order
    that is the same every time."""
    parts = rows.repartitionById(n_parts, part)
    if ties and layout.rest:
        return parts.sortWithinPartitions(*layout.keys, row_hash(parts, layout.rest))
    return parts.sortWithinPartitions(*layout.keys)


def ordered_rows(layout: Layout, n_parts: int | None = None) -> DataFrame:
    """All rows, partition by partition in ascending order.  With ``n_parts``
    neighbouring parts share a task, so that there are that many tasks, each with
    the parts that begin in its equal share of the positions."""
    slots = _slots(layout)
    task, n_tasks = None, slots.n_parts
    if n_parts is not None:
        shares = [at * n_parts // max(1, layout.n_rows) for at in slots.start_of_part]
        task, n_tasks = F.get(literal_array(shares, "int"), F.col(PART)), n_parts
    if layout.collapsible:
        rows = _collapsed(layout, slots)
        if slots.hot is not None:
            rows = rows.unionByName(_hot_blocks(slots).drop(START))
    else:
        rows = _cold(layout, slots)
        if slots.hot is not None:
            hot = _expand(_spread(_hot_blocks(slots)))
            rows = rows.select(PART, *layout.columns).unionByName(hot)
    if task is not None:
        rows = rows.withColumn(PART, task)
    rows = _sorted_parts(layout, rows, n_tasks)
    if layout.collapsible:
        rows = _expand(rows)
    return rows.select(*layout.columns)


def ranged_rows(layout: Layout, n_parts: int) -> DataFrame:
    """All rows in ascending order by the sampled ranges alone, without counts:
    for keys of which none is crowded."""
    return _sorted_parts(layout, layout.ranged, n_parts, RANGE).select(*layout.columns)


def numbered_rows(layout: Layout, position: str = "pos") -> DataFrame:
    """All rows with their 0-based position in ascending order.

    A row's position is its part's start plus its place in the sorted part;
    both halves of that come out of `monotonically_increasing_id`, which costs
    a counter where a window would sort by part and key.  Hot rows are
    numbered from their counts alone and never shuffled.
    """
    slots = _slots(layout)
    if layout.collapsible:
        rows = _expand(_sorted_parts(layout, _collapsed(layout, slots), slots.n_parts))
    else:
        rows = _sorted_parts(layout, _cold(layout, slots), slots.n_parts, ties=True)
    rows = rows.select(F.monotonically_increasing_id().alias(PLACE), *layout.columns)
    rows = rows.select(place_to_position(slots.start_of_part).alias(position), *layout.columns)
    if slots.hot is not None:
        hot = _expand(_spread(_hot_blocks(slots)), position)
        rows = rows.unionByName(hot.select(position, *layout.columns))
    return rows


def place_to_position(start_of_part: list[int]) -> Column:
    """Position of a row whose PLACE is the id Spark gave it where it lay."""
    start = F.get(
        literal_array(start_of_part, "bigint"), F.shiftright(PLACE, PLACE_BITS).cast("int")
    )
    return start + F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
