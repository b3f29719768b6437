"""Checks of a sort: order, conservation, completeness, session seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runweave.functions.scalars import chunk_seed
from runweave.functions.rows import row_hash
from runweave.operators.ranges import default_ranges, range_number, sample_ranges

MASTER = "Master Node"


def check_sorted(
    df: DataFrame, chunk: str, seq: str, v: str, num_ranges: int | None = None
) -> DataFrame:
    """One row: ``n, inner_violations, boundary_violations, is_sorted``.

    Rows are read in the order (chunk, seq).  A row less than the one before
    it is a violation: inner within a chunk, boundary between two chunks.  Nulls
    are least and NaN is greatest.  Rows at the same place have no order among
    each other and are read in that of their values, so the answer does not depend
    on how rows lie.

    Ranges of (chunk, seq, value) are checked side by side, then the seams between
    ranges from one row per range, so neither the size of a chunk nor of a place
    matters.  Where the sample shows rows equal in all three, they are counted
    before they meet.
    """
    rows = df.select(F.col(chunk).alias("c"), F.col(seq).alias("s"), F.col(v).alias("v"))
    n_rows = rows.count()
    p = num_ranges or default_ranges(df, n_rows)
    place = ["c", "s", "v"]
    ranges = sample_ranges(rows, place, n_rows, p)
    pivots = ranges.pivots
    if ranges.hot:
        rows = rows.groupBy(*place).agg(F.count("*").alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1).cast("bigint"))
    ranged = range_number(rows, place, pivots, "r").repartitionById(len(pivots) + 1, "r")

    def drops(order: W, this_c: str, this_v: str, prev_c: str, prev_v: str) -> list[Column]:
        c, v = F.lag(prev_c).over(order), F.lag(prev_v).over(order)
        # Null is the least value and NaN the greatest, as in a sort.
        drop = v.isNotNull() & (F.col(this_v).isNull() | (v > F.col(this_v)))
        same = c.eqNullSafe(F.col(this_c))
        return [(drop & same).alias("inner"), (drop & ~same).alias("boundary")]

    def count(name: str):
        return F.count_if(F.coalesce(F.col(name), F.lit(False)))

    inside = ranged.select(
        "r", "n", *place, *drops(W.partitionBy("r").orderBy(*place), "c", "v", "c", "v")
    )
    place = F.struct(*place)
    edges = inside.groupBy("r").agg(
        F.sum("n").alias("n"),
        count("inner").alias("inner_in"),
        count("boundary").alias("boundary_in"),
        F.min_by("v", place).alias("first_v"),
        F.max_by("v", place).alias("last_v"),
        F.min("c").alias("first_c"),
        F.max("c").alias("last_c"),
    )
    # One row per range.
    seams = edges.select(
        "n",
        "inner_in",
        "boundary_in",
        *drops(W.orderBy("r"), "first_c", "first_v", "last_c", "last_v"),
    )
    inner = F.coalesce(F.sum("inner_in"), F.lit(0)) + count("inner")
    boundary = F.coalesce(F.sum("boundary_in"), F.lit(0)) + count("boundary")
    return seams.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        inner.alias("inner_violations"),
        boundary.alias("boundary_violations"),
        (inner + boundary == 0).alias("is_sorted"),
    )


def check_order(df: DataFrame, col: str) -> DataFrame:
    """One row: ``n, violations, is_sorted`` for ``col`` in the order the rows
    of ``df`` lie, partition after partition.

    The check of a finished sort: each task compares neighbours in Arrow
    batches, carrying the last value from batch to batch, and reports its first
    and last value; nothing is shuffled but those.  Nulls come first, NaN last.
    """
    dtype = df.schema[col].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        n = drops = 0
        first = last = None
        for batch in batches:
            values = batch.column(0)
            if not len(values):
                continue
            if n == 0:
                first = values[:1]
                before, after = values[:-1], values[1:]
            else:
                before, after = pa.concat_arrays([last, values[:-1]]), values
            less = pc.fill_null(pc.less(after, before), False)
            lost = pc.and_(pc.is_null(after), pc.is_valid(before))
            if pa.types.is_floating(values.type):
                # Arrow finds nothing less than NaN.
                was, is_ = (pc.fill_null(pc.is_nan(x), False) for x in (before, after))
                less = pc.or_(less, pc.and_(was, pc.and_(pc.is_valid(after), pc.invert(is_))))
            drops += pc.sum(pc.or_(less, lost)).as_py() or 0
            n += len(values)
            last = values[-1:]
        if n:
            counts = [pa.array([x], t) for x, t in (
                (TaskContext.get().partitionId(), pa.int32()), (n, pa.int64()), (drops, pa.int64())
            )]
            yield pa.RecordBatch.from_arrays(
                counts + [first, last], names=["part", "n", "drops", "first", "last"]
            )

    parts = df.select(col).mapInArrow(
        scan, f"part int, n bigint, drops bigint, first {dtype}, last {dtype}"
    )
    # One row per partition.
    before = F.lag("last").over(W.orderBy("part"))
    seam = before.isNotNull() & (F.col("first").isNull() | (F.col("first") < before))
    violations = F.coalesce(F.sum("drops"), F.lit(0)) + F.count_if("seam")
    return parts.withColumn("seam", seam).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        violations.alias("violations"),
        (violations == 0).alias("is_sorted"),
    )


def check_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: row counts on both sides, whether they are equal, and whether
    the rows themselves are (order aside, by a sum of row hashes in which nulls
    count; 0.0 and -0.0 are the same)."""

    # Four 16-bit lanes of the hash: their sums fit a bigint for 10**14 rows.
    lanes = [f"h{i}" for i in range(4)]

    def side(df: DataFrame, sign: int) -> DataFrame:
        # Aggregated before they meet: one row a side.
        h = row_hash(df, df.columns)
        sums = [
            F.coalesce(F.sum(F.shiftright(h, 16 * i).bitwiseAND(0xFFFF)), F.lit(0)).alias(lane)
            for i, lane in enumerate(lanes)
        ]
        return df.agg(F.count("*").alias("n"), *sums).withColumn("side", F.lit(sign))

    both = side(before, 1).unionByName(side(after.select(*before.columns), -1))
    content_ok = F.lit(True)
    for lane in lanes:
        content_ok = content_ok & (F.sum(F.col(lane) * F.col("side")) == 0)
    return both.agg(
        F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("n_before"),
        F.sum(F.when(F.col("side") == -1, F.col("n"))).alias("n_after"),
        (F.sum(F.col("n") * F.col("side")) == 0).alias("count_ok"),
        content_ok.alias("content_ok"),
    )


def chunk_report(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per chunk: planned or not, results returned, items planned and returned.

    Both tables are stacked and grouped once; partial sums make a chunk with
    very many results as cheap as any other.
    """
    planned = manifest.select(
        "chunk_id", F.lit(1).alias("planned"), F.lit(0).alias("results"),
        F.col("n_items").alias("planned_items"), F.lit(None).cast("bigint").alias("lo"),
        F.lit(None).cast("bigint").alias("hi"),
    )
    returned = ledger.select(
        "chunk_id", F.lit(0).alias("planned"), F.lit(1).alias("results"),
        F.lit(None).cast("bigint").alias("planned_items"),
        F.col("n_items").alias("lo"), F.col("n_items").alias("hi"),
    )
    return (
        planned.unionByName(returned)
        .groupBy("chunk_id")
        .agg(
            F.sum("planned").alias("planned"),
            F.sum("results").alias("results"),
            F.sum("planned_items").alias("planned_items"),
            F.min("lo").alias("least_items"),
            F.max("hi").alias("most_items"),
        )
    )


def check_complete(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: ``chunks, results, missing, duplicate, unexpected,
    size_mismatch, complete``."""
    planned, results = F.col("planned") > 0, F.col("results")
    differs = (F.col("least_items") != F.col("planned_items")) | (
        F.col("most_items") != F.col("planned_items")
    )

    def count(cond) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    faults = {
        "missing": planned & (results == 0),
        "duplicate": results > 1,
        "unexpected": ~planned,
        "size_mismatch": planned & (results > 0) & differs,
    }
    counts = chunk_report(manifest, ledger).agg(
        F.coalesce(F.sum("planned"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("results"), F.lit(0)).alias("results"),
        *[count(c).alias(name) for name, c in faults.items()],
    )
    clean = F.lit(True)
    for name in faults:
        clean = clean & (F.col(name) == 0)
    return counts.withColumn("complete", clean)


def audit_seeds(ledger: DataFrame, session_seed: int, master: str = MASTER) -> DataFrame:
    """One row: how many chunks done by workers returned the session's seed
    (``all_verified`` is null where no worker did any), and how many chunks
    carry a seed that does not follow from it."""
    by_worker = F.col("worker_name") != master
    same = F.coalesce(F.col("session_seed") == session_seed, F.lit(False))
    wrong = ~F.col("seed").eqNullSafe(chunk_seed(session_seed, "chunk_id"))
    return ledger.agg(
        F.count_if(by_worker).alias("worker_chunks"),
        F.count_if(by_worker & same).alias("verified"),
        F.count_if(wrong).alias("wrong_chunk_seeds"),
    ).withColumn(
        "all_verified",
        F.when(F.col("worker_chunks") > 0, F.col("verified") == F.col("worker_chunks")),
    )
