"""Order of a stored sort, as summaries that can be added up.

A summary of rows that follow one another is ``n, drops, first, last``: how many
there are, how many are less than the one before, and the ends.  Two that follow
one another make one: counts are added, and a last value above the next first is
one drop more.  So pieces are summarised where they lie, kept, and never read
again when others are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runweave.operators.ranges import default_ranges

SUMMARY = ["n", "drops", "first", "last"]


def _falls(before: Column, value: Column) -> Column:
    """Null is the least value and NaN the greatest, as in a sort."""
    return F.coalesce(before.isNotNull() & (value.isNull() | (before > value)), F.lit(False))


def order_summaries(stored: DataFrame, piece: str, place: str, v: str) -> DataFrame:
    """``piece, at, n, drops, first, last``: one row per piece, in the order of its
    places.

    ``place`` numbers the rows as they were written, one up from row to row
    within a task, as that of `sorted_runs_with_ledger`.  Rows are read as they lie,
    in one pass; where places or pieces break off, a new summary begins, and only
    summaries are shuffled.  A null piece is a piece.
    """
    kinds = {c: stored.schema[c].dataType.simpleString() for c in (piece, v)}

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def same(a, b):
            equal = pc.fill_null(pc.equal(a, b), False)
            return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b)))

        def less(after, before):
            found = pc.fill_null(pc.less(after, before), False)
            if pa.types.is_floating(after.type):
                was, is_ = (pc.fill_null(pc.is_nan(x), False) for x in (before, after))
                found = pc.or_(found, pc.and_(was, pc.and_(pc.is_valid(after), pc.invert(is_))))
            return pc.or_(found, pc.and_(pc.is_null(after), pc.is_valid(before)))

        def summary(pieces, at, n, drops, first, last):
            columns = [pieces, at, pa.array(n, pa.int64()), pa.array(drops, pa.int64()), first, last]
            return pa.RecordBatch.from_arrays(columns, ["piece", "at", *SUMMARY])

        # The summary that may go on in the next batch, and its last place.
        held, end = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces, places, values = batch.columns
            at = places.to_numpy(zero_copy_only=False)
            goes_on = (np.diff(at) == 1) & same(pieces[1:], pieces[:-1]).to_numpy(zero_copy_only=False)
            falls = np.zeros(len(at), np.int64)
            falls[1:] = less(values[1:], values[:-1]).to_numpy(zero_copy_only=False) & goes_on
            starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            ends = np.append(starts[1:], len(at))
            n, drops = ends - starts, np.add.reduceat(falls, starts)
            heads, tails = pa.array(starts), pa.array(ends - 1)
            firsts, begins, kept = values.take(heads), places.take(heads), pieces.take(heads)
            if held is not None:
                if at[0] == end + 1 and same(kept[:1], held.column("piece"))[0].as_py():
                    n[0] += held.column("n")[0].as_py()
                    drops[0] += held.column("drops")[0].as_py() + less(values[:1], held.column("last"))[0].as_py()
                    firsts = pa.concat_arrays([held.column("first"), firsts[1:]])
                    begins = pa.concat_arrays([held.column("at"), begins[1:]])
                else:
                    yield held
            out = summary(kept, begins, n, drops, firsts, values.take(tails))
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held, end = out.slice(out.num_rows - 1), at[-1]
        if held is not None:
            yield held

    rows = stored.select(F.col(piece), F.col(place).cast("bigint"), F.col(v))
    schema = f"piece {kinds[piece]}, at bigint, n bigint, drops bigint, first {kinds[v]}, last {kinds[v]}"
    return merge_summaries(rows.mapInArrow(scan, schema)).withColumnRenamed("piece", piece)


def merge_summaries(parts: DataFrame, piece: str = "piece") -> DataFrame:
    """One summary per piece from several that follow one another by ``at``."""
    # As many rows as tasks and batches have read of a piece.
    before = F.lag("last").over(W.partitionBy(piece).orderBy("at"))
    seen = parts.withColumn("__seam", _falls(before, F.col("first")).cast("bigint"))
    return seen.groupBy(piece).agg(
        F.min("at").alias("at"),
        F.sum("n").alias("n"),
        (F.sum("drops") + F.sum("__seam")).alias("drops"),
        F.min_by("first", "at").alias("first"),
        F.max_by("last", "at").alias("last"),
    )


def check_summaries(summaries: DataFrame, piece: str) -> DataFrame:
    """``n, inner_violations, boundary_violations, is_sorted`` of pieces that follow
    one another in the order of ``piece``: what `check_sorted` finds in the rows."""
    parts = default_ranges(summaries, summaries.count())
    dealt = summaries.repartitionByRange(parts, piece).withColumn("__part", F.spark_partition_id())
    before = F.lag("last").over(W.partitionBy("__part").orderBy(piece))
    seen = dealt.withColumn("__seam", _falls(before, F.col("first")).cast("bigint"))
    place = F.struct(piece)
    edges = seen.groupBy("__part").agg(
        F.sum("n").alias("n"),
        F.sum("drops").alias("inner"),
        F.sum("__seam").alias("seams"),
        F.min_by("first", place).alias("first"),
        F.max_by("last", place).alias("last"),
    )
    # One row per range of pieces.
    rest = _falls(F.lag("last").over(W.orderBy("__part")), F.col("first")).cast("bigint")
    inner, boundary = (F.coalesce(F.sum(c), F.lit(0)) for c in ("inner", "boundary"))
    return edges.select("n", "inner", (F.col("seams") + rest).alias("boundary")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        inner.alias("inner_violations"),
        boundary.alias("boundary_violations"),
        (inner + boundary == 0).alias("is_sorted"),
    )
