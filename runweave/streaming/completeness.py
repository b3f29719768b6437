"""Completeness while results arrive: what was planned against what came back.

`check_complete` answers when all is there; here a chunk is reported missing as
soon as its time has passed, and a result that nobody planned as soon as nothing
that is still to come can have planned it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from runweave.operators.validate import check_complete

DONE, MISSING, UNEXPECTED, MISMATCH = "done", "missing", "unexpected", "size_mismatch"
MICRO = timedelta(microseconds=1)


def completeness_stream(
    manifest: DataFrame, results: DataFrame, within: timedelta, lateness: timedelta = timedelta(minutes=1)
) -> DataFrame:
    """``chunk_id, planned_items, n_items, issued, returned, finding`` of a stream of
    planned chunks (``chunk_id, n_items, issued``) and one of results (``chunk_id,
    n_items, returned``).

    A result belongs to a chunk that was issued at most ``within`` before it.  Each
    such pair is a row at once: ``done``, or ``size_mismatch``.  Once the watermark
    (the lesser of both streams' latest times, less ``lateness``) has passed its
    time, a chunk without a result is ``missing``; a result without a chunk, or out
    of its chunk's time, is ``unexpected``.  A chunk that came back twice is two rows.
    State is what was issued or returned in the last ``within`` and ``lateness``.

    Null chunk ids are equal to one another; a null number of items differs from
    any other.  Rows without a time belong to nothing and are left out, as are
    rows that come after the watermark.
    """
    late = f"{lateness // MICRO} microseconds"
    planned = manifest.where("issued is not null").select(
        F.col("chunk_id").alias("__planned"), F.col("n_items").alias("planned_items"), "issued"
    )
    got = results.where("returned is not null").select(F.col("chunk_id").alias("__got"), "n_items", "returned")
    until = F.col("issued") + F.lit(within)
    same = F.col("__planned").eqNullSafe(F.col("__got"))
    in_time = (F.col("returned") >= F.col("issued")) & (F.col("returned") <= until)
    both = planned.withWatermark("issued", late).join(got.withWatermark("returned", late), same & in_time, "full_outer")
    finding = (
        F.when(F.col("returned").isNull(), MISSING)
        .when(F.col("issued").isNull(), UNEXPECTED)
        .when(F.col("planned_items").eqNullSafe(F.col("n_items")), DONE)
        .otherwise(MISMATCH)
    )
    chunk = F.when(F.col("issued").isNull(), F.col("__got")).otherwise(F.col("__planned"))
    return both.select(chunk.alias("chunk_id"), "planned_items", "n_items", "issued", "returned", finding.alias("finding"))


def findings_report(findings: DataFrame) -> DataFrame:
    """The row that `check_complete` gives, from findings that were kept; a result out
    of its chunk's time counts as returned."""
    planned = findings.where("issued is not null").select("chunk_id", F.col("planned_items").alias("n_items"), "issued").distinct()
    return check_complete(planned, findings.where("returned is not null"))
