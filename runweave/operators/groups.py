"""Per-group totals joined back to rows, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runweave.storage import cut_lineage

# Group tables up to this many rows and bytes of group names are broadcast.
MAX_BROADCAST_GROUPS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
# Beyond it: at most this many groups can each hold more than
# 1/HOT_GROUPS of the rows, and only those are broadcast.
HOT_GROUPS = 10_000


def join_totals(df: DataFrame, totals: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """Join on ``group``, null groups included."""
    right = totals.withColumnRenamed(group, "__g")
    joined = df.join(right, F.col(group).eqNullSafe(F.col("__g")), how)
    return joined if how == "left_anti" else joined.drop("__g")


def attach_group_totals(
    df: DataFrame, totals: DataFrame, group: str, rows: str, how: str = "inner"
) -> DataFrame:
    """Add the columns of ``totals`` (one row per group, ``rows`` counting the
    group's rows) to every row of ``df``.

    Few groups: broadcast.  Many: rows of hot groups meet a broadcast of just
    those groups and are not shuffled; all others are joined by a shuffle in
    which no group is large.  The totals are worked out once.
    """
    totals = cut_lineage(totals, "totals")
    named = F.coalesce(F.sum(F.octet_length(F.col(group).cast("string"))), F.lit(0))
    size = totals.agg(F.count("*").alias("groups"), named.alias("bytes")).first()
    if size["groups"] <= MAX_BROADCAST_GROUPS and size["bytes"] <= MAX_BROADCAST_BYTES:
        return join_totals(df, F.broadcast(totals), group, how)
    n_rows = totals.agg(F.sum(rows)).first()[0]
    is_hot = F.col(rows) * HOT_GROUPS > F.lit(n_rows)
    hot = totals.where(is_hot)
    hot_rows = join_totals(df, F.broadcast(hot), group)
    other = join_totals(df, F.broadcast(hot.select(group)), group, "left_anti")
    return hot_rows.unionByName(join_totals(other, totals.where(~is_hot), group, how))
