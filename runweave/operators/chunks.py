"""Positional chunks, run pivots and proportional shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runweave.operators.groups import attach_group_totals, join_totals
from runweave.operators.layout import numbered_rows, plan_layout
from runweave.operators.ranges import literal_array, sample_ranges
from runweave.operators.selection import INTEGERS, select_ranks, strided_values
from runweave.operators.sorting import global_position, position_in_group
from runweave.storage import cut_lineage

# Chunks per node of a distributed run, and the least and
# greatest size of a chunk.
CHUNKS_PER_NODE = 32
MIN_CHUNK = 10_000
MAX_CHUNK = 500_000
# Fixed value: about how many samples a sorted run contributes to the pivots.
SAMPLES_PER_RUN = 2_000


def chunk_size(
    n_rows: int,
    units: int,
    per_unit: int = CHUNKS_PER_NODE,
    min_size: int = MIN_CHUNK,
    max_size: int = MAX_CHUNK,
) -> int:
    """Rows per chunk so that each unit gets about ``per_unit`` chunks."""
    wanted = -(-n_rows // max(units * per_unit, 1))
    return min(max(min_size, wanted), max_size)


def assign_chunks(
    df: DataFrame,
    order_by: str | list[str],
    units: int,
    per_unit: int = CHUNKS_PER_NODE,
    min_size: int = MIN_CHUNK,
    max_size: int = MAX_CHUNK,
) -> DataFrame:
    """Add ``pos`` and ``chunk_id`` (from 1): contiguous chunks of the rows in
    the order of ``order_by``."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    layout = plan_layout(df, keys)
    size = chunk_size(layout.n_rows, units, per_unit, min_size, max_size)
    return numbered_rows(layout).withColumn("chunk_id", F.expr(f"pos div {size}L + 1"))


def chunk_manifest(chunked: DataFrame, col: str = "v") -> DataFrame:
    """Rows, least and greatest value per chunk."""
    return chunked.groupBy("chunk_id").agg(
        F.count("*").alias("n_items"), F.min(col).alias("lo"), F.max(col).alias("hi")
    )


def _evenly(n: int, p: int) -> list[int]:
    """Indices of ``p - 1`` entries of ``n``; the spacing is a double, cut off to a
    whole index."""
    spacing = (n - 1) / p
    return [int(i * spacing) for i in range(1, p)]


def range_pivots(
    df: DataFrame, col: str, p: int, method: str = "approx", run: str | None = None
) -> list:
    """``p - 1`` ascending pivots that cut ``col`` into ``p`` ranges.

    ``approx`` takes them from a bounded random sample, which holds all rows of
    a small table; so they are exact there and close to it beyond, and only
    their rank error is promised.  ``stride`` is exact:
    every (rows/2000)-th value of each sorted ``run``, pooled, then evenly
    spaced entries of the pool.  For integers that takes counts alone, see
    `strided_values`; values of other types are put in order.
    """
    if method == "approx":
        drawn = sample_ranges(df, [col], df.count(), p).drawn
        if not drawn:
            return []
        typed = literal_array([t[0] for t in drawn], dict(df.dtypes)[col])
        return df.sparkSession.range(1).select(typed.alias("a")).first()["a"]
    if method != "stride":
        raise ValueError("method is 'approx' or 'stride'")
    if dict(df.dtypes)[col] in INTEGERS:
        keyed = df.withColumn("__run", F.lit(0)) if run is None else df.withColumnRenamed(run, "__run")
        pool = cut_lineage(strided_values(keyed, col, "__run", SAMPLES_PER_RUN), "pool")
        sizes = pool.agg(
            F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("m"))), F.lit(0)).alias("nulls")
        ).first()
        if sizes["n"] == 0 or p < 2:
            return []
        wanted = _evenly(sizes["n"], p)
        # Nulls come first.
        later = [at - sizes["nulls"] for at in wanted if at >= sizes["nulls"]]
        return [None] * (len(wanted) - len(later)) + select_ranks(pool, "v", later, weight="m")
    source = df.select(F.lit(0).alias("__run") if run is None else F.col(run).alias("__run"), col)
    stride = F.greatest(F.lit(1), F.expr(f"group_rows div {SAMPLES_PER_RUN}"))
    placed = position_in_group(source, "__run", col)
    pool = cut_lineage(placed.where(F.col("rn") % stride == 0).select(col), "pool")
    n = pool.count()
    if n == 0 or p < 2:
        return []
    wanted = _evenly(n, p)
    picked = global_position(pool, col).where(F.col("pos").isin(sorted(set(wanted))))
    at = {r["pos"]: r[col] for r in picked.collect()}
    return [at[i] for i in wanted]


def apportion(
    df: DataFrame, group: str, order: str, weight: str, total: int, method: str = "weighted"
) -> DataFrame:
    """Add ``share``: each group's rows divide ``total`` among them.

    ``weighted``: by weight, halves rounded to even; ``equal``: the whole
    quotient.  The row last in ``order`` (unique within the group) takes what
    is left, so shares always add up to ``total``.  A null weight is 0; a group whose
    weights add up to 0 divides equally.
    """
    totals = df.groupBy(group).agg(
        F.count("*").alias("__rows"),
        F.sum(weight).alias("__weights"),
        F.max(order).alias("__last"),
    )
    rows = attach_group_totals(df, totals, group, "__rows")
    last = F.col(order).eqNullSafe(F.col("__last"))
    if method == "equal":
        each = F.expr(f"{total}L div __rows")
        rest = F.lit(total) - each * (F.col("__rows") - 1)
        return rows.select(*df.columns, F.when(last, rest).otherwise(each).alias("share"))
    if method != "weighted":
        raise ValueError("method is 'weighted' or 'equal'")
    each = F.expr(f"{total}L div __rows")
    weighted = F.rint(F.lit(total) * (F.coalesce(weight, F.lit(0)) / F.nullif("__weights", F.lit(0)))).cast("bigint")
    share = F.coalesce(weighted, each)
    others = rows.where(~last).select(*df.columns, share.alias("share"))
    given = rows.groupBy(group).agg(
        F.coalesce(F.sum(F.when(~last, share)), F.lit(0)).alias("__given")
    )
    # One row per group on both sides.
    lasts = join_totals(rows.where(last), given, group).select(
        *df.columns, (F.lit(total) - F.col("__given")).alias("share")
    )
    return others.unionByName(lasts)
