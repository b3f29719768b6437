"""Exact order statistics from counts, without sorting or shuffling rows.

Each pass counts values per bucket around the wanted ranks and narrows the
buckets that hold one, until a bucket is a single value.  Only counts are
shuffled.  For integer values.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runweave.storage import cut_lineage

# Buckets of one interval, and of one group, that a pass counts.
BUCKETS = 1_024
GROUP_BUCKETS = 65_536
INTEGERS = {"tinyint", "smallint", "int", "bigint"}
# Wanted buckets (three integers each) that are broadcast to the rows at most.
BROADCAST_BUCKETS = 200_000


def _interval(v: Column, lows: list[int], highs: list[int]) -> Column:
    """The number of the disjoint interval that holds ``v``, or null."""

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.when(v.between(F.lit(lows[low]), F.lit(highs[low])), F.lit(low))
        middle = (low + high) // 2
        return F.when(v < F.lit(lows[middle]), search(low, middle)).otherwise(search(middle, high))

    return search(0, len(lows))


def select_ranks(df: DataFrame, col: str, ranks: list[int], weight: str | None = None) -> list:
    """The values at these 0-based ranks of ``col`` in ascending order, nulls left
    out; ``weight`` is a column that says how often a row counts.

    The driver holds ``BUCKETS`` counts per distinct rank at most.  A rank that is
    not there fails.
    """
    if dict(df.dtypes)[col] not in INTEGERS:
        raise ValueError("ranks are selected among integers")
    v, times = F.col(col).cast("bigint"), F.lit(1).cast("bigint") if weight is None else F.col(weight)
    rows = df.select(v.alias("v"), times.alias("m")).where("v is not null and m > 0")
    bounds = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()
    wanted = sorted(set(ranks))
    if wanted and not 0 <= wanted[0] <= wanted[-1] < bounds["n"]:
        raise ValueError(f"ranks lie from 0 to {bounds['n'] - 1}")
    found: dict[int, int] = {}
    # Interval: its bounds, and rank of its first row. All ranks begin in one.
    todo = {(bounds["low"], bounds["high"]): (0, wanted)} if wanted else {}
    while todo:
        spans = sorted(todo)
        width = [max(-(-(high - low + 1) // BUCKETS), 1) for low, high in spans]
        number = _interval(F.col("v"), [s[0] for s in spans], [s[1] for s in spans])
        inside = rows.withColumn("i", number).where("i is not null")
        lows = F.array(*[F.lit(s[0]).cast("bigint") for s in spans])
        widths = F.array(*[F.lit(w).cast("bigint") for w in width])
        bucket = F.expr("(v - lo) div w")
        counted = inside.withColumns({"lo": F.get(lows, "i"), "w": F.get(widths, "i")}).groupBy("i", bucket.alias("b")).agg(F.sum("m").alias("n"))
        by_span: dict[int, list[tuple[int, int]]] = {}
        for r in counted.collect():
            by_span.setdefault(r["i"], []).append((r["b"], r["n"]))
        narrowed: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for i, buckets in by_span.items():
            first, asked = todo[spans[i]]
            buckets.sort()
            starts = [first]
            for _, n in buckets:
                starts.append(starts[-1] + n)
            for rank in asked:
                at = bisect_right(starts, rank) - 1
                low = spans[i][0] + buckets[at][0] * width[i]
                if width[i] == 1:
                    found[rank] = low
                else:
                    span = (low, min(low + width[i] - 1, spans[i][1]))
                    narrowed.setdefault(span, (starts[at], []))[1].append(rank)
        todo = narrowed
    return [found[r] for r in ranks]


def strided_values(df: DataFrame, col: str, run: str, samples: int) -> DataFrame:
    """``v, m``: every (rows/``samples``)-th value of each ``run`` in ascending
    order, nulls first, with how often it is taken.

    As in `select_ranks` buckets that hold a wanted rank are narrowed, here for
    all runs at once; a run has ``GROUP_BUCKETS`` buckets at first.
    """
    # A run's nulls come first, as one value of their own.
    rows = df.select(F.col(run).alias("run"), F.col(col).cast("bigint").alias("v"))
    sizes = rows.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("low"), F.max("v").alias("high"))
    width = F.greatest(F.lit(1).cast("bigint"), F.expr(f"(high - low) div {GROUP_BUCKETS} + 1"))
    runs = sizes.select("run", "n", "nulls", "low", F.greatest(F.lit(1), F.expr(f"n div {samples}")).alias("stride"), width.alias("w"))
    runs = cut_lineage(runs, "runs")

    def taken(start: Column, n: Column) -> Column:
        """Multiples of the stride from ``start`` on, among ``n`` ranks."""
        stride = F.col("stride")
        return F.ceil((start + n) / stride).cast("bigint") - F.ceil(start / stride).cast("bigint")

    none = runs.where("nulls > 0").select(F.lit(None).cast("bigint").alias("v"), taken(F.lit(0), F.col("nulls")).alias("m"))
    # Per wanted bucket: its run, first value, width, and rank of its first row.
    open_ = runs.where("low is not null").select("run", "stride", F.col("low").alias("lo"), "w", F.col("nulls").alias("start"), F.lit(None).cast("bigint").alias("was"))
    out = none
    live = rows.where("v is not null").withColumn("at", F.lit(None).cast("bigint"))
    while True:
        few = open_.count() <= BROADCAST_BUCKETS
        side = F.broadcast(open_) if few else open_
        met = live.join(side.withColumnsRenamed({"run": "_run"}), F.col("run").eqNullSafe(F.col("_run")) & F.col("at").eqNullSafe(F.col("was")), "inner")
        counted = met.groupBy("run", "was", "lo", "w", "start", "stride", F.expr("(v - lo) div w").alias("b")).agg(F.count("*").alias("n"))
        # At most the buckets of one interval of one run, not rows.
        before = W.partitionBy("run", "was").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        placed = counted.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        placed = placed.withColumn("m", taken(F.col("start"), F.col("n"))).where("m > 0").withColumn("lo", F.col("lo") + F.col("b") * F.col("w"))
        placed = cut_lineage(placed.select("run", "lo", "w", "start", "stride", "m", "n"), "buckets")
        out = out.unionByName(placed.where("w = 1").select(F.col("lo").alias("v"), "m"))
        wide = placed.where("w > 1")
        if not wide.limit(1).count():
            return out
        # Rows that lie in a wanted bucket, known by its first value.
        keys = wide.select(F.col("run").alias("_run"), "lo", F.col("w").alias("wide"))
        side = F.broadcast(keys) if keys.count() <= BROADCAST_BUCKETS else keys
        first = met.select("run", "v", (F.col("lo") + F.expr("(v - lo) div w") * F.col("w")).alias("at"))
        live = first.join(side, F.col("run").eqNullSafe(F.col("_run")) & (F.col("at") == F.col("lo")), "left_semi")
        narrower = F.greatest(F.lit(1).cast("bigint"), F.expr(f"(w - 1) div {BUCKETS} + 1"))
        open_ = cut_lineage(wide.select("run", "stride", "lo", narrower.alias("w"), "start", F.col("lo").alias("was")), "wanted")
