"""Registered queries: every operator over the given tables, and the SQL that
gives the same result.

Results are compared without regard to row order, so a query about order
carries the position of each row.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from runweave.functions import chunk_seed, narrow_int32, overflow_int32
from runweave.operators import (
    add_run_sketches,
    append_run,
    apportion,
    assign_chunks,
    assign_range,
    audit_seeds,
    check_complete,
    check_conserved,
    check_order,
    check_sorted,
    check_summaries,
    chunk_contents,
    chunk_manifest,
    compare_runs,
    global_position,
    global_sort,
    index_rows,
    ledger_view,
    merge_runs,
    merge_stored,
    merge_stored_ranges,
    node_contribution,
    order_summaries,
    positions_of,
    preview,
    range_histogram,
    range_merge,
    range_pivots,
    read_runs,
    rows_at,
    run_sketches,
    run_summary,
    scaling_curve,
    select_ranks,
    sketch_pivots,
    sorted_runs,
    sorted_runs_with_ledger,
    store_sorted,
)
from runweave.plans import inputs as src
from runweave.sources import (
    draw_shares,
    draw_sorted,
    draw_uniform,
    number_lines,
    read_number_files,
    read_numbers,
    write_numbers,
)
from runweave.sources.generate import HIGH, LOW, PRIME, ROUNDS, SECOND_SEED, SHARE_LIMIT
from runweave.storage import shared_path
from runweave.streaming import (
    completeness_stream,
    live_sources,
    session_stream,
    source_events,
    source_sessions,
    stream_runs,
    stream_to_store,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Fixed parameters of the queries, the same in Spark and in SQL.
SEED = src.SESSION_SEED
HOURS = timedelta(hours=src.HEARTBEAT_HOURS)
LATENESS = timedelta(hours=1)
RANGES = 8
CHUNK_ROWS = dict(units=2, per_unit=4, min_size=500, max_size=5_000)

SORTED_SQL = "SELECT row_number() OVER (ORDER BY l_partkey) - 1 AS pos, l_partkey AS v FROM lineitem"

# ---------------------------------------------------------------- positions


@query(SORTED_SQL)
def global_position_of_values(spark, sf_dir):
    return global_position(src.part_keys(spark, sf_dir), "v")


@query(
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_custkey AS v "
    "FROM orders"
)
def global_position_of_rows(spark, sf_dir):
    return global_position(src.order_values(spark, sf_dir), "o_orderkey")


# A third of all rows share one key; the rest are distinct.
HOT_KEY = "CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey * 8 + l_linenumber END"


@query(
    f"SELECT row_number() OVER (ORDER BY k) - 1 AS pos, k AS v FROM (SELECT {HOT_KEY} AS k FROM lineitem)"
)
def global_position_hot_key(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select(F.expr(HOT_KEY).alias("v"))
    return global_position(rows, "v", RANGES)


# -------------------------------------------------------------- sort, merge


@query(SORTED_SQL)
def global_sort_order(spark, sf_dir):
    return index_rows(global_sort(src.part_keys(spark, sf_dir), "v"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_custkey AS v FROM orders")
def global_sort_rows(spark, sf_dir):
    return index_rows(global_sort(src.order_values(spark, sf_dir), "o_orderkey"))


@query(
    f"SELECT row_number() OVER (ORDER BY k) - 1 AS pos, k AS v FROM (SELECT {HOT_KEY} AS k FROM lineitem)"
)
def global_sort_hot_key(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select(F.expr(HOT_KEY).alias("v"))
    return index_rows(global_sort(rows, "v", RANGES))


def _chunked(spark, sf_dir):
    return assign_chunks(src.order_values(spark, sf_dir), "o_orderkey", **CHUNK_ROWS)


CHUNK_SIZE_SQL = (
    "least(greatest(500, CAST(ceil((SELECT count(*) FROM orders) / 8.0) AS BIGINT)), 5000)"
)
CHUNKED_SQL = f"""
SELECT pos, pos // {CHUNK_SIZE_SQL} + 1 AS chunk_id, o_orderkey, v
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_custkey AS v FROM orders)"""


@query(
    f"SELECT row_number() OVER (ORDER BY chunk_id, v) - 1 AS pos, chunk_id, v FROM ({CHUNKED_SQL})"
)
def sorted_runs_order(spark, sf_dir):
    return index_rows(sorted_runs(_chunked(spark, sf_dir).select("chunk_id", "v")))


@query(SORTED_SQL)
def merge_runs_order(spark, sf_dir):
    """A sorted run per line number on shared storage, merged into one."""
    runs = shared_path(spark, "line-runs")
    rows = src.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("run_id"), F.col("l_partkey").alias("v")
    )
    global_sort(rows, ["run_id", "v"]).write.partitionBy("run_id").parquet(runs)
    return index_rows(merge_runs(runs, "v", spark=spark))


STRIDE_SQL = f"""
WITH run AS (
  SELECT l_linenumber AS run, l_partkey AS v,
         row_number() OVER (PARTITION BY l_linenumber ORDER BY l_partkey) - 1 AS rn,
         count(*) OVER (PARTITION BY l_linenumber) AS n
  FROM lineitem),
pool AS (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS at, count(*) OVER () AS s
  FROM run WHERE rn % greatest(1, n // 2000) = 0),
wanted AS (
  SELECT i, CAST(floor(i * ((SELECT max(s) - 1 FROM pool) / CAST({RANGES} AS DOUBLE))) AS BIGINT) AS at
  FROM range(1, {RANGES}) t(i))
SELECT wanted.i AS i, pool.v AS pivot FROM wanted JOIN pool ON pool.at = wanted.at"""


def _stride_pivots(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_partkey").alias("v"))
    return range_pivots(rows, "v", RANGES, method="stride", run="l_linenumber")


@query(STRIDE_SQL)
def range_pivots_stride(spark, sf_dir):
    pivots = _stride_pivots(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(pivots, 1)), "i bigint, pivot bigint")


@query(f"SELECT i, true AS close FROM range(1, {RANGES}) t(i)")
def range_pivots_approx(spark, sf_dir):
    """Every pivot's rank is within a twentieth of the rows of the even cut."""
    values = src.part_keys(spark, sf_dir)
    pivots = range_pivots(values, "v", RANGES)
    ranks = values.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("v") < x).alias(f"r{i}") for i, x in enumerate(pivots, 1)]
    )
    cuts = [
        F.struct(F.lit(i).cast("bigint").alias("i"), F.col(f"r{i}").alias("r"))
        for i in range(1, RANGES)
    ]
    off = F.abs(F.col("r") / F.col("n") - F.col("i") / RANGES)
    return ranks.select("n", F.inline(F.array(*cuts))).select("i", (off < 0.05).alias("close"))


@query(
    f"""SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v,
               CAST((SELECT count(*) FROM ({STRIDE_SQL}) p WHERE p.pivot <= u.v) AS INT) AS bucket
        FROM (SELECT l_partkey AS v FROM lineitem) u"""
)
def range_merge_order(spark, sf_dir):
    pivots = _stride_pivots(spark, sf_dir)
    return index_rows(range_merge(src.part_keys(spark, sf_dir), "v", RANGES, pivots))


@query(
    f"""SELECT i, v FROM (SELECT l_extendedprice_cents AS v, row_number() OVER (ORDER BY l_extendedprice_cents) - 1 AS place,
               count(*) OVER () AS n
        FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice_cents FROM lineitem)) r
        JOIN (SELECT range AS i FROM range(0, {RANGES + 1})) w ON place = i * (n - 1) // {RANGES}"""
)
def select_ranks_prices(spark, sf_dir):
    """Least, greatest and evenly spaced prices, exactly, from counts alone."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("v")
    prices = src.table(spark, sf_dir, "lineitem").select(cents)
    n = prices.count()
    found = select_ranks(prices, "v", [i * (n - 1) // RANGES for i in range(RANGES + 1)])
    return spark.createDataFrame(list(enumerate(found)), "i bigint, v bigint")


@query(f"SELECT i, true AS close FROM range(1, {RANGES}) t(i)")
def sketch_pivots_of_runs(spark, sf_dir):
    """Pivots of all runs from their stored sketches, half of the runs added later;
    each has its rank within three hundredths of the rows."""
    rows = src.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_partkey").alias("v"))
    stored = shared_path(spark, "sketches")
    for some in (rows.where("run <= 3"), rows.where("run > 3")):
        add_run_sketches(run_sketches(some, "v", "run"), stored)
    pivots = sketch_pivots(spark.read.parquet(stored), RANGES)
    ranks = rows.agg(
        F.count("*").alias("n"),
        *[F.struct(F.count_if(F.col("v") < x).alias("lo"), F.count_if(F.col("v") <= x).alias("hi")).alias(f"r{i}") for i, x in enumerate(pivots, 1)],
    )
    cuts = [F.struct(F.lit(i).cast("bigint").alias("i"), F.col(f"r{i}.lo").alias("lo"), F.col(f"r{i}.hi").alias("hi")) for i in range(1, RANGES)]
    even = F.col("n") * F.col("i") / RANGES
    off = F.greatest(F.col("lo") - even, even - F.col("hi"), F.lit(0)) / F.col("n")
    return ranks.select("n", F.inline(F.array(*cuts))).select("i", (off < 0.03).alias("close"))


# ----------------------------------------------------------------- ranges

# A repeated pivot leaves range 3 empty; a value equal to a pivot goes right.
PIVOTS = [25, 50, 120, 120, 900, 1500]
BUCKET_SQL = " + ".join(f"CASE WHEN l_partkey >= {p} THEN 1 ELSE 0 END" for p in PIVOTS)


@query(f"SELECT l_partkey AS v, CAST({BUCKET_SQL} AS INT) AS bucket FROM lineitem")
def assign_range_rows(spark, sf_dir):
    return assign_range(src.part_keys(spark, sf_dir), "v", PIVOTS)


@query(
    f"SELECT CAST({BUCKET_SQL} AS INT) AS bucket, count(*) AS n, min(l_partkey) AS lo, "
    "max(l_partkey) AS hi FROM lineitem GROUP BY 1"
)
def range_histogram_rows(spark, sf_dir):
    return range_histogram(assign_range(src.part_keys(spark, sf_dir), "v", PIVOTS))


# ------------------------------------------------------- chunks and shares


@query(CHUNKED_SQL)
def assign_chunks_rows(spark, sf_dir):
    return _chunked(spark, sf_dir)


@query(
    f"SELECT chunk_id, count(*) AS n_items, min(v) AS lo, max(v) AS hi FROM ({CHUNKED_SQL}) GROUP BY 1"
)
def chunk_manifest_rows(spark, sf_dir):
    return chunk_manifest(_chunked(spark, sf_dir))


TOTAL = 1_000_003


def _shares_sql(total: str) -> str:
    return f"""WITH s AS ({src.SHARES_SQL}),
    w AS (SELECT *, sum(weight) OVER (PARTITION BY grp) AS ws, max(ord) OVER (PARTITION BY grp) AS la FROM s),
    r AS (SELECT *, CASE WHEN ord < la THEN
            CAST(round_even({total} * (weight / CAST(ws AS DOUBLE)), 0) AS BIGINT) END AS part FROM w)
    SELECT grp, ord, weight,
           CAST(coalesce(part, {total} - coalesce(sum(part) OVER (PARTITION BY grp), 0)) AS BIGINT) AS share
    FROM r"""


@query(_shares_sql(str(TOTAL)))
def apportion_weighted(spark, sf_dir):
    return apportion(src.shares(spark, sf_dir), "grp", "ord", "weight", TOTAL)


@query(
    f"""WITH s AS ({src.SHARES_SQL}),
    w AS (SELECT *, count(*) OVER (PARTITION BY grp) AS k, max(ord) OVER (PARTITION BY grp) AS la FROM s)
    SELECT grp, ord, weight,
           CASE WHEN ord < la THEN {TOTAL} // k ELSE {TOTAL} - (k - 1) * ({TOTAL} // k) END AS share
    FROM w"""
)
def apportion_equal(spark, sf_dir):
    return apportion(src.shares(spark, sf_dir), "grp", "ord", "weight", TOTAL, "equal")


# ---------------------------------------------------------- number files


@query(SORTED_SQL)
def number_file_sorted(spark, sf_dir):
    path = shared_path(spark, "sorted-numbers")
    write_numbers(global_sort(src.part_keys(spark, sf_dir), "v"), path)
    return number_lines(read_numbers(spark, path, line_order=True))


def _mixed_lines(spark, sf_dir):
    """Integers, decimals, blank lines and padded integers, as text."""
    line = F.expr(
        "CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS STRING) "
        "WHEN 'O' THEN concat('  ', CAST(o_custkey AS STRING), ' ') "
        "ELSE if(o_orderkey % 2 = 0, '   ', concat(CAST(o_orderkey AS STRING), '.5')) END"
    )
    path = shared_path(spark, "mixed-lines")
    src.table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return path


@query(
    "SELECT CASE o_orderstatus WHEN 'F' THEN o_orderkey ELSE o_custkey END AS v "
    "FROM orders WHERE o_orderstatus IN ('F', 'O')"
)
def number_file_accepted(spark, sf_dir):
    return read_numbers(spark, _mixed_lines(spark, sf_dir), mode="permissive")[0]


@query(
    "SELECT concat(CAST(o_orderkey AS VARCHAR), '.5') AS line "
    "FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 = 1"
)
def number_file_rejected(spark, sf_dir):
    return read_numbers(spark, _mixed_lines(spark, sf_dir), mode="permissive")[1]


# A file per customer number modulo 20; every fifth has lines that are no numbers.
FILES, NO_NUMBER = 20, "o_custkey % 5 = 0 AND o_orderkey % 3 = 0"


@query(
    f"""WITH lines AS (SELECT o_custkey % {FILES} AS k, CASE WHEN {NO_NUMBER} THEN concat(CAST(o_orderkey AS VARCHAR), 'x')
                        ELSE CAST(o_orderkey AS VARCHAR) END AS line, {NO_NUMBER} AS bad FROM orders)
    SELECT k, CASE WHEN bool_or(bad) THEN 'bad' ELSE 'good' END AS status,
           CASE WHEN bool_or(bad) THEN 0 ELSE count(*) END AS numbers, count(*) FILTER (WHERE bad) AS rejected,
           CASE WHEN bool_or(bad) THEN CAST(0 AS BIGINT) ELSE CAST(sum(try_cast(line AS BIGINT)) AS BIGINT) END AS total
    FROM lines GROUP BY k"""
)
def number_files_judged(spark, sf_dir):
    """Per file: good or bad, how many numbers it gives and their sum."""
    line = F.expr(f"CASE WHEN {NO_NUMBER} THEN concat(CAST(o_orderkey AS STRING), 'x') ELSE CAST(o_orderkey AS STRING) END")
    path = shared_path(spark, "number-files")
    orders = src.table(spark, sf_dir, "orders").select(F.expr(f"o_custkey % {FILES}").alias("k"), line.alias("value"))
    orders.repartition(RANGES, "k").write.partitionBy("k").text(path)
    numbers, report = read_number_files(spark, path)
    k = F.regexp_extract("file", "/k=([0-9]+)/", 1).cast("bigint").alias("k")
    sums = numbers.groupBy("file").agg(F.sum("v").alias("total"))
    return report.join(sums, "file", "left").select(k, "status", "numbers", "rejected", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))


# ------------------------------------------------------------- generators


def _drawn_sql(rows: str, key: str) -> str:
    """A table ``drawn`` of ``key, v``: the same integer arithmetic, step by step."""
    steps = [f"start AS (SELECT {key} AS key FROM {rows})"]
    for name, seed in (("a", SEED % PRIME), ("b", (SEED + SECOND_SEED) % PRIME)):
        steps.append(
            f"{name}0 AS (SELECT key, CAST((key % {PRIME} + ((key >> 31) % {PRIME}) * 31 + {seed}) % {PRIME} AS BIGINT) AS x FROM start)"
        )
        for i, (factor, term) in enumerate(ROUNDS, 1):
            steps.append(
                f"{name}{i} AS (SELECT key, (xor(x, x >> 15) * {factor} + {term}) % {PRIME} AS x FROM {name}{i - 1})"
            )
    n = len(ROUNDS)
    steps.append(
        f"drawn AS (SELECT a{n}.key, (a{n}.x * {PRIME} + b{n}.x) % {HIGH - LOW + 1} + {LOW} AS v FROM a{n} JOIN b{n} USING (key))"
    )
    return "WITH " + ", ".join(steps)


def _drawn(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", draw_uniform("o_orderkey", seed=SEED).alias("v"))


@query(_drawn_sql("orders", "o_orderkey") + " SELECT key AS o_orderkey, v FROM drawn")
def generate_uniform_rows(spark, sf_dir):
    """A value for every order, drawn from its key."""
    return _drawn(spark, sf_dir)


@query(
    _drawn_sql("orders", "o_orderkey")
    + " SELECT (v - 1) // 1000000 AS tenth, count(*) AS n, min(v) AS lo, max(v) AS hi FROM drawn GROUP BY 1"
)
def generate_uniform_audit(spark, sf_dir):
    """How many values fall into each tenth of the domain."""
    tenth = F.expr("(v - 1) div 1000000").alias("tenth")
    return _drawn(spark, sf_dir).groupBy(tenth).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )


@query(
    _drawn_sql("orders", "o_orderkey")
    + " SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM drawn"
)
def generate_sorted_rows(spark, sf_dir):
    """A value drawn from the key of every order, piped into the sort."""
    return index_rows(draw_sorted(src.table(spark, sf_dir, "orders"), "o_orderkey", seed=SEED))


@query(
    # Keys repeat, and each repetition draws the same value.
    _drawn_sql("(SELECT DISTINCT k FROM line_keys)", "k").replace(
        "WITH ", "WITH line_keys AS (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem), ", 1
    )
    + " SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM line_keys JOIN drawn ON key = k"
)
def generate_sorted_audit(spark, sf_dir):
    """A value drawn from the key of every line, in order as they lie."""
    lines = src.table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("k"))
    return index_rows(draw_sorted(lines, "k", seed=SEED))


SHARED_SQL = _shares_sql("(SELECT count(*) // 10 FROM orders)")


@query(
    _drawn_sql("keys", "k").replace(
        "WITH ",
        f"WITH shares AS ({SHARED_SQL}), keys AS (SELECT ord * {SHARE_LIMIT} + unnest(range(share)) AS k FROM shares), ",
        1,
    )
    + f" SELECT row_number() OVER (ORDER BY key // {SHARE_LIMIT}, v) - 1 AS pos, key // {SHARE_LIMIT} AS ord, v FROM drawn"
)
def draw_shares_sorted(spark, sf_dir):
    """Numbers made by the suppliers of each nation in shares by weight, sorted."""
    total = src.table(spark, sf_dir, "orders").count() // 10
    shares = apportion(src.shares(spark, sf_dir), "grp", "ord", "weight", total)
    return index_rows(draw_shares(shares, "ord", seed=SEED))


# ---------------------------------------------------------------- scalars

WIDE = "o_orderkey * 1000003"


@query(f"SELECT o_orderkey, try_cast({WIDE} AS INT) AS v FROM orders")
def narrow_int32_values(spark, sf_dir):
    rows = src.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(WIDE).alias("v"))
    return narrow_int32(rows, "v", on_overflow="null")


@query(
    f"SELECT count(*) AS n, count(*) FILTER (WHERE {WIDE} > 2147483647) AS overflowing FROM orders"
)
def narrow_int32_overflow(spark, sf_dir):
    rows = src.table(spark, sf_dir, "orders").select(F.expr(WIDE).alias("v"))
    return rows.agg(F.count("*").alias("n"), F.count_if(overflow_int32("v")).alias("overflowing"))


@query(
    f"SELECT o_orderkey AS chunk_id, CAST((CAST({SEED} AS HUGEINT) * 1000003 "
    "+ CAST(o_orderkey AS HUGEINT) * 2654435761) % 1000000000 AS BIGINT) AS seed FROM orders"
)
def chunk_seed_values(spark, sf_dir):
    chunk = F.col("o_orderkey").alias("chunk_id")
    return src.table(spark, sf_dir, "orders").select(chunk).withColumn(
        "seed", chunk_seed(SEED, "chunk_id")
    )


# -------------------------------------------------------------- validation


def _sortedness_sql(v: str) -> str:
    return f"""
    WITH r AS (SELECT o_orderkey // 1000 AS c, {v} AS v,
                      lag(o_orderkey // 1000) OVER (ORDER BY o_orderkey) AS pc,
                      lag({v}) OVER (ORDER BY o_orderkey) AS pv FROM orders)
    SELECT count(*) AS n, count(*) FILTER (WHERE pv > v AND pc = c) AS inner_violations,
           count(*) FILTER (WHERE pv > v AND pc <> c) AS boundary_violations,
           count(*) FILTER (WHERE pv > v) = 0 AS is_sorted FROM r"""


TIES_SQL = """
    WITH r AS (SELECT o_orderkey // 1000 AS c, o_orderkey % 1000 // 100 AS s, o_custkey AS v FROM orders),
    p AS (SELECT c, v, lag(c) OVER w AS pc, lag(v) OVER w AS pv FROM r WINDOW w AS (ORDER BY c, s, v))
    SELECT count(*) AS n, count(*) FILTER (WHERE pv > v AND pc = c) AS inner_violations,
           count(*) FILTER (WHERE pv > v AND pc <> c) AS boundary_violations,
           count(*) FILTER (WHERE pv > v) = 0 AS is_sorted FROM p"""


@query(TIES_SQL)
def check_sorted_ties(spark, sf_dir):
    """Many rows share a place, in whatever order they lie."""
    rows = src.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 1000").alias("c"), F.expr("o_orderkey % 1000 div 100").alias("s"), F.col("o_custkey").alias("v")
    )
    return check_sorted(rows, "c", "s", "v")


def _sortedness(spark, sf_dir, v):
    rows = src.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 1000").alias("chunk_id"),
        "o_orderkey",
        (F.col(v) if isinstance(v, str) else v).alias("v"),
    )
    return check_sorted(rows, "chunk_id", "o_orderkey", "v")


@query(_sortedness_sql("o_orderkey"))
def check_sorted_valid(spark, sf_dir):
    return _sortedness(spark, sf_dir, "o_orderkey")


@query(_sortedness_sql("o_custkey"))
def check_sorted_violations(spark, sf_dir):
    return _sortedness(spark, sf_dir, "o_custkey")


# A null in every seventh row, in key order.
HOLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END"


@query(
    f"""WITH b AS (SELECT o_orderkey, o_orderkey // 1000 AS c, {HOLED} AS v FROM orders),
    r AS (SELECT c, v, lag(c) OVER w AS pc, lag(v) OVER w AS pv FROM b WINDOW w AS (ORDER BY o_orderkey)),
    d AS (SELECT *, pc IS NOT NULL AND pv IS NOT NULL AND (v IS NULL OR pv > v) AS drop FROM r)
    SELECT count(*) AS n, count(*) FILTER (WHERE drop AND pc = c) AS inner_violations,
           count(*) FILTER (WHERE drop AND pc <> c) AS boundary_violations,
           count(*) FILTER (WHERE drop) = 0 AS is_sorted FROM d"""
)
def check_sorted_nulls(spark, sf_dir):
    return _sortedness(spark, sf_dir, F.expr(HOLED))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS violations, true AS is_sorted FROM lineitem")
def check_order_sorted(spark, sf_dir):
    return check_order(global_sort(src.part_keys(spark, sf_dir), "v"), "v")


@query(
    """WITH r AS (SELECT o_custkey AS v, lag(o_custkey) OVER (ORDER BY o_orderkey) AS pv FROM orders)
    SELECT count(*) AS n, count(*) FILTER (WHERE pv > v) AS violations,
           count(*) FILTER (WHERE pv > v) = 0 AS is_sorted FROM r"""
)
def check_order_violations(spark, sf_dir):
    """Sorted by another column than the one checked."""
    return check_order(global_sort(src.order_values(spark, sf_dir), "o_orderkey"), "v")


@query(
    "SELECT count(*) AS n_before, count(*) FILTER (WHERE o_orderkey % 97 <> 0) AS n_after, "
    "false AS count_ok, false AS content_ok FROM orders"
)
def check_conserved_lost_rows(spark, sf_dir):
    rows = src.order_values(spark, sf_dir)
    return check_conserved(rows, rows.where("o_orderkey % 97 <> 0"))


@query("SELECT count(*) AS n_before, count(*) AS n_after, true AS count_ok, true AS content_ok FROM lineitem")
def check_conserved_sorted(spark, sf_dir):
    rows = src.part_keys(spark, sf_dir)
    return check_conserved(rows, global_sort(rows, "v"))


@query(
    """SELECT count(*) AS n_before, count(*) AS n_after, true AS count_ok,
              count(*) FILTER (WHERE (o_orderkey % 2 = 0)) = 0 AND count(*) = 0 AS content_ok FROM orders"""
)
def check_conserved_swapped(spark, sf_dir):
    """A null and a value that change columns are other rows."""
    orders = src.table(spark, sf_dir, "orders")
    none = F.lit(None).cast("bigint")
    before = orders.select(none.alias("a"), F.col("o_orderkey").alias("b"))
    return check_conserved(before, orders.select(F.col("o_orderkey").alias("a"), none.alias("b")))


# Chunks go missing, come back twice, come back unplanned or with other sizes.
FAULTY_SQL = """
SELECT chunk_id + CASE WHEN chunk_id % 89 = 0 THEN 1000000000 ELSE 0 END AS chunk_id,
       n_items + CASE WHEN chunk_id % 53 = 0 THEN 1 ELSE 0 END AS n_items
FROM base WHERE chunk_id % 97 <> 0
UNION ALL SELECT chunk_id, n_items FROM base WHERE chunk_id % 61 = 0"""


@query(
    f"""WITH base AS ({src.LEDGER_SQL}), got AS ({FAULTY_SQL}),
    g AS (SELECT chunk_id, count(*) AS results, min(n_items) AS lo, max(n_items) AS hi FROM got GROUP BY 1),
    j AS (SELECT base.chunk_id AS planned, base.n_items AS items, coalesce(results, 0) AS results, lo, hi
          FROM base FULL JOIN g ON base.chunk_id = g.chunk_id)
    SELECT count(planned) AS chunks, CAST(sum(results) AS BIGINT) AS results,
           count(*) FILTER (WHERE planned IS NOT NULL AND results = 0) AS missing,
           count(*) FILTER (WHERE results > 1) AS duplicate,
           count(*) FILTER (WHERE planned IS NULL) AS unexpected,
           count(*) FILTER (WHERE planned IS NOT NULL AND results > 0 AND (lo <> items OR hi <> items)) AS size_mismatch,
           false AS complete FROM j"""
)
def check_complete_faults(spark, sf_dir):
    plan = src.ledger(spark, sf_dir)
    got = spark.sql(FAULTY_SQL.replace("FROM base", "FROM {base}"), base=plan)
    return check_complete(plan, got)


@query(
    f"""WITH l AS ({src.LEDGER_SQL})
    SELECT count(*) FILTER (WHERE worker_name <> '{src.MASTER}') AS worker_chunks,
           count(*) FILTER (WHERE worker_name <> '{src.MASTER}' AND session_seed = {SEED}) AS verified,
           CAST(0 AS BIGINT) AS wrong_chunk_seeds,
           count(*) FILTER (WHERE worker_name <> '{src.MASTER}' AND session_seed <> {SEED}) = 0 AS all_verified
    FROM l"""
)
def audit_seeds_ledger(spark, sf_dir):
    return audit_seeds(src.ledger(spark, sf_dir), SEED)


# ----------------------------------------------------------------- reports


@query(
    f"""SELECT worker_name, count(*) AS chunks, CAST(sum(n_items) AS BIGINT) AS items,
               CAST(sum(sort_us) AS BIGINT) AS sort_us, max(threads) AS threads
        FROM ({src.LEDGER_SQL}) GROUP BY 1"""
)
def node_contribution_ledger(spark, sf_dir):
    return node_contribution(src.ledger(spark, sf_dir))


@query(
    """WITH p AS (SELECT l_partkey AS v, row_number() OVER (ORDER BY l_partkey) - 1 AS pos,
                         count(*) OVER () AS n FROM lineitem)
    SELECT CASE WHEN n <= 8 THEN 'all' WHEN pos < 4 THEN 'head' ELSE 'tail' END AS side, pos, n, v
    FROM p WHERE n <= 8 OR pos < 4 OR pos >= n - 4"""
)
def preview_values(spark, sf_dir):
    return preview(src.part_keys(spark, sf_dir), "v")


@query(
    """WITH p AS (SELECT o_orderkey % 3 AS v, o_orderkey,
                         row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1 AS pos,
                         count(*) OVER () AS n FROM orders)
    SELECT CASE WHEN n <= 8 THEN 'all' WHEN pos < 4 THEN 'head' ELSE 'tail' END AS side, pos, n, v, o_orderkey
    FROM p WHERE n <= 8 OR pos < 4 OR pos >= n - 4"""
)
def preview_ties(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    return preview(orders.select(F.expr("o_orderkey % 3").alias("v"), "o_orderkey"), "v")


@query(
    f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY chunk_id) - 1 AS pos,
                          count(*) OVER () AS n FROM ({src.LEDGER_SQL}))
    SELECT chunk_id, worker_name, seed, session_seed, sort_us, roundtrip_us,
           session_seed = {SEED} AS seed_matches, roundtrip_us - sort_us AS transfer_us,
           greatest(n - 40, 0) AS hidden
    FROM l WHERE n <= 40 OR pos < 20 OR pos >= n - 20"""
)
def ledger_view_rows(spark, sf_dir):
    return ledger_view(src.ledger(spark, sf_dir), SEED)


@query(
    f"""WITH l AS ({src.LEDGER_SQL})
    SELECT CAST(1 AS BIGINT) AS run_id, count(*) AS rows_sorted,
           count(DISTINCT worker_name) AS nodes, count(*) AS chunks,
           CAST({SEED} AS BIGINT) AS session_seed,
           count(*) FILTER (WHERE worker_name <> '{src.MASTER}') AS worker_chunks,
           count(*) FILTER (WHERE worker_name <> '{src.MASTER}' AND session_seed = {SEED}) AS verified,
           sum(n_items) = count(*) AS is_valid,
           CAST(NULL AS BIGINT) AS generate_us, CAST(7000 AS BIGINT) AS compute_us,
           CAST(500 AS BIGINT) AS merge_us, CAST(7500 AS BIGINT) AS total_us
    FROM l"""
)
def run_summary_row(spark, sf_dir):
    """The summary as read back from the table of runs."""
    ledger = src.ledger(spark, sf_dir)
    runs = shared_path(spark, "runs")
    order = _sortedness(spark, sf_dir, "o_orderkey")
    summary = run_summary(ledger, SEED, order, run_id=1, compute_us=7000, merge_us=500)
    # Appended twice, as by a retry: the run is there once.
    append_run(summary, runs)
    append_run(summary, runs)
    return read_runs(spark, runs)


# Lines in chunks by order key, sorted by part: the ledger comes from the sort.
LINE_CHUNKS_SQL = "SELECT l_orderkey // 1000 AS chunk_id, l_partkey AS v FROM lineitem"
SEED_SQL = f"CAST((CAST({SEED} AS HUGEINT) * 1000003 + CAST(chunk_id AS HUGEINT) * 2654435761) % 1000000000 AS BIGINT)"


def _line_chunks(spark, sf_dir):
    lines = src.table(spark, sf_dir, "lineitem")
    return lines.select(F.expr("l_orderkey div 1000").alias("chunk_id"), F.col("l_partkey").alias("v"))


@query(
    f"""SELECT chunk_id, {SEED_SQL} AS seed, CAST({SEED} AS BIGINT) AS session_seed, count(*) AS n_items,
               min(v) AS first, max(v) AS last, true AS content_ok, true AS timed
        FROM ({LINE_CHUNKS_SQL}) GROUP BY chunk_id"""
)
def sorted_runs_ledger(spark, sf_dir):
    """What the sort of each chunk reports of itself."""
    chunked = _line_chunks(spark, sf_dir)
    _, ledger = sorted_runs_with_ledger(chunked, SEED)
    planned = chunk_contents(chunked).select("chunk_id", F.col("content").alias("planned"))
    return ledger.join(planned, "chunk_id").select(
        "chunk_id", "seed", "session_seed", "n_items", "first", "last",
        (F.col("content") == F.col("planned")).alias("content_ok"),
        ((F.col("sort_us") >= 0) & (F.col("roundtrip_us") >= 0) & (F.col("threads") > 0)).alias("timed"),
    )


@query(
    f"""SELECT count(*) AS rows_sorted, count(DISTINCT chunk_id) AS chunks, count(DISTINCT chunk_id) AS verified,
               CAST(0 AS BIGINT) AS faults, count(*) AS contributed, true AS is_valid, count(DISTINCT chunk_id) AS listed
        FROM ({LINE_CHUNKS_SQL})"""
)
def sorted_runs_audit(spark, sf_dir):
    """A real sort's order, completeness, seeds, shares and summary, from its ledger."""
    chunked = _line_chunks(spark, sf_dir)
    runs, ledger = sorted_runs_with_ledger(chunked, SEED)
    faults = check_complete(chunk_contents(chunked), ledger)
    order = check_sorted(runs.withColumn("at", F.lit(0)), "chunk_id", "place", "v")
    # Chunks overlap in value, so only the order within each counts.
    inner = order.select("n", (F.col("inner_violations") == 0).alias("is_sorted"))
    summary = run_summary(ledger, SEED, inner, run_id=1)
    return summary.select(
        "rows_sorted", "chunks", "verified",
        faults.select(F.col("missing") + F.col("duplicate") + F.col("unexpected") + F.col("size_mismatch")).scalar().alias("faults"),
        node_contribution(ledger).agg(F.sum("items")).scalar().alias("contributed"),
        "is_valid",
        ledger_view(ledger, SEED, limit=1_000_000).agg(F.count_if("seed_matches")).scalar().alias("listed"),
    )


@query(
    f"""WITH c AS (SELECT chunk_id, min(v) AS first, max(v) AS last, count(*) AS n FROM ({LINE_CHUNKS_SQL}) GROUP BY chunk_id),
    s AS (SELECT n, lag(last) OVER (ORDER BY chunk_id) > first AS drop FROM c)
    SELECT CAST(sum(n) AS BIGINT) AS n, CAST(0 AS BIGINT) AS inner_violations,
           count(*) FILTER (WHERE drop) AS boundary_violations, count(*) FILTER (WHERE drop) = 0 AS is_sorted FROM s"""
)
def order_summaries_appended(spark, sf_dir):
    """Order of chunks that were sorted in two goes: each is summarised as it comes,
    and the whole is judged from the summaries."""
    chunked, kept = _line_chunks(spark, sf_dir), shared_path(spark, "summaries")
    for go in (F.col("chunk_id") % 2 == 0, F.col("chunk_id") % 2 != 0):
        runs, _ = sorted_runs_with_ledger(chunked.where(go), SEED)
        order_summaries(runs, "chunk_id", "place", "v").write.mode("append").parquet(kept)
    return check_summaries(spark.read.parquet(kept), "chunk_id")


@query(
    f"""WITH h AS ({src.HISTORY_SQL}),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, mode ORDER BY started_at DESC, run_id DESC) AS rn FROM h),
    s AS (SELECT * FROM r WHERE rn = 1 AND mode = 'serial'),
    p AS (SELECT * FROM r WHERE rn = 1 AND mode <> 'serial'),
    j AS (SELECT p.dataset_id, p.mode, p.k, s.compute_us AS serial_us, p.compute_us AS parallel_us,
                 CASE WHEN p.compute_us > 0 THEN s.compute_us / CAST(p.compute_us AS DOUBLE) ELSE 0.0 END AS speedup
          FROM s JOIN p ON s.dataset_id = p.dataset_id)
    SELECT dataset_id, mode, k, serial_us, parallel_us, round(speedup, 6) AS speedup,
           round(CASE WHEN k > 0 THEN speedup / k * 100 ELSE 0.0 END, 6) AS efficiency,
           CASE WHEN speedup > 1 THEN 'faster' ELSE 'not faster' END AS verdict
    FROM j"""
)
def compare_runs_history(spark, sf_dir):
    table = compare_runs(src.history(spark, sf_dir))
    return table.withColumns(
        {c: F.round(c, 6) for c in ("speedup", "efficiency")}
    )


@query(
    f"""WITH h AS ({src.HISTORY_SQL}),
    b AS (SELECT dataset_id, k, min(compute_us) AS best_us FROM h GROUP BY 1, 2)
    SELECT b.dataset_id, b.k, b.best_us, one.best_us AS base_us,
           round(CASE WHEN b.best_us > 0 THEN one.best_us / CAST(b.best_us AS DOUBLE) ELSE 0.0 END, 6) AS speedup
    FROM b JOIN b one ON one.dataset_id = b.dataset_id AND one.k = 1"""
)
def scaling_curve_history(spark, sf_dir):
    return scaling_curve(src.history(spark, sf_dir)).withColumn("speedup", F.round("speedup", 6))


# --------------------------------------------------------------- streaming


@query("SELECT row_number() OVER (ORDER BY o_custkey) - 1 AS pos, o_custkey AS v FROM orders")
def stream_runs_merged(spark, sf_dir):
    """Files taken up a few at a time, a run per batch, then one merge."""
    arriving, runs, state = (shared_path(spark, x) for x in ("arriving", "runs", "state"))
    values = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("v"))
    values.repartition(4, "v").write.parquet(arriving)
    stream_runs(spark, arriving, runs, state, "v bigint", max_files=2)
    return index_rows(merge_runs(runs, "v", spark=spark).select("v"))


# Batches of a store, and how many runs of a level become one of the next.
BATCHES, FANOUT = 4, 2
# A file that arrives has row groups of so many bytes, so that many tasks read it.
GROUP_BYTES = 1 << 20


def _run_store(spark, sf_dir):
    """The part keys as they arrive: a run per file, merged where a level is full."""
    arriving, path, state = (shared_path(spark, x) for x in ("arriving", "store", "state"))
    keys = src.part_keys(spark, sf_dir).repartition(BATCHES, "v")
    keys.write.option("parquet.block.size", GROUP_BYTES).parquet(arriving)
    stream_to_store(spark, arriving, path, state, "v bigint", max_files=1, fanout=FANOUT)
    return path


@query(SORTED_SQL)
def run_store_merged(spark, sf_dir):
    """All runs of a store that took up files one by one, in order."""
    return index_rows(merge_stored(spark, _run_store(spark, sf_dir), "v"))


@query(
    f"""SELECT row_number() OVER (ORDER BY l_partkey) - 1 AS pos, l_partkey AS v, CAST({BUCKET_SQL} AS INT) AS bucket
        FROM lineitem WHERE {BUCKET_SQL} IN (2, 4)"""
)
def run_store_ranges(spark, sf_dir):
    """Two ranges of a store, from the files and row groups that reach into them."""
    return index_rows(merge_stored_ranges(spark, _run_store(spark, sf_dir), "v", PIVOTS, [2, 4]))


SESSIONS_SQL = f"""
WITH b AS ({src.BEATS_SQL}),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {src.HEARTBEAT_HOURS} HOUR THEN 0 ELSE 1 END AS starts
      FROM b WINDOW w AS (PARTITION BY name, port ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY name, port ORDER BY ts) AS session FROM g)
SELECT name, port, min(ts) AS started, max(ts) AS last_seen, count(*) AS beats,
       CASE WHEN bool_or(host = '127.0.0.1') THEN '127.0.0.1' ELSE arg_max(host, ts) END AS host
FROM s GROUP BY name, port, session"""


def _as_given(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    times = [c for c in ("started", "last_seen") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query(SESSIONS_SQL)
def source_sessions_batch(spark, sf_dir):
    return _as_given(source_sessions(src.beats(spark, sf_dir), HOURS))


@query(
    f"""SELECT name, port, host, last_seen FROM ({SESSIONS_SQL})
        WHERE last_seen >= (SELECT max(ts) FROM events) - INTERVAL {src.HEARTBEAT_HOURS} HOUR"""
)
def live_sources_now(spark, sf_dir):
    beats = src.beats(spark, sf_dir)
    now = beats.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return _as_given(live_sources(beats, now, HOURS))


@query(
    f"""SELECT * FROM ({SESSIONS_SQL})
        WHERE last_seen + INTERVAL {src.HEARTBEAT_HOURS} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def source_sessions_stream(spark, sf_dir):
    """The sessions closed by the time all events have arrived."""
    arriving, out, state = (shared_path(spark, x) for x in ("beats", "sessions", "state"))
    beats = src.beats(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    beats.write.parquet(arriving)
    sessions = session_stream(
        spark.readStream.schema(beats.schema).parquet(arriving), HOURS, LATENESS
    )
    query = (
        sessions.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _as_given(spark.read.schema(sessions.schema).parquet(out))


EVENTS_SQL = f"""
    WITH cut AS (SELECT epoch_ms(max(ts)) - 3600000 AS wm FROM events),
    b AS (SELECT name, port, ts, bool_or(host = '127.0.0.1') AS local, max(host) AS host
          FROM ({src.BEATS_SQL}) GROUP BY ALL),
    d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {src.HEARTBEAT_HOURS} HOUR THEN 0 ELSE 1 END AS starts
          FROM b WINDOW w AS (PARTITION BY name, port ORDER BY ts)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY name, port ORDER BY ts) AS session FROM d),
    a AS (SELECT *, CASE WHEN bool_or(local) OVER (PARTITION BY name, port, session ORDER BY ts) THEN '127.0.0.1' ELSE host END AS address FROM s),
    t AS (SELECT *, lag(address) OVER w AS was, lead(ts) OVER w AS next FROM a
          WINDOW w AS (PARTITION BY name, port, session ORDER BY ts)),
    e AS (SELECT name, port, 'seen' AS event, ts AS "at", address AS host, ts FROM t WHERE was IS NULL
          UNION ALL SELECT name, port, 'address', ts, address, ts FROM t WHERE was <> address
          UNION ALL SELECT name, port, 'gone', ts + INTERVAL {src.HEARTBEAT_HOURS} HOUR, address,
                           ts + INTERVAL {src.HEARTBEAT_HOURS} HOUR FROM t WHERE next IS NULL)
    SELECT name, port, event, "at", host FROM e, cut WHERE epoch_ms(ts) + 1 <= wm"""


@query(EVENTS_SQL)
def source_events_stream(spark, sf_dir):
    """Sources seen, under another address and gone, by timers of the stream."""
    arriving, out, state = (shared_path(spark, x) for x in ("beats", "events", "state"))
    beats = src.beats(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    beats.write.parquet(arriving)
    found = source_events(spark.readStream.schema(beats.schema).parquet(arriving), HOURS, LATENESS)
    query = (
        found.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out).withColumn("at", F.col("at").cast("timestamp_ntz"))


# Planned chunks and their results: some never come back, some late, some twice, some
# unplanned or with other sizes.
WITHIN_DAYS, LATE_HOURS = 3, 12
PLAN_SQL = """
SELECT o_orderkey AS chunk_id, CAST(floor(o_totalprice) AS BIGINT) AS n_items, CAST(o_orderdate AS TIMESTAMP) AS issued FROM orders"""
RETURNED_SQL = """
SELECT chunk_id + CASE WHEN chunk_id % 89 = 0 THEN 1000000000 ELSE 0 END AS chunk_id,
       n_items + CASE WHEN chunk_id % 53 = 0 THEN 1 ELSE 0 END AS n_items,
       issued + (chunk_id % 5) * INTERVAL '1' DAY AS returned
FROM base WHERE chunk_id % 97 <> 0
UNION ALL SELECT chunk_id, n_items, issued + INTERVAL '1' DAY AS returned FROM base WHERE chunk_id % 61 = 0"""
FINDINGS_SQL = f"""
WITH base AS ({PLAN_SQL}), got AS ({RETURNED_SQL}),
cut AS (SELECT least((SELECT max(issued) FROM base), (SELECT max(returned) FROM got)) - INTERVAL {LATE_HOURS} HOUR AS wm),
j AS (SELECT base.chunk_id AS planned, got.chunk_id AS returned_id, base.n_items AS planned_items, got.n_items AS n_items, issued, returned
      FROM base FULL JOIN got ON base.chunk_id = got.chunk_id AND returned >= issued AND returned <= issued + INTERVAL {WITHIN_DAYS} DAY)
SELECT coalesce(planned, returned_id) AS chunk_id, planned_items, n_items,
       CASE WHEN returned IS NULL THEN 'missing' WHEN issued IS NULL THEN 'unexpected'
            WHEN planned_items = n_items THEN 'done' ELSE 'size_mismatch' END AS finding
FROM j, cut
WHERE (issued IS NOT NULL AND returned IS NOT NULL)
   OR (returned IS NULL AND issued + INTERVAL {WITHIN_DAYS} DAY < wm) OR (issued IS NULL AND returned < wm)"""


@query(FINDINGS_SQL)
def completeness_findings_stream(spark, sf_dir):
    """What a stream of results tells of the planned chunks until all have arrived."""
    out, state = (shared_path(spark, x) for x in ("findings", "state"))
    plan = src.derived(spark, sf_dir, "orders", PLAN_SQL)
    plan = plan.withColumn("issued", F.col("issued").cast("timestamp"))
    got = spark.sql(RETURNED_SQL.replace("FROM base", "FROM {base}"), base=plan)
    streams = []
    for table in (plan, got):
        arriving = shared_path(spark, "arriving")
        table.write.parquet(arriving)
        streams.append(spark.readStream.schema(table.schema).parquet(arriving))
    found = completeness_stream(*streams, timedelta(days=WITHIN_DAYS), timedelta(hours=LATE_HOURS))
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("chunk_id", "planned_items", "n_items", "finding")


# ------------------------------------------------------- rank and select


@query(
    """WITH r AS (SELECT l_partkey AS v, row_number() OVER (ORDER BY l_partkey) - 1 AS pos FROM lineitem)
    SELECT w.v, min(pos) AS pos, count(pos) AS n
    FROM (SELECT DISTINCT o_custkey AS v FROM orders) w LEFT JOIN r ON r.v = w.v GROUP BY w.v"""
)
def positions_of_keys(spark, sf_dir):
    """Where each customer's number stands among the part keys of a stored sort."""
    path = shared_path(spark, "index")
    store_sorted(src.part_keys(spark, sf_dir), "v", path, RANGES)
    wanted = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("v"))
    return positions_of(spark, path, wanted, "v")


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
    SELECT pos, o_orderkey, v FROM r WHERE pos IN (SELECT l_partkey FROM lineitem)"""
)
def rows_at_positions(spark, sf_dir):
    """The orders at the positions that the part keys name, by a stored sort."""
    path = shared_path(spark, "index")
    store_sorted(src.order_values(spark, sf_dir), "o_orderkey", path, RANGES)
    wanted = src.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pos"))
    return rows_at(spark, path, wanted)


# ---------------------------------------------------- positions, special keys


@query("SELECT count(*) AS n, count(*) AS same FROM orders")
def global_position_ties(spark, sf_dir):
    """Rows with equal keys that differ in nulls get the same positions when the
    input comes in another order."""
    a = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    b = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_custkey"))
    rows = src.table(spark, sf_dir, "orders").select(F.expr("o_orderkey % 5").alias("k"), a.alias("a"), b.alias("b"), "o_orderkey")
    one = global_position(rows, "k").select("o_orderkey", F.col("pos").alias("one"))
    other = global_position(rows.orderBy(F.desc("o_orderkey")), "k").select("o_orderkey", F.col("pos").alias("other"))
    both = one.join(other, "o_orderkey")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("one") == F.col("other")).alias("same"))


@query("SELECT row_number() OVER (ORDER BY text) - 1 AS pos, md5(text) AS text_md5 FROM documents")
def global_position_texts(spark, sf_dir):
    """Whole texts as sort keys."""
    texts = src.table(spark, sf_dir, "documents").select("text")
    return global_position(texts, "text").select("pos", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
