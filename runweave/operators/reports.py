"""Audit and speedup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from runweave.operators.validate import audit_seeds

# Rows shown by a preview and by the ledger view.
PREVIEW_ROWS = 8
LEDGER_ROWS = 40

RUN_SUMMARY = (
    "run_id bigint, rows_sorted bigint, nodes bigint, chunks bigint, session_seed bigint, "
    "worker_chunks bigint, verified bigint, is_valid boolean, generate_us bigint, "
    "compute_us bigint, merge_us bigint, total_us bigint"
)


def node_contribution(ledger: DataFrame) -> DataFrame:
    """Chunks, items, sort time and threads of every node."""
    return ledger.groupBy("worker_name").agg(
        F.count("*").alias("chunks"),
        F.sum("n_items").alias("items"),
        F.sum("sort_us").alias("sort_us"),
        F.max("threads").alias("threads"),
    )


def _ends(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """All rows if there are at most ``limit``, else the first and the last
    ``limit // 2``; with ``side``, 0-based ``pos`` and the total ``n``.

    Two top-k selections and a count; no full sort.  The windows see at most
    ``limit`` rows.
    """
    half = limit // 2
    total = df.agg(F.count("*").alias("n"))
    up = [F.asc(c) for c in order]
    down = [F.desc(c) for c in order]

    def numbered(rows: DataFrame, by: list[Column]) -> DataFrame:
        rank = F.row_number().over(W.orderBy(*by)).cast("bigint")
        return rows.withColumn("__r", rank).withColumn("n", total.scalar())

    head = numbered(df.orderBy(*up).limit(limit), up).where(
        (F.col("n") <= limit) | (F.col("__r") <= half)
    )
    tail = numbered(df.orderBy(*down).limit(half), down).where(F.col("n") > limit)
    head = head.select(
        F.when(F.col("n") <= limit, "all").otherwise("head").alias("side"),
        (F.col("__r") - 1).alias("pos"), "n", *df.columns,
    )
    tail = tail.select(
        F.lit("tail").alias("side"), (F.col("n") - F.col("__r")).alias("pos"), "n", *df.columns
    )
    return head.unionByName(tail)


def preview(df: DataFrame, order_by: str, k: int = PREVIEW_ROWS) -> DataFrame:
    """First and last values of ``df`` in the order of ``order_by``; ties are in
    the order of the other columns, so the two ends do not overlap."""
    return _ends(df, [order_by, *[c for c in df.columns if c != order_by]], k)


def ledger_view(ledger: DataFrame, session_seed: int, limit: int = LEDGER_ROWS) -> DataFrame:
    """Chunks in order of their id, the middle left out and counted in
    ``hidden`` when there are more than ``limit``."""
    columns = ["chunk_id", "worker_name", "seed", "session_seed", "sort_us", "roundtrip_us"]
    shown = _ends(ledger.select(*columns), columns, limit)
    return shown.select(
        *columns,
        F.col("session_seed").eqNullSafe(F.lit(session_seed).cast("bigint")).alias("seed_matches"),
        (F.col("roundtrip_us") - F.col("sort_us")).alias("transfer_us"),
        F.greatest(F.col("n") - limit, F.lit(0)).alias("hidden"),
    )


def run_summary(
    ledger: DataFrame,
    session_seed: int,
    sortedness: DataFrame,
    run_id: int,
    generate_us: int | None = None,
    compute_us: int | None = None,
    merge_us: int | None = None,
) -> DataFrame:
    """One row about a run.  ``sortedness`` is the row of `check_sorted` on its
    result; the run is valid if that is sorted and as long as the ledger says.
    """
    totals = ledger.agg(
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"),
        F.countDistinct("worker_name").alias("nodes"),
        F.count("*").alias("chunks"),
    )
    seeds = audit_seeds(ledger, session_seed)
    # One-row tables, brought together as scalar values.
    valid = totals.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        sortedness.select("n").scalar().alias("rows_sorted"),
        "nodes",
        "chunks",
        F.lit(session_seed).cast("bigint").alias("session_seed"),
        seeds.select("worker_chunks").scalar().alias("worker_chunks"),
        seeds.select("verified").scalar().alias("verified"),
        (
            sortedness.select("is_sorted").scalar()
            & (sortedness.select("n").scalar() == F.col("items"))
        ).alias("is_valid"),
        F.lit(generate_us).cast("bigint").alias("generate_us"),
        F.lit(compute_us).cast("bigint").alias("compute_us"),
        F.lit(merge_us).cast("bigint").alias("merge_us"),
    )
    spent = [F.coalesce(F.col(c), F.lit(0)) for c in ("compute_us", "merge_us")]
    return valid.withColumn("total_us", spent[0] + spent[1])


def append_run(summary: DataFrame, path: str) -> None:
    """Add a summary to the table of runs all nodes can read.

    A run has a folder of its own, named by ``run_id``, that is replaced as a
    whole: appending the same run again, after a retry or a failure, leaves it once.
    """
    options = {"partitionOverwriteMode": "dynamic"}
    summary.write.mode("overwrite").options(**options).partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The table of runs that `append_run` has written."""
    columns = [c.split()[0] for c in RUN_SUMMARY.split(", ")]
    return spark.read.schema(RUN_SUMMARY).parquet(path).select(*columns)


def _ratio(serial: Column, parallel: Column) -> Column:
    return F.when(parallel > 0, serial / parallel).otherwise(F.lit(0.0))


def compare_runs(
    history: DataFrame, parallel_modes: tuple[str, ...] = ("distributed", "local")
) -> DataFrame:
    """Latest serial run against the latest run of each parallel mode, per
    dataset that has both: speedup, efficiency in percent of ``k``, verdict.

    One grouping, no join; the latest run of a dataset is found by partial
    maxima however many runs it has.
    """
    run = F.struct("compute_us", "k")
    when = F.struct("started_at", "run_id")
    latest = history.groupBy("dataset_id").agg(
        *[
            F.max_by(run, F.when(F.col("mode") == m, when)).alias(m)
            for m in ("serial", *parallel_modes)
        ]
    )
    pairs = latest.select(
        "dataset_id",
        F.col("serial.compute_us").alias("serial_us"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("mode"),
                        F.col(f"{m}.compute_us").alias("parallel_us"),
                        F.col(f"{m}.k").alias("k"),
                    )
                    for m in parallel_modes
                ]
            )
        ),
    ).where(F.col("serial_us").isNotNull() & F.col("parallel_us").isNotNull())
    speedup = _ratio(F.col("serial_us"), F.col("parallel_us"))
    return pairs.select(
        "dataset_id",
        "mode",
        "k",
        "serial_us",
        "parallel_us",
        speedup.alias("speedup"),
        F.when(F.col("k") > 0, speedup / F.col("k") * 100).otherwise(F.lit(0.0)).alias("efficiency"),
        F.when(speedup > 1, "faster").otherwise("not faster").alias("verdict"),
    )


def scaling_curve(history: DataFrame) -> DataFrame:
    """Best time per dataset and ``k``, and its speedup over ``k = 1``.

    The window sees one row per distinct ``k`` of a dataset, not its runs.
    """
    best = history.groupBy("dataset_id", "k").agg(F.min("compute_us").alias("best_us"))
    base = F.max(F.when(F.col("k") == 1, F.col("best_us"))).over(W.partitionBy("dataset_id"))
    return (
        best.withColumn("base_us", base)
        .where(F.col("base_us").isNotNull())
        .withColumn("speedup", _ratio(F.col("base_us"), F.col("best_us")))
    )
