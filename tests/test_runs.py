"""Ledgers of real sorts, selection from counts, sketches, ties, events, runs kept once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runweave.operators import (
    add_run_sketches,
    append_run,
    assign_chunks,
    check_complete,
    check_sorted,
    chunk_contents,
    range_pivots,
    read_runs,
    run_sketches,
    run_summary,
    select_ranks,
    sketch_pivots,
    sorted_runs_with_ledger,
    strided_values,
)
from runweave.operators.sketches import RANK_ERROR
from runweave.storage import shared_path
from runweave.streaming import source_events

SEED = 123456789


def values(spark, n, seed=1, spread=1 << 40):
    rng = random.Random(seed)
    return [rng.randrange(-spread, spread) for _ in range(n)]


# -------------------------------------------------------------------- ledger


def test_ledger_equals_what_was_sorted(spark):
    rows = [(i // 100 if i < 900 else None, v, str(i)) for i, v in enumerate(values(spark, 1_000, spread=50))] + [(3, None, "x")]
    chunked = spark.createDataFrame(rows, "chunk_id long, v long, other string").repartition(7)
    runs, ledger = sorted_runs_with_ledger(chunked, SEED)
    found = {r.chunk_id: r for r in ledger.collect()}
    planned = {r.chunk_id: r for r in chunk_contents(chunked).collect()}
    assert set(found) == set(planned) == {*range(9), None}
    for chunk, r in found.items():
        own = sorted(((v is not None, v or 0), v) for c, v, _ in rows if c == chunk)
        assert (r.n_items, r.first, r.last, r.content) == (len(own), own[0][1], own[-1][1], planned[chunk].content)
        assert r.tasks >= 1 and r.retried == 0 and r.sort_us >= 0 and r.threads >= 1
    stored = runs.orderBy("place").collect()
    assert sorted(map(str, ((r.chunk_id, r.v, r.other) for r in stored))) == sorted(map(str, rows))
    keys = [(r.chunk_id is not None, r.chunk_id or 0, r.v is not None, r.v or 0) for r in stored]
    assert keys == sorted(keys)


def test_ledger_of_a_hot_chunk_and_of_nothing(spark):
    chunked = spark.range(40_000).select(F.lit(1).cast("long").alias("chunk_id"), (F.col("id") % 977).alias("v"))
    runs, ledger = sorted_runs_with_ledger(chunked, SEED)
    (row,) = ledger.collect()
    assert (row.n_items, row.first, row.last) == (40_000, 0, 976) and row.tasks > 1
    assert check_complete(chunk_contents(chunked), ledger).first()["complete"]
    assert check_sorted(runs, "chunk_id", "place", "v").first()["is_sorted"]
    runs, ledger = sorted_runs_with_ledger(chunked.where("v < 0"), SEED)
    assert runs.count() == ledger.count() == 0


def test_ledger_leaves_a_failed_attempt_out(spark):
    """Content that differs from the plan shows; a lost row does too."""
    chunked = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "chunk_id long, v long")
    _, ledger = sorted_runs_with_ledger(chunked.where("v <> 6"), SEED)
    assert check_complete(chunk_contents(chunked), ledger).first()["size_mismatch"] == 1
    changed = chunk_contents(chunked.withColumn("v", F.col("v") + 1)).join(chunk_contents(chunked), "chunk_id")
    assert len(changed.columns) == 5 and all(r[2] != r[4] for r in changed.collect())


# ----------------------------------------------------------------- selection


@pytest.mark.parametrize("spread", [3, 500, 1 << 20, 1 << 60])
def test_ranks_equal_the_sorted_list(spark, spread):
    data = values(spark, 3_000, spread=spread)
    df = spark.createDataFrame([(v,) for v in data + [None]], "v long").repartition(5)
    ranks = [0, 1, 1_500, 1_500, 2_998, 2_999]
    assert select_ranks(df, "v", ranks) == [sorted(data)[r] for r in ranks]
    weighted = df.groupBy("v").agg(F.count("*").alias("m"))
    assert select_ranks(weighted, "v", ranks, weight="m") == [sorted(data)[r] for r in ranks]
    with pytest.raises(ValueError):
        select_ranks(df, "v", [3_000])


@pytest.mark.parametrize("spread", [40, 1 << 34])
def test_strided_values_equal_the_sorted_runs(spark, spread):
    rows = [(i % 3 if i % 5 else None, v if i % 11 else None) for i, v in enumerate(values(spark, 4_000, spread=spread))]
    df = spark.createDataFrame(rows, "run long, v long").repartition(4)
    want = []
    for run in (None, 0, 1, 2):
        own = sorted((v for r, v in rows if r == run), key=lambda v: (v is not None, v or 0))
        want += own[:: max(1, len(own) // 100)]
    got = [r.v for r in strided_values(df, "v", "run", 100).collect() for _ in range(r.m)]
    assert sorted(got, key=lambda v: (v is not None, v or 0)) == sorted(want, key=lambda v: (v is not None, v or 0))


def shuffled_records(spark):
    """Records that all stages so far have written to shuffles."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.length()))


def test_pivots_by_stride_shuffle_counts_and_not_rows(spark):
    df = spark.range(400_000).select((F.col("id") % 3).alias("run"), (F.col("id") % 1_009).alias("v"))
    before = shuffled_records(spark)
    pivots = range_pivots(df, "v", 4, "stride", "run")
    assert shuffled_records(spark) - before < 100_000
    assert all(abs(x - 1_009 * i / 4) < 5 for i, x in enumerate(pivots, 1))
    assert range_pivots(df.where("v < 0"), "v", 4, "stride", "run") == []


# ------------------------------------------------------------------ sketches


def test_pivots_of_sketches_are_within_their_bound(spark):
    data = values(spark, 60_000)
    df = spark.createDataFrame([(i % 9, v) for i, v in enumerate(data)], "run long, v long")
    path = shared_path(spark, "sketches")
    for some in ("run < 4", "run >= 4", "run = 2"):
        add_run_sketches(run_sketches(df.where(some), "v", "run"), path)
    stored = spark.read.parquet(path)
    assert stored.agg(F.sum("n")).first()[0] == 60_000
    pivots = sketch_pivots(stored, 10)
    line = sorted(data)
    for i, x in enumerate(pivots, 1):
        assert abs(sum(v <= x for v in line) / len(line) - i / 10) < 2 * RANK_ERROR
    assert sketch_pivots(stored.where("false"), 10) == [] and sketch_pivots(stored, 1) == []


# ---------------------------------------------------------------------- ties


def test_ties_have_one_answer_however_rows_lie(spark):
    up = spark.range(50).select(F.lit(1).alias("c"), F.lit(1).alias("s"), F.col("id").alias("v"))
    answers = {tuple(check_sorted(df, "c", "s", "v").first()) for df in (up, up.orderBy(F.desc("v")), up.repartition(7))}
    assert answers == {(50, 0, 0, True)}
    hot = spark.range(30_000).select(F.lit(1).alias("c"), F.lit(1).alias("s"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("v"))
    later = spark.createDataFrame([(1, 2, 5), (2, 0, 4)], "c int, s int, v long")
    assert tuple(check_sorted(hot.unionByName(later), "c", "s", "v", 6).first()) == (30_002, 1, 1, False)


# -------------------------------------------------------------------- events


def test_events_of_a_stream_in_two_parts(spark):
    start = datetime(2024, 1, 1)
    beats = [("a", 1, "10.0.0.1", 0), ("a", 1, "127.0.0.1", 2), ("a", 1, "10.0.0.1", 3), ("b", 1, "x", 0), ("b", 1, "y", 4)]
    more = [("a", 1, "10.0.0.9", 30), ("b", 1, "y", 8), ("c", 2, None, 100)]
    arriving, out, state = (shared_path(spark, x) for x in ("beats", "events", "state"))
    for part in (beats, more):
        rows = [(n, p, h, start + timedelta(seconds=s)) for n, p, h, s in part]
        spark.createDataFrame(rows, "name string, port int, host string, ts timestamp").coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("name string, port int, host string, ts timestamp").parquet(arriving)
        found = source_events(stream, lateness=timedelta(seconds=1))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {(r.name, r.event, (r.at - start).total_seconds(), r.host) for r in spark.read.parquet(out).collect()}
    assert got == {
        ("a", "seen", 0, "10.0.0.1"), ("a", "address", 2, "127.0.0.1"), ("a", "gone", 7, "127.0.0.1"),
        ("a", "seen", 30, "10.0.0.9"), ("a", "gone", 34, "10.0.0.9"),
        ("b", "seen", 0, "x"), ("b", "address", 4, "y"), ("b", "gone", 12, "y"),
    }


# ---------------------------------------------------------------------- runs


def test_a_run_appended_twice_is_there_once(spark):
    chunked = assign_chunks(spark.range(100).select("id", F.col("id").alias("v")), "id", 1, min_size=30)
    runs, ledger = sorted_runs_with_ledger(chunked.select("chunk_id", "v"), SEED)
    order = check_sorted(runs, "chunk_id", "place", "v")
    path = shared_path(spark, "runs")
    for run_id in (1, 2, 2, 1):
        append_run(run_summary(ledger, SEED, order, run_id=run_id), path)
    rows = read_runs(spark, path).collect()
    assert sorted(r.run_id for r in rows) == [1, 2] and all(r.is_valid and r.rows_sorted == 100 for r in rows)
