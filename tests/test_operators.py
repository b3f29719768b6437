"""Ranges, chunks, shares, validation, reports and scalar functions."""

import bisect
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from runweave.functions import chunk_seed, narrow_int32
from runweave.operators import (
    apportion,
    assign_chunks,
    assign_range,
    audit_seeds,
    check_complete,
    check_conserved,
    chunk_manifest,
    chunk_size,
    compare_runs,
    groups,
    ledger_view,
    node_contribution,
    preview,
    range_histogram,
    range_pivots,
    run_summary,
    scaling_curve,
)

LEDGER = (
    "chunk_id bigint, worker_name string, threads int, seed bigint, session_seed bigint, "
    "n_items bigint, sort_us bigint, roundtrip_us bigint"
)
HISTORY = "dataset_id bigint, run_id bigint, mode string, started_at timestamp, k int, compute_us bigint"


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "v bigint")


def ledger(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


# ------------------------------------------------------------------ ranges


@pytest.mark.parametrize("pivots", [[], [3], [3, 3], [1, 5, 5, 9], list(range(0, 600, 3))])
def test_ranges_match_binary_search(spark, pivots):
    xs = list(range(-2, 605)) if len(pivots) > 10 else list(range(-2, 12))
    got = {r["v"]: r["bucket"] for r in assign_range(values(spark, xs), "v", pivots).collect()}
    assert got == {x: bisect.bisect_right(pivots, x) for x in xs}


def test_filter_on_many_ranges_stays_small(spark):
    df = assign_range(values(spark, range(5_000)), "v", list(range(0, 5_000, 2)))
    assert df.where("bucket = 7").count() == 2
    assert df.where("bucket > 7 and v < 100").count() == 86


@pytest.mark.parametrize("dtype,pivots", [
    ("date", [date(2024, 1, 3)]),
    ("timestamp", [datetime(2024, 1, 3, tzinfo=timezone.utc)]),
    ("timestamp_ntz", [datetime(2024, 1, 3)]),
    ("string", ["2024-01-03"]),
])
def test_ranges_of_other_types(spark, dtype, pivots):
    df = spark.range(5).selectExpr(
        "id", f"cast(date_add(date'2024-01-01', cast(id as int)) as {dtype}) as v"
    )
    got = {r["id"]: r["bucket"] for r in assign_range(df, "v", pivots).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


def test_histogram_and_unsorted_pivots(spark):
    rows = assign_range(values(spark, [1, 2, 3, 3, 4]), "v", [3])
    got = sorted(tuple(r) for r in range_histogram(rows).collect())
    assert got == [(0, 2, 1, 2), (1, 3, 3, 4)]
    with pytest.raises(ValueError):
        assign_range(rows, "v", [3, 1])


def test_sampled_pivots_cut_evenly(spark):
    df = spark.range(200_000).select((F.col("id") * 7 % 200_000).alias("v"))
    pivots = range_pivots(df, "v", 10)
    assert len(pivots) == 9 and pivots == sorted(pivots)
    assert all(abs(x - 20_000 * i) < 4_000 for i, x in enumerate(pivots, 1))


def test_stride_pivots(spark):
    """Three runs of 4,500 rows: every second value is pooled."""
    rows = [(r, i * 3 + r) for r in range(3) for i in range(4_500)]
    df = spark.createDataFrame(rows, "run bigint, v bigint").repartition(5)
    pool = sorted(v for r in range(3) for v in sorted(v for q, v in rows if q == r)[::2])
    want = [pool[int(i * ((len(pool) - 1) / 6))] for i in range(1, 6)]
    assert range_pivots(df, "v", 6, method="stride", run="run") == want


# -------------------------------------------------------- chunks and shares


def test_chunk_sizes():
    assert chunk_size(1_000_000, 2) == 15_625
    assert chunk_size(1_000, 2) == 10_000
    assert chunk_size(10_000_000, 12, per_unit=1) == 500_000


def test_chunks_are_contiguous(spark):
    df = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("k"), F.col("id").alias("v"))
    chunked = assign_chunks(df, "k", units=3, per_unit=1, min_size=10, max_size=300)
    assert {(r["k"], r["pos"], r["chunk_id"]) for r in chunked.collect()} == {
        (i, i, i // 300 + 1) for i in range(1_000)
    }
    sizes = {r["chunk_id"]: r["n_items"] for r in chunk_manifest(chunked, "k").collect()}
    assert sizes == {1: 300, 2: 300, 3: 300, 4: 100}


@pytest.mark.parametrize("limit", [None, 1])
def test_shares(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(groups, "MAX_BROADCAST_GROUPS", limit)
        monkeypatch.setattr(groups, "HOT_GROUPS", 2)
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 1, 5), (None, 1, 2), (None, 2, 1)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {(r["g"], r["o"]): r["share"] for r in apportion(df, "g", "o", "w", 10).collect()}
    assert got == {
        ("a", 1): 2, ("a", 2): 2, ("a", 3): 6, ("b", 1): 10, (None, 1): 7, (None, 2): 3,
    }
    equal = apportion(df, "g", "o", "w", 10, "equal").collect()
    assert {(r["g"], r["o"]): r["share"] for r in equal} == {
        ("a", 1): 3, ("a", 2): 3, ("a", 3): 4, ("b", 1): 10, (None, 1): 5, (None, 2): 5,
    }


def test_shares_of_many_groups_with_a_hot_one(spark, monkeypatch):
    """Beyond the broadcast bound only the hot group is broadcast."""
    monkeypatch.setattr(groups, "MAX_BROADCAST_GROUPS", 10)
    monkeypatch.setattr(groups, "HOT_GROUPS", 5)
    df = spark.range(3_000).selectExpr(
        "if(id % 3 = 0, -1, id % 500) as g", "id as o", "id % 16 + 1 as w"
    )
    out = apportion(df, "g", "o", "w", 1_000)
    assert out.count() == 3_000
    assert [r["s"] for r in out.groupBy("g").agg(F.sum("share").alias("s")).select("s").distinct().collect()] == [1_000]


# --------------------------------------------------------------- validation


def test_conserved(spark):
    a = values(spark, [1, 2, 2, 3])
    assert tuple(check_conserved(a, values(spark, [3, 2, 1, 2])).first()) == (4, 4, True, True)
    assert tuple(check_conserved(a, values(spark, [3, 2, 1, 1])).first()) == (4, 4, True, False)
    assert tuple(check_conserved(a, values(spark, [])).first()) == (4, 0, False, False)


def test_complete(spark):
    plan = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "chunk_id bigint, n_items bigint")
    got = spark.createDataFrame([(1, 10), (1, 10), (2, 9), (4, 1)], "chunk_id bigint, n_items bigint")
    r = check_complete(plan, got).first().asDict()
    assert r == {
        "chunks": 3, "results": 4, "missing": 1, "duplicate": 1,
        "unexpected": 1, "size_mismatch": 1, "complete": False,
    }
    assert check_complete(plan, plan).first()["complete"] is True
    # As many results as chunks do not make a run complete.
    swapped = plan.withColumn("chunk_id", F.greatest("chunk_id", F.lit(2)))
    assert check_complete(plan, swapped).first()["complete"] is False


def test_seeds(spark):
    good = spark.range(1, 4).select(
        F.col("id").alias("chunk_id"), F.lit("W").alias("worker_name"), chunk_seed(9, "id").alias("seed"),
        F.lit(9).cast("bigint").alias("session_seed"),
    )
    assert audit_seeds(good, 9).first().asDict() == {
        "worker_chunks": 3, "verified": 3, "wrong_chunk_seeds": 0, "all_verified": True,
    }
    bad = good.withColumn("session_seed", F.when(F.col("chunk_id") > 1, F.col("session_seed")))
    assert audit_seeds(bad, 9).first()["all_verified"] is False
    own = good.withColumn("worker_name", F.lit("Master Node"))
    assert audit_seeds(own, 9).first().asDict() == {
        "worker_chunks": 0, "verified": 0, "wrong_chunk_seeds": 0, "all_verified": None,
    }


# ------------------------------------------------------------------ reports


def test_node_contribution(spark):
    rows = [(1, "a", 4, 0, 0, 10, 5, 6), (2, "a", 4, 0, 0, 20, 7, 9), (3, "b", 2, 0, 0, 1, 1, 1)]
    got = {tuple(r) for r in node_contribution(ledger(spark, rows)).collect()}
    assert got == {("a", 2, 30, 12, 4), ("b", 1, 1, 1, 2)}


@pytest.mark.parametrize("n,want", [
    (0, []),
    (8, [("all", i) for i in range(8)]),
    (9, [("head", i) for i in range(4)] + [("tail", i) for i in range(5, 9)]),
])
def test_preview(spark, n, want):
    got = preview(values(spark, range(n, 0, -1)), "v").collect()
    assert sorted((r["side"], r["pos"]) for r in got) == want
    assert all(r["v"] == r["pos"] + 1 and r["n"] == n for r in got)


@pytest.mark.parametrize("n,shown,hidden", [(40, 40, 0), (41, 40, 1)])
def test_ledger_view(spark, n, shown, hidden):
    rows = [(i, "a", 4, i, 9 if i else None, 1, 5, 8) for i in range(n)]
    got = ledger_view(ledger(spark, rows), 9).orderBy("chunk_id").collect()
    assert len(got) == shown and {r["hidden"] for r in got} == {hidden}
    assert [r["seed_matches"] for r in got] == [False] + [True] * (shown - 1)
    assert {r["transfer_us"] for r in got} == {3}


def test_run_summary(spark):
    rows = [(1, "Master Node", 4, 0, 9, 10, 5, 6), (2, "w", 4, 0, 9, 5, 7, 9)]
    order = spark.createDataFrame([(15, True)], "n bigint, is_sorted boolean")
    r = run_summary(ledger(spark, rows), 9, order, run_id=3, compute_us=20, merge_us=4).first()
    assert (r["rows_sorted"], r["nodes"], r["worker_chunks"], r["verified"]) == (15, 2, 1, 1)
    assert (r["is_valid"], r["total_us"]) == (True, 24)
    short = spark.createDataFrame([(14, True)], "n bigint, is_sorted boolean")
    assert run_summary(ledger(spark, rows), 9, short, run_id=3).first()["is_valid"] is False


def test_speedups(spark):
    day = "2024-01-0"
    rows = [
        (1, 1, "serial", day + "1", 1, 99), (1, 2, "serial", day + "2", 1, 45_812_300),
        (1, 3, "distributed", day + "2", 2, 20_627_100), (1, 4, "local", day + "3", 0, 50_000_000),
        (2, 5, "serial", day + "1", 1, 10), (2, 6, "distributed", day + "1", 2, 0),
        (3, 7, "distributed", day + "1", 2, 5),
    ]
    df = spark.createDataFrame(rows, HISTORY.replace("timestamp", "string")).withColumn(
        "started_at", F.to_timestamp("started_at")
    )
    got = {(r["dataset_id"], r["mode"]): r for r in compare_runs(df).collect()}
    assert set(got) == {(1, "distributed"), (1, "local"), (2, "distributed")}
    both = got[1, "distributed"]
    assert (round(both["speedup"], 2), round(both["efficiency"], 2)) == (2.22, 111.05)
    assert both["verdict"] == "faster"
    assert got[1, "local"]["efficiency"] == 0 and got[1, "local"]["verdict"] == "not faster"
    assert got[2, "distributed"]["speedup"] == 0


def test_scaling_curve(spark):
    rows = [(1, 1, "local", None, 1, 90), (1, 2, "local", None, 1, 80), (1, 3, "local", None, 4, 20),
            (2, 4, "local", None, 2, 20)]
    got = {tuple(r) for r in scaling_curve(spark.createDataFrame(rows, HISTORY)).collect()}
    assert got == {(1, 1, 80, 80, 1.0), (1, 4, 20, 80, 4.0)}


# ------------------------------------------------------------------ scalars


@pytest.mark.parametrize("session,chunk", [
    (123456789, 7), (999_999_999, 2**62), (100_000, 0), (5, -3), (2**40, 3_500_000_000),
])
def test_chunk_seed(spark, session, chunk):
    got = values(spark, [chunk]).select(chunk_seed(session, "v").alias("s")).first()["s"]
    assert got == (session * 1_000_003 + chunk * 2_654_435_761) % 1_000_000_000
    if (session, chunk) == (123456789, 7):
        assert got == 740420694


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_narrow(spark, ansi):
    df = values(spark, [-(2**31), 2**31 - 1, 2**31, None])
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        out = narrow_int32(df, "v", "null")
        assert dict(out.dtypes) == {"v": "int"}
        assert [r["v"] for r in out.collect()] == [-(2**31), 2**31 - 1, None, None]
        assert narrow_int32(df.where("v < 5 or v = 2147483647"), "v").count() == 2
        with pytest.raises(Exception, match="does not fit into int32"):
            narrow_int32(df, "v").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
