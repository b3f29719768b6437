"""Rank and select on stored sorts, summaries of order, files replaced whole, shares without weight."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from runweave.operators import (
    apportion,
    check_sorted,
    check_summaries,
    groups,
    merge_summaries,
    order_summaries,
    positions_of,
    rows_at,
    sorted_runs_with_ledger,
    store_sorted,
)
from runweave.sources import read_numbers, write_numbers
from runweave.storage import cut_lineage, shared_path

# ------------------------------------------------------------ rank and select


def sort_key(v):
    return (0,) if v is None else (2,) if v != v else (1, v)


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_positions_equal_a_sorted_list(spark, kind):
    rng = random.Random(3)
    cast = {"long": int, "double": float, "string": lambda x: f"k{x:05d}"}[kind]
    keys = [cast(7) if i % 3 == 0 else None if i % 50 == 1 else cast(rng.randrange(4_000)) for i in range(6_000)]
    if kind == "double":
        keys += [float("nan")] * 5
    path = shared_path(spark, "index")
    rows = [(k, i) for i, k in enumerate(keys)]
    entries = store_sorted(spark.createDataFrame(rows, f"v {kind}, i long").repartition(5), "v", path, 6)
    assert entries.agg(F.sum("n")).first()[0] == len(keys)
    asked = [None, *map(cast, range(-3, 4_010, 7)), cast(7), cast(7)] + ([float("nan")] if kind == "double" else [])
    got = positions_of(spark, path, spark.createDataFrame([(k,) for k in asked], f"v {kind}"), "v").collect()
    placed = sorted(map(sort_key, keys))
    assert len(got) == len(set(map(sort_key, asked)))
    for r in got:
        low, high = bisect.bisect_left(placed, sort_key(r.v)), bisect.bisect_right(placed, sort_key(r.v))
        assert (r.pos, r.n) == ((low, high - low) if high > low else (None, 0)), r
    wanted = [-1, None, 0, 1, 1, 2_500, 5_999, 10_000]
    found = rows_at(spark, path, spark.createDataFrame([(p,) for p in wanted], "pos long")).collect()
    assert {r.pos: sort_key(r.v) for r in found} == {p: placed[p] for p in (0, 1, 2_500, 5_999)} and len(found) == 4
    assert all(sort_key(keys[r.i]) == sort_key(r.v) for r in found)


def test_lookups_read_only_the_files_asked_for(spark):
    path = shared_path(spark, "index")
    df = spark.range(80_000).select(F.when(F.col("id") % 2 == 0, F.lit(40_000)).otherwise(F.col("id")).alias("v"))
    entries = store_sorted(df, "v", path, 16).orderBy("start").collect()
    assert len(entries) > 8
    # Without the files in the middle of the hot key the answer is the same.
    inner = [e["file"] for e in entries if e["first"] == e["last"] == 40_000][1:-1]
    assert inner
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    for f in inner:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{f}"), False)
    (row,) = positions_of(spark, path, spark.createDataFrame([(40_000,)], "v long"), "v").collect()
    assert (row.pos, row.n) == (20_000, 40_000)
    read = rows_at(spark, path, spark.createDataFrame([(5,), (7,)], "pos long"))
    assert [f.rsplit("/", 1)[1] for f in read.inputFiles() if "/rows/" in f] == [entries[0]["file"]]
    assert sorted(r.v for r in read.collect()) == [11, 15]


def test_index_of_nothing(spark):
    path = shared_path(spark, "index")
    assert store_sorted(spark.createDataFrame([], "v long, x string"), "v", path).count() == 0
    asked = spark.createDataFrame([(1,), (None,)], "v long")
    assert sorted(map(str, positions_of(spark, path, asked, "v").collect())) == sorted(
        ["Row(v=1, pos=None, n=0)", "Row(v=None, pos=None, n=0)"]
    )
    assert rows_at(spark, path, asked, "v").count() == 0


# ------------------------------------------------------------ order summaries


def stored(spark, rows, kind="long", tasks=4):
    df = spark.createDataFrame(rows, f"piece long, v {kind}").coalesce(tasks)
    return cut_lineage(df.withColumn("place", F.monotonically_increasing_id()), "lying")


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_summaries_equal_the_check_of_rows(spark, kind, batch):
    rng = random.Random(batch)
    odd = [None] + ([float("nan")] if kind == "double" else [])
    rows = [(i // 41 if i < 400 else None, rng.choice([*map(float if kind == "double" else int, range(30)), *odd])) for i in range(450)]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = stored(spark, rows, kind)
        want = check_sorted(df, "piece", "place", "v").first()
        summaries = order_summaries(df, "piece", "place", "v")
        assert check_summaries(summaries, "piece").first() == want and want.inner_violations > 0
        # In any order and any number of goes.
        halves = [df.where(F.col("place") % 2**33 < 50), df.where(F.col("place") % 2**33 >= 50)]
        parts = [order_summaries(h, "piece", "place", "v") for h in reversed(halves)]
        merged = merge_summaries(parts[0].unionByName(parts[1]))
        assert sorted(map(str, merged.collect())) == sorted(map(str, summaries.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_summaries_shuffle_no_rows(spark):
    chunked = spark.range(50_000).select((F.col("id") % 5).alias("chunk_id"), F.xxhash64("id").alias("v"))
    runs, _ = sorted_runs_with_ledger(chunked, 1)
    summaries = order_summaries(runs, "chunk_id", "place", "v")
    plan = summaries._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow") :]
    assert summaries.agg(F.sum("n"), F.sum("drops")).first()[:] == (50_000, 0) and summaries.count() == 5
    none = check_summaries(order_summaries(runs.where("false"), "chunk_id", "place", "v"), "chunk_id").first()
    assert none[:] == (0, 0, 0, True)


# ---------------------------------------------------------------- number files


def test_a_write_that_dies_leaves_the_old_numbers(spark, tmp_path):
    path = str(tmp_path / "numbers")
    assert write_numbers(spark.range(5).toDF("v"), path) == 5
    bad = spark.range(1_000).select(F.when(F.col("id") == 900, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="dies"):
        write_numbers(bad, path)
    assert sorted(r.v for r in read_numbers(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["numbers"]


def test_numbers_may_replace_what_they_are_read_from(spark, tmp_path):
    path = str(tmp_path / "numbers")
    write_numbers(spark.range(5).toDF("v"), path)
    assert write_numbers(read_numbers(spark, path).select((F.col("v") + 1).alias("v")), path) == 5
    assert sorted(r.v for r in read_numbers(spark, path).collect()) == [1, 2, 3, 4, 5]
    assert write_numbers(spark.range(0).toDF("v"), path) == 0
    assert read_numbers(spark, path).count() == 0
    assert write_numbers(spark.range(2).toDF("v"), path, mode="append") == 2
    with pytest.raises(Exception, match="(?i)exists"):
        write_numbers(spark.range(2).toDF("v"), path, mode="error")


# ---------------------------------------------------------------------- shares


def test_shares_without_weight(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("b", 1, None), ("b", 2, 4), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {(r.g, r.o): r.share for r in apportion(df, "g", "o", "w", 10).collect()}
    assert got == {("a", 1): 3, ("a", 2): 3, ("a", 3): 4, ("b", 1): 0, ("b", 2): 10, ("c", 1): 10}


def test_long_group_names_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(groups, "MAX_BROADCAST_BYTES", 1_000)
    df = spark.range(60).select(F.repeat((F.col("id") % 6).cast("string"), 400).alias("g"), "id")
    totals = df.groupBy("g").agg(F.count("*").alias("n"))
    out = groups.attach_group_totals(df, totals, "g", "n")
    assert out.count() == 60 and out.select("n").distinct().collect()[0].n == 10
