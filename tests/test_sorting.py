"""Sort, merge and position: edge vectors, skew, independence of partitioning."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runweave.operators import (
    check_order,
    check_sorted,
    global_position,
    global_sort,
    index_rows,
    merge_runs,
    position_in_group,
    range_merge,
    sorted_runs,
)
from runweave.operators import layout as lay
from runweave.operators.layout import numbered_rows, ordered_rows, plan_layout


def values(spark, xs, parts=3):
    return spark.createDataFrame([(x,) for x in xs], "v bigint").repartition(parts)


def in_order(df):
    """Values as they lie, through numbered rows on shared storage."""
    return [r["v"] for r in index_rows(df).orderBy("pos").collect()]


def positions(df):
    return [(r["pos"], r["v"]) for r in df.select("pos", "v").orderBy("pos").collect()]


EDGE = {
    "empty": [],
    "single": [4],
    "all equal": [7] * 50,
    "sorted": list(range(40)),
    "reversed": list(range(40, 0, -1)),
    "fewer values than ranges": [1, 2] * 30,
    "negative and large": [-(2**63), 2**63 - 1, 0, -1, 1],
    "null": [3, None, 1, None, 2] * 5,
}


def ascending(xs):
    return sorted(xs, key=lambda x: (x is not None, x or 0))


@pytest.mark.parametrize("case", EDGE)
@pytest.mark.parametrize("p", [1, 3, 8])
def test_position_and_sort_edges(spark, case, p):
    xs = ascending(EDGE[case])
    assert positions(global_position(values(spark, EDGE[case]), "v", p)) == list(enumerate(xs))
    assert in_order(global_sort(values(spark, EDGE[case]), "v", p)) == xs


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5) | st.integers(-(2**40), 2**40), max_size=60), st.integers(1, 9))
def test_position_is_a_sorted_permutation(spark, xs, p):
    assert positions(global_position(values(spark, xs), "v", p)) == list(enumerate(sorted(xs)))


def skewed_values(n=6_000):
    """A third of the rows share one value, a tenth another; the rest differ."""
    rng = random.Random(5)
    xs = [500] * (n // 3) + [-7] * (n // 10)
    xs += [rng.randrange(-(10**9), 10**9) for _ in range(n - len(xs))]
    rng.shuffle(xs)
    return xs


def test_hot_values_are_spread_over_tasks(spark):
    xs = skewed_values()
    df = values(spark, xs)
    layout = plan_layout(df, ["v"], 16)
    assert layout.skewed and not layout.collapsible
    out = ordered_rows(layout)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2.5 * len(xs) / 16
    assert in_order(out) == sorted(xs)
    assert positions(numbered_rows(layout)) == list(enumerate(sorted(xs)))


def test_repeated_values_are_counted_not_sorted(spark):
    rng = random.Random(6)
    xs = [rng.randrange(40) for _ in range(3_000)] + [17] * 1_500
    layout = plan_layout(values(spark, xs), ["v"], 8)
    assert layout.collapsible and layout.skewed
    assert in_order(ordered_rows(layout)) == sorted(xs)
    assert positions(numbered_rows(layout)) == list(enumerate(sorted(xs)))


def test_long_runs_of_copies_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lay, "COPIES_PER_ARRAY", 7)
    monkeypatch.setattr(lay, "COPIES_PER_BLOCK", 20)
    xs = skewed_values(900)
    layout = plan_layout(values(spark, xs), ["v"], 6)
    assert in_order(ordered_rows(layout)) == sorted(xs)
    assert positions(numbered_rows(layout)) == list(enumerate(sorted(xs)))


@pytest.mark.parametrize("same_payload", [False, True])
def test_rows_with_a_hot_key(spark, same_payload):
    """Rows under a hot key are told apart by their other columns; those that
    cannot be are counted."""
    rows = [(500 if i % 3 == 0 else i, "x" if same_payload and i % 3 == 0 else f"p{i}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "v bigint, payload string").repartition(4)
    layout = plan_layout(df, ["v"], 12)
    assert layout.crowded and layout.skewed == same_payload
    for got in (numbered_rows(layout), index_rows(ordered_rows(layout))):
        out = got.orderBy("pos").collect()
        assert [r["pos"] for r in out] == list(range(3_000))
        assert [r["v"] for r in out] == sorted(r[0] for r in rows)
        assert sorted((r["v"], r["payload"]) for r in out) == sorted(rows)
    sizes = [r["count"] for r in global_sort(df, "v", 12).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 2.5 * 3_000 / 12


def test_hot_null_key(spark):
    rows = [(None if i % 3 == 0 else i, i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "v bigint, id bigint").repartition(4)
    out = global_position(df, "v", 12)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2.5 * 3_000 / 12
    got = out.orderBy("pos").collect()
    assert [r["v"] for r in got] == [None] * 1_000 + [i for i in range(3_000) if i % 3]


@pytest.mark.parametrize("dtype", ["string", "double", "date", "timestamp", "decimal(12,3)"])
def test_keys_of_other_types(spark, dtype):
    keys = {
        "string": "concat('k,\"', id % 97)",
        "double": "id / 7.0D",
        "date": "date_add(date'1970-01-01', cast(id % 300 as int) - 150)",
        "timestamp": "timestamp_micros(id * 777777777 - 5)",
        "decimal(12,3)": "cast(id as decimal(12,3)) / 8",
    }
    key = keys[dtype]
    df = spark.range(1_000).selectExpr(f"cast({key} as {dtype}) as v").repartition(4)
    third = spark.range(500).select(F.lit(df.agg(F.min("v")).first()[0]).cast(dtype).alias("v"))
    for rows in (df, df.unionByName(third)):
        want = sorted(r["v"] for r in rows.collect())
        assert plan_layout(rows, ["v"], 7).crowded == (rows is not df)
        assert [v for _, v in positions(global_position(rows, "v", 7))] == want
        assert in_order(global_sort(rows, "v", 7)) == want


def test_composite_keys(spark):
    rows = [(i % 3, (i * 37) % 101) for i in range(600)]
    df = spark.createDataFrame(rows, "a bigint, v bigint").repartition(4)
    out = global_position(df, ["a", "v"], 9).orderBy("pos").collect()
    assert [(r["a"], r["v"]) for r in out] == sorted(rows)


def test_position_in_group_with_one_large_group(spark):
    rows = [(0 if i % 3 else i, i * 7 % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "g bigint, v bigint").repartition(4)
    got = position_in_group(df, "g", "v").collect()
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    want = [(g, v, i, len(vs)) for g, vs in groups.items() for i, v in enumerate(sorted(vs))]
    assert sorted((r["g"], r["v"], r["rn"], r["group_rows"]) for r in got) == sorted(want)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sort_merge_and_range_merge_agree(spark, parts):
    rng = random.Random(parts)
    xs = [rng.randrange(500) for _ in range(2_000)]
    runs = [values(spark, sorted(xs[i::4]), parts) for i in range(4)]
    want = sorted(xs)
    assert in_order(global_sort(values(spark, xs, parts), "v")) == want
    assert in_order(merge_runs(runs, "v")) == want
    assert in_order(range_merge(runs, "v", 5)) == want


def test_merge_of_no_one_and_missing_runs(spark):
    assert merge_runs([], "v", spark=spark).count() == 0
    one = values(spark, [2, 1])
    assert merge_runs([None, one], "v") is one
    assert in_order(merge_runs([values(spark, []), values(spark, [3, 4])], "v")) == [3, 4]


def test_range_merge_buckets(spark):
    runs = [values(spark, [1, 3, 4]), values(spark, [2, 3])]
    out = range_merge(runs, "v", 2, [3]).collect()
    assert [(r["bucket"], r["v"]) for r in out] == [(0, 1), (0, 2), (1, 3), (1, 3), (1, 4)]


def test_sorted_runs_keep_chunks_together(spark):
    rows = [(i % 5, (i * 31) % 97) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk_id bigint, v bigint").repartition(4)
    out = index_rows(sorted_runs(df)).orderBy("pos").collect()
    assert [(r["chunk_id"], r["v"]) for r in out] == sorted(rows)


def test_check_sorted_sees_what_lies_between_ranges(spark):
    """Every row is its own range, so every violation sits on a seam."""
    rows = [(1, 0, 1), (1, 1, 5), (2, 0, 4), (2, 1, 9), (2, 2, 8)]
    df = spark.createDataFrame(rows, "c bigint, s bigint, v bigint")
    for p in (1, 2, 5):
        r = check_sorted(df, "c", "s", "v", p).first()
        assert tuple(r) == (5, 1, 1, False)


@pytest.mark.parametrize("xs,ok", [([], True), ([1], True), ([2, 2], True), ([2, 1], False)])
def test_check_sorted_small(spark, xs, ok):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "c bigint, s bigint, v bigint")
    assert check_sorted(df, "c", "s", "v").first()["is_sorted"] is ok


def test_one_exchange_of_the_rows_and_no_single_task_window(spark):
    df = values(spark, range(2_000)).where("v >= 0")
    plan = global_position(df, "v", 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("xs,drops", [
    ([], 0), ([1], 0), ([2, 2], 0), ([2, 1], 1), ([None, None, 1], 0), ([1, None, None, 0], 1),
    ([5, 4, 4, 3, 9], 2), (list(range(100)), 0), (list(range(100, 0, -1)), 99),
])
@pytest.mark.parametrize("batch", [2, 10_000])
def test_check_order_as_rows_lie(spark, xs, drops, batch):
    """Neighbours meet within batches, across batches and across partitions."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, batch)
    try:
        rows = [(i, x) for i, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "i bigint, v bigint").repartitionByRange(4, "i")
        got = check_order(df.sortWithinPartitions("i"), "v").first()
    finally:
        spark.conf.set(conf, before)
    assert tuple(got) == (len(xs), drops, drops == 0)


def test_check_order_shuffles_no_rows(spark):
    df = spark.range(1_000).select(F.col("id").alias("v"))
    plan = check_order(df, "v")._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow", 1)[1]
    assert "Exchange" not in below


def test_unread_columns_stay_unread_while_planning(spark, tmp_path):
    """Sampling and counting scan the key alone unless a key is crowded."""
    path = str(tmp_path / "wide")
    spark.range(3_000).selectExpr("id as v", "repeat('x', 50) as wide").write.parquet(path)
    layout = plan_layout(spark.read.parquet(path), ["v"], 6)
    assert layout.split == ["v"] and not layout.crowded
    counts = layout.ranged.groupBy("__range").count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<v:bigint>" in plan


def test_timestamps_when_clocks_go_back(spark):
    """Half an hour steps through a night in which two hours bear one name."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(400).selectExpr(
            "timestamp_seconds(1730610000 + id * 60) as v", "id as n"
        ).repartition(4)
        out = global_position(df, "v", 40).orderBy("pos").collect()
        assert [(r["pos"], r["n"]) for r in out] == [(i, i) for i in range(400)]
        values = df.select("v")
        assert index_rows(global_sort(values.union(values), "v", 40)).count() == 800
        assert check_order(ordered_rows(plan_layout(values.union(values), ["v"], 40)), "v").first()[1] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cuts_that_begin_alike_still_split():
    from runweave.operators import ranges

    head = "h" * 3_000
    drawn = [("a",), *[(f"{head}{i:02d}" + "x" * 500,) for i in range(20)], ("z" * 5_000,)]
    cuts = ranges._shortened(drawn)
    assert len(cuts) == len(drawn) and cuts == sorted(set(cuts))
    assert all(before < cut <= t for before, cut, t in zip(drawn, cuts[1:], drawn[1:]))
    assert cuts[-1] == ("z" * ranges.CUT_CHARS,)
    long = [("h" * 300_000 + f"{i:02d}",) for i in range(20)]
    cuts = ranges._shortened(long)
    assert cuts == sorted(set(cuts)) and 3 <= len(cuts) < 20
