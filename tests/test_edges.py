"""Nulls, NaN, ties, long keys, empty inputs, pushdown: where checks and sorts
could go wrong without anybody seeing it."""

import math

import pytest
from pyspark.sql import functions as F

from runweave.operators import (
    append_run,
    assign_range,
    audit_seeds,
    check_conserved,
    check_order,
    check_sorted,
    global_position,
    global_sort,
    index_rows,
    merge_runs,
    preview,
    range_merge,
    range_pivots,
    sorted_runs,
)
from runweave.functions import chunk_seed
from runweave.sources import draw_uniform, generate_uniform, read_numbers, write_numbers


def test_check_sorted_sees_nulls(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, None, 3])], "c int, s int, v int")
    got = check_sorted(rows, "c", "s", "v").first()
    assert (got.n, got.inner_violations, got.is_sorted) == (3, 1, False)
    fine = spark.createDataFrame([(i // 2, i, v) for i, v in enumerate([None, None, 1, 3])], "c int, s int, v int")
    assert check_sorted(fine, "c", "s", "v").first().is_sorted
    seam = spark.createDataFrame([(0, 0, 5), (1, 1, None)], "c int, s int, v int")
    assert check_sorted(seam, "c", "s", "v").first().boundary_violations == 1


def test_checks_take_nan_as_greatest(spark):
    bad = spark.createDataFrame([(math.nan,), (1.0,)], "v double").coalesce(1)
    assert check_order(bad, "v").first().violations == 1
    good = spark.createDataFrame([(None,), (1.0,), (math.nan,), (math.nan,)], "v double").coalesce(1)
    assert check_order(good, "v").first().violations == 0


@pytest.mark.parametrize("kind", ["bigint", "struct<x:bigint>", "array<bigint>"])
def test_swapped_columns_are_other_rows(spark, kind):
    value = {"bigint": 1, "struct<x:bigint>": (1,), "array<bigint>": [None, 1]}[kind]
    one = spark.createDataFrame([(None, value)], f"a {kind}, b {kind}")
    other = spark.createDataFrame([(value, None)], f"a {kind}, b {kind}")
    assert not check_conserved(one, other).first().content_ok
    assert check_conserved(one, one).first().content_ok
    zero = [spark.createDataFrame([(z,)], "a double") for z in (0.0, -0.0)]
    assert check_conserved(*zero).first().content_ok


def test_preview_ends_do_not_overlap(spark):
    rows = spark.createDataFrame([(1, x) for x in range(20)], "v int, x int")
    got = preview(rows, "v").collect()
    assert sorted(r.x for r in got if r.side == "head") == [0, 1, 2, 3]
    assert sorted(r.x for r in got if r.side == "tail") == [16, 17, 18, 19]


def test_filters_pass_assign_range(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("v"), (F.col("id") % 5).alias("w")).write.parquet(path)
    ranged = assign_range(spark.read.parquet(path), "v", list(range(0, 1000)))
    plan = ranged.where("v < 10")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(v,10)" in plan
    assert len(plan) < 60_000
    assert [r.bucket for r in ranged.where("v < 3").orderBy("v").collect()] == [1, 2, 3]


def test_null_pivots_and_values(spark):
    rows = spark.createDataFrame([(None,), (1,), (5,)], "v bigint")
    got = {r.v: r.bucket for r in assign_range(rows, "v", [None, 2]).collect()}
    assert got == {None: 1, 1: 1, 5: 2}
    many = spark.createDataFrame([(None,)] * 8 + [(i,) for i in range(8)], "v bigint")
    assert assign_range(many, "v", range_pivots(many, "v", 4)).count() == 16
    with pytest.raises(ValueError):
        assign_range(rows, "v", [2, None])


def test_merging_nothing_and_one(spark, tmp_path):
    assert range_merge([], "v", 4).columns == ["v", "bucket"]
    assert range_merge([None], "v", 4).count() == 0
    empty = tmp_path / "runs"
    empty.mkdir()
    assert merge_runs(str(empty), "v", spark=spark).count() == 0
    one = spark.createDataFrame([(3,), (1,)], "v bigint").coalesce(1)
    assert [r.v for r in range_merge([one], "v", 2, [2]).collect()] == [3, 1]


def test_sink_replaces_what_was_there(spark, tmp_path):
    path = str(tmp_path / "numbers")
    write_numbers(spark.range(5).select(F.col("id").alias("v")), path)
    assert write_numbers(spark.range(3).select(F.col("id").alias("v")), path) == 3
    assert read_numbers(spark, path).count() == 3


def test_lines_are_read_as_digits(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes(" 5\n5\x00\n+7\n -2 \n1_000\n".encode())
    good, bad = read_numbers(spark, str(path), mode="permissive")
    assert sorted(r.v for r in good.collect()) == [-2, 5, 7]
    assert bad.count() == 2


def test_long_keys_are_sorted(spark):
    """Keys of 230 KB with equal beginnings: the sample is bounded by bytes."""
    keys = spark.range(1_500).select(
        F.concat(F.repeat(F.lit("a"), 2_000), F.lpad((F.col("id") * 7919 % 1500).cast("string"), 6, "0"), F.repeat(F.lit("x"), 228_000)).alias("k")
    )
    got = global_position(keys, "k").select("pos", F.substring("k", 2_001, 6).cast("int").alias("n")).collect()
    assert all(r.pos == r.n for r in got) and len(got) == 1_500
    assert check_order(global_sort(keys, "k"), "k").first().is_sorted


def test_num_partitions_is_kept(spark):
    """Where no key stands out, where one is hot, where few values repeat, and
    where rows of a hot key are told apart by other columns."""
    plain = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("v"))
    hot = plain.select(F.when(F.col("v") % 3 == 0, 5).otherwise(F.col("v")).alias("v"))
    few = plain.select((F.col("v") % 9).alias("v"))
    wide = hot.withColumn("id", F.monotonically_increasing_id())
    for rows in (plain, hot, few, wide):
        out = global_sort(rows, "v", 8)
        assert out.rdd.getNumPartitions() == 8
        assert check_order(out, "v").first().is_sorted
        assert check_conserved(rows, out).first().content_ok
    for rows in (plain, hot, wide):
        sizes = global_sort(rows, "v", 8).groupBy(F.spark_partition_id()).count()
        assert sizes.agg(F.max("count")).first()[0] <= 2.2 * 40_000 / 8


def test_sort_reads_its_input_once_more(spark):
    """The sampled ranges are used as they are: one exchange of the rows, by
    their range, and no sampling by the sort itself."""
    plain = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("v"))
    plan = global_sort(plain, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("dtype", ["double", "date", "timestamp", "decimal(20,4)", "string", "boolean", "binary"])
def test_keys_of_any_type_sort(spark, dtype):
    number = F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 40_009)
    made = {
        "double": number / 7,
        "date": F.date_add(F.lit("1990-01-01").cast("date"), number.cast("int")),
        "timestamp": F.timestamp_micros(number * 1_000_003),
        "boolean": number % 2 == 0,
        "binary": F.unhex(F.lpad(F.hex(number + 0xFF0000), 8, "0")),
    }.get(dtype, number.cast(dtype))
    rows = spark.range(30_000).select(made.alias("k"), "id")
    out = global_sort(rows, "k", 5)
    assert out.rdd.getNumPartitions() == 5
    assert check_conserved(rows, out).first().content_ok
    keys = [r.k for r in out.select("k").collect()]
    known = [k for k in keys if k is not None]
    assert keys[: len(keys) - len(known)] == [None] * (len(keys) - len(known)) and known == sorted(known)


def test_runs_with_a_hot_pair(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("chunk_id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("v"), "id")
    assert check_order(sorted_runs(rows), "v").first().is_sorted


def test_drawn_values_do_not_depend_on_partitions(spark):
    one = {r.pos: r.v for r in generate_uniform(spark, 5_000, seed=3, num_partitions=1).collect()}
    many = {r.pos: r.v for r in generate_uniform(spark, 5_000, seed=3, num_partitions=7).collect()}
    assert one == many and min(one.values()) >= 1 and max(one.values()) <= 10_000_000
    mean = sum(one.values()) / len(one)
    # Four standard errors of a uniform mean.
    assert abs(mean - 5e6) < 4 * 1e7 / math.sqrt(12 * len(one))
    big = spark.range(100).select(draw_uniform(F.col("id") + (1 << 40), 0, 1 << 50).alias("v")).collect()
    assert len({r.v for r in big}) == 100


def test_wrong_seeds_are_counted(spark):
    ids = spark.range(1, 11).select(F.col("id").alias("chunk_id"))
    ledger = ids.select(
        "chunk_id",
        F.lit("w1").alias("worker_name"),
        (chunk_seed(123_456, "chunk_id") + F.when(F.col("chunk_id") < 4, 1).otherwise(0)).alias("seed"),
        F.lit(123_456).cast("bigint").alias("session_seed"),
    )
    assert audit_seeds(ledger, 123_456).first().wrong_chunk_seeds == 3
