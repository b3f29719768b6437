"""Number files, generators, runs from a stream, live sources."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runweave.operators import global_position, global_sort, merge_runs
from runweave.sources import (
    LINE_ORDER,
    generate_sorted,
    generate_uniform,
    number_lines,
    read_numbers,
    write_numbers,
)
from runweave.streaming import live_sources, session_stream, source_sessions, stream_runs


def lines(tmp_path, text):
    path = tmp_path / "numbers.txt"
    path.write_bytes(text.encode())
    return str(path)


# -------------------------------------------------------------- number files


@pytest.mark.parametrize("text,want", [
    ("\n", []),
    ("", []),
    ("5\n\n  7 \n3", [5, 7, 3]),
    ("\t+5\r\n-6\x0b\r\n \t \n", [5, -6]),
    ("9223372036854775807\n-9223372036854775808\n", [2**63 - 1, -(2**63)]),
])
def test_read(spark, tmp_path, text, want):
    assert [r["v"] for r in read_numbers(spark, lines(tmp_path, text)).collect()] == want


@pytest.mark.parametrize("bad", ["x", "5.7", "1_000", "1e3", "9223372036854775808", "5 6"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_line(spark, tmp_path, bad, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        path = lines(tmp_path, f"1\n{bad}\n2\n")
        strict = read_numbers(spark, path)
        for job in (strict.collect, strict.count, strict.orderBy("v").collect):
            with pytest.raises(Exception, match="not an integer"):
                job()
        good, rejected = read_numbers(spark, path, mode="permissive")
        assert [r["v"] for r in good.collect()] == [1, 2]
        assert [r["line"] for r in rejected.collect()] == [bad]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_numbers(spark, str(tmp_path / "absent.txt"))


def test_write_keeps_order_over_files_and_splits(spark, tmp_path):
    xs = [(i * 7919) % 10_007 for i in range(10_007)]
    out = str(tmp_path / "out")
    assert write_numbers(global_sort(spark.createDataFrame([(x,) for x in xs], "v bigint"), "v"), out) == len(xs)
    text = "".join(
        open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-")
    )
    assert text == "".join(f"{x}\n" for x in sorted(xs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = read_numbers(spark, out, line_order=True)
        assert back.rdd.getNumPartitions() > 4
        placed = number_lines(back).orderBy("pos").collect()
        same = global_position(back, LINE_ORDER, 5).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["pos"], r["v"]) for r in placed] == list(enumerate(sorted(xs)))
    assert [r["v"] for r in same] == sorted(xs)


def test_line_numbers_leave_no_gaps(spark, tmp_path):
    for name, text in (("b.txt", "\n5\nx\n\n4\n"), ("a.txt", "9\n\n\n8\ny\n7\n")):
        (tmp_path / name).write_text(text)
    good, bad = read_numbers(spark, str(tmp_path), mode="permissive", line_order=True)
    assert sorted(tuple(r) for r in number_lines(good).collect()) == [
        (0, 9), (1, 8), (2, 7), (3, 5), (4, 4),
    ]
    assert sorted(tuple(r) for r in number_lines(bad).collect()) == [(0, "y"), (1, "x")]


def test_write_nothing(spark, tmp_path):
    out = str(tmp_path / "none")
    assert write_numbers(spark.createDataFrame([], "v bigint"), out) == 0
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.startswith("part-"))
    assert text == "\n"
    assert read_numbers(spark, out).count() == 0


# ---------------------------------------------------------------- generators


def test_generated_values_do_not_depend_on_partitions(spark):
    a, b, c = (
        generate_uniform(spark, 5_000, 10, 40, seed=3, num_partitions=p).orderBy("pos").collect()
        for p in (1, 3, 8)
    )
    assert a == b == c
    assert {r["v"] for r in a} == set(range(10, 41))
    assert generate_uniform(spark, 5_000, 10, 40, seed=4).orderBy("pos").collect() != a
    assert generate_uniform(spark, 0).count() == 0
    assert {r["v"] for r in generate_uniform(spark, 9, 5, 5).collect()} == {5}
    with pytest.raises(ValueError):
        generate_uniform(spark, 1, 2, 1)


@pytest.mark.parametrize("high", [50, 10**12])
def test_generate_sorted(spark, high):
    got = [r["v"] for r in generate_sorted(spark, 20_000, 1, high, seed=5).collect()]
    assert got == sorted(r["v"] for r in generate_uniform(spark, 20_000, 1, high, seed=5).collect())


# --------------------------------------------------------------- stream runs


def test_runs_from_a_stream(spark, tmp_path):
    src, runs, state = (str(tmp_path / x) for x in ("in", "runs", "state"))

    def arrive(lo, hi):
        spark.range(lo, hi).select((F.col("id") * 7 % 1000).alias("v")).repartition(3).write.mode(
            "append"
        ).parquet(src)

    arrive(0, 300)
    stream_runs(spark, src, runs, state, "v bigint", max_files=2)
    assert sorted(d for d in os.listdir(runs) if d.startswith("run_id")) == ["run_id=0", "run_id=1"]
    stream_runs(spark, src, runs, state, "v bigint")
    arrive(300, 500)
    stream_runs(spark, src, runs, state, "v bigint")
    assert [r["v"] for r in merge_runs(runs, "v", spark=spark).collect()] == sorted(
        i * 7 % 1000 for i in range(500)
    )
    for run in os.listdir(runs):
        got = [r["v"] for r in spark.read.parquet(f"{runs}/{run}").orderBy(
            F.col("_metadata.file_name"), F.monotonically_increasing_id()).collect()]
        assert got == sorted(got)


# --------------------------------------------------------------- live sources

T0 = datetime(2024, 1, 1)


def beats(spark, rows):
    data = [(n, 5000, h, T0 + timedelta(microseconds=round(s * 1e6))) for n, h, s in rows]
    return spark.createDataFrame(data, "name string, port int, host string, ts timestamp_ntz").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def at(seconds):
    return F.lit(T0.isoformat()).cast("timestamp") + F.expr(f"interval {round(seconds * 1e6)} microseconds")


def alive(spark, rows, seconds):
    return {r["name"]: r["host"] for r in live_sources(beats(spark, rows), at(seconds)).collect()}


def test_expiry_is_inclusive(spark):
    rows = [("a", "10.0.0.1", 0), ("b", "10.0.0.2", 1)]
    assert alive(spark, rows, 4) == {"a": "10.0.0.1", "b": "10.0.0.2"}
    assert alive(spark, rows, 4.000001) == {"b": "10.0.0.2"}
    assert alive(spark, rows, 0.5) == {"a": "10.0.0.1"}


def test_a_local_address_stays_until_expiry(spark):
    rows = [("a", "127.0.0.1", 0), ("a", "10.0.0.1", 3), ("a", "10.0.0.2", 6.9)]
    assert alive(spark, rows, 7) == {"a": "127.0.0.1"}
    # Gone for more than the timeout: known by its new address only.
    rows += [("a", "10.0.0.3", 11)]
    assert alive(spark, rows, 11) == {"a": "10.0.0.3"}
    assert alive(spark, [("a", "10.0.0.1", 0), ("a", "10.0.0.9", 3)], 5) == {"a": "10.0.0.9"}


def test_sessions_split_at_more_than_the_timeout(spark):
    rows = [("a", "h", s) for s in (-9, -5, -1, 3.000001, 3.5, 7.500001, 20)]
    got = source_sessions(beats(spark, rows)).orderBy("started").collect()
    assert [r["beats"] for r in got] == [3, 1 + 1, 1, 1]


def test_stream_sessions_equal_closed_batch_sessions(spark, tmp_path):
    rows = [(f"s{i % 5}", "127.0.0.1" if i % 11 == 0 else f"10.0.0.{i % 7}", (i * i) % 997 * 0.9) for i in range(400)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = beats(spark, rows).distinct()
    df.write.parquet(src)
    sessions = session_stream(spark.readStream.schema(df.schema).parquet(src), lateness=timedelta(seconds=30))
    query = (
        sessions.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = df.agg(F.max("ts")).scalar()
    closed = source_sessions(df).where(
        F.col("last_seen") + F.expr("interval 4 seconds") <= last - F.expr("interval 30 seconds")
    )
    got = spark.read.schema(sessions.schema).parquet(out)

    def found(x):
        return sorted(tuple(r) for r in x.collect())

    assert found(got) == found(closed) and closed.count() > 5
