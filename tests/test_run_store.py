"""The store of runs: levels, bounds, snapshots, writers that die."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runweave.operators import (
    add_run,
    check_order,
    compact_runs,
    merge_stored,
    merge_stored_ranges,
    run_manifest,
    run_store,
    snapshots,
    stored_rows,
    vacuum_runs,
)
from runweave.plans import catalog
from runweave.storage import file_system, shared_path
from runweave.streaming import stream_to_store


def levels(spark, path):
    files = run_manifest(spark, path).where("run is not null")
    return {r["level"]: r["n"] for r in files.groupBy("level").agg(F.count_distinct("run").alias("n")).collect()}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_twenty_batches_are_merged_by_levels(spark):
    rng = random.Random(1)
    path, all_rows, steps = shared_path(spark, "store"), [], []
    for b in range(20):
        rows = [(rng.randrange(9_000) if i else None, f"{b}-{i}") for i in range(30)]
        all_rows += rows
        assert add_run(spark.createDataFrame(rows, "v long, x string").coalesce(2), path, "v", "s", b)
        steps.append(compact_runs(spark, path, "v", fanout=4))
    # Every fourth batch four runs of one level were merged, and of the next one once.
    assert [i + 1 for i, merged in enumerate(steps) if merged] == [4, 8, 12, 16, 17, 20] and set(steps) == {0, 4}
    assert levels(spark, path) == {1: 1, 2: 1} and compact_runs(spark, path, "v", fanout=4) == 0
    assert rows_of(stored_rows(spark, path)) == rows_of(spark.createDataFrame(all_rows, "v long, x string"))
    assert check_order(merge_stored(spark, path, "v"), "v").first()[:] == (600, 0, True)


def test_a_batch_counts_once_and_a_writer_may_die(spark, monkeypatch):
    path = shared_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        stored_rows(spark, path)
    one, two = (spark.range(a, a + 10).select(F.col("id").alias("v")) for a in (0, 5))
    assert add_run(one, path, "v", "s", 0) and not add_run(one, path, "v", "s", 0)
    # Dead between the rows and the version, and again half-way through a version.
    with monkeypatch.context() as m:
        m.setattr(run_store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("dies")))
        with pytest.raises(OSError):
            add_run(two, path, "v", "s", 1)
    files, half = file_system(spark, f"{path}/versions/{snapshots(spark, path)[-1] + 1}")
    files.mkdirs(half)
    assert stored_rows(spark, path).count() == 10
    assert add_run(two, path, "v", "s", 1) and stored_rows(spark, path).count() == 20
    # The same while merging.
    with monkeypatch.context() as m:
        m.setattr(run_store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("dies")))
        with pytest.raises(OSError):
            compact_runs(spark, path, "v", 2)
    assert levels(spark, path) == {0: 2}
    old = stored_rows(spark, path)
    assert compact_runs(spark, path, "v", 2) == 2 and levels(spark, path) == {1: 1}
    # A reader of the version before still reads; then what is in no version goes.
    assert rows_of(old) == rows_of(stored_rows(spark, path)) and old.count() == 20
    assert vacuum_runs(spark, path, keep=1) == 4 and len(snapshots(spark, path)) == 1
    assert [r["v"] for r in merge_stored(spark, path, "v").collect()] == sorted([*range(10), *range(5, 15)])
    # Numbers are those of a source; what was taken stays so after merging.
    assert not add_run(one, path, "v", "s", 1) and add_run(one, path, "v", "other", 0) and add_run(one, path, "v")
    assert stored_rows(spark, path).count() == 40


def test_runs_that_follow_one_another_are_not_read(spark):
    path = shared_path(spark, "store")
    for a in (20, 0, 10):
        add_run(spark.range(a, a + 10).select(F.when(F.col("id") > 0, F.col("id")).alias("v")), path, "v")
    before = {r["folder"] for r in run_manifest(spark, path).where("run is not null").collect()}
    assert compact_runs(spark, path, "v", 3) == 3 and levels(spark, path) == {1: 1}
    assert {r["folder"] for r in run_manifest(spark, path).where("run is not null").collect()} == before
    assert [r["v"] for r in merge_stored(spark, path, "v").collect()] == [None, *range(1, 30)]
    # A second run with nulls does not follow.
    add_run(spark.createDataFrame([(None,), (90,)], "v long"), path, "v")
    add_run(spark.createDataFrame([(None,), (None,)], "v long"), path, "v")
    assert compact_runs(spark, path, "v", 2) == 2 and stored_rows(spark, path).count() == 34


def test_ranges_read_only_what_overlaps_them(spark):
    path = shared_path(spark, "store")
    for b in range(3):
        df = spark.range(4_000).select((F.col("id") * 3 + b).alias("v"))
        add_run(df, path, "v", num_files=8)
    pivots = [3_000, 6_000, 9_000]
    got = merge_stored_ranges(spark, path, "v", pivots, [2])
    assert [r[:] for r in got.collect()] == [(v, 2) for v in range(6_000, 9_000)]
    files = run_manifest(spark, path).where("run is not null").collect()
    inside = {f["file"] for f in files if f["first"] < 9_000 and f["last"] >= 6_000}
    plan = got._jdf.queryExecution().executedPlan().toString()
    read = {f.rsplit("/", 1)[1] for f in got.inputFiles() if "/rows/" in f}
    assert read == inside and 3 <= len(inside) <= len(files) // 2
    assert "GreaterThanOrEqual(v,6000), LessThan(v,9000)" in plan


@pytest.mark.parametrize("kind", ["double", "string"])
def test_ranges_with_nulls_and_odd_keys(spark, kind):
    path = shared_path(spark, "store")
    odd = [None, float("nan")] if kind == "double" else [None, ""]
    cast = float if kind == "double" else lambda x: f"k{x:03d}"
    rng = random.Random(5)
    keys = [rng.choice(odd) if i % 4 == 0 else cast(rng.randrange(50)) for i in range(400)]
    for part in (keys[:150], keys[150:], []):
        add_run(spark.createDataFrame([(k,) for k in part], f"v {kind}"), path, "v")
    for pivots in ([cast(10), cast(20), cast(20), cast(40)], [None, cast(10)], [None], []):
        whole = merge_stored_ranges(spark, path, "v", pivots, list(range(len(pivots) + 1)))
        assert whole.count() == 400, pivots
        for r in range(len(pivots) + 2):
            part = merge_stored_ranges(spark, path, "v", pivots, [r])
            assert rows_of(part) == rows_of(whole.where(F.col("bucket") == r)), (pivots, r)


def test_edges(spark):
    path = shared_path(spark, "store")
    none = spark.createDataFrame([], "v long, x string")
    assert add_run(none, path, "v", "s", 3) and not add_run(none, path, "v", "s", 3)
    assert stored_rows(spark, path).columns == ["v", "x"] and merge_stored(spark, path, "v").count() == 0
    assert merge_stored_ranges(spark, path, "v", [1], [0, 1]).count() == 0 and compact_runs(spark, path, "v") == 0
    with pytest.raises(ValueError):
        add_run(spark.range(3).toDF("v"), path, "v")
    with pytest.raises(ValueError):
        compact_runs(spark, path, "v", 1)


def test_arriving_files_are_readable_after_every_batch(spark, tmp_path):
    arriving, path, state = (str(tmp_path / x) for x in ("arriving", "store", "state"))
    spark.range(40).select((F.col("id") * 7 % 40).alias("v")).repartition(5).write.parquet(arriving)
    stream_to_store(spark, arriving, path, state, max_files=1, fanout=2)
    assert levels(spark, path) == {2: 1, 0: 1} and len(snapshots(spark, path)) == 8
    spark.range(40, 50).toDF("v").coalesce(1).write.mode("append").parquet(arriving)
    stream_to_store(spark, arriving, path, state, max_files=1, fanout=2)
    assert [r["v"] for r in merge_stored(spark, path, "v").collect()] == list(range(50))


def test_files_that_arrive_can_be_read_by_many_tasks(spark, tmp_path, monkeypatch):
    n = 1_200_000
    spark.range(n).select(F.col("id").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    taken = []
    monkeypatch.setattr(catalog, "stream_to_store", lambda _, arriving, *a, **kw: taken.append((arriving, kw)))
    catalog._run_store(spark, str(tmp_path))
    (arriving, options), *_ = taken
    files = [f.removeprefix("file:") for f in spark.read.parquet(arriving).inputFiles()]
    groups = [pq.ParquetFile("/" + f.lstrip("/")).metadata.num_row_groups for f in files]
    assert len(files) == catalog.BATCHES and options["max_files"] == 1
    assert min(groups) > 1
    assert spark.read.parquet(arriving).agg(F.count("*"), F.sum("v")).first()[:] == (n, n * (n - 1) // 2)
