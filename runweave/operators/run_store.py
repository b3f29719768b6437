"""A store of sorted runs: levels, value bounds, snapshots.

Every batch becomes a run, sorted once.  When a level holds ``fanout`` runs, they
are merged into one of the next level; so a row is rewritten once a level, not at
every batch, and the runs in sight stay few.  The manifest of a version has an
entry per file with its least and greatest key, so a range of keys is read from
the files that overlap it.

A change writes its rows first and then a new version; it counts from the moment
the version is complete.  A writer that dies before leaves files that no version
names: nothing is lost or doubled.  Readers stay on the version they took; files
that only old versions name are kept until `vacuum_runs`.  One writer at a time.

Edge cases: null keys are least and NaN greatest; a batch without rows adds no
run, but its number counts as taken; equal rows are all kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from runweave.operators.ranges import assign_range
from runweave.operators.sorting import global_sort
from runweave.storage import file_system

ROWS, VERSIONS, DONE = "rows", "versions", "_SUCCESS"
FANOUT = 8
# Entries of files have a run; those of sources have none.
ENTRY = "run string, level int, born bigint, folder string, file string, n bigint, first {key}, last {key}, source string, batch bigint, columns string"


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the store, oldest first."""
    return [v for v, complete in _versions(spark, path) if complete]


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    files, at = file_system(spark, f"{path}/{VERSIONS}")
    if not files.exists(at):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in files.listStatus(at)]
    return sorted((int(p.getName()), files.exists(child(p, DONE))) for p in found)


def run_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The entries of a version (the latest, if none is named)."""
    if version is None:
        complete = snapshots(spark, path)
        if not complete:
            raise FileNotFoundError(f"no run was added to {path}")
        version = complete[-1]
    return spark.read.parquet(f"{path}/{VERSIONS}/{version}")


def _files(manifest: DataFrame) -> DataFrame:
    return manifest.where("run is not null")


def _commit(manifest: DataFrame, path: str) -> None:
    spark = manifest.sparkSession
    version = max((v for v, _ in _versions(spark, path)), default=0) + 1
    # One row per file.
    manifest.coalesce(1).write.mode("error").parquet(f"{path}/{VERSIONS}/{version}")


def _write_run(rows: DataFrame, path: str, key: str, level: int, born: int, num_files: int | None = None) -> DataFrame:
    """Store ``rows`` in ascending order; entries of the files."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    folder = f"{path}/{ROWS}/{run}"
    global_sort(rows, key, num_files).write.parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder)
    entries = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n"), _least(key).alias("first"), F.max(key).alias("last")
    )
    return entries.select(
        F.lit(run).alias("run"), F.lit(level).alias("level"), F.lit(born).cast("bigint").alias("born"),
        F.lit(run).alias("folder"), "file", "n", "first", "last",
    )


def _least(col: str) -> Column:
    """The least value, where null is least."""
    return F.when(F.count(col) == F.count("*"), F.min(col))


def add_run(df: DataFrame, path: str, key: str, source: str = "", batch: int | None = None, num_files: int | None = None) -> bool:
    """Sort ``df`` by ``key`` into a new run of the store at ``path``, with as
    many files as the sort has tasks, or as ``num_files`` says.

    Batches of a ``source`` are numbered upwards; one whose number was taken
    already is left out, and the answer is False.
    """
    spark = df.sparkSession
    complete = snapshots(spark, path)
    before = run_manifest(spark, path, complete[-1]) if complete else None
    # One row per source.
    heads = before.where("run is null").select("source", "batch", "columns").collect() if complete else []
    if heads and StructType.fromJson(json.loads(heads[0]["columns"])).simpleString() != df.schema.simpleString():
        raise ValueError("the columns of a store do not change")
    taken = {h["source"]: h["batch"] for h in heads}
    if batch is not None and taken.get(source) is not None and batch <= taken[source]:
        return False
    taken[source] = taken.get(source) if batch is None else batch
    columns = heads[0]["columns"] if heads else df.schema.json()
    schema = ENTRY.format(key=df.schema[key].dataType.simpleString())
    sources = spark.createDataFrame([(None,) * 8 + (s, b, columns) for s, b in taken.items()], schema)
    born = (complete[-1] if complete else 0) + 1
    manifest = sources.unionByName(_write_run(df, path, key, 0, born, num_files), allowMissingColumns=True)
    _commit(manifest if before is None else _files(before).unionByName(manifest), path)
    return True


def compact_runs(spark: SparkSession, path: str, key: str, fanout: int = FANOUT) -> int:
    """One step: the ``fanout`` oldest runs of the lowest level that has so many
    become one run of the next level.  Returns how many runs were merged, or 0.

    Runs whose keys follow one another are only entered as one; nothing is read.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    manifest = run_manifest(spark, path)
    runs = _files(manifest).groupBy("run", "level", "born").agg(
        _least("first").alias("low"), F.max("last").alias("high"), F.collect_set("folder").alias("folders")
    )
    # One row per run: less than `fanout` a level where this follows each batch.
    age = W.partitionBy("level").orderBy("born", "run")
    oldest = runs.withColumn("age", F.row_number().over(age)).where(F.col("age") <= fanout)
    by_key = W.partitionBy("level").orderBy("low", "high")
    before = F.lag("high").over(by_key)
    meets = before.isNotNull() & (F.col("low").isNull() | (before > F.col("low")))
    found = oldest.withColumn("meets", meets).collect()
    for level in sorted({r["level"] for r in found}):
        chosen = [r for r in found if r["level"] == level]
        if len(chosen) < fanout:
            continue
        picked = F.coalesce(F.col("run").isin([r["run"] for r in chosen]), F.lit(False))
        if any(r["meets"] for r in chosen):
            merged = _write_run(
                _read_folders(manifest, path, [f for r in chosen for f in r["folders"]]), path, key, level + 1, max(r["born"] for r in chosen)
            )
        else:
            renamed = {"run": F.lit(uuid.uuid4().hex), "level": F.lit(level + 1), "born": F.lit(max(r["born"] for r in chosen)).cast("bigint")}
            merged = manifest.where(picked).withColumns(renamed)
        _commit(manifest.where(~picked).unionByName(merged, allowMissingColumns=True), path)
        return len(chosen)
    return 0


def _columns(manifest: DataFrame) -> StructType:
    return StructType.fromJson(json.loads(manifest.where("run is null").select("columns").first()["columns"]))


def _read_folders(manifest: DataFrame, path: str, folders: list[str]) -> DataFrame:
    spark, schema = manifest.sparkSession, _columns(manifest)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{ROWS}/{f}" for f in sorted(folders)])


def stored_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a version, in no order."""
    manifest = run_manifest(spark, path, version)
    return _read_folders(manifest, path, [r["folder"] for r in _files(manifest).select("folder").distinct().collect()])


def merge_stored(spark: SparkSession, path: str, key: str, num_partitions: int | None = None, version: int | None = None) -> DataFrame:
    """All rows of a version in ascending order of ``key``."""
    return global_sort(stored_rows(spark, path, version), key, num_partitions)


def merge_stored_ranges(
    spark: SparkSession, path: str, key: str, pivots: list, ranges: list[int], version: int | None = None
) -> DataFrame:
    """The rows of the named ``ranges`` between ``pivots`` in ascending order, with
    their ``bucket`` (as of `assign_range`).

    Only files whose bounds reach into a range are opened, and of these only the
    row groups that do: the ranges are also conditions on the key.
    """
    manifest = run_manifest(spark, path, version)
    files = _files(manifest)
    for bound in ("first", "last"):
        files = assign_range(files, bound, pivots).withColumnRenamed("bucket", f"{bound}_bucket")
    reached = F.lit(False)
    for r in ranges:
        reached = reached | F.lit(r).between(F.col("first_bucket"), F.col("last_bucket"))
    names = [f"{path}/{ROWS}/{r['folder']}/{r['file']}" for r in files.where(reached).select("folder", "file").collect()]
    schema = _columns(manifest)
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    inside = _between(key, schema[key].dataType.simpleString(), pivots, ranges)
    return assign_range(global_sort(rows.where(inside), key), key, pivots)


def _between(key: str, kind: str, pivots: list, ranges: list[int]) -> Column:
    """The condition that ``key`` lies in one of the ranges."""
    known = [v for v in pivots if v is not None]
    nulls = len(pivots) - len(known)
    inside = F.lit(False)
    for r in ranges:
        at = r - nulls
        if not 0 <= at <= len(known):
            continue
        low = F.col(key) >= F.lit(known[at - 1]).cast(kind) if at else F.lit(True)
        high = F.col(key) < F.lit(known[at]).cast(kind) if at < len(known) else F.lit(True)
        # Null values are in the lowest range that any value is in.
        one = low & high if at else F.col(key).isNull() | high
        inside = inside | one
    return inside


def vacuum_runs(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions but the last ``keep`` complete ones and what only they
    name; returns how many folders of rows went.  Not while a writer is at work."""
    if keep < 1:
        raise ValueError("one version must be kept")
    kept = snapshots(spark, path)[-keep:]
    named = {r["folder"] for v in kept for r in _files(run_manifest(spark, path, v)).select("folder").distinct().collect()}
    child = spark._jvm.org.apache.hadoop.fs.Path
    files, at = file_system(spark, f"{path}/{VERSIONS}")
    for v, _ in _versions(spark, path):
        if v not in kept:
            files.delete(child(at, str(v)), True)
    files, at = file_system(spark, f"{path}/{ROWS}")
    folders = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
    return sum(bool(files.delete(p, True)) for p in folders if p.getName() not in named)
