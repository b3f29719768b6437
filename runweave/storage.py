"""Shared storage for intermediate tables.

A table written here survives the loss of executors and cuts the lineage of
whatever reads it back.  The folder is the one the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Whether shuffle files go when the query that wrote them has ended, not when the
# driver next collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows of a few numbers that one file of a small table may have.
ROWS_A_FILE = 200_000
# Paths handed out and not yet released, by the session they were made for.
_handed_out: dict[int, list[str]] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's shared folder."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        # A folder of this machine is only right when the machine is the cluster.
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="runweave-")
        spark.conf.set(CHECKPOINT_CONF, base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _handed_out.setdefault(_session(spark), []).append(path)
    return path


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and return it read back.

    Nothing reads the shuffles of the write again, so their files go with it.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def files_for(n_rows: int, rows_a_file: int = ROWS_A_FILE) -> int:
    """How many files suit a table of about ``n_rows`` rows, of a few numbers each
    unless ``rows_a_file`` says otherwise."""
    return max(1, ceil(n_rows / rows_a_file))


def _session(spark: SparkSession) -> int:
    """What tells sessions apart, also when Python holds two objects of one."""
    return spark._jsparkSession.hashCode() if isinstance(spark, SparkSession) else id(spark)


def file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of `cut_lineage` that nothing reads any more."""
    mine = _handed_out.get(_session(spark), [])
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            known = next((p for p in mine if p.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]), None)
            if known:
                mine.remove(known)
                files, at = file_system(spark, known)
                files.delete(at, True)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far for this session and return how
    many there were; those of other sessions stay.

    For callers who have written or collected their results: DataFrames that were
    returned before can no longer be read afterwards.
    """
    gone = 0
    for path in _handed_out.pop(_session(spark), []):
        files, at = file_system(spark, path)
        gone += bool(files.delete(at, True))
    return gone
