"""Sorted runs from files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from runweave.operators.run_store import FANOUT, add_run, compact_runs
from runweave.operators.sorting import global_sort
from runweave.storage import release


def stream_runs(
    spark: SparkSession,
    in_dir: str,
    run_dir: str,
    checkpoint: str,
    schema: StructType | str = "v bigint",
    key: str = "v",
    file_format: str = "parquet",
    max_files: int = 100,
) -> None:
    """Sort each batch of new files in ``in_dir`` into a run under ``run_dir``
    and return when there are no more; call again to take up later files.

    A run's folder is named by its batch and replaced on a replay, so a batch
    that is run twice leaves one run.  `merge_runs` reads ``run_dir``.
    """
    arriving = (
        spark.readStream.format(file_format)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .load(in_dir)
    )

    def write_run(batch: DataFrame, batch_id: int) -> None:
        global_sort(batch, key).write.mode("overwrite").parquet(f"{run_dir}/run_id={batch_id}")

    _take_up(arriving, write_run, checkpoint)


def stream_to_store(
    spark: SparkSession,
    in_dir: str,
    path: str,
    checkpoint: str,
    schema: StructType | str = "v bigint",
    key: str = "v",
    file_format: str = "parquet",
    max_files: int = 100,
    fanout: int = FANOUT,
) -> None:
    """Add each batch of new files in ``in_dir`` to the store of runs at ``path``,
    merge runs where a level is full, and return when there are no more files.

    What has arrived is sorted, merged and readable after every batch.  A batch
    that is run twice is in the store once; its numbers are those of ``checkpoint``,
    so another checkpoint is another source.
    """
    arriving = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", max_files).load(in_dir)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_run(batch, path, key, checkpoint, batch_id)
        while compact_runs(batch.sparkSession, path, key, fanout):
            pass

    _take_up(arriving, add, checkpoint)


def _take_up(arriving: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    def one(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        # A stream has a session of its own.
        release(batch.sparkSession)

    query = (
        arriving.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
