"""The ledger of a sort, made by the sort itself.

Every sort task hands on its rows and, behind them, an entry for each chunk it
has sorted.  Rows and entries are one output of one task, so they are committed
together: a task that is run again leaves its rows and its entries once.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from runweave.functions.rows import row_hash
from runweave.functions.scalars import chunk_seed
from runweave.operators.sorting import sorted_runs
from runweave.storage import cut_lineage

# Helper columns: the entry, a row's hash, and its place (partition and row).
ENTRY, HASH, PLACE = "__entry", "__hash", "place"
# Bits of a row's hash that are added up: sums of 2**31 rows fit a bigint.
HASH_BITS = 0xFFFFFFFF


def _content(df: DataFrame, columns: list[str]):
    return row_hash(df, columns).bitwiseAND(F.lit(HASH_BITS))


def chunk_contents(chunked: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Per chunk what a sort of it must return: ``n_items`` and ``content``, a sum
    of row hashes, whatever the order of rows."""
    hashed = chunked.withColumn(HASH, _content(chunked, chunked.columns))
    return hashed.groupBy(F.col(chunk).alias("chunk_id")).agg(
        F.count("*").alias("n_items"), F.sum(HASH).alias("content")
    )


def _record(chunk: str, key: str):
    """Hands on the rows of a task and adds an entry per chunk.

    What passes before the first row is the task's sort, and is shared among its
    chunks by rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        began = time.perf_counter_ns()
        sort_us, names, types = 0, [], {}
        done: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not names:
                sort_us = (time.perf_counter_ns() - began) // 1000
                names = batch.schema.names
                types = dict(zip(names, batch.schema.types))
            # Chunks follow one another; one may go on in the next batch.
            ends = pc.run_end_encode(batch.column(chunk)).run_ends.to_pylist()
            for low, high in zip([0, *ends[:-1]], ends):
                part = batch.slice(low, high - low)
                value = part.column(chunk)[0].as_py()
                if not done or done[-1]["chunk"] != value:
                    done.append({"chunk": value, "n": 0, "content": 0, "first": part.column(key)[0].as_py()})
                entry = done[-1]
                entry["n"] += part.num_rows
                entry["content"] += pc.sum(part.column(HASH)).as_py() or 0
                entry["last"] = part.column(key)[-1].as_py()
                entry["roundtrip_us"] = (time.perf_counter_ns() - began) // 1000
            yield _with_entries(batch, None)
        if not done:
            return
        context = TaskContext.get()
        n_rows = sum(e["n"] for e in done)
        entries = [
            e | {
                "task": context.partitionId(), "attempt": context.attemptNumber(), "worker": socket.gethostname(),
                "threads": context.cpus(), "sort_us": sort_us * e["n"] // n_rows,
            }
            for e in done
        ]
        nothing = pa.RecordBatch.from_arrays([pa.nulls(len(entries), types[c]) for c in names], names)
        yield _with_entries(nothing, entries)

    def _with_entries(batch, entries):
        import pyarrow as pa

        kept = [c for c in batch.schema.names if c != HASH]
        fields = [
            ("chunk", batch.schema.field(chunk).type), ("n", pa.int64()), ("content", pa.int64()),
            ("first", batch.schema.field(key).type), ("last", batch.schema.field(key).type),
            ("task", pa.int32()), ("attempt", pa.int32()), ("worker", pa.string()), ("threads", pa.int32()),
            ("sort_us", pa.int64()), ("roundtrip_us", pa.int64()),
        ]
        column = pa.array(entries or [None] * batch.num_rows, pa.struct(fields))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], [*kept, ENTRY])

    return run


def sorted_runs_with_ledger(
    chunked: DataFrame, session_seed: int, key: str = "v", chunk: str = "chunk_id"
) -> tuple[DataFrame, DataFrame]:
    """`sorted_runs`, written to shared storage, and the ledger of that very sort.

    The runs have a column ``place`` more, which grows in the order in which the
    rows were written; so their order can be checked.  The ledger has a row per
    chunk: ``chunk_id, worker_name, threads, seed, session_seed, n_items, first,
    last, content, tasks, retried, sort_us, roundtrip_us``.  A chunk sorted by
    several tasks is one row: counts, contents and sort times are added up, and
    the worker of its first rows names it.

    Null keys and null chunks are sorted and counted like any other; a table
    without rows gives runs and a ledger without rows.
    """
    ordered = sorted_runs(chunked, key, chunk)
    hashed = ordered.withColumn(HASH, _content(ordered, chunked.columns)).withColumn(PLACE, F.monotonically_increasing_id())
    kind = {f.name: f.dataType for f in chunked.schema.fields}
    entry = T.StructType(
        [T.StructField("chunk", kind[chunk]), T.StructField("n", T.LongType()), T.StructField("content", T.LongType())]
        + [T.StructField(c, kind[key]) for c in ("first", "last")]
        + [T.StructField("task", T.IntegerType()), T.StructField("attempt", T.IntegerType()), T.StructField("worker", T.StringType())]
        + [T.StructField("threads", T.IntegerType()), T.StructField("sort_us", T.LongType()), T.StructField("roundtrip_us", T.LongType())]
    )
    fields = [T.StructField(f.name, f.dataType) for f in chunked.schema.fields]
    schema = T.StructType([*fields, T.StructField(PLACE, T.LongType()), T.StructField(ENTRY, entry)])
    stored = cut_lineage(hashed.mapInArrow(_record(chunk, key), schema), "runs-and-ledger")
    runs = stored.where(F.col(ENTRY).isNull()).drop(ENTRY)
    pieces = stored.where(F.col(ENTRY).isNotNull()).select(f"{ENTRY}.*")
    ledger = pieces.groupBy(F.col("chunk").alias("chunk_id")).agg(
        F.min_by("worker", "task").alias("worker_name"),
        F.max("threads").alias("threads"),
        F.sum("n").alias("n_items"),
        F.min_by("first", "task").alias("first"),
        F.max_by("last", "task").alias("last"),
        F.sum("content").alias("content"),
        F.count("*").alias("tasks"),
        F.count_if(F.col("attempt") > 0).alias("retried"),
        F.sum("sort_us").alias("sort_us"),
        F.max("roundtrip_us").alias("roundtrip_us"),
    )
    seeds = [chunk_seed(session_seed, "chunk_id").alias("seed"), F.lit(session_seed).cast("bigint").alias("session_seed")]
    return runs, ledger.select("chunk_id", "worker_name", "threads", *seeds, *ledger.columns[3:])
