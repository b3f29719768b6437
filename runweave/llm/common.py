"""What several of these operators share: row numbers, hot-key joins, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runweave.storage import cut_lineage

# Into how many parts the rows of one key are dealt before they meet others.
SALTS = 64
# Keys of up to about a hundred bytes that are broadcast at most.
BROADCAST_KEYS = 50_000
# The letters that are lower-cased where only A-Z count.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit("")), UPPER, LOWER)


def bucket_of(n: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def attach_by_key(rows: DataFrame, keyed: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left-join ``keyed`` (one row a key) to ``rows``, however many rows a key has.

    The key's row first goes to those of its parts that exist, then each part
    joins on its own, so no task sees more than a part of a key.  ``spread`` is
    a column that tells the rows of a key apart.
    """
    parted = rows.withColumn("_part", bucket_of(salts, F.col(spread)))
    parts = parted.select(key, "_part").distinct().join(keyed, key)
    return parted.join(parts, [key, "_part"], "left").drop("_part")


def _key(mark: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), mark)


def keep_rows(docs: DataFrame, decided: DataFrame, mark: Column, decided_mark: str) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, one for each kept id and mark.

    ``mark`` is an expression over ``docs`` that ``decided`` has as a column, beside
    ``doc_id`` and ``kept``, a row for each of ``docs``.  Ids and marks alone say
    which rows go, and which stand for several.  Where those keys are few
    (``BROADCAST_KEYS``, about a hundred bytes each) they go to the rows; only the
    rows that stand for several are shuffled then.  Else all rows meet their
    decisions by a shuffle, in which those that agree are merged where they are read.
    """
    names = docs.columns
    keys = decided.select(_key(F.col(decided_mark)).alias("_key"), "kept")
    keys = keys.groupBy("_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = cut_lineage(keys.where("not kept or n > 1").select("_key", "kept"), "decided")
    wrapped = docs.select(_key(mark).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked = wrapped.join(F.broadcast(keys), "_key", "left").where("kept is null or kept")
        several = marked.where("kept").groupBy("_key").agg(F.first("_row").alias("_row"))
        return marked.where("kept is null").select("_row.*").unionByName(several.select("_row.*"))
    first = wrapped.groupBy("_key").agg(F.first("_row").alias("_row"))
    return first.join(keys.where("not kept"), "_key", "left_anti").select("_row.*")


def slices(batches: Iterator[pa.RecordBatch], size_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``size_col``; a
    single longer value comes alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(size_col))
        start, held = 0, 0
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def row_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``row`` structs with their ``text`` as a column beside, not a copy."""
    for batch in batches:
        rows = batch.column("row")
        at = rows.type.get_field_index("text")
        # Not field(): a sliced struct has unsliced fields.
        text = rows.flatten()[at]
        yield pa.RecordBatch.from_arrays([rows, text], ["row", "text"])
