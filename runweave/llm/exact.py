"""Exact duplicates by a tree merge of sorted digest runs.

Every partition makes a run: its digests in order, each with the identifier that
it would keep and a count.  Runs are exchanged in binomial rounds: of the nodes
that differ in one digit of their number, each takes the digests with its own
digit from the others and merges those runs into one, in order of digest.  A
node's entries are on one task, sorted; the merge walks over them.  After the last
round a digest lives on one node only.  The answers go back down the same tree.  A digest
has one entry per run, so no exchange sees more than ``RADIX`` entries of it, be
it the digest of a third of all rows.

The sort key of a run is a 64-bit digest; entries are merged only if the full
SHA-256 and the byte length agree too, at every level.

Edge cases: a null text counts as empty; of rows that agree in text and id one
is kept (rows of the same input in file order); a null id is kept only if its
group has no other; an empty table gives an empty table.  Other columns are not
read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runweave.llm.common import ascii_lower, keep_rows, slices
from runweave.storage import cut_lineage

# Runs merged at once, as a power of two.
RADIX_BITS = 3
RADIX = 1 << RADIX_BITS
# monotonically_increasing_id(): the partition, then 33 bits of row number.
ROW_BITS = 33
# A task looks at about this many bytes of text at a time.
SLICE = 1 << 20
DIGESTS = "doc_id long, row_id long, digest long, sha string, n_bytes long"
ENTRY = ["digest", "sha", "n_bytes"]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        shas, heads, sizes = [], [], []
        for text in batch.column("text"):
            raw = text.as_buffer()
            # bytes.lower() changes A-Z alone
            raw = raw.to_pybytes().lower() if raw is not None else b""
            sha = hashlib.sha256(raw)
            shas.append(sha.hexdigest())
            heads.append(int.from_bytes(sha.digest()[:8], "big", signed=True))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_id"),
                pa.array(heads, pa.int64()),
                pa.array(shas, pa.string()),
                pa.array(sizes, pa.int64()),
            ],
            ["doc_id", "row_id", "digest", "sha", "n_bytes"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """The digest of every row's normalised text."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row_id"))
    return rows.mapInArrow(_digest, DIGESTS)


def _digit(col: str, level: int) -> Column:
    return F.shiftright(F.col(col), RADIX_BITS * level).bitwiseAND(F.lit(RADIX - 1)).cast("int")


def _merged(entries: DataFrame) -> DataFrame:
    """One sorted run per node from all entries that meet there.

    Entries go to their node alone, and are put in order of digest; equal ones
    are then neighbours.  The grouping needs no other exchange; as its maximum is
    over structs it is no hash table, but walks over the sorted entries, compares
    them in full, and keeps the best.
    """
    ordered = entries.repartition("node").sortWithinPartitions("node", *ENTRY)
    return ordered.groupBy("node", *ENTRY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def tree_merge(rows: DataFrame, keep: str = "largest", levels: int | None = None) -> DataFrame:
    """``rows`` of :func:`digests` with ``keep_id, keep_row, group_size, kept``.

    ``keep`` says whether the smallest or the largest id of a group stays.
    ``RADIX ** levels`` nodes take part; by default as many as there are shuffle
    partitions at least.
    """
    spark = rows.sparkSession
    if levels is None:
        wanted, levels = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
        while RADIX**levels < wanted:
            levels += 1
    sign = 1 if keep == "largest" else -1
    nodes = RADIX**levels
    # A leaf is what one task has read.
    leaves = rows.withColumn("node", F.pmod(F.shiftright("row_id", ROW_BITS), F.lit(nodes)).cast("int"))
    # The greatest rank is kept; -id for smallest. Nulls order below all ids.
    rank = F.struct(
        F.col("doc_id").isNotNull().alias("has"),
        (F.coalesce(F.col("doc_id"), F.lit(0)).cast("decimal(20,0)") * sign).alias("rank"),
        (-F.col("row_id")).alias("row"),
    )
    runs = [cut_lineage(_merged(leaves.select("node", *ENTRY, rank.alias("best"), F.lit(1).cast("long").alias("n"))), "runs")]
    for level in range(levels):
        scale = RADIX**level
        # Exchange in one digit: the node of the group whose digit is the digest's.
        own = F.col("node") + (_digit("digest", level) - _digit("node", level)) * scale
        exchanged = runs[-1].withColumn("node", own.cast("int"))
        runs.append(cut_lineage(_merged(exchanged), "runs"))
    known = runs[-1]
    for level in reversed(range(levels)):
        scale = RADIX**level
        above = (F.col("node") + (_digit("digest", level) - _digit("node", level)) * scale).cast("int")
        asking = runs[level].select("node", *ENTRY).withColumn("above", above)
        known = asking.join(known.withColumnRenamed("node", "above"), ["above", *ENTRY]).drop("above")
    found = leaves.join(known, ["node", *ENTRY])
    return found.select(
        "doc_id",
        "row_id",
        F.when(F.col("best.has"), (F.col("best.rank") * sign).cast("long")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_id") == -F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_bytes",
    )


def exact_duplicates(docs: DataFrame, keep: str = "largest", levels: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes``."""
    return tree_merge(cut_lineage(digests(docs), "digests"), keep, levels).drop("row_id")


def drop_exact_duplicates(docs: DataFrame, keep: str = "largest", levels: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows meet their decision by id and digest; of rows equal in both one stays.
    """
    decided = exact_duplicates(docs, keep, levels)
    digest = F.sha2(F.encode(ascii_lower("text"), "UTF-8"), 256)
    return keep_rows(docs, decided, digest, "text_sha256")
