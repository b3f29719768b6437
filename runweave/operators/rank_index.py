"""Rank and select on a stored sort: positions of keys, rows at positions.

A table is sorted and written once, with an entry per file: where its rows begin
and which keys it begins and ends with.  Lookups read those entries, at most
``MAX_RANGES`` with a key each, and then only the files that hold an answer.
The entries are written last, so a build that dies is no index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runweave.operators.groups import MAX_BROADCAST_GROUPS
from runweave.operators.layout import PLACE, PLACE_BITS, place_to_position
from runweave.operators.ranges import literal_array, range_number
from runweave.operators.sorting import global_sort
from runweave.storage import cut_lineage

ROWS, FILES = "rows", "files"


def store_sorted(df: DataFrame, key: str, path: str, num_partitions: int | None = None) -> DataFrame:
    """Sort ``df`` by ``key`` and store it below ``path`` with its index.

    Returns the entries: ``part, file, start, n, first, last``.  Nulls come first
    and NaN last.  A table without rows has no entries.
    """
    spark = df.sparkSession
    rows = global_sort(df, key, num_partitions).withColumn(PLACE, F.monotonically_increasing_id())
    rows.write.parquet(f"{path}/{ROWS}")
    part = F.shiftright(PLACE, PLACE_BITS).cast("int").alias("part")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/{ROWS}")
    entries = stored.groupBy(part, F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n"), F.min_by(key, PLACE).alias("first"), F.max_by(key, PLACE).alias("last"), F.min(PLACE).alias("at")
    )
    # One row per file.
    entries = cut_lineage(entries, "files").toLocalIterator()
    kind = rows.schema[key].dataType.simpleString()
    start, out = 0, []
    for e in sorted(entries, key=lambda e: e["at"]):
        out.append((e["part"], e["file"], start, e["n"], e["first"], e["last"]))
        start += e["n"]
    schema = f"part int, file string, start bigint, n bigint, first {kind}, last {kind}"
    spark.createDataFrame(out, schema).coalesce(1).write.parquet(f"{path}/{FILES}")
    return spark.read.schema(schema).parquet(f"{path}/{FILES}")


def _entries(spark: SparkSession, path: str) -> list:
    return sorted(spark.read.parquet(f"{path}/{FILES}").collect(), key=lambda e: e["start"])


def _read(spark: SparkSession, path: str, entries: list, wanted: list[int]) -> DataFrame:
    """Rows of the wanted files with ``pos``."""
    schema = spark.read.parquet(f"{path}/{ROWS}").schema
    starts = [0] * (max((e["part"] for e in entries), default=0) + 1)
    for e in reversed(entries):
        # A part may be several files; its first has its start.
        starts[e["part"]] = e["start"]
    files = [f"{path}/{ROWS}/{entries[i]['file']}" for i in sorted(wanted)]
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.select(place_to_position(starts).alias("pos"), *[c for c in schema.names if c != PLACE])


def positions_of(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """``key, pos, n`` for every distinct key of ``wanted``, whose column has the
    name and type of the stored key: the position of its first row and how many
    rows it has.  A key that is not there has a null ``pos`` and 0 rows.

    Of a key only the first and the last file are read, however many it fills.
    """
    entries = _entries(spark, path)
    kind = dict(wanted.dtypes)[key]
    keys = wanted.select(key).distinct()
    if not entries:
        return keys.withColumn("pos", F.lit(None).cast("bigint")).withColumn("n", F.lit(0).cast("bigint"))
    lasts = [e["last"] for e in entries]
    # The first of the files that end with the same key.
    low_of: list[int] = []
    for i, last in enumerate(lasts):
        low_of.append(low_of[-1] if i and lasts[i - 1] == last else i)
    found = range_number(keys, [key], [(e["first"],) for e in entries], "__begun")
    found = range_number(found, [key], [(x,) for x in lasts], "__ended")
    before = F.col("__ended") - 1
    ends = (before >= 0) & F.get(literal_array(lasts, kind), before).eqNullSafe(F.col(key))
    low = F.when(ends, F.get(literal_array(low_of, "int"), before)).otherwise(F.col("__ended"))
    found = cut_lineage(found.select(key, low.alias("__low"), (F.col("__begun") - 1).alias("__high")), "wanted")
    asked = found.where("__low <= __high")
    files = asked.select(F.explode(F.array("__low", "__high")).alias("f")).distinct()
    rows = _read(spark, path, entries, [r["f"] for r in files.collect()]).select("pos", F.col(key).alias("__k"))
    same = F.col("__k").eqNullSafe(F.col(key))
    names = asked.select(key)
    if asked.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS and kind != "string":
        rows = rows.join(F.broadcast(names), same, "left_semi")
    # Rows lie together, so the ends tell how many there are.
    ranks = rows.groupBy("__k").agg(F.min("pos").alias("pos"), (F.max("pos") - F.min("pos") + 1).alias("n"))
    return found.join(ranks, same, "left").select(key, "pos", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def rows_at(spark: SparkSession, path: str, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows at the distinct ``positions`` with their ``pos``; positions that are
    null, negative or beyond the last row give none."""
    entries = _entries(spark, path)
    n = sum(e["n"] for e in entries)
    wanted = positions.select(F.col(pos).cast("bigint").alias("pos")).where(F.col("pos").between(0, n - 1)).distinct()
    found = cut_lineage(range_number(wanted, ["pos"], [(e["start"],) for e in entries], "__file"), "wanted")
    files = [r["__file"] - 1 for r in found.select("__file").distinct().collect()]
    rows, names = _read(spark, path, entries, files), found.select("pos")
    if names.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS:
        names = F.broadcast(names)
    return rows.join(names, "pos", "left_semi")
