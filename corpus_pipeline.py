"""A corpus pipeline: stages applied one after the other to ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's input.
Documents stay unless a stage has a reason to drop them: no language, an equal
text with a larger id, a near-duplicate with a smaller id, or passages of the
benchmark.  The last stage adds the pieces of each text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runweave.llm import language, pieces
from runweave.llm.common import table
from runweave.llm.decontaminate import drop_contaminated
from runweave.llm.exact import drop_exact_duplicates
from runweave.llm.jaccard import drop_near_duplicates
from runweave.storage import cut_lineage

# Rows that go to a Python worker at once: few, as their texts go along.
BATCH_ROWS = 1_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Near-duplicates share this percentage of their shingles of so many words.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def small_batches(spark: SparkSession) -> None:
    """Have the session's Python workers hold few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no language go: null, empty, or without a letter.

    A null language or id is no reason; a table without rows stays empty.
    """
    small_batches(spark)
    model = language.fit(docs, F.col("doc_id").isNotNull())
    return language.drop_unknown(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of rows that repeat
    id and text, one.  Null texts count as empty, null ids are kept last."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (of
    several with that id the one with the least text digest).  Documents without
    words all stay."""
    small_batches(spark)
    return drop_near_duplicates(docs, NEAR_PERCENT, NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of the benchmark in them go; those without words
    stay, and so do all where the benchmark has no items."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as pieces; ``round_trip`` says that they decode to it.  Null and
    empty texts have none.  Every document stays."""
    small_batches(spark)
    vocabulary = pieces.load(pieces.MODEL_PATH)
    encoded = pieces.encode(docs, vocabulary, pieces.N_BEST)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return encoded.select(
        *kept,
        F.size("ids").cast("long").alias("n_pieces"),
        F.col("ids").alias("piece_ids"),
        F.col("score").alias("piece_score"),
        F.col("others").alias("other_segmentations"),
        "round_trip",
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
# Learned models and searches have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
