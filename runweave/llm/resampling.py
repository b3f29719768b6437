"""Target-distribution importance resampling over hashed word features.

Features are runs of one to ``n_max`` consecutive words joined by one space; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets.
How often the buckets occur in the target and in the corpus gives every bucket a
gain, a text's gains add up to its weight, and the texts with the highest weight
plus Gumbel noise are drawn: a sample without replacement in proportion to the
exponentials of the weights.

A slice of text is scanned by an Aho-Corasick automaton whose dictionary is the
slice's distinct words, each bounded by delimiters on both sides, with its CRC
and length as payload; so a dictionary is never larger than its slice, and a
word's CRC is worked out once.  The scan emits a payload per word in order.  The
CRC of a longer feature is composed of the payloads of adjacent words: shifting
a CRC by a length is linear over its bits.

Counting emits one row per bucket and task, scoring reads the gains (one number
per bucket, a fixed number).  Words of more than ``LONG_WORD`` bytes stay out of
the dictionary, and carry their payload directly.

Edge cases: a null text counts as empty; a text without words has no features
and weight 0; a text may be longer than a slice, and is then scanned in pieces
cut between words; rows that repeat count each; ties go to the smaller id, null
ids last; a null id is hashed as the empty string; an empty target or corpus
gives counts of zero; other columns are not read and cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runweave.llm.common import slices
from runweave.operators import global_position
from runweave.storage import cut_lineage

SLICE = 1 << 19
LONG_WORD = 256
# The bytes of words, A-Z lower-cased; every other byte bounds words.
_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TRANSLATION = bytes(b if b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
# Fixed value: the CRC-32 polynomial, bits reversed.
POLYNOMIAL = 0xEDB88320


def _zero_byte_tables(levels: int = 31) -> np.ndarray:
    """``[k, j, b]``: what ``2**k`` zero bytes make of byte ``j`` of a CRC being ``b``."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(POLYNOMIAL) ^ (step >> 1), step >> 1).astype(np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    one = np.stack([step] + [byte << np.uint32(8 * j - 8) for j in (1, 2, 3)])
    tables = [one]
    for _ in range(levels - 1):
        tables.append(_apply(tables[-1], tables[-1]))
    return np.stack(tables)


def _apply(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return table[0][crcs & 255] ^ table[1][crcs >> 8 & 255] ^ table[2][crcs >> 16 & 255] ^ table[3][crcs >> 24]


ZEROS = _zero_byte_tables()
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What so many bytes behind them make of CRCs, before those bytes' own CRC is added."""
    out, rest, level = crcs.copy(), lengths.copy(), 0
    while rest.any():
        some = np.flatnonzero(rest & 1)
        out[some] = _apply(ZEROS[level], out[some])
        rest >>= 1
        level += 1
    return out


def _scan(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, CRCs and lengths of the words of a piece, in order."""
    words = list(set(piece.split()))
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    lengths = np.array([len(w) for w in words], np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    long = []
    for number, word in enumerate(words):
        if len(word) <= LONG_WORD:
            automaton.add_word(f" {word.decode('latin-1')} ", number)
        else:
            long.append(number)
    starts = numbers = np.zeros(0, np.int64)
    padded = f" {piece.decode('latin-1')} "
    if len(long) < len(words):
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(padded)), np.int64).reshape(-1, 2)
        numbers = found[:, 1]
        # In the padded text a word ends before the match does.
        starts = found[:, 0] - lengths[numbers] - 1
    if long:
        at = np.array([(i, n) for n in long for i in _places(padded, f" {words[n].decode('latin-1')} ")])
        starts, numbers = np.append(starts, at[:, 0]), np.append(numbers, at[:, 1])
        order = np.argsort(starts, kind="stable")
        starts, numbers = starts[order], numbers[order]
    return starts, crcs[numbers], lengths[numbers]


def _places(text: str, bounded: str) -> Iterator[int]:
    at = text.find(bounded)
    while at >= 0:
        yield at
        at = text.find(bounded, at + 1)


def payloads(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, CRCs and lengths of all words of ``raw``, whose delimiters are spaces."""
    found, at = [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            cut = raw.find(b" ", end) if cut < 0 else cut
            end = len(raw) if cut < 0 else cut + 1
        if raw[at:end].strip():
            starts, crcs, lengths = _scan(raw[at:end])
            found.append((starts + at, crcs, lengths))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def features(texts: list[bytes], n_max: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and buckets of all features, and every text's number of words."""
    raw = b" ".join(texts).translate(TRANSLATION)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, crcs, lengths = payloads(raw)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    owners, found = [owner], [crcs]
    # A word behind a space, as it follows another.
    behind = shifted(np.full(len(crcs), SPACE_CRC), lengths) ^ crcs
    run = crcs
    for n in range(2, n_max + 1):
        run = shifted(run[: len(run) - 1], lengths[n - 1 :] + 1) ^ behind[n - 1 :] if len(run) else run
        whole = owner[: len(run)] == owner[n - 1 :] if len(run) else np.zeros(0, bool)
        owners.append(owner[: len(run)][whole])
        found.append(run[whole])
    words = np.bincount(owner, minlength=len(texts))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64) % buckets, words


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    buffers = [t.as_buffer() for t in batch.column("text")]
    return [b"" if b is None else b.to_pybytes() for b in buffers]


def bucket_counts(texts: DataFrame, n_max: int, buckets: int) -> DataFrame:
    """``bucket, n``: how many features of the column ``text`` fall into each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", SLICE):
            total += np.bincount(features(_texts(batch), n_max, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_max: int, buckets: int) -> np.ndarray:
    """Per bucket ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))``; one row
    per bucket comes to the driver."""
    counts = []
    for texts in (corpus, target):
        n = [0.0] * buckets
        for row in bucket_counts(texts, n_max, buckets).collect():
            n[row["bucket"]] = float(row["n"])
        counts.append(n)
    s, t = counts
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n_max: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            owner, bucket, words = features(_texts(batch), n_max, buckets)
            n = np.bincount(owner, minlength=batch.num_rows)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, owner, gain[bucket])
            columns = [pa.array(x.astype(np.int64)) for x in (words, n, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln u))``, ``u`` from the SHA-256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int, seed: int, n_max: int = 2, buckets: int = 10_000, least_words: int = 0
) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, n_words, n_features, weight, score, rank``.

    Of the rows with at least ``least_words`` words the ``percent`` of highest
    score are drawn and ranked from 1; others have no rank.  Ranks are positions
    in a global sort by ranges, so no task sees all drawn rows.
    """
    gain = gains(docs, target, n_max, buckets)
    scored = weigh(docs, gain, n_max).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = cut_lineage(scored, "weights")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    order = scored.where(fit).select("*", (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_none"))
    placed = global_position(order, ["_down", "_none", "doc_id"])
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long")
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*scored.columns, rank.alias("rank")).unionByName(rest)
