"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file that is read on the driver (a fixed number of
tokens) and goes to the tasks; there are no special tokens.  Every match of the
pattern is encoded on its own, as the library does it.

Long texts are cut before they reach the library's pattern matcher.  White space
after anything else is a safe boundary: no alternative of the pattern goes on
from other characters into white space, and none looks back, so the matches on
either side are those of the whole text.  A long run of white space, on which
the matcher's look-ahead would exhaust its stack, is one match up to its last
character (all of it at the end of the text) and is encoded as a single piece.

Decoding joins the bytes of the tokens, whether or not they are valid text.

Edge cases: null and empty texts have no tokens; special-looking texts are
ordinary; a run of any length without a boundary is one part; rows that repeat
are each encoded; the input row is kept as a struct, so no name clashes; null
ids decode to no bytes, unknown ids fail the job; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from runweave.llm.common import row_texts, slices

# Bytes of text encoded, and tokens decoded, in one go.
SLICE = 1 << 20
TOKENS_AT_ONCE = 1 << 18
# Texts of more characters are cut into parts of about so many.
PART = 1 << 13
# A run of white space of more characters is encoded apart.
LONG_SPACE = 1 << 10
SPACES = regex.compile(r"\p{White_Space}++")


def load(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def tokenizer(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str) -> Iterator[tuple[bool, str]]:
    """``text`` in parts whose matches are those of the whole; true marks a part
    that is a single match."""
    start = 0
    for run in SPACES.finditer(text):
        low, high = run.span()
        if high - low > LONG_SPACE:
            if low > start:
                yield False, text[start:low]
            # The last space may begin the next match.
            start = high if high == len(text) else high - 1
            yield True, text[low:start]
        elif low - start >= PART:
            yield False, text[start:low]
            start = low
    if start < len(text):
        yield False, text[start:]


def encode_text(text: str, encoding: tiktoken.Encoding) -> np.ndarray:
    if len(text) <= PART:
        return encoding.encode_to_numpy(text, disallowed_special=())
    found = [
        np.array(encoding._encode_single_piece(part), np.uint32) if single else encoding.encode_to_numpy(part, disallowed_special=())
        for single, part in parts_of(text)
    ]
    return np.concatenate(found)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``row`` (the input row) and ``ids``, the tokens of its ``text``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(ranks, pattern)
        for batch in slices(row_texts(batches), "text", SLICE):
            found = [encode_text(text.as_py() or "", encoding) for text in batch.column("text")]
            ends = np.cumsum([0] + [len(ids) for ids in found]).astype(np.int32)
            flat = pa.array(np.concatenate(found).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["row", "ids"])

    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes its ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = {rank: token for token, rank in ranks.items()}
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False)
            group = (np.cumsum(sizes) - sizes) // TOKENS_AT_ONCE
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(sizes))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(low, high - low)
                flat = part.column("ids").flatten().to_numpy()
                ends = np.cumsum(sizes[low:high]).tolist()
                raw = [
                    b"".join([spelled[i] for i in flat[end - size : end].tolist()])
                    for end, size in zip(ends, sizes[low:high].tolist())
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(run, schema)
