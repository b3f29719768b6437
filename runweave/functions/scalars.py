"""Scalar functions: all built-in expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bounds of a 32-bit integer, and the chunk-seed formula
# (session * SESSION_FACTOR + chunk * CHUNK_FACTOR) mod SEED_MODULUS.
INT32_MIN = -2_147_483_648
INT32_MAX = 2_147_483_647
SESSION_FACTOR = 1_000_003
CHUNK_FACTOR = 2_654_435_761
SEED_MODULUS = 1_000_000_000


def overflow_int32(col: Column | str) -> Column:
    """True where a value does not fit into 32 bits."""
    c = F.col(col) if isinstance(col, str) else col
    return ~c.between(INT32_MIN, INT32_MAX)


def narrow_int32(df: DataFrame, col: str, on_overflow: str = "fail") -> DataFrame:
    """Replace ``col`` by its 32-bit form.

    ``fail`` stops the job at the first value out of range, whatever the
    session's ANSI setting; ``null`` blanks such values.  Never wraps around.
    """
    if on_overflow == "null":
        bad = F.lit(None).cast("int")
    elif on_overflow == "fail":
        bad = F.raise_error(
            F.concat(F.lit(f"{col} does not fit into int32: "), F.col(col).cast("string"))
        ).cast("int")
    else:
        raise ValueError("on_overflow is 'fail' or 'null'")
    return df.withColumn(
        col, F.when(overflow_int32(col), bad).otherwise(F.expr(f"try_cast(`{col}` AS int)"))
    )


def chunk_seed(session_seed: Column | int, chunk_id: Column | str) -> Column:
    """Seed of a chunk, derived from the session's seed.

    Both inputs are reduced first: the products then stay below 2**63 for any
    chunk number, and the remainder is unchanged.
    """
    session = F.lit(session_seed) if isinstance(session_seed, int) else session_seed
    chunk = F.col(chunk_id) if isinstance(chunk_id, str) else chunk_id
    modulus = F.lit(SEED_MODULUS).cast("bigint")
    return F.pmod(
        F.pmod(session.cast("bigint"), modulus) * F.lit(SESSION_FACTOR).cast("bigint")
        + F.pmod(chunk.cast("bigint"), modulus) * F.lit(CHUNK_FACTOR).cast("bigint"),
        modulus,
    )
