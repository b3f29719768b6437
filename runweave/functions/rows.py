"""One hash for whole rows, wherever rows are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Flags that fit one number.
FLAGS = 62


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A 64-bit hash of these columns of ``df`` in which nulls count.

    Spark's hash skips nulls, so (null, 1) and (1, null) would agree; which
    columns are null is hashed along.  Nested values are hashed as text for the
    same reason.  0.0 and -0.0 agree, as they do in comparisons.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nested = (T.StructType, T.ArrayType, T.MapType)
    values = [
        F.col(f"`{c}`").cast("string") if isinstance(kinds[c], nested) else F.col(f"`{c}`")
        for c in columns
    ]
    flags = []
    for low in range(0, len(columns), FLAGS):
        bits = [
            F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, c in enumerate(columns[low : low + FLAGS])
        ]
        total = bits[0]
        for bit in bits[1:]:
            total = total + bit
        flags.append(total)
    return F.xxhash64(*values, *flags)
