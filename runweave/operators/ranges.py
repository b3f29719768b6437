"""Value ranges: sampled pivots and the lookup of a row's range.

A range is numbered by how many pivots are <= the row's key, so a value equal
to a pivot goes right and repeated pivots leave empty ranges behind.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

MIN_ROWS_PER_RANGE = 10_000
MAX_ROWS_PER_RANGE = 8_000_000
MAX_RANGES = 65_536
SAMPLE_PER_RANGE = 100
MIN_SAMPLE = 10_000
MAX_SAMPLE = 1_000_000
SAMPLE_SEED = 7
# Bytes of keys that one task sorts; fewer keys are drawn where keys are long.
SAMPLE_BYTES = 64 << 20
# A cut need not be a whole key: of a long text its beginning will do.
CUT_CHARS = 1_000
# Characters that all cuts together may keep beyond that to be told apart.
CUT_BUDGET = 1 << 20
# Keys drawn exactly twice that make the estimate of all keys worth using.
MIN_PAIRS = 10
# Rows per key from which counting keys beats sorting rows.
COPIES_TO_COLLAPSE = 16


def default_ranges(df: DataFrame, n_rows: int) -> int:
    """How many ranges suit ``n_rows``: the session's parallelism, fewer for
    small data, more where ranges would outgrow a task."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = min(parallel, ceil(n_rows / MIN_ROWS_PER_RANGE))
    return max(1, min(MAX_RANGES, max(p, ceil(n_rows / MAX_ROWS_PER_RANGE))))


# A timestamp as text could name two instants when clocks go back.
SECONDS = "decimal(20,6)"


def _as_text(key: Column, dtype: str) -> Column:
    return (key.cast(SECONDS) if dtype == "timestamp" else key).cast("string")


def literal_array(values: list, dtype: str) -> Column:
    """A constant array, built from one string so that its cost in the driver
    does not grow with a call per element; the optimizer folds it.  Values are
    given as Python values or as `_as_text` has them."""
    if dtype == "timestamp":
        values = [f"{v.timestamp():.6f}" if isinstance(v, datetime) else v for v in values]
    texts = [None if v is None else str(v) for v in values]
    array = F.from_json(F.lit(json.dumps(texts)), "array<string>")
    if dtype == "timestamp":
        array = array.cast(f"array<{SECONDS}>")
    return array.cast(f"array<{dtype}>")


@dataclass(frozen=True)
class SampledRanges:
    """Pivots of a sample, as text: one tuple per pivot, one entry per key
    column.  ``hot`` are pivots drawn more than once, that is,
    keys holding about a whole range or more of the rows."""

    cols: list[str]
    drawn: list[tuple]
    n_rows: int
    #: Keys in the data, as far as the sample tells; None where it cannot.
    n_keys: float | None

    @property
    def pivots(self) -> list[tuple]:
        return list(dict.fromkeys(self.drawn))

    @property
    def hot(self) -> set[tuple]:
        seen: set[tuple] = set()
        return {t for t in self.drawn if t in seen or seen.add(t)}

    @property
    def repetitive(self) -> bool:
        """A key has many rows on average, hot keys aside."""
        return self.n_keys is not None and self.n_keys * COPIES_TO_COLLAPSE <= self.n_rows


def _estimate_keys(distinct: int, once: int, twice: int, whole: bool) -> float | None:
    """Chao's estimate of the number of keys from those drawn once and twice;
    keys drawn often do not disturb it."""
    if whole or once == 0:
        return distinct
    return distinct + once * once / (2 * twice) if twice >= MIN_PAIRS else None


def sample_ranges(df: DataFrame, cols: list[str], n_rows: int, p: int) -> SampledRanges:
    """Evenly spaced keys of a bounded random sample of ``df``.

    The sample places the cuts and picks a strategy; it never decides which
    rows a result has.  One task sorts it (about MAX_SAMPLE keys at most) and
    the driver receives p - 1 of them.
    """
    target = max(MIN_SAMPLE, min(MAX_SAMPLE, SAMPLE_PER_RANGE * p))
    keys = df.select(*cols)
    texts = [c for c, dtype in zip(cols, _dtypes(df, cols)) if dtype in ("string", "binary")]
    if texts and n_rows:
        lengths = sum(F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts)
        mean = keys.agg(F.avg(lengths)).first()[0] or 0
        target = max(1, min(target, int(SAMPLE_BYTES / max(1, mean))))
    whole = n_rows <= target
    if not whole:
        keys = keys.sample(fraction=target / n_rows, seed=SAMPLE_SEED)
    drawn = keys.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("k")).select(
        "k", F.size("k").alias("m")
    )

    def same(i: Column, j: Column) -> Column:
        return F.get("k", i).eqNullSafe(F.get("k", j))

    # Where each distinct key begins in the sorted sample.
    begins = F.filter(
        F.sequence(F.lit(0), F.col("m") - 1), lambda i: (i == 0) | ~same(i, i - 1)
    )
    once = F.filter("begins", lambda i: ~same(i, i + 1))
    twice = F.filter("begins", lambda i: same(i, i + 1) & ~same(i, i + 2))
    if p < 2:
        picks = F.array().cast("array<array<string>>")
    else:
        at = F.col("m").cast("bigint") / p
        picks = F.transform(
            F.sequence(F.lit(1), F.lit(p - 1)),
            lambda i: F.array(
                *[
                    _as_text(F.get("k", (i * at).cast("int"))[c], dtype)
                    for c, dtype in zip(cols, _dtypes(df, cols))
                ]
            ),
        )
    row = (
        drawn.withColumn("begins", begins)
        .select(
            "m",
            picks.alias("picks"),
            F.size("begins").alias("distinct"),
            F.size(once).alias("once"),
            F.size(twice).alias("twice"),
        )
        .first()
    )
    if not row["m"]:
        return SampledRanges(list(cols), [], n_rows, 0)
    n_keys = _estimate_keys(row["distinct"], row["once"], row["twice"], whole)
    drawn = [tuple(t) for t in row["picks"]]
    if _dtypes(df, cols)[0] == "string":
        drawn = _shortened(drawn)
    return SampledRanges(list(cols), drawn, n_rows, n_keys)


def _shortened(drawn: list[tuple]) -> list[tuple]:
    """Cuts with long texts cut off, still in order.  A text that shares its first
    characters with the one before keeps as many as tell the two apart; where all
    that is more than ``CUT_BUDGET``, evenly spaced ones of these do.  Those drawn
    more than once are hot keys and stay whole."""
    ends: list[int | None] = []
    for i, t in enumerate(drawn):
        hot = t in drawn[max(0, i - 1) : i] or t in drawn[i + 1 : i + 2]
        if hot or t[0] is None or len(t[0]) <= CUT_CHARS:
            ends.append(None)
            continue
        before = drawn[i - 1][0] if i and drawn[i - 1][0] is not None else ""
        ends.append(max(CUT_CHARS, len(os.path.commonprefix([before, t[0]])) + 1))
    every = -(-sum(n for n in ends if n and n > CUT_CHARS) // CUT_BUDGET)
    out: list[tuple] = []
    longer = 0
    for t, n in zip(drawn, ends):
        if n and n > CUT_CHARS:
            longer += 1
            if longer % every:
                continue
        out.append(t if n is None else (t[0][:n], *t[1:]))
    return out


def _dtypes(df: DataFrame, cols: list[str]) -> list[str]:
    types = dict(df.dtypes)
    return [types[c] for c in cols]


def range_number(
    df: DataFrame, cols: list[str], pivots: list[tuple], out: str
) -> DataFrame:
    """Add ``out``: the number of ``pivots`` (sorted tuples) <= the row's key.

    A binary search written as one projection per level: level k holds the
    2**k pivots it may need, so a row costs log2(p) comparisons inside
    generated code and the plan carries each pivot once.  Nulls sort first.
    """
    dtypes = _dtypes(df, cols)
    levels = len(pivots).bit_length()
    with_nulls = [any(t[i] is None for t in pivots) for i in range(len(cols))]
    names = list(df.columns)
    cur = F.lit(0)
    for k in range(levels):
        step = 2 ** (levels - 1 - k)
        level = pivots[step - 1 :: 2 * step]
        le = None
        for i in reversed(range(len(cols))):
            pivot = F.get(literal_array([t[i] for t in level], dtypes[i]), cur)
            key = F.col(cols[i])
            if with_nulls[i]:
                flag = F.get(
                    literal_array([int(t[i] is not None) for t in level], "int"), cur
                )
                known = key.isNotNull().cast("int")
                lt = (flag < known) | (pivot < key)
                eq = (flag == known) & pivot.eqNullSafe(key)
            else:
                lt, eq = pivot < key, pivot == key
            if le is None and not with_nulls[i]:
                le = pivot <= key
            else:
                le = lt | (eq if le is None else eq & le)
        df = df.select(*names, (cur * 2 + F.when(le, 1).otherwise(0)).alias(out))
        cur = F.col(out)
    if levels == 0:
        return df.withColumn(out, F.lit(0))
    # Pushing a filter on `out` below the levels would double it at each one; a
    # condition that is constant but not deterministic keeps it above.
    return df.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, F.col(out)))


def is_hot(df: DataFrame, ranges: SampledRanges, number: str) -> Column:
    """True where a row's key equals the lower pivot of its range and that
    pivot is hot."""
    dtypes = _dtypes(df, ranges.cols)
    hot = ranges.hot
    lower = [None] + [t if t in hot else None for t in ranges.pivots]
    cond = F.get(literal_array([int(t is not None) for t in lower], "int"), F.col(number)) == 1
    for i, c in enumerate(ranges.cols):
        values = literal_array([None if t is None else t[i] for t in lower], dtypes[i])
        cond = cond & F.get(values, F.col(number)).eqNullSafe(F.col(c))
    return cond


def assign_range(df: DataFrame, col: str, pivots: list) -> DataFrame:
    """Add ``bucket int``: pivot[b-1] <= value < pivot[b].  Null pivots, like null
    values, are least.

    One deterministic expression, a binary search over one constant array, so
    that filters on other columns still reach the scan.
    """
    known = [v for v in pivots if v is not None]
    nulls = len(pivots) - len(known)
    if any(v is None for v in pivots[nulls:]) or any(a > b for a, b in zip(known, known[1:])):
        raise ValueError("pivots must be in ascending order")
    if not known:
        return df.withColumn("bucket", F.lit(nulls))
    array = literal_array(known, dict(df.dtypes)[col])
    steps = [1 << k for k in reversed(range(len(known).bit_length()))]

    def step(found: Column, width: Column) -> Column:
        # Whether the next `width` pivots are all <= the value.
        return F.when(F.get(array, found + width - 1) <= F.col(col), found + width).otherwise(found)

    search = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
    return df.withColumn("bucket", search + F.lit(nulls))


def range_histogram(ranged: DataFrame, col: str = "v") -> DataFrame:
    """Rows, least and greatest value of each non-empty range."""
    return ranged.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")
    )
