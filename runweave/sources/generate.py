"""Reproducible uniform integers, made where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runweave.operators.sorting import global_sort

# The default domain, both ends included.
LOW, HIGH = 1, 10_000_000


# Fixed values of the mixing: a prime below 2**31, and factors and terms below it.
PRIME = 2_147_483_647
ROUNDS = ((1_103_515_245, 12_345), (1_664_525, 1_013_904_223), (69_069_413, 907_133_923))
SECOND_SEED = 486_187_739

# Values of one share at most, of one block of it, of one task; tasks at most.
SHARE_LIMIT, SHARE_BLOCK, TASK_VALUES, MAX_TASKS = 1 << 32, 1 << 16, 1 << 21, 1 << 16


def _mixed(key: Column, seed: Column) -> Column:
    """A number below PRIME from a key, by products that fit 64 bits."""
    x = F.pmod(F.pmod(key, F.lit(PRIME)) + F.pmod(F.shiftright(key, 31), F.lit(PRIME)) * 31 + seed, F.lit(PRIME))
    for factor, term in ROUNDS:
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(factor) + F.lit(term), F.lit(PRIME))
    return x


def draw_uniform(key: Column | str, low: int = LOW, high: int = HIGH, seed: int = 0) -> Column:
    """A uniform integer in ``low..high`` for each (integer) key: the same for the
    same key and seed wherever and whenever it is drawn."""
    if high < low:
        raise ValueError("low must not exceed high")
    key = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    first = _mixed(key, F.lit(seed % PRIME).cast("bigint"))
    second = _mixed(key, F.lit((seed + SECOND_SEED) % PRIME).cast("bigint"))
    wide = first * F.lit(PRIME) + second
    return (F.pmod(wide, F.lit(high - low + 1)) + F.lit(low)).cast("bigint")


def generate_uniform(
    spark: SparkSession,
    n: int,
    low: int = LOW,
    high: int = HIGH,
    seed: int = 0,
    num_partitions: int | None = None,
) -> DataFrame:
    """``n`` rows ``(pos, v)`` with ``v`` uniform in ``low..high``.

    Each value is drawn from its position and the seed, so it is the same for
    any number of partitions and after any retry; every task makes an equal
    share.
    """
    ids = spark.range(n, numPartitions=num_partitions)
    return ids.select(F.col("id").alias("pos"), draw_uniform("id", low, high, seed).alias("v"))


def generate_sorted(
    spark: SparkSession,
    n: int,
    low: int = LOW,
    high: int = HIGH,
    seed: int = 0,
    num_partitions: int | None = None,
) -> DataFrame:
    """``n`` uniform values in ascending order, never stored unsorted."""
    return global_sort(
        generate_uniform(spark, n, low, high, seed, num_partitions).select("v"), "v"
    )


def draw_sorted(
    df: DataFrame, key: str, low: int = LOW, high: int = HIGH, seed: int = 0, num_partitions: int | None = None
) -> DataFrame:
    """A uniform value for each row of ``df``, drawn from its ``key``, in ascending
    order; the unsorted values are never stored."""
    return global_sort(df.select(draw_uniform(key, low, high, seed).alias("v")), "v", num_partitions)


def draw_shares(
    shares: DataFrame, key: str, share: str = "share", low: int = LOW, high: int = HIGH, seed: int = 0
) -> DataFrame:
    """``share`` uniform values for each row of ``shares``, as sorted runs: ``key, v`` in
    ascending order.

    ``key`` is an integer that tells the rows apart; the i-th value of a row is drawn
    from ``key * SHARE_LIMIT + i``, so a share may have as many values as that.  Shares
    are dealt to the tasks in blocks, so one large share is made by many.  A null
    share, or one below 1, has no values.
    """
    wanted = shares.select(key, F.col(share).cast("bigint").alias("__n")).where("__n > 0")
    sums = wanted.agg(F.sum("__n").alias("n"), F.max("__n").alias("most")).first()
    if (sums["most"] or 0) > SHARE_LIMIT:
        raise ValueError(f"a share has more than {SHARE_LIMIT} values")
    last = F.expr(f"(__n - 1) div {SHARE_BLOCK}")
    blocks = wanted.select(key, "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__block"))
    tasks = min((sums["n"] or 0) // TASK_VALUES + 1, MAX_TASKS)
    first = F.col("__block") * SHARE_BLOCK
    places = F.sequence(first, F.least(first + SHARE_BLOCK, F.col("__n")) - 1)
    values = blocks.repartition(tasks, key, "__block").select(key, F.explode(places).alias("__i"))
    drawn = draw_uniform(F.col(key).cast("bigint") * SHARE_LIMIT + F.col("__i"), low, high, seed)
    return global_sort(values.select(key, drawn.alias("v")), [key, "v"])
