"""Sources known from their heartbeats: who is alive, and when each was.

A source is ``(name, port)``.  It stays in view while no two of its beats, nor
its last beat and now, are more than the timeout apart.  Within one such
session a source seen under the loopback address keeps it.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Seconds until a silent source is dropped, the loopback address.
TIMEOUT = timedelta(seconds=4)
LOOPBACK = "127.0.0.1"

SOURCE = ["name", "port"]
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _address(local: Column, latest: Column) -> Column:
    return F.when(local, F.lit(LOOPBACK)).otherwise(latest)


def source_sessions(beats: DataFrame, timeout: timedelta = TIMEOUT) -> DataFrame:
    """Sessions of each source: ``name, port, started, last_seen, beats, host``.

    Beats are first merged per source and time slice one timeout long, whose
    beats always share a session.  The window then sees a row per slice, so a
    source's work is bounded by the time it covers, not by its beats.
    """
    span = _micros(timeout)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = (
        beats.withColumn("at", at)
        .groupBy(*SOURCE, F.expr(f"at div {span}L - if(at % {span}L < 0, 1, 0)").alias("slice"))
        .agg(
            F.min("at").alias("first"),
            F.max("at").alias("last"),
            F.count("*").alias("beats"),
            F.max(F.col("host") == LOOPBACK).alias("local"),
            F.max(F.struct("at", "host")).alias("latest"),
        )
    )
    by_time = W.partitionBy(*SOURCE).orderBy("first")
    starts = F.coalesce(F.col("first") - F.lag("last").over(by_time) > span, F.lit(True))
    sessions = (
        slices.withColumn("starts", starts.cast("int"))
        .withColumn("session", F.sum("starts").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*SOURCE, "session")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("beats").alias("beats"),
            F.max("local").alias("local"),
            F.max("latest").alias("latest"),
        )
    )
    return sessions.select(
        *SOURCE,
        F.timestamp_micros("first").alias("started"),
        F.timestamp_micros("last").alias("last_seen"),
        "beats",
        _address(F.col("local"), F.col("latest.host")).alias("host"),
    )


def live_sources(
    beats: DataFrame, as_of: datetime | Column, timeout: timedelta = TIMEOUT
) -> DataFrame:
    """Sources in view at ``as_of``: ``name, port, host, last_seen``.

    A source silent for exactly the timeout is still in view.
    """
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    now = F.unix_micros(now.cast("timestamp"))
    seen = F.unix_micros(F.col("ts").cast("timestamp"))
    latest = source_sessions(beats.where(seen <= now), timeout)
    # At most one session of a source reaches into the last timeout.
    return latest.where(now - F.unix_micros("last_seen") <= _micros(timeout)).select(
        *SOURCE, "host", "last_seen"
    )


def session_stream(
    stream: DataFrame, timeout: timedelta = TIMEOUT, lateness: timedelta = timedelta(minutes=1)
) -> DataFrame:
    """`source_sessions` of a stream: a session is emitted once the watermark
    has passed its end; beats later than ``lateness`` are not counted.

    Sessions are merged before the exchange too, so a busy source sends its
    sessions, not its beats.  (This sets the session option that says so.)
    """
    stream.sparkSession.conf.set(LOCAL_MERGE, "true")
    gap = f"{_micros(timeout)} microseconds"
    sessions = (
        stream.withWatermark("ts", f"{_micros(lateness)} microseconds")
        .groupBy(*SOURCE, F.session_window("ts", gap).alias("w"))
        .agg(
            F.count("*").alias("beats"),
            F.max(F.col("host") == LOOPBACK).alias("local"),
            F.max(F.struct("ts", "host")).alias("latest"),
        )
    )
    return sessions.select(
        *SOURCE,
        F.col("w.start").alias("started"),
        F.col("latest.ts").alias("last_seen"),
        "beats",
        _address(F.col("local"), F.col("latest.host")).alias("host"),
    )
