"""What happens to sources, told as it happens: seen, address changed, gone.

`live_sources` answers when asked; here a source that falls silent is dropped by
a timer.  Beats are kept until the watermark has passed them, and are then taken
in order of time, so events do not depend on the order of arrival within the
lateness allowed.  State is one small record per source in view, and its beats of
the last ``lateness``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from runweave.streaming.live import LOOPBACK, SOURCE, TIMEOUT

SEEN, CHANGED, GONE = "seen", "address", "gone"
EVENTS = StructType(
    [
        StructField("name", StringType()), StructField("port", IntegerType()), StructField("event", StringType()),
        StructField("at", TimestampType()), StructField("host", StringType()),
    ]
)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MICRO = timedelta(microseconds=1)
KNOWN = StructType([StructField("last", LongType()), StructField("host", StringType())])
BEAT = StructType([StructField("at", LongType()), StructField("host", StringType())])


def _due(at: int) -> int:
    """The millisecond by which a moment (in microseconds) has surely passed."""
    return at // 1000 + 1


class SourceEvents(StatefulProcessor):
    def __init__(self, timeout: timedelta) -> None:
        self.timeout = timeout // MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)
        self.waiting = handle.getListState("waiting", BEAT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A burst of beats of one moment is one; its address is the greatest.
        beats: dict[int, str | None] = {}
        local = set()
        for row in rows:
            at = (row["ts"].astimezone(timezone.utc) - EPOCH) // MICRO
            beats[at] = max(beats.get(at) or "", row["host"] or "")
            if row["host"] == LOOPBACK:
                local.add(at)
        self.waiting.appendList([(at, LOOPBACK if at in local else host) for at, host in beats.items()])
        self.handle.registerTimer(_due(min(beats)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        known = self.known.get() if self.known.exists() else None
        last, host = (known[0], known[1]) if known else (None, None)
        ready, later = {}, []
        for at, beat in self.waiting.get() if self.waiting.exists() else ():
            if _due(at) <= now:
                ready[at] = LOOPBACK if LOOPBACK in (beat, ready.get(at)) else max(beat, ready.get(at, ""))
            else:
                later.append((at, beat))
        out = []
        for at, beat in sorted(ready.items()):
            if last is not None and at - last > self.timeout:
                out.append((GONE, last + self.timeout, host))
                last = None
            if last is None:
                out.append((SEEN, at, beat))
                host = beat
            elif host != LOOPBACK and beat != host:
                out.append((CHANGED, at, beat))
                host = beat
            last = at
        if last is not None and _due(last + self.timeout) <= now and not any(at <= last + self.timeout for at, _ in later):
            out.append((GONE, last + self.timeout, host))
            last = None
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(_due(min(at for at, _ in later)))
        self.known.clear()
        if last is not None:
            self.known.update((last, host))
            self.handle.registerTimer(_due(last + self.timeout))
        for event, at, address in out:
            yield Row(name=key[0], port=key[1], event=event, at=EPOCH + at * MICRO, host=address)


def source_events(
    stream: DataFrame, timeout: timedelta = TIMEOUT, lateness: timedelta = timedelta(minutes=1)
) -> DataFrame:
    """``name, port, event, at, host`` of a stream of beats, up to the watermark,
    which is the latest beat less ``lateness``; beats that come later than that are
    not counted.

    ``seen`` begins a session, ``address`` says that a source is now known under
    another one (once under the loopback address, it keeps that until it is gone),
    ``gone`` comes one timeout after its last beat.  Null hosts count as empty.
    (This sets the session option for the state store that timers need.)
    """
    stream.sparkSession.conf.set(STORE, ROCKS)
    beats = stream.select(*SOURCE, "host", "ts").withWatermark("ts", f"{lateness // MICRO} microseconds")
    return beats.groupBy(*SOURCE).transformWithState(
        statefulProcessor=SourceEvents(timeout), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime"
    )
