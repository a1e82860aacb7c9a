"""Debounce and throttle as keyed state over a stream. State per key is two instants and a count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from sessionlens import constants as K

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounce_stream(events: DataFrame, settle_seconds: float = K.SETTLE_SECONDS, max_wait_seconds: float = K.MAX_WAIT_SECONDS, event_time: bool = True) -> DataFrame:
    """``(key, ts)`` changes to one row per hand-over.

    With ``event_time`` the stream needs a watermark on ``ts``, and a key is handed over when the
    watermark passes its ready time; otherwise the clock of the engine decides. Needs the RocksDB
    state store.
    """
    settle, longest = int(settle_seconds * 1000), int(max_wait_seconds * 1000)

    class Debounce(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.pending = handle.getValueState("pending", "first bigint, last bigint, changes bigint")

        def _row(self, key, first, last, changes) -> pd.DataFrame:
            at = pd.to_datetime([first, last, min(last + settle, first + longest)], unit="ms")
            return pd.DataFrame({"key": [key[0]], "first_seen": [at[0]], "last_seen": [at[1]], "changes": [changes], "ready_at": [at[2]]})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            first, last, changes = self.pending.get() if self.pending.exists() else (None, None, 0)
            if first is not None:
                self.handle.deleteTimer(min(last + settle, first + longest))
            now = None if event_time else timerValues.getCurrentProcessingTimeInMs()
            instants = []
            for batch in rows:
                stamps = batch["ts"].astype("datetime64[ms]").astype("int64")
                instants.extend(stamps if event_time else [now] * len(batch))
            for at in sorted(set(instants)) if event_time else instants:
                if first is not None and (at - last > settle or at - first > longest):
                    yield self._row(key, first, last, changes)
                    first, changes = None, 0
                first, last, changes = (at if first is None else first), at, changes + 1
            self.pending.update((int(first), int(last), int(changes)))
            self.handle.registerTimer(int(min(last + settle, first + longest)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.pending.exists():
                first, last, changes = self.pending.get()
                self.pending.clear()
                yield self._row(key, first, last, changes)

        def close(self) -> None:
            pass

    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Debounce(),
        outputStructType="key string, first_seen timestamp, last_seen timestamp, changes bigint, ready_at timestamp",
        outputMode="Append",
        timeMode="EventTime" if event_time else "ProcessingTime",
    )


def throttle_stream(events: DataFrame, interval_seconds: float) -> DataFrame:
    """``(key, ts)`` to the events that pass: none passed within the interval before. Events of a key
    are expected in order from one batch to the next. Needs the RocksDB state store."""
    interval = int(interval_seconds * 1e6)

    class Throttle(StatefulProcessor):
        def init(self, handle) -> None:
            self.passed = handle.getValueState("passed", "at bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            passed = self.passed.get()[0] if self.passed.exists() else None
            instants = set()
            for batch in rows:
                instants.update(batch["ts"].astype("datetime64[us]").astype("int64"))
            kept = []
            for at in sorted(instants):
                if passed is None or at - passed >= interval:
                    passed = at
                    kept.append(at)
            if kept:
                self.passed.update((int(passed),))
                yield pd.DataFrame({"key": [key[0]] * len(kept), "ts": pd.to_datetime(kept, unit="us")})

        def close(self) -> None:
            pass

    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Throttle(), outputStructType="key string, ts timestamp", outputMode="Append", timeMode="None",
    )
