"""Sessions of a stream's keys, kept as state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups that keys are put into by a hash; a group's open sessions are one value of the state, looked at together.
KEY_GROUPS = 1024

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spans (first time, last time, rows) in order of time, those at most `gap` apart joined."""
    out: list[tuple[int, int, int]] = []
    for low, high, n in sorted(spans):
        if out and low - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], high), out[-1][2] + n)
        else:
            out.append((low, high, n))
    return out


def joined(spans: pd.DataFrame, key: str, gap: int) -> pd.DataFrame:
    """What merged() does for one key, for spans of many keys (columns key, low, high, n) at once."""
    spans = spans.sort_values([key, "low"], kind="stable", ignore_index=True)
    of_key = spans.groupby(key, sort=False, dropna=False)
    opens = of_key.ngroup().diff().ne(0) | (spans["low"] - of_key["high"].cummax().shift()).gt(gap)
    parts = spans.groupby(opens.cumsum().to_numpy(), sort=False)
    return parts.agg({key: "first", "low": "first", "high": "max", "n": "sum"}).reset_index(drop=True)


class Sessions(StatefulProcessor):
    """Keeps the open spans of a group of keys, and a timer for the first of them that closes: when the watermark has passed its last time by the gap."""

    def __init__(self, gap: int, key: str, kind: str) -> None:
        self.gap, self.key, self.kind = gap, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"keys array<{self.kind}>, low array<bigint>, high array<bigint>, n array<bigint>")

    def _closes(self, high):
        """The first whole millisecond by which no row can join any more."""
        return -(-(high + self.gap) // 1000) + 1

    def _known(self) -> pd.DataFrame | None:
        found = self.open.get()
        return None if found is None else pd.DataFrame(dict(zip((self.key, "low", "high", "n"), found)))

    def _keep(self, spans: pd.DataFrame, timer: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Emit the spans that have closed by now, keep the others, and let the timer that was set, if any, be that of the first of these."""
        closed = self._closes(spans["high"]) <= now
        left = spans[~closed]
        following = None if left.empty else int(self._closes(left["high"].min()))
        if timer is not None and timer != following:
            self.handle.deleteTimer(timer)
        if following is not None and timer != following:
            self.handle.registerTimer(following)
        if left.empty:
            self.open.clear()
        else:
            self.open.update(tuple(left[c].tolist() for c in (self.key, "low", "high", "n")))
        if closed.any():
            yield spans[closed]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._known()
        timer = None if before is None else int(self._closes(before["high"].min()))
        parts = [part[[self.key, "low", "high", "n"]] for part in rows]
        spans = joined(pd.concat(parts if before is None else [before, *parts]), self.key, self.gap)
        yield from self._keep(spans, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Spark removes the timer that has expired
        yield from self._keep(self._known(), None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_sessions(stream: DataFrame, key: str, time: str, gap_seconds: int, late: str, groups: int = KEY_GROUPS) -> DataFrame:
    """key, began, ended, n: the sessions of each key, emitted once when no row can join them any more.

    Rows that come out of order by at most `late` join, or connect, the sessions
    they belong to; later ones are left out. The state holds a key's open
    sessions only, a few numbers each. Keys are dealt into `groups` by a hash;
    the open sessions of a group are read, joined and written at once, and a
    timer waits for the first that closes, so that the cost goes with the rows
    and not with calls for each key or session. A stream that goes on from its
    state needs the same number of groups, and tasks beyond it have nothing to
    do. Within a task rows of a key that are at most the gap apart become one
    span before the shuffle, so a key with most rows costs no more than others;
    such a span is late only if its last row is. Rows with a null key or time
    are left out. The session has to name a state store with timers (STORE, in
    spark.sql.streaming.stateStore.providerClass).
    """
    gap = gap_seconds * 1_000_000
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.unix_micros(time).alias("at"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield joined(pd.DataFrame({key: batch[key], "low": batch["at"], "high": batch["at"], "n": 1}), key, gap)

    kind = stream.schema[key].dataType.simpleString()
    found = rows.mapInPandas(spans, f"{key} {kind}, low bigint, high bigint, n bigint").withColumn("last", F.timestamp_micros("high")).withWatermark("last", late)
    out = found.withColumn("key_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("key_group").transformWithStateInPandas(Sessions(gap, key, kind), f"{key} {kind}, low bigint, high bigint, n bigint", "append", "eventTime")
    return out.select(key, F.timestamp_micros("low").alias("began"), F.timestamp_micros("high").alias("ended"), "n")
