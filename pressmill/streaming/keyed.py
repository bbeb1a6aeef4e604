"""Per-key state with timers on streams: rate windows, windows opened by a first attempt, hosts fetched in turn, answers that
expire. State is Spark's (RocksDB), its time is the rows' own: a timer fires when the watermark passes it, so a replay gives the
same rows, and what is past is dropped. Rows later than the watermark allows are dropped by Spark; others count where they belong.

Each function takes a stream with a watermark on `at` and returns one. A hot key is one task in turn, as its order matters; it
holds a few numbers a window, or the waiting rows of a host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(moment) -> int:
    return int(pd.Timestamp(moment).timestamp() * 1000)


def _in_order(batches: Iterator[pd.DataFrame], at: str, order: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values([at, order])


class _Windows(StatefulProcessor):
    """Counts of a key by window; a window's count goes when the watermark passes its end."""

    def __init__(self, limit: int, seconds: int, key: str, at: str, order: str):
        self.limit, self.seconds, self.key, self.at, self.order = limit, seconds, key, at, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "start bigint", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, size = [], self.seconds * 1000
        for row in _in_order(rows, self.at, self.order).to_dict("records"):
            moment = _millis(row[self.at])
            start = moment // size * size
            n = self.used.getValue((start,))[0] + 1 if self.used.containsKey((start,)) else 1
            if n == 1:
                self.handle.registerTimer(start + size)
            self.used.updateValue((start,), (n,))
            over = n > self.limit
            wait = max(1, -(-(start + size - moment) // 1000)) if over else 0
            out.append((key[0], row[self.at], row[self.order], not over, wait))
        yield pd.DataFrame(out, columns=[self.key, self.at, self.order, "allowed", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.seconds * 1000
        if self.used.containsKey((start,)):
            self.used.removeKey((start,))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class _FirstAttempt(StatefulProcessor):
    """A window that a key's first attempt opens; it closes `seconds` later, or when the watermark says so."""

    def __init__(self, limit: int, seconds: int, key: str, at: str, order: str):
        self.limit, self.seconds, self.key, self.at, self.order = limit, seconds, key, at, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, n = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for row in _in_order(rows, self.at, self.order).to_dict("records"):
            moment = _millis(row[self.at])
            if opened is None or moment - opened >= self.seconds * 1000:
                opened, n = moment, 0
                self.handle.registerTimer(opened + self.seconds * 1000)
            n += 1
            out.append((key[0], row[self.at], row[self.order], n <= self.limit))
        self.window.update((opened, n))
        yield pd.DataFrame(out, columns=[self.key, self.at, self.order, "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self.window.get()[0] + self.seconds * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class _Host(StatefulProcessor):
    """The waiting rows of a host, the newest first; one leaves, then none for `seconds`."""

    def __init__(self, seconds: int, host: str, at: str, seq: str):
        self.seconds, self.host, self.at, self.seq = seconds, host, at, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq bigint", "at bigint")
        self.free = handle.getValueState("free", "at bigint")

    def _next(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Let the newest waiting row go, and wake up when the next may. A busy host has its timer already."""
        if (self.free.exists() and self.free.get()[0] > now) or not (rows := list(self.waiting.keys())):
            return
        newest = max(rows)
        self.waiting.removeKey(newest)
        self.free.update((now + self.seconds * 1000,))
        self.handle.registerTimer(now + self.seconds * 1000)
        yield pd.DataFrame({self.host: [key[0]], self.seq: [newest[0]], "fetch_at": [pd.Timestamp(now, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A host that is free takes the rows one moment after the other, as they come.
        for moment, now in _in_order(rows, self.at, self.seq).groupby(self.at):
            for seq in now[self.seq]:
                self.waiting.updateValue((int(seq),), (_millis(moment),))
            yield from self._next(key, _millis(moment))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._next(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


class _Answers(StatefulProcessor):
    """A host's newest robots answer, for `seconds`; a request gets what held at its time, or none."""

    def __init__(self, seconds: int, host: str, at: str, answer: str, request: str):
        self.seconds, self.host, self.at, self.answer, self.request = seconds, host, at, answer, request

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "at bigint, answer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, answer = self.known.get() if self.known.exists() else (None, None)
        out = []
        both = pd.concat(list(rows))
        both = both.assign(_asks=both[self.request].notna()).sort_values([self.at, "_asks"])
        for row in both.to_dict("records"):
            moment = _millis(row[self.at])
            if row["_asks"]:
                valid = at is not None and at <= moment < at + self.seconds * 1000
                out.append((key[0], int(row[self.request]), answer if valid else None))
            elif at is None or moment >= at:
                at, answer = moment, row[self.answer]
        if at is not None:
            self.known.update((at, answer))
            self.handle.registerTimer(at + self.seconds * 1000)
        yield pd.DataFrame(out, columns=[self.host, self.request, self.answer])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists() and self.known.get()[0] + self.seconds * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.known.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60, *, key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, at, order, allowed, retry_after): the first `limit` of each key in each fixed window pass, a late one in its own."""
    kinds = dict(requests.dtypes)
    return _run(requests, key, _Windows(limit, seconds, key, at, order), f"{key} {kinds[key]}, {at} timestamp, {order} {kinds[order]}, allowed boolean, retry_after bigint")


def first_attempt_limited(attempts: DataFrame, limit: int, seconds: int, *, key: str, at: str, order: str) -> DataFrame:
    """(key, at, order, allowed): `limit` attempts in the `seconds` that begin with a key's first one."""
    kinds = dict(attempts.dtypes)
    return _run(attempts, key, _FirstAttempt(limit, seconds, key, at, order), f"{key} {kinds[key]}, {at} timestamp, {order} {kinds[order]}, allowed boolean")


def paced(rows: DataFrame, seconds: int, *, host: str = "host", at: str = "at", seq: str = "seq") -> DataFrame:
    """(host, seq, fetch_at): the newest waiting row of each host, then the next one `seconds` later."""
    return _run(rows, host, _Host(seconds, host, at, seq), f"{host} string, {seq} bigint, fetch_at timestamp")


def answered(rows: DataFrame, seconds: int, *, host: str = "host", at: str = "at", answer: str = "robots", request: str = "request_id") -> DataFrame:
    """(host, request, answer): requests with the host's newest answer of the last `seconds`. rows: answers (request null) and requests."""
    return _run(rows, host, _Answers(seconds, host, at, answer, request), f"{host} string, {request} bigint, {answer} string")
