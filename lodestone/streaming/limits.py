"""Streaming twins of the temporal operators: rate limits, session expiry and counters over event streams.

State is kept by key and bounded: a limiter holds at most `limit` times, a session three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND = 1_000_000


def rate_limit(events: DataFrame, keys: list[str], at: str, tie: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """keys, at, tie, allowed, retry_after: at most limit allowed events of a key in a window sliding over the last `seconds`.

    Denied events are not recorded; one of exactly `seconds` ago no longer counts. Within a micro-batch, events are taken
    in order of time; across batches in order of arrival. A key's state goes when the watermark, `late` behind, has passed
    its last event's window; later events than that are dropped.
    """
    names = [*keys, at, tie]
    schema = events.select(*names).schema.add("allowed", "boolean").add("retry_after", "long")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([at, tie])
        allowed, retry = [], []
        for moment in rows[at]:
            now = moment.value // 1000
            recent = [x for x in recent if x > now - seconds * SECOND]
            allowed.append(len(recent) < limit)
            retry.append(0 if allowed[-1] else max(1, -(-(seconds * SECOND - (now - recent[0])) // SECOND)))
            if allowed[-1]:
                recent.append(now)
        state.update((recent,))
        _expire(state, int(rows[at].max().value // 1_000_000) + seconds * 1000)
        yield rows[names].assign(allowed=allowed, retry_after=retry)

    return events.withWatermark(at, late).groupBy(*keys).applyInPandasWithState(step, schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _expire(state: GroupState, at_ms: int) -> None:
    """The state goes when event time has passed at_ms."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def sessions(events: DataFrame, key: str, at: str, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """key, session, n_events, last_at after each micro-batch: a session expires when its key was idle for ttl_seconds or longer.

    A key's state goes when the watermark, `late` behind, has passed its session's end; a later session of the key then is its first again.
    """
    schema = events.select(key).schema.add("session", "long").add("n_events", "long").add("last_at", "long")

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session, n, last = state.get if state.exists else (0, 0, 0)
        done = {}
        for moment in pd.concat(list(frames))[at].sort_values():
            now = moment.value // 1000
            if not session or now - last >= ttl_seconds * SECOND:
                session, n = session + 1, 0
            n, last = n + 1, max(last, now)
            done[session] = (n, last)
        state.update((session, n, last))
        _expire(state, last // 1000 + ttl_seconds * 1000)
        yield pd.DataFrame([(group[0], s, *v) for s, v in done.items()], columns=[key, "session", "n_events", "last_at"])

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, schema, "session long, n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, at: str, by: list[str], size: str, late: str) -> DataFrame:
    """Events by key in tumbling windows; a window is closed when the watermark, `late` behind, has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), "n")
