"""Validity, as-of, sessions and rate limits over tables; lodestone.streaming has their streaming twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_inclusive(day: Column, start: Column, end: Column) -> Column:
    """start <= day <= end; an open or unreadable end holds. A null day is always valid."""
    return day.isNull() | (F.coalesce(day >= start, F.lit(True)) & F.coalesce(day <= end, F.lit(True)))


def valid_exclusive(day: Column, start: Column, end: Column) -> Column:
    """start <= day < end, with a known start; an open end holds."""
    return F.coalesce(day >= start, F.lit(False)) & F.coalesce(day < end, F.lit(True))


def as_of(rows: DataFrame, key: str, start: str, day: Column, tie: str) -> DataFrame:
    """The row of each key with the latest start up to day; of equals the one with the largest tie. One aggregate, no window."""
    return rows.filter(F.col(start) <= day).groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(start, tie)).alias("r")).select("r.*")


def sessions(events: DataFrame, key: str, at: str, ttl_seconds: int, tie: str) -> DataFrame:
    """Adds session (1, 2, ...): a new one starts when the key was idle for ttl_seconds or longer."""
    order = Window.partitionBy(key).orderBy(at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    new = F.when(gap.isNull() | (gap >= ttl_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def rate_limit(events: DataFrame, keys: list[str], at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """Adds allowed and retry_after: at most limit allowed events of a key in a window that slides over the last `seconds`.

    Denied events aren't recorded, and an event of exactly `seconds` ago no longer counts, so each answer depends on the
    answers before: a key's rows stream by in order, with a queue of at most limit times. A key may be split over batches.
    """
    names = [*keys, at, tie]
    dealt = events.select(*names).repartition(*(F.col(c) for c in keys)).sortWithinPartitions(*keys, at, tie)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, deque()
        for frame in frames:
            allowed, retry = [], []
            for row in frame.itertuples(index=False):
                key, now = tuple(row[: len(keys)]), row[len(keys)].value
                if key != last:
                    last, recent = key, deque()
                while recent and recent[0] <= now - seconds * 10**9:
                    recent.popleft()
                allowed.append(len(recent) < limit)
                if allowed[-1]:
                    recent.append(now)
                    retry.append(0)
                else:
                    retry.append(max(1, -(-(seconds * 10**9 - (now - recent[0])) // 10**9)))
            yield frame.assign(allowed=allowed, retry_after=retry)

    schema = events.select(*names).schema.add("allowed", "boolean").add("retry_after", "long")
    return dealt.mapInPandas(run, schema)
