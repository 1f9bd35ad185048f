"""Bounded state over streams with keyed list and map state and timers: rings of last values, collections with the oldest leaving.

State is kept by Spark's state store with a row for each element (needs the RocksDB provider, see `use_state_store`), so
a key's state is never read or written whole. Rows of a micro-batch are taken in order of time, batches in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Values of a ring, items of a collection, and collections that are kept.
RING, ITEMS, KEYS = 500, 20, 100


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(frames: Iterator[pd.DataFrame], at: str, tie: str) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values([at, tie], kind="stable")


class _Ring(StatefulProcessor):
    """A map from place (running number modulo the ring) to value, and how many values there were."""

    def __init__(self, at: str, tie: str, value: str, ring: int, percent: int, idle_ms: int | None):
        self.at, self.tie, self.value, self.ring, self.percent, self.idle_ms = at, tie, value, ring, percent, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "place int", "value double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for x in _sorted(rows, self.at, self.tie)[self.value]:
            self.values.updateValue((int(n % self.ring),), (float(x),))
            n += 1
        self.seen.update((int(n),))
        held = sorted(v[0] for v in self.values.values())
        rank = max(1, -(-self.percent * len(held) // 100))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"key": [str(key[0])], "n_events": [int(n)], "n_ring": [len(held)], "percentile": [held[rank - 1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.seen.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "n_events": pd.Series([], dtype="int64"), "n_ring": pd.Series([], dtype="int64"), "percentile": pd.Series([], dtype=float)})

    def close(self) -> None:
        pass


def last_values(events: DataFrame, key: str, at: str, tie: str, value: str, ring: int = RING, percent: int = 95, idle_ms: int | None = None) -> DataFrame:
    """key, n_events, n_ring, percentile after each micro-batch: the nearest-rank percentile of a key's last `ring` values.

    With idle_ms, a key's state goes when it had no row for so long (by the clock).
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    step = _Ring("at", "tie", "value", ring, percent, idle_ms)
    return rows.groupBy("key").transformWithStateInPandas(step, "key string, n_events long, n_ring long, percentile double", "Update", "ProcessingTime" if idle_ms is not None else "None")


CHANGES = "key string, item string, at long, change string"


class _Collection(StatefulProcessor):
    """A map from item to its time."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = {k[0]: v[0] for k, v in self.items.iterator()}  # `most` at most
        for item, at in _sorted(rows, "at", "item")[["item", "at"]].itertuples(index=False):
            out.append((item, int(at), "replaced" if item in held else "added"))
            held[item] = max(int(at), held.get(item, int(at)))
            self.items.updateValue((item,), (held[item],))
            if len(held) > self.most:
                oldest = min(held, key=lambda x: (held[x], x))
                out.append((oldest, held.pop(oldest), "evicted"))
                self.items.removeKey((oldest,))
        yield pd.DataFrame(out, columns=["item", "at", "change"]).assign(key=str(key[0]))[["key", "item", "at", "change"]]

    def close(self) -> None:
        pass


def collections(rows: DataFrame, key: str, item: str, at: str, items: int = ITEMS) -> DataFrame:
    """key, item, at, change (added, replaced, evicted): collections of at most `items` items; one that comes again takes its new time, and the oldest leaves. Times are microseconds."""
    own = rows.select(F.col(key).cast("string").alias("key"), F.col(item).cast("string").alias("item"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).filter("item is not null and at is not null")
    return own.groupBy("key").transformWithStateInPandas(_Collection(items), CHANGES, "Append", "None")


def evicted_keys(changes: DataFrame, keys: int = KEYS) -> DataFrame:
    """key, at of collections that leave as more than `keys` are there, the one that was touched longest ago first.

    A second stage over collections(): its one state has `keys` rows, and of a micro-batch it gets a row for each key that changed.
    What reads both drops the collections that are named here and were not touched since.
    """
    touched = changes.filter("change <> 'evicted'").select(F.lit("all").alias("key"), F.col("key").alias("item"), "at")
    left = touched.groupBy("key").transformWithStateInPandas(_Collection(keys), CHANGES, "Append", "None")
    return left.filter("change = 'evicted'").select(F.col("item").alias("key"), "at")
