"""Scans that were processed before are left out, in batch and in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from galewatch.config import EngineConfig
from galewatch.streaming.stores import in_order, micros, timer_at


def unprocessed(scans: DataFrame, processed: DataFrame, key: str = "key") -> DataFrame:
    """The scans whose key isn't in processed; of repeated keys one row stays."""
    return scans.dropDuplicates([key]).join(processed.select(key).distinct(), key, "left_anti").select(*scans.columns)


def first_seen(scans: DataFrame, time: str, key: str = "key", config: EngineConfig | None = None) -> DataFrame:
    """Each key once, remembered for the retention time behind the watermark (column `time` is a timestamp).

    The retention counts from a key's first sighting; sliding_first_seen counts from its last.
    """
    config = config or EngineConfig()
    return scans.withWatermark(time, f"{config.processed_ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])


class Sightings(StatefulProcessor):
    """For each key, when it was last seen. A timer forgets it after the retention time; every sighting puts it off."""

    def __init__(self, retention_us: int):
        self.retention = retention_us

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for row in in_order(rows, "time").itertuples():
            at = micros(row.time)
            if last is None or at - last > self.retention:
                out.append((key[0], row.time))
            last = at if last is None else max(last, at)
        self.last.update((last,))
        timer_at(self.handle, last + self.retention + 1)
        yield pd.DataFrame(out, columns=["key", "time"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["key", "time"])

    def close(self) -> None:
        pass


def sliding_first_seen(sightings: DataFrame, lateness: str = "0 seconds", config: EngineConfig | None = None) -> DataFrame:
    """A stream of key, time -> key, time of the sightings that are new: no sighting of the key in the retention time
    before. Every sighting, new or not, keeps the key for that time again.

    What is kept is a number per key that was seen within the retention time, in RocksDB (stores.rocksdb has to hold
    when the stream starts). Sightings later than `lateness` are dropped; a null key is a key; several sightings of one
    moment are one.
    """
    config = config or EngineConfig()
    rows = sightings.select("key", "time").withWatermark("time", lateness)
    return rows.groupBy("key").transformWithStateInPandas(Sightings(config.processed_ttl_seconds * 1_000_000), "key string, time timestamp", "append", "EventTime")
