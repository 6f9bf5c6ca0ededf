"""What operators with timers and named state need of the session, and state read back out of a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, on executors' disks and in the checkpoint, not on the heap.

    A query keeps its provider for good: the session's setting is put back, so other queries keep theirs.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def in_order(batches: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, by time."""
    return pd.concat(list(batches), ignore_index=True).sort_values(list(columns), kind="stable")


def timer_at(handle, us: int) -> None:
    """The key's only timer: at us microseconds or just after, as timers count in milliseconds."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(-(-us // 1000))
