"""Stage times as they are measured: seconds and rows of every stage of a pass, and of every micro-batch of a stream."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from galewatch.functions.tables import stored

TIMINGS = "scan_key string, stage string, seconds double, rows long"


class Stages:
    """Stores tables one after the other and notes how long each took and how many rows it has.

    Rows are counted by an observation while the table is written, not by reading it again. `run` names the pass, as
    scan_key does for reports.stage_times.
    """

    def __init__(self, spark: SparkSession, run: str = "run"):
        self.spark, self.run, self.noted = spark, run, []

    def stored(self, df: DataFrame, stage: str) -> DataFrame:
        seen, began = Observation(f"{stage}-{uuid.uuid4().hex}"), time.perf_counter()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), stage)
        self.noted.append((self.run, stage, time.perf_counter() - began, int(seen.get["rows"])))
        return out

    def table(self) -> DataFrame:
        """TIMINGS of the stages so far, for reports.stage_times."""
        return self.spark.createDataFrame(self.noted, TIMINGS)


class BatchTimes(StreamingQueryListener):
    """TIMINGS of a session's streams: a row per micro-batch and step, with the rows that the batch read.

        times = BatchTimes(); spark.streams.addListener(times); ...; times.table(spark)
    """

    def __init__(self):
        self.noted: list[tuple[str, str, float, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = json.loads(event.progress.json)
        name = f"{told.get('name') or told['id']}-{told['batchId']}"
        self.noted += [(name, step, ms / 1000.0, int(told.get("numInputRows") or 0)) for step, ms in told["durationMs"].items() if step != "triggerExecution"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.noted, TIMINGS)
