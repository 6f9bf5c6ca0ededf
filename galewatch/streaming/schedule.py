"""Adaptive polling: how soon a site is due again, from the outcomes of its attempts so far."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galewatch.config import EngineConfig
from galewatch.schemas import ATTEMPTS, SCHEDULE
from galewatch.streaming.stores import in_order, micros, moment, timer_at

COUNTERS = ("activity_score", "consecutive_quiet", "consecutive_no_new", "consecutive_errors")
COLUMNS = [c.split()[0] for c in SCHEDULE.split(", ")]


def next_counters(counters: tuple[int, int, int, int], status: str, cells: int, chips: int, raw: int, detections: int) -> tuple[int, int, int, int]:
    score, quiet, waiting, errors = counters
    if status == "error":
        return score, quiet, waiting, errors + 1
    if status == "processed" and (detections > 0 or raw > 0):
        return 3, 0, 0, 0
    if status == "processed" and (chips > 0 or cells > 0):
        return 2, 0, 0, 0
    if status == "no_new_scan":
        return (max(0, score - 1), quiet, 0, 0) if waiting >= 2 else (score, quiet, waiting + 1, 0)
    return 0, quiet + 1, 0, 0


def decided(status: Column, score: Column, quiet: Column, errors: Column, config: EngineConfig) -> Column:
    """struct<delay_seconds, priority, reason> for the state after an attempt."""

    def told(delay, priority: int, reason: str) -> Column:
        return F.struct((F.lit(delay) if isinstance(delay, int) else delay).cast("int").alias("delay_seconds"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"))

    back = F.least(F.lit(config.error_backoff_seconds) * F.pow(F.lit(2.0), F.greatest(errors - 1, F.lit(0))), F.lit(float(config.max_error_backoff_seconds)))
    slow = F.least(F.floor(F.lit(config.quiet_poll_seconds) * F.pow(F.lit(config.quiet_multiplier), F.greatest(quiet - 1, F.lit(0)))), F.lit(config.max_quiet_poll_seconds))
    return (
        F.when(status == "error", told(back, 30, "error_backoff"))
        .when(status == "no_scans", told(config.no_scan_poll_seconds, 25, "no_scans_backoff"))
        .when(score >= 3, told(config.hot_poll_seconds, 0, "hot_detection_candidate"))
        .when(score >= 2, told(config.active_poll_seconds, 5, "active_cells"))
        .when(status == "no_new_scan", told(config.quiet_poll_seconds, 15, "waiting_for_new_scan"))
        .otherwise(told(slow, 20, "quiet_backoff"))
    )


def _folded(rows: Iterator, counters: tuple[int, int, int, int]) -> tuple[list[tuple], tuple[int, int, int, int]]:
    out = []
    for r in rows:
        n = [0 if pd.isna(x) else int(x) for x in (r.cells_found, r.chips_processed, r.raw_detections, r.detections)]
        counters = next_counters(counters, r.status, *n)
        out.append((r.site, r.seq, r.status, *counters))
    return out, counters


STATES = "site string, seq long, status string, activity_score int, consecutive_quiet int, consecutive_no_new int, consecutive_errors int"


def _decide(states: DataFrame, config: EngineConfig) -> DataFrame:
    choice = decided(F.col("status"), F.col("activity_score"), F.col("consecutive_quiet"), F.col("consecutive_errors"), config)
    return states.withColumn("_d", choice).select(*[c for c in COLUMNS if c not in ("delay_seconds", "priority", "reason")], "_d.*")


def schedule(attempts: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """ATTEMPTS -> SCHEDULE, a row per attempt. A task reads sites one after the other and holds four counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, counters = None, (0, 0, 0, 0)
        for batch in batches:
            out: list[tuple] = []
            for own, rows in batch.groupby("site", sort=False):
                if own != site:
                    site, counters = own, (0, 0, 0, 0)
                told, counters = _folded(rows.itertuples(), counters)
                out += told
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    rows = attempts.repartition("site").sortWithinPartitions("site", "seq").mapInPandas(run, STATES)
    return _decide(rows, config or EngineConfig())


def continued(states: DataFrame, attempts: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Last rows of SCHEDULE per site, and ATTEMPTS -> SCHEDULE for the attempts that come after them.

    The held counters stand before a site's attempts, so a round costs as many rows as it has sites and attempts,
    however many attempts there ever were. Attempts up to the held one are in its counters and are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, counters, last = None, (0, 0, 0, 0), None
        for batch in batches:
            out: list[tuple] = []
            for own, rows in batch.groupby("site", sort=False):
                if own != site:
                    site, counters, last = own, (0, 0, 0, 0), None
                known, new = rows[rows["held"]], rows[~rows["held"]]
                if len(known):
                    last, counters = int(known["seq"].iloc[0]), tuple(int(x) for x in known[list(COUNTERS)].iloc[0])
                told, counters = _folded((new if last is None else new[new["seq"] > last]).itertuples(), counters)
                out += told
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    counts = [c.split()[0] for c in ATTEMPTS.split(", ")[3:]]
    known = states.select("site", "seq", "status", *COUNTERS, F.lit(True).alias("held"))
    rows = known.unionByName(attempts.select("site", "seq", "status", *counts, F.lit(False).alias("held")), allowMissingColumns=True)
    return _decide(rows.repartition("site").sortWithinPartitions("site", F.desc("held"), "seq").mapInPandas(run, STATES), config or EngineConfig())


#: Rows that a stream hands on at once.
BATCH = 10_000


def stream(attempts: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """The same over a stream of attempts, counters in the state store.

    A site's attempts of one micro-batch come in any order, so they are held until all are there: ten bytes each, that is
    seq, a number for the status, and whether there were cells and hits.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        numbers: dict = {}  # of statuses, as they are met
        seqs, kinds, found = [], [], []
        for batch in batches:
            codes, names = pd.factorize(batch["status"], use_na_sentinel=False)
            own = np.array([numbers.setdefault(None if pd.isna(x) else x, len(numbers)) for x in names], dtype=np.int64)
            seqs.append(batch["seq"].to_numpy())
            kinds.append(own[codes].astype(np.uint8 if len(numbers) < 256 else np.int64))
            any_of = lambda *columns: (batch[list(columns)].fillna(0).astype("int64") > 0).any(axis=1).to_numpy()  # noqa: B023, E731
            found.append(any_of("cells_found", "chips_processed") + 2 * any_of("raw_detections", "detections").astype(np.uint8))
        seq, kind, hits = (np.concatenate(x) for x in (seqs, kinds, found))
        del seqs, kinds, found
        order, names = np.argsort(seq, kind="stable"), list(numbers)
        counters = held.get if held.exists else (0, 0, 0, 0)
        for first in range(0, len(order), BATCH):
            out, rows = [], order[first : first + BATCH]
            for n, k, h in zip(seq[rows].tolist(), kind[rows].tolist(), hits[rows].tolist()):
                counters = next_counters(counters, names[k], h & 1, 0, h & 2, 0)
                out.append((key[0], n, names[k], *counters))
            if first + BATCH >= len(order):
                held.update(counters)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    kinds = ", ".join(f"{c} int" for c in COUNTERS)
    return _decide(attempts.groupBy("site").applyInPandasWithState(run, STATES, kinds, "append", GroupStateTimeout.NoTimeout), config or EngineConfig())


def site_states(scheduled: DataFrame) -> DataFrame:
    """Each site's last row of SCHEDULE."""
    return scheduled.groupBy("site").agg(F.max_by(F.struct(*[c for c in COLUMNS if c != "site"]), "seq").alias("s")).select("site", "s.*")


def due_queue(states: DataFrame, sites: DataFrame, now: Column) -> DataFrame:
    """All sites (site) in the order in which they are due: those never tried at once, then by due time, priority, name.

    `finished_at` of states is when a site's last attempt ended.
    """
    rows = sites.select("site").join(states.select("site", "finished_at", "delay_seconds", "priority"), "site", "left")
    due = F.coalesce(F.timestamp_add("SECOND", F.col("delay_seconds"), F.col("finished_at")), now)
    return rows.select("site", due.alias("due_at"), F.coalesce("priority", F.lit(10)).alias("priority")).withColumn("due", F.col("due_at") <= now).orderBy("due_at", "priority", "site")


class DueTimers(StatefulProcessor):
    """For each site, when it is due and how urgently. Its timer tells; an attempt before that puts it off."""

    def init(self, handle) -> None:
        self.handle, self.next = handle, handle.getValueState("next", "due long, priority int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = (self.next.get() if self.next.exists() else None), []
        for row in in_order(rows, "finished_at", "seq").itertuples():
            at = micros(row.finished_at)
            if held is not None and held[0] <= at:  # it was due before this attempt, whatever the micro-batches
                out.append((key[0], moment(held[0]), held[1]))
            held = (at + int(row.delay_seconds) * 1_000_000, int(row.priority))
        self.next.update(held)
        timer_at(self.handle, held[0])
        yield pd.DataFrame(out, columns=["site", "due_at", "priority"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, priority = self.next.get()
        self.next.clear()
        yield pd.DataFrame([(key[0], moment(due), priority)], columns=["site", "due_at", "priority"])

    def close(self) -> None:
        pass


def due_sites(scheduled: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """A stream of SCHEDULE with finished_at -> site, due_at, priority: a row whenever a site becomes due.

    A site is due its delay after its last attempt; a further attempt before that counts instead. Nothing is polled: a
    timer per site fires as the watermark of attempts passes it. State is in RocksDB (stores.rocksdb).
    """
    rows = scheduled.select("site", "seq", "finished_at", "delay_seconds", "priority").withWatermark("finished_at", lateness)
    return rows.groupBy("site").transformWithStateInPandas(DueTimers(), "site string, due_at timestamp, priority int", "append", "EventTime")
