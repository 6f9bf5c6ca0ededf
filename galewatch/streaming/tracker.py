"""Association of candidates to tracks across scans: one rule, used over stored scans and over a stream.

A scan is one row with all its candidates, none included, so that tracks age. The rule is a small function of a site's
open tracks and one scan. In batch, scans are dealt by site, sorted by time and read as a stream of rows, so a task
holds open tracks only, however many scans a site has. In a stream the same state is kept per site in the state store.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galewatch.config import EngineConfig
from galewatch.schemas import OBSERVATION, UPDATES
from galewatch.streaming.matching import greedy

OUTPUT = UPDATES + f", created_at timestamp, confirmed_at timestamp, observations array<{OBSERVATION}>"
STATES = UPDATES + ", created_at timestamp, confirmed_at timestamp"
STATE = "tracks string, counter long, last_scan double, seen string"
TIME = pa.timestamp("us", tz="UTC")
#: Fields of an observation with their types in columns and in Arrow. Columns of numbers have NaN where there is none.
FIELDS = {
    "scan_time": (float, TIME), "cell_id": (object, pa.string()), "probability": (float, pa.float64()), "above_threshold": (bool, pa.bool_()), "x_km": (float, pa.float64()), "y_km": (float, pa.float64()), "activation_x_km": (float, pa.float64()),
    "activation_y_km": (float, pa.float64()), "quality_pass": (bool, pa.bool_()), "quality_reasons": (object, pa.list_(pa.string())), "missed": (bool, pa.bool_()),
}
#: What a track sees in a scan without a candidate for it.
MISS = {"cell_id": None, "probability": 0.0, "above_threshold": False, "x_km": math.nan, "y_km": math.nan, "activation_x_km": math.nan, "activation_y_km": math.nan, "quality_pass": False, "quality_reasons": (), "missed": True}
#: Fields of a candidate, and those of them that are numbers.
CANDIDATE_FIELDS = ("cand_idx", "cell_id", "probability", "threshold", "az_deg", "range_km", "activation_az_deg", "activation_range_km", "quality_pass", "reasons")
NUMBERS = ("probability", "threshold", "az_deg", "range_km", "activation_az_deg", "activation_range_km")
#: Updates that go to Spark at once.
BATCH = 10_000


def objects(values: Iterable) -> np.ndarray:
    values = list(values)
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def places(az: np.ndarray, km: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y, NaN where either is missing. Sine and cosine are those of the C library, as in SQL."""
    known = ~(np.isnan(az) | np.isnan(km))
    x, y = np.full(len(az), np.nan), np.full(len(az), np.nan)
    turns = [math.radians(a) for a in az[known].tolist()]
    x[known] = km[known] * np.array([math.sin(a) for a in turns])
    y[known] = km[known] * np.array([math.cos(a) for a in turns])
    return x, y


def observed(c: dict[str, np.ndarray], at: float) -> dict[str, np.ndarray]:
    """A scan's candidates, columns of CANDIDATE_FIELDS, as observations."""
    x, y = places(c["az_deg"], c["range_km"])
    ax, ay = places(c["activation_az_deg"], c["activation_range_km"])
    n = len(x)
    return {
        "scan_time": np.full(n, at), "cell_id": c["cell_id"], "probability": c["probability"], "above_threshold": c["probability"] >= c["threshold"], "x_km": x, "y_km": y, "activation_x_km": ax, "activation_y_km": ay,
        "quality_pass": np.array([True if q is None else bool(q) for q in c["quality_pass"]], dtype=bool), "quality_reasons": objects(() if r is None else tuple(r) for r in c["reasons"]), "missed": np.zeros(n, dtype=bool),
    }


class OpenTracks:
    """A site's open tracks in columns: a row per track, with its last observations from the right. All in `observations`
    that is left of a track's own `n` is void, with False for flags."""

    def __init__(self, config: EngineConfig, tracks: list[dict] = (), counter: int = 0):
        self.config, self.counter, wide = config, counter, config.track_history
        self.ids = objects(t["track_id"] for t in tracks)
        self.created = np.array([t["created_at"] for t in tracks], dtype=float)
        self.confirmed = np.array([t["confirmed_at"] for t in tracks], dtype=float)  # None becomes NaN
        self.n = np.array([min(len(t["observations"]), wide) for t in tracks], dtype=np.int64)
        self.observations = {f: np.full((len(tracks), wide), None if kind is object else kind(0), dtype=kind) for f, (kind, _) in FIELDS.items()}
        at = [(i, wide - len(own) + j, o) for i, t in enumerate(tracks) for own in [t["observations"][-wide:]] for j, o in enumerate(own)]
        if at:
            rows, columns = [i for i, _, _ in at], [j for _, j, _ in at]
            for f, (kind, _) in FIELDS.items():
                told = (o[f] for _, _, o in at)
                self.observations[f][rows, columns] = objects(tuple(x or ()) if f == "quality_reasons" else x for x in told) if kind is object else np.array(list(told), dtype=kind)

    def told(self) -> list[dict]:
        """The tracks as dictionaries, as they go into a state store and come from there."""
        none = lambda x: None if x != x else x
        columns = [self.observations[f].tolist() for f in FIELDS]
        numbers = {f for f, (kind, _) in FIELDS.items() if kind is float}
        shape = {f: none if f in numbers else list if f == "quality_reasons" else (lambda x: x) for f in FIELDS}
        seen = lambda i, j: {f: shape[f](c[i][j]) for f, c in zip(FIELDS, columns)}
        wide = self.config.track_history
        return [
            {"track_id": name, "created_at": created, "confirmed_at": none(confirmed), "observations": [seen(i, j) for j in range(wide - n, wide)]}
            for i, (name, created, confirmed, n) in enumerate(zip(self.ids.tolist(), self.created.tolist(), self.confirmed.tolist(), self.n.tolist()))
        ]

    def _filled(self) -> np.ndarray:
        wide = self.config.track_history
        return np.arange(wide) >= wide - self.n[:, None]

    def _leads(self, at: float) -> dict[str, np.ndarray]:
        """Where each track leads by then, how far it reaches, and its last peak; NaN for one without a place."""
        o, rows = self.observations, np.arange(len(self.n))
        real = self._filled() & ~o["missed"]
        own, lit = real & ~np.isnan(o["x_km"]), real & ~np.isnan(o["activation_x_km"])
        final = lambda flags: flags.shape[1] - 1 - np.argmax(flags[:, ::-1], axis=1)
        last, peak = final(real), final(lit)
        usable = own[rows, last]
        earlier = own.copy()
        earlier[rows, last] = False
        before = final(earlier)
        x, y, tm = o["x_km"][rows, last], o["y_km"][rows, last], o["scan_time"][rows, last]
        ahead, past = (at - tm) / 3600.0, (tm - o["scan_time"][rows, before]) / 3600.0
        go = usable & earlier.any(axis=1) & (ahead > 0) & (past > 0)
        past = np.where(go, past, 1.0)
        lead = lambda a, f: np.where(usable, np.where(go, a + (a - o[f][rows, before]) / past * ahead, a), np.nan)
        has = lit.any(axis=1)
        return {
            "x": lead(x, "x_km"), "y": lead(y, "y_km"), "reach": self.config.track_match_base_km + self.config.track_max_speed_kmh * np.maximum(0.0, ahead),
            "ax": np.where(has, o["activation_x_km"][rows, peak], np.nan), "ay": np.where(has, o["activation_y_km"][rows, peak], np.nan),
        }

    def feed(self, site: str, at: float, candidates: dict[str, np.ndarray], history: bool = True) -> dict:
        """One scan: changes the tracks and returns columns of an update per candidate, in their order.

        Pairs are taken by least cost, each candidate and track once. Tracks without a candidate get a miss. Candidates
        over the threshold that matched nothing start tracks; those below don't. Tracks with too many misses end.
        """
        config, wide, old = self.config, self.config.track_history, len(self.n)
        seen = observed(candidates, at)
        places_ = {k: seen[f] for k, f in (("x", "x_km"), ("y", "y_km"), ("ax", "activation_x_km"), ("ay", "activation_y_km"))}
        whose = greedy(places_, self._leads(at), config.track_activation_match_km, config.track_activation_weight)
        fresh = np.flatnonzero(seen["above_threshold"] & (whose < 0))
        met = np.flatnonzero(whose >= 0)
        whose[fresh] = old + np.arange(len(fresh))
        stamp = datetime.fromtimestamp(at, timezone.utc).strftime("%Y%m%d%H%M%S")
        self.ids = np.concatenate([self.ids, objects(f"{site}-{stamp}-T{self.counter + k:04d}" for k in range(1, len(fresh) + 1))])
        self.counter += len(fresh)
        self.created = np.concatenate([self.created, np.full(len(fresh), at)])
        self.confirmed = np.concatenate([self.confirmed, np.full(len(fresh), np.nan)])
        self.n = np.minimum(np.concatenate([self.n, np.zeros(len(fresh), dtype=np.int64)]) + 1, wide)
        for f, (kind, _) in FIELDS.items():
            before = self.observations[f]
            now = np.full((old + len(fresh), wide), None if kind is object else kind(0), dtype=kind)
            now[:old, :-1] = before[:, 1:]
            if f == "scan_time":
                now[:, -1] = at
            else:
                now[:old, -1] = objects([MISS[f]] * old) if kind is object else MISS[f]
                now[whose[met], -1], now[old:, -1] = seen[f][met], seen[f][fresh]
            self.observations[f] = now
        window = min(config.track_confirm_window_scans, wide)
        hits = self.observations["above_threshold"][:, wide - window :].sum(axis=1)
        updated = np.zeros(len(self.n), dtype=bool)
        updated[whose[whose >= 0]] = True
        new = updated & np.isnan(self.confirmed) & (hits >= config.track_confirm_scans)
        self.confirmed[new] = at
        k, own = np.maximum(whose, 0), whose >= 0
        take = lambda column, other: np.where(own, column[k], other) if len(column) else np.full(len(whose), other)
        said = np.where(take(new, False), "newly_confirmed", np.where(take(~np.isnan(self.confirmed), False), "confirmed", np.where(seen["above_threshold"], "pending", "tracked_below_threshold")))
        out = {
            "site": objects([site] * len(whose)), "scan_time": seen["scan_time"], "cand_idx": candidates["cand_idx"], "cell_id": seen["cell_id"], "track_id": take(self.ids, None), "status": np.where(own, said, "below_threshold").astype(object),
            "hits_in_window": take(hits, 0), "window_size": take(np.minimum(self.n, window), 0), "newly_confirmed": take(new, False), "created_at": take(self.created, np.nan), "confirmed_at": take(self.confirmed, np.nan),
        }
        if history:
            filled = self._filled()[whose[own]]
            out["sizes"] = np.where(own, self.n[k] if len(self.n) else 0, -1)
            out |= {f"_{f}": c[whose[own]][filled] for f, c in self.observations.items()}
        missed = self._filled() & self.observations["missed"]
        misses = np.where(missed.all(axis=1), wide, np.argmax(~missed[:, ::-1], axis=1))
        kept = misses <= config.track_max_missed_scans
        self.ids, self.created, self.confirmed, self.n = (c[kept] for c in (self.ids, self.created, self.confirmed, self.n))
        self.observations = {f: c[kept] for f, c in self.observations.items()}
        return out


def _times(seconds: np.ndarray) -> pa.Array:
    gone = np.isnan(seconds)
    return pa.array(np.rint(np.where(gone, 0.0, seconds) * 1e6).astype("int64"), mask=gone).cast(TIME)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if kind == TIME:
        return _times(values)
    return pa.array(values, kind, from_pandas=values.dtype == float)


def _table(updates: list[dict], history: bool) -> pa.RecordBatch:
    """Columns of one scan or more as rows of OUTPUT, or of STATES without the history."""
    kinds = {"site": pa.string(), "scan_time": TIME, "cand_idx": pa.int32(), "cell_id": pa.string(), "track_id": pa.string(), "status": pa.string(), "hits_in_window": pa.int32(), "window_size": pa.int32(), "newly_confirmed": pa.bool_(), "created_at": TIME, "confirmed_at": TIME}
    whole = lambda f, kind: np.concatenate([u[f] for u in updates]) if updates else np.empty(0, dtype=kind)
    columns = {f: _column(whole(f, float if kind == TIME else object), kind) for f, kind in kinds.items()}
    if history:
        sizes = whole("sizes", np.int64)
        ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        offsets = pa.array(ends, pa.int32(), mask=np.concatenate([sizes < 0, [False]]))
        items = pa.StructArray.from_arrays([_column(whole(f"_{f}", kind), told) for f, (kind, told) in FIELDS.items()], names=list(FIELDS))
        columns["observations"] = pa.ListArray.from_arrays(offsets, items)
    return pa.RecordBatch.from_pydict(columns)


def _numbers(values: Iterable) -> np.ndarray:
    return np.array([math.nan if x is None else x for x in values], dtype=float)


def advance(state: dict, site: str, at: float, candidates: list[dict], config: EngineConfig) -> list[dict]:
    """One scan of dictionaries: changes state {"tracks": [...], "counter": n} by the rule of OpenTracks.feed, and returns
    an update per candidate, in their order, without the track's history."""
    tracks = OpenTracks(config, state["tracks"], state["counter"])
    columns = {f: _numbers(c[f] for c in candidates) if f in NUMBERS else objects(c[f] for c in candidates) for f in CANDIDATE_FIELDS}
    out = tracks.feed(site, at, columns, history=False)
    state["tracks"], state["counter"] = tracks.told(), tracks.counter
    return [{f: None if x != x else x for f, x in zip(out, row)} for row in zip(*(c.tolist() for c in out.values()))]


def _moment(micros: int) -> float:
    return micros * 1000 / 1e9


def _restored(saved: str, config: EngineConfig) -> OpenTracks:
    """A site's row of SAVED as JSON -> its open tracks."""
    told = json.loads(saved)

    def at(x) -> float | None:
        return None if x is None else _moment(pd.Timestamp(x).tz_convert(None).value // 1000 if pd.Timestamp(x).tz else pd.Timestamp(x).value // 1000)

    for t in told["tracks"]:
        t |= {"created_at": at(t["created_at"]), "confirmed_at": at(t.get("confirmed_at"))}
        t["observations"] = [{k: o.get(k) for k in FIELDS} | {"scan_time": at(o["scan_time"])} for o in t["observations"]]
    return OpenTracks(config, told["tracks"], told["counter"])


def replay(scans: DataFrame, config: EngineConfig | None = None, newest_first: bool = False, start: DataFrame | None = None, history: bool = True) -> DataFrame:
    """SCANS -> OUTPUT: an update per candidate, with the track's history after it; without history, STATES.

    Sites are dealt over tasks; a site's scans follow one another by nature. newest_first: the order of live polling,
    which walks back from the newest scan. start: SAVED, the tracks that are open before the first scan. A task is sent a
    row per candidate, so that a batch is small however many a scan has.
    """
    config = config or EngineConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, tracks, at, parts, out = None, None, None, [], []

        def ended() -> None:
            if at is not None:
                whole = pa.Table.from_batches(parts)
                out.append(tracks.feed(site, at, _arrow_columns(whole), history))

        for batch in batches:
            step, saved = batch.column("step").to_numpy(zero_copy_only=False), batch.column("saved")
            # Where a scan or a saved state begins: its first candidate, or a row without any.
            heads = np.flatnonzero(~(step > 0)).tolist()
            if not heads or heads[0] > 0:
                parts.append(batch.slice(0, heads[0] if heads else None))
            for a, b in zip(heads, [*heads[1:], batch.num_rows]):
                ended()
                parts, at, own = [], None, batch.column("site")[a].as_py()
                if own != site:
                    site, tracks = own, OpenTracks(config)
                if saved[a].is_valid:
                    tracks = _restored(saved[a].as_py(), config)
                    continue
                at = _moment(batch.column("at")[a].as_py())
                parts.append(batch.slice(a, b - a if step[a] == 0 else 0))
            if sum(len(u["site"]) for u in out) >= BATCH:
                yield _table(out, history)
                out.clear()
        ended()
        yield _table(out, history)

    order = F.desc("scan_time") if newest_first else F.asc("scan_time")
    rows = scans.select("site", "scan_time", "candidates", F.lit(None).cast("string").alias("saved"))
    if start is not None:
        rows = rows.unionByName(start.select("site", F.to_json(F.struct("counter", "tracks")).alias("saved")), allowMissingColumns=True)
    rows = rows.repartition("site").sortWithinPartitions("site", F.col("saved").isNull(), order)
    rows = rows.select("site", F.unix_micros("scan_time").alias("at"), "saved", F.posexplode_outer("candidates").alias("step", "c"))
    return rows.select("site", "at", "saved", "step", *[F.col("c")[f].alias(f) for f in CANDIDATE_FIELDS]).mapInArrow(run, OUTPUT if history else STATES)


def _arrow_columns(rows: pa.Table) -> dict[str, np.ndarray]:
    told = lambda f: rows.column(f).cast(pa.float64()).to_numpy() if f in NUMBERS else objects(rows.column(f).to_pylist())
    return {f: told(f) for f in CANDIDATE_FIELDS}


def stream(scans: DataFrame, config: EngineConfig | None = None, drop_late: bool = False, expire: bool = False, history: bool = True) -> DataFrame:
    """The same over a stream of SCANS, with a site's open tracks in the state store.

    expire: sites without a scan for the retention time lose their state. That is for streams that run on: with a
    trigger that ends, timeouts by the clock would ask for another batch for ever.

    Scans of one micro-batch are taken in the order of their time. A scan older than the last one seen is applied as it
    comes, or left out with drop_late. A scan that the site had already is left out, so one that is delivered twice
    confirms nothing: the times of scans are remembered for the retention time of processed keys before the last one.
    """
    config = config or EngineConfig()

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        tracks, last, seen = OpenTracks(config), float("-inf"), set()
        if held.exists:
            text, counter, last, times = held.get
            tracks, seen = OpenTracks(config, json.loads(text), counter), set(json.loads(times))
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for row in rows.itertuples():
            at = _moment(row.at)
            if at in seen or (drop_late and at < last):
                continue
            seen.add(at)
            own = lambda f: [] if getattr(row, f) is None else getattr(row, f)  # noqa: B023, E731
            out.append(tracks.feed(key[0], at, {f: _numbers(own(f)) if f in NUMBERS else objects(own(f)) for f in CANDIDATE_FIELDS}, history))
            last = max(last, at)
            if sum(len(u["site"]) for u in out) >= BATCH:
                yield _table(out, history).to_pandas()
                out = []
        kept = sorted(t for t in seen if t >= last - config.processed_ttl_seconds)
        held.update((json.dumps(tracks.told()), tracks.counter, last, json.dumps(kept)))
        if expire:
            held.setTimeoutDuration(config.track_ttl_seconds * 1000)
        yield _table(out, history).to_pandas()

    # A scan's candidates go as a column for each field: arrays of numbers need no object for each candidate.
    rows = scans.select("site", F.unix_micros("scan_time").alias("at"), *[F.col("candidates")[f].alias(f) for f in CANDIDATE_FIELDS])
    return rows.groupBy("site").applyInPandasWithState(run, OUTPUT if history else STATES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


SAVED = f"site string, counter long, last_scan timestamp, tracks array<struct<track_id:string,created_at:timestamp,confirmed_at:timestamp,observations:array<{OBSERVATION}>>>"


def saved_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """SAVED: each site's open tracks and counter as the tracker's stream left them in its checkpoint.

    They are read out of the state store itself, so a table of open tracks needs no log of updates; replay takes them as
    its start.
    """
    held = spark.read.format("statestore").load(checkpoint).select("key.site", "value.groupState.*")
    plain = SAVED[SAVED.index("tracks ") + 7 :].replace("timestamp", "double")  # moments are seconds in the state
    rows = held.select("site", "counter", F.timestamp_micros((F.col("last_scan") * 1e6).cast("long")).alias("last_scan"), F.from_json("tracks", plain).alias("tracks"))
    at = lambda x: F.timestamp_micros(F.round(x * 1e6).cast("long"))
    seen = lambda o: o.withField("scan_time", at(o["scan_time"]))
    told = lambda t: F.struct(t["track_id"].alias("track_id"), at(t["created_at"]).alias("created_at"), at(t["confirmed_at"]).alias("confirmed_at"), F.transform(t["observations"], seen).alias("observations"))
    return rows.withColumn("tracks", F.transform("tracks", told))


def open_tracks(saved: DataFrame) -> DataFrame:
    """SAVED -> TRACKS: a row per open track, misses included."""
    return saved.select("site", F.explode("tracks").alias("t")).select("t.track_id", "site", "t.created_at", "t.confirmed_at", "t.observations")


def tracks_of(updates: DataFrame) -> DataFrame:
    """Each track as of its last candidate: misses that follow it aren't in."""
    last = F.max_by(F.struct("created_at", "confirmed_at", "observations"), F.struct("scan_time", "cand_idx"))
    rows = updates.where(F.col("track_id").isNotNull()).groupBy("track_id", "site").agg(last.alias("t"))
    return rows.select("track_id", "site", "t.*")


def attach_updates(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Cells with their tracking update, where they have one."""
    return cells.join(updates.select("cell_id", "track_id", "status", "hits_in_window", "window_size", "newly_confirmed", "confirmed_at"), "cell_id", "left")


def scans_of(cells: DataFrame, scans: DataFrame) -> DataFrame:
    """Scored cells and all scans (site, scan_key, scan_time) -> SCANS, scans without cells included."""
    fields = ("cand_idx", "cell_id", "probability", "threshold", "az_deg", "range_km", "activation_az_deg", "activation_range_km", "quality_pass", "reasons")
    own = cells.groupBy("site", "scan_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    joined = scans.join(own, ["site", "scan_key"], "left")
    return joined.select("site", "scan_time", F.coalesce("candidates", F.array().cast(own.schema["candidates"].dataType)).alias("candidates"))
