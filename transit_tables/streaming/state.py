"""Buses and positions with keyed state that expires, on the RocksDB store.

``matched_buses`` and ``pinned_positions`` give the rows of ``live.match_predictions`` and
``live.cached_positions`` and differ in how state is kept: an entry for each bus or vehicle, so a refresh
writes the entries that changed; entries of buses end by their time to live, and a timer ends a
pinned service that falls silent, whose vehicles are then given as gone. Call ``use_rocksdb`` before a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .live import FIELDS, OUT, same_bus

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUS = "place int, duration_ms long, feature string, type string, visit_number int, origin_code string, destination_code string"
POSITION = "feed_id string, no string, vehicle_id string, lat double, lng double, gone boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that start after this keep their state in RocksDB, which map state, timers and times to live need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _plain(value):
    """A field as the state's types want it."""
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


class Buses(StatefulProcessor):
    """The buses of one stop and service by id, as the last snapshot had them."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buses = handle.getMapState("buses", "bus_id long", BUS, self.ttl_ms)
        self.next_id = handle.getValueState("next_id", "next_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_id = self.next_id.get()[0] if self.next_id.exists() else 0
        found = {k[0]: dict(zip(("place", *FIELDS), v, strict=True)) for k, v in self.buses.iterator()}
        before, kept, out = sorted(found.items(), key=lambda b: b[1]["place"]), set(found), []
        for snapshot, part in pd.concat(list(rows)).sort_values(["snapshot_id", "ord"]).groupby("snapshot_id", sort=True):
            free = [{k: _plain(r[k]) for k in FIELDS} for r in part.to_dict("records") if _plain(r["duration_ms"]) is not None]
            ids: list[int | None] = [None] * len(free)
            for bus, old in before:
                same = next((i for i, new in enumerate(free) if ids[i] is None and same_bus(old, new)), None)
                if same is None:
                    out.append((*key, snapshot, bus, int(old["duration_ms"]), True))
                else:
                    ids[same] = bus
            for i, own in enumerate(ids):
                if own is None:
                    ids[i], next_id = next_id, next_id + 1
            before = list(zip(ids, free, strict=True))
            out += [(*key, snapshot, i, int(b["duration_ms"]), False) for i, b in before]
        for bus in kept - {i for i, _ in before}:
            self.buses.removeKey((bus,))
        for place, (bus, b) in enumerate(before):
            self.buses.updateValue((bus,), (place, int(b["duration_ms"]), *(b[f] if f != "visit_number" or b[f] is None else int(b[f]) for f in FIELDS[1:])))
        self.next_id.update((next_id,))
        yield pd.DataFrame(out, columns=["feed_id", "stop_id", "no", "snapshot_id", "bus_id", "duration_ms", "ghost"])

    def close(self) -> None:
        pass


def matched_buses(predictions: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """The rows of ``live.match_predictions``; a bus is forgotten ``ttl_ms`` after its last snapshot."""
    return predictions.groupBy("feed_id", "stop_id", "no").transformWithStateInPandas(Buses(ttl_ms), OUT, "Append", "ProcessingTime")


class Pins(StatefulProcessor):
    """Whether a service is pinned, the vehicles seen since, and a timer for silence."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pinned = handle.getValueState("pinned", "pinned boolean")
        self.seen = handle.getMapState("seen", "vehicle_id string", "lat double, lng double")

    def _gone(self, key) -> list[tuple]:
        out = [(*key, k[0], None, None, True) for k, _ in self.seen.iterator()] if self.seen.exists() else []
        self.seen.clear()
        self.pinned.clear()
        return out

    def _timed(self, now: int | None) -> None:
        """One timer for each service, put off by each batch with data; none for ``now`` of None."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if now is not None:
            self.handle.registerTimer(now + self.silence_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pinned, out = self.pinned.exists(), []
        for r in pd.concat(list(rows)).sort_values("ord").itertuples():
            if _plain(r.vehicle_id) is None:
                if pinned and not r.pinned:
                    out += self._gone(key)
                pinned = bool(r.pinned)
                if pinned:
                    self.pinned.update((True,))
            elif pinned:
                self.seen.updateValue((r.vehicle_id,), (_plain(r.lat), _plain(r.lng)))
                out.append((*key, r.vehicle_id, _plain(r.lat), _plain(r.lng), False))
        self._timed(timerValues.getCurrentProcessingTimeInMs() if pinned else None)
        yield pd.DataFrame(out, columns=["feed_id", "no", "vehicle_id", "lat", "lng", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._gone(key), columns=["feed_id", "no", "vehicle_id", "lat", "lng", "gone"])

    def close(self) -> None:
        pass


def pinned_positions(vehicles: DataFrame, pins: DataFrame, silence_ms: int = 3_600_000) -> DataFrame:
    """The rows of ``live.cached_positions``; a pinned service without data for ``silence_ms`` gives its vehicles as gone and is forgotten."""
    none = lambda kind: F.lit(None).cast(kind)
    seen = vehicles.select("feed_id", "no", "vehicle_id", "lat", "lng", none("boolean").alias("pinned"), "ord")
    marks = pins.select("feed_id", "no", none("string").alias("vehicle_id"), none("double").alias("lat"), none("double").alias("lng"), "pinned", "ord")
    return seen.unionByName(marks).groupBy("feed_id", "no").transformWithStateInPandas(Pins(silence_ms), POSITION, "Append", "ProcessingTime")
