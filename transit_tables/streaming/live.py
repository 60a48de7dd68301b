"""Arrivals and vehicle positions as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import live
from ..tables import files

WATERMARK = "10 minutes"
#: Minutes that a bus may come sooner or later than at the last refresh and still be the same.
SOONER, LATER = -5, 3


def stream_live_services(predictions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, static: DataFrame | None = None):
    """Starts a query that gives each batch of predictions to ``sink`` as services; stops without any fall back to ``static``."""
    def each(batch: DataFrame, epoch: int) -> None:
        services = live.live_services(batch)
        sink(services if static is None else live.arrivals_with_fallback(services, static), epoch)

    return predictions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()


def retried(sink: Callable[[DataFrame, int], None], marks: str, tries: int = 3) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is given to ``sink`` up to ``tries`` times, and never again once that went well.

    Each batch that went well leaves a file of its number in the folder ``marks``, so one that is replayed after a restart is
    passed over. The last failure is raised and stops the query, which goes on with that batch when it is started again.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        from pyarrow import fs

        system, root = files(marks)
        if system.get_file_info(f"{root}/{epoch}").type != fs.FileType.NotFound:
            return
        kept = batch.persist()
        try:
            for k in range(tries):
                try:
                    sink(kept, epoch)
                    break
                except Exception:
                    if k + 1 == tries:
                        raise
        finally:
            kept.unpersist()
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{epoch}"):
            pass

    return each


def lost_snapshots(expected: DataFrame, arrived: DataFrame, grace: str = "30 seconds", watermark: str = WATERMARK) -> DataFrame:
    """(feed, stop, due) of a stream of expected refreshes (feed, stop, due) for which no snapshot (feed, stop, ts) came from ``due`` on within ``grace``.

    A refresh is given up once both streams have passed it by ``watermark`` and the grace; state is kept until then.
    """
    due = expected.select("feed_id", "stop_id", "due").withWatermark("due", watermark)
    came = arrived.select(F.col("feed_id").alias("_feed"), F.col("stop_id").alias("_stop"), "ts").withWatermark("ts", watermark)
    on = F.expr(f"feed_id = _feed and stop_id = _stop and ts >= due and ts < due + interval {grace}")
    return due.join(came, on, "leftOuter").where("ts is null").select("feed_id", "stop_id", "due")


def lost_to_schedule(lost: DataFrame, static: DataFrame) -> DataFrame:
    """The schedule's services for a batch of lost refreshes, as ``arrivals_with_fallback`` gives them for stops without live data."""
    at = lost.select("feed_id", "stop_id").distinct()
    return static.join(at, ["feed_id", "stop_id"], "left_semi")


def latest_positions(vehicles: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The newest mappable record of each vehicle; ``ts`` is a timestamp. For update mode."""
    ok = vehicles.where(live.mappable(F.col("lat"), F.col("lng"))).withWatermark("ts", watermark)
    return ok.groupBy("feed_id", "vehicle_id").agg(F.max_by(F.struct("ts", "lat", "lng"), F.struct("ts", "ord")).alias("p")).select("feed_id", "vehicle_id", "p.*")


def tracked_only(vehicles: DataFrame, tracked: Callable[[], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    """For foreachBatch: the batch's vehicles of the services tracked now; an empty table stops all."""
    return lambda batch, _: batch.join(tracked(), ["feed_id", "routeno"], "left_semi")


def dedupe_snapshots(vehicles: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One record of each vehicle number and snapshot, whichever comes first; where up must go before down, use ``first_of_snapshots``."""
    return vehicles.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["feed_id", "vehicle_number", "snapshot_id"])


def first_of_snapshots(batch: DataFrame, _epoch: int = 0) -> DataFrame:
    """For foreachBatch, as a snapshot comes in one batch: of each vehicle number and snapshot the first record, up before down."""
    order = Window.partitionBy("feed_id", "snapshot_id", "vehicle_number").orderBy(F.when(F.col("direction") == "up", 0).otherwise(1), "ord")
    return batch.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def cached_positions(vehicles: DataFrame, pins: DataFrame, timeout: str = GroupStateTimeout.ProcessingTimeTimeout, silence_ms: int = 3_600_000) -> DataFrame:
    """Rows (feed, no, vehicle, lat, lng, gone) of streams of vehicles (feed, no, vehicle, lat, lng, ord) and of pins (feed, no, pinned, ord).

    A vehicle's last position is kept while its service is pinned. When the service is unpinned, its
    vehicles are given once as gone and forgotten; positions of services that aren't pinned are left out.
    The same goes for a pinned service without data for ``silence_ms``, which then counts as unpinned, unless ``timeout`` is NoTimeout.
    Rows of one service are taken in order of ``ord``.
    """
    kind = "feed_id string, no string, vehicle_id string, lat double, lng double, gone boolean"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pinned, held = state.get if state.exists else (False, [])
        held, out = list(held), []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, v, None, None, True) for v in held], columns=["feed_id", "no", "vehicle_id", "lat", "lng", "gone"])
            return
        for r in pd.concat(list(frames)).sort_values("ord").itertuples():
            if r.vehicle_id is None:
                if pinned and not r.pinned:
                    out += [(*key, v, None, None, True) for v in held]
                    held = []
                pinned = bool(r.pinned)
            elif pinned:
                held += [r.vehicle_id] if r.vehicle_id not in held else []
                out.append((*key, r.vehicle_id, r.lat, r.lng, False))
        if pinned:
            state.update((pinned, held))
            if timeout != GroupStateTimeout.NoTimeout:
                state.setTimeoutDuration(silence_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["feed_id", "no", "vehicle_id", "lat", "lng", "gone"])

    none = lambda kind: F.lit(None).cast(kind)
    seen = vehicles.select("feed_id", "no", "vehicle_id", "lat", "lng", none("boolean").alias("pinned"), "ord")
    marks = pins.select("feed_id", "no", none("string").alias("vehicle_id"), none("double").alias("lat"), none("double").alias("lng"), "pinned", "ord")
    return seen.unionByName(marks).groupBy("feed_id", "no").applyInPandasWithState(step, kind, "pinned boolean, held array<string>", "append", timeout)


def with_staleness(vehicles: DataFrame, now) -> DataFrame:
    """Seconds since a vehicle's last refresh; nothing is cut off."""
    return vehicles.withColumn("stale_s", F.unix_timestamp(now) - F.unix_timestamp("ts"))


def same_bus(old: dict, new: dict) -> bool:
    minutes = (new["duration_ms"] - old["duration_ms"]) / 60000
    return all(old[k] == new[k] for k in ("feature", "type", "visit_number", "origin_code", "destination_code")) and SOONER < minutes < LATER


FIELDS = ("duration_ms", "feature", "type", "visit_number", "origin_code", "destination_code")
OUT = "feed_id string, stop_id string, no string, snapshot_id long, bus_id long, duration_ms long, ghost boolean"
STATE = "next_id long, ids array<long>, durations array<long>, features array<string>, types array<string>, visits array<int>, origins array<string>, destinations array<string>"


def match_predictions(predictions: DataFrame, ttl_ms: int = 3_600_000, timeout: str = GroupStateTimeout.ProcessingTimeTimeout) -> DataFrame:
    """Rows (feed, stop, no, snapshot, bus_id, duration_ms, ghost) of a stream of predictions.

    A bus keeps its id from one snapshot of its stop and service to the next if a free
    prediction is the same but for a small shift; the first such is taken. A bus
    that isn't found is given once more as a ghost. State is dropped after ``ttl_ms``
    without data.
    """
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_id, before = 0, []
        if state.exists:
            next_id, ids, *cols = state.get
            before = [(i, dict(zip(FIELDS, v, strict=True))) for i, *v in zip(ids, *cols, strict=True)]
        out = []
        for snapshot, rows in pd.concat(list(frames)).sort_values(["snapshot_id", "ord"]).groupby("snapshot_id", sort=True):
            free = [{k: r[k] for k in FIELDS} for r in rows.to_dict("records") if r["duration_ms"] is not None and not pd.isna(r["duration_ms"])]
            ids: list[int | None] = [None] * len(free)
            for bus, old in before:
                found = next((i for i, new in enumerate(free) if ids[i] is None and same_bus(old, new)), None)
                if found is None:
                    out.append((*key, snapshot, bus, int(old["duration_ms"]), True))
                else:
                    ids[found] = bus
            for i, own in enumerate(ids):
                if own is None:
                    ids[i], next_id = next_id, next_id + 1
            before = list(zip(ids, free, strict=True))
            out += [(*key, snapshot, i, int(b["duration_ms"]), False) for i, b in before]
        state.update((next_id, [i for i, _ in before], *([b[f] if f not in ("duration_ms", "visit_number") else int(b[f]) for _, b in before] for f in FIELDS)))
        if timeout != GroupStateTimeout.NoTimeout:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["feed_id", "stop_id", "no", "snapshot_id", "bus_id", "duration_ms", "ghost"])

    return predictions.groupBy("feed_id", "stop_id", "no").applyInPandasWithState(step, OUT, STATE, "append", timeout)
