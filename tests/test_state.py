"""State that expires: the same rows as the older form, a restart, a timer and a time to live."""

import time

import pytest

from transit_tables.streaming import live as streams
from transit_tables.streaming import state

PREDICTION = "feed_id string, stop_id string, no string, snapshot_id long, ord long, duration_ms long, feature string, type string, visit_number int, origin_code string, destination_code string"
PIN, SEEN = "feed_id string, no string, pinned boolean, ord long", "feed_id string, no string, vehicle_id string, lat double, lng double, ord long"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(STORE)
    state.use_rocksdb(spark)
    yield spark
    spark.conf.set(STORE, before)


def add(spark, path, kind, data):
    spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, kind):
    return spark.readStream.schema(kind).parquet(str(path))


def run(df, name, checkpoint):
    """Everything there is, each time from the checkpoint, added to a table."""
    query = df.writeStream.foreachBatch(lambda batch, _: name.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(checkpoint)).trigger(once=True).start()
    query.awaitTermination()
    return name


def snapshot(n, *buses):
    return [("f", "s", "7", n, i, d, None, t, 1, "o", "d") for i, (d, t) in enumerate(buses)]


def test_buses_keep_their_ids_over_a_restart(rocksdb, spark, tmp_path):
    parts = [snapshot(1, (600_000, "SD"), (1_200_000, "DD")), snapshot(2, (540_000, "SD"), (1_700_000, "DD")), snapshot(3, (1_640_000, "DD"), (480_000, "SD"))]
    got, old = [], []
    for part in parts:  # a new query each time, whose state is that of the checkpoint
        add(spark, tmp_path / "in", PREDICTION, part)
        run(state.matched_buses(source(spark, tmp_path / "in", PREDICTION)), got, tmp_path / "cp")
        run(streams.match_predictions(source(spark, tmp_path / "in", PREDICTION), timeout="NoTimeout"), old, tmp_path / "old")
    assert sorted(got) == sorted(old)
    assert {(r[3], r[4], r[6]) for r in got} == {(1, 0, False), (1, 1, False), (2, 0, False), (2, 1, True), (2, 2, False), (3, 0, False), (3, 2, False)}


def test_buses_are_forgotten_after_their_time_to_live(rocksdb, spark, tmp_path):
    got = []
    add(spark, tmp_path / "in", PREDICTION, snapshot(1, (600_000, "SD")))
    run(state.matched_buses(source(spark, tmp_path / "in", PREDICTION), ttl_ms=1_000), got, tmp_path / "cp")
    time.sleep(1.5)
    add(spark, tmp_path / "in", PREDICTION, snapshot(2, (540_000, "DD")))
    run(state.matched_buses(source(spark, tmp_path / "in", PREDICTION), ttl_ms=1_000), got, tmp_path / "cp")
    assert [r[3:] for r in got] == [(1, 0, 600_000, False), (2, 0, 540_000, False)]  # no ghost, ids from 0 again


def test_pinned_services_end_by_unpinning_or_silence(rocksdb, spark, tmp_path):
    def step(pins=(), seen=(), silence=600_000):
        got = []
        for name, kind, data in (("pins", PIN, pins), ("seen", SEEN, seen)):
            add(spark, tmp_path / name, kind, list(data))
        run(state.pinned_positions(source(spark, tmp_path / "seen", SEEN), source(spark, tmp_path / "pins", PIN), silence), got, tmp_path / "cp")
        return sorted(r[1:] for r in got)

    assert step([("f", "7", True, 1), ("f", "8", True, 1)], [("f", "7", "a", 1.0, 2.0, 2), ("f", "8", "b", 1.0, 2.0, 2), ("f", "9", "c", 1.0, 2.0, 2)], 1_000) == [("7", "a", 1.0, 2.0, False), ("8", "b", 1.0, 2.0, False)]
    assert step([("f", "7", False, 3)], [("f", "7", "a", 9.0, 9.0, 4)])[:1] == [("7", "a", None, None, True)]
    time.sleep(1.5)  # 8 stays silent, so its timer is due whatever comes
    assert step([("f", "9", True, 5)], [("f", "9", "c", 3.0, 4.0, 6)])[-1] == ("9", "c", 3.0, 4.0, False)
    after = step(seen=[("f", "8", "b", 5.0, 6.0, 7), ("f", "9", "c", 5.0, 6.0, 8)])
    assert [r for r in after if r[0] == "9"] == [("9", "c", 5.0, 6.0, False)] and ("8", "b", 5.0, 6.0, False) not in after
