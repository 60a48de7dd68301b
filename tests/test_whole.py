"""Small tables on which a query that reads only a part of its input gives too few rows."""

import io
import math
import random
import zipfile

import pytest
from transit_tables.operators import diagram, graphs, network, search, shapes
from transit_tables.plans import fixtures, queries
from transit_tables.sources import feeds as sources
from transit_tables.sources import zips


def tables(spark, path, customers=(), orders=(), lines=(), suppliers=()):
    """Writes the columns of the test tables that the views read: customers (key), orders (key, customer), lines (order, part, supplier)."""
    kinds = {
        "customer": ([(k, f"Customer#{k:09d}", "F") for k in customers], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": ([(k, c, "F") for k, c in orders], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "lineitem": ([(o, p, s, n, None, 1.0) for n, (o, p, s) in enumerate(lines)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_shipdate date, l_extendedprice double"),
        "supplier": ([(k, f"Supplier#{k:09d}") for k in suppliers], "s_suppkey long, s_name string"),
    }
    for name, (data, kind) in kinds.items():
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_importance_reads_every_trip(spark, tmp_path):
    trips = {1: [1, 2, 3], 2: [3, 4], 20: [4, 1]}
    d = tables(spark, tmp_path, [5], [(o, 5) for o in trips], [(o, p, 0) for o, parts in trips.items() for p in parts])
    pairs = {(a, b) for parts in trips.values() for i, a in enumerate(parts) for b in parts[i + 1 :]}
    hops = {x for parts in trips.values() for a, b in zip(parts, parts[1:]) for x in ((a, b), (b, a))}
    reach = {r.stop_id: r.destinations for r in queries.QUERIES["reachable_counts"](spark, d).collect()}
    assert reach == {f"P{s}": sum(a == s for a, _ in pairs) for s in {a for a, _ in pairs}}
    assert {(r.stop_id, r.other) for r in queries.QUERIES["stop_neighbors"](spark, d).collect()} == {(f"P{a}", f"P{b}") for a, b in hops}
    assert {r.stop_id: (r.destinations, r.neighbors) for r in queries.QUERIES["stop_importance"](spark, d).collect()} == {s: (n, sum(f"P{a}" == s for a, _ in hops)) for s, n in reach.items()}


def test_requests_come_from_every_customer_and_cover_every_stop(spark, tmp_path):
    d = tables(spark, tmp_path, range(450), suppliers=range(150))
    got = {tuple(r) for r in fixtures.load(spark, d, "requests")[0].collect()}
    pairs = {(k * 13 % 150, (k * 29 + k // 150) % 150) for k in range(450)}
    assert got == {("F", f"S{a}", f"S{b}") for a, b in pairs if a != b} and len(got) > 400
    assert {x for _, a, b in got for x in (a, b)} == {f"S{k}" for k in range(150)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_search_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda least: "".join(rng.choice("ab5E ") for _ in range(rng.randint(least, 9))).strip()
    asked = {f"q{i}": t for i, t in enumerate(["5", "e", "ab", "335E", *(word(1) for _ in range(40))])}
    known = {f"r{i}": t for i, t in enumerate(["335E", "5", *(word(2) for _ in range(60))])}
    frame = lambda x, k: spark.createDataFrame(list(x.items()), f"{k} string, text string")
    for threshold in (0.3, 0.6):
        want = {}
        for q, a in asked.items():
            for r, t in known.items():
                n, a, t = len(a), a.lower(), t.lower()
                score = min((distance(a, t[i : i + n]) for i in range(max(len(t) - n, 0) + 1)), default=n) / n if n else 1
                if score <= threshold:
                    want[q, r] = score
        got = search.fuzzy_search(frame(asked, "query_id"), frame(known, "id"), frame({"s": "zzzzzzzzzzzzz"}, "id"), threshold)
        assert {(r.query_id, r.id): r.score for r in got.collect()} == want
        assert ("q0", "r0") in want


def test_shared_stops_and_search_take_all_routes(spark, tmp_path):
    d = tables(spark, tmp_path, [1, 50, 100], [(1, 1), (2, 50), (3, 100)], [(o, 0, s) for o in (1, 2, 3) for s in (8, 9)], [8, 9])
    assert {(r.stop_id, r.services) for r in queries.QUERIES["shared_stops"](spark, d).collect()} == {("S8", "R1,R100,R50"), ("S9", "R1,R100,R50")}
    found = {(r.query_id, r.id) for r in queries.QUERIES["fuzzy_search"](spark, d).where("kind = 'service'").collect()}
    assert {q for q, _ in found} == {"R50", "R100"} and {r for _, r in found} == {"R1", "R50", "R100"}  # every 50th asks, all answer


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


def test_only_the_members_bytes_of_a_zip_are_read():
    rng, packed = random.Random(1), io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big/stop_times.txt", "trip_id,stop_id\n" + "".join(f"t{rng.random()},s{rng.random()}\n" for _ in range(50_000)))
        z.writestr("big/routes.txt", "route_id\nr1\nr2\n")
    source = Counted(packed.getvalue())
    assert list(zips.member_rows(source, "routes")) == [["route_id"], ["r1"], ["r2"]]
    assert source.taken < 2_000 and len(packed.getvalue()) > 900_000
    assert list(zips.member_rows(Counted(packed.getvalue()), "stops")) == []


def test_zips_of_over_two_gigabytes_and_damaged_ones(spark, tmp_path):
    """A hole of 2.5 GB before the zip proper takes no disk."""
    (tmp_path / "z").mkdir()
    with open(tmp_path / "z" / "large feed.zip", "wb") as out:
        out.truncate(2_500_000_000)
        out.seek(0, 2)
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("stops.txt", "stop_id,stop_name,extra\ns1,One,x\n\ns2\n")
    with zipfile.ZipFile(tmp_path / "z" / "torn.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("stops.txt", "stop_id,stop_name\n" + "s9,Nine\n" * 30_000)
    torn = (tmp_path / "z" / "torn.zip").read_bytes()
    (tmp_path / "z" / "torn.zip").write_bytes(torn[:100_000] + b"X" + torn[100_001:])
    (tmp_path / "z" / "no.zip").write_bytes(b"no")
    got = sources.read_gtfs_table(spark, f"{tmp_path}/z", "stops").where("feed_id = 'large feed'").orderBy("ord").select("stop_id", "stop_name", "ord.row", "absent")
    assert [tuple(r) for r in got.collect()] == [("s1", "One", 1, ["stop_lat", "stop_lon"]), ("s2", None, 3, ["stop_lat", "stop_lon"])]
    found = zips.read_zips(spark, f"{tmp_path}/z", "stops", ["stop_id"])
    assert {r.feed_id for r in found.where("error is not null and row is null").collect()} == {"torn", "no"}
    assert found.columns == ["feed_id", "row", "absent", "error", "stop_id"]
    listing = {tuple(r) for r in sources.unzip_feeds(spark, f"{tmp_path}/z", f"{tmp_path}/out").collect()}
    assert {("no", None, None), ("torn", None, None), ("large feed", "stops", 4)} <= listing


def test_tables_read_by_line_tell_which_lines_are_broken(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "trips.txt").write_text('trip_id,route_id,shape_id\nt1,r1,"x\ny"\nt2,r2,\n')
    assert [tuple(r) for r in sources.broken_lines(spark, str(tmp_path), "trips").collect()] == [("a", 2)]
    whole = sources.read_gtfs_table(spark, str(tmp_path), "trips", multi_line=True)
    assert {(r.trip_id, r.shape_id) for r in whole.collect()} == {("t1", "x\ny"), ("t2", None)}


def test_similar_routes_by_brute_force(spark):
    """Every route visits the hub; blocks of 5 and of 256 routes, any least share."""
    rng = random.Random(8)
    stops = {f"r{i}": {99, *rng.sample(range(30), rng.randint(0, 9))} for i in range(70)} | {"twin": {99, 1, 2, 3}, "twin2": {99, 1, 2, 3}}
    members = spark.createDataFrame([("f", r, f"s{x}") for r, xs in stops.items() for x in xs] + [("g", "r1", "s99")], "feed_id string, route_id string, stop_id string")
    for least, block in ((0.0, 5), (0.2, 5), (0.5, 256), (1.0, 5)):
        want = {(a, b): j for a in stops for b in stops if a < b and (j := len(stops[a] & stops[b]) / len(stops[a] | stops[b])) >= least and j > 0}
        got = {(r.a, r.b): r.jaccard for r in graphs.route_similarity(members, least, block).collect()}
        assert got == want and ("twin", "twin2") in got
    assert graphs.rarest_stops(members, 1.0).count() == len(stops) + 1 < graphs.rarest_stops(members, 0.5).count() < members.count()


def test_levels_of_bands_equal_those_of_one_loop(spark):
    rng = random.Random(7)
    stops = {(f, f"r{i}"): rng.sample("abcdefghij", rng.randint(1, 3)) for f in "fg" for i in range(40)}
    ranks = {k: rng.choice([1.0, 2.0, 3.0, None]) for k in stops}
    members = spark.createDataFrame([(*k, s) for k, ss in stops.items() for s in ss], "feed_id string, route_id string, stop_id string")
    priority = spark.createDataFrame([(*k, p) for k, p in ranks.items() if p], "feed_id string, route_id string, priority double")
    used, want = {}, {}
    for k in sorted(stops, key=lambda k: (ranks[k] is None, ranks[k] or 0, k[1])):
        taken = set().union(*(used.setdefault((k[0], s), set()) for s in stops[k]))
        want[k] = next(n for n in range(1, 99) if n not in taken)
        for s in stops[k]:
            used[k[0], s].add(want[k])
    size = 10 * (graphs.ROUTE_WEIGHT + 3)
    bands = graphs.level_bands(members, priority, size).groupBy("feed_id", "band").count().collect()
    assert len(bands) > 6 and max(r["count"] for r in bands) <= 11
    assert {(r.feed_id, r.route_id): r.level for r in graphs.assign_levels(members, priority, size).collect()} == want
    assert graphs.assign_levels(members.limit(0), priority).count() == 0


def test_zips_load_as_folders_do(spark, tmp_path):
    texts = {"routes": 'route_id,route_long_name\n007,"Alpha, Beta"\n', "trips": "trip_id,route_id\r\nt1,007\r\n", "stop_times": "﻿trip_id,stop_id,stop_sequence\nt1,01,1\n\nt1,02,x\n", "stops": "stop_id,stop_lon,stop_lat,stop_name\n01,2.5,1.5,S"}
    (tmp_path / "folder" / "z").mkdir(parents=True)
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "z.zip", "w", zipfile.ZIP_DEFLATED) as packed:
        for name, text in texts.items():
            (tmp_path / "folder" / "z" / f"{name}.txt").write_bytes(text.encode())
            packed.writestr(f"inner/{name}.txt", text.encode())
    (tmp_path / "zips" / "bad.zip").write_bytes(b"no zip")
    folder, zips = (sources.load_feed(spark, f"{tmp_path}/{x}") for x in ("folder", "zips"))
    listed = sources.unzip_feeds(spark, f"{tmp_path}/zips", f"{tmp_path}/out")
    assert {tuple(r) for r in listed.collect()} == {("bad", None, None), ("z", "routes", 2), ("z", "trips", 2), ("z", "stop_times", 4), ("z", "stops", 2)}
    for name in sources.TABLES:
        want = [tuple(r) for r in folder[name].orderBy("ord").drop("ord").collect()]
        assert bool(want) == (name != "shapes")
        for got in (zips[name], spark.read.parquet(f"{tmp_path}/out/{name}")):
            assert [tuple(r) for r in got.orderBy("ord").drop("ord").collect()] == want
        assert [tuple(r) for r in sources.present_columns(spark, f"{tmp_path}/zips", name).collect()] == [tuple(r) for r in sources.present_columns(spark, f"{tmp_path}/folder", name).collect()]


def test_levels_are_handed_from_band_to_band(spark):
    """A hub of all routes fills one range; a stop that pauses for several bands keeps its levels."""
    stops = {f"r{i:03}": ["hub"] + (["pause"] if i in (0, 1, 90) else []) + [f"own{i}"] for i in range(100)}
    members = spark.createDataFrame([("f", r, s) for r, ss in stops.items() for s in ss], "feed_id string, route_id string, stop_id string")
    priority = spark.createDataFrame([("f", r, float(i)) for i, r in enumerate(stops)], "feed_id string, route_id string, priority double")
    found = graphs.assign_levels(members, priority, 10 * (graphs.ROUTE_WEIGHT + 3)).collect()
    assert {r.route_id: r.level for r in found} == {r: i + 1 for i, r in enumerate(stops)}
    apart = members.where("stop_id <> 'hub'")
    found = {r.route_id: r.level for r in graphs.assign_levels(apart, priority, 10 * (graphs.ROUTE_WEIGHT + 3)).collect()}
    assert found == {r: 2 if r == "r001" else 3 if r == "r090" else 1 for r in stops}


def test_simplified_shapes_equal_a_recursion(spark):
    rng = random.Random(3)
    tolerance = 0.05

    def kept(points, a, b):
        far, at = tolerance, None
        (x0, y0), (x1, y1) = points[a], points[b]
        for i in range(a + 1, b):
            x, y = points[i]
            size = (x1 - x0) ** 2 + (y1 - y0) ** 2
            t = 0 if size == 0 else min(1, max(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / size))
            off = math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0))
            if off > far:
                far, at = off, i
        return [] if at is None else [*kept(points, a, at), at, *kept(points, at, b)]

    lines = {f"s{n}": [(77 + rng.random() / 2, 12 + rng.random() / 2) for _ in range(n)] for n in (1, 2, 3, 10, 60)}
    lines["loop"] = [(77.0, 12.0), (77.3, 12.0), (77.3, 12.3), (77.0, 12.0)]
    lines["same"] = [(77.0, 12.0)] * 4
    points = spark.createDataFrame([("f", k, i, y, x) for k, line in lines.items() for i, (x, y) in enumerate(line)], "feed_id string, shape_id string, pt_seq int, lat double, lon double")
    want = {(k, i) for k, line in lines.items() for i in {0, len(line) - 1, *kept(line, 0, len(line) - 1)}}
    assert {(r.shape_id, r.pt_seq) for r in shapes.simplify_shapes(points, tolerance).collect()} == want
    assert shapes.simplify_shapes(points.limit(0), tolerance).count() == 0


def test_forward_ids_are_compared_as_numbers_before_texts(spark):
    stops = {"a": ["0", "10"], "b": ["0", "9"], "c": ["0", "x"], "d": ["0"], "e": ["0", "9", "2"], "10": ["0", "9"], "2": ["0", "9"]}
    routes = spark.createDataFrame([("f", "0", r, ss) for r, ss in stops.items()], "feed_id string, stop_id string, route_id string, stops array<string>")
    placed = diagram.order_by_forward_ids(routes).orderBy("place").collect()
    assert [r.route_id for r in placed] == ["d", "10", "2", "b", "e", "a", "c"]  # ties by service order: first digit, then number


def test_pairs_of_routes_are_counted_in_tasks(spark):
    """Two feeds, blocks of 4; a pair is no row for each stop that both have."""
    rng = random.Random(12)
    stops = {(f, f"r{i}"): set(rng.sample(range(12), rng.randint(1, 8))) for f in "fg" for i in range(25)}
    members = spark.createDataFrame([(*k, f"s{x}") for k, xs in stops.items() for x in xs], "feed_id string, route_id string, stop_id string")
    found = graphs.route_similarity(members, 0.2, 4)
    want = {(*a, b[1]): j for a in stops for b in stops if a[0] == b[0] and a[1] < b[1] and (j := len(stops[a] & stops[b]) / len(stops[a] | stops[b])) >= 0.2}
    rows = found.collect()
    assert {(r.feed_id, r.a, r.b): r.jaccard for r in rows} == want and len(rows) == len(want)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()


def test_stops_at_one_place_meet_as_one(spark, monkeypatch):
    """80 stops at 4 places, two of them less than the nine decimals apart, and a lone one: four or five rows meet, not 81."""
    rng = random.Random(4)
    places = [(0.0, 0.0), (0.001, 0.0), (0.001, 1e-11), (7.0, 7.0)]
    at = [(f"s{i}", *places[i % 4], "x Int" if i % 3 else "x", rng.randint(0, 9)) for i in range(80)] + [("lone", 3.0, 3.0, "x", 1)]
    met, plain = [], network._nearest_in_cells
    monkeypatch.setattr(network, "_nearest_in_cells", lambda todo, base, size: met.append((todo.count(), base.count())) or plain(todo, base, size))
    df = spark.createDataFrame([("f", *r) for r in at], "feed_id string, stop_id string, lon double, lat double, name string, ord long")
    got = {r.stop_id: (r.nearest, r.degrees) for r in network.nearest_stop(df).collect()}
    for s, x, y, *_ in at:
        key = lambda o: (round(((x - o[1]) ** 2 + (y - o[2]) ** 2) ** 0.5, 9), o[3].endswith(" Int"), o[4], o[0])
        best = min((o for o in at if o[0] != s), key=key)
        assert got[s] == (best[0], pytest.approx(((x - best[1]) ** 2 + (y - best[2]) ** 2) ** 0.5))
    assert len(got) == 81 and max(x for m in met for x in m) <= 5


def test_areas_that_share_no_stop_go_beside_each_other(spark):
    """40 separate areas of 3 routes: one band or two for all, and requests only within an area."""
    lists = {f"r{i}": [f"s{i // 3 * 3 + i % 3}", f"s{i // 3 * 3 + (i + 1) % 3}"] for i in range(120)}
    members = spark.createDataFrame([("f", r, s) for r, ss in lists.items() for s in ss], "feed_id string, route_id string, stop_id string")
    found = {r.route_id: r.area for r in graphs.areas(members).collect()}
    assert found == {r: min(f"r{int(r[1:]) // 3 * 3 + k}" for k in range(3)) for r in lists}
    size = 3 * (graphs.ROUTE_WEIGHT + 2) + 1
    bands = graphs.level_bands(members.join(graphs.areas(members), graphs.ROUTE), members.limit(0).selectExpr("feed_id", "route_id", "0d as priority"), size)
    assert {r.band for r in bands.select("band").distinct().collect()} == {0}
    known = spark.createDataFrame([("f", r, ss[-1], 1, 0, ss) for r, ss in lists.items()], "feed_id string, route_id string, destination string, dest_rank int, variant_idx int, stops array<string>")
    asked = spark.createDataFrame([("f", f"s{i}", f"s{i + k}") for i in range(0, 117, 3) for k in (1, 3)], "feed_id string, start_stop string, end_stop string")
    assert {(r.start_stop, r.end_stop) for r in network.connected_requests(known, asked).collect()} == {(f"s{i}", f"s{i + 1}") for i in range(0, 117, 3)}


def test_snapping_by_brute_force_over_few_cells(spark, monkeypatch):
    """Segments lie in the cells along their line, not in all of their bounds."""
    rng = random.Random(6)
    at = lambda: (77 + rng.random() / 2, 12 + rng.random() / 2)
    lines = [(*at(), *at()) for _ in range(12)] + [(77.1, 12.1, 77.4, 12.1), (77.2, 12.0, 77.2, 12.4), (77.3, 12.3, 77.3, 12.3)]
    points = spark.createDataFrame([("f", f"l{i}", k, y, x) for i, (a, b, c, d) in enumerate(lines) for k, (x, y) in enumerate(((a, b), (c, d)))], "feed_id string, shape_id string, pt_seq int, lat double, lon double")
    where = [at() for _ in range(150)]
    cars = spark.createDataFrame([("f", f"v{i}", y, x) for i, (x, y) in enumerate(where)], "feed_id string, vehicle_id string, lat double, lng double")
    kept, plain = [], shapes.save
    monkeypatch.setattr(shapes, "save", lambda rows, name: kept.append(rows.count()) or plain(rows, name))
    kx, ky = shapes.scales()
    for metres in (500.0, 3000.0):
        got = {r.vehicle_id: r.metres for r in shapes.snap_to_shapes(cars, points, metres).collect()}
        for i, (x, y) in enumerate(where):
            off = []
            for a, b, c, d in lines:
                dx, dy, px, py = (c - a) * kx, (d - b) * ky, (x - a) * kx, (y - b) * ky
                t = max(0, min(1, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                off.append(1000 * math.hypot(px - t * dx, py - t * dy))
            assert got[f"v{i}"] == (pytest.approx(min(off)) if min(off) < metres else None)
    assert 0 < kept[0] < 15 * 300


def test_equal_texts_are_searched_once(spark, monkeypatch):
    met, plain = [], search.candidates
    monkeypatch.setattr(search, "candidates", lambda q, t, least: met.append((q.count(), t.count())) or plain(q, t, least))
    frame = lambda n, k: spark.createDataFrame([(f"{k}{i}", "Route 335E" if i % 2 else " route 335e ") for i in range(n)], f"{k} string, text string")
    got = search.fuzzy_search(frame(6, "query_id"), frame(30, "id"), frame(2, "id")).collect()
    assert len(got) == 180 and {r.score for r in got} == {0.0} and met[0] == (1, 1)
