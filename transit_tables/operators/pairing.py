"""Two-way services as rows of an outbound and an inbound stop."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks the turning point of a loop.
TURN = "~~~"


def opposite(stop: str | None) -> str | None:
    return None if not stop or stop[-1] not in "19" else stop[:-1] + ("9" if stop[-1] == "1" else "1")


def align(out: list[str], back: list[str]) -> list[tuple[str | None, str | None]]:
    """Rows of both lists in order, with as many equal or opposite stops beside each other as possible.

    The longest common subsequence under "equal or opposite" gives the rows with both;
    stops between two of them stand alone, side by side while both columns have some.
    """
    n, m = len(out), len(back)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    fits = lambda a, b: a == b or opposite(a) == b
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if fits(out[i], back[j]) else max(best[i + 1][j], best[i][j + 1])
    rows: list[tuple[str | None, str | None]] = []
    i = j = 0
    left: list[str] = []
    right: list[str] = []

    def flush():
        rows.extend((left[k] if k < len(left) else None, right[k] if k < len(right) else None) for k in range(max(len(left), len(right))))
        left.clear()
        right.clear()

    while i < n or j < m:
        if i < n and j < m and fits(out[i], back[j]):
            flush()
            rows.append((out[i], back[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            left.append(out[i])
            i += 1
        else:
            right.append(back[j])
            j += 1
    flush()
    return rows


def split_loop(stops: list[str]) -> tuple[list[str], list[str]]:
    """A loop as its way out and, backwards, its way home; an opposite pair nearest the middle is where it turns, else the middle."""
    mid = len(stops) / 2
    turns = [k + 1 for k in range(len(stops) - 1) if opposite(stops[k]) == stops[k + 1]]
    half = min(turns, key=lambda k: abs(k - mid), default=-(-len(stops) // 2))
    return stops[:half], stops[half:][::-1]


def pair_rows(first: list[str], second: list[str] | None) -> list[tuple[str | None, str | None]]:
    if second is not None:
        return align(first, second[::-1])
    if len(first) < 2 or first[0] != first[-1]:
        return [(s, None) for s in first]
    out, home = split_loop(first)
    return [*align(out, home), (TURN, TURN)]


def pair_opposite_stops(patterns: DataFrame) -> DataFrame:
    """(feed, route, row, outbound, inbound, same, opposite) from the first two variants of each service.

    A single variant that ends where it starts is split at its turn; other single ones
    have no inbound stops. Each service is one row of two stop lists, and a task takes them in batches.
    """
    place = F.row_number().over(Window.partitionBy("feed_id", "route_id").orderBy("dest_rank", "variant_idx"))
    two = patterns.select("feed_id", "route_id", "stops", place.alias("k")).where("k <= 2")
    lists = two.groupBy("feed_id", "route_id").agg(*(F.max(F.when(F.col("k") == k, F.col("stops"))).alias(c) for k, c in ((1, "a"), (2, "b"))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pair_rows(a, b if b is not None and len(b) > 1 else None) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            of = pa.array([k for k, x in enumerate(got) for _ in x], pa.int64())
            out, back = ([x[c] for y in got for x in y] for c in (0, 1))
            cols = [batch["feed_id"].take(of), batch["route_id"].take(of), pa.array([i for x in got for i in range(1, len(x) + 1)], pa.int32()), pa.array(out, pa.string()), pa.array(back, pa.string())]
            same, other = ([a is not None and f(a) == b for a, b in zip(out, back, strict=True)] for f in (str, opposite))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(same, pa.bool_()), pa.array(other, pa.bool_())], names=["feed_id", "route_id", "row", "outbound", "inbound", "same", "opposite"])

    return lists.mapInArrow(rows, "feed_id string, route_id string, row int, outbound string, inbound string, same boolean, opposite boolean")
