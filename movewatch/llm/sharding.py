"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has a number of points on a ring, and a row belongs to the first point at or
after its own position. A shard takes no more rows than its capacity: rows that meet a full
shard go on clockwise to the next point of one that has room. With the capacities set to
equal shares, row counts differ by one at most, whatever the data.

Only how many rows lie in each of ``cells`` equal parts of the ring decides who overflows,
so that is all the driver sees: a table of at most ``cells`` counts, however large the input
is. The walk turns it into ranges (cell, first rank, last rank) -> shard, of at most
cells + shards * points rows, and every row finds its range by its rank within its cell.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewatch.llm.common import free_name

CELL_BITS = 16
POINTS = 64


class Range(NamedTuple):
    """Ranks ``low`` up to, not including, ``high`` of a cell: their shard, and the slot of the first."""

    cell: int
    low: int
    high: int
    shard: int
    slot: int


def ring(shards: int, points: int = POINTS, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """The (cell, shard) of every virtual node, in ring order."""
    def cell(shard: int, point: int) -> int:
        digest = hashlib.sha256(f"shard {shard} point {point}".encode()).digest()
        return int.from_bytes(digest[:8], "big") >> (64 - cell_bits)
    return sorted((cell(s, p), s) for s in range(shards) for p in range(points))


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[Range]:
    """Where the rows of each cell go. In every round each node takes what waits at it, in ring
    order, as far as its shard has room; the rest moves on to the next node."""
    starts = [cell for cell, _ in nodes]
    waiting: list[deque] = [deque() for _ in nodes]
    for cell in sorted(counts):
        waiting[bisect.bisect_left(starts, cell) % len(nodes)].append((cell, 0, counts[cell]))
    room, taken, out = list(capacity), [0] * len(capacity), []
    while any(waiting):
        moved: list[deque] = [deque() for _ in nodes]
        for at, ((_, shard), queue) in enumerate(zip(nodes, waiting)):
            for cell, low, high in queue:
                fits = min(high - low, room[shard])
                if fits:
                    out.append(Range(cell, low, low + fits, shard, taken[shard]))
                    room[shard] -= fits
                    taken[shard] += fits
                if low + fits < high:
                    moved[(at + 1) % len(nodes)].append((cell, low + fits, high))
        waiting = moved
    return out


def equal_shares(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def position(by: Sequence[str]) -> Column:
    """A row's place on the ring, 63 bits: from all columns, so that many rows of one id lie all around it."""
    return F.shiftrightunsigned(F.xxhash64(*by), 1)


def assign(
    df: DataFrame, shards: int, by: Sequence[str] = ("doc_id", "text"), points: int = POINTS, cell_bits: int = CELL_BITS
) -> DataFrame:
    """``df`` with ``shard`` (0 up to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    ``by`` names the columns that make a row's place, null or not. Columns called shard or slot are replaced. Rows that
    agree in all of ``by`` lie in one place and may swap slots; nothing else depends on the order of the input. An empty
    table gives an empty one.
    """
    df = df.drop("shard", "slot")
    place, cell, rank = (free_name(df, c) for c in ("_place", "_cell", "_rank"))
    home = F.shiftright(position(by), 63 - cell_bits).cast("int")
    counts = {r[0]: r[1] for r in df.groupBy(home.alias("cell")).count().collect()}
    ranges = walk(counts, ring(shards, points, cell_bits), equal_shares(sum(counts.values()), shards))
    low, high, bound = (free_name(df, c) for c in ("_low", "_high", "_bound"))
    bounds = df.sparkSession.createDataFrame(ranges, f"{bound} int, {low} long, {high} long, shard int, slot long")
    order = Window.partitionBy(cell).orderBy(place, *by)
    placed = df.withColumns({place: position(by), cell: home}).withColumn(rank, F.row_number().over(order) - F.lit(1))
    found = (F.col(cell) == F.col(bound)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high))
    # the ranges are bounded by cells + shards * points rows, whatever the input
    return (
        placed.join(F.broadcast(bounds), found)
        .withColumn("slot", F.col("slot") + F.col(rank) - F.col(low))
        .drop(place, cell, rank, bound, low, high)
    )
