"""Filling containers of fixed capacity with items, by histogram packing.

Method: shortest-pack-first over the length histogram.  Lengths are placed longest first, each
into the open pattern with the most room left; a pattern stands for as many equal containers as
its count says.  Afterwards patterns are joined back to items by the items' rank among those
of equal length.  The histogram has at most ``capacity`` lengths and the packing at most twice
as many patterns, whatever the number of items, so the driver's part doesn't grow with the data.

Items of length null or below 1 get no container.  Only items longer than the capacity are
split: into full containers and one rest.  Repeated ids are items of their own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvault.runtime import checkpoint, shuffle_partitions


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) and how many containers have each."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []  # heap of -room
    done: list[tuple[dict[int, int], int]] = []

    def put(pattern: dict[int, int], count: int, room: int) -> None:
        if room <= 0:
            done.append((pattern, count))
            return
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0] < length:
                # as many to a container as fit side by side; a last, less full one may follow
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put({length: each}, full, capacity - each * length)
                if rest:
                    put({length: rest}, 1, capacity - rest * length)
                break
            room = -rooms[0]
            pattern, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                heapq.heappop(rooms)
            used = min(left, count)
            if used < count:
                put(pattern, count - used, room)
            grown = dict(pattern)
            grown[length] = grown.get(length, 0) + 1
            put(grown, used, room - length)
            left -= used
    done += [x for rest in open_.values() for x in rest]
    merged: dict[tuple[tuple[int, int], ...], int] = {}
    for pattern, count in done:
        key = tuple(sorted(pattern.items(), reverse=True))
        merged[key] = merged.get(key, 0) + count
    return sorted(merged.items(), reverse=True)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, size, container_id): where every piece of every item goes.

    ``start`` and ``size`` are in the units of the capacity; an item that fits has one piece with
    piece_no 0.  Containers are numbered from 0 without gaps.
    """
    spark = items.sparkSession
    cells = shuffle_partitions(spark)
    sized = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("total")).where("total > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity)))
    pieces = sized.select("id", "total", piece.alias("piece_no")).select(
        "id",
        "piece_no",
        (F.col("piece_no") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece_no") * capacity).alias("size"),
        # a length that a third of all items have is still numbered in many tasks
        F.pmod(F.xxhash64("id", "piece_no"), F.lit(cells)).cast("int").alias("cell"),
    )
    pieces = checkpoint(pieces)
    counts = pieces.groupBy("size", "cell").agg(F.count("*").alias("n"))
    histogram = {int(r["size"]): int(r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(shortest_pack_first(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = (
        pieces.withColumn("r", F.row_number().over(Window.partitionBy("size", "cell").orderBy("id", "piece_no")) - 1)
        .join(offsets, ["size", "cell"])
        .select("id", "piece_no", "start", "size", (F.col("r") + F.col("before")).alias("rank"))
    )

    def place(batches):
        length, first, base, times = slots.value
        for b in batches:
            size = b.column(3).to_numpy()
            rank = b.column(4).to_numpy()
            # ranges are ordered by (length, first rank)
            i = np.searchsorted(_key(length, first), _key(size, rank), side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(base[i] + (rank - first[i]) // times[i])], ["id", "piece_no", "start", "size", "container_id"])

    kind = dict(pieces.dtypes)["id"]
    return ranked.mapInArrow(place, f"id {kind}, piece_no long, start long, size long, container_id long")


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length.astype(np.int64) << 44) + rank.astype(np.int64)


def _slots(patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of ranks for each length: (length, first rank, first container, items of it in each container)."""
    rows: list[tuple[int, int, int, int]] = []
    taken: dict[int, int] = {}
    container = 0
    for pattern, count in patterns:
        for length, times in pattern:
            rows.append((length, taken.get(length, 0), container, times))
            taken[length] = taken.get(length, 0) + count * times
        container += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, filled, least_containers, unused): one row; no packing can do with fewer than ``least_containers``, ``unused`` is the share of all room that is left."""
    n = packed.groupBy("container_id").agg(F.sum("size").alias("filled")).agg(F.count("*").alias("containers"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"))
    room = F.col("containers") * capacity
    return n.select("containers", "filled", F.ceil(F.col("filled") / capacity).alias("least_containers"), F.when(room > 0, 1 - F.col("filled") / room).otherwise(0.0).alias("unused"))
