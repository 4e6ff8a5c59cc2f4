"""Bloom filters sized by the number of their keys, built by region in the cluster.

A key belongs to one region of the filter and all its probes lie there, so every task makes one
slice and the driver gets each slice once.  A filter is broadcast only up to ``MOST_BITS``; for
more keys :func:`build` gives None, and callers join with the keys instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvault.llm.units import mix

_U = np.uint64
#: Bits for each key, and the largest filter that is broadcast (32 MB, 22 million keys).
BITS_PER_KEY = 12
MOST_BITS = 1 << 28
_REGION_BITS = 1 << 19
_PROBES = 4


class Filter:
    def __init__(self, bits: np.ndarray, regions: int):
        self.bits, self.regions = bits, regions

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """False where a key is surely not in the filter."""
        region, cells = _cells(keys, self.regions)
        ok = np.ones(len(keys), dtype=bool)
        for c in cells:
            at = region * _REGION_BITS + c
            ok &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok


def _cells(keys: np.ndarray, regions: int) -> tuple[np.ndarray, list[np.ndarray]]:
    h = mix(keys.astype(_U) ^ _U(0x8CB92BA72F3D8DD7))
    step = mix(h) | _U(1)
    return ((h >> _U(40)) % _U(regions)).astype(np.int64), [((h + _U(i) * step) & _U(_REGION_BITS - 1)).astype(np.int64) for i in range(_PROBES)]


def longs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(_U)


def build(keys: DataFrame, count: int | None = None, hashes: Callable[[pa.RecordBatch], np.ndarray] = longs) -> Filter | None:
    """Filter over the keys that ``hashes`` finds in the batches of ``keys`` (its one long column if not said otherwise).

    ``count``: how many keys there are at most; counted where it isn't given.  None: too many to broadcast.
    """
    count = keys.count() if count is None else count
    if count * BITS_PER_KEY > MOST_BITS:
        return None
    regions = max(1, -(-count * BITS_PER_KEY // _REGION_BITS))

    def deal(batches):
        for b in batches:
            own = np.unique(hashes(b))
            region = _cells(own, regions)[0]
            order = np.argsort(region, kind="stable")
            own, region = own[order], region[order]
            at = np.flatnonzero(np.r_[True, region[1:] != region[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(region[at], pa.int32()), pa.array([own[a:e].tobytes() for a, e in zip(at, np.r_[at[1:], len(own)])], pa.binary())], ["region", "keys"])

    def fill(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column(0).to_pylist(), b.column(1)):
                bits = made.setdefault(r, np.zeros(_REGION_BITS, dtype=bool))
                for c in _cells(np.frombuffer(v.as_buffer(), dtype="<u8"), regions)[1]:
                    bits[c] = True
        for r, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["region", "keys"])

    total = np.zeros(regions * _REGION_BITS // 8, dtype=np.uint8)
    width = _REGION_BITS // 8
    for row in keys.mapInArrow(deal, "region int, keys binary").repartition(min(regions, 64), "region").mapInArrow(fill, "region int, keys binary").collect():
        total[row.region * width : (row.region + 1) * width] = np.frombuffer(row["keys"], dtype=np.uint8)
    return Filter(total, regions)
