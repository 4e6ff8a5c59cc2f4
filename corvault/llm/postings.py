"""Inverted-index joins on 64-bit tokens, carried through the shuffle as binary blocks.

A posting says that a record holds a token.  Instead of a row for each posting, every map task
sends one binary block for each bucket, with the postings of a record together, so the record's
key isn't repeated.  A reducer takes one bucket at a time and joins with numpy; the number of
buckets follows the number of postings, so its memory doesn't grow with the data.  Tokens that
are hot by the frequency sketch are spread over a grid of cells, as large as their counts ask
for: no task gets an unbounded group, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvault.llm.units import mix
from corvault.runtime import shuffle_partitions

_U = np.uint64

#: Cells of the frequency sketch at least and at most (uint32: 8 and 256 MB), and tokens for each cell in between.
CELLS, MOST_CELLS, PER_CELL = 1 << 21, 1 << 26, 64
_SKETCH_BLOCK = 1 << 16
#: Tokens that a task counts at once, and tasks that add up the counts at most (4 MB of the largest sketch each).
_SKETCH_HELD, _SKETCH_TASKS = 4_000_000, 64
#: Kinds of partial counts: places and counts, all counts of 16 bits, all counts of 32 bits.
_FEW, _NARROW, _WIDE = b"\0\0", b"\2\0", b"\4\0"
#: A token with more records than this is spread over a grid of cells, each with about as many on a side.
HOT = 20_000
#: Postings that a bucket should hold.
PER_BUCKET = 4_000_000
#: Code points that are hashed in one step.
STEP = 500_000

BLOCK_SCHEMA = "bucket int, block binary"
SKETCH_SCHEMA = "at int, counts binary"
PAIR_SCHEMA = "k1 long, k2 long, hits long, need long"

BOTH, INDEX, PROBE = 0, 1, 2
_MEMBERS = 255


def slices(texts: list[str | None], step: int = STEP) -> Iterator[slice]:
    """Consecutive slices of ``texts`` of about ``step`` code points each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= step:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def text_batches(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        texts = b.column(b.schema.get_field_index(text)).to_pylist()
        for s in slices(texts):
            yield b.slice(s.start, s.stop - s.start), texts[s]


class Sketch:
    """Counts of hashed tokens; a count is never too small."""

    def __init__(self, cells: np.ndarray, total: int):
        self.cells, self.total = cells, total

    def count(self, tokens: np.ndarray) -> np.ndarray:
        return self.cells[(tokens & _U(len(self.cells) - 1)).astype(np.int64)]


def counted(rows: DataFrame, tokens: Callable[[list[str | None]], np.ndarray], text: str = "text", cells: int = CELLS) -> DataFrame:
    """(at, counts): the cells of a sketch over all rows of ``rows``, in stretches of uint32 from cell ``at`` on; stretches of zeros are left out.

    Every row counts.  Tasks send partial counts by stretch, only of the cells that they met where these are few, so what
    a task sends follows its tokens and not ``cells`` (see :func:`cells_for`).  They are added up in the cluster.
    """
    size = min(cells, _SKETCH_BLOCK)

    def count(batches):
        held, many = [], 0
        for _, texts in text_batches(batches, text):
            t = tokens(texts)
            held.append((t & _U(cells - 1)).astype("<u4"))
            many += len(t)
            if many >= _SKETCH_HELD:
                yield from _partial(np.concatenate(held), size)
                held, many = [], 0
        if many:
            yield from _partial(np.concatenate(held), size)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if k not in total:
                    total[k] = np.zeros(size, dtype=np.int64)
                _add(total[k], np.frombuffer(blob.as_buffer(), dtype=np.uint8))
        for k, v in total.items():
            cut = np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k * size], pa.int32()), pa.array([cut], pa.binary())], ["at", "counts"])

    parts = rows.select(text).mapInArrow(count, BLOCK_SCHEMA)
    return parts.repartition(min(cells // size, shuffle_partitions(rows.sparkSession), _SKETCH_TASKS), "bucket").mapInArrow(add, SKETCH_SCHEMA)


def gathered(stretches: DataFrame, cells: int) -> np.ndarray:
    """The cells of the stretches (at, counts), which come to the driver a partition at a time."""
    found = np.zeros(cells, dtype=np.uint32)
    for row in stretches.toLocalIterator():
        part = np.frombuffer(row.counts, dtype="<u4")
        found[row.at : row.at + len(part)] = part
    return found


def frequency_sketch(rows: DataFrame, tokens: Callable[[list[str | None]], np.ndarray], text: str = "text", cells: int = CELLS) -> Sketch:
    """Counts of hashed tokens over all rows of ``rows``; the driver gets ``cells`` numbers.

    A sketch fixes the order in which tokens are looked up and the size of the grids, so collisions
    cost time and never results.
    """
    found = gathered(counted(rows, tokens, text, cells), cells)
    return Sketch(found, int(found.sum(dtype=np.int64)))


def _partial(met: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the cells ``met``, a block for each stretch of ``size``: of few cells their places and counts, else the counts of all."""
    cell, n = np.unique(met, return_counts=True)
    at = np.flatnonzero(np.r_[True, cell[1:] // size != cell[:-1] // size])
    bucket, blocks = (cell[at] // size).astype(np.int32), []
    for a, e in zip(at, np.r_[at[1:], len(cell)]):
        place, own = cell[a:e] % size, n[a:e]
        wide = own.max() >= 1 << 16
        if not wide and 2 * len(place) < size:
            blocks.append(_FEW + place.astype("<u2").tobytes() + own.astype("<u2").tobytes())
        else:
            full = np.zeros(size, dtype="<u4" if wide else "<u2")
            full[place] = own
            blocks.append((_WIDE if wide else _NARROW) + full.tobytes())
    for a in range(0, len(blocks), _SKETCH_TASKS):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + _SKETCH_TASKS]), pa.array(blocks[a : a + _SKETCH_TASKS], pa.binary())], ["bucket", "block"])


def _add(total: np.ndarray, raw: np.ndarray) -> None:
    kind, raw = raw[:2].tobytes(), raw[2:]
    if kind == _FEW:
        place, n = raw.view("<u2").reshape(2, -1)
        total[place] += n
    else:
        total += raw.view("<u4" if kind == _WIDE else "<u2")


def cells_for(code_points: int) -> int:
    """Cells of a sketch over so many code points: a power of two between ``CELLS`` and ``MOST_CELLS``."""
    return min(MOST_CELLS, max(CELLS, 1 << max(0, code_points // PER_CELL).bit_length()))


def bucket_count(df: DataFrame, postings: int) -> int:
    """Buckets, and so partitions, for so many postings."""
    return max(shuffle_partitions(df.sparkSession), -(-postings // PER_BUCKET))


class BlockWriter:
    """Collects postings and gives them out as one block for each bucket.

    A block is: numbers of records and postings and the flags; of each record its key, its size and
    its number of postings; of each posting 32 bits of the token and its position.  Positions
    and counts are split into low and high halves, as the high ones are zeros that compress.
    """

    def __init__(self, buckets: int, sketch: Sketch | None, limit: int = 1_500_000):
        self.buckets, self.sketch, self.limit = buckets, sketch, limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.records: list[tuple[np.ndarray, np.ndarray]] = []
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.known = 0

    def add(self, token: np.ndarray, owner: np.ndarray, pos: np.ndarray, key: np.ndarray, n: np.ndarray, flags: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Postings (token, number of its record, position); of the records the key, the size and two bits for the caller."""
        flag = np.zeros(len(token), dtype=np.int64) if flags is None else flags[owner]
        x = flag << 2
        if self.sketch is not None and len(token):
            share = self.sketch.count(token).astype(np.int64) // HOT + 1
            hot = np.flatnonzero(share > 1)
            if len(hot):
                s = share[hot]
                of = np.repeat(hot, 2 * s)
                s = np.repeat(s, 2 * s)
                within = np.arange(len(of)) - np.repeat(np.cumsum(2 * share[hot]) - 2 * share[hot], 2 * share[hot])
                own = (key[owner[of]] % s.astype(_U)).astype(np.int64)
                first = within < s
                cell = np.where(first, own * s + within, (within - s) * s + own)
                cold = np.flatnonzero(share == 1)
                token = np.r_[token[cold], mix(token[of] + (cell.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))]
                x = np.r_[x[cold], x[of] | np.where(first, INDEX, PROBE)]
                owner, pos = np.r_[owner[cold], owner[of]], np.r_[pos[cold], pos[of]]
        self.parts.append((((token >> _U(32)) % _U(self.buckets)).astype(np.int32), x.astype(np.int32), (owner + self.known).astype(np.int32), (token & _U(0xFFFFFFFF)).astype("<u4"), pos.astype("<u4")))
        self.records.append((key.astype("<u8"), n.astype("<u4")))
        self.known += len(key)
        self.held += len(token)
        if self.held >= self.limit:
            yield from self.flush()

    def members(self, group: np.ndarray, key: np.ndarray) -> None:
        """Says which classes belong to which groups; groups of two classes or more come out as pairs with themselves."""
        self.groups.append((group, key))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            bucket, x, rec, t, pos = (np.concatenate([p[i] for p in self.parts]) for i in range(5))
            key, n = (np.concatenate([p[i] for p in self.records]) for i in range(2))
            order = np.lexsort((rec, x, bucket))
            bucket, x, rec, t, pos = bucket[order], x[order], rec[order], t[order], pos[order]
            at = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1])])
            blocks = [_block(rec[a:e], t[a:e], pos[a:e], int(x[a]), key, n) for a, e in zip(at, np.r_[at[1:], len(t)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(blocks, pa.binary())], ["bucket", "block"])
        if self.groups:
            g, low, high = _extremes(*(np.concatenate([p[i] for p in self.groups]) for i in (0, 1, 1)))
            bucket = ((g >> _U(32)) % _U(self.buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, g, low, high = bucket[order], g[order], low[order], high[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blocks = [np.array([e - a, 0, _MEMBERS], dtype="<u4").tobytes() + g[a:e].tobytes() + low[a:e].tobytes() + high[a:e].tobytes() for a, e in zip(at, np.r_[at[1:], len(g)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(blocks, pa.binary())], ["bucket", "block"])
        self.parts, self.records, self.groups, self.held, self.known = [], [], [], 0, 0


def _extremes(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least and the greatest class of each group."""
    order = np.argsort(group, kind="stable")
    group, low, high = group[order], low[order], high[order]
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return group[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def _halves(v: np.ndarray) -> bytes:
    return (v & 0xFFFF).astype("<u2").tobytes() + (v >> 16).astype("<u2").tobytes()


def _whole(raw: np.ndarray) -> np.ndarray:
    half = raw.view("<u2")
    return half[: len(half) // 2].astype(np.int64) | (half[len(half) // 2 :].astype(np.int64) << 16)


def _block(rec: np.ndarray, t: np.ndarray, pos: np.ndarray, x: int, key: np.ndarray, n: np.ndarray) -> bytes:
    at = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
    own = rec[at]
    count = np.diff(np.r_[at, len(rec)])
    return b"".join([np.array([len(own), len(t), x], dtype="<u4").tobytes(), key[own].tobytes(), _halves(n[own]), _halves(count), t.tobytes(), _halves(pos)])


def opened(blob) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(flags, keys, sizes, counts, tokens, positions) of a block; None for a block of members."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    m, p, x = raw[:12].view("<u4").tolist()
    if x == _MEMBERS:
        return None
    ends = np.cumsum([12, 8 * m, 4 * m, 4 * m, 4 * p, 4 * p])
    key, n, count, t, pos = (raw[a:e] for a, e in zip(ends, ends[1:]))
    return x, key.copy().view("<u8"), _whole(n.copy()), _whole(count.copy()), t.copy().view("<u4"), _whole(pos.copy())


def filtered(blob, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> bytes | None:
    """A block with the postings for which ``keep(tokens, keys)`` is true; None if none is left."""
    x, key, n, count, t, pos = opened(blob)
    rec = np.repeat(np.arange(len(key)), count)
    ok = keep(t, key[rec])
    return _block(rec[ok], t[ok], pos[ok], x, key, n) if ok.any() else None


#: Of pairs a, b with a's key the smaller: sizes, positions, flags and roles of both; gives (keep, weight, need).
Rule = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def joined(blocks: DataFrame, buckets: int, rule: Rule) -> DataFrame:
    """Pairs of keys that share tokens, with the sum of their weights where it reaches what they need.

    Postings of one key with equal flags count once for a token.
    """

    def join(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(k, []).append(v)
        acc = _Pairs()
        for k in list(held):
            yield from _joined_bucket(held.pop(k), rule, acc)
        yield from acc.flush()

    found = blocks.repartitionById(buckets, "bucket").mapInArrow(join, PAIR_SCHEMA)
    return found.groupBy("k1", "k2").agg(F.sum("hits").alias("hits"), F.max("need").alias("need")).where("hits >= need")


def _joined_bucket(blobs: list, rule: Rule, acc: _Pairs) -> Iterator[pa.RecordBatch]:
    parts, groups = [], []
    for v in blobs:
        raw = v.as_buffer()
        got = opened(raw)
        if got is None:
            u = np.frombuffer(raw, dtype="<u8", offset=12).reshape(3, -1)
            groups.append(u)
        else:
            parts.append(got)
    if groups:
        g, low, high = _extremes(*np.concatenate(groups, axis=1))
        many = g[low != high]
        one = np.ones(len(many), dtype=np.int64)
        yield from acc.put(many, many, one, one)
    if not parts:
        return
    key, rec = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    size = np.zeros(len(key), dtype=np.int64)
    size[rec] = np.concatenate([p[2] for p in parts])
    rec = np.repeat(rec, np.concatenate([p[3] for p in parts]))
    x = np.repeat([p[0] for p in parts], [len(p[4]) for p in parts]).astype(np.int64)
    t = np.concatenate([p[4] for p in parts])
    pos = np.concatenate([p[5] for p in parts])
    parts.clear()
    # one number to sort by: token, record, flags
    mark = (t.astype(_U) << _U(32)) | (rec.astype(_U) << _U(4)) | x.astype(_U)
    order = np.argsort(mark, kind="stable")
    mark = mark[order]
    new = np.r_[True, mark[1:] != mark[:-1]] if len(mark) else np.zeros(0, dtype=bool)
    order = order[new]
    t, rec, x, pos = t[order], rec[order], x[order], pos[order]
    at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    length = np.diff(np.r_[at, len(t)])

    def offer(i: np.ndarray, j: np.ndarray):
        apart = rec[i] != rec[j]
        i, j = i[apart], j[apart]
        keep, weight, need = rule(size[rec[i]], size[rec[j]], pos[i], pos[j], x[i] >> 2, x[j] >> 2, x[i] & 3, x[j] & 3)
        return acc.put(key[rec[i[keep]]], key[rec[j[keep]]], weight[keep], need[keep])

    short = (length > 1) & (length <= 48)
    starts, lens = at[short], length[short]
    for d in range(1, int(lens.max(initial=1))):
        ok = lens > d
        starts, lens = starts[ok], lens[ok]
        # all (i, i + d) of every run
        reach = lens - d
        i = np.repeat(starts - np.r_[0, np.cumsum(reach)[:-1]], reach) + np.arange(reach.sum())
        for c in range(0, len(i), 1_000_000):
            yield from offer(i[c : c + 1_000_000], i[c : c + 1_000_000] + d)
    for s, ln in zip(at[length > 48].tolist(), length[length > 48].tolist()):
        rows = max(1, 1_000_000 // ln)
        for a in range(0, ln, rows):
            i, j = np.meshgrid(np.arange(a, min(ln, a + rows)), np.arange(ln), indexing="ij")
            up = j > i
            yield from offer(s + i[up], s + j[up])


class _Pairs:
    def __init__(self, limit: int = 1_000_000):
        self.parts, self.held, self.limit = [], 0, limit

    def put(self, k1: np.ndarray, k2: np.ndarray, weight: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k1):
            self.parts.append((k1, k2, weight, need))
            self.held += len(k1)
            if self.held >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        k1, k2, w, need = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        self.parts, self.held = [], 0
        order = np.lexsort((k2, k1))
        k1, k2, w, need = k1[order], k2[order], w[order], need[order]
        at = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), pa.array(np.add.reduceat(w, at)), pa.array(np.maximum.reduceat(need, at))],
            ["k1", "k2", "hits", "need"],
        )


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None, cell: int = 2_000) -> DataFrame:
    """(x, y): the members of both classes of every pair (key_a, key_b).

    ``left`` and ``right`` have (id, key).  A class with more than ``cell`` members is dealt to so
    many cells, and its pairs to pairs of cells, so no task writes out an unbounded class.  Without
    ``right``, pairs of a class with itself give each two members once.
    """
    from corvault.runtime import checkpoint

    def sized(members: DataFrame) -> DataFrame:
        return checkpoint(members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > cell).select("key", F.ceil(F.col("m") / cell).cast("int").alias("s")))

    hot = sized(left)
    hot_right = hot if right is None else sized(right)

    def dealt(members: DataFrame, hot_: DataFrame, k: str, name: str) -> DataFrame:
        return members.join(hot_, "key", "left").select(F.col("key").alias(k), F.when(F.col("s").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("s"))).cast("int").alias(f"c_{k}"), F.col("id").alias(name))

    cells = lambda s: F.explode(F.sequence(F.lit(0), F.coalesce(s, F.lit(1)) - 1))
    p = pairs.select("key_a", "key_b").join(hot.toDF("key_a", "s_a"), "key_a", "left").join(hot_right.toDF("key_b", "s_b"), "key_b", "left")
    p = p.select("key_a", "key_b", "s_b", cells(F.col("s_a")).alias("c_key_a")).select("key_a", "key_b", "c_key_a", cells(F.col("s_b")).alias("c_key_b"))
    if right is None:
        p = p.where("key_a != key_b or c_key_a <= c_key_b")
    both = p.join(dealt(left, hot, "key_a", "x"), ["key_a", "c_key_a"]).join(dealt(left if right is None else right, hot_right, "key_b", "y"), ["key_b", "c_key_b"])
    if right is None:
        both = both.where("key_a != key_b or c_key_a < c_key_b or x < y")
    return both.select("x", "y")
