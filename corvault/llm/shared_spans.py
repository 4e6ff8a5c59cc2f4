"""Long exact spans that stand in more than one record.

Method: content-defined chunking with a gear rolling hash.  A text is cut where the gear hash of
the last ``WINDOW`` code points is the least of a stretch, so cuts resist shifts: between two cuts
that lie in a common passage of two texts there are no others in either.  The stretch is so
short that every passage of ``span`` code points holds two cuts, and so a whole chunk that all
its texts have.  Chunks are deduplicated by digest; those with digests of one text only are done
with.  Around each remaining chunk the passages of ``span`` that it stands for are hashed, each
passage under one chunk only, and texts with equal hashes share them.  The work follows the
length of what is shared, not the number of pairs of texts; pairs are made only where they
are the result.

Lengths are code points.  Null texts and texts shorter than ``span`` share nothing.  Exact
copies are one class.  Results are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvault.llm import bloom
from corvault.llm.near_duplicates import fresh, rows_of
from corvault.llm.postings import BLOCK_SCHEMA, text_batches
from corvault.llm.units import code_points, mix, range_hashes
from corvault.runtime import checkpoint, release, shuffle_partitions

_U = np.uint64
#: Code points that a cut looks back on.
WINDOW = 40
#: Bytes of hashes that a bucket should hold, and records that a block of a hot passage has.
PER_BUCKET, HOT = 64_000_000, 4_000
_PLACE = 26


def gear(cp: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + g(cp[i]), cut to the bits that the last ``WINDOW`` code points set, for all i at once by doubling."""
    h = mix(cp.astype(_U) + _U(0x632BE59BD9B4E019))
    reach = 1
    while reach < WINDOW:
        up = h[:-reach] << _U(reach)
        h = h.copy()
        h[reach:] += up
        reach *= 2
    return h & _U((1 << WINDOW) - 1)


def _sliding(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i : i + width]) for every i that has as many."""
    reach = 1
    while reach * 2 <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    return np.minimum(v[: len(v) - (width - reach)], v[width - reach :]) if width > reach else v


class Chunks:
    """Chunks of a batch of texts, each with the run of passages of ``span`` that it stands for.

    ``digest``, ``owner`` (number of the text), ``cut`` (place of the first cut), ``first`` and ``count``: the
    passages that begin at ``first`` and the next places.  Places are those of all texts laid end to end.
    """

    def __init__(self, texts: list[str | None], span: int):
        texts = [t or "" for t in texts]
        self.cp, self.starts = code_points(texts)
        self.n = np.diff(self.starts) - 1
        self.key = range_hashes(self.cp, self.starts[:-1], self.starts[1:] - 1)
        self.span = span
        width = (span - WINDOW + 1) // 2
        none = np.zeros(0, dtype=np.int64)
        self.digest, self.owner, self.cut, self.first, self.count = none.astype(_U), none, none, none, none
        if len(self.cp) < span:
            return
        place = np.arange(len(self.cp))
        # a total order in which the leftmost of equal hashes is the least
        v = (mix(gear(self.cp)) >> _U(_PLACE) << _U(_PLACE)) | (place & ((1 << _PLACE) - 1)).astype(_U)
        least = (_sliding(v, width) & _U((1 << _PLACE) - 1)).astype(np.int64)
        least += np.arange(len(least)) >> _PLACE << _PLACE
        least += np.where(least < np.arange(len(least)), 1 << _PLACE, 0)
        owner = np.repeat(np.arange(len(texts)), self.n + 1)
        end = self.starts[owner + 1] - 1
        i = place[: len(least)]
        whole = (i - (WINDOW - 1) >= self.starts[owner[i]]) & (i + width <= end[i])
        cuts = np.unique(least[whole])
        q = place[place + span <= end]
        if not len(q):
            return
        cut = least[q + WINDOW - 1]
        at = np.flatnonzero(np.r_[True, (cut[1:] != cut[:-1]) | (owner[q[1:]] != owner[q[:-1]])])
        self.cut, self.first, self.owner = cut[at], q[at], owner[q[at]]
        self.count = np.diff(np.r_[at, len(q)])
        self.digest = range_hashes(self.cp, self.cut - (WINDOW - 1), cuts[np.searchsorted(cuts, self.cut) + 1] + 1)

    def passages(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen chunks all passages: number of the chunk, and the passage's hash with its digest and place beside the cut."""
        of = np.repeat(chosen, self.count[chosen])
        run = np.cumsum(self.count[chosen]) - self.count[chosen]
        begin = self.first[of] + np.arange(len(of)) - np.repeat(run, self.count[chosen])
        h = range_hashes(self.cp, begin, begin + self.span)
        return of, mix(h ^ self.digest[of] ^ mix((self.cut[of] - begin).astype(_U)))


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block for each bucket: its columns one after another."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = tuple(c[order] for c in columns)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
    blocks = [b"".join(c[a:e].tobytes() for c in columns) for a, e in zip(at, np.r_[at[1:], len(bucket)])]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _columns(blob, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(blob, dtype=np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    m = len(raw) // sum(sizes)
    ends = np.cumsum([0, *(m * s for s in sizes)])
    return [raw[a:e].copy().view(k) for a, e, k in zip(ends, ends[1:], kinds)]


def _shared_digests(rows: DataFrame, span: int, buckets: int) -> DataFrame:
    """(k): the digests (bucket and 32 bits) that chunks of two texts or more have."""

    def post(batches):
        seen: set[int] = set()
        held, size = [], 0

        def out():
            d, tag = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.lexsort((tag, d))
            d, tag = d[order], tag[order]
            new = np.r_[True, (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])]
            d, tag = d[new], tag[new]
            # of a digest two different texts are enough
            at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            last = np.r_[at[1:], len(d)] - 1
            pick = np.unique(np.r_[at, last])
            yield from _dealt((d[pick] >> _U(32)) % _U(buckets), (d[pick] & _U(0xFFFFFFFF)).astype("<u4"), tag[pick])

        for _, texts in text_batches(batches):
            c = Chunks(texts, span)
            m = fresh(c.key, seen, np.flatnonzero(c.n >= span))[c.owner]
            held.append((c.digest[m], (c.key[c.owner[m]] & _U(0xFFFFFFFF)).astype("<u4")))
            size += int(m.sum())
            if size > 1_500_000:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def meet(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(k, []).append(v.as_buffer())
        for k in list(held):
            got = [_columns(v, "<u4", "<u4") for v in held.pop(k)]
            t, tag = (np.concatenate([g[i] for g in got]) for i in range(2))
            order = np.argsort(t, kind="stable")
            t, tag = t[order], tag[order]
            at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            many = np.minimum.reduceat(tag, at) != np.maximum.reduceat(tag, at)
            yield pa.RecordBatch.from_arrays([pa.array((t[at[many]].astype(_U) | (_U(k) << _U(32))).view(np.int64))], ["k"])

    return rows.select("text").mapInArrow(post, BLOCK_SCHEMA).repartitionById(buckets, "bucket").mapInArrow(meet, "k long")


def _passages(rows: DataFrame, span: int, take, schema: str) -> tuple[DataFrame, DataFrame]:
    """(what ``take`` makes of each bucket's shared passages; members: id, key, n).

    ``take(run, key, begin)`` gets, ordered by passage and key, the number of each passage, the class of the text
    that has it and its place there; every passage is one of two classes or more.
    """
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = shuffle_partitions(spark)
    digests = max(parts, -(-chars // 80_000_000))
    known = checkpoint(_shared_digests(rows, span, digests))
    release(spark)
    shared = spark.sparkContext.broadcast(bloom.build(known))
    buckets = max(parts, -(-chars * 8 // PER_BUCKET))

    def post(batches):
        seen: set[int] = set()
        for b, texts in text_batches(batches):
            c = Chunks(texts, span)
            enough = np.flatnonzero(c.n >= span)
            m = fresh(c.key, seen, enough)[c.owner]
            if shared.value is not None:
                m &= shared.value.maybe((c.digest & _U(0xFFFFFFFF)) | ((c.digest >> _U(32)) % _U(digests) << _U(32)))
            chosen = np.flatnonzero(m)
            of, h = c.passages(chosen)
            nulls = lambda k, kind: pa.nulls(k, kind)
            # of each chunk: class, place of its first passage, number of passages; the hashes of all of them
            which = (mix(c.digest[chosen]) % _U(buckets)).astype(np.int64)
            order = np.argsort(which, kind="stable")
            chosen, which = chosen[order], which[order]
            begin = np.zeros(len(c.digest) + 1, dtype=np.int64)
            begin[1:] = np.cumsum(np.bincount(of, minlength=len(c.digest)))
            at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else which
            blocks = []
            for a, e in zip(at, np.r_[at[1:], len(which)]):
                own = chosen[a:e]
                place = np.repeat(begin[own], c.count[own]) + _within(c.count[own])
                head = np.array([len(own)], dtype="<u4").tobytes()
                blocks.append(head + c.key[c.owner[own]].tobytes() + (c.first[own] - c.starts[c.owner[own]]).astype("<u4").tobytes() + c.count[own].astype("<u2").tobytes() + h[place].tobytes())
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(which[at].astype(np.int32)), pa.array(blocks, pa.binary()), nulls(k, pa.int64()), nulls(k, pa.int64()), nulls(k, pa.int64())], ["bucket", "block", "id", "key", "n"])
            k = len(enough)
            yield pa.RecordBatch.from_arrays([nulls(k, pa.int32()), nulls(k, pa.binary()), b.column(0).take(pa.array(enough)), pa.array(c.key[enough].view(np.int64)), pa.array(c.n[enough])], ["bucket", "block", "id", "key", "n"])

    made = checkpoint(rows.select("id", "text").mapInArrow(post, "bucket int, block binary, id long, key long, n long"))

    def meet(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(k, []).append(v.as_buffer())
        for k in list(held):
            yield from _met(held.pop(k), take)

    found = made.where("block is not null").select("bucket", "block").repartitionById(buckets, "bucket").mapInArrow(meet, schema)
    return found, made.where("id is not null").select("id", "key", "n")


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _met(blobs: list, take) -> Iterator[pa.RecordBatch]:
    keys, firsts, counts, hashes = [], [], [], []
    for v in blobs:
        raw = np.frombuffer(v, dtype=np.uint8)
        m = int(raw[:4].copy().view("<u4")[0])
        ends = np.cumsum([4, 8 * m, 4 * m, 2 * m])
        keys.append(raw[ends[0] : ends[1]].copy().view("<u8"))
        firsts.append(raw[ends[1] : ends[2]].copy().view("<u4").astype(np.int64))
        counts.append(raw[ends[2] : ends[3]].copy().view("<u2").astype(np.int64))
        hashes.append(raw[ends[3] :].copy().view("<u8"))
    key, rec = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.concatenate(counts)
    begin = np.repeat(np.concatenate(firsts), count) + _within(count)
    rec, h = np.repeat(rec, count).astype(np.int32), np.concatenate(hashes)
    order = np.lexsort((rec, h))
    h, rec, begin = h[order], rec[order], begin[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    run = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(h)]))
    many = (np.minimum.reduceat(rec, at) != np.maximum.reduceat(rec, at))[run] if len(at) else run.astype(bool)
    yield from take(run[many], key[rec[many]], begin[many])


def _pairs_of(run: np.ndarray, key: np.ndarray, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(g, no, blocks, keys): the classes of each passage, in blocks; passages of the same classes once."""
    if not len(run):
        return
    new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])]
    run, key = run[new], key[new]
    at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    mark = np.add.reduceat(mix(key ^ _U(0x9FB21C651E98DF25)), at)
    _, once = np.unique(mark, return_index=True)
    ends = np.r_[at[1:], len(run)]
    g, no, blocks, keys = [], [], [], []
    for i in once.tolist():
        own = key[at[i] : ends[i]]
        k = -(-len(own) // HOT)
        for j in range(k):
            g.append(int(mark[i]))
            no.append(j)
            blocks.append(k)
            keys.append(own[j * HOT : (j + 1) * HOT].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(np.array(g, dtype=_U).view(np.int64)), pa.array(no, pa.int32()), pa.array(blocks, pa.int32()), pa.array(keys, pa.binary())], ["g", "no", "blocks", "keys"])


def _written(batches):
    """Pairs of two blocks of classes (x, y); of a block with itself each pair once."""
    for b in batches:
        for x, y, same in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
            x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
            step = max(1, 1_000_000 // max(1, len(y)))
            for a in range(0, len(x), step):
                i, j = (v.ravel() for v in np.meshgrid(np.arange(a, min(len(x), a + step)), np.arange(len(y)), indexing="ij"))
                ok = j > i if same else np.ones(len(i), dtype=bool)
                u, v = x[i[ok]], y[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v).view(np.int64)), pa.array(np.maximum(u, v).view(np.int64))], ["key_a", "key_b"])


def _long_enough(rows: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    if span < 2 * WINDOW:
        raise ValueError(f"span must be at least {2 * WINDOW}")
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where((F.length("text") >= span) & F.col("id").isNotNull())


def sharing_rows(rows: DataFrame, id_col: str, text_col: str, span: int = 120) -> DataFrame:
    """Every pair of different rows (id_a < id_b) with a common verbatim span of at least ``span``."""
    found, members = _passages(_long_enough(rows, id_col, text_col, span), span, _pairs_of, "g long, no int, blocks int, keys binary")
    found = checkpoint(found)
    release(rows.sparkSession)
    single = found.where("blocks = 1").select(F.col("keys").alias("x"), F.col("keys").alias("y"), F.lit(True).alias("same"))
    # classes of a passage that very many texts have are paired by blocks, in many tasks
    hot = found.where("blocks > 1").dropDuplicates(["g", "no"])
    other = hot.select("g", F.col("no").alias("no_b"), F.col("keys").alias("y"))
    wide = hot.join(other, "g").where("no <= no_b").select(F.col("keys").alias("x"), "y", (F.col("no") == F.col("no_b")).alias("same"))
    wide = wide.repartition(shuffle_partitions(rows.sparkSession))
    pairs = single.unionByName(wide).mapInArrow(_written, "key_a long, key_b long").distinct()
    return rows_of(pairs, members)


def _spans_of(span: int):
    def take(run: np.ndarray, key: np.ndarray, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stretches (key, s, e) that the shared passages of each class cover."""
        if not len(run):
            return
        order = np.lexsort((begin, key))
        key, begin = key[order], begin[order]
        at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (begin[1:] - begin[:-1] > span)])
        last = np.r_[at[1:], len(key)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(begin[at]), pa.array(begin[last] + span)], ["key", "s", "e"])

    return take


def shared_part(rows: DataFrame, id_col: str, text_col: str, span: int = 120) -> DataFrame:
    """(id, n_chars, shared_chars, spans): how much of each text also stands elsewhere; one row for each text of at least ``span``.

    A copy of another row is shared as a whole.
    """
    found, members = _passages(_long_enough(rows, id_col, text_col, span), span, _spans_of(span), "key long, s long, e long")
    spans = checkpoint(found.distinct())
    release(rows.sparkSession)
    copies = members.groupBy("key").agg(F.count("*").alias("copies"))
    w = Window.partitionBy("key").orderBy("s", "e")
    islands = spans.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gained = F.greatest(F.lit(0).cast("long"), F.col("e") - F.greatest("s", F.coalesce("reach", "s")))
    covered = islands.groupBy("key").agg(F.sum(gained).alias("shared"), F.sum((F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("long")).alias("islands"))
    copy = F.col("copies") > 1
    return members.join(copies.join(covered, "key", "left"), "key").select(
        "id",
        F.col("n").alias("n_chars"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_chars"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("islands", F.lit(0))).cast("long").alias("spans"),
    )
