"""Near-duplicate records: an exact set-similarity join over word shingles.

Method: grouped prefix join.  Shingles are ordered by a count over all records, rare ones first.
Two sets of at least the wanted Jaccard similarity must share tokens in their prefixes of that
order; records with identical prefix and size form one group, groups are joined on prefix tokens
(a group of several classes also with itself), and only the members of surviving group pairs are
verified on their whole sets.

Nulls and texts of fewer than ``least_units`` units are similar to nothing.  Exact copies
are one class and are compared once.  Repeated ids are kept as they come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvault.llm import bloom
from corvault.llm.postings import BLOCK_SCHEMA, INDEX, PROBE, BlockWriter, bucket_count, cells_for, expanded, frequency_sketch, joined, text_batches
from corvault.llm.units import mix, shingle_hashes, shingle_sets, unit_hashes
from corvault.runtime import checkpoint, release, shuffle_partitions

_U = np.uint64
#: Shared prefix tokens that a pair must have; prefixes are longer by one less.
HITS = 4
#: Classes of a group that one task holds; larger groups are dealt to several cells.
CELL = 512
#: Keys that a task remembers so as to send copies once; what it forgets is sent again and counts once all the same.
_SEEN = 500_000


class Sets:
    """Shingle sets of a batch in the common order, with the keys of their groups and classes."""

    def __init__(self, texts, sketch, threshold, k, least_units):
        h, owner, _ = shingle_sets(texts, k, least_units)
        self.h, self.owner = h, owner
        self.n = np.bincount(owner, minlength=len(texts))
        self.at = np.r_[0, np.cumsum(self.n)]
        if sketch is not None:
            h = h[np.lexsort((h, sketch.count(h), owner))]
        pos = np.arange(len(h)) - self.at[owner]
        need = np.ceil(threshold * self.n - 1e-9).astype(np.int64)
        self.prefix = np.minimum(self.n, self.n - need + HITS)
        inside = pos < self.prefix[owner]
        self.token, self.token_owner, self.pos = h[inside], owner[inside], pos[inside]
        self.group = _digest(self.token, self.token_owner, len(texts), self.n)
        self.key = _digest(self.h, self.owner, len(texts), self.n)


def _digest(h: np.ndarray, owner: np.ndarray, texts: int, n: np.ndarray) -> np.ndarray:
    """An order-free 64-bit digest of the hashes of each text."""
    v = mix(h ^ _U(0xA0761D6478BD642F))
    run = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(v, out=run[1:])
    at = np.searchsorted(owner, np.arange(texts + 1))
    return mix(run[at[1:]] - run[at[:-1]] + n.astype(_U) * _U(0xE7037ED1A0B428DB))


def fresh(keys: np.ndarray, seen: set[int], where: np.ndarray) -> np.ndarray:
    """Which of the rows ``where`` hold a key that the task sees for the first time."""
    out = np.zeros(len(keys), dtype=bool)
    for i, k in zip(where.tolist(), keys[where].tolist()):
        if k not in seen:
            out[i] = True
            if len(seen) < _SEEN:
                seen.add(k)
    return out


def _pair_rule(threshold: float):
    total = threshold / (1 + threshold)

    def rule(na, nb, pa_, pb, fa, fb, role_a, role_b):
        need = np.ceil(total * (na + nb) - 1e-9).astype(np.int64)
        a_small = na <= nb
        small = np.minimum(na, nb)
        indexed = np.where(a_small, pa_, pb) < small - np.ceil(2 * total * small - 1e-9) + HITS
        role_small, role_large = np.where(a_small, role_a, role_b), np.where(a_small, role_b, role_a)
        keep = indexed & (role_small != PROBE) & (role_large != INDEX)
        keep &= small >= np.ceil(threshold * np.maximum(na, nb) - 1e-9)
        keep &= np.minimum(na - pa_, nb - pb) + HITS - 1 >= need
        return keep, np.ones(len(na), dtype=np.int64), np.minimum(need, HITS)

    return rule


def class_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, least_units: int = 20) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal shingle sets, and the members of every class.

    Returns (pairs: key_a, key_b, similarity; members: id, key).  ``pairs`` has every two different
    classes whose Jaccard similarity over sets of ``k`` consecutive units is at least ``threshold``.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def plain(texts):
        units, at = unit_hashes(texts)
        h, owner = shingle_hashes(units, at, k)
        return h[np.diff(at)[owner] >= least_units]

    length = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    made = frequency_sketch(rows, plain, cells=cells_for(length))
    buckets = bucket_count(rows, made.total)
    sketch = spark.sparkContext.broadcast(made)
    release(spark)

    def post(batches):
        out = BlockWriter(buckets, sketch.value)
        groups: set[int] = set()
        classes: set[int] = set()
        for _, texts in text_batches(batches):
            s = Sets(texts, sketch.value, threshold, k, least_units)
            some = np.flatnonzero(s.n)
            own = fresh(s.key, classes, some)
            out.members(s.group[own], s.key[own])
            # copies, and members of one group, are sent once
            m = fresh(s.group, groups, some)[s.token_owner]
            yield from out.add(s.token[m], s.token_owner[m], s.pos[m], s.group, s.n)
        yield from out.flush()

    groups_ = checkpoint(joined(rows.select("text").mapInArrow(post, BLOCK_SCHEMA), buckets, _pair_rule(threshold)).select("k1", "k2"))
    release(spark)
    return _confirmed(rows, groups_, threshold, k, least_units, sketch)


def _described(rows: DataFrame, sketch, wanted: bloom.Filter | None, every: bool, threshold: float, k: int, least_units: int) -> DataFrame:
    """(id, key, grp, n, bits, shingles) of every record with a set; bits and shingles where the group may be wanted, once for each task."""
    spark = rows.sparkSession
    wanted_ = spark.sparkContext.broadcast(wanted)

    def describe(batches):
        seen: set[int] = set()
        for b, texts in text_batches(batches):
            s = Sets(texts, sketch.value, threshold, k, least_units)
            has = np.flatnonzero(s.n)
            hit = np.full(len(has), every) if wanted_.value is None else wanted_.value.maybe(s.group[has])
            first = fresh(s.key, seen, has[hit])
            own = [s.h[s.at[i] : s.at[i + 1]] if first[i] else None for i in has.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(has)),
                    pa.array(s.key[has].view(np.int64)),
                    pa.array(s.group[has].view(np.int64)),
                    pa.array(s.n[has].astype(np.int32)),
                    pa.array([None if h is None else _parity_bits(h) for h in own], pa.binary()),
                    pa.array([None if h is None else np.sort((h >> _U(32)).astype(np.uint32)).tobytes() for h in own], pa.binary()),
                ],
                ["id", "key", "grp", "n", "bits", "shingles"],
            )

    described = checkpoint(rows.select("id", "text").mapInArrow(describe, "id long, key long, grp long, n int, bits binary, shingles binary"))
    release(spark)
    return described


def _confirmed(rows: DataFrame, candidates: DataFrame, threshold: float, k: int, least_units: int, sketch) -> tuple[DataFrame, DataFrame]:
    """Verifies the members of candidate pairs of groups (k1, k2) on their whole shingle sets."""
    spark = rows.sparkSession
    asked = candidates.select(F.explode(F.array("k1", "k2")).alias("k")).distinct()
    wanted = bloom.build(asked)
    described = detail = _described(rows, sketch, wanted, False, threshold, k, least_units)
    if wanted is None:
        # too many groups to broadcast: one record of each wanted class is sent through the shuffle and described again
        chosen = described.join(asked.withColumnRenamed("k", "grp"), "grp", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
        detail = _described(rows.join(chosen.select("id"), "id", "left_semi"), sketch, None, True, threshold, k, least_units)
    members = described.select("id", "key")
    parts = shuffle_partitions(spark)
    # groups of many classes are dealt to cells, their pairs to pairs of cells; the table of such groups is small or else shuffled
    hot = detail.where("bits is not null").select("grp", "key").distinct().groupBy("grp").agg(F.count("*").alias("m"))
    hot = checkpoint(hot.where(F.col("m") > CELL).select("grp", F.ceil(F.col("m") / CELL).cast("int").alias("s")))
    cell = F.when(F.col("s").isNull(), 0).otherwise(F.pmod("key", F.col("s"))).cast("int")
    placed = detail.where("bits is not null").select("grp", "key", "n", "bits").join(hot, "grp", "left").select("grp", cell.alias("cell"), "key", "n", "bits")
    # partitioned by group and cell only, so that neither the aggregation nor the joins move the bits again
    first = placed.repartition(parts, "grp", "cell").groupBy("grp", "cell", "key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    left = first.select(F.col("grp").alias("k1"), F.col("cell").alias("c1"), F.col("key").alias("key_a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = first.select(F.col("grp").alias("k2"), F.col("cell").alias("c2"), F.col("key").alias("key_b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    cells = lambda s: F.explode(F.sequence(F.lit(0), F.coalesce(s, F.lit(1)) - 1))
    dealt = candidates.join(hot.toDF("k1", "s1"), "k1", "left").join(hot.toDF("k2", "s2"), "k2", "left")
    dealt = dealt.select("k1", "k2", "s2", cells(F.col("s1")).alias("c1")).select("k1", "k2", "c1", cells(F.col("s2")).alias("c2")).where("k1 != k2 or c1 <= c2")
    maybe = dealt.join(left, ["k1", "c1"]).join(right, ["k2", "c2"]).where("k1 != k2 or c1 < c2 or key_a < key_b").select("key_a", "key_b", "na", "nb", "ba", "bb")
    close = checkpoint(maybe.mapInArrow(lambda batches: _close(batches, threshold), "key_a long, key_b long"))
    release(spark)
    return verified(close, detail.where("shingles is not null").select("key", "shingles"), threshold), members


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key_a, key_b, similarity) of the pairs whose sets (key, shingles) are similar enough; a class may have its set more than once."""
    spark = pairs.sparkSession
    asked = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    linked = bloom.build(asked)
    if linked is None:
        sets = sets.join(asked, "key", "left_semi")
    else:
        linked_ = spark.sparkContext.broadcast(linked)

        def of_links(batches):
            for b in batches:
                yield b.filter(pa.array(linked_.value.maybe(b.column(0).to_numpy().view(_U))))

        sets = sets.select("key", "shingles").mapInArrow(of_links, "key long, shingles binary")
    classes = sets.repartition(shuffle_partitions(spark), "key").groupBy("key").agg(F.first("shingles").alias("shingles"))
    both = (
        pairs.select("key_a", "key_b")
        .join(classes.select(F.col("key").alias("key_a"), F.col("shingles").alias("sa")), "key_a")
        .join(classes.select(F.col("key").alias("key_b"), F.col("shingles").alias("sb")), "key_b")
        .select("key_a", "key_b", "sa", "sb")
    )
    return both.mapInArrow(lambda batches: _verified(batches, threshold), "key_a long, key_b long, similarity double")


def _parity_bits(h: np.ndarray) -> bytes:
    """Parity of the shingles in each of a power of two of cells, at least four for each shingle."""
    cells = max(64, 1 << (4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & _U(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def _close(batches, threshold):
    """Drops pairs that surely differ too much: two sets differ in at least as many elements as their parity bits do."""
    for b in batches:
        keep = []
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        most = np.floor((1 - threshold) / (1 + threshold) * (na + nb) + 1e-9)
        for i, (x, y) in enumerate(zip(b.column(4), b.column(5))):
            x, y = int.from_bytes(x.as_py(), "little"), int.from_bytes(y.as_py(), "little")
            wide_x, wide_y = b.column(4)[i].as_buffer().size * 8, b.column(5)[i].as_buffer().size * 8
            while wide_x != wide_y:
                if wide_x > wide_y:
                    wide_x //= 2
                    x = (x >> wide_x) ^ (x & ((1 << wide_x) - 1))
                else:
                    wide_y //= 2
                    y = (y >> wide_y) ^ (y & ((1 << wide_y) - 1))
            if (x ^ y).bit_count() <= most[i]:
                keep.append(i)
        kept = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept)], ["key_a", "key_b"])


def _verified(batches, threshold):
    for b in batches:
        keep, sims = [], []
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint32), np.frombuffer(y.as_buffer(), dtype=np.uint32)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            sim = shared / (len(x) + len(y) - shared)
            if sim >= threshold:
                keep.append(i)
                sims.append(sim)
        kept = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), pa.array(sims, pa.float64())], ["key_a", "key_b", "similarity"])


def similar_rows(rows: DataFrame, id_col: str, text_col: str, threshold: float, k: int, least_units: int = 20) -> DataFrame:
    """Every pair of different rows (id_a < id_b) of at least the given similarity, copies written out."""
    pairs, members = class_pairs(rows, id_col, text_col, threshold, k, least_units)
    return rows_of(pairs, members)


def rows_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the members of linked classes, and of each class of copies."""
    copies = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    linked = checkpoint(pairs.select("key_a", "key_b").unionByName(copies))
    release(pairs.sparkSession)
    return expanded(linked, members).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def groups(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, least_units: int = 20) -> DataFrame:
    """One row for each record with at least one set: id, class_id (smallest id of its group), links.

    Groups are the connected components of the links; ``links`` counts the other classes that a
    record's class is linked to, plus the copies of its own class.  Records too short for the
    similarity are groups of one.
    """
    pairs, members = class_pairs(rows, id_col, text_col, threshold, k, least_units)
    pairs = checkpoint(pairs.select("key_a", "key_b"))
    reps = members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    edges = (
        pairs.join(reps.select(F.col("key").alias("key_a"), F.col("first").alias("u")), "key_a")
        .join(reps.select(F.col("key").alias("key_b"), F.col("first").alias("v")), "key_b")
        .select("u", "v")
    )
    label = components(edges)
    degree = edges.select(F.explode(F.array("u", "v")).alias("first")).groupBy("first").agg(F.count("*").alias("others"))
    known = (
        members.join(reps, "key")
        .join(label, "first", "left")
        .join(degree, "first", "left")
        .select("id", F.coalesce("label", "first").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    rest = rows.select(F.col(id_col).cast("long").alias("id")).where("id is not null").join(members.select("id"), "id", "left_anti")
    return known.unionByName(rest.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def components(edges: DataFrame) -> DataFrame:
    """(first, label): the smallest vertex of each vertex's component, by alternating star contraction."""
    e = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # large star: larger neighbours go to the smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the vertex itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        new = checkpoint(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.groupBy(F.col("u").alias("first")).agg(F.min("v").alias("label")).unionByName(
                new.select(F.col("v").alias("first"), F.col("v").alias("label")).distinct()
            )
        e = new
