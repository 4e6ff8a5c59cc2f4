"""New batches against all accepted history.

Method: content-defined chunking.  A rolling hash over three units sets boundaries, so that an
edit moves only the boundaries next to it; the ends of a text are boundaries too.  The chunks
between boundaries are hashed, and a persistent table (:class:`ChunkTable`) holds which record
has which chunk, with the chunk's weight in shingles.  A new batch looks its chunks up, the shared
weights of each two records are added up, rarest chunks first, and a pair is looked at if they
cover enough of the two.  Such pairs are compared exactly, on shingle sets that the table holds too, so
no text of the history is read again.  Accepted records are appended to the table.

Null texts and texts with fewer than ``least_units`` units repeat nothing and are accepted.
Rows without a batch number or an id are left out.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvault.llm import bloom
from corvault.llm.near_duplicates import _digest, fresh, verified
from corvault.llm.postings import BLOCK_SCHEMA, SKETCH_SCHEMA, BlockWriter, Sketch, bucket_count, cells_for, counted, expanded, filtered, gathered, joined, opened, text_batches
from corvault.llm.units import mix, shingle_hashes, unit_hashes
from corvault.runtime import checkpoint, release, shared_dir

_U = np.uint64
#: A shingle is a boundary if its hash is below this part of all hashes: chunks have one and a half shingles on average.
BOUNDARY = 2 / 3
#: Shared chunks must cover so much of the mean size of two records, and so much of it must be seen among the rarer chunks; the rest
#: need not be looked up.  Records at the threshold of one half share two thirds of their mean size; of 32,776 such
#: pairs of the larger check data the least covered one has 0.42.
COVERED, SEEN = 0.40, 0.06
_MOST = (1 << 24) - 1
_NEW = 1
_STAGED = "bucket int, block binary, id long, batch int, key long, n int, shingles binary"


def chunks(texts: list[str | None], k: int, least_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of each text: hash, number of the text, weight in shingles; and all shingles with their texts."""
    units, at = unit_hashes(texts)
    h, owner = shingle_hashes(units, at, k)
    keep = np.diff(at)[owner] >= least_units
    h, owner = h[keep], owner[keep]
    if not len(h):
        return h, owner, owner, h, owner
    last = np.r_[owner[1:] != owner[:-1], True]
    end = np.flatnonzero(last | (mix(h ^ _U(0x2545F4914F6CDD1D)) < _U(int(BOUNDARY * 2**64)))) + 1
    begin = np.r_[0, end[:-1]]
    run = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h, out=run[1:])
    return mix(run[end] - run[begin] + (end - begin).astype(_U)), owner[begin], end - begin, h, owner


def _once(token: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that a text has more than once count once."""
    order = np.lexsort((token, owner))
    token, owner, weight = token[order], owner[order], weight[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])] if len(token) else np.zeros(0, dtype=bool)
    return token[new], owner[new], weight[new]


class Records:
    """Of the texts of a batch: chunks in the common order, rarest first, as far as they are looked up; distinct shingles; class keys."""

    def __init__(self, texts, sketch: Sketch, threshold: float, k: int, least_units: int):
        token, owner, weight, h, of = chunks(texts, k, least_units)
        m = len(texts)
        token, owner, weight = _once(token, owner, weight)
        order = np.lexsort((token, sketch.count(token), owner))
        token, owner, weight = token[order], owner[order], weight[order]
        # what of a record's chunks is left from each one on, itself included
        rest = np.cumsum(weight[::-1])[::-1]
        after = np.r_[rest, 0][np.searchsorted(owner, np.arange(m), "right")]
        rest = rest - after[owner]
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, dtype=bool)
        self.h, of = h[new], of[new]
        self.n = np.bincount(of, minlength=m)
        self.at = np.r_[0, np.cumsum(self.n)]
        self.key = _digest(self.h, of, m, self.n)
        # the smaller of two similar records has half the larger one's size at least, so their mean is three quarters of it
        looked = rest >= np.floor((COVERED - SEEN) * 0.5 * (1 + threshold) * self.n[owner])
        self.token, self.owner = token[looked], owner[looked]
        self.place = np.minimum(rest[looked], _MOST) | (np.minimum(weight[looked], 255) << 24)


def _rule(threshold: float):
    """Pairs with a new record whose sizes allow the similarity; a chunk counts while enough is left behind it in both records."""

    def rule(na, nb, a, b, fa, fb, role_a, role_b):
        mean = (na + nb) / 2
        keep = ((fa | fb) == _NEW) & (np.minimum(na, nb) >= np.ceil(threshold * np.maximum(na, nb) - 1e-9))
        # in a grid cell a pair counts once: where the smaller key is indexed
        keep &= (role_a != 2) & (role_b != 1)
        keep &= np.minimum(a & _MOST, b & _MOST) >= np.minimum(np.floor((COVERED - SEEN) * mean), _MOST)
        return keep, np.minimum(a >> 24, b >> 24), np.maximum(1, np.floor(SEEN * mean)).astype(np.int64)

    return rule


def _tokens(b: pa.RecordBatch) -> np.ndarray:
    """Tokens of the blocks (bucket, block) as 64-bit numbers, unique to token and bucket."""
    found = [_placed(opened(v.as_buffer())[4], k) for k, v in zip(b.column(0).to_pylist(), b.column(1))]
    return np.concatenate(found) if found else np.zeros(0, dtype=_U)


def _placed(t: np.ndarray, bucket: int) -> np.ndarray:
    return t.astype(_U) | (_U(bucket) << _U(32))


class ChunkTable:
    """The persistent chunk-to-record table: a folder with the common order of chunks and one folder for each append.

    Of every accepted record it has the chunks as blocks of postings by bucket, (id, batch, key), and of every
    class of equal shingle sets the set.  An append counts once its marker is written, so one that is
    cut off leaves the table as it was.  The order is that of the first append; later ones keep to it, so
    that old and new records look up the same chunks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])
        self.buckets, self.k, self.least_units, self.threshold = meta["buckets"], meta["k"], meta["least_units"], meta["threshold"]
        cells = gathered(self.spark.read.schema(SKETCH_SCHEMA).parquet(f"{self.path}/order"), meta["cells"])
        self.sketch = spark.sparkContext.broadcast(Sketch(cells, meta["total"]))

    @classmethod
    def create(cls, rows: DataFrame, path: str, threshold: float = 0.8, k: int = 5, least_units: int = 20) -> ChunkTable:
        """A table at ``path`` with all of ``rows`` (id, text, batch) accepted."""
        spark = rows.sparkSession

        def count(texts):
            token, owner, weight, _, _ = chunks(texts, k, least_units)
            return _once(token, owner, weight)[0]

        length = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        cells = cells_for(length)
        # the tasks that add up the counts write them; from the driver they would be one task, too large to be sent
        counted(rows, count, cells=cells).write.parquet(f"{path}/order")
        release(spark)
        order = spark.read.schema(SKETCH_SCHEMA).parquet(f"{path}/order")
        total = order.mapInArrow(_sums, "n long").agg(F.sum("n")).first()[0] or 0
        meta = {"buckets": bucket_count(rows, total), "k": k, "least_units": least_units, "threshold": threshold, "cells": cells, "total": total}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
        table = cls(spark, path)
        part = table._part(table.staged(rows, 0))
        table._done(part, rows)
        return table

    def _parts(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/part-*/_DONE")) or []
        return sorted(s.getPath().getParent().toString() for s in found)

    def rows(self) -> DataFrame:
        """The table: blocks (bucket, block), records (id, batch, key) and sets (key, n, shingles); also of records that weren't accepted."""
        parts = self._parts()
        return self.spark.read.schema(_STAGED).parquet(*(f"{p}/rows" for p in parts)) if parts else self.spark.createDataFrame([], _STAGED)

    def accepted(self) -> DataFrame:
        """(id, batch, key) of all accepted records."""
        ids = self.spark.read.schema("id long").parquet(*(f"{p}/accepted" for p in self._parts())) if self._parts() else self.spark.createDataFrame([], "id long")
        return self.rows().where("id is not null").select("id", "batch", "key").join(ids.distinct(), "id", "left_semi")

    def staged(self, rows: DataFrame, flag: int) -> DataFrame:
        """``rows`` (id, text, batch) as rows of the table, in one pass over their texts."""
        buckets, threshold, k, least, sketch = self.buckets, self.threshold, self.k, self.least_units, self.sketch

        def describe(batches):
            out = BlockWriter(buckets, sketch.value)
            seen: set[int] = set()
            blank = lambda n, kind: pa.nulls(n, kind)

            def blocks(found):
                for b in found:
                    m = b.num_rows
                    yield pa.RecordBatch.from_arrays([*b.columns, blank(m, pa.int64()), blank(m, pa.int32()), blank(m, pa.int64()), blank(m, pa.int32()), blank(m, pa.binary())], ["bucket", "block", "id", "batch", "key", "n", "shingles"])

            for b, texts in text_batches(batches):
                r = Records(texts, sketch.value, threshold, k, least)
                has = np.flatnonzero(r.n)
                first = fresh(r.key, seen, has)
                m = first[r.owner]
                yield from blocks(out.add(r.token[m], r.owner[m], r.place[m], r.key, r.n, np.full(len(texts), flag)))
                sets = [(r.h[r.at[i] : r.at[i + 1]] >> _U(32)).astype(np.uint32) if first[i] else None for i in has.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        blank(len(has), pa.int32()), blank(len(has), pa.binary()), b.column(0).take(pa.array(has)), b.column(2).take(pa.array(has)), pa.array(r.key[has].view(np.int64)),
                        pa.array(r.n[has].astype(np.int32)), pa.array([None if s is None else np.sort(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["bucket", "block", "id", "batch", "key", "n", "shingles"],
                )
            yield from blocks(out.flush())

        return rows.select("id", "text", "batch").mapInArrow(describe, _STAGED)

    def _part(self, rows: DataFrame) -> str:
        path = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{path}/rows")
        return path

    def _done(self, part: str, accepted: DataFrame) -> None:
        """Makes a part count, with the ``accepted`` ones (id) of its records."""
        accepted.select("id").distinct().write.parquet(f"{part}/accepted")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{part}/_DONE")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True).close()

    def arrive(self, rows: DataFrame) -> DataFrame:
        """(accepted_id, new_id, similarity) of new records (id, text, batch), which are then appended as far as they are accepted.

        Records come in order of (batch, id).  One is a repeat if its similarity to any record accepted before it, those
        of the table first, reaches the threshold; else it is accepted.
        """
        spark = self.spark
        old, accepted = self.rows(), self.accepted()
        part = self._part(self.staged(rows, _NEW))
        new = spark.read.schema(_STAGED).parquet(f"{part}/rows")
        fresh_blocks = new.where("block is not null").select("bucket", "block")
        asked = bloom.build(fresh_blocks, _postings(fresh_blocks), _tokens)
        blocks = old.where("block is not null").select("bucket", "block")
        asked_ = spark.sparkContext.broadcast(asked)

        def hits(batches):
            # of the history only the chunks that a new record may have go through the shuffle
            for b in batches:
                kept = [_aged(v.as_buffer(), k, asked_.value) for k, v in zip(b.column(0).to_pylist(), b.column(1))]
                some = [i for i, v in enumerate(kept) if v is not None]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([kept[i] for i in some], pa.binary())], ["bucket", "block"])

        blocks = blocks.mapInArrow(hits, BLOCK_SCHEMA)
        found = checkpoint(joined(blocks.unionByName(fresh_blocks), self.buckets, _rule(self.threshold)).select(F.col("k1").alias("key_a"), F.col("k2").alias("key_b")))
        release(spark)
        sets = old.unionByName(new).where("shingles is not null").select("key", "shingles")
        pairs = checkpoint(verified(found, sets, self.threshold))
        known = accepted.select("id", "key", F.lit(True).alias("old"), "batch")
        placed = checkpoint(known.unionByName(new.where("id is not null").select("id", "key", F.lit(False).alias("old"), "batch")))
        release(spark)
        result, taken = _settled(pairs, placed)
        result = checkpoint(result)
        self._done(part, taken)
        return result


def _sums(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(v.as_buffer(), dtype="<u4").sum(dtype=np.int64)) for v in b.column(1)], pa.int64())], ["n"])


def _aged(blob, bucket: int, asked: bloom.Filter | None) -> bytes | None:
    """A block of the table as one of old records, with the postings that ``asked`` may have; all of them without a filter."""
    made = filtered(blob, lambda t, _: np.ones(len(t), dtype=bool) if asked is None else asked.maybe(_placed(t, bucket)))
    if made is None:
        return None
    head = np.frombuffer(made[:12], dtype="<u4").copy()
    head[2] &= 3
    return head.tobytes() + made[12:]


def _postings(blocks: DataFrame) -> int:
    """How many postings there are in blocks (bucket, block), from their heads."""
    number = F.expr("conv(hex(substring(block, 8, 1)) || hex(substring(block, 7, 1)) || hex(substring(block, 6, 1)) || hex(substring(block, 5, 1)), 16, 10)").cast("long")
    return blocks.agg(F.sum(number)).first()[0] or 0


def _settled(pairs: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (accepted_id, new_id, similarity) and the accepted new records (id, key), from linked classes and all records (id, key, old, batch)."""
    place = F.struct("batch", "id")
    classes = placed.groupBy("key").agg(F.bool_or("old").alias("old"), F.min(F.when(~F.col("old"), place)).alias("first"))
    # only classes that are linked to another matter for the order of acceptance
    side = lambda c: classes.select(F.col("key").alias(f"key_{c}"), F.col("first").alias(f"first_{c}"), F.col("old").alias(f"old_{c}"))
    linked = checkpoint(pairs.join(side("a"), "key_a").join(side("b"), "key_b").where("not (old_a and old_b)"))
    a_first = F.col("old_a") | (~F.col("old_b") & (F.col("first_a") < F.col("first_b")))
    forward = linked.select(
        F.when(a_first, F.col("key_a")).otherwise(F.col("key_b")).alias("early"), F.when(a_first, F.col("key_b")).otherwise(F.col("key_a")).alias("late"), (F.col("old_a") | F.col("old_b")).alias("to_old")
    )
    rejected = _rejected(forward)
    taken = checkpoint(classes.where("not old").join(rejected.select(F.col("late").alias("key")), "key", "left_anti").select("key", F.col("first.id").alias("id"), F.col("first.batch").alias("batch")))
    accepted = placed.where("old").select("key", "id", F.lit(-1).alias("batch")).unionByName(taken)
    both = pairs.select("key_a", "key_b", "similarity").unionByName(pairs.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "similarity"))
    fresh_ = placed.where("not old").select("key").distinct()
    own = fresh_.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("similarity"))
    both = both.unionByName(own)
    carried = F.struct("key", "batch", "id").alias("id")
    left, right = accepted.select("key", carried), placed.where("not old").select("key", carried)
    rows = expanded(both.select("key_a", "key_b"), left, right)
    rows = rows.select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"), F.col("x.batch").alias("b0"), F.col("x.id").alias("accepted_id"), F.col("y.batch").alias("b1"), F.col("y.id").alias("new_id"))
    rows = rows.where("b0 < b1 or (b0 = b1 and accepted_id < new_id)")
    # an accepted record may have later links, but it repeats none
    rows = rows.join(taken.select(F.col("id").alias("new_id")), "new_id", "left_anti").join(both, ["key_a", "key_b"])
    return rows.select("accepted_id", "new_id", "similarity").distinct(), taken.select("id", "key")


def _rejected(forward: DataFrame) -> DataFrame:
    """Classes whose first record is a repeat; decided in rounds, each for all records whose earlier neighbours are decided.

    Links to the table decide in the first round; what is left are chains of revisions among the new records.
    """
    rejected = checkpoint(forward.where("to_old").select("late").distinct())
    late = rejected.withColumnRenamed("late", "early")
    edges = checkpoint(forward.where("not to_old").select("early", "late").distinct().join(rejected, "late", "left_anti").join(late, "early", "left_anti"))
    while not edges.isEmpty():
        heads = edges.select("early").distinct().join(edges.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        out = checkpoint(edges.join(heads, "early", "left_semi").select("late").distinct())
        rejected = rejected.unionByName(out)
        edges = checkpoint(edges.join(out, "late", "left_anti").join(out.withColumnRenamed("late", "early"), "early", "left_anti"))
    return rejected


def _named(rows: DataFrame, id_col: str, text_col: str, batch_col: str) -> DataFrame:
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(batch_col).cast("int").alias("batch"))
    return named.where("id is not null and text is not null and batch is not null")


def repeats(rows: DataFrame, id_col: str, text_col: str, batch_col: str, threshold: float = 0.8, k: int = 5, least_units: int = 20, path: str | None = None, in_turn: bool = False) -> DataFrame:
    """(accepted_id, new_id, similarity): every repeated record with every record accepted before it that it repeats.

    Batch 0 is accepted as a whole and makes the table at ``path`` (a new folder of the shared folder if none is
    given), the others arrive at once, or each in its turn.
    """
    rows = _named(rows, id_col, text_col, batch_col)
    path = path or f"{shared_dir(rows.sparkSession).rstrip('/')}/chunk-table-{uuid.uuid4().hex}"
    table = ChunkTable.create(rows.where("batch = 0"), path, threshold, k, least_units)
    new = rows.where("batch > 0")
    if not in_turn:
        return table.arrive(new)
    out = rows.sparkSession.createDataFrame([], "accepted_id long, new_id long, similarity double")
    for b in sorted(r.batch for r in new.select("batch").distinct().collect()):
        out = out.unionByName(table.arrive(new.where(F.col("batch") == b)))
    return out
