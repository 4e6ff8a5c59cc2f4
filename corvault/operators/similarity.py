"""Exact vector search and similarity joins in blocks.

A task holds a block of the queries or sources and reads all of the other side beside it, see
``packs``; pairs are chosen by a matrix product in single precision with room for its error and
then computed in double.  Nothing is broadcast, each side goes through the shuffle once, and only
what is asked for leaves a task.  The work is the product of both sides, as the search is
exhaustive by definition.

Vectors that are null, hold nulls or NaN, or differ in length from their partners match nothing.
Equal similarities are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvault.functions import scores
from corvault.operators import literal
from corvault.operators.packs import meet
from corvault.runtime import shuffle_partitions

#: Rows of either side that a task holds at a time.
BLOCK = 20_000
#: Rows that a finer cut leaves at least.
LEAST = 2_000


def _sound(v):
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each length of vectors the rows that have it, and the vectors."""
    vec = b.column("vec")
    lengths = vec.value_lengths().to_numpy()
    for k in np.unique(lengths):
        at = np.flatnonzero(lengths == k)
        own = vec if len(at) == len(lengths) else vec.take(pa.array(at))
        yield at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), k).astype(np.float64)


def _tasks(df: DataFrame, least: int) -> int:
    """Tasks over ``df``: of ``BLOCK`` rows at most; small tables are cut finer, so that all tasks have work."""
    n = df.count()
    return max(1, math.ceil(n / BLOCK), min(shuffle_partitions(df.sparkSession), n // least))


def _prepared(df: DataFrame, id_col: str, level_col: str, vec_col: str, *more: str) -> DataFrame:
    v = F.col(vec_col)
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    return df.where(_sound(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(level_col).alias("level"), v.cast(kind).alias("vec"), *more)


def nearest(queries: DataFrame, corpus: DataFrame, n: int, id_col: str = "id", level_col: str = "level", vec_col: str = "vec", within: dict[str, float] | None = None) -> DataFrame:
    """(query_id, level, id, distance, rank): the ``n`` corpus rows of each level at the least squared distance from each query.

    With ``within`` only rows of its levels at a distance up to the level's are searched for.
    """
    q, c = _prepared(queries, id_col, level_col, vec_col).select("id", "vec"), _prepared(corpus, id_col, level_col, vec_col)

    def search(passing: Iterator[pa.RecordBatch], own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = own.column("id").to_numpy()
        sides = [(at, x, x.astype(np.float32), (x**2).sum(1)) for at, x in _vectors(own)]
        # by level, the best so far: query, distance, id, in order; and the distance that a query still asks for
        best: dict = {}
        for b in passing:
            there, levels = b.column("id").to_numpy(), np.array(b.column("level").to_pylist(), dtype=object)
            for at_c, y in _vectors(b):
                side = next((s for s in sides if s[1].shape[1] == y.shape[1]), None)
                if side is None:
                    continue
                at_q, x, narrow, xx = side
                for level in set(levels[at_c]):
                    if within is not None and level not in within:
                        continue
                    mine = np.flatnonzero(levels[at_c] == level)
                    z = y[mine]
                    zz, z32 = (z**2).sum(1), np.ascontiguousarray(z.T.astype(np.float32))
                    if level not in best:
                        best[level] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.full(len(ids), np.inf if within is None else within[level] + 1e-6)]
                    asked, take, found = best[level][3][at_q], min(n, len(z)), []
                    for i in range(0, len(x), 256):
                        # single precision only chooses whose distance is computed
                        d = narrow[i : i + 256] @ z32
                        d *= -2
                        d += xx[i : i + 256].astype(np.float32)[:, None]
                        d += zz.astype(np.float32)
                        slack = 1e-9 + (x.shape[1] + 8) * 1.2e-7 * (xx[i : i + 256] + zz.max())
                        edge = asked[i : i + 256]
                        if take == n and np.isinf(edge).any():
                            edge = np.minimum(edge, np.partition(d, take - 1, axis=1)[:, take - 1] + slack)
                        a, k = np.nonzero(~(d > (edge + slack)[:, None].astype(np.float32)))
                        if len(a):
                            found.append((i + a, k, ((x[i + a] - z[k]) ** 2).sum(1)))
                    if found:
                        a, k, exact = map(np.concatenate, zip(*found))
                        best[level] = _least(at_q[a], exact, there[at_c[mine[k]]], best[level], n)
        for level, (a, d, i, _) in best.items():
            for s in range(0, len(a), 50_000):
                e = slice(s, s + 50_000)
                begins = np.searchsorted(a, a[e])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[e]]), pa.array([level] * len(a[e]), pa.string()), pa.array(i[e]), pa.array(d[e]), pa.array(np.arange(len(a))[e] - begins + 1, pa.int32())], ["query_id", "level", "id", "distance", "rank"])

    return meet(c, q, _tasks(q, 64), "id", search, "query_id long, level string, id long, distance double, rank int", BLOCK)


def _least(a: np.ndarray, d: np.ndarray, i: np.ndarray, best: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The best ``n`` of each query, of those so far and of more."""
    a, d, i = np.r_[best[0], a], np.r_[best[1], d], np.r_[best[2], i]
    order = np.lexsort((i, np.round(d, 9), a))
    a, d, i = a[order], d[order], i[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    asked = best[3].copy()
    # ties at the edge are settled by id
    asked[a[rank == n - 1]] = np.minimum(asked[a[rank == n - 1]], d[rank == n - 1] + 2e-9)
    return [a[rank < n], d[rank < n], i[rank < n], asked]


def similar_pairs(source: DataFrame, target: DataFrame, least: float, id_col: str = "id", level_col: str = "level", vec_col: str = "vec", text_col: str | None = None) -> DataFrame:
    """(source_id, source_level, target_id, target_level, raw): pairs of a higher and a lower level with cosine at least ``least``.

    With ``text_col`` also (overlap, run) of the source's text in the target's, see ``literal.pair_overlap``.
    """
    rank = {"public": 0, "restricted": 1, "confidential": 2}
    more = [text_col] if text_col else []
    # the lowest level is no source and the highest no target, so they don't go through the shuffle as such
    s = _prepared(source, id_col, level_col, vec_col, *more).where(F.col("level").isin("restricted", "confidential"))
    t = _prepared(target, id_col, level_col, vec_col, *more).where(F.col("level").isin("public", "restricted"))

    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = np.linalg.norm(x, axis=1)
        return x / np.where(length > 0, length, 1)[:, None], length > 0

    def search(passing: Iterator[pa.RecordBatch], own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, levels = own.column("id").to_numpy(), own.column("level")
        ranks = np.array([rank[v] for v in levels.to_pylist()])
        sides = [(at, *unit(x)) for at, x in _vectors(own)]
        signs = literal.Signs(own.column(3)) if text_col else None
        for b in passing:
            there, below = b.column("id").to_numpy(), b.column("level")
            below_ranks = np.array([rank[v] for v in below.to_pylist()])
            found = []
            for at_t, y in _vectors(b):
                side = next((s for s in sides if s[1].shape[1] == y.shape[1]), None)
                if side is None:
                    continue
                at_s, x, real = side
                y, _ = unit(y)
                y32, slack = np.ascontiguousarray(y.T.astype(np.float32)), 1e-9 + (x.shape[1] + 8) * 1.2e-7
                for i in range(0, len(x), 256):
                    u, v = np.nonzero(x[i : i + 256].astype(np.float32) @ y32 >= least - slack)
                    u += i
                    keep = (ranks[at_s[u]] > below_ranks[at_t[v]]) & real[u]
                    u, v = u[keep], v[keep]
                    raw = (x[u] * y[v]).sum(1)
                    keep = raw >= least
                    found.append((at_s[u[keep]], at_t[v[keep]], raw[keep]))
            if not found:
                continue
            u, v, raw = map(np.concatenate, zip(*found))
            extra = signs.of(u, v, b.column(3)) if text_col else ()
            for k in range(0, len(u), 50_000):
                e = slice(k, k + 50_000)
                a, c = pa.array(u[e]), pa.array(v[e])
                yield pa.RecordBatch.from_arrays([pa.array(ids[u[e]]), levels.take(a), pa.array(there[v[e]]), below.take(c), pa.array(raw[e]), *(pa.array(z[e]) for z in extra)], names)

    schema = "source_id long, source_level string, target_id long, target_level string, raw double" + ", overlap double, run int" * bool(text_col)
    names = [x.split()[0] for x in schema.split(", ")]
    return meet(t, s, _tasks(s, LEAST), "id", search, schema, BLOCK)


def parent_child(hits: DataFrame, parents: DataFrame, parent_of: str) -> DataFrame:
    """Hits of children (query_id, level, id, distance, ``parent_of``): the best child of each parent, with the parent's text.

    The limit was applied to children before, so a query may have fewer parents than hits.
    """
    w = Window.partitionBy("query_id", "level", parent_of).orderBy(F.round("distance", 9), "id")
    best = hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return best.join(parents.select(F.col("parent_id").alias(parent_of), "parent_text"), parent_of, "left")


def best_per(df: DataFrame, keys: list[str], score: str, *ties) -> DataFrame:
    """The row of the greatest score for each key; ties by the given order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def norm_audit(df: DataFrame, vec_col: str) -> DataFrame:
    """Count of vectors, of those whose norm is off by more than 0.01, and the norms' range."""
    n = scores.norm(F.col(vec_col))
    return df.where(_sound(F.col(vec_col))).select(n.alias("n")).agg(
        F.count("*").alias("vectors"), F.count_if(F.abs(F.col("n") - 1) > 0.01).alias("bad"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.avg("n").alias("avg_norm")
    )


def summary_vector(df: DataFrame, doc_col: str, order_col: str, vec_col: str, first: int = 3) -> DataFrame:
    """(doc, vec): the normalised mean of the first vectors of each document."""
    w = Window.partitionBy(doc_col).orderBy(order_col)
    head = df.where(_sound(F.col(vec_col))).withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= first)
    dims = head.select(F.col(doc_col).alias("doc"), F.posexplode(vec_col).alias("i", "x")).groupBy("doc", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = dims.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return mean.select("doc", scores.normalised(F.col("mean")).alias("vec"))
