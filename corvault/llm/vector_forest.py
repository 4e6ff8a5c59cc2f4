"""The most similar vectors of every vector, within a small loss.

Method: a forest of random-projection trees.  A node projects its vectors on the line between the
centres of two groups that grow from two random ones of them, and splits at the median.  The upper
levels are fitted on a bounded sample of each model, and every vector is indexed in its home leaf of
each tree; a leaf that holds many more vectors than it should is split further, on its own vectors,
where it is searched.  A query takes leaves from one priority queue over all trees, in the order of
how near it lies to all the splits that part it from a leaf, however many those are.  Candidates of
the leaves are found on vectors of 8-bit numbers and reranked on the exact ones.

A vector is usable if it is not null, has ``dim`` elements, all finite and not all zero; others
are in no result.  Vectors of different models are never compared.  Equal vectors are indexed
once; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvault.llm import bloom
from corvault.llm.postings import expanded
from corvault.llm.units import mix
from corvault.runtime import checkpoint, release, shuffle_partitions

_U = np.uint64
#: Bounds of the sample that splits are fitted on: vectors of a model, of all models, and bytes of a model's.
SAMPLE, ALL_SAMPLES, SAMPLE_BYTES = 65_536, 131_072, 64_000_000
#: Models with dimensions, at most; their counts are collected.
MOST_SPACES = 10_000
#: Vectors that a leaf should have, and from how many times that on it is split further where it is searched; leaves looked at there.
LEAF, LARGE, INNER = 220, 6, 4
#: Bytes of postings that a bucket should hold.
PER_BUCKET = 12_000_000
#: Part of the squared distance at a cosine that the splits on the way to a leaf may take: leaves farther away aren't visited when only such cosines are wanted.
REACH = 0.02
#: See :meth:`Forest.wanted`: the more leaves there are, the smaller the part of them that is visited.
QUEUE = 3
_BLOCK = "bucket int, block binary"
#: 8-bit products of unit vectors differ from the exact cosine by less than this.
SLACK = 0.012


class Forest:
    """Splits of all trees of one model."""

    def __init__(self, sample: np.ndarray, total: int, trees: int, seed: int):
        sample = sample.astype(np.float32)
        d = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.depth = int(max(0, min(np.ceil(np.log2(max(1, total / LEAF))), np.floor(np.log2(max(1, len(sample) / 16))))))
        nodes = 1 << self.depth
        self.normals = np.zeros((trees, nodes, d), dtype=np.float32)
        self.cuts = np.zeros((trees, nodes), dtype=np.float32)
        for t in range(trees):
            node = np.ones(len(sample), dtype=np.int64)
            for _ in range(self.depth):
                order = np.argsort(node, kind="stable")
                ids, at = np.unique(node[order], return_index=True)
                for i, a, e in zip(ids.tolist(), at, np.r_[at[1:], len(order)]):
                    own = sample[order[a:e]]
                    self.normals[t, i] = _between(own, rng)
                    self.cuts[t, i] = np.median(own @ self.normals[t, i])
                node = self._step(sample, t, node)

    def _step(self, v: np.ndarray, t: int, node: np.ndarray) -> np.ndarray:
        return 2 * node + (np.einsum("ij,ij->i", v, self.normals[t, node]) >= self.cuts[t, node])

    def home(self, v: np.ndarray) -> np.ndarray:
        """Home leaf of each vector in each tree."""
        v = v.astype(np.float32)
        out = []
        for t in range(len(self.cuts)):
            node = np.ones(len(v), dtype=np.int64)
            for _ in range(self.depth):
                node = self._step(v, t, node)
            out.append(node - (1 << self.depth))
        return np.stack(out, axis=1)

    def costs(self, v: np.ndarray) -> np.ndarray:
        """Of each vector and each leaf of all trees the sum of the squared distances to the splits that part them."""
        out = []
        for t in range(len(self.cuts)):
            gap = v @ self.normals[t].T - self.cuts[t]
            cost = np.zeros((len(v), 1), dtype=np.float32)
            for level in range(self.depth):
                own = gap[:, 1 << level : 2 << level]
                below = np.empty((len(v), 2 << level), dtype=np.float32)
                below[:, 0::2] = cost + np.maximum(own, 0) ** 2
                below[:, 1::2] = cost + np.minimum(own, 0) ** 2
                cost = below
            out.append(cost)
        return np.concatenate(out, axis=1)

    def wanted(self, extra: int | None) -> int:
        """Leaves beside the homes: as many as said, else ``QUEUE`` times the root of the number of leaves of a tree."""
        return int(QUEUE * (1 << self.depth) ** 0.5) if extra is None else extra

    def visits(self, v: np.ndarray, extra: int, reach: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf): the first leaves of each row's queue over all trees, its homes (of cost 0) and ``extra`` more; ``reach``: none of a greater cost."""
        v = v.astype(np.float32)
        rows, leaves = [], []
        take = min(len(self.cuts) + extra, len(self.cuts) << self.depth)
        step = max(1, 8_000_000 // (len(self.cuts) << self.depth))
        for a in range(0, len(v), step):
            cost = self.costs(v[a : a + step])
            best = np.argpartition(cost, take - 1, axis=1)[:, :take]
            i, j = np.nonzero(np.take_along_axis(cost, best, axis=1) <= (np.inf if reach is None else reach))
            rows.append(a + i)
            leaves.append(best[i, j])
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        return row, leaf >> self.depth, leaf & ((1 << self.depth) - 1)


def _between(own: np.ndarray, rng) -> np.ndarray:
    """The direction from one to the other of two groups that grow from two random vectors."""
    i, j = rng.integers(len(own), size=2)
    a, b = own[i], own[j]
    some = own[rng.integers(len(own), size=min(len(own), 200))]
    for _ in range(4):
        near = some @ (a - b) > (a @ a - b @ b) / 2
        if near.all() or not near.any():
            break
        a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
    d = a - b
    if not d.any():
        d = rng.standard_normal(own.shape[1]).astype(np.float32)
    return d / np.linalg.norm(d)


def usable(rows: DataFrame, id_col: str, model_col: str, dim_col: str, vec_col: str) -> DataFrame:
    """(id, space, vec) of the usable vectors; a space is a model with a dimension."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.concat_ws("\0", F.col(model_col), F.col(dim_col).cast("string")).alias("space"), F.col(dim_col).alias("dim"), F.col(vec_col).alias("vec"))
    return named.where(F.col("id").isNotNull() & (F.size("vec") == F.col("dim"))).where(fine).select("id", "space", "vec")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32)


def _by_space(batches):
    for b in batches:
        spaces = b.column(1).dictionary_encode()
        codes = spaces.indices.to_numpy()
        for c, s in enumerate(spaces.dictionary.to_pylist()):
            at = np.flatnonzero(codes == c)
            for i in range(0, len(at), 4096):
                part = b.take(pa.array(at[i : i + 4096]))
                raw = _matrix(part.column(2))
                wide = raw.astype(np.float64)
                yield s, part.column(0).to_numpy(), raw, wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _seed(space: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(space.encode(), digest_size=8).digest(), "little"))


def _keys(space: str, raw: np.ndarray) -> np.ndarray:
    """64-bit class of equal vectors of a space."""
    words = np.ascontiguousarray(raw + np.float32(0)).view(np.uint32).astype(_U)
    h = np.full(len(raw), _seed(space), dtype=_U)
    for c in range(words.shape[1]):
        h = mix(h + words[:, c] + _U(0x9E3779B97F4A7C15))
    return h


def _forests(vectors: DataFrame, trees: int, seed: int) -> tuple[dict[str, Forest], int]:
    """The forest of each space with more vectors than a leaf or two, from one sample; and the number of all vectors."""
    spark = vectors.sparkSession
    counts = {r.space: r.n for r in vectors.groupBy("space").agg(F.count("*").alias("n")).limit(MOST_SPACES + 1).collect()}
    if len(counts) > MOST_SPACES:
        raise ValueError(f"more than {MOST_SPACES} models with dimensions")
    total = sum(counts.values())
    large = {s: n for s, n in counts.items() if n > 2 * LEAF}
    forests = {s: Forest(np.zeros((0, int(s.rpartition("\0")[2]))), n, trees, seed) for s, n in counts.items()}
    if large:
        most = {s: min(SAMPLE, max(1024, ALL_SAMPLES * n // total), max(1024, SAMPLE_BYTES // (4 * int(s.rpartition("\0")[2]))), 32 * max(32, n // LEAF)) for s, n in large.items()}
        cut = spark.createDataFrame([(s, int(min(1.0, most[s] / n) * (1 << 30))) for s, n in large.items()], "space string, cut long")
        chosen = vectors.join(F.broadcast(cut), "space").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.col("cut")).select("space", "vec")
        found: dict[str, list[np.ndarray]] = {}
        for b in chosen.toArrow().to_batches():
            names = b.column(0).to_pylist()
            for i, name in enumerate(names):
                found.setdefault(name, []).append(b.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.float32))
        for s, held in found.items():
            own = np.stack(held)
            forests[s] = Forest(own / np.linalg.norm(own, axis=1, keepdims=True), counts[s], trees, seed)
    return forests, total


def candidates(vectors: DataFrame, queries, k: int, trees: int, extra: int | None, least: float | None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(pairs: q, c, of class keys; members: id, key).  ``queries(ids)`` says which vectors are queries; None: all."""
    spark = vectors.sparkSession
    made, total = _forests(vectors, trees, seed)
    most = max((f.wanted(extra) for f in made.values()), default=0)
    width = max((f.normals.shape[2] for f in made.values()), default=1) + 17
    buckets = max(shuffle_partitions(spark), -(-total * width * (trees + (most if queries is None else most // 20)) // PER_BUCKET))
    forests = spark.sparkContext.broadcast(made)
    reach = None if least is None else REACH * (2 - 2 * least)

    def post(batches):
        parts, held = [], 0
        seen: set[tuple[int, bool]] = set()
        for s, ids, raw, unit in _by_space(batches):
            f = forests.value[s]
            key = _keys(s, raw)
            asks = np.ones(len(ids), dtype=bool) if queries is None else queries(ids)
            fresh = np.zeros(len(ids), dtype=bool)
            for i, own in enumerate(zip(key.tolist(), asks.tolist())):
                if own not in seen:
                    fresh[i] = True
                    if len(seen) < 500_000:
                        seen.add(own)
            raw, unit, key, asks = raw[fresh], unit[fresh], key[fresh], asks[fresh]
            if not len(raw):
                continue
            kind = np.dtype([("leaf", "<u8"), ("k", "<u8"), ("role", "u1"), ("v", "i1", (raw.shape[1],))])
            small = np.clip(np.rint(unit * 127), -127, 127).astype(np.int8)
            homes = f.home(unit)
            n = len(raw)
            rows = [(np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n), homes.ravel(), 1)]
            if asks.any():
                at = np.flatnonzero(asks)
                r, t, leaf = f.visits(unit[at], f.wanted(extra), reach)
                r = at[r]
                if queries is None:
                    # all are queries: the home postings serve as both
                    away = homes[r, t] != leaf
                    r, t, leaf = r[away], t[away], leaf[away]
                rows.append((r, t, leaf, 2))
            for r, t, leaf, role in rows:
                p = np.empty(len(r), dtype=kind)
                p["leaf"] = mix(_seed(s) + (t.astype(_U) << _U(40)) + leaf.astype(_U))
                p["k"], p["role"], p["v"] = key[r], 3 if role == 1 and queries is None else role, small[r]
                parts.append(p)
                held += p.nbytes
            if held > 40_000_000:
                yield from _flush(parts, buckets)
                parts, held = [], 0
        yield from _flush(parts, buckets)

    def search(batches):
        held: dict[int, list] = {}
        for b in batches:
            for n, v in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(n, []).append(v.as_buffer())
        # one bucket at a time
        for n in list(held):
            by_dim: dict[int, list[np.ndarray]] = {}
            for blob in held.pop(n):
                d = int.from_bytes(blob[:4].to_pybytes(), "little")
                kind = np.dtype([("leaf", "<u8"), ("k", "<u8"), ("role", "u1"), ("v", "i1", (d,))])
                by_dim.setdefault(d, []).append(np.frombuffer(blob, dtype=kind, offset=4))
            for found in by_dim.values():
                p = np.concatenate(found)
                p = p[np.argsort(p["leaf"], kind="stable")]
                at = np.flatnonzero(np.r_[True, p["leaf"][1:] != p["leaf"][:-1]])
                best = _Best(k, least)
                for a, e in zip(at, np.r_[at[1:], len(p)]):
                    leaf = p[a:e]
                    x, q = leaf[leaf["role"] & 1 == 1], leaf[leaf["role"] & 2 == 2]
                    if len(q) and len(x):
                        _, first = np.unique(x["k"], return_index=True)
                        yield from _searched(q, x[first], best, seed)
                yield from best.flush()

    blocks = vectors.mapInArrow(post, _BLOCK)
    found = blocks.repartitionById(buckets, "bucket").mapInArrow(search, "q long, c long, approx float")
    pairs = found.groupBy("q", "c").agg(F.max("approx").alias("approx"))
    if least is None:
        w = Window.partitionBy("q").orderBy(F.desc("approx"), "c")
        pairs = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k + 5)

    def identify(batches):
        for s, ids, raw, _ in _by_space(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_keys(s, raw).view(np.int64))], ["id", "key"])

    return pairs.select("q", "c"), vectors.mapInArrow(identify, "id long, key long")


def _searched(q: np.ndarray, x: np.ndarray, best: _Best, seed: int):
    """Compares the queries of a leaf with its vectors; a large leaf is split by a tree of its own, of which each query sees its nearest leaves."""
    if len(x) > LARGE * LEAF:
        rng = np.random.default_rng(seed)
        xv = x["v"].astype(np.float32) / np.float32(127)
        own = Forest(xv[rng.choice(len(xv), min(len(xv), 16_384), replace=False)], len(x), 1, seed)
        home = own.home(xv)[:, 0]
        row, _, leaf = own.visits(q["v"].astype(np.float32) / np.float32(127), INNER)
        order, back = np.argsort(leaf, kind="stable"), np.argsort(home, kind="stable")
        row, leaf, home = row[order], leaf[order], home[back]
        for n in np.unique(leaf).tolist():
            mine = x[back[np.searchsorted(home, n) : np.searchsorted(home, n, "right")]]
            if len(mine):
                yield from _compared(q[row[np.searchsorted(leaf, n) : np.searchsorted(leaf, n, "right")]], mine, best)
    else:
        yield from _compared(q, x, best)


def _compared(q: np.ndarray, x: np.ndarray, best: _Best):
    xv = x["v"].astype(np.float32).T / np.float32(127 * 127)
    step = max(1, 4_000_000 // len(x))
    for i in range(0, len(q), step):
        own = q[i : i + step]
        sim = own["v"].astype(np.float32) @ xv
        sim[own["k"][:, None] == x["k"][None, :]] = -2
        yield from best.add(own["k"], x["k"], sim)


def _flush(parts: list[np.ndarray], buckets: int):
    by_dim: dict[int, list[np.ndarray]] = {}
    for p in parts:
        by_dim.setdefault(p["v"].shape[1], []).append(p)
    for d, held in by_dim.items():
        p = np.concatenate(held)
        bucket = (mix(p["leaf"]) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, p = bucket[order], p[order]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        head = int(d).to_bytes(4, "little")
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[at], pa.int32()), pa.array([head + p[a:e].tobytes() for a, e in zip(at, np.r_[at[1:], len(p)])], pa.binary())], ["bucket", "block"]
        )


class _Best:
    """Candidates of the leaves of a task: all above a least score, or the best of each query."""

    def __init__(self, k: int, least: float | None):
        self.k, self.least = k, least
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, x: np.ndarray, sim: np.ndarray):
        if self.least is not None:
            i, j = np.nonzero(sim >= self.least - SLACK)
        else:
            take = min(self.k + 5, len(x))
            j = np.argpartition(-sim, take - 1, axis=1)[:, :take].ravel()
            i = np.repeat(np.arange(len(q)), take)
            real = sim[i, j] > -2
            i, j = i[real], j[real]
        self.parts.append((q[i], x[j], sim[i, j]))
        self.held += len(i)
        if self.held > 500_000:
            if self.least is None:
                self._trim()
            if self.held > 400_000:
                yield from self.flush()

    def _trim(self):
        q, c, s = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s = q[new], c[new], s[new]
        at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(at, np.diff(np.r_[at, len(q)]))
        keep = rank < 2 * self.k + 5
        self.parts = [(q[keep], c[keep], s[keep])]
        self.held = int(keep.sum())

    def flush(self):
        if self.held:
            if self.least is None:
                self._trim()
            q, c, s = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(q.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s.astype(np.float32))], ["q", "c", "approx"])


def neighbours(
    rows: DataFrame, id_col: str, model_col: str, dim_col: str, vec_col: str, k: int = 10, trees: int = 4, extra: int | None = None, least: float | None = None, queries=None
) -> DataFrame:
    """(id, neighbour, cosine, rank): up to ``k`` most similar vectors of each query, best first, equal cosines by id.

    ``trees`` and ``extra`` say how many leaves a query visits: its home in each tree and ``extra`` more in the order of the queue (see :meth:`Forest.wanted`).

    ``least`` leaves out neighbours of a smaller cosine, which never changes the rank of the others, and ends the queue
    where a vector of that cosine can hardly be (``REACH``), so that fewer leaves are enough.
    ``queries`` is a function of an array of ids; None makes every vector a query.
    """
    spark = rows.sparkSession
    vectors = usable(rows, id_col, model_col, dim_col, vec_col)
    pairs, members = candidates(vectors, queries, k, trees, extra, least)
    pairs, members = checkpoint(pairs), checkpoint(members)
    release(spark)
    asked = pairs.select(F.explode(F.array("q", "c")).alias("key")).distinct()
    wanted = spark.sparkContext.broadcast(bloom.build(asked))

    def fetch(batches):
        seen: set[int] = set()
        for s, _, raw, unit in _by_space(batches):
            key = _keys(s, raw)
            keep = []
            for i in np.flatnonzero(np.ones(len(key), dtype=bool) if wanted.value is None else wanted.value.maybe(key)).tolist():
                if int(key[i]) not in seen:
                    keep.append(i)
                    if len(seen) < 500_000:
                        seen.add(int(key[i]))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array([u.tobytes() for u in raw[keep]], pa.binary())], ["key", "vec"])

    parts = shuffle_partitions(spark)
    fetched = vectors.mapInArrow(fetch, "key long, vec binary")
    # more classes than a filter holds are chosen by a join
    fetched = fetched.join(asked, "key", "left_semi") if wanted.value is None else fetched
    exact = fetched.repartition(parts, "key").groupBy("key").agg(F.first("vec").alias("vec"))
    both = pairs.join(exact.select(F.col("key").alias("q"), F.col("vec").alias("x")), "q").join(exact.select(F.col("key").alias("c"), F.col("vec").alias("y")), "c").select("q", "c", "x", "y")

    def rerank(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = [np.frombuffer(v.as_buffer(), dtype=np.float32).astype(np.float64) for v in b.column(2)]
            y = [np.frombuffer(v.as_buffer(), dtype=np.float32).astype(np.float64) for v in b.column(3)]
            cos = np.array([(u @ v) / np.sqrt((u @ u) * (v @ v)) for u, v in zip(x, y)])
            keep = pa.array(np.flatnonzero(cos >= least) if least is not None else np.arange(len(cos)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(cos).take(keep)], ["q", "c", "cosine"])

    scored = both.mapInArrow(rerank, "q long, c long, cosine double")
    # of a class of copies only the first k + 1 can be among the k nearest of anything
    order = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    first = checkpoint(members.withColumn("n", order).where(F.col("n") <= k + 1).select("id", "key", "n"))
    asking = members
    if queries is not None:

        def chosen(batches):
            for b in batches:
                yield b.filter(pa.array(queries(b.column(0).to_numpy())))

        asking = members.mapInArrow(chosen, "id long, key long")
    across = asking.withColumnRenamed("key", "q").join(scored, "q").join(first.select(F.col("id").alias("neighbour"), F.col("key").alias("c")), "c").select("id", "neighbour", "cosine")
    several = first.where("n = 2").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    copies = expanded(several, asking, first.select("id", "key")).where("x != y").select(F.col("x").alias("id"), F.col("y").alias("neighbour"), F.lit(1.0).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return across.unionByName(copies).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
