"""Encoding of texts with a public byte-level BPE vocabulary.

Method: two-tier lookup.  A minimal perfect hash over the vocabulary resolves pre-tokens that
are tokens as a whole; the rest are merged with a heap over linked bytes.  Before that, a miss
is cut wherever no token of the vocabulary can reach across, which changes no result.

Null and empty texts give the empty list.  Strings that look like special tokens are ordinary
text.  The vocabulary file is a parameter; it is read on each worker, never copied.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvault.llm.postings import text_batches

#: Fixed value: the pre-token pattern that belongs to the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers; past it, it forgets all and goes on.
REMEMBERED = 400_000
_M64 = (1 << 64) - 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


class PerfectHash:
    """A minimal perfect hash: every key has its own slot of ``len(keys)``; found by displacement, largest bucket first."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * n
        members: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members.setdefault(h % self.buckets, []).append(i)
        free = None
        for b, own in sorted(members.items(), key=lambda m: -len(m[1])):
            if len(own) == 1:
                # single keys take what is left: their shift names the slot itself
                if free is None:
                    free = iter([s for s, v in enumerate(self.slots) if v < 0])
                slot = next(free)
                self.shift[b] = -slot - 1
                self.slots[slot] = own[0]
                continue
            d = 0
            while True:
                d += 1
                at = [_mix(hashes[i] + d * 0x9E3779B97F4A7C15 & _M64) % n for i in own]
                if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                    break
            self.shift[b] = d
            for i, s in zip(own, at):
                self.slots[s] = i

    def slot(self, key: bytes) -> int:
        """The number of the key that alone may equal ``key``; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else _mix(h + d * 0x9E3779B97F4A7C15 & _M64) % self.n]


class Encoder:
    """Encodes batches of texts; keeps what it has seen of pre-tokens."""

    def __init__(self, vocabulary: str):
        self.keys: list[bytes] = []
        self.ranks: list[int] = []
        for line in open(vocabulary, "rb"):
            if line.strip():
                a, b = line.split()
                self.keys.append(base64.b64decode(a))
                self.ranks.append(int(b))
        self.hash = PerfectHash(self.keys)
        self.single = {k: r for k, r in zip(self.keys, self.ranks) if len(k) == 1}
        #: bytes that stand side by side within some token, by (left byte, next two bytes)
        self.inside: set[bytes] = set()
        for k in self.keys:
            for i in range(1, len(k)):
                self.inside.add(k[i - 1 : i + 2])
        self.find = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self)
        self.parts: dict[bytes, list[int]] = {}
        self.cuts: dict[str, bool] = {}
        self.lengths: list[int] = []
        self.flat: list[int] = []

    def rank(self, key: bytes) -> int | None:
        i = self.hash.slot(key)
        return self.ranks[i] if self.keys[i] == key else None

    def merge(self, word: bytes) -> list[int]:
        """Byte-pair merges of lowest rank first, leftmost first among equals."""
        whole = self.rank(word)
        if whole is not None:
            return [whole]
        n = len(word)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (r := self.rank(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = right[i]
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i] = e
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank(word[i : end[i]]))
            i = right[i]
        return out

    def _may_join(self, a: str, b: str) -> bool:
        """Whether some token could reach across the border of two characters."""
        pair = a + b
        known = self.cuts.get(pair)
        if known is None:
            left, nxt = a.encode()[-1:], b.encode()
            known = left + nxt[:2] in self.inside if len(nxt) > 1 else any(s[:2] == left + nxt for s in self.inside)
            # a token may also end right after the first byte of b
            known = known or left + nxt[:1] in self.inside
            self.cuts[pair] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.rank(raw)
        if whole is not None:
            return [whole]
        if len(raw) == len(word):
            return self.merge(raw)
        out: list[int] = []
        begin = 0
        for i in range(1, len(word) + 1):
            if i == len(word) or not self._may_join(word[i - 1], word[i]):
                piece = word[begin:i].encode()
                ids = self.parts.get(piece)
                if ids is None:
                    ids = self.parts[piece] = self.merge(piece)
                out += ids
                begin = i
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if len(self.known) + len(self.parts) + len(self.cuts) > REMEMBERED:
            self.forget()
        words = [self.find(t) if t else () for t in texts]
        per_text = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        get = self.known.__getitem__
        index = np.fromiter((get(w) for ws in words for w in ws), dtype=np.int64, count=int(per_text.sum()))
        lengths = np.array(self.lengths, dtype=np.int64)
        starts = np.r_[0, np.cumsum(lengths)]
        flat = np.array(self.flat, dtype=np.int32)
        n = lengths[index]
        ends = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(starts[index] - ends[:-1], n) + np.arange(ends[-1])]
        at = np.r_[0, np.cumsum(per_text)]
        return ids, ends[at[1:]] - ends[at[:-1]]


class _Known(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        e = self.encoder
        ids = e.encode_word(word)
        e.lengths.append(len(ids))
        e.flat += ids
        i = self[word] = len(e.lengths) - 1
        return i


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode(rows: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the ids of each text; one row for each row of ``rows``."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b, texts in text_batches(batches):
            ids, n = e.encode_batch(texts)
            offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(rows.dtypes)[id_col]}, ids array<int>")


def count_tokens(rows: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, n): the number of ids of each text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b, texts in text_batches(batches):
            _, n = e.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["id", "n"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(rows.dtypes)[id_col]}, n long")
