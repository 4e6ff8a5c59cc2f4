"""Vectorised units, shingles and rolling hashes over batches of texts.

A *unit* is a maximal run of ``a-z 0-9 ä ö ü ß`` of the lower-cased text, or one
ideograph U+4E00..U+9FFF.  All functions work on a whole Arrow batch at once: the
texts are laid end to end as code points, so that one pass of numpy does the work of
millions of Python calls.  Hashes are 64 bits and equal on every machine.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E6C63D0876A9A47 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``x`` (uint64) over the word."""
    x = x ^ (x >> _U(30))
    x = x * _K2
    x = x ^ (x >> _U(27))
    x = x * _K3
    return x ^ (x >> _U(31))


_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        grown = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            grown.append(np.cumprod(steps))
        _powers = tuple(grown)
    return _powers


_classes = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        t = np.zeros(0x110000, dtype=np.uint8)
        t[ord("a") : ord("z") + 1] = 1
        t[ord("0") : ord("9") + 1] = 1
        for c in "äöüß":
            t[ord(c)] = 1
        t[0x4E00:0xA000] = 2
        _classes = t
    return _classes


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one NUL, and the start of each text (n + 1 numbers)."""
    joined = "\0".join(texts) + "\0" if texts else ""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return cp, starts


def unit_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of all texts in order, and where each text's units begin (n + 1 numbers).

    Null counts as empty.
    """
    low = [t.lower() if t else "" for t in texts]
    cp, starts = code_points(low)
    n = len(cp)
    if n == 0:
        return np.zeros(0, dtype=_U), np.zeros(len(texts) + 1, dtype=np.int64)
    cls = _class_table()[cp]
    word, ideo = cls == 1, cls == 2
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    s = np.flatnonzero(first | ideo)
    e = np.flatnonzero(last | ideo) + 1
    pw, inv = _power_tables(n + 1)
    v = (cp.astype(_U) + _U(1)) * _K1
    v ^= v >> _U(32)
    v *= pw[:n]
    h = np.zeros(n + 1, dtype=_U)
    np.cumsum(v, out=h[1:])
    units = mix((h[e] - h[s]) * inv[s] + (e - s).astype(_U))
    return units, np.searchsorted(s, starts)


def shingle_hashes(units: np.ndarray, at: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` consecutive units of each text (with repeats), and the number of the text it is of."""
    n = len(units)
    if n < k:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    h = units[: n - k + 1].copy()
    for i in range(1, k):
        h = mix(h) + units[i : n - k + 1 + i]
    h = mix(h)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = owner[: n - k + 1] == owner[k - 1 :]
    return h[ok], owner[: n - k + 1][ok]


def shingle_sets(texts: list[str | None], k: int = 3, least: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with at least ``least`` units.

    Returns the hashes ordered by (text, hash), the number of the text of each, and the number of
    units of every text.
    """
    units, at = unit_hashes(texts)
    count = np.diff(at)
    h, owner = shingle_hashes(units, at, k)
    keep = count[owner] >= least
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, owner, count


def range_hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``cp[begin:end]`` for each pair of borders, equal wherever the content is equal."""
    n = len(cp)
    pw, inv = _power_tables(n + 1)
    v = mix(cp.astype(_U) + _K1)
    v *= pw[:n]
    h = np.zeros(n + 1, dtype=_U)
    np.cumsum(v, out=h[1:])
    return mix((h[end] - h[begin]) * inv[begin] + (end - begin).astype(_U))
