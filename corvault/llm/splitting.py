"""Splitting of oversized texts at natural boundaries.

Method: recursive separator hierarchy (section, paragraph, sentence, word, character) with
greedy packing to the limit and a trailing overlap.  Lengths are code points.

Every piece is at most ``limit`` long and starts ``overlap`` before the end of the last one.
Only where no boundary lies within the room that leaves, but one does within the limit, the
overlap is shortened so that the cut stays natural.  A cut between two characters is made only
where ``limit`` code points in a row hold no boundary at all; such a text is "forced".

Null texts and texts within the limit give no pieces from :func:`split_oversized`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points after which a text may be cut, from the problem's statement.
BOUNDARIES = " \t\r\n　。！？；"
#: From the strongest to the weakest; each matches what a cut may follow.
SEPARATORS = (
    ("section", regex.compile(r"\n(?=#{1,6} )|\n(?==+ )|\n\n+(?=[^\n]{1,80}\n[=-]{3,}\n)|\f")),
    ("paragraph", regex.compile(r"(?:\r?\n[ \t　]*){2,}|\r\r+")),
    ("sentence", regex.compile(r"[.!?][\"'”’)\]]*[ \t\r\n　]+|[。！？；]+[”’」』）]*(?<=[。！？；])|\r?\n")),
    ("word", regex.compile(r"[ \t\r\n　。！？；]+")),
)


def _cuts(text: str) -> list[tuple[str, list[int]]]:
    found = []
    for name, pattern in SEPARATORS:
        found.append((name, [m.end() for m in pattern.finditer(text)]))
    # every single boundary, so that a long run of blanks can be cut as well
    found[-1] = ("word", [i + 1 for i, c in enumerate(text) if c in BOUNDARIES])
    return found


def _last_within(ends: list[int], low: int, high: int) -> int:
    """The largest cut in (low, high], or -1."""
    from bisect import bisect_right

    i = bisect_right(ends, high) - 1
    return ends[i] if i >= 0 and ends[i] > low else -1


def split_text(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int, str]]:
    """Pieces (start, end, level of the cut at the end) that cover ``text``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text), "end")] if text else []
    levels = _cuts(text)
    pieces: list[tuple[int, int, str]] = []
    start = done = 0
    while True:
        if len(text) - start <= limit:
            pieces.append((start, len(text), "end"))
            return pieces
        high = start + limit
        # packing is greedy: a weaker separator is taken only if the stronger would leave half of the room unused
        for name, ends in levels:
            cut = _last_within(ends, done if name == "word" else max(done, start + limit // 2), high)
            if cut > 0:
                break
        if cut < 0:
            # an atom longer than the room beside the overlap: give up overlap before cutting into it
            rest = text[done:]
            # a last stretch of just the limit without any boundary leaves no room for the overlap, so it is cut
            if len(rest) < limit or (len(rest) == limit and any(c in BOUNDARIES for c in rest)):
                pieces.append((len(text) - limit, len(text), "end"))
                return pieces
            cut = _last_within(levels[-1][1], done, done + limit)
            if cut > 0:
                start, name = max(start, cut - limit), "word"
            else:
                cut, name = high, "forced"
        pieces.append((start, cut, name))
        if cut == len(text):
            return pieces
        done = cut
        start = max(0, cut - overlap, start + 1)


def split_oversized(rows: DataFrame, keys: list[str], text_col: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """One row for each piece of each text over the limit: the key columns, piece_no, start, end, level, piece."""
    named = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("text")).where(F.length("text") > limit)
    kinds = dict(rows.dtypes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, no, begin, end, level, piece = [], [], [], [], [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for j, (s, e, name) in enumerate(split_text(t, limit, overlap)):
                    own.append(i)
                    no.append(j)
                    begin.append(s)
                    end.append(e)
                    level.append(name)
                    piece.append(t[s:e])
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(len(keys))), pa.array(no, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(level, pa.string()), pa.array(piece, pa.string())],
                [*keys, "piece_no", "start", "end", "level", "piece"],
            )

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, start long, end long, level string, piece string"
    return named.mapInArrow(run, schema)
