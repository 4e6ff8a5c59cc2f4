"""Repair of text from scanned pages: broken words, misread letters, running headers, page numbers.

Method: anagram hashes.  A word's hash is the sum of a power of its code points, so replacing
some letters changes it by a fixed difference whatever the word.  Rare words of scanned pages
are joined, in SQL, with frequent words by the differences of known confusions; the matches are
verified letter by letter and ranked by the number of confusions, then by frequency.  Edge lines
are removed where their words run through the first lines of the file's pages, or where they
are just a page number.  A break at a line end is closed on the evidence of how often the
joined word and the hyphenated word stand elsewhere.

A scanned file is one whose rows are mostly pages of short lines and that shows running headers
or page numbers.  Null and empty texts, and rows without a file, hold nothing to repair.  A page
delivered twice is repaired twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvault.runtime import checkpoint, release

#: What scanners read, and what it stands for.
CONFUSIONS = (
    ("c", "e"), ("é", "e"), ("f", "t"), ("1", "l"), ("o", "a"), ("l", "i"), ("0", "o"), ("!", "i"), ("cl", "d"), ("5", "s"),
    ("rn", "m"), ("ii", "u"), ("9", "g"), ("b", "h"), ("b", "ti"), ("vv", "w"), ("1", "i"), ("|", "l"), ("|", "i"), ("6", "b"),
    ("8", "b"), ("I", "l"), ("O", "o"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("rm", "nn"), ("nn", "m"), ("á", "a"), ("ó", "o"), ("í", "i"), ("ü", "u"), ("q", "g"),
)
#: Longest line of a page of short lines; one line in five may be longer.
WIDEST, WIDE_PART = 90, 5
#: A header of more words of three letters or more than this has four fifths of them in common with others, a shorter one half.
LONGEST_HEADER = 8
#: A frequent word stands at least so often in texts that aren't scanned, and so many times as often as its misreading.
FREQUENT, RATIO = 4, 8
#: Signs at a line end that may break a word.
_BREAK = "-¬­‐‑"
_TOKEN = re.compile(r"[^\s.,;:?()\[\]{}\"“”„‘’'/<>«»—–]+")
_WORD = re.compile(r"(?=.*[a-z])[a-zé0-9!|áóíüI][a-zéáóíüäöß0-9!|IO]*(?:-[a-zé0-9!|áóíüäöß]+)*")
_DIGIT = r"[0-9OoIlSB|!]"
_PAGE_NO = re.compile(
    rf"\s*(?:[-—–]\s*(?:{_DIGIT}{{1,5}}|[ivxlcdm1]{{1,9}})\s*[-—–]|\[\s*{_DIGIT}{{1,5}}\s*\]|{_DIGIT}{{1,5}}\s*/\s*{_DIGIT}{{1,5}}|(?:p\.|[Pp][aoá][gq9][eécE])\s*{_DIGIT}{{1,5}}(?:\s+[oa][ft]\s+{_DIGIT}{{1,5}})?|[0-9]{_DIGIT}{{0,4}}|{_DIGIT}{{0,4}}[0-9])\s*"
)
_SKELETON = str.maketrans({"1": "i", "!": "i", "|": "i", "l": "i", "0": "o", "a": "o", "c": "e", "5": "s", "9": "g", "b": "h", "f": "t", "6": "h"})

_PAGE = (
    "id long, file string, no int, lines int, first_words array<string>, numbered boolean, page_no string, breaks array<struct<a:string,b:string>>, "
    "tail string, head1 string, head2 string, tokens array<string>, tokens1 array<string>"
)


def skeleton(word: str) -> str:
    """``word`` in lower case with all that is easily confused made equal."""
    w = unicodedata.normalize("NFD", word.lower())
    w = "".join(c for c in w if not unicodedata.combining(c)).replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "u")
    return w.translate(_SKELETON)


def is_page(text: str) -> bool:
    """Whether ``text`` has the shape of a page of short lines."""
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) >= 2 and WIDE_PART * sum(len(x) > WIDEST for x in lines) <= len(lines) and not any(x.startswith(("    ", "- ", "|", "def ")) for x in lines[:4])


def _stem(line: str) -> str | None:
    """What of a word stands before a break at the end of ``line``."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in _BREAK or not (s[-2].isalnum() or s[-2] in "!|"):
        return None
    part = re.search(r"[^\s.,;:?()\[\]\"“”'/]+$", s[:-1])
    return part[0] + s[-1] if part else None


def _rest(line: str) -> str | None:
    """The letters that ``line`` begins with, hyphenated parts included."""
    m = re.match(r"\s*([^\s.,;:?()\[\]\"“”'/]+)", line)
    return m[1].rstrip(_BREAK) if m and m[1][0] not in _BREAK else None


def page(text: str) -> dict:
    """What the repair has to know of one page."""
    lines = [x for x in text.split("\n") if x.strip()]
    number = lines[-1] if len(lines) > 1 and _PAGE_NO.fullmatch(lines[-1]) else None
    body = lines[:-1] if number is not None else lines
    first = body[0]
    breaks, tokens, tokens1 = [], set(), set()
    carried = False
    for i, line in enumerate(body):
        own = _TOKEN.findall(line)
        stem = _stem(line)
        if carried and own:
            own = own[1:]
        carried = False
        if stem is not None:
            own = own[:-1]
            if i + 1 < len(body) and (rest := _rest(body[i + 1])) is not None:
                if i or len(body) == 1:
                    breaks.append({"a": stem, "b": rest})
                else:
                    # a first line that turns out to be body text breaks words too
                    breaks.append({"a": "\n" + stem, "b": rest})
                carried = True
        (tokens if i else tokens1).update(w for w in own if len(w) > 2 and _WORD.fullmatch(w))
    tail = _stem(body[-1]) if len(body) > 1 or number is None else None
    words = sorted({skeleton(w) for w in re.findall(r"\w[\w!|]{2,}", re.sub(r"^\s*\d+\s\s+|\s\s+\d+\s*$", "", first))})
    return {
        "lines": len(lines),
        "first_words": words,
        "numbered": bool(re.match(rf"\s*{_DIGIT}{{1,5}}\s\s+\S|.*\S\s\s+{_DIGIT}{{1,5}}\s*$", first)),
        "page_no": number.strip() if number is not None else None,
        "breaks": breaks,
        "tail": tail,
        "head1": _rest(first),
        "head2": _rest(body[1]) if len(body) > 1 else None,
        "tokens": sorted(tokens),
        "tokens1": sorted(tokens1),
    }


def _short_lines(text):
    """SQL form of the cheap part of :func:`is_page`."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")
    return F.instr(text, "\n").cast("boolean") & (WIDE_PART * F.size(F.filter(lines, lambda x: F.length(x) > WIDEST)) <= F.size(lines))


def words(rows: DataFrame) -> DataFrame:
    """(word, n_clean, n_scan): how often each word that begins small stands in other texts and in pages of short lines."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()
        scan: Counter[str] = Counter()

        def out():
            keys = [w for w in clean.keys() | scan.keys() if 1 < len(w) < 60 and _WORD.fullmatch(w)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([clean[w] for w in keys], pa.int64()), pa.array([scan[w] for w in keys], pa.int64())], ["word", "n_clean", "n_scan"]
            )
            clean.clear()
            scan.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    (scan if "\n" in t and is_page(t) else clean).update(_TOKEN.findall(t))
            if len(clean) + len(scan) > 400_000:
                yield from out()
        yield from out()

    parts = rows.select("text").where("text is not null").mapInArrow(count, "word string, n_clean long, n_scan long")
    return parts.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"))


def anagram(word):
    """The anagram hash of a word column."""
    codes = F.transform(F.split(word, ""), lambda c: F.pow(F.ascii(c).cast("double"), F.lit(5)).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x)


def corrections(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, word): the best frequent word for each misread token, for up to two confusions."""
    right = counts.where(F.col("n_clean") >= FREQUENT).where(F.col("word").rlike("^[a-zäöüß]+(-[a-zäöüß]+)*$")).select(F.col("word").alias("right"), F.col("n_clean").alias("n_right"))
    right = right.withColumn("av", anagram(F.col("right")))
    rare = (
        tokens.join(counts, tokens["token"] == counts["word"], "left")
        .select("token", F.coalesce("n_clean", F.lit(0)).alias("n_clean"), F.coalesce("n_scan", F.lit(1)).alias("n_scan"))
        .where(F.col("n_clean") <= F.col("n_scan") / 2)
    )
    power = lambda s: sum(ord(c) ** 5 for c in s)
    table = F.array(*(F.struct(F.lit(a).alias("mis"), F.lit(b).alias("good"), F.lit(power(b) - power(a)).alias("diff")) for a, b in CONFUSIONS))

    def matched(words_: DataFrame) -> DataFrame:
        tried = words_.select("*", F.explode(F.filter(table, lambda c: F.contains(F.col("form"), c["mis"]))).alias("c")).select("*", (anagram(F.col("form")) + F.col("c.diff")).alias("av"))
        spots = F.sequence(F.lit(1), F.length("form"))
        replaced = lambda p: F.concat(
            F.substring("form", F.lit(1), p - 1), F.col("c.good"), F.substring(F.col("form"), p + F.length("c.mis"), F.length("form"))
        )
        fits = F.exists(spots, lambda p: (F.substring(F.col("form"), p, F.length("c.mis")) == F.col("c.mis")) & (replaced(p) == F.col("right")))
        return tried.join(right, "av").where(fits)

    start = rare.select("token", "n_clean", "n_scan", F.col("token").alias("form"))
    once = matched(start).select("token", "right", "n_right", "n_clean", "n_scan", F.lit(1).alias("errors"))
    open_ = start.join(once.select("token").distinct(), "token", "left_anti").where(F.length("token") >= 5)
    spread = open_.select("*", F.explode(F.filter(table, lambda c: F.contains(F.col("form"), c["mis"]))).alias("c"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(1), F.length("form"))).alias("p")).where(F.expr("substring(form, p, length(c.mis)) = c.mis"))
    second = spread.select("token", "n_clean", "n_scan", F.expr("concat(substring(form, 1, p - 1), c.good, substring(form, p + length(c.mis)))").alias("form")).distinct()
    twice = matched(second).select("token", "right", "n_right", "n_clean", "n_scan", F.lit(2).alias("errors"))
    best = Window.partitionBy("token").orderBy("errors", F.desc("n_right"), "right")
    return (
        once.unionByName(twice)
        .where(F.col("n_right") >= RATIO * F.col("n_clean") + F.col("n_scan") / 4)
        .withColumn("r", F.row_number().over(best))
        .where("r = 1")
        .select("token", F.col("right").alias("word"))
    )


def analyse(rows: DataFrame, id_col: str, text_col: str, file_col: str, order_col: str) -> dict[str, DataFrame]:
    """All that is to be repaired on the scanned pages of ``rows``.

    pages (id, file, no, header), page_numbers (id, item), breaks (id, a, b, word: the joined word or null, across: whether
    the word goes on on the next page), glyphs (id, token, word).
    """
    spark = rows.sparkSession
    named = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(file_col).alias("file"), F.col(order_col).cast("int").alias("no"), F.col(text_col).alias("text")
    ).where("id is not null")
    counts = checkpoint(words(named))

    def describe(batches) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in re.split(r", (?![^<]*>)", _PAGE)]
        kinds = {
            "lines": pa.int32(), "first_words": pa.list_(pa.string()), "numbered": pa.bool_(), "page_no": pa.string(),
            "breaks": pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])), "tail": pa.string(), "head1": pa.string(), "head2": pa.string(),
            "tokens": pa.list_(pa.string()), "tokens1": pa.list_(pa.string()),
        }
        for b in batches:
            texts = b.column(3).to_pylist()
            at = [i for i, t in enumerate(texts) if is_page(t)]
            found = [page(texts[i]) for i in at]
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(where) for i in range(3)), *(pa.array([x[n] for x in found], kinds[n]) for n in names[3:])], names)

    shaped = checkpoint(named.where(F.col("file").isNotNull() & F.col("no").isNotNull() & _short_lines(F.col("text"))).mapInArrow(describe, _PAGE))
    release(spark)
    # words that run through the first lines of a file's pages
    sizes = shaped.groupBy("file").agg(F.countDistinct("no").alias("pages"), F.count("page_no").alias("with_no"), F.sum(F.col("numbered").cast("int")).alias("with_head_no"))
    running = shaped.select("file", "no", F.explode("first_words").alias("w")).distinct().groupBy("file", "w").agg(F.count("*").alias("n")).where("n >= 2")
    running = running.join(sizes.select("file", "pages"), "file").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.2))).select("file", "w")
    of_line = shaped.select("id", "file", "no", F.size("first_words").alias("words"), F.explode("first_words").alias("w"))
    known = of_line.join(running, ["file", "w"]).groupBy("id", "file", "no").agg(F.count("*").alias("shared"), F.first("words").alias("words"))
    headed = known.where((F.col("shared") >= 2) & (F.col("shared") >= F.when(F.col("words") <= LONGEST_HEADER, 0.5).otherwise(0.8) * F.col("words"))).select("id", "file", F.lit(True).alias("running"))
    # a file is scanned if its rows are mostly such pages and show headers or page numbers
    total = named.where("file is not null").groupBy("file").agg(F.count("*").alias("rows"))
    evidence = shaped.select("file", "id", "page_no", "numbered").join(headed.select("id", "running").distinct(), "id", "left")
    proof = evidence.groupBy("file").agg(F.count("*").alias("shaped"), F.sum((F.col("page_no").isNotNull() | F.coalesce("running", F.lit(False)) | F.col("numbered")).cast("int")).alias("edges"))
    scanned = proof.join(total, "file").where("shaped * 2 >= rows and edges >= 1 and edges * 3 >= shaped").select("file")
    pages = shaped.join(scanned, "file", "left_semi").join(headed.select("id", "running").distinct(), "id", "left")
    pages = checkpoint(pages.withColumn("header", F.coalesce("running", F.lit(False)) | F.col("numbered")).drop("running"))

    inside = pages.select("id", "header", F.explode("breaks").alias("k")).where("not (header and k.a like '\\n%')")
    inside = inside.select("id", F.regexp_replace("k.a", "^\n", "").alias("a"), F.col("k.b").alias("b"), F.lit(False).alias("across"))
    following = pages.select("file", (F.col("no") - 1).alias("no"), F.when(F.col("header"), F.col("head2")).otherwise(F.col("head1")).alias("b"), "id")
    following = following.groupBy("file", "no").agg(F.min_by("b", "id").alias("b"))
    over = pages.where("tail is not null").select("id", "file", "no", F.col("tail").alias("a")).join(following, ["file", "no"]).select("id", "a", "b", F.lit(True).alias("across"))
    cut = inside.unionByName(over).where("b is not null").withColumn("stem", F.expr("substring(a, 1, length(a) - 1)"))
    cut = cut.where(F.col("b").rlike("^[a-zé0-9!|áóíüI]")).select("id", "a", "b", "across", F.concat("stem", "b").alias("joined"), F.concat("stem", F.lit("-"), "b").alias("hyphened"))
    cut = checkpoint(cut)

    tokens = pages.select("id", F.explode(F.when(F.col("header"), F.col("tokens")).otherwise(F.array_union("tokens", "tokens1"))).alias("token"))
    every = tokens.unionByName(cut.select("id", F.col("joined").alias("token"))).unionByName(cut.select("id", F.col("hyphened").alias("token"))).distinct()
    known_words = counts.select(F.col("word").alias("token"), "n_clean", "n_scan")
    fixed = checkpoint(corrections(every.select("token").distinct().where(F.length("token") > 2), counts))
    glyphs = every.join(fixed, "token").select("id", "token", "word")

    # hyphen evidence: how often either form stands in texts that aren't broken into lines
    seen = known_words.select("token", F.col("n_clean").alias("n"))
    evidence = (
        cut.join(fixed.select(F.col("token").alias("joined"), F.col("word").alias("joined_right")), "joined", "left")
        .join(fixed.select(F.col("token").alias("hyphened"), F.col("word").alias("hyphened_right")), "hyphened", "left")
        .withColumn("j", F.coalesce("joined_right", "joined"))
        .withColumn("h", F.coalesce("hyphened_right", "hyphened"))
        .join(seen.select(F.col("token").alias("j"), F.col("n").alias("nj")), "j", "left")
        .join(seen.select(F.col("token").alias("h"), F.col("n").alias("nh")), "h", "left")
    )
    nj, nh = F.coalesce("nj", F.lit(0)), F.coalesce("nh", F.lit(0))
    ordinary = F.col("j").rlike("^[a-zäöüß]+(-[a-zäöüß]+)*$")
    closes = ordinary & ((nj > nh) | ((nj == 0) & (nh == 0) & ~F.col("a").endswith("-")))
    breaks = evidence.select("id", "a", "b", "across", F.when(closes, F.col("j")).alias("word"), "joined", "hyphened")
    wrong = breaks.select("id", F.when(F.col("word").isNotNull(), F.col("hyphened")).otherwise(F.col("joined")).alias("token"))
    # of a break only the form that holds can be misread
    glyphs = glyphs.join(wrong.join(tokens, ["id", "token"], "left_anti").distinct(), ["id", "token"], "left_anti")
    return {"pages": pages, "breaks": breaks, "glyphs": glyphs, "named": named}


def found(rows: DataFrame, id_col: str, text_col: str, file_col: str, order_col: str) -> DataFrame:
    """(id, kind, item): every break, misread word, header and page number of the scanned pages."""
    a = analyse(rows, id_col, text_col, file_col, order_col)
    lines = a["pages"].where("header").select("id").join(a["named"].select("id", "text"), "id")
    first = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")[0]
    headers = lines.select("id", F.lit("header").alias("kind"), F.regexp_replace(first, "^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$", "").alias("item"))
    numbers = a["pages"].where("page_no is not null").select("id", F.lit("pageno").alias("kind"), F.col("page_no").alias("item"))
    hyphens = a["breaks"].where("word is not null").select("id", F.lit("hyphen").alias("kind"), F.col("word").alias("item"))
    glyphs = a["glyphs"].select("id", F.lit("glyph").alias("kind"), F.col("word").alias("item"))
    return headers.unionByName(numbers).unionByName(hyphens).unionByName(glyphs).distinct()


def repaired(rows: DataFrame, id_col: str, text_col: str, file_col: str, order_col: str) -> DataFrame:
    """(id, text): every scanned page as continuous paragraphs, without edge lines; a word broken over two pages stands on the first."""
    a = analyse(rows, id_col, text_col, file_col, order_col)
    pages = a["pages"].select("id", "file", "no", "header", F.col("page_no").isNotNull().alias("numbered"))
    breaks = a["breaks"].groupBy("id").agg(F.collect_list(F.struct("a", "b", "across", F.coalesce("word", "hyphened").alias("w"))).alias("breaks"))
    glyphs = a["glyphs"].groupBy("id").agg(F.collect_list(F.struct("token", "word")).alias("glyphs"))
    over = a["breaks"].where("across").join(pages.select("id", "file", (F.col("no") + 1).alias("no")), "id").select("file", "no").distinct().withColumn("begun", F.lit(True))
    all_ = (
        pages.join(a["named"].select("id", "text"), "id")
        .join(breaks, "id", "left")
        .join(glyphs, "id", "left")
        .join(over, ["file", "no"], "left")
        .select("id", "text", "header", "numbered", F.coalesce("begun", F.lit(False)).alias("begun"), "breaks", "glyphs")
    )

    def mend(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                right = {g["token"]: g["word"] for g in r["glyphs"] or ()}
                joins = {(k["a"], k["b"]): k["w"] for k in r["breaks"] or () if not k["across"]}
                over_ = [k for k in r["breaks"] or () if k["across"]]
                out.append(_mended(r["text"], r["header"], r["numbered"], r["begun"], joins, over_[0] if over_ else None, right))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    return all_.mapInArrow(mend, "id long, text string")


def _mended(text: str, header: bool, numbered: bool, begun: bool, joins: dict, over: dict | None, right: dict) -> str:
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    if numbered:
        lines = lines[: solid[-1]]
        solid = solid[:-1]
    if header:
        lines = lines[solid[0] + 1 :]
    correct = lambda s: _TOKEN.sub(lambda m: right.get(m[0], m[0]), s)
    if begun and lines:
        at = next((i for i, x in enumerate(lines) if x.strip()), None)
        if at is not None:
            lines[at] = re.sub(r"^\s*[^\s.,;:?()\[\]\"“”'/]+", "", lines[at])
    paragraphs: list[str] = []
    current = ""
    pending = False
    for i, line in enumerate(lines):
        if not line.strip():
            if current and not pending:
                paragraphs.append(current)
                current = ""
            continue
        s = line.strip()
        if pending:
            s = re.sub(r"^[^\s.,;:?()\[\]\"“”'/]+", "", s).lstrip()
            pending = False
        stem = _stem(s)
        nxt = next((x for x in lines[i + 1 :] if x.strip()), None)
        if stem is not None:
            word = joins.get((stem, _rest(nxt))) if nxt is not None else over and over["w"]
            if word:
                s = s[: len(s) - len(stem)] + word
                pending = nxt is not None
        current += (" " if current and s[:1] not in ".,;:" else "") + correct(s)
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)
