"""Text functions on columns.

All are built from JVM-side expressions unless a function says otherwise.  Null gives null; lengths are code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what ``str.strip`` and ``\s`` take for blank.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HAN = r"\x{4e00}-\x{9fff}"

#: Headings whose sections carry no content of their own.
SKIPPED_SECTIONS = (
    "目{s}*录", "contents?", "参考文献", "references?", "附录{s}*[A-Z]?", "appendix{s}*[A-Z]?", "致谢", "acknowledgements?",
    "公式", "equations?", "索引", "index", "图{s}*表?{s}*目{s}*录", "list{s}+of{s}+(?:figures|tables)",
)
#: Stamps that make a short line noise.
NOISE_WORDS = (
    "页眉 页脚 header footer toc 修订记录 版本记录 revision 变更记录 changelog 版权所有 copyright 版权声明 免责声明 disclaimer 机密 confidential 保密 绝密 "
    "内部文件 内部资料 内部使用 审批人 审核人 批准人 拟定人 复核人 文档编号 文件编号 密级 密等 正本 副本 草稿 draft 第1页 第2页 共1页 共页 作者： 作者: 部门： 部门: 文档状态"
).split() + ["table of contents", "version history", "all rights reserved", "internal use", "第 1 页", "第 2 页", "page 1", "page 2", "共 1 页", "作者 ", "部门 "]
#: Words that are no keywords.
STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 the and for are but not you all can had her was one our out day get has him his"
).split()
#: Traditional characters and the simplified ones they become, in two rows.
TRADITIONAL = (
    "勢變應響與經濟進個時間問題後對點從現實認識說話讓麼這裡為會發達處場員團務報據標準係條結構頭腳馬車業學習體驗戰爭選擇決議論證確鐵錢銀貨資貿邊頁顯視聽覺歷華國黨軍戶産醫藥藝術計劃測試備勝負贏輸競極難簡單複"
    "級層類種樣屬於並幾賽獎獲勵稱養傷勞動靜歡樂風陽陰電腦機網絡頻畫圖聲鬱鬆緊張開關閉護辦幫別屆週繞圍圓釋兒親戀終辭雙獨傳統聯盤縣區鄉鎮倆東兩"
)
SIMPLIFIED = (
    "势变应响与经济进个时间问题后对点从现实认识说话让么这里为会发达处场员团务报据标准系条结构头脚马车业学习体验战争选择决议论证确铁钱银货资贸边页显视听觉历华国党军户产医药艺术计划测试备胜负赢输竞极难简单复"
    "级层类种样属于并几赛奖获励称养伤劳动静欢乐风阳阴电脑机网络频画图声郁松紧张开关闭护办帮别届周绕围圆释儿亲恋终辞双独传统联盘县区乡镇俩东两"
)
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_GARBAGE = (
    r"[\x{00}-\x{08}\x{0b}-\x{0c}\x{0e}-\x{1f}]",
    r"[\x{fffd}\x{feff}]",
    r"\x{3000}{3,}",
    rf"[^\p{{L}}\p{{N}}_{SPACE}{HAN}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]{{10,}}",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def clean_text(c: Column) -> Column:
    """Width folding, single blanks, trimmed lines, at most one empty line, no blanks between Han and Latin, no repeated stops."""
    c = F.regexp_replace(F.translate(c, _WIDE, _NARROW), "[ \t]+", " ")
    c = F.array_join(F.transform(lines(c), strip), "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    c = F.regexp_replace(c, f"([{HAN}])[{SPACE}]+([a-zA-Z0-9])", "$1$2")
    c = F.regexp_replace(c, f"([a-zA-Z0-9])[{SPACE}]+([{HAN}])", "$1$2")
    for mark in "。！？，、；：":
        c = F.regexp_replace(c, f"{mark}{{2,}}", mark)
    return c


def remove_garbage(c: Column) -> Column:
    """Without control characters, byte-order marks and replacement characters; runs of wide blanks become one."""
    c = F.regexp_replace(c, r"[\x{00}-\x{08}\x{0b}-\x{0c}\x{0e}-\x{1f}\x{feff}]", "")
    return F.regexp_replace(F.regexp_replace(c, r"\x{fffd}", ""), r"\x{3000}{3,}", "　")


def garbage_pieces(c: Column) -> Column:
    found = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in _GARBAGE)))
    # one look is enough for the most texts
    return F.when(c.rlike("|".join(_GARBAGE)), found).otherwise(F.array().cast("array<string>"))


def garbage_ratio(c: Column) -> Column:
    n = F.aggregate(garbage_pieces(c), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(c) > 0, n / F.length(c)).otherwise(F.lit(0.0))


def is_garbage(c: Column) -> Column:
    pieces = F.array_distinct(F.transform(garbage_pieces(c), lambda x: F.substring(x, 1, 50)))
    return (garbage_ratio(c) > 0.01) | (F.size(pieces) > 5)


def is_skip_section(line: Column) -> Column:
    names = "|".join(SKIPPED_SECTIONS).replace("{s}", f"[{SPACE}]")
    return line.rlike(f"(?i)^[{SPACE}]*(?:{names})[{SPACE}]*$")


def is_formula_line(line: Column) -> Column:
    return strip(line).rlike(r"^\$+.+\$+$|^\\\[.+\\\]$|^\\\(.+\\\)$|" + rf"^[0-9]+[{SPACE}]*[+\-*/=^][{SPACE}]*[0-9]+")


def is_low_quality_line(line: Column) -> Column:
    """Blank lines, digits only, signs only."""
    s = strip(line)
    return (s == "") | s.rlike("^[0-9]+$") | s.rlike(r"^[^\p{L}\p{N}_]+$") | s.rlike("^[_-]{3,}$")


def good_lines(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~is_low_quality_line(x)), "\n")


def tokens(c: Column) -> Column:
    """Distinct runs of two to four Han characters, or of three Latin letters or more."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"[{HAN}]{{2,4}}|[a-zA-Z]{{3,}}"), F.lit(0)))


def paragraph_similarity(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?i)https?://[-\p{L}\p{N}_.]+(?::[0-9]+)?(?:/[\p{L}\p{N}_/.]*(?:\?[\p{L}\p{N}_&=%.]*)?(?:#[\p{L}\p{N}_.]*)?)?"), F.lit(0))


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0))


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"), F.lit(0))


def phones(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?<![0-9])(?:1[3-9][0-9]{9}|0[0-9]{2,3}-[0-9]{7,8})(?![0-9])"), F.lit(0))


def id_cards(c: Column) -> Column:
    return F.regexp_extract_all(
        c, F.lit(r"(?<![0-9])[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![0-9])"), F.lit(0)
    )


def quality(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with readability, structure, content_richness, overall_score (0 to 100) and up to five issues; empty text scores 0.

    Pieces and counts are made once, in an inner select, and only then put together.
    """
    c = F.col(text_col)
    paragraphs, parts = F.split(c, "\n\n"), lines(c)
    distinct = F.array_distinct(F.transform(F.filter(paragraphs, lambda p: F.length(p) > 50), lambda p: F.substring(p, 1, 100)))
    made = df.withColumns(
        {
            "g_": garbage_pieces(c),
            "q_": F.struct(
                F.length(c).alias("size"),
                # the lines' lengths add up to the text's without its line ends
                ((F.length(c) - F.size(parts) + 1) / F.size(parts)).alias("mean"),
                # the heading pattern sees the text as one line, so only a text that is one heading has any
                c.rlike(rf"^#{{1,6}}[{SPACE}]+[^\n]+\n?$").alias("heading"),
                F.length(F.regexp_extract(c, "^(#{1,6})", 1)).alias("level"),
                (F.length(c) - F.length(F.regexp_replace(c, f"[{HAN}]", ""))).alias("han"),
                F.regexp_count(c, F.lit("[a-zA-Z]{3,}")).alias("latin"),
                F.size(paragraphs).alias("paragraphs"),
                F.size(distinct).alias("distinct"),
            ),
        }
    )
    q = lambda n: F.col(f"q_.{n}")
    made = made.withColumn("r_", F.when(q("size") > 0, F.aggregate("g_", F.lit(0), lambda s, x: s + F.length(x)) / q("size")).otherwise(0.0))
    made = made.withColumn("b_", (F.col("r_") > 0.01) | (F.size(F.array_distinct(F.transform("g_", lambda x: F.substring(x, 1, 50)))) > 5))
    flaws = {
        "readability": [("long_lines", q("mean") > 200, F.lit(20)), ("short_lines", q("mean") < 10, F.lit(20)), ("garbage", F.col("b_"), F.floor(F.col("r_") * 100))],
        "structure": [("no_headings", ~q("heading") & (q("size") > 1000), F.lit(30)), ("heading_jump", q("heading") & (q("level") > 1), F.lit(10))],
        "content_richness": [("little_text", (q("han") + 2 * q("latin")) / q("size") < 0.3, F.lit(30)), ("repeated_paragraphs", (q("paragraphs") > 5) & (q("distinct") / q("paragraphs") < 0.8), F.lit(20))],
    }
    some = q("size") > 0
    for name, own in flaws.items():
        score = F.lit(100)
        for _, when, points in own:
            score = score - F.when(when, points).otherwise(0)
        made = made.withColumn(name, F.when(some, F.greatest(F.lit(0), score)).otherwise(0).cast("int"))
    said = F.array_compact(F.array(*(F.when(when, F.lit(n)) for own in flaws.values() for n, when, _ in own)))
    overall = F.floor(F.round(F.col("readability") * 0.4 + F.col("structure") * 0.3 + F.col("content_richness") * 0.3, 6)).cast("int")
    return made.withColumn("overall_score", overall).withColumn("issues", F.when(some, F.slice(said, 1, 5)).otherwise(F.array(F.lit("empty")))).drop("g_", "q_", "r_", "b_")


def title(c: Column) -> Column:
    """The first heading or short line among the first ten lines."""
    heads = F.filter(F.transform(F.slice(lines(c), 1, 10), strip), lambda x: x != "")
    heading = F.get(F.filter(heads, lambda x: x.rlike(r"^#{1,6}\s")), F.lit(0))
    return F.coalesce(F.regexp_replace(heading, r"^#{1,6}\s+", ""), F.get(F.filter(heads, lambda x: F.length(x) <= 100), F.lit(0)), F.lit(""))


def clean_markdown(c: Column) -> Column:
    return F.concat(strip(F.regexp_replace(c, "\n{3,}", "\n\n")), F.lit("\n"))


def strip_toc_markers(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?m)^\.{{2,}}[{SPACE}]*[0-9]+[{SPACE}]*$", "")
    return F.regexp_replace(c, rf"(?m)^[0-9]+\.[{SPACE}]+\.{{3,}}[{SPACE}]*[0-9]+[{SPACE}]*$", "")


def wrap_chunk(title: Column, abstract: Column, text: Column) -> Column:
    part = lambda tag, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>")))
    return F.concat_ws("\n", part("file_title", title), part("file_abstract", abstract), F.concat(F.lit("<paragraph_content>"), F.coalesce(text, F.lit("")), F.lit("</paragraph_content>")))


def unwrap_chunk(c: Column, tag: str = "paragraph_content") -> Column:
    return F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def noise(c: Column) -> Column:
    """True: surely noise; false: surely not; null: undecided."""
    s = strip(c)
    low = F.lower(s)
    hit = F.exists(F.array(*(F.lit(w) for w in NOISE_WORDS)), lambda w: F.contains(low, w))
    return F.when(F.length(s) < 2, F.lit(None).cast("boolean")).when(F.length(s) > 200, F.lit(False)).when(hit, F.lit(True))


def simplified(c: Column) -> Column:
    return F.translate(c, TRADITIONAL, SIMPLIFIED)


def for_grams(c: Column) -> Column:
    """Without any blanks, in simplified characters."""
    return simplified(F.regexp_replace(c, f"[{SPACE}]", ""))


def safe_href(c: Column) -> Column:
    """No scheme, or one of http, https, mailto, ftp; control characters in front don't hide a scheme."""
    bare = F.regexp_replace(c, r"^[\x{00}-\x{20}]+", "")
    scheme = F.lower(F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return (scheme == "") | scheme.isin("http", "https", "mailto", "ftp")


def level_of_path(path: Column) -> Column:
    """The classification of the first level directory in a path, else public."""
    part = F.filter(F.split(path, "/"), lambda p: p.isin("0Public", "1Restricted", "2Confidential"))
    return F.coalesce(F.lower(F.regexp_replace(F.get(part, F.lit(0)), "^[0-9]", "")), F.lit("public"))


def level_of(label: Column, path: Column) -> Column:
    """A label in any spelling as public, restricted or confidential; what is none of these is taken from the path."""
    word = F.lower(F.regexp_replace(F.trim(label), "^[0-9]+", ""))
    return F.when(word.isin("public", "restricted", "confidential"), word).otherwise(level_of_path(path))


def source_of_chunk_file(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.(?:chunks|parents|children)\.json$", "")


def chunk_kind(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"\.(chunks|parents|children)\.json$", 1), F.lit(""))


def format_time(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1f s", seconds)).when(seconds < 3600, F.format_string("%.1f min", seconds / 60)).otherwise(F.format_string("%.1f h", seconds / 3600))


def percent(c: Column) -> Column:
    """``c``, at least zero, in percent with one decimal, halves up; null and NaN have none."""
    y = c * 100
    whole = F.floor(y)
    rest = y - whole
    tenth = F.floor(rest * 10)
    # 20 * rest against an odd number, in steps that lose no bit
    up = (16 * rest - (2 * tenth + 1)) + 4 * rest >= 0
    n = whole * 10 + tenth + up.cast("int")
    return F.when(c.isNull() | F.isnan(c), F.lit("—")).otherwise(F.format_string("%d.%d%%", F.floor(n / 10).cast("long"), (n % 10).cast("long")))


#: Labels and colours of the levels.
LEVEL_LABELS = {"public": "公开", "restricted": "受限", "confidential": "机密"}
LEVEL_COLOURS = {"restricted": "#FA8C16", "confidential": "#EC4F4F"}


def level_label(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LEVEL_LABELS.items() for x in kv])[level], F.lit("未知"))


def level_colour(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LEVEL_COLOURS.items() for x in kv])[level], F.lit("#535353"))


def ocr_language(code: Column) -> Column:
    """The recogniser's language for a language code."""
    low = F.lower(code)
    return F.when(low.contains("chi") | low.startswith("ch"), "ch").when(low.contains("jpn"), "japan").when(low.contains("kor"), "korean").otherwise("en")


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.7f", x.cast("double"))), ","), F.lit("]"))


#: Marks around a vector in text; another exchange format can name its own.
MARKS = ("/vector-begin/", "/vector-end/")


def write_vector(v: Column, marks: tuple[str, str] = MARKS) -> Column:
    return F.concat(F.lit(marks[0]), format_vector(v), F.lit(marks[1]))


def parse_vector(c: Column, marks: tuple[str, str] = MARKS) -> Column:
    """The numbers between the vector's marks; null where the text isn't such a vector."""
    return F.from_json(F.regexp_extract(c, rf"{re.escape(marks[0])}(\[[^\]]*\]){re.escape(marks[1])}", 1), "array<double>")


def with_similarities(c: Column, sims: Column, marks: tuple[str, str] = MARKS) -> Column:
    """A written vector with (level, similarity) pairs behind it, in place of any that were there."""
    said = F.array_join(F.transform(sims, lambda s: F.concat(s["level"], F.lit(":"), F.format_string("%.6f", s["similarity"]))), ",")
    return F.concat(F.regexp_extract(c, rf"^(.*?{re.escape(marks[1])})", 1), said)


def parse_similarities(c: Column, marks: tuple[str, str] = MARKS) -> Column:
    """Level to similarity, from what follows the vector; entries that are no numbers are null."""
    after = F.regexp_extract(c, rf"{re.escape(marks[1])}(.*)$", 1)
    return F.when(after != "", F.transform_values(F.str_to_map(after, F.lit(","), F.lit(":")), lambda _, v: v.try_cast("double")))


#: Element types of parsed documents, as they are spelled, and the chunk types they become.
CHUNK_TYPES = {
    "Title": "heading", "Header": "heading", "heading": "heading", "Table": "table", "table": "table", "Image": "image", "image": "image", "Figure": "image", "figure": "image",
    "Code": "code", "code": "code", "List": "list", "list": "list", "text": "text", "Text": "text", "paragraph": "text", "Paragraph": "text",
}


def chunk_type(c: Column) -> Column:
    """The chunk type of an element type; an unknown or missing one is other."""
    names = F.create_map(*[x for k, v in CHUNK_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(names[c], F.lit("other"))


def prompt(task: str, c: Column, most: int = 7000) -> Column:
    """A request to a language model over at most ``most`` characters of a text."""
    return F.concat(F.lit(task + "\n\n"), F.substring(c, 1, most))


#: Fixed value: what reads as a number with a fraction, an exponent or a name.
FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def coerced(c: Column) -> Column:
    """(kind, number): whether a setting's text is a truth value, a whole number, a number or text; blanks around a number don't count, around a word they do."""
    truth = F.when(F.lower(c).isin("true", "yes", "on"), 1.0).when(F.lower(c).isin("false", "no", "off"), 0.0)
    low = F.lower(strip(c))
    kind = F.when(truth.isNotNull(), "bool").when(low.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), "int").when(low.rlike(FLOAT), "float").otherwise("text")
    return F.struct(kind.alias("kind"), F.coalesce(truth, F.when(kind.isin("int", "float"), F.regexp_replace(low, "_", "").try_cast("double"))).alias("number"))


def markers(c: Column) -> Column:
    """The file names of the image markers in a text."""
    return F.regexp_extract_all(c, F.lit("##([^#\n]+)##"), F.lit(1))
