"""The queries of the core, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvault.functions import embedding, models, scores
from corvault.functions import text as T
from corvault.operators import chunking, ingest, intervals, literal, similarity, stats
from corvault.plans import compare, dedup, pipeline, status
from corvault.runtime import checkpoint, read, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S, H = T.SPACE, T.HAN


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _re(x: str, pattern: str, to: str = "") -> str:
    """DuckDB: all matches replaced."""
    p = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{p}', '{to}', 'g')"


def _strip(x: str) -> str:
    return _re(x, f"^[{S}]+|[{S}]+$")


def _lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


_SECTION_SQL = "|".join(T.SKIPPED_SECTIONS).replace("{s}", f"[{S}]")
#: The level of a row of embeddings, by its number.
LEVEL_OF_ID = "['public','restricted','confidential'][(vec_id % 3 + 1)::INT]"


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("public", "restricted", "confidential"))), (F.pmod("vec_id", F.lit(3)) + 1).cast("int"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), level.alias("level"), F.col("embedding").alias("vec"), "label")


# Text


def _clean_sql(x: str) -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")
    x = _re(f"translate({x}, '{wide}', '{narrow}')", "[ \t]+", " ")
    x = f"array_to_string(list_transform({_lines(x)}, lambda l: {_strip('l')}), chr(10))"
    x = f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"
    x = f"regexp_replace({x}, '([{H}])[{S}]+([a-zA-Z0-9])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '([a-zA-Z0-9])[{S}]+([{H}])', '\\1\\2', 'g')"
    for mark in "。！？，、；：":
        x = _re(x, f"{mark}{{2,}}", mark)
    return x


@query(f"SELECT row_id, {_clean_sql('text')} AS cleaned FROM chunks")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("row_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x{01}-\x{08}\x{0b}-\x{0c}\x{0e}-\x{1f}\x{feff}]', '', 'g'), '\x{fffd}', '', 'g'), '\x{3000}{3,}', '　', 'g') AS cleaned FROM documents""")
def remove_garbage(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.remove_garbage(F.col("text")).alias("cleaned"))


_PIECES_SQL = "flatten([" + ", ".join("regexp_extract_all(text, '" + p.replace(r"\x{00}", r"\x{01}") + "')" for p in T._GARBAGE) + "])"


@query(f"""SELECT doc_id, round(coalesce(CASE WHEN length(text) > 0 THEN list_sum(list_transform({_PIECES_SQL}, lambda x: length(x))) / length(text) END, 0), 6) AS ratio FROM documents WHERE text IS NOT NULL""")
def garbage_ratio(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(T.garbage_ratio(F.col("text")), 6).alias("ratio"))


@query(
    f"""WITH l AS (SELECT row_id, unnest({_lines('text')}) AS line FROM chunks)
    SELECT row_id, count(*) FILTER (regexp_matches(line, '(?i)^[{S}]*(?:{_SECTION_SQL})[{S}]*$')) AS sections,
    count(*) FILTER (regexp_matches({_strip('line')}, '^\\$+.+\\$+$|^\\\\\\[.+\\\\\\]$|^\\\\\\(.+\\\\\\)$|^[0-9]+[{S}]*[+\\-*/=^][{S}]*[0-9]+')) AS formulas,
    count(*) FILTER ({_strip('line')} = '' OR regexp_matches({_strip('line')}, '^[0-9]+$|^[^\\p{{L}}\\p{{N}}_]+$|^[_-]{{3,}}$')) AS poor FROM l GROUP BY row_id"""
)
def line_kinds(spark, sf_dir):
    """Section headings, formula lines and poor lines of every chunk."""
    rows = read(spark, sf_dir, "chunks").select("row_id", F.explode(T.lines(F.col("text"))).alias("line"))
    n = lambda c, name: F.count_if(c).alias(name)
    line = F.col("line")
    return rows.groupBy("row_id").agg(n(T.is_skip_section(line), "sections"), n(T.is_formula_line(line), "formulas"), n(T.is_low_quality_line(line), "poor"))


@query(f"""SELECT row_id, array_to_string(list_filter({_lines('text')}, lambda l: NOT ({_strip('l')} = '' OR regexp_matches({_strip('l')}, '^[0-9]+$|^[^\\p{{L}}\\p{{N}}_]+$|^[_-]{{3,}}$'))), chr(10)) AS good FROM chunks""")
def good_lines(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("row_id", T.good_lines(F.col("text")).alias("good"))


def _tokens_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '[{H}]{{2,4}}|[a-zA-Z]{{3,}}'))"


@query(
    f"""WITH n AS (SELECT row_id, text, lead(text) OVER (PARTITION BY file_path ORDER BY chunk_index, row_id) AS next FROM chunks),
    t AS (SELECT row_id, {_tokens_sql('text')} AS a, {_tokens_sql('next')} AS b FROM n WHERE text IS NOT NULL AND next IS NOT NULL)
    SELECT row_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM t"""
)
def next_chunk_similarity(spark, sf_dir):
    """Token similarity of each chunk and the next one of its file."""
    rows = read(spark, sf_dir, "chunks").withColumn("next", F.lead("text").over(Window.partitionBy("file_path").orderBy("chunk_index", "row_id"))).where("text is not null and next is not null")
    return rows.select("row_id", F.round(T.paragraph_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    f"""WITH k AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[{H}]{{2,4}}'), list_transform(regexp_extract_all(text, '[a-zA-Z]{{3,}}'), lambda x: lower(x))) AS ks FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(ks) AS keyword, unnest(range(len(ks))) AS pos FROM k),
    c AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS first FROM e WHERE keyword NOT IN ({_STOP_SQL}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
    SELECT doc_id, keyword, n, rank FROM r WHERE rank <= 10"""
)
def keywords_top10(spark, sf_dir):
    return stats.keywords(read(spark, sf_dir, "documents"), "doc_id", "text", 10, T.STOP_WORDS).withColumnRenamed("id", "doc_id")


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))), ' ') AS emails,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}'))), ' ') AS dates,
    length(text) AS chars FROM documents WHERE text IS NOT NULL"""
)
def extract_metadata(spark, sf_dir):
    text = F.col("text")
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", said(T.emails(text)).alias("emails"), said(T.dates(text)).alias("dates"), F.length("text").alias("chars"))


@query(
    f"""WITH p AS (SELECT doc_id, text, {_lines('text')} AS l, string_split(text, chr(10) || chr(10)) AS ps, {_PIECES_SQL} AS g FROM documents WHERE length(text) > 0),
    m AS (SELECT doc_id, text, list_sum(list_transform(l, lambda x: length(x))) / len(l) AS mean, coalesce(list_sum(list_transform(g, lambda x: length(x))), 0) / length(text) AS ratio,
      len(list_distinct(list_transform(g, lambda x: substring(x, 1, 50)))) AS kinds, regexp_matches(text, '^#{{1,6}}[{S}]+[^\\n]+\\n?$') AS heading, length(regexp_extract(text, '^(#{{1,6}})', 1)) AS lvl,
      len(regexp_extract_all(text, '[{H}]')) AS han, len(regexp_extract_all(text, '[a-zA-Z]{{3,}}')) AS latin, len(ps) AS np,
      len(list_distinct(list_transform(list_filter(ps, lambda x: length(x) > 50), lambda x: substring(x, 1, 100)))) AS nd FROM p),
    s AS (SELECT doc_id, greatest(0, 100 - CASE WHEN mean > 200 THEN 20 ELSE 0 END - CASE WHEN mean < 10 THEN 20 ELSE 0 END - CASE WHEN ratio > 0.01 OR kinds > 5 THEN floor(ratio * 100)::INT ELSE 0 END) AS readability,
      greatest(0, 100 - CASE WHEN NOT heading AND length(text) > 1000 THEN 30 ELSE 0 END - CASE WHEN heading AND lvl > 1 THEN 10 ELSE 0 END) AS structure,
      greatest(0, 100 - CASE WHEN (han + 2 * latin) / length(text) < 0.3 THEN 30 ELSE 0 END - CASE WHEN np > 5 AND nd / np < 0.8 THEN 20 ELSE 0 END) AS content_richness FROM m)
    SELECT doc_id, floor(round(readability * 0.4::DOUBLE + structure * 0.3::DOUBLE + content_richness * 0.3::DOUBLE, 6))::INT AS overall_score, readability::INT AS readability, structure::INT AS structure, content_richness::INT AS content_richness FROM s"""
)
def quality_score(spark, sf_dir):
    q = T.quality(read(spark, sf_dir, "documents").where("length(text) > 0"), "text")
    return q.select("doc_id", "overall_score", "readability", "structure", "content_richness")


@query(
    f"""SELECT row_id, {_strip("regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS markdown,
    regexp_replace(regexp_replace(text, '(?m)^\\.{{2,}}[{S}]*[0-9]+[{S}]*$', '', 'g'), '(?m)^[0-9]+\\.[{S}]+\\.{{3,}}[{S}]*[0-9]+[{S}]*$', '', 'g') AS without_toc FROM chunks"""
)
def markdown_form(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("row_id", T.clean_markdown(F.col("text")).alias("markdown"), T.strip_toc_markers(F.col("text")).alias("without_toc"))


_NOISE_SQL = "[" + ", ".join(f"'{w}'" for w in T.NOISE_WORDS) + "]"


@query(
    f"""WITH t AS (SELECT row_id, {_strip('text')} AS s FROM chunks)
    SELECT row_id, CASE WHEN length(s) < 2 THEN 'undecided' WHEN length(s) > 200 THEN 'content' WHEN len(list_filter({_NOISE_SQL}, lambda w: contains(lower(s), w))) > 0 THEN 'noise' ELSE 'undecided' END AS noise FROM t"""
)
def noise_chunks(spark, sf_dir):
    said = F.coalesce(F.when(T.noise(F.col("text")), "noise").when(~T.noise(F.col("text")), "content"), F.lit("undecided"))
    return read(spark, sf_dir, "chunks").select("row_id", said.alias("noise"))


@query(f"""SELECT row_id, translate({_re('text', f'[{S}]')}, '{T.TRADITIONAL}', '{T.SIMPLIFIED}') AS normal FROM chunks""")
def normal_for_grams(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("row_id", T.for_grams(F.col("text")).alias("normal"))


_WORD_SQL = "lower(regexp_replace(trim(classification), '^[0-9]+', ''))"
LEVEL_SQL = f"""CASE WHEN {_WORD_SQL} IN ('public', 'restricted', 'confidential') THEN {_WORD_SQL}
    ELSE coalesce(lower(regexp_replace(list_filter(string_split(file_path, '/'), lambda p: p IN ('0Public', '1Restricted', '2Confidential'))[1], '^[0-9]', '')), 'public') END"""


@query(
    f"""SELECT row_id, {LEVEL_SQL} AS level, regexp_replace(regexp_extract(file_path, '([^/]+)$', 1), '\\.(?:chunks|parents|children)\\.json$', '') AS document,
    nullif(regexp_extract(file_path, '\\.(chunks|parents|children)\\.json$', 1), '') AS kind FROM chunks"""
)
def chunk_origin(spark, sf_dir):
    path = F.col("file_path")
    return read(spark, sf_dir, "chunks").select("row_id", T.level_of(F.col("classification"), path).alias("level"), T.source_of_chunk_file(path).alias("document"), T.chunk_kind(path).alias("kind"))


@query(
    """WITH w AS (SELECT row_id, text, array_to_string(list_filter([CASE WHEN coalesce(document_name, '') != '' THEN '<file_title>' || document_name || '</file_title>' END,
      CASE WHEN coalesce(abstract, '') != '' THEN '<file_abstract>' || abstract || '</file_abstract>' END, '<paragraph_content>' || coalesce(text, '') || '</paragraph_content>'], lambda x: x IS NOT NULL), chr(10)) AS wrapped FROM chunks)
    SELECT row_id, wrapped, coalesce(text, '') AS body FROM w"""
)
def wrapped_chunks(spark, sf_dir):
    """Chunks wrapped for an index, and unwrapped again."""
    w = read(spark, sf_dir, "chunks").select("row_id", T.wrap_chunk(F.col("document_name"), F.col("abstract"), F.col("text")).alias("wrapped"))
    return w.withColumn("body", T.unwrap_chunk(F.col("wrapped")))


@query("""SELECT vec_id, len(embedding) AS parsed, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(embedding[1]::DOUBLE, 7) AS first, round(embedding[len(embedding)]::DOUBLE, 7) AS last,
    round((vec_id % 7) / 10.0::DOUBLE, 6) AS public, NULL::DOUBLE AS restricted FROM embeddings""")
def vector_codec(spark, sf_dir):
    """Vectors written as text with similarities of two levels, one of them spoilt, and all of it read back."""
    sims = F.array(F.struct(F.lit("public").alias("level"), (F.pmod("vec_id", F.lit(7)) / 10).alias("similarity")))
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.concat(T.with_similarities(T.write_vector(F.col("embedding")), sims), F.lit(",restricted:x")).alias("t"))
    p = v.select("vec_id", T.parse_vector(F.col("t")).alias("v"), T.parse_similarities(F.col("t")).alias("s"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", F.size("v").alias("parsed"), F.round(total, 4).alias("total"), F.round(F.get("v", F.lit(0)), 7).alias("first"), F.round(F.element_at("v", -1), 7).alias("last"), F.round(F.col("s")["public"], 6).alias("public"), F.col("s")["restricted"].alias("restricted"))


_HREFS = ("a/b.html", "HTTPS://x.org", "javascript:alert(1)", "\x01javascript:alert(1)", "data:text/html,x", "mailto:a@b.c", "ftp://x", "#top", "")
_HREF_SQL = ", ".join("(" + ("chr(1) || " if h[:1] == "\x01" else "") + "'" + h.lstrip("\x01") + "')" for h in _HREFS)


@query(
    f"""WITH v(href) AS (VALUES {_HREF_SQL}), s AS (SELECT href, lower(regexp_extract(regexp_replace(href, '^[\\x{{01}}-\\x{{20}}]+', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme FROM v)
    SELECT href, scheme = '' OR scheme IN ('http', 'https', 'mailto', 'ftp') AS safe FROM s"""
)
def safe_hrefs(spark, sf_dir):
    v = spark.createDataFrame([(h,) for h in _HREFS], "href string")
    return v.select("href", T.safe_href(F.col("href")).alias("safe"))


# Chunkers


@query(
    """WITH d AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN [1] ELSE range(1, length(text) + 1, 450) END AS s FROM documents WHERE length(text) > 0)
    SELECT doc_id, unnest(range(len(s)))::INT AS window_no, substring(text, unnest(s), 500) AS text FROM d"""
)
def hard_windows(spark, sf_dir):
    return chunking.hard_windows(read(spark, sf_dir, "documents"), "doc_id", "text", 500, 50).withColumnRenamed("id", "doc_id")


@query(f"""WITH n AS (SELECT row_id, translate({_re('text', f'[{S}]')}, '{T.TRADITIONAL}', '{T.SIMPLIFIED}') AS t FROM chunks WHERE text IS NOT NULL)
    SELECT row_id, CASE WHEN length(t) >= 8 THEN len(list_distinct(list_transform(range(1, length(t) - 6), lambda i: substring(t, i, 8)))) ELSE 0 END::INT AS grams FROM n""")
def char_grams(spark, sf_dir):
    """Distinct 8-grams of each chunk."""
    c = read(spark, sf_dir, "chunks").where("text is not null")
    n = literal.gram_counts(c, "row_id", "text").withColumnRenamed("id", "row_id")
    return c.select("row_id").join(n, "row_id", "left").select("row_id", F.coalesce("grams", F.lit(0)).alias("grams"))


_BOXES_SQL = """l AS (SELECT row_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM chunks WHERE text IS NOT NULL),
    b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l),
    boxes AS (SELECT id, line_no, char_start, char_start + length(line) + 1 AS char_end, (line_no // 60)::INT AS page, 0 AS x0, line_no % 60 * 14 AS y0, 595 AS x1, line_no % 60 * 14 + 14 AS y1
      FROM b WHERE trim(translate(line, chr(9) || chr(13), '  ')) != '')"""


def _boxes(spark, sf_dir):
    return intervals.line_boxes(read(spark, sf_dir, "chunks").where("text is not null"), "row_id", "text")


@query(f"WITH {_BOXES_SQL} SELECT id AS row_id, * EXCLUDE (id) FROM boxes")
def line_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir).withColumnRenamed("id", "row_id")


_SPANS = """spans AS (SELECT row_id AS id, unnest(range(0, length(text), 200)) AS r_start, unnest(range(len(range(0, length(text), 200))))::INT AS r_id FROM chunks WHERE length(text) > 0)"""


def _spans(spark, sf_dir):
    s = F.sequence(F.lit(0), F.length("text") - 1, F.lit(200))
    rows = read(spark, sf_dir, "chunks").where("length(text) > 0").select(F.col("row_id").alias("id"), F.posexplode(s).alias("r_id", "r_start"))
    left = _boxes(spark, sf_dir).select("id", F.col("line_no").alias("l_id"), F.col("char_start").alias("l_start"), F.col("char_end").alias("l_end"))
    return left, rows.select("id", "r_id", F.col("r_start").cast("long").alias("r_start"), (F.col("r_start") + 200).cast("long").alias("r_end"))


def _overlap_sql(condition: str) -> str:
    return f"WITH {_BOXES_SQL}, {_SPANS} SELECT b.id AS row_id, b.line_no, s.r_id FROM boxes b JOIN spans s ON b.id = s.id AND {condition}"


@query(_overlap_sql("b.char_start < s.r_start + 200 AND s.r_start < b.char_end"))
def strict_overlap(spark, sf_dir):
    """Lines and stretches of 200 characters that share more than an end."""
    return intervals.strict_overlap(*_spans(spark, sf_dir), "id").select(F.col("id").alias("row_id"), F.col("l_id").alias("line_no"), "r_id")


@query(_overlap_sql("b.char_start <= s.r_start + 200 AND b.char_end >= s.r_start"))
def closed_overlap(spark, sf_dir):
    return intervals.closed_overlap(*_spans(spark, sf_dir), "id").select(F.col("id").alias("row_id"), F.col("l_id").alias("line_no"), "r_id")


@query(_overlap_sql("b.char_start <= s.r_start AND b.char_end >= s.r_start + 200"))
def containment(spark, sf_dir):
    return intervals.containment(*_spans(spark, sf_dir), "id").select(F.col("id").alias("row_id"), F.col("l_id").alias("line_no"), "r_id")


def _chunked(pieces):
    def run(spark, sf_dir):
        return chunking.chunk(read(spark, sf_dir, "documents"), "doc_id", "text", pieces).withColumnRenamed("id", "doc_id")

    return run


for _name, _pieces in (("recursive_chunks", chunking.recursive()), ("sentence_chunks", chunking.at_sentence()), ("merged_chunks", chunking.merging()), ("semantic_chunks", chunking.semantic())):
    _f = _chunked(_pieces)
    _f.__name__ = _name
    query()(_f)


@query()
def parent_child_chunks(spark, sf_dir):
    _, children = chunking.parent_child(read(spark, sf_dir, "documents"), "doc_id", "text")
    return children.select(F.col("id").alias("document"), "doc_id", "chunk_index", "text")


def _rewritten(change):
    def run(spark, sf_dir):
        return chunking.rewrite(read(spark, sf_dir, "chunks"), "row_id", "text", change).withColumnRenamed("id", "row_id")

    return run


for _name, _change in (("without_sections", chunking.without_sections), ("level_headings", chunking.level_headings), ("distinct_paragraphs", chunking.distinct_paragraphs)):
    _f = _rewritten(_change)
    _f.__name__ = _name
    query()(_f)


@query(
    r"""WITH p AS (SELECT row_id, regexp_replace(text, '\]\(h(ttps?://)', '](' || chr(1) || '\1', 'g') AS t FROM chunks),
    l AS (SELECT row_id, regexp_replace(t, '(https?://([-\p{L}\p{N}_.]+)(?::\d+)?(?:/[\p{L}\p{N}_/.]*(?:\?[\p{L}\p{N}_&=%.]*)?(?:#[\p{L}\p{N}_.]*)?)?)', '[链接: \2](\1)', 'g') AS t FROM p)
    SELECT row_id, replace(t, chr(1), 'h') AS text FROM l""".replace("\\\\", "\\")
)
def named_links(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("row_id", chunking.named_links(F.col("text")).alias("text"))


@query()
def contacts_on_lines(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("row_id", chunking.contacts_on_lines(F.col("text")).alias("text"))


# Scores

_ADJ = "greatest(0, (score - 0.37::DOUBLE) / 0.63::DOUBLE)"
_SHOW = "CASE classification WHEN 'confidential' THEN sqrt((0.6::DOUBLE - 0.37::DOUBLE) / 0.63::DOUBLE) WHEN 'restricted' THEN sqrt((0.7::DOUBLE - 0.37::DOUBLE) / 0.63::DOUBLE) ELSE 0.6::DOUBLE END"


@query(f"""SELECT hit_id, round({_ADJ}, 6) AS linear, round(sqrt({_ADJ}), 6) AS rooted, round({_SHOW}, 6) AS shown_from, sqrt({_ADJ}) >= {_SHOW} AS shown FROM retrieval_hits WHERE score IS NOT NULL""")
def adjusted_scores(spark, sf_dir):
    raw, show = F.col("score"), scores.display_threshold(F.col("classification"))
    return read(spark, sf_dir, "retrieval_hits").where("score is not null").select(
        "hit_id", F.round(scores.linear(raw), 6).alias("linear"), F.round(scores.rooted(raw), 6).alias("rooted"), F.round(show, 6).alias("shown_from"), (scores.rooted(raw) >= show).alias("shown")
    )


_CHANNELS = """i AS (SELECT hit_id, score AS v, (hit_id % 11) / 10.0::DOUBLE AS o, (hit_id * 7 % 130)::DOUBLE AS r, 100::DOUBLE AS q, CASE WHEN hit_id % 5 = 0 THEN NULL ELSE (hit_id % 10) / 10.0::DOUBLE END AS k FROM retrieval_hits WHERE score IS NOT NULL),
    s AS (SELECT *, CASE WHEN r >= 50 THEN least(1, r / q) ELSE 0 END AS st FROM i),
    c AS (SELECT *, CASE WHEN r >= 80 AND r / q >= 0.7 THEN least(1, greatest(0.85::DOUBLE, 0.7::DOUBLE + st * 0.3::DOUBLE, v)) WHEN v >= 0.7 THEN least(1, v + least(0.1::DOUBLE, (o + st) * 0.1::DOUBLE))
      WHEN v < 0.5 THEN least(0.55::DOUBLE * v + 0.3::DOUBLE * o + 0.15::DOUBLE * st, 0.5::DOUBLE) ELSE 0.55::DOUBLE * v + 0.3::DOUBLE * o + 0.15::DOUBLE * st END AS m FROM s)"""


@query(
    f"""WITH {_CHANNELS} SELECT hit_id, round(m, 9) AS combined, round(CASE WHEN k IS NULL THEN m WHEN k >= 0.6 THEN least(1, 0.7::DOUBLE * k + 0.3::DOUBLE * m) WHEN k < 0.2 THEN least(m, 0.4::DOUBLE) ELSE 0.5::DOUBLE * k + 0.5::DOUBLE * m END, 9) AS fused,
    CASE WHEN m >= 0.8 AND (o >= 0.3 OR r >= 30) THEN 'high' WHEN m >= 0.65 THEN 'medium' WHEN m >= 0.5 THEN 'low' END AS band FROM c"""
)
def score_channels(spark, sf_dir):
    """All channels of the combined score, its fusion with a reranker and its bands, over made-up literal signs."""
    h = read(spark, sf_dir, "retrieval_hits").where("score is not null")
    n = F.col("hit_id")
    i = h.select("hit_id", F.col("score").alias("v"), (n % 11 / 10).alias("o"), (n * 7 % 130).cast("double").alias("r"), F.lit(100.0).alias("q"), F.when(n % 5 != 0, n % 10 / 10).alias("k"))
    m = i.withColumn("m", scores.combined(F.col("v"), F.col("o"), F.col("r"), F.col("q")))
    return m.select("hit_id", F.round("m", 9).alias("combined"), F.round(scores.fused(F.col("m"), F.col("k")), 9).alias("fused"), scores.band(F.col("m"), scores.literal_support(F.col("o"), F.col("r"))).alias("band"))


# Vectors

_E = f"e AS (SELECT vec_id AS id, {LEVEL_OF_ID} AS level, embedding::DOUBLE[] AS v, label FROM embeddings)"
_DIST = "list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_KNN = f"""{_E}, d AS (SELECT q.id AS query_id, c.level, c.id, {_DIST} AS distance FROM e q JOIN e c ON q.id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY round(distance, 9), id) AS rank FROM d)"""


def _knn(spark, sf_dir, n=10):
    e = _leveled(spark, sf_dir)
    return similarity.nearest(e.where("id % 50 = 0"), e, n)


@query(f"WITH {_KNN} SELECT query_id, level, id AS vec_id, rank::INT AS rank, round(greatest(0, least(1, 1 - distance / 2)), 6) AS raw FROM k WHERE rank <= 10")
def nearest_by_level(spark, sf_dir):
    """The 10 nearest vectors of every level for the query set (numbers divisible by 50), against all vectors."""
    return _knn(spark, sf_dir).select("query_id", "level", F.col("id").alias("vec_id"), "rank", F.round(scores.raw_similarity(F.col("distance")), 6).alias("raw"))


@query(
    f"""WITH {_KNN}, h AS (SELECT query_id, level, id, distance, id // 4 AS parent FROM k WHERE rank <= 10),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, level, parent ORDER BY round(distance, 9), id) AS n FROM h)
    SELECT query_id, level, parent, id AS vec_id, 'parent ' || parent AS parent_text FROM b WHERE n = 1"""
)
def parent_child_search(spark, sf_dir):
    """The same search with four children to a parent: the best child of each parent, with the parent's text."""
    hits = _knn(spark, sf_dir).withColumn("parent", F.floor(F.col("id") / 4))
    parents = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("parent_id")).distinct().withColumn("parent_text", F.concat(F.lit("parent "), F.col("parent_id").cast("string")))
    return similarity.parent_child(hits, parents, "parent").select("query_id", "level", "parent", F.col("id").alias("vec_id"), "parent_text")


@query(
    f"""WITH {_KNN}, f AS (SELECT query_id, level, greatest(0, least(1, 1 - distance / 2)) AS raw FROM k WHERE rank = 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, list_position(['public','restricted','confidential'], level)) AS n FROM f WHERE raw > 0)
    SELECT query_id, level, round(raw, 6) AS raw FROM b WHERE n = 1"""
)
def best_level(spark, sf_dir):
    hits = _knn(spark, sf_dir, 1).withColumn("raw", F.round(scores.raw_similarity(F.col("distance")), 9)).where("raw > 0")
    rank = F.array_position(F.array(*map(F.lit, compare.LEVELS)), F.col("level"))
    return similarity.best_per(hits, ["query_id"], "raw", rank).select("query_id", "level", F.round("raw", 6).alias("raw"))


_PAIR = f"""{_E}, n AS (SELECT *, list_position(['public','restricted','confidential'], level) AS lr, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e),
    p AS (SELECT s.id AS source_id, s.level AS source_level, t.id AS target_id, t.level AS target_level, list_sum(list_transform(list_zip(s.v, t.v), lambda p: p[1] * p[2])) / (s.len * t.len) AS raw
      FROM n s JOIN n t ON s.lr > t.lr), m AS (SELECT * FROM p WHERE raw >= 0.3)"""


@query(f"WITH {_PAIR} SELECT source_id, source_level, target_id, target_level, round(raw, 6) AS raw, round(greatest(0, (raw - 0.37::DOUBLE) / 0.63::DOUBLE), 6) AS adjusted FROM m")
def cross_level_pairs(spark, sf_dir):
    """Pairs of a higher and a lower level with raw similarity of at least 0.3."""
    e = _leveled(spark, sf_dir)
    p = similarity.similar_pairs(e, e, 0.3)
    return p.select("source_id", "source_level", "target_id", "target_level", F.round("raw", 6).alias("raw"), F.round(scores.linear(F.col("raw")), 6).alias("adjusted"))


@query(
    f"""WITH {_PAIR}, c AS (SELECT level, count(*) AS n FROM e GROUP BY level), v(source_level, target_level) AS (VALUES ('restricted', 'public'), ('confidential', 'public'), ('confidential', 'restricted'))
    SELECT v.source_level, v.target_level, coalesce(a.n, 0) * coalesce(b.n, 0) AS total_checked, (SELECT count(*) FROM m WHERE m.source_level = v.source_level AND m.target_level = v.target_level) AS found
    FROM v LEFT JOIN c a ON a.level = v.source_level LEFT JOIN c b ON b.level = v.target_level"""
)
def pair_plan(spark, sf_dir):
    e = _leveled(spark, sf_dir)
    found = similarity.similar_pairs(e, e, 0.3).withColumn("band", F.lit("low"))
    return dedup.counters(found, e).select("source_level", "target_level", "total_checked", F.col("low").alias("found"))


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
    SELECT count(*) AS vectors, count(*) FILTER (abs(n - 1) > 0.01) AS bad, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS avg_norm FROM n""")
def norm_audit(spark, sf_dir):
    a = similarity.norm_audit(read(spark, sf_dir, "embeddings"), "embedding")
    return a.select("vectors", "bad", *(F.round(c, 6).alias(c) for c in ("min_norm", "max_norm", "avg_norm")))


@query("""WITH v AS (SELECT vec_no, vec::DOUBLE[] AS v FROM embedding_cache WHERE vec IS NOT NULL AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0),
    n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
    SELECT vec_no, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first, round(CASE WHEN n > 0 THEN v[len(v)] / n ELSE v[len(v)] END, 6) AS last FROM n""")
def normalised_vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embedding_cache").where(similarity._sound(F.col("vec"))).select("vec_no", scores.normalised(F.col("vec")).alias("v"))
    return v.select("vec_no", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query("""WITH h AS (SELECT vec_id // 10 AS doc, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS n FROM embeddings),
    x AS (SELECT doc, unnest(v) AS x, unnest(range(len(v))) AS i FROM h WHERE n <= 3), a AS (SELECT doc, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT doc, sqrt(sum(x * x)) AS n FROM a GROUP BY doc)
    SELECT doc, round(x / n, 6) AS first FROM a JOIN n USING (doc) WHERE i = 0""")
def summary_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 10))
    return similarity.summary_vector(e, "doc", "vec_id", "embedding").select("doc", F.round(F.element_at("vec", 1), 6).alias("first"))


# Literal signs

_GRAMS = f"""t AS (SELECT row_id, batch_no, file_path, translate({_re('text', f'[{S}]')}, '{T.TRADITIONAL}', '{T.SIMPLIFIED}') AS t FROM chunks WHERE batch_no >= 0),
    g AS (SELECT row_id, batch_no, file_path, unnest(range(0, length(t) - 7)) AS pos, substring(t, unnest(range(0, length(t) - 7))::INT + 1, 8) AS gram FROM t WHERE length(t) >= 8)"""


def _against_history(spark, sf_dir):
    c = read(spark, sf_dir, "chunks")
    new = c.where("batch_no > 0").select(F.col("row_id").alias("id"), "text")
    return new, c.where("batch_no = 0").select(F.lit("history").alias("level"), F.col("file_path").alias("doc"), "text")


@query(f"""WITH {_GRAMS}, q AS (SELECT DISTINCT row_id, gram FROM g WHERE batch_no > 0), i AS (SELECT DISTINCT gram FROM g WHERE batch_no = 0)
    SELECT row_id, count(*) AS grams, count(i.gram) AS hits, round(count(i.gram) / count(*), 6) AS overlap FROM q LEFT JOIN i USING (gram) GROUP BY row_id""")
def overlap_with_history(spark, sf_dir):
    """The part of the 8-grams of the new batches that stand anywhere in the history."""
    new, old = _against_history(spark, sf_dir)
    return literal.known(new, old).select(F.col("id").alias("row_id"), "grams", "hits", F.round(F.col("hits") / F.col("grams"), 6).alias("overlap"))


@query(f"""WITH {_GRAMS}, i AS (SELECT DISTINCT file_path AS doc, gram FROM g WHERE batch_no = 0), h AS (SELECT row_id, doc, pos FROM g JOIN i USING (gram) WHERE batch_no > 0),
    s AS (SELECT *, pos - row_number() OVER (PARTITION BY row_id, doc ORDER BY pos) AS island FROM h), r AS (SELECT row_id, doc, island, count(*) + 7 AS run FROM s GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY run DESC, doc) AS n FROM r) SELECT row_id, doc, run FROM b WHERE n = 1""")
def longest_run_in_history(spark, sf_dir):
    met = literal.against(*_against_history(spark, sf_dir), hits=False)
    return met.select(F.col("id").alias("row_id"), "doc", "run")


# Ingest


@query(f"""WITH k AS (SELECT *, {LEVEL_SQL} AS level FROM chunks) SELECT row_id, level, coalesce(nullif(CASE WHEN trim(document_name) != '' THEN document_name END, ''), source) AS document_name, coalesce(page, 0) AS page,
    CASE WHEN coalesce(doc_id, '') != '' THEN doc_id ELSE 'auto_' || substring(sha256(concat_ws('::', nullif(regexp_extract(file_path, '\\.(chunks|parents|children)\\.json$', 1), ''), source, chunk_index::VARCHAR)), 1, 16) END AS id FROM k""")
def canonical_chunks(spark, sf_dir):
    return ingest.canonical(read(spark, sf_dir, "chunks")).select("row_id", "level", "document_name", "page", "id")


@query("SELECT chunk_id, row_id, batch_no FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ts DESC, row_id DESC) AS n FROM chunks) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    """All batches upserted into the history, the newest delivery of a chunk last."""
    c = read(spark, sf_dir, "chunks")
    old = ingest.latest(c.where("batch_no = 0"), ["chunk_id"], F.desc("ts"), F.desc("row_id"))
    # the newest of the old and the new rows of a key counts, also where an old row is newer
    new = c.where("batch_no > 0")
    return ingest.upsert(old, new.unionByName(old.join(new.select("chunk_id").distinct(), "chunk_id", "left_semi")), "chunk_id", F.desc("ts"), F.desc("row_id")).select("chunk_id", "row_id", "batch_no")


_HASH = "regexp_replace(lower(regexp_replace(trim(content_hash), '(?i)^(?:sha-?256[:=]?|0x)\\s*', '')), '[^0-9a-f]', '', 'g')"
_PLAIN = f"CASE WHEN length({_HASH}) = 64 THEN {_HASH} END"


@query(f"""WITH i AS (SELECT file_path, {_PLAIN} AS h FROM incoming_files), k AS (SELECT DISTINCT {_PLAIN} AS h FROM indexed_files)
    SELECT i.file_path, i.h AS content_hash FROM i LEFT JOIN k ON i.h = k.h WHERE k.h IS NULL""")
def manifest_new(spark, sf_dir):
    """Incoming files whose content isn't in the manifest, whatever the notation of the hash."""
    plain = lambda t: read(spark, sf_dir, t).select("file_path", ingest.plain_hash(F.col("content_hash")).alias("content_hash"))
    return ingest.new_or_changed(plain("incoming_files"), plain("indexed_files"), ["content_hash"]).select("file_path", "content_hash")


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, chunk_id ORDER BY row_id) AS n FROM chunks) WHERE n = 1)
    SELECT file_path, sha256(array_to_string(list(coalesce(text, '') ORDER BY chunk_index, row_id), chr(10) || chr(10))) AS content_hash FROM f GROUP BY file_path""")
def content_hashes(spark, sf_dir):
    return ingest.content_hashes(read(spark, sf_dir, "chunks"))


@query("""WITH w AS (SELECT DISTINCT file_path FROM incoming_files), p AS (SELECT DISTINCT file_path FROM indexed_files)
    SELECT count(*) AS wanted, count(p.file_path) AS present, count(*) - count(p.file_path) AS missing, CASE WHEN count(*) = count(p.file_path) THEN 'skipped' ELSE 'process' END AS action FROM w LEFT JOIN p USING (file_path)""")
def ingest_precheck(spark, sf_dir):
    return ingest.precheck(read(spark, sf_dir, "incoming_files"), read(spark, sf_dir, "indexed_files"), "file_path")


@query(f"""WITH c AS (SELECT {LEVEL_SQL} AS level, chunk_id FROM chunks) SELECT l.classification AS level, count(DISTINCT c.chunk_id) AS n FROM levels l LEFT JOIN c ON c.level = l.classification GROUP BY ALL
    UNION ALL SELECT NULL, count(DISTINCT chunk_id) FROM chunks""")
def level_counts(spark, sf_dir):
    rows = ingest.canonical(read(spark, sf_dir, "chunks"))
    return stats.level_counts(rows, read(spark, sf_dir, "levels"), "chunk_id")


@query(f"""WITH c AS (SELECT {LEVEL_SQL} AS level FROM chunks) SELECT l.classification AS level, count(c.level) AS parents, 0::BIGINT AS children, count(c.level) AS total FROM levels l LEFT JOIN c ON c.level = l.classification GROUP BY ALL""")
def collection_counts(spark, sf_dir):
    return stats.collection_counts(ingest.canonical(read(spark, sf_dir, "chunks")), read(spark, sf_dir, "levels"))


@query("""WITH f AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM chunks GROUP BY source), r AS (SELECT greatest(1, size // 1000) AS r FROM f)
    SELECT sum(r)::BIGINT AS records, count(*) AS documents, round(sum(r) * 0.1::DOUBLE + count(*) * 0.5::DOUBLE, 4) AS seconds FROM r""")
def ingest_estimate(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").select("source", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return ingest.estimate(c, "size", "source").withColumn("seconds", F.round("seconds", 4))


@query("""WITH n AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS n FROM chunks)
    SELECT row_id, CASE WHEN n = 0 THEN source ELSE regexp_extract(source, '^(.*?)(\\.[^.]*)?$', 1) || '_' || n || regexp_extract(source, '^(.*?)(\\.[^.]*)?$', 2) END AS free_name FROM n""")
def free_names(spark, sf_dir):
    return ingest.free_names(read(spark, sf_dir, "chunks").select("row_id", "source"), "source", "row_id").select("row_id", "free_name")


@query("""SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, 'MD/0Public/') THEN substring(file_path, 12) ELSE '_external_' || substring(sha1(regexp_replace(file_path, '/[^/]*$', '')), 1, 8) || '/' || regexp_extract(file_path, '([^/]+)$', 1) END || '.md' AS target FROM chunks""")
def mirrored_paths(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select("file_path").distinct().withColumn("target", ingest.mirrored_path(F.col("file_path"), "MD/0Public"))


@query("""SELECT count(*) AS texts, count(*) FILTER (cache_key IN (SELECT cache_key FROM embedding_cache WHERE vec IS NOT NULL)) AS cached
    FROM (SELECT DISTINCT sha256('lumen-embed-64' || chr(0) || text) AS cache_key FROM chunks WHERE text IS NOT NULL)""")
def cache_probe(spark, sf_dir):
    """How many texts of chunks have a cached embedding."""
    keys = read(spark, sf_dir, "chunks").where("text is not null").select(ingest.embedding_key(F.lit("lumen-embed-64"), F.col("text")).alias("cache_key")).distinct()
    known = read(spark, sf_dir, "embedding_cache").where("vec is not null").select("cache_key").distinct().withColumn("known", F.lit(1))
    return keys.join(known, "cache_key", "left").agg(F.count("*").alias("texts"), F.count("known").alias("cached"))


@query("SELECT file_path, count(*) AS records, count(*) FILTER (coalesce(text, '') != '') AS with_text FROM chunks GROUP BY file_path")
def dry_run(spark, sf_dir):
    return read(spark, sf_dir, "chunks").groupBy("file_path").agg(F.count("*").alias("records"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"))


# Reports


@query("""WITH t AS (SELECT document_name, chunk_type, count(*) AS n, min(row_id) AS first FROM chunks GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY n DESC, first, chunk_type) AS k FROM t)
    SELECT document_name, chunk_type, n FROM r WHERE k = 1""")
def dominant_type(spark, sf_dir):
    return stats.mode(read(spark, sf_dir, "chunks"), "document_name", "chunk_type", "row_id")


@query("""WITH p AS (SELECT file_path AS doc, chunk_index AS page, text FROM chunks), l AS (SELECT DISTINCT doc, page, trim(line) AS line FROM (SELECT doc, page, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line) != ''),
    s AS (SELECT doc, count(DISTINCT page) AS all_pages FROM p GROUP BY doc HAVING count(DISTINCT page) >= 3), n AS (SELECT doc, line, count(*) AS pages FROM l GROUP BY ALL)
    SELECT doc, line, pages FROM n JOIN s USING (doc) WHERE pages >= greatest(3, floor(all_pages * 0.6::DOUBLE))""")
def boilerplate_lines(spark, sf_dir):
    return stats.boilerplate_lines(read(spark, sf_dir, "chunks"), "file_path", "chunk_index", "text")


@query("""WITH d AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS delta FROM events),
    r AS (SELECT *, min(delta) OVER w > 0 AND count(delta) OVER w = 4 AND sum(delta) OVER w > 100 AS run FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT event_type, count(*) AS samples, max(value) AS peak, round(sum(delta), 4) AS total_delta, bool_or(run) AS leaking FROM r GROUP BY event_type""")
def series_report(spark, sf_dir):
    r = stats.series_report(read(spark, sf_dir, "events"), "event_type", F.struct("ts", "event_id"), "value")
    return r.withColumn("total_delta", F.round("total_delta", 4))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def retained_events(spark, sf_dir):
    """The three newest events of each type."""
    return stats.retained(read(spark, sf_dir, "events"), "event_type", F.desc("ts"), F.desc("event_id"), keep=3).select("event_type", "event_id")


@query("SELECT event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def latest_per_type(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_vec_no ORDER BY score DESC, hit_id) AS n FROM retrieval_hits WHERE score IS NOT NULL) SELECT query_vec_no, vec_no, score FROM h WHERE n = 1""")
def best_hit(spark, sf_dir):
    return similarity.best_per(read(spark, sf_dir, "retrieval_hits").where("score is not null"), ["query_vec_no"], "score", "hit_id").select("query_vec_no", "vec_no", "score")


@query("""SELECT hit_id, CASE WHEN score IS NULL THEN '—' WHEN score * 100 * 4 = floor(score * 100 * 4) THEN printf('%.1f%%', floor(score * 1000 + 0.5::DOUBLE) / 10) ELSE printf('%.1f%%', score * 100) END AS shown,
    CASE classification WHEN 'public' THEN '公开' WHEN 'restricted' THEN '受限' WHEN 'confidential' THEN '机密' ELSE '未知' END AS label,
    CASE classification WHEN 'restricted' THEN '#FA8C16' WHEN 'confidential' THEN '#EC4F4F' ELSE '#535353' END AS colour FROM retrieval_hits""")
def percent_labels(spark, sf_dir):
    level = F.col("classification")
    return read(spark, sf_dir, "retrieval_hits").select("hit_id", T.percent(F.col("score")).alias("shown"), T.level_label(level).alias("label"), T.level_colour(level).alias("colour"))


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    from corvault.streaming.ingest import event_windows as windows

    w = windows(read(spark, sf_dir, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


# Composite plans


def _corpus(spark: SparkSession, sf_dir: str, rows: str = "batch_no = 0") -> DataFrame:
    """Chunks with text as a corpus (id, level, doc, vec, text); the accepted ones if not said otherwise."""
    c = ingest.canonical(read(spark, sf_dir, "chunks").where(rows)).where("text != ''")
    return c.select(F.col("row_id").alias("id"), "level", F.col("document_name").alias("doc"), embedding.get()(F.col("text")).alias("vec"), "text")


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All new documents: their chunks as parents, and children cut from them; a chunk delivered again counts once."""
    c = ingest.canonical(read(spark, sf_dir, "chunks").where("batch_no > 0")).where("text != ''")
    c = ingest.latest(c, ["file_path", "chunk_index"], F.col("row_id")).select(F.col("file_path").alias("doc"), F.col("chunk_index").alias("idx"), F.col("id").alias("doc_id"), "text")
    cut = chunking.chunk(c.select(F.struct("doc", "idx", "doc_id").alias("own"), "text"), "own", "text", chunking.recursive(500, 60))
    number = F.row_number().over(Window.partitionBy("id.doc").orderBy("id.idx", "chunk_index")) - 1
    children = cut.select("id.doc", number.alias("idx"), "id.doc_id", "text")
    vec = embedding.get()(F.col("text"))
    return c.withColumn("vec", vec), children.withColumn("vec", vec)


@query()
def search(spark, sf_dir):
    """Nearest chunks of each level, of all, for the chunks whose number is divisible by 50."""
    corpus = checkpoint(_corpus(spark, sf_dir, "true"))
    hits = similarity.nearest(corpus.where("id % 50 = 0").select("id", F.lit("query").alias("level"), "vec"), corpus, 5)
    return hits.select(F.col("query_id").alias("row_id"), "level", F.col("id").alias("hit_row_id"), "rank", F.round(scores.raw_similarity(F.col("distance")), 4).alias("raw"))


@query()
def compare_documents(spark, sf_dir):
    """All new documents against the accepted corpus, from the whole to the parts."""
    parents, children = map(checkpoint, _documents(spark, sf_dir))
    return compare.compare(parents, children, checkpoint(_corpus(spark, sf_dir)))


@query()
def scan_texts(spark, sf_dir):
    """Stretches of the new texts that are like confidential or restricted passages."""
    asked = read(spark, sf_dir, "chunks").where("batch_no > 0").select("row_id", "text")
    found = compare.scan(asked, "row_id", "text", embedding.get(), checkpoint(_corpus(spark, sf_dir)))
    return found.select(F.col("id").alias("row_id"), "chunk_no", "level", F.round("similarity", 4).alias("similarity"), "matched_id", "start", "end", "content")


@query()
def dedup_matches(spark, sf_dir):
    """All chunks of a higher level near one of a lower level, from the threshold of deletion on, with literal signs and bands."""
    return dedup.matches(checkpoint(_corpus(spark, sf_dir, "true")), 0.75, texts=False)


# States and statistics


@query(f"""WITH p AS (SELECT {LEVEL_SQL} AS level, file_path FROM incoming_files), i AS (SELECT {LEVEL_SQL} AS level, source FROM chunks WHERE batch_no = 0),
    e AS (SELECT l.classification AS level, (SELECT count(*) FROM p WHERE p.level = l.classification) AS pending, (SELECT count(DISTINCT source) FROM i WHERE i.level = l.classification) AS indexed FROM levels l)
    SELECT level, pending, indexed FROM e UNION ALL SELECT NULL, sum(pending)::BIGINT, sum(indexed)::BIGINT FROM e""")
def ingest_status(spark, sf_dir):
    """Files that wait and documents that are indexed, by level and in all."""
    leveled = lambda d: d.withColumn("level", T.level_of(F.col("classification"), F.col("file_path")))
    return status.ingest_status(leveled(read(spark, sf_dir, "incoming_files")), leveled(read(spark, sf_dir, "chunks").where("batch_no = 0")), read(spark, sf_dir, "levels"))


def _scan_folder(spark, sf_dir):
    """A working folder made of the chunks' sources: every file, Markdown beside some, parents of some, with vectors for some of these and similarities for some of those."""
    n = read(spark, sf_dir, "chunks").select(F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1).alias("doc")).distinct().where("doc != ''").select(F.regexp_replace("doc", r"\.md$", "").alias("stem"), F.length("doc").alias("k"))
    listing = n.select(F.concat("stem", F.lit(".pdf")).alias("name")).unionByName(n.where("k % 3 = 0").select(F.concat("stem", F.lit(".md")).alias("name"))).unionByName(n.where("k % 2 = 0").select(F.concat("stem", F.lit(".parents.json")).alias("name")))
    text = F.when(F.col("k") % 4 == 0, F.concat(F.lit("".join((T.MARKS[0], "[1.0]", T.MARKS[1]))), F.when(F.col("k") % 8 == 0, "public:0.5").otherwise("")))
    return listing, n.where("k % 2 = 0").select("stem", text.alias("vector"))


_FOLDER = r"""n AS (SELECT DISTINCT regexp_replace(regexp_extract(file_path, '([^/]+)/[^/]+$', 1), '\.md$', '') AS stem, length(regexp_extract(file_path, '([^/]+)/[^/]+$', 1)) AS k FROM chunks WHERE regexp_extract(file_path, '([^/]+)/[^/]+$', 1) != '')"""


@query(f"WITH {_FOLDER} SELECT stem, stem || '.pdf' AS name, k % 2 = 0 AS preprocessed, k % 4 = 0 AS embedded, k % 8 = 0 AS compared FROM n")
def scan_states(spark, sf_dir):
    """How far each file of a working folder is: saved, preprocessed, embedded, compared."""
    listing, first = _scan_folder(spark, sf_dir)
    return status.file_states(listing, first, ["pdf", "md"])


@query(f"WITH {_FOLDER} SELECT count(*) AS total_files, count(*) FILTER (k % 2 = 0) AS preprocessed, count(*) FILTER (k % 4 = 0) AS embedded, count(*) FILTER (k % 8 = 0) AS compared FROM n")
def scan_statistics(spark, sf_dir):
    listing, first = _scan_folder(spark, sf_dir)
    return status.folder_statistics(listing, status.file_states(listing, first, ["pdf", "md"]))


@query("""WITH s AS (SELECT query_vec_no % 7 AS doc, query_vec_no AS id, coalesce(classification, '') AS level, coalesce(score, 0) AS sim FROM retrieval_hits),
    t AS (SELECT doc, level, max(sim) AS max_similarity FROM s GROUP BY ALL), e AS (SELECT doc, id, max(sim) AS m FROM s GROUP BY ALL),
    p AS (SELECT doc, count(*) AS parents, count(*) FILTER (m >= 0.92::DOUBLE) AS parents_skipped FROM e GROUP BY doc),
    k AS (SELECT h.query_vec_no % 7 AS doc, bool_or(e.m >= 0.92::DOUBLE) AS skipped FROM retrieval_hits h JOIN e ON e.id = h.query_vec_no GROUP BY h.hit_id, h.query_vec_no),
    c AS (SELECT doc, count(*) AS children, count(*) FILTER (skipped) AS children_skipped FROM k GROUP BY doc)
    SELECT t.doc, t.level, round(t.max_similarity, 6) AS max_similarity, parents, parents_skipped, children, children_skipped FROM t JOIN p USING (doc) JOIN c USING (doc)""")
def comparison_statistics(spark, sf_dir):
    """Logged hits as scored parents in seven documents, and as their children."""
    h = read(spark, sf_dir, "retrieval_hits")
    doc, own = (F.col("query_vec_no") % 7).alias("doc"), F.col("query_vec_no").cast("string")
    scored = h.select(doc, F.col("query_vec_no").alias("id"), own.alias("doc_id"), F.coalesce("classification", F.lit("")).alias("level"), F.coalesce("score", F.lit(0.0)).alias("sim"))
    s = status.comparison_statistics(scored, h.select("hit_id", doc, own.alias("parent_doc_id")))
    return s.select("doc", "level", F.round("max_similarity", 6).alias("max_similarity"), "parents", "parents_skipped", "children", "children_skipped")


@query("SELECT model_name, count(*) AS n FROM embedding_cache GROUP BY model_name")
def cache_counts(spark, sf_dir):
    return status.cached(read(spark, sf_dir, "embedding_cache"))


@query("""WITH x AS (SELECT vec_id, unnest(range(15)) AS i, embedding FROM embeddings), e AS (SELECT vec_id, i, exp(embedding[i + 1]::DOUBLE) AS e FROM x), p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rank FROM p) SELECT vec_id, rank::INT AS rank, 'label ' || i AS label, round(p, 6) AS probability FROM r WHERE rank <= 5""")
def top_labels(spark, sf_dir):
    """The first 15 numbers of each vector as logits of labels."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 15), lambda x: x.cast("double")).alias("l"))
    t = e.select("vec_id", F.posexplode(models.top_labels(F.col("l"), [f"label {i}" for i in range(15)])).alias("rank", "t"))
    return t.select("vec_id", (F.col("rank") + 1).alias("rank"), "t.label", F.round("t.probability", 6).alias("probability"))


@query("""WITH n AS (SELECT row_id, document_name, row_number() OVER (PARTITION BY document_name ORDER BY row_id) - 1 AS n FROM chunks WHERE document_name IS NOT NULL)
    SELECT row_id, length(document_name) % 3 = 0 AS noise FROM n WHERE n % 50 + 1 <> 7""")
def noise_verdicts(spark, sf_dir):
    """Requests for verdicts on chunks, and replies to them read back: a line for each number but 7, and lines that mean nothing."""
    c = read(spark, sf_dir, "chunks").where("document_name is not null")
    asked = models.verdict_requests(c.select("row_id", F.coalesce("text", F.lit("")).alias("text"), "document_name"), "row_id", "text", "Which are noise?", "document_name")
    line = lambda i: F.concat(i.cast("string"), F.when(F.length("group") % 3 == 0, ": yes, it is").otherwise(" : no"))
    told = F.transform(F.filter(F.sequence(F.lit(1), F.size("ids")), lambda i: i != 7), line)
    return models.verdicts(asked.select("ids", F.concat(F.array_join(told, "\n"), F.lit("\n99: YES\nx: YES\nnothing")).alias("reply"))).select(F.col("id").alias("row_id"), "noise")


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'done' WHEN 2 THEN 'skipped' WHEN 3 THEN 'other' ELSE 'start' END AS phase, CASE event_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' WHEN 2 THEN 'confidential' ELSE '' END AS level,
      CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0::DOUBLE END AS own FROM events),
    r AS (SELECT * FROM (VALUES ('public', 0.0, 0.33, 0.05), ('restricted', 0.33, 0.67, 0.38), ('confidential', 0.67, 1.0, 0.72)) AS v(level, low, high, first))
    SELECT event_id, round(CASE WHEN own IS NOT NULL AND low IS NULL THEN own WHEN own IS NOT NULL THEN low::DOUBLE + own * (high - low)::DOUBLE WHEN phase IN ('done', 'skipped') THEN coalesce(high, 0.5)::DOUBLE WHEN phase = 'start' THEN coalesce(first, 0)::DOUBLE ELSE 0.1::DOUBLE END, 6) AS progress
    FROM e LEFT JOIN r USING (level)""")
def overall_progress(spark, sf_dir):
    n = F.col("event_id")
    phase = F.element_at(F.array(*map(F.lit, ("start", "done", "skipped", "other", "start"))), (n % 5 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ("public", "restricted", "confidential", ""))), (n % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.round(models.overall_progress(phase, level, F.when(n % 3 == 0, n % 10 / 10)), 6).alias("progress"))


@query()
def processed_documents(spark, sf_dir):
    """The cleaning pipeline over all documents: sizes before and after, scores, and the number of semantic chunks."""
    p = pipeline.process(read(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select(F.col("id").alias("doc_id"), "original_length", "length", "title", "overall_score", F.size("chunks").alias("chunks"))


@query()
def document_chunks(spark, sf_dir):
    """All documents cleaned and split, with the type of each chunk's lines."""
    return pipeline.chunk_with_metadata(read(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "chunk_index", "char_start", "char_end", "chunk_type", "document_name")


# Smaller operators of ingest, dedup and the services


@query("""SELECT event_id, CASE WHEN s < 60 THEN printf('%.1f s', s) WHEN s < 3600 THEN printf('%.1f min', s / 60) ELSE printf('%.1f h', s / 3600) END AS said FROM (SELECT event_id, (event_id * 37 % 9000 * 6 + 1)::DOUBLE AS s FROM events)""")
def format_times(spark, sf_dir):
    s = (F.col("event_id") * 37 % 9000 * 6 + 1).cast("double")
    return read(spark, sf_dir, "events").select("event_id", T.format_time(s).alias("said"))


_TYPE_SQL = "CASE WHEN chunk_type IN ('Title', 'Header', 'heading') THEN 'heading' WHEN chunk_type IN ('Image', 'image', 'Figure', 'figure') THEN 'image' WHEN lower(chunk_type) IN ('table', 'code', 'list') THEN lower(chunk_type) WHEN lower(chunk_type) IN ('text', 'paragraph') THEN 'text' ELSE 'other' END"


@query(f"SELECT row_id, {_TYPE_SQL} AS chunk_type, length('Give a title.' || chr(10) || chr(10) || substring(coalesce(text, ''), 1, 3000)) AS prompt_chars FROM chunks")
def chunk_types_and_prompts(spark, sf_dir):
    return read(spark, sf_dir, "chunks").select(
        "row_id", T.chunk_type(F.col("chunk_type")).alias("chunk_type"), F.length(T.prompt("Give a title.", F.coalesce("text", F.lit("")), 3000)).alias("prompt_chars")
    )


_SETTINGS = ("true", " No ", "no", "17", " 17", "-3", "0.5", "1e3", "1e3x", ".5e2", "5.", "text", "", "ON", "0", "1")


@query(
    "WITH v(s) AS (VALUES " + ", ".join(f"('{x}')" for x in _SETTINGS) + r"""), l AS (SELECT s, lower(trim(s)) AS w, lower(s) AS b FROM v),
    k AS (SELECT s, w, CASE WHEN b IN ('true', 'yes', 'on', 'false', 'no', 'off') THEN 'bool' WHEN regexp_matches(w, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches(w, '^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?[0-9]+e[+-]?[0-9]+$') THEN 'float' ELSE 'text' END AS kind FROM l)
    SELECT s AS setting, kind, CASE kind WHEN 'bool' THEN (w IN ('true', 'yes', 'on'))::INT::DOUBLE WHEN 'text' THEN NULL ELSE TRY_CAST(w AS DOUBLE) END AS number FROM k"""
)
def coerced_settings(spark, sf_dir):
    v = spark.createDataFrame([(x,) for x in _SETTINGS], "setting string")
    return v.select("setting", T.coerced(F.col("setting")).alias("c")).select("setting", "c.kind", "c.number")


@query("""WITH p AS (SELECT file_path, min(row_id) AS parent FROM chunks GROUP BY file_path), t AS (SELECT p.file_path, p.parent, c.text FROM p JOIN chunks c ON c.row_id = p.parent)
    SELECT c.row_id, t.parent, substring(t.text, 1, 300) AS parent_text FROM chunks c LEFT JOIN t USING (file_path)""")
def parent_texts(spark, sf_dir):
    """The first chunk of a file as the parent of its chunks, with the text cut as for a report."""
    c = read(spark, sf_dir, "chunks")
    first = ingest.latest(c, ["file_path"], F.col("row_id")).select("file_path", F.col("row_id").alias("parent"), F.substring("text", 1, 300).alias("parent_text"))
    return c.select("row_id", "file_path").join(first, "file_path", "left").select("row_id", "parent", "parent_text")


@query("""SELECT row_id, coalesce(doc_id, '') <> '' AND EXISTS (SELECT 1 FROM chunks p WHERE p.file_path = c.file_path AND p.doc_id = c.doc_id AND length(p.text) > 1000) AS skipped FROM chunks c""")
def skip_propagation(spark, sf_dir):
    """Chunks as children of their doc_id: whether a parent of that id in their file is skipped (here: oversized)."""
    c = read(spark, sf_dir, "chunks")
    kids = c.select("row_id", F.col("file_path").alias("doc"), F.col("doc_id").alias("parent_doc_id"))
    return status.skipped_children(kids, c.where("length(text) > 1000").select(F.col("file_path").alias("doc"), "doc_id")).select("row_id", "skipped")


@query("""SELECT 'retired' AS kind, file_path FROM (SELECT file_path FROM indexed_files EXCEPT SELECT file_path FROM incoming_files)
    UNION ALL SELECT 'again', file_path FROM (SELECT file_path FROM indexed_files INTERSECT SELECT file_path FROM incoming_files)""")
def source_sets(spark, sf_dir):
    old, new = (read(spark, sf_dir, t).select("file_path") for t in ("indexed_files", "incoming_files"))
    return old.subtract(new).select(F.lit("retired").alias("kind"), "file_path").unionByName(old.intersect(new).select(F.lit("again").alias("kind"), "file_path"))


_READY = f"""{_PAIR}, r AS (SELECT *, (raw - 0.37::DOUBLE) / 0.63::DOUBLE AS adjusted FROM m WHERE (raw - 0.37::DOUBLE) / 0.63::DOUBLE >= 0.02)"""


@query(f"WITH {_READY}, q AS (SELECT *, row_number() OVER (PARTITION BY source_level, target_level ORDER BY round(adjusted, 9) DESC, source_id, target_id) AS no FROM r) SELECT source_level, target_level, no, source_id, target_id FROM q")
def dedup_ready(spark, sf_dir):
    """Pairs at or above a threshold, numbered within their pair of levels; every pair is taken to have literal support."""
    found = _found(spark, sf_dir)
    w = Window.partitionBy("source_level", "target_level").orderBy(F.desc(F.round("adjusted", 9)), "source_id", "target_id")
    return dedup.ready(found, 0.02).withColumn("no", F.row_number().over(w)).select("source_level", "target_level", "no", "source_id", "target_id")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _leveled(spark, sf_dir)
    return similarity.similar_pairs(e, e, 0.3).withColumn("adjusted", scores.linear(F.col("raw"))).withColumn("overlap", F.lit(1.0)).withColumn("run", F.lit(30))


@query(f"WITH {_READY} SELECT e.id AS vec_id, e.level FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = e.id AND r.source_level = e.level)")
def apply_dedup(spark, sf_dir):
    """The vectors that stay when the higher ones of ready pairs are deleted."""
    return dedup.apply(_leveled(spark, sf_dir), _found(spark, sf_dir), 0.02).select(F.col("id").alias("vec_id"), "level")


@query(f"""WITH {_READY} SELECT source_level, count(DISTINCT source_id) AS documents, round(max(raw), 6) AS max_raw, count(*) FILTER (adjusted >= 0.1) AS strong FROM r GROUP BY source_level""")
def compare_statistics(spark, sf_dir):
    r = dedup.ready(_found(spark, sf_dir), 0.02)
    return r.groupBy("source_level").agg(F.countDistinct("source_id").alias("documents"), F.round(F.max("raw"), 6).alias("max_raw"), F.count_if(F.col("adjusted") >= 0.1).alias("strong"))


@query("SELECT row_id, ts FROM chunks WHERE classification = 'confidential' AND page = 2")
def metadata_filter(spark, sf_dir):
    """A predicate on metadata; it reaches the scan."""
    return read(spark, sf_dir, "chunks").where("classification = 'confidential' and page = 2").select("row_id", "ts")


@query("SELECT row_id, chunk_id FROM chunks ORDER BY sha256(row_id || ':3'), row_id LIMIT 100")
def sampled_chunks(spark, sf_dir):
    """100 chunks without replacement, the same in every run."""
    return ingest.sample(read(spark, sf_dir, "chunks").select("row_id", "chunk_id"), "row_id", 100, seed=3)


@query()
def html_markdown(spark, sf_dir):
    """Chunks with HTML read as pages."""
    from corvault.sources.files import html_markdown as convert

    c = read(spark, sf_dir, "chunks").where(F.col("text").rlike("</?[a-zA-Z][^<>]*>"))
    return chunking.rewrite(c, "row_id", "text", convert).withColumnRenamed("id", "row_id")


@query("""WITH n AS (SELECT file_path, count(*) AS rows, count(*) FILTER (coalesce(text, '') != '') AS filled, bool_or(page IS NOT NULL) AS paged, max(ts) AS newest FROM chunks GROUP BY file_path)
    SELECT file_path, rows, CASE WHEN filled = 0 THEN 'empty' WHEN filled < rows THEN 'partial' ELSE 'complete' END AS status, paged, newest FROM n""")
def file_status(spark, sf_dir):
    n = read(spark, sf_dir, "chunks").groupBy("file_path").agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("filled"), F.bool_or(F.col("page").isNotNull()).alias("paged"), F.max("ts").alias("newest")
    )
    status = F.when(F.col("filled") == 0, "empty").when(F.col("filled") < F.col("rows"), "partial").otherwise("complete")
    return n.select("file_path", "rows", status.alias("status"), "paged", "newest")
