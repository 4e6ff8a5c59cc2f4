"""The pN_ queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvault.llm import batch_dedup, byte_bpe, markup, near_duplicates, packing, scanned, shared_spans, splitting, subjects, vector_forest
from corvault.runtime import read, ship

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch_dedup.repeats(read(spark, sf_dir, "chunks"), "row_id", "text", "batch_no", 0.5, 3)
    return found.select(F.col("accepted_id").alias("accepted_row_id"), F.col("new_id").alias("new_row_id"))


def p1_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p1_found with similarities, each new batch in its turn against the table that the batches before it were appended to."""
    found = batch_dedup.repeats(read(spark, sf_dir, "chunks"), "row_id", "text", "batch_no", 0.5, 3, in_turn=True)
    return found.select(F.col("accepted_id").alias("accepted_row_id"), F.col("new_id").alias("new_row_id"), F.round("similarity", 6).alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(read(spark, sf_dir, "chunks"), ["row_id"], "text")
    forced = F.max((F.col("level") == "forced").cast("int")) == 1
    return pieces.groupBy("row_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk; chunk_index goes on from the chunk's own."""
    pieces = splitting.split_oversized(read(spark, sf_dir, "chunks"), ["row_id", "doc_id", "chunk_index"], "text")
    return pieces.select("row_id", "doc_id", (F.coalesce("chunk_index", F.lit(0)) + F.col("piece_no")).alias("chunk_index"), "start", "end", "level", "piece")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = shared_spans.sharing_rows(read(spark, sf_dir, "chunks"), "row_id", "text", 120)
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each chunk's text also stands in other chunks."""
    return shared_spans.shared_part(read(spark, sf_dir, "chunks"), "row_id", "text", 120).withColumnRenamed("id", "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_rows(read(spark, sf_dir, "chunks"), "row_id", "text", 0.5, 3)
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the chunks at the default similarity of 0.8 over five words."""
    g = near_duplicates.groups(read(spark, sf_dir, "chunks"), "row_id", "text")
    return g.select(F.col("id").alias("row_id"), "class_id", "links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned.found(read(spark, sf_dir, "chunks"), "row_id", "text", "file_path", "chunk_index")
    return found.select(F.col("id").alias("row_id"), "kind", "item")


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages as continuous paragraphs."""
    return scanned.repaired(read(spark, sf_dir, "chunks"), "row_id", "text", "file_path", "chunk_index").withColumnRenamed("id", "row_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector_forest.neighbours(read(spark, sf_dir, "embedding_cache"), "vec_no", "model_name", "dim", "vec", k=10, trees=3, extra=12, least=0.95)
    return near.select(F.least("id", "neighbour").alias("vec_no_a"), F.greatest("id", "neighbour").alias("vec_no_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of every vector whose number is divisible by 50, with the score of a retrieval hit."""
    near = vector_forest.neighbours(
        read(spark, sf_dir, "embedding_cache"), "vec_no", "model_name", "dim", "vec", k=10, queries=lambda ids: ids % 50 == 0
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))), 4)
    return near.select(F.col("id").alias("vec_no"), F.col("neighbour").alias("neighbour_vec_no"), F.col("rank").alias("rank_no"), score.alias("score"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.kinds_of(read(spark, sf_dir, "chunks"), "row_id", "text").withColumnRenamed("id", "row_id").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text without markup; headings, lists, code and formulas stay recognisable."""
    return markup.cleaned(read(spark, sf_dir, "chunks"), "row_id", "text").withColumnRenamed("id", "row_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(read(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(byte_bpe.count_tokens(read(spark, sf_dir, "documents"), "doc_id", "text"), "id", "n", 2048)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of every document go: containers of 2,048 tokens."""
    return _packed(spark, sf_dir).select(
        F.col("id").alias("doc_id"), "piece_no", F.col("start").alias("token_from"), F.col("size").alias("n_tokens"), "container_id"
    )


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, against the least that any packing needs, and the room left unused."""
    return packing.usage(_packed(spark, sf_dir), 2048)


def _areas(spark: SparkSession, sf_dir: str) -> list[str]:
    """The closed list of subject areas: a fixed table of a dozen rows."""
    return sorted({r.subject for r in read(spark, sf_dir, "subjects").select("subject").where("subject is not null").collect()})


def _subject_model(spark: SparkSession, sf_dir: str) -> subjects.Model:
    return subjects.fit(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "subject_labels"), "subject")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.assign(read(spark, sf_dir, "documents"), "doc_id", "text", _areas(spark, sf_dir), _subject_model(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each subject area in the corpus."""
    return subjects.composition(read(spark, sf_dir, "documents"), "doc_id", "text", _areas(spark, sf_dir), _subject_model(spark, sf_dir))


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in (p1_found, p1_in_turn, p2_found, p2_pieces, p3_found, p3_shared, p4_found, p4_groups, p5_found, p5_text, p6_found, p6_neighbours, p7_found, p7_clean, p8_ids, p9_containers, p9_usage, p10_found, p10_composition)}


_UNITS = r"regexp_extract_all(lower(text), '[a-z0-9äöüß]+|[\x{4e00}-\x{9fff}]')"
#: (id, s): the distinct sets of three consecutive units; pairs with their similarity from one half on.
_SIMILAR = f"""u AS (SELECT row_id AS id, batch_no AS batch, {_UNITS} AS us FROM chunks WHERE text IS NOT NULL),
    s AS (SELECT DISTINCT id, batch, unnest(list_transform(range(1, len(us) - 1), lambda i: us[i] || ' ' || us[i + 1] || ' ' || us[i + 2])) AS s FROM u WHERE len(us) >= 20),
    n AS (SELECT id, any_value(batch) AS batch, count(*) AS n FROM s GROUP BY id),
    o AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
    p AS (SELECT o.a, o.b, x.batch AS batch_a, y.batch AS batch_b, k / (x.n + y.n - k) AS similarity FROM o JOIN n x ON x.id = o.a JOIN n y ON y.id = o.b WHERE k >= 0.5::DOUBLE * (x.n + y.n - k))"""
#: Links in order of arrival; a step for each new record that has any decides whether it is accepted.
_ARRIVALS = f"""{_SIMILAR}, f AS (SELECT CASE WHEN (batch_a, a) < (batch_b, b) THEN a ELSE b END AS early, CASE WHEN (batch_a, a) < (batch_b, b) THEN b ELSE a END AS late,
      least(batch_a, batch_b) AS batch_early, greatest(batch_a, batch_b) AS batch_late, similarity FROM p WHERE greatest(batch_a, batch_b) > 0),
    l AS (SELECT late, batch_late, row_number() OVER (ORDER BY batch_late, late) AS step, bool_or(batch_early = 0) AS old, list(early) AS earlier FROM f GROUP BY late, batch_late),
    r(step, repeats) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT r.step + 1, CASE WHEN l.old OR len(list_filter(l.earlier, lambda e: NOT list_contains(r.repeats, e))) > 0 THEN list_append(r.repeats, l.late) ELSE r.repeats END FROM r JOIN l ON l.step = r.step + 1),
    z AS (SELECT repeats FROM r ORDER BY step DESC LIMIT 1),
    w AS (SELECT f.* FROM f, z WHERE list_contains(z.repeats, f.late) AND (f.batch_early = 0 OR NOT list_contains(z.repeats, f.early)))"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_ARRIVALS} SELECT early AS accepted_row_id, late AS new_row_id FROM w",
    "p1_in_turn": f"WITH RECURSIVE {_ARRIVALS} SELECT early AS accepted_row_id, late AS new_row_id, round(similarity, 6) AS similarity FROM w",
    "p2_found": r"SELECT row_id, CASE WHEN regexp_matches(text, '[^ \t\r\n\x{3000}。！？；]{1000}') THEN 'forced' ELSE 'natural' END AS cut FROM chunks WHERE length(text) > 1000",
    "p3_found": """WITH t AS (SELECT row_id AS id, text FROM chunks WHERE length(text) >= 120), g AS (SELECT DISTINCT id, substring(text, unnest(range(1, length(text) - 118))::INT, 120) AS g FROM t),
    m AS (SELECT g, list(id) AS ids FROM g GROUP BY g HAVING count(*) > 1), d AS (SELECT DISTINCT list_sort(ids) AS ids FROM m), e AS (SELECT unnest(ids) AS a, ids FROM d)
    SELECT DISTINCT a AS row_id_a, b AS row_id_b FROM (SELECT a, unnest(ids) AS b FROM e) WHERE a < b""",
    "p3_shared": """WITH t AS (SELECT row_id AS id, text FROM chunks WHERE length(text) >= 120), g AS (SELECT id, i, substring(text, i::INT, 120) AS g FROM (SELECT id, text, unnest(range(1, length(text) - 118)) AS i FROM t)),
    m AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT id) > 1), h AS (SELECT id, i FROM g JOIN m USING (g)), s AS (SELECT *, i - lag(i) OVER (PARTITION BY id ORDER BY i) AS gap FROM h),
    c AS (SELECT id, sum(CASE WHEN gap IS NULL OR gap > 120 THEN 120 ELSE gap END) AS shared, count(*) FILTER (gap IS NULL OR gap > 120) AS spans FROM s GROUP BY id)
    SELECT t.id AS row_id, length(text) AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, coalesce(spans, 0) AS spans FROM t LEFT JOIN c ON c.id = t.id""",
    "p4_found": f"WITH {_SIMILAR} SELECT a AS row_id_a, b AS row_id_b FROM p",
    "p6_found": """WITH v AS (SELECT vec_no AS id, model_name || chr(0) || dim AS space, vec::DOUBLE[] AS v FROM embedding_cache
      WHERE vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
    c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM v a JOIN v b ON a.space = b.space AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c WHERE cosine >= 0.95::DOUBLE)
    SELECT DISTINCT least(a, b) AS vec_no_a, greatest(a, b) AS vec_no_b FROM r WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
