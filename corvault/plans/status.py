"""States and statistics: of files on their way through a scan, of levels, of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvault.functions import text as T

#: Endings of what a scan makes of a file.
_MADE = (".parents.json", ".children.json", ".chunks.json")


def ingest_status(pending: DataFrame, indexed: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, pending, indexed): files (level) that wait and documents (level, source) that are there; level null has the totals."""
    p = pending.groupBy("level").agg(F.count("*").alias("pending"))
    i = indexed.groupBy("level").agg(F.countDistinct("source").alias("indexed"))
    each = levels.select(F.col("classification").alias("level")).distinct().join(p, "level", "left").join(i, "level", "left").fillna(0, ["pending", "indexed"])
    return each.rollup("level").agg(F.sum("pending").alias("pending"), F.sum("indexed").alias("indexed"))


def _named(listing: DataFrame) -> DataFrame:
    name = F.col("name")
    made = F.greatest(*(F.when(name.endswith(e), F.lit(e)).otherwise("") for e in _MADE))
    ext = F.when(made != "", made).otherwise(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    return listing.where(~name.startswith(".")).withColumn("ending", ext).withColumn("stem", F.substring(name, F.lit(1), F.length(name) - F.length(ext)))


def file_states(listing: DataFrame, first_vectors: DataFrame, extensions: list[str], marks: tuple[str, str] = T.MARKS) -> DataFrame:
    """(stem, name, preprocessed, embedded, compared) of every source file of a working folder.

    ``listing`` (name); ``first_vectors`` (stem, vector): the vector text of the first parent of each file of parents.  A Markdown file
    beside a source of the same stem is made from it and no source itself; parents without a source don't count.
    """
    n = _named(listing)
    sources = n.where(F.col("ending").isin([f".{e}" for e in extensions]) & (F.col("ending") != ".md"))
    plain = n.where("ending = '.md'").join(sources.select("stem").distinct(), "stem", "left_anti")
    each = sources.select("stem", "name").unionByName(plain.select("stem", "name")).groupBy("stem").agg(F.min("name").alias("name"))
    parents = n.where(F.col("ending") == ".parents.json").select("stem").distinct().withColumn("made", F.lit(True))
    v = F.coalesce(F.col("vector"), F.lit(""))
    has = F.contains(v, F.lit(marks[0]))
    after = F.substring_index(v, marks[1], -1)
    told = first_vectors.select("stem", has.alias("embedded"), (has & F.contains(v, F.lit(marks[1])) & (after != "")).alias("compared"))
    no = F.lit(False)
    joined = each.join(parents, "stem", "left").join(told, "stem", "left").withColumn("made", F.coalesce("made", no))
    return joined.select("stem", "name", F.col("made").alias("preprocessed"), (F.col("made") & F.coalesce("embedded", no)).alias("embedded"), (F.col("made") & F.coalesce("compared", no)).alias("compared"))


def status_of(states: DataFrame, asked: DataFrame) -> DataFrame:
    """(filename, saved, preprocessed, embedded, compared) of asked names; one that was saved under a number (stem_1) is found by its stem, the least first."""
    a = asked.select(F.col(asked.columns[0]).alias("filename")).withColumn("want", F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""))
    s = states.withColumn("bare", F.regexp_replace("stem", "_[0-9]+$", ""))
    exact = a.join(s.select("stem", "preprocessed", "embedded", "compared"), a["want"] == s["stem"], "inner").withColumn("far", F.lit(0))
    near = a.join(s.where("stem != bare").select("stem", "bare", "preprocessed", "embedded", "compared"), a["want"] == s["bare"], "inner").drop("bare").withColumn("far", F.lit(1))
    best = exact.unionByName(near).groupBy("filename").agg(F.min_by(F.struct("preprocessed", "embedded", "compared"), F.struct("far", "stem")).alias("s"))
    no = F.lit(False)
    joined = a.join(best, "filename", "left")
    return joined.select("filename", F.col("s").isNotNull().alias("saved"), *(F.coalesce(F.col(f"s.{c}"), no).alias(c) for c in ("preprocessed", "embedded", "compared")))


def folder_statistics(listing: DataFrame, states: DataFrame) -> DataFrame:
    """(total_files, preprocessed, embedded, compared): one row; files that a scan made aren't counted."""
    n = _named(listing)
    sources = n.where(~F.col("ending").isin(*_MADE))
    beside = sources.where("ending != '.md'").select("stem").distinct()
    files_ = sources.join(beside.withColumn("beside", F.lit(True)), "stem", "left").where("not (ending = '.md' and coalesce(beside, false))")
    s = states.agg(F.count_if("preprocessed").alias("preprocessed"), F.count_if("embedded").alias("embedded"), F.count_if("compared").alias("compared"))
    return _beside(files_.agg(F.count("*").alias("total_files")), s)


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row as one row."""
    return a.withColumn("k_", F.lit(1)).join(b.withColumn("k_", F.lit(1)), "k_").drop("k_")


def without_files(listing: DataFrame, gone: DataFrame) -> DataFrame:
    """``listing`` (name, ...) without the files of ``gone`` (name) and what was made from them: the Markdown, parents and children of their stems."""
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    names = gone.select("name", stem.alias("stem"))
    dead = names.select("name")
    for e in (".md", ".parents.json", ".children.json"):
        dead = dead.unionByName(names.select(F.concat("stem", F.lit(e)).alias("name")))
    return listing.join(dead.distinct(), "name", "left_anti")


def comparison_statistics(scored: DataFrame, children: DataFrame, skip: float = 0.92) -> DataFrame:
    """(doc, level, max_similarity, parents, parents_skipped, children, children_skipped) of scored parents (doc, id, doc_id, level, sim) and children (doc, parent_doc_id).

    A parent is skipped if its greatest similarity in any level reaches ``skip``, and its children with it.
    """
    top = scored.groupBy("doc", "level").agg(F.max("sim").alias("max_similarity"))
    each = scored.groupBy("doc", "id").agg(F.max("sim").alias("m"), F.first("doc_id", True).alias("doc_id"))
    parents = each.groupBy("doc").agg(F.count("*").alias("parents"), F.count_if(F.col("m") >= skip).alias("parents_skipped"))
    flagged = skipped_children(children, each.where(F.col("m") >= skip).select("doc", "doc_id"))
    kids = flagged.groupBy("doc").agg(F.count("*").alias("children"), F.count_if("skipped").alias("children_skipped"))
    return top.join(parents, "doc").join(kids, "doc", "left").fillna(0, ["children", "children_skipped"])


def skipped_children(children: DataFrame, skipped: DataFrame) -> DataFrame:
    """``children`` (doc, parent_doc_id, ...) with ``skipped``: whether their parent is one of ``skipped`` (doc, doc_id); no parent is never skipped."""
    gone = skipped.where("doc_id is not null and doc_id != ''").select("doc", F.col("doc_id").alias("parent_doc_id")).distinct().withColumn("skipped", F.lit(True))
    return children.join(gone, ["doc", "parent_doc_id"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def cached(cache: DataFrame, model: str | None = None) -> DataFrame:
    """(model_name, n): entries of an embedding cache, of one model or of each."""
    rows = cache if model is None else cache.where(F.col("model_name") == model)
    return rows.groupBy("model_name").agg(F.count("*").alias("n"))
