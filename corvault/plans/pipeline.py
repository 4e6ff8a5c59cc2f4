"""From files to an index: cleaning pipelines, splitting with metadata, preprocessing with a log, ingest with a manifest, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvault.functions import embedding, scores
from corvault.functions import text as T
from corvault.operators import chunking, ingest, intervals, similarity
from corvault.operators.ingest import Table
from corvault.runtime import checkpoint
from corvault.sources import files


def cleaned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): texts without garbage, sections of no content, poor lines and repeated paragraphs, with level headings and named links."""
    rows = df.select(F.col(id_col).alias("id"), T.clean_text(T.remove_garbage(F.col(text_col))).alias("text"))
    rows = chunking.rewrite(rows, "id", "text", chunking.without_sections).withColumn("text", T.good_lines(F.col("text")))
    rows = chunking.rewrite(rows, "id", "text", lambda t: chunking.level_headings(chunking.distinct_paragraphs(t)))
    return rows.withColumn("text", chunking.named_links(F.col("text")))


def metadata(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with title, urls, emails, dates, length, and the quality scores."""
    c = F.col(text_col)
    said = lambda x: F.array_sort(F.array_distinct(x))
    named = df.withColumns({"title": T.title(c), "urls": said(T.urls(c)), "emails": said(T.emails(c)), "dates": said(T.dates(c)), "length": F.length(c)})
    return T.quality(named, text_col)


def process(df: DataFrame, id_col: str, text_col: str, size: int = 500) -> DataFrame:
    """(id, text, title, urls, ..., original_length, chunks): the whole pipeline on each text, with its semantic chunks."""
    original = df.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("original_length"))
    done = checkpoint(metadata(cleaned(df, id_col, text_col)))
    pieces = chunking.chunk(done, "id", "text", chunking.semantic(size)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("chunks"))
    return done.join(original, "id").join(pieces, "id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def line_elements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, element, start, end, page, box, type): each line as an element, headings and lines of tables told apart."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @F.pandas_udf("array<struct<start:int,end:int,type:string>>")
    def told(texts):
        import pandas as pd

        out = []
        for t in texts:
            own, at = [], 0
            blocks = chunking.table_blocks(t) if t else []
            for i, line in enumerate(t.split("\n") if t else ()):
                kind = "Table" if any(a <= i < b for a, b in blocks) else "Title" if line.strip().startswith("#") else "text"
                own.append({"start": at, "end": at + len(line) + 1, "type": kind})
                at += len(line) + 1
            out.append(own)
        return pd.Series(out)

    e = rows.select("id", F.posexplode(told("text")).alias("element", "e"))
    return e.select("id", "element", "e.start", "e.end", F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<double>").alias("box"), "e.type")


def split_documents(df: DataFrame, elements: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50, most: int | None = None) -> DataFrame:
    """(id, chunk_index, text, char_start, char_end, page, bbox, chunk_type): recursive chunks with what their elements say.

    ``elements`` (id, element, start, end, page, box, type).  A chunk's range is widened by the overlap at both sides to look
    elements up; page is that of the first one, bbox lists all of them as JSON, and the type is the most frequent one, of
    equally frequent ones the first.  Without elements a chunk is text.  ``most``: a longer chunk is an error.
    """
    pieces = chunking.chunk(df, id_col, text_col, chunking.recursive(size, overlap))
    if most is not None:
        pieces = pieces.withColumn("text", F.when(F.length("text") > most, F.raise_error(F.concat(F.lit("chunk longer than the limit: "), F.col("chunk_index").cast("string")))).otherwise(F.col("text")))
    pieces = checkpoint(pieces)
    left = pieces.select("id", F.col("chunk_index").alias("l_id"), F.greatest(F.lit(0), F.col("char_start") - overlap).cast("long").alias("l_start"), (F.col("char_end") + overlap).alias("l_end"))
    right = elements.select("id", F.col("element").alias("r_id"), F.col("start").cast("long").alias("r_start"), F.col("end").cast("long").alias("r_end"), "page", "box", "type")
    met = intervals.closed_overlap(left, right, "id")
    kinds = met.groupBy("id", "l_id", "type").agg(F.count("*").alias("n"), F.min("r_start").alias("first"))
    mode = kinds.groupBy("id", "l_id").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "first")).alias("type"))
    box = F.struct("page", F.col("box").alias("bbox"))
    own = met.groupBy("id", "l_id").agg(F.array_sort(F.collect_list(F.struct("r_start", "r_id", box.alias("b")))).alias("es"))
    told = own.join(mode, ["id", "l_id"]).select("id", F.col("l_id").alias("chunk_index"), F.get("es", F.lit(0))["b"]["page"].alias("page"), F.to_json(F.struct(F.transform("es", lambda e: e["b"]).alias("chunk_bboxes"))).alias("bbox"), T.chunk_type(F.col("type")).alias("chunk_type"))
    return pieces.join(told, ["id", "chunk_index"], "left").select("id", "chunk_index", "text", "char_start", "char_end", "page", F.coalesce("bbox", F.lit("")).alias("bbox"), F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"))


def chunk_with_metadata(df: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50, elements: DataFrame | None = None) -> DataFrame:
    """:func:`split_documents` of cleaned texts, with the title as abstract and document name; lines are the elements if none are given."""
    done = checkpoint(metadata(cleaned(df, id_col, text_col)))
    own = line_elements(done, "id", "text") if elements is None else elements
    named = done.select("id", F.col("title").alias("abstract"), F.col("title").alias("document_name"), "overall_score")
    return split_documents(done, own, "id", "text", size, overlap).join(named, "id")


# Preprocessing


def preprocess(spark: SparkSession, root: str, out: str, only: DataFrame | None = None, size: int = 500, overlap: int = 50) -> DataFrame:
    """Every file below ``root`` to Markdown, parents and children below ``out``; returns the log (path, level, status, message, chunks).

    A file that fails has its message and the others go on.  Tables are written by level: ``markdown``, ``parents``,
    ``children``, and ``log``, to which each run adds.
    """
    text = checkpoint(files.markdown(spark, root, only))
    good = text.where("error is null and text is not null")
    # a run over files that were there before takes their place
    parents, children = chunking.parent_child(good, "path", "text", size, overlap)
    level = good.select(F.col("path").alias("id"), "level")
    source = F.regexp_extract("id", "([^/]+)$", 1)
    shaped = lambda d: d.join(level, "id").select(F.concat_ws("#", "id", F.col("chunk_index").cast("string")).alias("key"), F.col("id").alias("path"), source.alias("source"), "level", "doc_id", "chunk_index", "text")
    parents, children = checkpoint(shaped(parents)), checkpoint(shaped(children))
    for name, rows in (("markdown", good.select(F.col("path").alias("key"), "path", "level", "text")), ("parents", parents), ("children", children)):
        _replace(Table(spark, f"{out}/{name}"), rows, good.select("path"))
    n = children.groupBy("path").agg(F.count("*").alias("chunks"))
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("success")
    log = checkpoint(text.join(n, "path", "left").select("path", "level", status.alias("status"), F.coalesce("error", F.lit("")).alias("message"), F.coalesce("chunks", F.lit(0)).alias("chunks")))
    Table(spark, f"{out}/log").upsert(log, "path")
    return log


def _replace(table: Table, rows: DataFrame, paths: DataFrame) -> None:
    """``rows`` in place of all rows of the same paths, shrunken files included."""
    now = table.read()
    gone = None if now is None else now.join(paths.distinct(), "path", "left_semi").join(rows.select("key"), "key", "left_anti").select("key")
    table.upsert(rows, "key")
    if gone is not None:
        table.delete(checkpoint(gone), "key")


def retry(spark: SparkSession, root: str, out: str) -> DataFrame:
    """:func:`preprocess` of the files whose last run failed."""
    log = Table(spark, f"{out}/log").read()
    failed = spark.createDataFrame([], "path string") if log is None else checkpoint(log.where("status = 'failed'").select("path"))
    return preprocess(spark, root, out, failed)


def totals(log: DataFrame) -> DataFrame:
    """(level, processed, success, failed) of a log, and a row of level null for all."""
    n = [F.count("*").alias("processed"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed")]
    return log.rollup("level").agg(*n)


# Ingest


class Index:
    """Collections of parents, children and pictures with a manifest of files, below one folder.

    ``model`` is the embedder's name; vectors of another one are never mixed in (see :meth:`switch`).
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "hashed"):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.parents, self.children, self.images, self.manifest = (Table(spark, f"{self.path}/{n}") for n in ("parents", "children", "images", "manifest"))

    def _embedded(self, rows: DataFrame, c: Column | None = None) -> DataFrame:
        return rows.withColumn("vec", embedding.get(self.model)(F.col("text") if c is None else c))

    def index(self, chunks: DataFrame, levels: list[str] | None = None) -> DataFrame:
        """Indexes rows of chunk files (see :func:`files.chunk_files`); returns (file_path, content_hash, level) of the files that were new or changed.

        A file counts by its path and the hash of its content; an unchanged one is skipped.  The manifest is written last,
        so a run that dies does its files again.  Rows of a changed file that it no longer has are removed.
        """
        rows = chunks if levels is None else chunks.where(F.col("level").isin(levels))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("kind", "chunk_index", "text"))), lambda x: F.concat_ws("\0", x["kind"], x["chunk_index"].cast("string"), x["text"]))
        hashed = rows.groupBy("file_path", "level").agg(F.sha2(F.array_join(ordered, "\1"), 256).alias("content_hash"))
        known = self.manifest.read()
        new = checkpoint(hashed if known is None else ingest.new_or_changed(hashed, known, ["file_path", "content_hash"]))
        todo = rows.join(new.select("file_path"), "file_path", "left_semi")
        name = F.coalesce(F.when(F.trim("document_name") != "", F.col("document_name")), F.col("source"))
        child = F.col("kind") == "children"
        key = F.when(child, ingest.child_key(F.col("parent_doc_id"), F.col("chunk_index"), F.col("file_path"), F.col("text"))).otherwise(ingest.chunk_key(F.col("doc_id"), F.col("kind"), F.col("source"), F.col("chunk_index")))
        shaped = todo.select(key.alias("id"), "text", "chunk_index", "source", "page", "bbox", "chunk_type", "abstract", name.alias("document_name"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("parent_doc_id", "doc_id", F.lit("")).alias("parent_doc_id"), "level", "file_path", child.alias("is_child"))
        done = checkpoint(self._embedded(shaped))
        for table, mine in ((self.parents, ~F.col("is_child")), (self.children, F.col("is_child"))):
            own = done.where(mine).drop("is_child")
            now = table.read()
            gone = None if now is None else checkpoint(now.join(new.select("file_path"), "file_path", "left_semi").join(own.select("id"), "id", "left_anti").select("id"))
            if now is not None or not own.isEmpty():
                table.upsert(own, "id", F.col("file_path"), F.col("chunk_index"))
            if gone is not None and not gone.isEmpty():
                table.delete(gone, "id")
        if not new.isEmpty():
            self.manifest.upsert(new.withColumn("ts", F.current_timestamp()), "file_path")
        return new

    def ingest(self, chunks: DataFrame) -> DataFrame:
        """(level, action, files): a level whose sources are all present is skipped, else all of its files are taken."""
        known = self.parents.read()
        wanted = chunks.select("level", "source").distinct()
        there = wanted.limit(0) if known is None else known.select("level", "source").distinct()
        missing = wanted.join(there, ["level", "source"], "left_anti").groupBy("level").agg(F.count("*").alias("missing"))
        plan = checkpoint(wanted.groupBy("level").agg(F.count("*").alias("sources")).join(missing, "level", "left").select("level", F.when(F.col("missing").isNull(), "skipped").otherwise("process").alias("action")))
        todo = [r.level for r in plan.where("action = 'process'").collect()]
        new = self.index(chunks, todo) if todo else self.spark.createDataFrame([], "level string")
        return plan.join(new.groupBy("level").agg(F.count("*").alias("files")), "level", "left").select("level", "action", F.coalesce("files", F.lit(0)).alias("files"))

    def add_pair(self, parent: DataFrame, children: DataFrame) -> None:
        """A parent with its children: both get the parent's doc_id, made from its text where it has none."""
        told = F.coalesce(F.nullif("doc_id", F.lit("")), F.concat(F.lit("auto_"), F.substring(F.sha2("text", 256), 1, 16)))
        one = parent.withColumn("doc_id", told)
        kids = children.withColumn("doc_id", F.lit(one.select("doc_id").first()[0]))
        self.parents.upsert(self._embedded(one.withColumn("id", F.col("doc_id")).withColumn("parent_doc_id", F.col("doc_id"))), "id")
        self.children.upsert(self._embedded(kids.withColumn("parent_doc_id", F.col("doc_id")).withColumn("id", ingest.child_key(F.col("doc_id"), F.col("chunk_index"), F.col("text")))), "id")

    def index_images(self, found: DataFrame, contents: DataFrame, embed: Column) -> DataFrame:
        """Pictures (see :func:`files.images`) with vectors of their contents (path, content), by their ids; one that can't be read is left out.  Returns those indexed."""
        rows = found.join(contents.select("path", embed.alias("vec")), "path").where("vec is not null")
        rows = checkpoint(rows.select(F.col("image_id").alias("id"), F.concat(F.lit("[image] "), F.col("document"), F.lit(" "), F.regexp_extract("path", "([^/]+)$", 1)).alias("text"), "path", "document", "level", "image_index", "vec"))
        if not rows.isEmpty():
            self.images.upsert(rows, "id")
        return rows

    def search(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """(query_id, level, id, doc_id, text, score, parent_text): the best children of each level for queries (id, text), one to a parent, with the parents' texts.

        The limit comes before parents are told apart, so there may be fewer than ``n``.  A level without children is searched in its
        parents.  A child without parent stands for itself.
        """
        asked = self._embedded(queries.select("id", F.lit("query").alias("level"), "text"))
        p, c = self.parents.read(), self.children.read()
        shape = ["id", "level", "vec", "text", "doc_id", "parent_doc_id"]
        empty = self.spark.createDataFrame([], "id string, level string, vec array<float>, text string, doc_id string, parent_doc_id string")
        p, c = (empty if t is None else t.select(*shape) for t in (p, c))
        alone = p.join(c.select("level").distinct(), "level", "left_anti")
        corpus = checkpoint(c.withColumn("own", F.lit(False)).unionByName(alone.withColumn("own", F.lit(True))).withColumn("no", F.xxhash64("level", "id")))
        hits = similarity.nearest(asked, corpus.select(F.col("no").alias("id"), "level", "vec"), n)
        hits = hits.withColumnRenamed("id", "no").join(corpus.select("no", "level", "id", "text", "doc_id", "parent_doc_id", "own"), ["no", "level"])
        group = F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("parent_doc_id", F.lit("")), "id")
        best = Window.partitionBy("query_id", "level", group).orderBy(F.round("distance", 9), "id")
        first = hits.withColumn("r", F.row_number().over(best)).where("r = 1")
        texts = p.select(F.col("id").alias("doc_id"), F.col("level"), F.col("text").alias("parent_text"))
        told = first.select("query_id", "level", "id", F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("parent_doc_id", F.lit(""))).alias("doc_id"), "text", F.round(scores.raw_similarity(F.col("distance")), 6).alias("score"), "own")
        return told.join(texts, ["doc_id", "level"], "left").select("query_id", "level", "id", "doc_id", "text", "score", F.when(~F.col("own"), F.col("parent_text")).alias("parent_text"))

    def clear(self, level: str | None = None) -> None:
        """Removes one level from all collections and the manifest, or everything."""
        for t in (self.parents, self.children, self.images, self.manifest):
            now = t.read()
            if level is None or now is None:
                t.clear()
            else:
                t.delete(now.where(F.col("level") == level).select(t._state()["key"]), t._state()["key"])

    def counts(self) -> DataFrame:
        """(collection, level, n) of what the index holds; rows without a level count under null."""
        out = self.spark.createDataFrame([], "collection string, level string, n long")
        for name, t in (("parents", self.parents), ("children", self.children), ("images", self.images), ("manifest", self.manifest)):
            if (now := t.read()) is not None:
                level = F.col("level") if "level" in now.columns else F.lit(None).cast("string")
                out = out.unionByName(now.groupBy(level.alias("level")).agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "level", "n"))
        return out

    def switch(self, model: str) -> bool:
        """Takes another embedder.  Vectors of another dimension are dropped, and the manifest always, so that all files are embedded again; false if it is the same."""
        if model == self.model:
            return False
        dims = [self._embedded(self.spark.createDataFrame([("x",)], "text string")).select(F.size("vec")).first()[0]]
        self.model = model
        dims.append(self._embedded(self.spark.createDataFrame([("x",)], "text string")).select(F.size("vec")).first()[0])
        if dims[0] != dims[1]:
            self.parents.clear()
            self.children.clear()
            self.images.clear()
        self.manifest.clear()
        return True
