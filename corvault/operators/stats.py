"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvault.runtime import shuffle_partitions


def level_counts(df: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """Distinct keys of every level, levels without rows too, and a row of level null for all."""
    found = df.groupBy("level").agg(F.countDistinct(key).alias("n"))
    each = levels.select(F.col("classification").alias("level")).distinct().join(found, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return each.unionByName(df.agg(F.countDistinct(key).alias("n")).select(F.lit(None).cast("string").alias("level"), "n"))


def collection_counts(df: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, parents, children, total)"""
    found = df.groupBy("level").agg(F.count_if(F.col("collection") == "parent").alias("parents"), F.count_if(F.col("collection") == "child").alias("children"))
    full = levels.select(F.col("classification").alias("level")).distinct().join(found, "level", "left").fillna(0, ["parents", "children"])
    return full.withColumn("total", F.col("parents") + F.col("children"))


def mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one that comes first."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first", value)
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, value, "n")


def keywords(df: DataFrame, id_col: str, text_col: str, top: int, stop_words: list[str]) -> DataFrame:
    """(id, keyword, n, rank): the most frequent tokens; equal counts in order of appearance, Han before Latin."""
    from corvault.functions.text import HAN

    han = F.regexp_extract_all(F.col(text_col), F.lit(f"[{HAN}]{{2,4}}"), F.lit(0))
    latin = F.transform(F.regexp_extract_all(F.col(text_col), F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.lower)
    # a text moves once, before it becomes rows; what follows is grouped by its id
    own = df.select(F.col(id_col).alias("id"), F.col(text_col)).where(F.col(text_col).isNotNull()).repartition(shuffle_partitions(df.sparkSession), "id")
    rows = own.select("id", F.posexplode(F.concat(han, latin)).alias("pos", "keyword"))
    n = rows.where(~F.col("keyword").isin(stop_words)).groupBy("id", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = n.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "keyword"))), 1, top).alias("best"))
    return best.select("id", F.posexplode("best").alias("rank", "b")).select("id", "b.keyword", (-F.col("b.n")).alias("n"), (F.col("rank") + 1).alias("rank"))


def boilerplate_lines(df: DataFrame, doc_col: str, page_col: str, text_col: str, part: float = 0.6) -> DataFrame:
    """(doc, line, pages): lines that stand on at least 60 % of a document's pages, and on three at least."""
    lines = df.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), F.explode(F.split(text_col, "\n")).alias("l")).select("doc", "page", F.trim("l").alias("line")).where("line != ''").distinct()
    sizes = df.groupBy(F.col(doc_col).alias("doc")).agg(F.countDistinct(page_col).alias("all_pages")).where("all_pages >= 3")
    n = lines.groupBy("doc", "line").agg(F.count("*").alias("pages"))
    return n.join(sizes, "doc").where(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("all_pages") * part))).select("doc", "line", "pages")


def series_report(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """(key, samples, peak, total_delta, leaking): differences of a series; leaking if four rises in a row add up to more than 100."""
    d = df.select(key, order.alias("o_"), value).withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy("o_")))
    w4 = Window.partitionBy(key).orderBy("o_").rowsBetween(-3, 0)
    d = d.withColumn("run", (F.min("delta").over(w4) > 0) & (F.count("delta").over(w4) == 4) & (F.sum("delta").over(w4) > 100))
    return d.groupBy(key).agg(F.count("*").alias("samples"), F.max(value).alias("peak"), F.sum("delta").alias("total_delta"), F.max("run").alias("leaking"))


def retained(df: DataFrame, key: str, *newest: Column, keep: int) -> DataFrame:
    """The newest rows of each key."""
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("r_") <= keep).drop("r_")
