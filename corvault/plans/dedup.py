"""Duplicates of passages of a higher level in a lower one: pairs, bands, the list that may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvault.functions import scores
from corvault.operators.similarity import similar_pairs

PAIRS = (("restricted", "public"), ("confidential", "public"), ("confidential", "restricted"))


def raw_of(adjusted: float) -> float:
    """The raw similarity at an adjusted one; the scale rises steadily, so filters move below it."""
    return scores.BASELINE + (1 - scores.BASELINE) * adjusted


def matches(corpus: DataFrame, least: float = 0.5, texts: bool = True) -> DataFrame:
    """Pairs of ``corpus`` (id, level, vec, text) from a higher to a lower level, adjusted similarity at least ``least``, with literal signals and bands.

    Overlap and run are those of the higher passage in the lower one. With ``texts`` also the beginnings of both.
    """
    found = similar_pairs(corpus, corpus, raw_of(least), text_col="text").withColumn("adjusted", scores.linear(F.col("raw")))
    banded = found.withColumn("band", scores.band(F.col("adjusted"), scores.literal_support(F.col("overlap"), F.col("run"))))
    columns = ["source_id", "source_level", "target_id", "target_level", "raw", "adjusted", F.round("overlap", 4).alias("overlap"), "run", "band"]
    if not texts:
        return banded.select(*columns)
    text = corpus.select("id", F.substring("text", 1, 300).alias("text"))
    return banded.join(text.toDF("source_id", "source_text"), "source_id").join(text.toDF("target_id", "target_text"), "target_id").select(*columns, "source_text", "target_text")


def ready(found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Matches at or above the threshold that have literal support."""
    return found.where((F.coalesce(F.col("adjusted"), scores.linear(F.col("raw"))) >= threshold) & scores.literal_support(F.col("overlap"), F.col("run")))


def counters(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(source_level, target_level, total_checked, high, medium, low) of the three pairs of levels."""
    spark = found.sparkSession
    pairs = spark.createDataFrame(list(PAIRS), "source_level string, target_level string")
    n = corpus.groupBy("level").agg(F.count("*").alias("n"))
    sizes = pairs.join(n.toDF("source_level", "ns"), "source_level", "left").join(n.toDF("target_level", "nt"), "target_level", "left")
    checked = sizes.select("source_level", "target_level", (F.coalesce("ns", F.lit(0)) * F.coalesce("nt", F.lit(0))).alias("total_checked"))
    bands = found.groupBy("source_level", "target_level").agg(*(F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low")))
    return checked.join(bands, ["source_level", "target_level"], "left").fillna(0, ["high", "medium", "low"])


def apply(corpus: DataFrame, found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``corpus`` without the higher passages that are ready to go."""
    gone = ready(found, threshold).select(F.col("source_id").alias("id"), F.col("source_level").alias("level")).distinct()
    return corpus.join(gone, ["id", "level"], "left_anti")


def report(found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One Markdown line for each match that is ready, numbered within its pair of levels."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_level", "target_level").orderBy(F.desc("adjusted"), "source_id", "target_id")
    line = F.format_string("%d. [%s → %s] %.4f overlap %.4f run %d: %s", "no", "source_level", "target_level", "adjusted", "overlap", "run", "source_text")
    return ready(found, threshold).withColumn("no", F.row_number().over(w)).select("source_level", "target_level", "no", "source_id", "target_id", line.alias("line"))
