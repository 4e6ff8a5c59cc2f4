"""Overlap joins of intervals within a document, and line boxes.

A range condition alone would compare every interval with every other.  Both sides are put into
cells of ``CELL`` positions first, so the join is one on (document, cell); a pair is kept only in
the first cell that both lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 256
#: Fixed values of the synthetic page: lines on it, their height, its width.
LINES, HEIGHT, WIDTH = 60, 14, 595


def _celled(df: DataFrame, start: str, end: str) -> DataFrame:
    low, high = F.floor(F.col(start) / CELL), F.floor(F.greatest(F.col(end), F.col(start)) / CELL)
    return df.withColumn("cell", F.explode(F.sequence(low, high)))


def _joined(left: DataFrame, right: DataFrame, doc: str, fits: Column) -> DataFrame:
    """``left`` has (doc, l_id, l_start, l_end), ``right`` (doc, r_id, r_start, r_end)."""
    first = F.col("cell") == F.floor(F.greatest("l_start", "r_start") / CELL)
    both = _celled(left, "l_start", "l_end").join(_celled(right, "r_start", "r_end"), [doc, "cell"])
    return both.where(fits & first).drop("cell")


def closed_overlap(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    """Intervals that share a point, ends included."""
    return _joined(left, right, doc, (F.col("l_start") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_start")))


def strict_overlap(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    """Intervals that share more than an end."""
    return _joined(left, right, doc, (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))


def containment(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    """Intervals of the left that contain one of the right."""
    return _joined(left, right, doc, (F.col("l_start") <= F.col("r_start")) & (F.col("l_end") >= F.col("r_end")))


def line_boxes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line that isn't blank: its characters (line end included), page and box."""
    n = F.length("line") + 1
    starts = F.sum(n).over(Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    placed = rows.withColumn("char_start", F.coalesce(starts, F.lit(0)).cast("long")).withColumn("char_end", F.col("char_start") + n)
    y = (F.col("line_no") % LINES) * HEIGHT
    return placed.where(F.trim(F.translate("line", "\t\r", "  ")) != "").select(
        "id", "line_no", "char_start", "char_end", F.floor(F.col("line_no") / LINES).cast("int").alias("page"), F.lit(0).alias("x0"), y.alias("y0"), F.lit(WIDTH).alias("x1"), (y + HEIGHT).alias("y1")
    )


def lines_of_chunks(boxes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines that a chunk (id, chunk_no, source text, chunk text) touches; the chunk stands where it is first found."""
    at = F.expr("locate(chunk_text, source_text)") - 1
    placed = chunks.withColumn("r_start", at.cast("long")).where("r_start >= 0").withColumn("r_end", F.col("r_start") + F.length("chunk_text"))
    left = boxes.select("id", F.col("line_no").alias("l_id"), F.col("char_start").alias("l_start"), F.col("char_end").alias("l_end"))
    right = placed.select("id", F.col("chunk_no").alias("r_id"), "r_start", "r_end")
    return strict_overlap(left, right, "id").select("id", F.col("r_id").alias("chunk_no"), F.col("l_id").alias("line_no"))
