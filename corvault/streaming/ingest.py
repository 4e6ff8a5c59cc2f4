"""Ingest of arriving chunk tables, and event windows, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvault.operators.ingest import Table, canonical


def ingest(spark: SparkSession, source: str, schema: StructType, table: Table, checkpoint: str) -> StreamingQuery:
    """Upserts every file that has arrived under ``source`` into ``table`` by chunk identity, newest row first, then stops.

    A second run takes only what is new: the checkpoint knows the files.  The same batch run twice
    leaves the table the same, as rows are replaced by key.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            table.upsert(canonical(df), "id", F.desc("ts"), F.desc("row_id"))

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, value): counts and sums of events in tumbling windows; events later than ``late`` are left out of a stream."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
