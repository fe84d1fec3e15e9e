"""Postings of documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.operators import index


def append_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing the postings of a stream of (doc_id, text), with their documents' lengths, one folder per micro-batch.

    A batch that is tried again replaces its own folder, so each document counts once. ``docs`` ends when its source does.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.sized_postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf, dl) of all batches; a document that came in several adds up, in length too."""
    rows = spark.read.parquet(path)
    lengths = rows.select("doc_id", "batch", "dl").distinct().groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    return rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")).join(lengths, "doc_id").select("term", "doc_id", "tf", "dl")
