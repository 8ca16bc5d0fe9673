"""Keeping an index current from a stream of new documents (an addition; batch results are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import tokens
from lodestone.operators.index import Index, build_index


def append_documents(stream: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Writes the tokens of each micro-batch of documents under ``path``, in a folder per batch: a batch that is run
    again after a failure overwrites its own folder and nothing else. Call ``start_index`` to read the whole."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))
        rows.select("doc_id", "tokens").write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def start_index(spark, path: str) -> Index:
    """The index over all batches written so far; of a document that came twice, the batch with the greater number counts."""
    docs = spark.read.option("basePath", f"{path}/docs").parquet(f"{path}/docs")
    last = docs.groupBy("doc_id").agg(F.max_by("tokens", "batch").alias("tokens"))
    return build_index(last, F.col("tokens"))
