"""Continuous indexing: new documents from a stream, a new index version for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.build import build_index


def follow(stream: DataFrame, corpus: str, root: str, checkpoint: str, **how):
    """Starts a query that adds the stream's documents (url, title, body) to the Parquet corpus and builds the index anew.

    A batch that is run again replaces its own part of the corpus, so each document counts once.
    """
    spark = stream.sparkSession

    def batch(docs: DataFrame, batch_id: int) -> None:
        docs.select("url", "title", "body").write.mode("overwrite").parquet(f"{corpus}/batch={batch_id}")
        whole = spark.read.schema("url string, title string, body string").option("recursiveFileLookup", "true").parquet(corpus)
        build_index(whole, root, **how)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
