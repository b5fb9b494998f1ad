"""An index that grows by new page files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import index

PAGES = "doc_id string, text string, fetched_at timestamp"


def grow(spark: SparkSession, source: str, index_path: str, checkpoint: str) -> StreamingQuery:
    """Index all page files (Parquet of doc_id, text, fetched_at) in ``source`` that no earlier run has read, then stop.

    Of several rows of one doc_id within a batch the latest counts; a doc_id that is already indexed isn't read again,
    also when a batch is repeated after a failure.
    """
    from lodestar.sources.files import documents

    def add(batch: DataFrame, number: int) -> None:
        index.extend(index_path, documents(batch), f"stream-{number}")

    stream = spark.readStream.schema(PAGES).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
