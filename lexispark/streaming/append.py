"""Documents that arrive as a stream, appended and counted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files below a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def append_stream(docs: DataFrame, to_rows, folder: str, checkpoint: str) -> StreamingQuery:
    """Derives rows of each new batch by ``to_rows`` and appends them; a batch that is retried after a failure replaces its own files alone."""

    def write(batch: DataFrame, number: int) -> None:
        to_rows(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
