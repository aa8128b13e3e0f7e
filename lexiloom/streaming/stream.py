"""Streams of documents through per-document operators.

Operators that read a document by itself are stateless, so a stream takes them
as they are. Pipelines with windows over rows run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def documents(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(folder)


def once(docs: DataFrame, key: str = "doc_id", at: str = "loaded_at", delay: str = "1 day") -> DataFrame:
    """Documents sent twice within the delay counted once; later ones are late data and dropped by the watermark."""
    return docs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def counts(docs: DataFrame, at: str = "loaded_at", by: str = "source", every: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Documents and characters per window and source."""
    return docs.withWatermark(at, delay).groupBy(F.window(at, every), by).agg(F.count("*").alias("documents"), F.sum(F.length("content")).alias("characters"))


def run(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through `transform`, appended as Parquet; a batch that is repeated after a failure replaces itself."""

    def batch(df: DataFrame, epoch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def aggregated(table: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An aggregation of a stream: each micro-batch writes the rows that changed with its number; the last number of a key is its state."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return table.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
