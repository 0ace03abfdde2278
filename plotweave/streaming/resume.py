"""Incremental enrichment as a stream that stops when its input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def enrich_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, max_files: int | None = None) -> None:
    """Runs work once over each new Parquet file of source and appends to sink; files done before are skipped.

    Each micro-batch is written under its number, so that a batch repeated after a failure replaces itself.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    write = lambda df, n: work(df).write.mode("overwrite").parquet(f"{sink}/batch={n}")
    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
