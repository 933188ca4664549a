"""A fitted transform over a stream of new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def apply_stream(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str,
                 checkpoint: str) -> StreamingQuery:
    """Each micro-batch of Parquet files goes through ``transform`` (fitted before, not refitted) to a Parquet sink.

    A batch that is run again overwrites its own folder, so nothing is written twice. No state, so no watermark.
    """

    def write(batch: DataFrame, no: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={no}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
