"""Global positions without sending all rows through one task."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOW = (1 << 33) - 1
BROADCAST_ROWS = 1_000_000  # of short columns; larger tables are never sent to every executor


def shared_folder(spark: SparkSession, name: str = "files") -> str:
    """A new folder that every executor reaches, below ``spark.checkpoint.dir``; where that is unset one below /tmp, on one
    machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """The frame written as Parquet into the shared folder and read back: worked out once however often it is read, and not
    lost with an executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a frame has at most ``rows`` rows (None: BROADCAST_ROWS)."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored frame of a few short columns with a broadcast hint if it has at most ``rows`` rows, as it is otherwise."""
    return F.broadcast(df) if few(df, rows) else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into as many partitions as a shuffle has, or four for each of the input's: what is exploded from
    them and grouped by the key (and more) isn't exchanged again."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions())
    return df.repartition(parts, key)


def global_index(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """Adds the 0-based position of every row in the given order.

    Rows are dealt by ranges of the order and numbered inside each; ranges shift by the sizes of those before, a table of
    one row a partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_at"), 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["_n"]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    index = F.col("_start") + F.col("_at").bitwiseAND(F.lit(_LOW))
    return out.withColumn(name, index).select(*df.columns, name)
