"""Ids that come in chunks: which ones no earlier chunk held, with state that survives between runs.

The state is a table of ids by chunk and, per chunk, a Bloom filter of them (words of 64 bits by place). New rows meet the
filters first: what no filter knows is new for certain and skips the exact join, which is left with known ids and a few
false alarms. A chunk that runs again replaces its own state and is compared with the chunks before it only, so a rerun
gives the same rows and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.order import small

#: Most words of a Bloom filter: a million rows of two numbers when read for a broadcast.
WORDS = 1 << 20
#: Bits that an id sets in its word.
BITS = 4


def bloom_place(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(words))


def bloom_bits(key: Column) -> Column:
    """The bits of an id in its word, as a long."""
    h, out = F.xxhash64(F.lit(2), key), F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom(ids: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """Filter of a frame's ids: place, bits; one aggregation with map-side combine, at most ``words`` rows."""
    rows = ids.select(bloom_place(F.col(key), words).alias("place"), bloom_bits(F.col(key)).alias("bits"))
    return rows.groupBy("place").agg(F.bit_or("bits").alias("bits"))


class SeenIds:
    """Ids of the chunks so far, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, words: int = WORDS):
        self.spark, self.path, self.key, self.words = spark, path, key, words

    def _before(self, what: str, kind: str, chunk: int) -> DataFrame | None:
        """State of the chunks before one; null if there is none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema(f"{kind}, chunk int").parquet(f"{self.path}/{what}").filter(F.col("chunk") < chunk)

    def add(self, df: DataFrame, chunk: int) -> DataFrame:
        """The rows of ``df`` whose id no earlier chunk held, one for each id (the smallest row); they become the chunk's state.

        Rows without an id are left out. Chunks are numbered in their order.
        """
        key, others = self.key, [c for c in df.columns if c != self.key]
        kind = df.schema[key].dataType.simpleString()
        rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("_x") if others else F.count("*").alias("_x"))
        rows = rows.select(key, "_x.*") if others else rows.select(key)
        filters = self._before("bloom", "place long, bits long", chunk)
        if filters is not None:
            known = self._before("ids", f"{key} {kind}", chunk).select(key)
            filters = small(filters.groupBy("place").agg(F.bit_or("bits").alias("_bits")), self.words)
            probe = rows.withColumn("place", bloom_place(F.col(key), self.words)).join(filters, "place", "left")
            maybe = F.coalesce(F.col("_bits").bitwiseAND(bloom_bits(F.col(key))) == bloom_bits(F.col(key)), F.lit(False))
            probe = probe.withColumn("_maybe", maybe).select(*df.columns, "_maybe")
            sure, asked = probe.filter("not _maybe").drop("_maybe"), probe.filter("_maybe").drop("_maybe")
            rows = sure.unionByName(asked.join(known, key, "left_anti"))
        out = f"{self.path}/rows/chunk={chunk}"
        rows.write.mode("overwrite").parquet(out)
        rows = self.spark.read.schema(df.schema).parquet(out)
        rows.select(key).write.mode("overwrite").parquet(f"{self.path}/ids/chunk={chunk}")
        bloom(rows, key, self.words).write.mode("overwrite").parquet(f"{self.path}/bloom/chunk={chunk}")
        return rows


def stream_unseen(spark: SparkSession, source: str, schema: StructType, key: str, sink: str, checkpoint: str) -> StreamingQuery:
    """The same over a stream of Parquet files: the first row of every id goes to the sink, all later ones are dropped.

    Ids are keyed state in the checkpoint. A query started again with its checkpoint goes on with new files only; the sink's
    log makes repeated batches harmless.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    fresh = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
