"""Helpers the operators share: durable tables, global order, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Odd multipliers of hashes.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a few longs up to which a frame is broadcast: about 24 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach, from ``spark.checkpoint.dir``.

    Where it is unset and Spark runs on one machine (tests) a folder below ``/tmp/checkpoints`` is set for the session; on a
    cluster that is an error, as executors wouldn't see each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Durable tables of one operator. Calling it writes and rereads a frame; ``clear`` removes what nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def clear(self, *keep: DataFrame) -> None:
        """Remove all tables but those to keep. Only tables whose readers have been written may go."""
        stay = [(t, p) for t, p in self.tables if any(t is k for k in keep)]
        kept = {p for _, p in stay}
        for _, path in self.tables:
            if path not in kept:
                remove(self.spark, path)
        self.tables = stay


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored frame of a few longs a row with a broadcast hint if it has at most ``rows`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions_for(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending split points of a long column, from one aggregation without a shuffle of rows."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(F.col(key), at, F.lit(20 * parts)).alias("b")).first()["b"]
    return sorted(set(got or []))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below the value (null: 0), by a binary search of CASE expressions."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNotNull(), tree(0, len(bounds))).otherwise(F.lit(0))


def components(edges: DataFrame, a: str, b: str, *, rounds: int = 200) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    ``edges`` holds pairs of longs; returns (node, root) with the smallest node of each component as root,
    for every node that has an edge. Each round is two minimum aggregations with map-side combine and two equi-joins, whose
    skewed partitions (the smallest node of a giant component) adaptive execution splits; its result is written to the
    shared folder, so a lost executor costs one round, and replaces the one before. No group is gathered. Rounds grow with
    the logarithm of the longest chain; labels that haven't settled after ``rounds`` are an error. Pairs with a null end,
    loops and repeated pairs are harmless. Empty edges: empty result.
    """
    keep = Scratch(edges.sparkSession, "cc")
    cur = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())

    def state(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(cur)
    for _ in range(rounds if last[0] else 0):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        big = big.filter("u > v").distinct()
        # small star: every smaller neighbour of u, and u, is linked to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        pairs = big.join(low, "u")
        stars = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        cur = keep(stars.filter("u > v").distinct())
        keep.clear(cur)
        # the number of edges and a sum of their hashes say whether the round changed any
        seen = state(cur)
        if seen == last:
            break
        last = seen
    else:
        if last[0]:
            raise RuntimeError(f"components haven't settled after {rounds} rounds")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark exchange at most so many rows at once with Python from here on.

    Ten thousand texts, its own choice, are tens of megabytes in buffers of the JVM and of each Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and the C library keeps what they had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded(batch: pa.RecordBatch, text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text, at least a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy())
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chars, "right")))
        yield batch.slice(a, z - a)
        a = z


def word_hashes(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and where each text's begin (and the last one's end).

    Words are what the six ASCII white-space characters separate; each distinct word is hashed once.
    """
    import xxhash

    split = pc.ascii_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, seed) for w in coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    some = pc.binary_length(split.values).to_numpy() > 0
    ends = np.concatenate([[0], np.cumsum(some)])[split.offsets.to_numpy()]
    return own[coded.indices.to_numpy()[some]], ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a hash of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case: ``stem`` with underscores before it."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem = f"_{stem}"
    return stem


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ... and their names by the old ones, so that no name of a caller's can clash."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)


LONG = T.LongType()
