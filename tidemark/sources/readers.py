"""Readers of the log's files as DataFrames. All are built on Spark's own sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LISTS = ["text_tokens", "hashtags", "present_media", "present_links", "present_domains"]
# Columns of the log in order, with their types.
COLUMNS = [
    ("text_tokens", "list"), ("hashtags", "list"), ("tweet_id", "string"), ("present_media", "list"), ("present_links", "list"),
    ("present_domains", "list"), ("tweet_type", "string"), ("language", "string"), ("tweet_timestamp", "long"),
    ("creator_id", "string"), ("creator_followers", "int"), ("creator_following", "int"), ("creator_verified", "boolean"),
    ("creator_created", "long"), ("user_id", "string"), ("user_followers", "int"), ("user_following", "int"),
    ("user_verified", "boolean"), ("user_created", "long"), ("creator_follows_user", "boolean"),
    ("reply_ts", "long"), ("retweet_ts", "long"), ("comment_ts", "long"), ("like_ts", "long"),
]


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_impressions(spark: SparkSession, path: str | list[str], *, labelled: bool = True) -> DataFrame:
    """Lines of fields between U+0001, lists between tabs: typed columns, lists as arrays, blanks as null, flags as 0/1."""
    names = COLUMNS if labelled else COLUMNS[:-4]
    parts = F.split(F.col("value"), "\u0001", -1)
    cols = []
    for i, (name, kind) in enumerate(names):
        c = blank(F.try_element_at(parts, F.lit(i + 1)))
        if kind == "list":
            c = F.split(c, "\t")
        elif kind == "boolean":
            c = F.lower(c).cast("boolean").cast("int")
        elif kind != "string":
            c = c.cast(kind)
        cols.append(c.alias(name))
    return spark.read.text(path).select(*cols)


def read_tagged(spark: SparkSession, files: dict[str, tuple[str, bool]]) -> DataFrame:
    """Several logs with the name of their data set: {dataset: (path, labelled)}."""
    frames = [read_impressions(spark, p, labelled=ok).withColumn("dataset", F.lit(d)) for d, (p, ok) in files.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_id_text(spark: SparkSession, path: str) -> DataFrame:
    """id and the rest of the line after the first comma."""
    line = F.col("value")
    return spark.read.text(path).select(F.regexp_extract(line, r"^([^,]*),", 1).alias("id"), F.regexp_extract(line, r"^[^,]*,(.*)$", 1).alias("text"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tweet_id string, user_id string, score double").csv(path)


def read_libsvm(spark: SparkSession, path: str, *, first: str = "label") -> DataFrame:
    """``first index:value ...`` lines, 0-based, as (line's first number, col, value); lines without a pair are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(parts) >= 2)
    rows = rows.select(F.monotonically_increasing_id().alias("line"), parts[0].cast("double").alias(first), F.explode(F.slice(parts, 2, 1 << 30)).alias("p"))
    pair = F.split("p", ":")
    return rows.select("line", first, pair[0].cast("long").alias("col"), pair[1].cast("double").alias("value"))


def read_interactions(spark: SparkSession, path: str, *, weight: bool = False, date: bool = False) -> DataFrame:
    """user,item[,weight][,date]: weights of one pair add up (1 without a weight), the latest date stays."""
    schema = "user int, item int" + ", weight double" * weight + ", date long" * date
    rows = spark.read.schema(schema).csv(path)
    w = F.col("weight") if weight else F.lit(1.0)
    return rows.groupBy("user", "item").agg(F.sum(w).alias("weight"), *([F.max("date").alias("date")] if date else []))


def read_feature_csv(spark: SparkSession, path: str, layout: list[tuple[str, int, str]]) -> DataFrame:
    """Wide rows cut into arrays by (name, width, type) in order; a width of 1 is a plain column."""
    fields, cols, at = [], [], 0
    for name, n, kind in layout:
        fields += [f"_f{at + i} {kind}" for i in range(n)]
        own = [F.col(f"_f{at + i}") for i in range(n)]
        cols.append((own[0] if n == 1 else F.array(*own)).alias(name))
        at += n
    return spark.read.schema(", ".join(fields)).csv(path).select(*cols)


def read_embedding_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of segments (id, vec); of an id's vectors the last segment's stays."""
    each = [spark.read.parquet(p).withColumn("segment", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, each).groupBy("id").agg(F.max_by("vec", "segment").alias("vec"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tweet_id string, tweet_index long").csv(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_columns(spark: SparkSession, path: str, cols: dict[str, str]) -> DataFrame:
    """Typed columns of a CSV file with a header: trimmed, blanks null. A missing header is an error."""
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in cols if c not in rows.columns]
    if missing:
        raise ValueError(f"columns not in the header: {missing}")
    return rows.select(*[blank(F.col(f"`{c}`")).cast(kind).alias(c) for c, kind in cols.items()])


def rows_between(df: DataFrame, position: str, start: int, end: int) -> DataFrame:
    """Rows of positions [start, end)."""
    return df.filter((F.col(position) >= start) & (F.col(position) < end))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")
