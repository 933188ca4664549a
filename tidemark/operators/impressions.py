"""The impression log: who saw which item of which creator, and which of four actions followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ["reply", "retweet", "comment", "like"]
DAY, HOUR = 86400, 3600


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions derived from ``events``: the item is the integer in props, its creator the item modulo 20."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    tweet = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    log = e.select(F.col("event_id").alias("engage_index"), "user_id", tweet.alias("tweet_id"), t.alias("t"), "event_type", "value")
    first = log.groupBy("tweet_id").agg(F.min("t").alias("tweet_ts"))
    kind = F.col("event_type")
    like = (kind == "purchase") | ((kind != "view") & (F.col("value") >= 100))
    return log.join(first, "tweet_id").select(
        "engage_index", "user_id", "tweet_id", (F.col("tweet_id") % 20).alias("creator_id"), "t", "tweet_ts",
        F.when(kind == "error", F.col("t")).alias("reply_ts"), F.when(kind == "signup", F.col("t")).alias("retweet_ts"),
        F.when(kind == "click", F.col("t")).alias("comment_ts"), F.when(like, F.col("t")).alias("like_ts"),
        ((F.col("user_id") + F.col("tweet_id") % 20) % 3 == 0).alias("follow"),
    )


def times(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{a}_ts") for a in ACTIONS]


def labels(imps: DataFrame) -> DataFrame:
    """Adds a 0/1 label per action, and ``negative`` where none followed."""
    out = imps.withColumns({f"{a}_label": F.col(f"{a}_ts").isNotNull().cast("int") for a in ACTIONS})
    return out.withColumn("negative", F.coalesce(*times()).isNull())


def unpivot_actions(imps: DataFrame) -> DataFrame:
    """One row per action that followed: the impression's columns, action, at. Absent actions give no row."""
    keep = [c for c in imps.columns if c not in {f"{a}_ts" for a in ACTIONS}]
    pairs = F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"{a}_ts").alias("at")) for a in ACTIONS])
    rows = imps.select(*keep, F.explode(F.filter(pairs, lambda p: p["at"].isNotNull())).alias("_p"))
    return rows.select(*keep, "_p.action", "_p.at")


def all_before(date: Column) -> Column:
    """True if the date is negative or every action is before it."""
    return (date < 0) | F.coalesce(F.greatest(*times()) < date, F.lit(True))


def profiles(spark: SparkSession, sf_dir: str, start: int) -> DataFrame:
    """User and creator profiles from ``customer``; ``start`` is the first second of the log."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        F.col("c_custkey").alias("id"), F.abs(F.col("c_acctbal").cast("int")).alias("followers"),
        (F.col("c_nationkey") * 10).alias("following"), (F.col("c_mktsegment") == "BUILDING").alias("verified"),
        (F.lit(start) - DAY * (F.col("c_custkey") + 1)).alias("created"),
    )


def bounds(imps: DataFrame) -> tuple[int, int]:
    """First and last second of a log, from one aggregation."""
    r = imps.agg(F.min("t"), F.max("t")).first()
    return r[0], r[1]


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of items from ``documents``: tweet_id, creator_id, text, language, domain, tokens, hashtags.

    Stand-ins for what the tables lack: the type is the size class of the text, media are its words in capitals, links its
    e-mail addresses. The creator is that of ``from_events``.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("tweet_id"), (F.col("doc_id") % 20).alias("creator_id"), "text", F.col("lang").alias("language"), F.col("source").alias("domain"),
        F.split(F.col("text"), r"[ \n]+").alias("tokens"),
        F.regexp_extract_all("text", F.lit(r"(#[^ \n]+)"), 1).alias("hashtags"),
        F.when(F.col("n_chars") >= 1000, "long").otherwise("short").alias("type"),
        F.regexp_extract_all("text", F.lit(r"([A-Z]{3,})"), 1).alias("media"),
        F.regexp_extract_all("text", F.lit(r"([a-z0-9.]+@[a-z0-9.]+)"), 1).alias("links"),
    )
