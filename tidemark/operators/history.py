"""Aggregates of what users and creators did before, without the rows that are to be predicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.impressions import ACTIONS, times, unpivot_actions


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def history(imps: DataFrame, held: DataFrame, key: str = "engage_index") -> DataFrame:
    """The log without rows of a train or validation set."""
    return imps.join(held.select(key), key, "left_anti")


def impression_counts(hist: DataFrame, entity: str, prefix: str) -> DataFrame:
    """Per entity: impressions, those with any action, and their ratio."""
    out = hist.groupBy(entity).agg(F.count("*").alias(f"{prefix}_total"), F.count(F.coalesce(*times())).alias(f"{prefix}_pos"))
    return out.withColumn(f"{prefix}_ratio", ratio(F.col(f"{prefix}_pos"), F.col(f"{prefix}_total")))


def action_counts(hist: DataFrame, entity: str, prefix: str, *, start: int, unit: float) -> DataFrame:
    """Per entity one column each action: count, count over impressions, and last time from ``start`` in ``unit`` seconds.

    One pass over the log with map-side sums; an action that never happened has count and offset 0.
    """
    aggs = []
    for a in ACTIONS:
        t = F.col(f"{a}_ts")
        aggs += [F.count(t).alias(f"{prefix}_{a}_n"), F.coalesce((F.max(t) - start) / unit, F.lit(0.0)).alias(f"{prefix}_{a}_last")]
    out = hist.groupBy(entity).agg(F.count("*").alias("_n"), *aggs)
    return out.withColumns({f"{prefix}_{a}_norm": ratio(F.col(f"{prefix}_{a}_n"), F.col("_n")) for a in ACTIONS}).drop("_n")


def attach(imps: DataFrame, features: DataFrame, key: str, entity: str | None = None) -> DataFrame:
    """Left join of an entity's features to impressions by ``key``; missing ones are 0."""
    entity = entity or key
    f = features.withColumnRenamed(entity, key) if entity != key else features
    return imps.join(f, key, "left").fillna(0, [c for c in f.columns if c != key])


def pair_counts(hist: DataFrame) -> DataFrame:
    """Actions of a user with one creator: user_id, creator_id, one count each action."""
    return hist.groupBy("user_id", "creator_id").agg(*[F.count(f"{a}_ts").alias(f"with_{a}_n") for a in ACTIONS])


def action_sets(hist: DataFrame, entity: str) -> DataFrame:
    """Size, first and last row of the actions of each kind of an entity; no action at all is the kind ``none``."""
    acted = unpivot_actions(hist).select(entity, "engage_index", "action")
    none = hist.filter(F.coalesce(*times()).isNull()).select(entity, "engage_index", F.lit("none").alias("action"))
    return acted.unionByName(none).groupBy(entity, "action").agg(
        F.count("*").alias("n"), F.min("engage_index").alias("first_row"), F.max("engage_index").alias("last_row")
    )


def mean_content(hist: DataFrame, contents: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Means over a user's actions, per action: distinct tags, tokens, media, links and domains of the item, the follow flag,
    and with ``profiles`` (id, verified) whether the creator is verified. An item without contents counts as 0."""
    cols = {"tags": "hashtags", "words": "tokens", "media": "media", "links": "links"}
    per = contents.select(
        "tweet_id", *[F.size(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(n) for n, c in cols.items()],
        F.col("domain").isNotNull().cast("int").alias("domains"),
    )
    rows = unpivot_actions(hist).join(per, "tweet_id", "left")
    flags = {"follow": F.col("follow").cast("int")}
    if profiles is not None:
        rows = rows.join(profiles.select(F.col("id").alias("creator_id"), "verified"), "creator_id", "left")
        flags["verified"] = F.coalesce(F.col("verified").cast("int"), F.lit(0))
    means = {n: F.coalesce(n, F.lit(0)) for n in (*cols, "domains")} | flags
    return rows.groupBy("user_id", "action").agg(*[F.avg(c).alias(n) for n, c in means.items()])


def distinct_languages(hist: DataFrame, contents: DataFrame) -> DataFrame:
    """Languages of the items a user acted on."""
    rows = hist.filter(F.coalesce(*times()).isNotNull()).join(contents.select("tweet_id", "language"), "tweet_id")
    return rows.groupBy("user_id").agg(F.count_distinct("language").alias("languages"))


def mean_statistics(hist: DataFrame, stats: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Means of item statistics over (row, action) pairs: a row with two actions counts twice."""
    rows = unpivot_actions(hist).join(stats, "tweet_id")
    return rows.groupBy(entity).agg(*[F.avg(c).alias(c) for c in cols])


def interactions(hist: DataFrame) -> DataFrame:
    """user_id, creator_id, n: (row, action) pairs."""
    acted = sum((t.isNotNull().cast("int") for t in times()[1:]), times()[0].isNotNull().cast("int"))
    return hist.groupBy("user_id", "creator_id").agg(F.sum(acted).alias("n")).filter("n > 0")


def first_distinct_items(hist: DataFrame, most: int = 10) -> DataFrame:
    """Per (user, action): items in row order up to the ``most``-th distinct one, repeats included, cut to ``most``.

    The cut makes that the first ``most`` rows, so each task passes on no more than those of a user, however many it has.
    """
    rows = unpivot_actions(hist).select("user_id", "action", "engage_index", "tweet_id")
    rank = F.row_number().over(W.partitionBy("user_id", "action").orderBy("engage_index"))
    rows = rows.withColumn("at", rank).filter(F.col("at") <= most)
    got = rows.groupBy("user_id", "action").agg(F.sort_array(F.collect_list(F.struct("engage_index", "tweet_id"))).alias("x"))
    return got.select("user_id", "action", F.col("x.tweet_id").alias("items"))


def id_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """One row: the ids two frames share over those of either, of the first and of the second."""
    both = a.select(col).distinct().withColumn("l", F.lit(1)).join(b.select(col).distinct().withColumn("r", F.lit(1)), col, "full")
    n = F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1))
    return both.agg(F.try_divide(n, F.count("*")).alias("of_either"), F.try_divide(n, F.count("l")).alias("of_first"), F.try_divide(n, F.count("r")).alias("of_second"))


def account_age(created: Column, now: int) -> Column:
    """Days from an account's creation to ``now``, both in epoch seconds."""
    return (F.lit(now) - created) / 86400.0


def day_and_hour(at: Column) -> tuple[Column, Column]:
    """Day of the week (Monday 1) and hour of an epoch second, in the session's time zone."""
    stamp = F.timestamp_seconds(at)
    return F.weekday(stamp) + 1, F.hour(stamp)


def month_end(day: Column, ahead: int) -> Column:
    """Last day of the month ``ahead`` months after a date."""
    return F.last_day(F.add_months(day, ahead))


def month_end_time(at: Column, ahead: int) -> Column:
    """The same for a timestamp, which keeps its time of day."""
    return F.to_timestamp(F.concat_ws(" ", month_end(F.to_date(at), ahead).cast("string"), F.date_format(at, "HH:mm:ss.SSSSSS")))


def pad(items: Column, n: int = 10, fill: int = -1) -> Column:
    """The first n, filled up."""
    return F.slice(F.concat(items, F.array_repeat(F.lit(fill).cast("long"), n)), 1, n)
