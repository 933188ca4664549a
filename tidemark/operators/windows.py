"""Histories of several training windows at once.

Every window predicts its own rows and must not see them, so each has a history of its own: the log without its train rows
and without validation rows. A row's windows are bits of a mask. One pass over the log adds up counts and latest times per
user, creator and mask; a window's history is then what the masks without its bit add up to. Sums and maxima are combined
alike, so nothing is subtracted and no window reads the log again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.impressions import ACTIONS, DAY, times
from tidemark.operators.splits import split_by_create_date

TOTALS = ["total", "pos", *[f"{a}_n" for a in ACTIONS]]
LATEST = [f"{a}_last" for a in ACTIONS]


def with_mask(log: DataFrame, *, cutoff: int, interval: int = DAY, n: int = 5) -> DataFrame:
    """Adds ``valid`` and ``mask``: bit i is set if window i may not see the row (all bits for validation rows)."""
    if n > 30:
        raise ValueError("a mask holds 30 windows")
    mask = F.lit(0)
    for i in range(n):
        split = split_by_create_date(log, start=cutoff - (i + 1) * interval, end=cutoff - i * interval, cutoff=cutoff)
        mask = mask + F.when(split.isNotNull(), F.lit(1 << i)).otherwise(0)
    start, end = cutoff - interval, cutoff
    valid = F.coalesce(split_by_create_date(log, start=start, end=end, cutoff=cutoff) == "valid", F.lit(False))
    return log.withColumns({"mask": mask, "valid": valid})


def window_rows(masked: DataFrame, n: int = 5) -> DataFrame:
    """The rows that each window trains on, validation rows with window 0 alone: adds chunk, split."""
    own = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", "mask", i).bitwiseAND(F.lit(1)) == 1)
    chunk = F.when(F.col("valid"), F.array(F.lit(0))).otherwise(own)
    split = F.when(F.col("valid"), "valid").otherwise("train")
    return masked.select("*", split.alias("split"), F.explode(chunk).alias("chunk")).drop("mask", "valid")


def partial_counts(masked: DataFrame, *keys: str) -> DataFrame:
    """Per keys and mask: rows, rows with any action, and per action count and latest time. The only pass over the log."""
    return masked.groupBy(*keys, "mask").agg(
        F.count("*").alias("total"), F.count(F.coalesce(*times())).alias("pos"),
        *[F.count(f"{a}_ts").alias(f"{a}_n") for a in ACTIONS], *[F.max(f"{a}_ts").alias(f"{a}_last") for a in ACTIONS],
    )


def window_histories(partial: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """Per keys an array with the history of each window: counts (0 if there are none) and latest times (null if there are none)."""

    def of(i: int) -> Column:
        seen = F.col("mask").bitwiseAND(F.lit(1 << i)) == 0
        sums = [F.coalesce(F.sum(F.when(seen, F.col(c))), F.lit(0)).alias(c) for c in TOTALS]
        return F.struct(*sums, *[F.max(F.when(seen, F.col(c))).alias(c) for c in LATEST])

    return partial.groupBy(*keys).agg(F.array(*[of(i) for i in range(n)]).alias("windows"))


def window_features(masked: DataFrame, *, start: int, unit: float, n: int = 5) -> DataFrame:
    """The rows of ``window_rows`` with the history that their own window may see, of their user (``u_``), their creator
    (``c_``) and both (``with_``): counts, shares of impressions, and offsets of the latest times from ``start``."""
    from tidemark.operators.order import stored

    pairs = stored(partial_counts(masked, "user_id", "creator_id"), "windows")  # users and creators add pairs up
    out = window_rows(masked, n)
    for prefix, keys in (("u", ["user_id"]), ("c", ["creator_id"]), ("with", ["user_id", "creator_id"])):
        merged = pairs.groupBy(*keys, "mask").agg(*[F.sum(c).alias(c) for c in TOTALS], *[F.max(c).alias(c) for c in LATEST])
        own = window_histories(merged, *keys, n=n).withColumnRenamed("windows", f"_{prefix}")
        out = out.join(own, keys, "left")
    cols = []
    for prefix in ("u", "c", "with"):
        h = F.get(F.col(f"_{prefix}"), F.col("chunk"))
        total = F.coalesce(h["total"], F.lit(0))
        cols += [F.coalesce(h[c], F.lit(0)).alias(f"{prefix}_{c}") for c in TOTALS]
        cols += [F.coalesce((h[f"{a}_last"] - start) / unit, F.lit(0.0)).alias(f"{prefix}_{a}_last") for a in ACTIONS]
        cols += [F.when(total > 0, h[f"{a}_n"] / total).otherwise(0.0).alias(f"{prefix}_{a}_norm") for a in ACTIONS]
    return out.select(*[c for c in out.columns if not c.startswith("_")], *cols)


def day_sketches(rows: DataFrame, entity: str, value: str, *, cutoff: int, at: str = "t", interval: int = DAY, precision: int = 12) -> DataFrame:
    """Per entity and day before the cut-off (day 0 is the last one) a HyperLogLog sketch of the values, mergeable for good:
    a day's sketches are written once and later windows only read them."""
    day = F.floor((F.lit(cutoff) - F.col(at)) / interval).cast("int")
    rows = rows.filter((F.col(at) <= cutoff) & F.col(value).isNotNull()).withColumn("day", day)
    return rows.groupBy(entity, "day").agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def trailing_distinct(sketches: DataFrame, entity: str, days: list[int]) -> DataFrame:
    """(entity, days, distinct): estimates of distinct values in the last ``days`` days, for every length at once.

    The standard error is about 1.04 / 2^(precision / 2), 1.6% at 12; a few hundred values or fewer are counted nearly exactly.
    A sketch is sent once to every window that holds its day and merged before the exchange.
    """
    wide = F.filter(F.array(*[F.lit(d) for d in days]), lambda d: d > F.col("day"))
    rows = sketches.select(entity, "sketch", F.explode(wide).alias("days"))
    return rows.groupBy(entity, "days").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
