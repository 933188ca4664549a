"""Train and validation splits, samples and batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.impressions import DAY, HOUR, times
from tidemark.operators.order import global_index


def portable(key: Column, seed: int) -> Column:
    """A hash that other engines agree on: md5 of the id and the seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def date_windows(df_or_spark, *, cutoff: int, interval: int = DAY, n: int = 5) -> DataFrame:
    """n back-to-back windows (start, end] that end at the cut-off, newest first."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("chunk"), (F.lit(cutoff) - (i + 1) * interval).alias("start"), (F.lit(cutoff) - i * interval).alias("end"))


def any_after(date: Column | int) -> Column:
    return F.coalesce(F.greatest(*times()) > date, F.lit(False))


def negative() -> Column:
    return F.coalesce(*times()).isNull()


def split_by_create_date(imps: DataFrame, *, start: Column | int, end: Column | int, cutoff: int) -> Column:
    """'valid', 'train' or null. Positives go by their actions: any after the cut-off is valid, else any in (start, end] is
    train. Negatives go by the item's creation: after the cut-off valid, strictly inside train."""
    hit = F.lit(False)
    for t in times():
        hit |= F.coalesce((t > start) & (t <= end), F.lit(False))
    made = F.col("tweet_ts")
    own = F.when(any_after(cutoff), "valid").when(hit, "train")
    other = F.when(made > cutoff, "valid").when((made > start) & (made < end), "train")
    return F.when(negative(), other).otherwise(own)


def split_blend(imps: DataFrame, *, train: int, valid: int) -> Column:
    """By the earliest action, or the item's creation for negatives: after ``valid`` valid, else after ``train`` train."""
    t = F.coalesce(F.least(*times()), F.col("tweet_ts"))
    return F.when(t > valid, "valid").when(t > train, "train")


def split_random_negatives(imps: DataFrame, *, train: int, valid: int, key: str = "engage_index", seed: int = 0) -> DataFrame:
    """Positives by any action after the dates; as many negatives as positives of each part, drawn in hash order, the
    first ones valid. Rows of neither part are left out."""
    pos = imps.filter(~negative()).withColumn("split", F.when(any_after(valid), "valid").when(any_after(train), "train"))
    pos = pos.filter("split is not null")
    n = pos.agg(F.count(F.when(F.col("split") == "valid", 1)), F.count("*")).first()
    drawn = global_index(imps.filter(negative()), portable(F.col(key), seed), name="_rank")
    drawn = drawn.filter(F.col("_rank") < n[1]).withColumn("split", F.when(F.col("_rank") < n[0], "valid").otherwise("train"))
    return pos.unionByName(drawn.drop("_rank"))


def window_sets(imps: DataFrame, *, cutoff: int, interval: int = DAY, n: int = 5) -> DataFrame:
    """Every window's own train rows, and the validation rows with window 0 only: adds chunk, split."""
    each = [
        F.struct(F.lit(i).alias("chunk"), split_by_create_date(imps, start=cutoff - (i + 1) * interval, end=cutoff - i * interval, cutoff=cutoff).alias("split"))
        for i in range(n)
    ]
    mine = F.filter(F.array(*each), lambda w: (w["split"] == "train") | (w["split"] == "valid") & (w["chunk"] == 0))
    return imps.withColumn("_w", F.explode(mine)).select(*imps.columns, "_w.chunk", "_w.split")


def action_window(actions: DataFrame, *, cutoff: int, interval: int = DAY, n: int = 5) -> DataFrame:
    """The window (start, end] that an action's time lies in, by arithmetic instead of a range join."""
    chunk = F.floor((F.lit(cutoff) - F.col("at")) / interval).cast("int")
    return actions.withColumn("chunk", chunk).filter(F.col("chunk").between(0, n - 1))


def members(df: DataFrame, of: DataFrame, key: str, *, inside: bool = True) -> DataFrame:
    """Rows whose key is (not) in another frame."""
    return df.join(of.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def k_chunks(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k near-equal chunks of rows in hash order, the last with the remainder."""
    n = df.count()
    rows = global_index(df, portable(F.col(key), seed), F.col(key), name="_rank")
    return rows.withColumn("chunk", F.least(F.floor(F.col("_rank") / max(n // k, 1)), F.lit(k - 1)).cast("int")).drop("_rank")


def holdout(df: DataFrame, key: str, share: float = 0.4, seed: int = 0) -> DataFrame:
    """Adds ``eval``: true for the given share of rows by hash."""
    bucket = F.conv(F.substring(portable(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("eval", bucket < int(share * (1 << 32)))


def length_batches(df: DataFrame, key: str, length: str, *, bins: list[int], batch: int, seed: int = 0) -> DataFrame:
    """Batches of rows of like length: bins by length, hash order inside a bin, partial batches dropped.

    Adds bin and batch (in the bin).
    """
    at = F.lit(0)
    for b in bins:
        at = at + (F.col(length) >= b).cast("int")
    # positions in (bin, hash) order less the bin's first one: no task sorts a whole bin
    rows = global_index(df.withColumn("bin", at).withColumn("_h", portable(F.col(key), seed)), "bin", "_h", key, name="_at")
    starts = rows.groupBy("bin").agg(F.min("_at").alias("_start"))
    rows = rows.join(starts, "bin").withColumn("batch", F.floor((F.col("_at") - F.col("_start")) / batch)).drop("_h", "_at", "_start")
    full = rows.groupBy("bin", "batch").agg(F.count("*").alias("_n")).filter(F.col("_n") == batch).select("bin", "batch")
    return rows.join(full, ["bin", "batch"])


def longest_first(df: DataFrame, own: str, key: str, name: str = "place") -> DataFrame:
    """Rows by falling length of an array, ties by key, with their 0-based place: ranges of lengths are sorted side by side."""
    return global_index(df, F.size(own).desc(), F.col(key), name=name)


def corpus_sets(a: DataFrame, b: DataFrame, valid_ids: DataFrame, *, key: str, own: str, words: str, least: int = 7) -> DataFrame:
    """Union of two token sets: ids of the validation set go there, the rest train; short rows go, token lists are unique."""
    both = a.unionByName(b).filter(F.col(words) >= least)
    valid = both.join(valid_ids.select(key).distinct(), key, "left_semi").withColumn("split", F.lit("valid"))
    train = both.join(valid_ids.select(key).distinct(), key, "left_anti").withColumn("split", F.lit("train"))
    return valid.unionByName(train).groupBy(own).agg(F.min(F.struct(key, "split", words)).alias("x")).select(own, "x.*")


def sample_rows(df: DataFrame, fraction: float, *, replace: bool = False, seed: int = 0) -> DataFrame:
    return df.sample(replace, fraction, seed)


def drawn_rows(df: DataFrame, key: str, fraction: float, *, replace: bool = False, seed: int = 0) -> DataFrame:
    """A sample that follows from ids and seed alone: each row with chance ``fraction``, or with replacement as often as a
    Poisson number of that mean says (beyond 40 copies none)."""
    u = uniform(key, seed=seed)
    if not replace:
        return df.filter(u <= fraction)
    copies, below, term = F.lit(0), 0.0, math.exp(-fraction)
    for k in range(40):
        below, term = below + term, term * fraction / (k + 1)
        copies = copies + (u > below).cast("int")
    return df.withColumn("_n", copies).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def uniform(*salt: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1] that follows from the salt and the seed alone and that other engines agree on."""
    own = F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in salt])
    return (F.conv(F.substring(portable(own, seed), 1, 12), 16, 10).cast("long") + 1) / float(1 << 48)


def weighted_choice(df: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, chances in proportion to the weight: smallest exponential keys."""
    own = df.filter(F.col(weight) > 0).withColumn("_k", -F.log(uniform(key, seed=seed)) / F.col(weight))
    return own.orderBy("_k", key).limit(k).drop("_k")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(portable(F.col(key), seed))


def random_matrix(spark, rows: int, cols: int, *, normal: bool = False, seed: int = 0) -> DataFrame:
    """(row, values): each value follows from its row, column and the seed, however the rows are dealt over tasks."""
    row = F.col("id")

    def cell(c: int) -> Column:
        u = uniform(row, F.lit(c), seed=seed)
        if not normal:
            return u
        v = uniform(row, F.lit(c), seed=seed + 1)  # Box-Muller
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)

    return spark.range(rows).select(row.alias("row"), F.array(*[cell(c) for c in range(cols)]).alias("values"))


def ith_choice(i: Column, n: int, length: int) -> Column:
    """Digits of i in base n, lowest first: the i-th way to choose ``length`` times among n."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.pmod(F.floor(i / F.pow(F.lit(float(n)), k)), F.lit(n)).cast("long"))


CUTOFF_BEFORE_END = 4 * HOUR
