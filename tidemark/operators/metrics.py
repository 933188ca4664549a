"""Ranking metrics per action over (action, label, score) rows.

Running sums over falling scores are made inside ranges of scores, cut at quantiles, and shifted by the totals of the
ranges before, so no task sees all rows of an action. What a row's predecessor had follows from the sums themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.order import stored

#: Rows of a range, about, and the smallest and largest number of ranges of a group.
RANGE_ROWS, PARTS, MOST_PARTS = 1_000_000, 16, 4096


def running(rows: DataFrame, by: str, order: str, sums: list[str], ties: str | None = None) -> DataFrame:
    """Adds ``<c>_upto``: running sums per group over falling ``order``, rows that tie by rising ``ties`` (a number).

    The number of ranges a group is cut into grows with the rows. Rows that tie at a cut are a range of their own, and as most
    rows of a group may tie there (scores that were filled with 0), such a range is cut again by ``ties``. Cuts and totals have a row a group
    and one a range; whether they are broadcast is left to their size. Rows and cuts are stored: a sketch that is made again merges its
    parts in another order and gives other cuts, and totals by those don't fit the ranges.
    """
    rows = stored(rows, "running")
    parts = min(MOST_PARTS, max(PARTS, rows.count() // RANGE_ROWS))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = stored(rows.groupBy(by).agg(F.percentile_approx(order, at, F.lit(100 * parts)).alias("_cuts")), "cuts")
    own = rows.join(cuts, by)
    above = F.size(F.filter("_cuts", lambda c: c > F.col(order)))
    part = 2 * above + F.when(F.array_contains("_cuts", F.col(order)), 1).otherwise(0)  # what ties at a cut comes after what is above it
    own = own.withColumn("_part", part).drop("_cuts")
    if ties is not None:
        inner = own.filter("_part % 2 = 1").groupBy(by, "_part").agg(F.percentile_approx(ties, at, F.lit(100 * parts)).alias("_cuts"))
        own = own.join(stored(inner, "cuts"), [by, "_part"], "left").withColumn("_sub", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(ties))), F.lit(0))).drop("_cuts")
    else:
        own = own.withColumn("_sub", F.lit(0))
    key = [by, "_part", "_sub"]
    totals = own.groupBy(*key).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = W.partitionBy(by).orderBy("_part", "_sub").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*key, *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums])
    inside = W.partitionBy(*key).orderBy(F.desc(order), *([ties] if ties else [])).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = own.withColumns({f"_{c}_in": F.sum(c).over(inside) for c in sums}).join(totals, key)
    new = {f"{c}_upto": F.col(f"_{c}_in") + F.col(f"_{c}_before") for c in sums}
    return out.withColumns(new).select(*rows.columns, *new)


def _area(steps: DataFrame, rows: DataFrame, by: str, first_counts: bool) -> DataFrame:
    """Sum of trapezoids between each step of (tp, n) and the one before it; the first one starts at (0, 1) or not at all."""
    total = rows.groupBy(by).agg(F.sum("label").alias("_total"))
    steps = steps.join(total, by)
    tp0, n0 = F.col("tp_upto") - F.col("tp"), F.col("n_upto") - F.col("n")
    p, p0 = F.col("tp_upto") / F.col("n_upto"), F.when(n0 > 0, F.try_divide(tp0, n0)).otherwise(1.0)
    r, r0 = (F.coalesce(F.try_divide(x, F.col("_total")), F.lit(0.0)) for x in (F.col("tp_upto"), tp0))
    area = (r - r0) * (p + p0) / 2
    area = area if first_counts else F.when(n0 > 0, area).otherwise(0.0)
    return steps.groupBy(by).agg(F.sum(area).alias("pr_auc"))


def curve(rows: DataFrame, by: str = "action") -> DataFrame:
    """tp, n, and their running sums at each distinct score, falling."""
    return running(rows.groupBy(by, "score").agg(F.sum("label").alias("tp"), F.count("*").alias("n")), by, "score", ["tp", "n"])


def pr_auc(rows: DataFrame, by: str = "action") -> DataFrame:
    """Area under the threshold curve with the point (0, 1), by trapezoids over distinct scores."""
    return _area(curve(rows, by), rows, by, True)


def pr_auc_rows(rows: DataFrame, key: str, by: str = "action") -> DataFrame:
    """Area by trapezoids between consecutive rows of falling score (ties by key), from the second row on."""
    steps = rows.select(by, key, "score", F.col("label").alias("tp"), F.lit(1).alias("n"))
    return _area(running(steps, by, "score", ["tp", "n"], key), rows, by, False)


def relative_cross_entropy(rows: DataFrame, by: str = "action", *, inside: float | None = None) -> DataFrame:
    """Gain over always predicting the rate, in percent. ``inside`` adds a constant within the logarithms, otherwise scores
    are clipped to [1e-15, 1 - 1e-15]."""
    s, y = F.col("score"), F.col("label")
    if inside is None:
        s = F.least(F.greatest(s, F.lit(1e-15)), F.lit(1 - 1e-15))
        loss = -(y * F.log(s) + (1 - y) * F.log(1 - s))
    else:
        loss = -(y * F.log(s + inside) + (1 - y) * F.log(1 - s + inside))
    got = rows.groupBy(by).agg(F.avg(loss).alias("loss"), F.avg(y.cast("double")).alias("ctr"))
    c = F.col("ctr")
    base = -(c * F.log(c) + (1 - c) * F.log(1 - c))
    return got.select(by, "ctr", F.when((c > 0) & (c < 1), (1 - F.col("loss") / base) * 100).alias("rce"))


def report(rows: DataFrame, by: str = "action") -> DataFrame:
    """Both metrics per action, and their means as the action ``mean``."""
    each = pr_auc(rows, by).join(relative_cross_entropy(rows, by).select(by, "rce"), by)
    return each.unionByName(each.agg(F.lit("mean").alias(by), F.avg("pr_auc").alias("pr_auc"), F.avg("rce").alias("rce")))


def rank_desc(rows: DataFrame, by: str, score: str) -> DataFrame:
    """Competition ranks: ties share one, the next skips. Ranks are made per distinct score, in ranges of scores."""
    steps = running(rows.groupBy(by, score).agg(F.count("*").alias("_n")), by, score, ["_n"])
    steps = steps.select(by, score, (F.col("_n_upto") - F.col("_n") + 1).cast("int").alias("rank"))
    return rows.join(steps, [by, score]).select(*rows.columns, "rank")


def top_n(rows: DataFrame, row: str, item: str, value: str, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """The n largest values of each row, without excluded (row, item) pairs; ties by item."""
    rows = rows if excluded is None else rows.join(excluded, [row, item], "left_anti")
    rank = F.row_number().over(W.partitionBy(row).orderBy(F.desc(value), item))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def standardise_within(rows: DataFrame, row: str, value: str) -> DataFrame:
    """Values less their row's mean over its deviation, where that is above 1e-5. Means are aggregated and joined back."""
    stats = rows.groupBy(row).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    out = rows.join(stats, row)
    z = F.when(F.col("_s") > 1e-5, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.col(value))
    return out.withColumn(value, z).select(*rows.columns)


def best_iteration(curve: DataFrame, by: str) -> DataFrame:
    """The largest metric and its first iteration."""
    return curve.groupBy(by).agg(F.max("metric").alias("metric"), F.max_by("iteration", F.struct("metric", -F.col("iteration"))).alias("iteration"))
