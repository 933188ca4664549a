"""Feature transforms fitted on nonzeros in long form (row, col, value), applied to any frame of that form.

``fit`` returns a model whose parameters are a DataFrame; ``apply`` joins them, so a transform fitted on training rows is
reused unchanged elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import small, stored


def _v() -> Column:
    return F.col("value")


def lp_norm(m: DataFrame, by: str, p: float = 2.0) -> DataFrame:
    """Norm of each row or column; p = 1 takes absolute values, others don't."""
    total = F.sum(F.abs("value")) if p == 1 else F.pow(F.sum(F.pow("value", F.lit(p))), F.lit(1 / p))
    return m.groupBy(by).agg(total.alias("norm"))


@dataclass
class Fitted:
    """Parameters per column and the expression that applies them to ``value``."""

    params: DataFrame
    value: Column
    drop: Column | None = None

    def apply(self, m: DataFrame) -> DataFrame:
        out = m.join(self.params, "col", "left")
        out = out if self.drop is None else out.filter(~F.coalesce(self.drop, F.lit(False)))
        return out.withColumn("value", self.value).select(*m.columns)


def column_norm(m: DataFrame, p: float = 2.0) -> Fitted:
    return Fitted(lp_norm(m, "col", p), F.when(F.col("norm") > 1e-10, _v() / F.col("norm")).otherwise(_v()))


def row_norm(m: DataFrame, p: float = 2.0) -> DataFrame:
    norms = lp_norm(m, "row", p)
    return m.join(norms, "row").withColumn("value", F.when(F.col("norm") < 1e-5, _v()).otherwise(_v() / F.col("norm"))).drop("norm")


def min_max(m: DataFrame) -> Fitted:
    """By the nonzeros of all rows and the zeros of the first row; a constant column becomes 1."""
    first = m.agg(F.min("row")).first()[0]
    ext = m.groupBy("col").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.max((F.col("row") == F.lit(first)).cast("int")).alias("in_first")
    )
    zero = F.col("in_first") == 0
    params = ext.select(
        "col", F.when(zero, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
        F.when(zero, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
    )
    return Fitted(params, F.when(F.col("hi") > F.col("lo"), (_v() - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0))


def power(m: DataFrame, k: float) -> DataFrame:
    return m.withColumn("value", F.pow("value", F.lit(float(k))))


def outlier_clip(m: DataFrame, share: float, *, exact: bool = True) -> Fitted:
    """Clips to the r-th smallest and largest nonzero of a column, r = ceil(nonzeros * share) + 1 or all there are.

    Exact ranks come from running counts of a column's distinct values, made in ranges of values, so no task sorts a column;
    without ``exact`` a sketch of quantiles does.
    """
    if not exact:
        params = m.groupBy("col").agg(F.percentile_approx("value", share).alias("lo"), F.percentile_approx("value", 1 - share).alias("hi"))
    else:
        from tidemark.operators.metrics import running

        steps = running(m.groupBy("col", "value").agg(F.count("*").alias("n")), "col", "value", ["n"])
        total = m.groupBy("col").agg(F.count("*").alias("all"))
        steps = steps.join(total, "col").withColumn("r", F.least(F.ceil(F.col("all") * share) + 1, F.col("all")))
        below = F.col("all") - F.col("n_upto") + F.col("n")  # values up to this one
        params = steps.groupBy("col").agg(
            F.min(F.when(below >= F.col("r"), _v())).alias("lo"), F.max(F.when(F.col("n_upto") >= F.col("r"), _v())).alias("hi")
        )
    return Fitted(params, F.least(F.greatest(_v(), F.col("lo")), F.col("hi")))


def standardise(m: DataFrame, clip: float | None = None) -> Fitted:
    """By mean and deviation of a column's nonzeros; values within 1e-5 of the mean go."""
    params = m.groupBy("col").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = F.when(F.col("std") > 0, (_v() - F.col("mean")) / F.col("std")).otherwise(_v() - F.col("mean"))
    z = z if clip is None else F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))
    return Fitted(params, z, F.abs(_v() - F.col("mean")) < 1e-5)


def dense_standardise(df: DataFrame, cols: list[str], clip: float = 5.0) -> DataFrame:
    """Centred and scaled columns, clipped; a constant one is only centred. Statistics are one row."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    new = {}
    for c in cols:
        z = F.col(c) - F.lit(stats[f"m_{c}"])
        z = z / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else z
        new[c] = F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))
    return df.withColumns(new)


def tf_idf(m: DataFrame, rows: int) -> Fitted:
    """ln(1 + tf) ln(N / df)."""
    params = m.groupBy("col").agg(F.count("*").alias("df"))
    return Fitted(params, F.log(1 + _v()) * F.log(F.lit(float(rows)) / F.col("df")))


def yeo_johnson(v: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) > 1e-12, (F.pow(v + 1, lam) - 1) / lam).otherwise(F.log1p(v))
    down = F.when(F.abs(lam - 2) > 1e-12, -(F.pow(1 - v, 2 - lam) - 1) / (2 - lam)).otherwise(-F.log1p(-v))
    return F.when(v >= 0, up).otherwise(down)


def fit_yeo_johnson(m: DataFrame, grid: list[float] | None = None) -> Fitted:
    """Power of the largest likelihood per column on a grid, standardised: one aggregation over grid x values."""
    grid = grid or [round(-2 + 0.1 * i, 1) for i in range(41)]
    lam = F.col("lam")
    each = m.select("col", "value", F.explode(F.array(*[F.lit(g) for g in grid])).alias("lam"))
    y = yeo_johnson(_v(), lam)
    sums = each.groupBy("col", "lam").agg(
        F.avg(y).alias("mean"), F.var_pop(y).alias("var"), F.sum(F.signum("value") * F.log1p(F.abs("value"))).alias("jac"), F.count("*").alias("n")
    )
    like = -F.col("n") / 2 * F.log(F.greatest("var", F.lit(1e-300))) + (lam - 1) * F.col("jac")
    params = sums.groupBy("col").agg(F.max_by(F.struct("lam", "mean", "var"), like).alias("x")).select("col", "x.*")
    z = yeo_johnson(_v(), lam) - F.col("mean")
    return Fitted(params, F.when(F.col("var") > 0, z / F.sqrt("var")).otherwise(z))


def optimal_yeo_johnson(m: DataFrame, *, low: float = -5.0, high: float = 5.0, points: int = 16, tolerance: float = 1e-7) -> Fitted:
    """Power of the largest likelihood of every column between ``low`` and ``high``, standardised.

    All columns are searched together: a pass over the values works out the likelihood at ``points`` places inside every
    column's own bracket, which shrinks to the places beside the best one, until it is narrower than ``tolerance``. The
    likelihood has one maximum. A column with one value keeps its middle.
    """
    m = stored(m.select("col", F.col("value").cast("double").alias("value")), "power")
    base = m.groupBy("col").agg(F.sum(F.signum("value") * F.log1p(F.abs("value"))).alias("jac"), F.count("*").alias("n"))
    state = stored(base.select("col", "jac", "n", F.lit(low).alias("lo"), F.lit(high).alias("hi")), "power")
    width = high - low
    while width > tolerance:
        at = [F.col("lo") + (F.col("hi") - F.col("lo")) * (i / (points + 1)) for i in range(points + 2)]
        rows = m.join(small(state.select("col", "lo", "hi")), "col")
        spread = rows.groupBy("col").agg(*[F.var_pop(yeo_johnson(_v(), lam)).alias(f"v{i}") for i, lam in enumerate(at)])
        like = [-F.col("n") / 2 * F.log(F.greatest(F.col(f"v{i}"), F.lit(1e-300))) + (lam - 1) * F.col("jac") for i, lam in enumerate(at)]
        # the place in the middle of those that share the largest likelihood, so that a flat one doesn't drift
        best = F.array(*like)
        flat = F.filter(F.sequence(F.lit(0), F.lit(points + 1)), lambda i: F.get(best, i) >= F.array_max(best))
        found = state.join(spread, "col").withColumn("k", F.get(flat, F.floor(F.size(flat) / 2).cast("int")))
        step = (F.col("hi") - F.col("lo")) / (points + 1)
        lower, upper = F.col("lo") + step * F.greatest(F.col("k") - 1, F.lit(0)), F.col("lo") + step * F.least(F.col("k") + 1, F.lit(points + 1))
        state = stored(found.select("col", "jac", "n", lower.alias("lo"), upper.alias("hi")), "power")
        width *= 2 / (points + 1)
    lam = (F.col("lo") + F.col("hi")) / 2
    rows = m.join(small(state.select("col", lam.alias("lam"))), "col")
    y = yeo_johnson(_v(), F.col("lam"))
    params = stored(rows.groupBy("col").agg(F.first("lam").alias("lam"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")), "power")
    z = y - F.col("mean")
    return Fitted(params, F.when(F.col("var") > 0, z / F.sqrt("var")).otherwise(z))


def vectors_mean(m: DataFrame, rows: int) -> DataFrame:
    """Element-wise mean of rows, empty ones included."""
    return m.groupBy("col").agg((F.sum("value") / rows).alias("value"))


def dated(m: DataFrame, date: int, *, after: bool) -> DataFrame:
    """Entries (row, col, value, date) later than the date, or those up to it; rows left without entries vanish."""
    return m.filter(F.col("date") > date if after else F.col("date") <= date)


def listed_rows(m: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows of (old, new) positions, renumbered; a row may be listed several times."""
    return m.join(positions.select(F.col("old").alias("row"), "new"), "row").drop("row").withColumnRenamed("new", "row").select(*m.columns)


def merge_dated(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value, date) of both: values of one cell add up, the latest date stays."""
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("value").alias("value"), F.max("date").alias("date"))


def concat_columns(frames: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices (with their widths) side by side."""
    out, offset = None, 0
    for m, n in frames:
        part = m.withColumn("col", F.col("col") + offset)
        out, offset = part if out is None else out.unionByName(part), offset + n
    return out


def concat_rows(frames: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices (with their heights) one below the other."""
    out, offset = None, 0
    for m, n in frames:
        part = m.withColumn("row", F.col("row") + offset)
        out, offset = part if out is None else out.unionByName(part), offset + n
    return out


def to_sparse(df: DataFrame, row: str, vec: str) -> DataFrame:
    """Array -> (row, col, value) nonzeros."""
    return df.select(F.col(row).alias("row"), F.posexplode(vec).alias("col", "value")).filter("value <> 0")


def to_dense(m: DataFrame, width: int) -> DataFrame:
    """(row, col, value) -> row, vec, zeros filled in."""
    got = m.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "value"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return got.select("row", at.alias("vec"))


def binarise(m: DataFrame) -> DataFrame:
    return m.filter("value <> 0").withColumn("value", F.lit(1.0))
