"""Boosted trees by second-order gains on binned columns, level by level.

Columns are binned once at approximate quantiles. A level of a tree is one aggregation: gradient and hessian sums per node,
column and bin, added up in every task before the exchange, so what is shuffled grows with nodes, columns and bins and not
with rows. Splits are found by running sums over a node's bins; the driver gets a row a node. Leaves are
``-G / (H + penalty)`` times the rate, gains those of the penalised loss. Trees are small arrays applied to the bins of a
row by an expression; margins are stored every few trees, so plans don't grow with the rounds.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.order import stored

#: Trees between two writes of the margins.
STORE_EVERY = 8


def constant(values: list, kind: str) -> Column:
    """A list as one array literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


@dataclass
class Tree:
    """A complete binary tree in level order: column (-1: a leaf), bin up to which rows go left, value, gain of the split."""

    depth: int
    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def __post_init__(self):
        if not self.column:
            n = 2 ** (self.depth + 1) - 1
            self.column, self.bin, self.value, self.gain = [-1] * n, [0] * n, [0.0] * n, [0.0] * n

    def node(self, bins: Column) -> Column:
        """Node that a row ends in."""
        column, limit = constant(self.column, "int"), constant(self.bin, "int")

        def down(n: Column, _: Column) -> Column:
            right = F.get(bins, F.get(column, n)) > F.get(limit, n)
            return F.when(F.get(column, n) < 0, n).otherwise(2 * n + 1 + right.cast("int"))

        return F.aggregate(F.array_repeat(F.lit(0), max(self.depth, 1)), F.lit(0), down)

    def leaf(self, bins: Column) -> Column:
        return F.get(constant(self.value, "double"), self.node(bins))


@dataclass
class Trees:
    """Fitted trees: columns, bin edges of each, trees."""

    cols: list[str]
    edges: list[list[float]]
    trees: list[Tree]

    def binned(self) -> Column:
        """Bins of a row: how many edges of a column lie below its value; null counts as below all."""
        def below(value: Column, edges: list[float]) -> Column:
            return F.when(value.isNull(), 0).otherwise(F.size(F.filter(constant(edges, "double"), lambda x: x < value)))

        each = [below(F.col(c).cast("double"), e) for c, e in zip(self.cols, self.edges, strict=True)]
        return F.array(*[b.cast("int") for b in each])

    def margin(self, bins: Column, upto: int | None = None) -> Column:
        out = F.lit(0.0)
        for t in self.trees[:upto]:
            out = out + t.leaf(bins)
        return out

    def score(self, df: DataFrame, keep: list[str], name: str = "score", upto: int | None = None) -> DataFrame:
        """Probability of label 1 by the first ``upto`` trees."""
        rows = df.select(*keep, self.binned().alias("_bins"))
        return rows.select(*keep, (1 / (1 + F.exp(-self.margin(F.col("_bins"), upto)))).alias(name))

    def importances(self) -> list[tuple[str, float]]:
        """Columns by falling sum of gains, unused ones 0."""
        total = dict.fromkeys(self.cols, 0.0)
        for t in self.trees:
            for c, g in zip(t.column, t.gain, strict=True):
                if c >= 0:
                    total[self.cols[c]] += g
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables: edges (column, edges) and nodes (tree, depth, node, column, bin, value, gain)."""
        spark.createDataFrame(list(enumerate(self.cols, 0)), "at int, column string").join(
            spark.createDataFrame(list(enumerate(self.edges)), "at int, edges array<double>"), "at").write.parquet(f"{path}/edges")
        rows = [(i, t.depth, n, *x) for i, t in enumerate(self.trees) for n, x in enumerate(zip(t.column, t.bin, t.value, t.gain, strict=True))]
        spark.createDataFrame(rows, "tree int, depth int, node int, column int, bin int, value double, gain double").write.parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        edges = spark.read.parquet(f"{path}/edges").orderBy("at").collect()
        trees: dict[int, Tree] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            t = trees.setdefault(r["tree"], Tree(r["depth"]))
            t.column[r["node"]], t.bin[r["node"]], t.value[r["node"]], t.gain[r["node"]] = r["column"], r["bin"], r["value"], r["gain"]
        return cls([r["column"] for r in edges], [r["edges"] for r in edges], list(trees.values()))


def quantile_edges(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 1`` edges a column, from one aggregation to a row of sketches."""
    at = [i / bins for i in range(1, bins)]
    got = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, F.lit(100 * bins)).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [sorted({x for x in got[f"q{i}"] or [] if math.isfinite(x)}) for i in range(len(cols))]


def fit(df: DataFrame, cols: list[str], label: str, *, depth: int = 5, rounds: int = 20, rate: float = 0.1, penalty: float = 1.0,
        least_hessian: float = 1.0, least_gain: float = 0.0, bins: int = 64) -> Trees:
    """Boosted trees for a 0/1 label with logistic loss. Rows without a label are left out; an empty table gives trees of 0."""
    model = Trees(cols, quantile_edges(df, cols, bins), [])
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), model.binned().alias("bins"), F.lit(0.0).alias("m"))
    rows, since = stored(rows, "trees"), 0
    for _ in range(rounds):
        if len(model.trees) - since >= STORE_EVERY:
            margin = F.col("m")
            for t in model.trees[since:]:
                margin = margin + t.leaf(F.col("bins"))
            rows, since = stored(rows.select("y", "bins", margin.alias("m")), "trees"), len(model.trees)
        margin = F.col("m")
        for t in model.trees[since:]:
            margin = margin + t.leaf(F.col("bins"))
        p = 1 / (1 + F.exp(-margin))
        now = rows.select("bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
        model.trees.append(grow(now, depth, rate, penalty, least_hessian, least_gain))
    return model


def grow(rows: DataFrame, depth: int, rate: float, penalty: float, least_hessian: float, least_gain: float) -> Tree:
    """One tree on rows (bins, g, h)."""
    tree = Tree(depth)
    top = rows.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
    if top["g"] is None:
        return tree
    tree.value[0], open_ = -rate * top["g"] / (top["h"] + penalty), [0]
    for _ in range(depth):
        best = {r["node"]: r for r in splits(rows.withColumn("node", tree.node(F.col("bins"))), min(open_), penalty, least_hessian, least_gain).collect()}
        open_ = []
        for node, r in best.items():
            tree.column[node], tree.bin[node], tree.gain[node] = r["column"], r["bin"], r["gain"]
            for child, g, h in ((2 * node + 1, r["gl"], r["hl"]), (2 * node + 2, r["gr"], r["hr"])):
                tree.value[child] = -rate * g / (h + penalty)
                open_.append(child)
        if not open_:
            break
    return tree


def splits(rows: DataFrame, first: int, penalty: float, least_hessian: float, least_gain: float) -> DataFrame:
    """Best split of each node from ``first`` on, which are those of the level at hand: node, gain, column, bin, and the sums of both sides. Equal gains (to nine digits of
    the total) go to the first column, then the lowest bin."""
    own = rows.filter(F.col("node") >= first).select("node", "g", "h", F.posexplode("bins").alias("column", "bin"))
    sums = own.groupBy("node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    order = W.partitionBy("node", "column").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("node", "column")  # a node's bins of a column
    sums = sums.select("node", "column", "bin", F.sum("g").over(order).alias("gl"), F.sum("h").over(order).alias("hl"), F.sum("g").over(every).alias("gt"), F.sum("h").over(every).alias("ht"))
    sums = sums.withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})

    def part(g: str, h: str) -> Column:
        return F.col(g) * F.col(g) / (F.col(h) + penalty)

    gain = (part("gl", "hl") + part("gr", "hr") - part("gt", "ht")) / 2
    ok = sums.withColumn("gain", F.round(gain, 9)).filter((F.col("hl") >= least_hessian) & (F.col("hr") >= least_hessian) & (F.col("gain") > least_gain))
    pick = F.max_by(F.struct("gain", "column", "bin", "gl", "hl", "gr", "hr"), F.struct("gain", -F.col("column"), -F.col("bin")))
    return ok.groupBy("node").agg(pick.alias("x")).select("node", "x.*")


def out_of_fold(df: DataFrame, cols: list[str], label: str, fold: str, k: int, keep: list[str], name: str = "score", **settings) -> DataFrame:
    """Every row scored by trees that were fitted on the other folds: ``keep`` and the score."""
    out = None
    for i in range(k):
        model = fit(df.filter(F.col(fold) != i), cols, label, **settings)
        part = model.score(df.filter(F.col(fold) == i), keep, name)
        out = part if out is None else out.unionByName(part)
    return out
