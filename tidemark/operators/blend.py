"""Blends of several models' scores, and temperature scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import stored
from tidemark.operators.metrics import relative_cross_entropy

# Temperatures of the calibrated actions, and the shift of one.
TEMPERATURES = {"reply": 1.05, "retweet": 1.15, "comment": 1.05, "like": 1.25}
SHIFTS = {"like": -0.1}
GRID = [round(0.80 + 0.05 * i, 2) for i in range(10)]
EDGE = 1e-7


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def merge(preds: DataFrame, models: list[str], *, complete: bool = True) -> DataFrame:
    """Long predictions (tweet_id, user_id, action, model, score) -> a column each model.

    Complete keeps the rows every model has; otherwise those of the first model, 0 where another lacks them.
    """
    wide = preds.groupBy("tweet_id", "user_id", "action").pivot("model", models).agg(F.first("score"))
    return wide.dropna(subset=models) if complete else wide.dropna(subset=models[:1]).fillna(0.0, models)


def check_complete(preds: DataFrame, labels: DataFrame, keys: list[str]) -> None:
    """Raises if a prediction has no label."""
    if not preds.join(labels, keys, "left_anti").isEmpty():
        raise ValueError("predictions without a label")


def labelled(preds: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their labels, joined once and stored; raises if a prediction has none.

    Both sides are shuffled a single time: the check reads what was stored.
    """
    own = stored(preds.join(labels.withColumn("_known", F.lit(True)), keys, "left"), "labelled")
    if not own.filter("_known is null").isEmpty():
        raise ValueError("predictions without a label")
    return own.drop("_known")


def average(preds: DataFrame) -> DataFrame:
    return preds.groupBy("tweet_id", "user_id", "action").agg(F.avg("score").alias("score"))


def features(preds: DataFrame, models: list[str], actions: list[str]) -> DataFrame:
    """All models' scores of all actions as columns ``<model>_<action>``."""
    keyed = preds.withColumn("k", F.concat_ws("_", "model", "action"))
    return keyed.groupBy("tweet_id", "user_id").pivot("k", [f"{m}_{a}" for m in models for a in actions]).agg(F.first("score"))


def fit_linear(wide: DataFrame, models: list[str], label: str = "label"):
    """Logistic regression on the models' logits: a convex fit that Spark distributes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=[f"{m}_logit" for m in models], outputCol="features")
    return Pipeline(stages=[x, LogisticRegression(labelCol=label, maxIter=50)]).fit(with_logits(wide, models))


def with_logits(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.withColumns({f"{m}_logit": logit(F.col(m)) for m in models})


def apply_weights(wide: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """Sigmoid of the weighted logits."""
    z = F.lit(bias)
    for m, w in weights.items():
        z = z + w * logit(F.col(m))
    return wide.withColumn("score", sigmoid(z))


def scale(preds: DataFrame, temperatures: dict[str, float] | None = None, shifts: dict[str, float] | None = None) -> DataFrame:
    """Logits drawn to their action's mean by the temperature, shifted, and back to scores."""
    t, s = temperatures or TEMPERATURES, SHIFTS if shifts is None else shifts
    table = F.create_map(*[F.lit(x) for a in t for x in (a, t[a])])
    shift = F.create_map(*[F.lit(x) for a in t for x in (a, s.get(a, 0.0))])
    z = preds.withColumn("z", logit(F.col("score")))
    means = z.groupBy("action").agg(F.avg("z").alias("mean"))
    out = z.join(means, "action")
    new = (F.col("z") - F.col("mean")) / table[F.col("action")] + F.col("mean") + shift[F.col("action")]
    return out.withColumn("score", sigmoid(new)).drop("z", "mean")


def grid_search(preds: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Relative cross-entropy of every action at every temperature, in one pass over rows x grid."""
    z = preds.withColumn("z", logit(F.col("score")))
    means = z.groupBy("action").agg(F.avg("z").alias("mean"))
    each = z.join(means, "action").withColumn("t", F.explode(F.array(*[F.lit(g) for g in grid])))
    each = each.withColumn("score", sigmoid((F.col("z") - F.col("mean")) / F.col("t") + F.col("mean")))
    each = each.withColumn("key", F.struct("action", "t")).select("key", "label", "score")
    got = relative_cross_entropy(each, "key")
    return got.select("key.action", "key.t", "rce")


def fit_joint(wide: DataFrame, inputs: list[str], labels: list[str], start: dict[str, dict[str, float]], *, steps: int = 50,
              tolerance: float = 1e-8, ridge: float = 1e-9) -> dict[str, dict]:
    """Joint linear blend: every action's logit from all models' logits of all actions, fitted by Newton steps from ``start``.

    ``start`` has weights by action and input (others 0). A step is one pass that adds up gradients and hessians of all actions
    in every task, so the driver gets a row a task and action. Returns by action: weights (with ``bias``), gradient (largest entry over the rows,
    at most ``tolerance``), loss. A step that doesn't lower the loss is halved. ``ridge`` keeps equal inputs apart.
    """
    k = len(inputs) + 1
    x = F.array(*[logit(F.col(c)) for c in inputs], F.lit(1.0))
    rows = stored(wide.select(x.alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y")), "blend")
    w = np.zeros((len(labels), k))
    for i, a in enumerate(labels):
        for j, c in enumerate(inputs):
            w[i, j] = start.get(a, {}).get(c, 0.0)

    def passed(at: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, loss, g, h = 0, np.zeros(len(at)), np.zeros_like(at), np.zeros((len(at), k, k))
            for f in frames:
                if len(f):
                    own, y = np.stack(f["x"].to_numpy()), np.stack(f["y"].to_numpy())
                    z = own @ at.T
                    p = 1 / (1 + np.exp(-z))
                    n, loss = n + len(f), loss + (np.logaddexp(0, z) - y * z).sum(axis=0)
                    g += (p - y).T @ own
                    for i in range(len(at)):
                        h[i] += (own * (p[:, i] * (1 - p[:, i]))[:, None]).T @ own
            if n:
                yield pd.DataFrame({"n": [n], "loss": [loss], "g": [g.ravel()], "h": [h.ravel()]})

        got = rows.mapInPandas(run, "n long, loss array<double>, g array<double>, h array<double>").collect()  # a row a task
        n = sum(r["n"] for r in got)
        total = [np.sum([r[c] for r in got], axis=0) / max(n, 1) for c in ("loss", "g", "h")] if got else [np.zeros(len(at)), np.zeros(at.size), np.zeros(at.size * k)]
        return n, total[0], total[1].reshape(at.shape), total[2].reshape(len(at), k, k)

    n, loss, g, h = passed(w)
    for _ in range(steps):
        off = np.abs(g).max(axis=1) > tolerance
        if not off.any():
            break
        move = np.stack([np.linalg.solve(h[i] + ridge * np.eye(k), g[i]) if off[i] else np.zeros(k) for i in range(len(labels))])
        size = np.ones(len(labels))
        for _ in range(30):
            n, new, g2, h2 = passed(w - size[:, None] * move)
            worse = new > loss + 1e-12
            if not worse.any():
                break
            size[worse] /= 2
        w, loss, g, h = w - size[:, None] * move, new, g2, h2
    return {a: {"weights": dict(zip([*inputs, "bias"], w[i].tolist(), strict=True)), "gradient": float(np.abs(g[i]).max()), "loss": float(loss[i])} for i, a in enumerate(labels)}


def apply_joint(wide: DataFrame, fitted: dict[str, dict]) -> DataFrame:
    """Adds a column ``<action>_score`` each."""
    return wide.withColumns({f"{a}_score": sigmoid(sum((w * logit(F.col(c)) for c, w in f["weights"].items() if c != "bias"), F.lit(f["weights"]["bias"]))) for a, f in fitted.items()})
