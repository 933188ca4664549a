"""Tree models, batch scoring with a caller's function, and feature-group selection."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import transforms


def train_trees(df: DataFrame, cols: list[str], label: str, *, depth: int = 5, rounds: int = 20, rate: float = 0.1, seed: int = 0):
    """Boosted trees on columns: a pipeline model with a ``probability`` column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), trees]).fit(df)


def score(model, df: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """Probability of the positive class."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def importances(model, cols: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance, unused ones 0."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(cols, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def validation_curve(model, df: DataFrame) -> DataFrame:
    """iteration, metric (negative loss) of every boosting round."""
    losses = model.stages[-1].evaluateEachIteration(model.stages[0].transform(df))
    return df.sparkSession.createDataFrame([(i, -x) for i, x in enumerate(losses)], "iteration int, metric double")


def without_groups(groups: dict[str, list[str]], removed: list[str]) -> list[str]:
    """Columns of the feature groups that stay, in order."""
    return [c for g, cols in groups.items() if g not in removed for c in cols]


#: Functions that this Python worker has made, by the token of their frame.
_MADE: dict[str, Callable] = {}


def made(token: str, make: Callable[[], Callable]) -> Callable:
    """What ``make`` returns, made once in a Python worker however many tasks it runs."""
    if token not in _MADE:
        _MADE.clear()  # one model in memory
        _MADE[token] = make()
    return _MADE[token]


#: Cells of a padded array that the caller's function gets at once, about; one row may have more.
CELLS = 1 << 20


def padded_runs(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Places of rows of about one size, shortest first, whose arrays padded to the longest hold at most ``cells`` (or one row)."""
    order, start = np.argsort(sizes, kind="stable"), 0
    for end in range(1, len(order) + 1):
        if end == len(order) or sizes[order[end]] * (end + 1 - start) > cells:
            yield order[start:end]
            start = end


def batch_score(df: DataFrame, keep: list[str], inputs: list[str], outputs: list[str], make: Callable[[], Callable]) -> DataFrame:
    """Scores with a caller's function from (padded arrays, masks) to probabilities.

    ``make`` runs once in each Python worker, which keeps its function for later tasks. Array columns are padded with zeros to
    the longest of the batch, and come with 0/1 masks; scalars come as they are. A batch is a run of rows of about one size
    with at most CELLS cells a column, so one long row doesn't widen thousands of others; scores go back to their rows.
    """
    token = uuid.uuid4().hex
    most = CELLS
    lists = [c for c in inputs if df.schema[c].dataType.typeName() == "array"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidemark.operators import models  # the worker's own module, which outlives the task

        predict = models.made(token, make)
        for b in batches:
            sizes = {c: b[c].map(len).to_numpy("i8") for c in lists}
            longest = np.maximum.reduce([*sizes.values(), np.ones(len(b), "i8")])
            got = np.zeros((len(b), len(outputs)))
            for at in models.padded_runs(longest, most):
                arrays, masks = {}, {}
                for c in inputs:
                    own = b[c].to_numpy()[at]
                    if c in sizes:
                        size = sizes[c][at]
                        masks[c] = np.arange(size.max())[None, :] < size[:, None]
                        arrays[c] = np.zeros(masks[c].shape)
                        arrays[c][masks[c]] = np.concatenate([np.asarray(v, "f8") for v in own])
                    else:
                        arrays[c] = own
                got[at] = np.asarray(predict(arrays, masks)).reshape(len(at), len(outputs))
            yield b[keep].assign(**{o: got[:, i] for i, o in enumerate(outputs)})

    kept = df.select(*keep).schema
    schema = T.StructType([*kept.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, schema)


def validate(scored: dict[str, DataFrame], path: str) -> DataFrame:
    """Scores of a validation set, by action: writes them as files of predictions, reads them back and evaluates them.

    ``scored`` has tweet_id, user_id, label, score per action. Returns action, pr_auc, rce, with their means as ``mean``.
    """
    from functools import reduce

    from tidemark.operators import metrics
    from tidemark.operators.order import stored
    from tidemark.sources import readers, writers

    rows = stored(reduce(DataFrame.unionByName, [df.select(F.lit(a).alias("action"), "tweet_id", "user_id", "label", "score") for a, df in scored.items()]), "valid")
    writers.write_predictions(rows, path)
    back = [readers.read_predictions(rows.sparkSession, f"{path}/action={a}").withColumn("action", F.lit(a)) for a in scored]
    own = rows.select("action", F.col("tweet_id").cast("string").alias("tweet_id"), F.col("user_id").cast("string").alias("user_id"), "label").distinct()
    return metrics.report(reduce(DataFrame.unionByName, back).join(own, ["action", "tweet_id", "user_id"]))


class ColumnScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over long-form nonzeros: fits one of the transforms of this package by name (param ``kind``) with its settings
    (param ``settings``, JSON)."""

    kind = Param(Params._dummy(), "kind", "name of a transform", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "its settings as JSON", TypeConverters.toString)

    def __init__(self, kind: str | None = None, **settings):
        super().__init__()
        self._setDefault(kind="standardise", settings="{}")
        if kind is not None:
            self._set(kind=kind, settings=json.dumps(settings))

    def _fit(self, dataset: DataFrame) -> ColumnScalerModel:
        fitted = getattr(transforms, self.getOrDefault("kind"))(dataset, **json.loads(self.getOrDefault("settings")))
        return self._copyValues(ColumnScalerModel(fitted))


class ColumnScalerModel(Model, MLWritable, MLReadable):
    """A fitted transform; its parameters are a table and are saved as one."""

    kind, settings = ColumnScaler.kind, ColumnScaler.settings

    def __init__(self, fitted: transforms.Fitted | None = None):
        super().__init__()
        self._setDefault(kind="standardise", settings="{}")
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.apply(dataset)

    def write(self) -> MLWriter:
        return _ScalerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ScalerReader()


class _ScalerWriter(MLWriter):
    def __init__(self, model: ColumnScalerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.params.write.parquet(f"{path}/parameters")


class _ScalerReader(MLReader):
    def load(self, path: str) -> ColumnScalerModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ColumnScalerModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        # the expressions follow from the name and settings alone; only the parameters come from the table
        empty = self.sparkSession.createDataFrame([], "row long, col long, value double")
        fitted = getattr(transforms, model.getOrDefault("kind"))(empty, **json.loads(model.getOrDefault("settings")))
        model.fitted = transforms.Fitted(self.sparkSession.read.parquet(f"{path}/parameters"), fitted.value, fitted.drop)
        return model


class TextTransform(Transformer, HasInputCol, HasOutputCol):
    """Transformer that applies a caller's column function, for example one of the text functions."""

    def __init__(self, function: Callable, inputCol: str, outputCol: str):
        super().__init__()
        self.function = function
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.function(F.col(self.getInputCol())))
