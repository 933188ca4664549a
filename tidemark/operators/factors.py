"""Low-rank factors of a sparse matrix in long form, by a randomised range finder.

Tall blocks are frames (index, vec) with arrays of a few dozen numbers. A product with the matrix is an equi-join with the
block and sums with map-side combine; a block is made orthogonal by a tall-skinny QR: every task reduces its rows to one
small triangle, triangles are reduced again, and rows are multiplied by the inverse of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import small, stored
from tidemark.operators.splits import uniform

#: Columns beyond the rank asked for, power steps, and tasks of the second round of triangles.
MORE, STEPS, FAN_IN = 10, 4, 16


def multiply(m: DataFrame, block: DataFrame, width: int, *, by: str, out: str) -> DataFrame:
    """Matrix (row, col, value) times block: sums of the block's rows at ``by`` for every ``out``."""
    rows = m.join(small(block.withColumnRenamed("index", by)), by)
    sums = [F.sum(F.col("value") * F.get("vec", F.lit(j))).alias(f"_{j}") for j in range(width)]
    return rows.groupBy(F.col(out).alias("index")).agg(*sums).select("index", F.array(*[f"_{j}" for j in range(width)]).alias("vec"))


def triangle(block: DataFrame, width: int) -> np.ndarray:
    """R of the QR of all rows. A task passes on ``width`` rows whatever it reads; FAN_IN tasks reduce those again, and the
    driver gets one triangle of each."""

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for f in frames:
            if len(f):
                r = np.linalg.qr(np.vstack([r, np.stack(f["vec"].to_numpy())]), mode="r")
        if len(r):
            yield pd.DataFrame({"vec": list(r)})

    got = block.select("vec").mapInPandas(reduce, "vec array<double>")
    got = got.repartition(FAN_IN).mapInPandas(reduce, "vec array<double>")
    rows = [np.array(x["vec"]) for x in got.collect()]  # width rows a task
    return np.linalg.qr(np.stack(rows), mode="r") if rows else np.zeros((0, width))


def times(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every row of a block times a small matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"index": f["index"].to_numpy(), "vec": list(np.stack(f["vec"].to_numpy()) @ matrix)})

    return block.mapInPandas(run, "index long, vec array<double>")


def orthogonal(block: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """Q (a stored block) and R; directions without weight become 0."""
    block = stored(block, "block")
    r = triangle(block, width)
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    keep = s > 1e-12 * max(s.max(initial=0.0), 1e-300)
    turn = vt.T[:, keep] / s[keep]  # block @ turn has orthonormal columns
    q = stored(times(block, np.pad(turn, ((0, 0), (0, width - turn.shape[1])))), "block")
    return q, np.pad(turn, ((0, 0), (0, width - turn.shape[1])))


def low_rank(m: DataFrame, k: int, *, more: int = MORE, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The k largest singular values of (row, col, value) with non-null whole numbers as rows and columns, and both sides'
    factors (index, vec): left ones orthonormal, right ones too.

    ``steps`` power steps sharpen the range; with ``k + more`` at or above the rank the result is exact. An empty matrix has
    no values.
    """
    width = k + more
    m = stored(m.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), "matrix")
    normal = [F.sqrt(-2 * F.log(uniform("index", F.lit(j), seed=seed))) * F.cos(2 * F.pi() * uniform("index", F.lit(j), seed=seed + 1)) for j in range(width)]
    start = stored(m.select(F.col("col").alias("index")).distinct().select("index", F.array(*normal).alias("vec")), "block")
    q, _ = orthogonal(multiply(m, start, width, by="col", out="row"), width)
    for _ in range(steps):
        z, _ = orthogonal(multiply(m, q, width, by="row", out="col"), width)
        q, _ = orthogonal(multiply(m, z, width, by="col", out="row"), width)
    back = stored(multiply(m, q, width, by="row", out="col"), "block")  # transposed: the matrix in the range's coordinates
    r = triangle(back, width)
    if not len(r):
        return np.zeros(0), q, back
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    s, v = s[:k], vt[:k].T
    right = times(back, v / np.where(s > 0, s, 1.0))
    return s, times(q, v), right
