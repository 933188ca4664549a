"""Trees, blends, powers, sketches and savable models against small numpy versions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemark.operators import blend, ids, models, similarity, transforms, trees, windows


def small_tree(x, g, h, depth, rate, penalty, least):
    """One tree by the definition: arrays of columns, bins and values in level order, and the value of each row."""
    n = 2 ** (depth + 1) - 1
    column, cut, value = [-1] * n, [0] * n, [0.0] * n
    at = np.zeros(len(x), int)
    value[0] = -rate * g.sum() / (h.sum() + penalty)
    for node in range(2**depth - 1):
        own = at == node
        if not own.any():
            continue
        best = (0.0, 0, 0)
        gt, ht = g[own].sum(), h[own].sum()
        for c in range(x.shape[1]):
            for b in np.unique(x[own, c]):
                left = own & (x[:, c] <= b)
                gl, hl = g[left].sum(), h[left].sum()
                if hl < least or ht - hl < least:
                    continue
                gain = round((gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)) / 2, 9)
                best = max(best, (gain, -c, -b))
        if best[0] > 0:
            c, b = -best[1], -best[2]
            column[node], cut[node] = c, int(b)
            right = own & (x[:, c] > b)
            at[own] = 2 * node + 1
            at[right] = 2 * node + 2
            for child in (2 * node + 1, 2 * node + 2):
                value[child] = -rate * g[at == child].sum() / (h[at == child].sum() + penalty)
    return column, cut, value, np.array(value)[at]


def test_trees_equal_a_small_version(spark):
    rng = np.random.default_rng(1)
    n, cols = 500, ["a", "b", "c"]
    raw = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(2), rng.integers(0, 3, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(raw[:, 0] - 6) * (raw[:, 2] - 1)))).astype(int)
    data = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(raw, y, strict=True))]
    df = spark.createDataFrame([*data, (n, 1.0, 1.0, 1.0, None)], "i int, a double, b double, c double, y int")
    model = trees.fit(df, cols, "y", depth=3, rounds=10, rate=0.3, penalty=2.0, bins=16)  # rounds beyond one write of margins
    x = np.column_stack([[np.sum(np.array(e) < v) for v in raw[:, c]] for c, e in enumerate(model.edges)])
    margin = np.zeros(n)
    for t in model.trees:
        p = 1 / (1 + np.exp(-margin))
        column, cut, value, leaf = small_tree(x, p - y, p * (1 - p), 3, 0.3, 2.0, 1.0)
        assert t.column == column
        assert [b for b, c in zip(t.bin, t.column, strict=True) if c >= 0] == [b for b, c in zip(cut, column, strict=True) if c >= 0]
        assert np.allclose(t.value, value, atol=1e-9)
        margin += leaf
    got = {r["i"]: r["s"] for r in model.score(df, ["i"], "s").collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-m))) < 1e-9 for i, m in enumerate(margin))
    assert model.importances()[0][1] > 0 and {c for c, _ in model.importances()} == set(cols)


def test_trees_of_odd_tables_and_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (2, 5.0, 0), (3, 5.0, 1), (4, float("nan"), 0)] * 8, "i int, a double, y int")
    model = trees.fit(df, ["a"], "y", depth=2, rounds=2)
    assert model.score(df, ["i"]).count() == 32
    model.save(spark, f"file://{tmp_path}/m")
    back = trees.Trees.load(spark, f"file://{tmp_path}/m")
    assert back == model
    none = trees.fit(df.limit(0), ["a"], "y", depth=2, rounds=1)
    assert {r["score"] for r in none.score(df, ["i"]).collect()} == {0.5}
    penalised = trees.fit(df, ["a"], "y", depth=2, rounds=1, penalty=1e9)
    assert all(abs(r["score"] - 0.5) < 1e-6 for r in penalised.score(df, ["i"]).collect())


def test_no_row_is_scored_by_trees_that_saw_it(spark):
    """Labels are random within a fold and told by the fold's number: trees of other folds can't know them."""
    rows = [(i, i % 3, float(i % 3), int(i % 3 == 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, fold int, x double, y int")
    got = {r["i"]: r["score"] for r in trees.out_of_fold(df, ["x"], "y", "fold", 3, ["i"], depth=1, rounds=5, rate=0.5).collect()}
    assert len(got) == 300
    assert all(got[i] < 0.5 for i, f, _, y in rows if y == 1)  # seen, they would be near 1
    whole = trees.fit(df, ["x"], "y", depth=2, rounds=5, rate=0.5)
    assert all(r["score"] > 0.5 for r in whole.score(df.filter("y = 1"), ["i"]).collect())


def test_joint_blend_ends_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    labels = (rng.random((400, 2)) < 1 / (1 + np.exp(-x @ rng.normal(size=(4, 2))))).astype(int)
    cols = ["m0_a", "m1_a", "m0_b", "m1_b"]
    rows = [(*map(float, 1 / (1 + np.exp(-r))), *map(int, y)) for r, y in zip(x, labels, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", a int, b int")
    got = blend.fit_joint(df, cols, ["a", "b"], {"a": {"m0_a": 0.5, "m1_a": 0.5}, "b": {"m0_b": 0.5, "m1_b": 0.5}})
    own = np.column_stack([x, np.ones(400)])
    for k, a in enumerate(("a", "b")):
        w = np.array([got[a]["weights"][c] for c in [*cols, "bias"]])
        p = 1 / (1 + np.exp(-own @ w))
        assert np.abs(own.T @ (p - labels[:, k]) / 400).max() < 1e-6 and got[a]["gradient"] <= 1e-8
        loss = -np.mean(labels[:, k] * np.log(p) + (1 - labels[:, k]) * np.log(1 - p))
        assert abs(got[a]["loss"] - loss) < 1e-6
        for j in range(5):  # a minimum
            for d in (-0.01, 0.01):
                q = 1 / (1 + np.exp(-own @ (w + d * np.eye(5)[j])))
                assert -np.mean(labels[:, k] * np.log(q) + (1 - labels[:, k]) * np.log(1 - q)) > loss
    out = blend.apply_joint(df, got).first()
    assert 0 < out["a_score"] < 1 and 0 < out["b_score"] < 1


def likelihood(v, lam):
    up = (np.power(v + 1, lam) - 1) / lam if abs(lam) > 1e-12 else np.log1p(v)
    down = -(np.power(1 - np.minimum(v, 0), 2 - lam) - 1) / (2 - lam) if abs(lam - 2) > 1e-12 else -np.log1p(-np.minimum(v, 0))
    y = np.where(v >= 0, np.nan_to_num(up), down)
    return -len(v) / 2 * np.log(y.var()) + (lam - 1) * np.sum(np.sign(v) * np.log1p(np.abs(v)))


def test_powers_equal_a_search_of_one_column(spark):
    rng = np.random.default_rng(4)
    cols = [rng.lognormal(0, 1, 300), rng.normal(1, 2, 200), -rng.gamma(2, 1, 150), rng.exponential(3, 250) ** 2]
    rows = [(i, c, float(v)) for c, own in enumerate(cols) for i, v in enumerate(own)] + [(0, 9, 4.0), (1, 9, 4.0)]
    fit = transforms.optimal_yeo_johnson(spark.createDataFrame(rows, "row int, col int, value double"))
    got = {r["col"]: r["lam"] for r in fit.params.collect()}
    with np.errstate(all="ignore"):
        for c, own in enumerate(cols):
            lo, hi, g = -5.0, 5.0, (5**0.5 - 1) / 2
            for _ in range(80):
                a, b = hi - g * (hi - lo), lo + g * (hi - lo)
                lo, hi = (lo, b) if likelihood(own, a) > likelihood(own, b) else (a, hi)
            assert abs(got[c] - (lo + hi) / 2) < 1e-5
            assert likelihood(own, got[c]) >= likelihood(own, (lo + hi) / 2) - 1e-9
    assert math.isfinite(got[9])


def test_sketches_of_days_add_up_to_windows(spark):
    rnd = random.Random(6)
    rows = [(u, rnd.randrange(10 * 86400), rnd.randrange(3000 if u else 5)) for u in range(3) for _ in range(4000)] + [(1, 5, None), (1, 11 * 86400, 7)]
    df = spark.createDataFrame(rows, "user_id int, t long, value int")
    cut = 10 * 86400
    got = windows.trailing_distinct(windows.day_sketches(df, "user_id", "value", cutoff=cut), "user_id", [1, 3, 10]).collect()
    assert len(got) == 9
    for r in got:
        want = len({v for u, t, v in rows if u == r["user_id"] and v is not None and t <= cut and (cut - t) // 86400 < r["days"]})
        assert abs(r["distinct"] - want) <= max(0, 0.05 * want if want > 100 else 0)


def test_pipelines_with_scalers_are_saved_and_loaded(spark, tmp_path):
    m = spark.createDataFrame([(i, c, float(i * c + i % 3 + 1)) for i in range(12) for c in range(4)], "row long, col long, value double")
    for kind, settings in (("standardise", {"clip": 1.0}), ("min_max", {}), ("tf_idf", {"rows": 12}), ("column_norm", {"p": 1}), ("outlier_clip", {"share": 0.2})):
        fitted = Pipeline(stages=[models.ColumnScaler(kind, **settings)]).fit(m)
        path = f"file://{tmp_path}/{kind}"
        fitted.save(path)
        back = PipelineModel.load(path)
        assert back.stages[0].uid == fitted.stages[0].uid and back.stages[0].getOrDefault("kind") == kind
        assert sorted(map(tuple, back.transform(m).collect())) == sorted(map(tuple, fitted.transform(m).collect()))
    unfitted = Pipeline(stages=[models.ColumnScaler("tf_idf", rows=3)])
    unfitted.save(f"file://{tmp_path}/unfitted")
    assert Pipeline.load(f"file://{tmp_path}/unfitted").getStages()[0].getOrDefault("settings") == '{"rows": 3}'


def test_a_worker_makes_its_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda arrays, masks: arrays["x"]

    df = spark.range(200).select("id", F.col("id").cast("double").alias("x")).repartition(20)
    out = models.batch_score(df, ["id"], ["x"], ["y"], make)
    for _ in range(2):
        assert out.filter("id = y").count() == 200
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 8


@pytest.mark.parametrize(("how", "want"), [("add", [5.0, -1.0]), ("subtract", [-3.0, 5.0]), ("multiply", [4.0, -6.0]), ("min", [1.0, -3.0]), ("max", [4.0, 2.0])])
def test_vector_arithmetic(spark, how, want):
    df = spark.createDataFrame([([1, 2], [4, -3])], "a array<int>, b array<int>")
    assert df.select(similarity.combine(F.col("a"), F.col("b"), how).alias("x")).first()["x"] == want
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 5, 3.0)], "row int, col int, value double")
    b = spark.createDataFrame([(0, 0, 4.0), (0, 1, -3.0), (2, 5, -7.0)], "row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in similarity.combine_sparse(a, b, how).collect()}
    rest = {"add": {(1, 5): 3.0, (2, 5): -7.0}, "subtract": {(1, 5): 3.0, (2, 5): 7.0}, "multiply": {}, "min": {(2, 5): -7.0}, "max": {(1, 5): 3.0}}
    assert got == {(0, 0): want[0], (0, 1): want[1]} | rest[how]


def test_scaling_and_extremes(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([],), (None,)], "a array<double>")
    got = df.select(similarity.scaled(F.col("a"), 3).alias("s"), similarity.scaled(F.col("a"), 0, divide=True).alias("z"), similarity.extremes(F.col("a")).alias("e")).collect()
    assert got[0]["s"] == [3.0, -6.0] and got[0]["z"] == [None, None] and tuple(got[0]["e"]) == (-1.0, -2.0, 1.0)
    assert tuple(got[1]["e"]) == (0.0, None, None) and got[2]["s"] is None


def test_names_of_languages(spark):
    codes = ["D3164C7FBCF2565DDF915B1B3AEFB1DC", "48236EC80FDDDFADE99420ABC9210DDF", "de", "nope", None]
    got = [r["n"] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(ids.language_name(F.col("c")).alias("n")).collect()]
    assert got == ["english", "swahili", "german", "other", "other"]
    assert sum(len(k) == 32 for k in ids.LANGUAGES) == 25


def test_one_long_row_does_not_pad_the_others(spark):
    def make():
        def predict(arrays, masks):
            assert arrays["x"].size <= models.CELLS  # all 3001 rows at once would be 60 million cells
            return (arrays["x"] * masks["x"]).sum(axis=1) + arrays["id"]

        return predict

    n = F.when(F.col("id") == 1700, 20_000).otherwise(F.col("id") % 5)
    df = spark.range(3001).select("id", F.array_repeat(F.lit(2), n.cast("int")).alias("x")).coalesce(1)
    got = models.batch_score(df, ["id"], ["x", "id"], ["y"], make).collect()
    assert [(r["id"], r["y"]) for r in got] == [(i, i + 2.0 * (20_000 if i == 1700 else i % 5)) for i in range(3001)]
