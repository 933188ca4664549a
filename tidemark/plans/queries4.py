"""Queries of window histories, incremental ids, fitted models and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blend, ids, increments, models, similarity, splits, transforms, trees, windows
from tidemark.operators.impressions import ACTIONS, HOUR, contents
from tidemark.operators.order import shared_folder, small, stored
from tidemark.plans.queries import _ANY, _CON, _NEG, _WHIT, BASE, history_features, item_tokens, r, stored_log
from tidemark.plans.queries2 import keyed, matrix, vectors
from tidemark.sources import readers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


_W5 = BASE + f""", w AS (SELECT CAST(range AS INT) AS chunk, cut - (range + 1) * 86400 AS s, cut - range * 86400 AS e, cut, t0 FROM lim, range(5)),
x AS (SELECT chunk, t0, imp.*, CASE WHEN {_NEG} THEN CASE WHEN tweet_ts > cut THEN 'valid' WHEN tweet_ts > s AND tweet_ts < e THEN 'train' END WHEN {_ANY} > cut THEN 'valid' WHEN {_WHIT} THEN 'train' END AS split FROM imp, w),
h AS (SELECT * FROM x WHERE split IS NULL), tg AS (SELECT chunk, engage_index, user_id, creator_id, split FROM x WHERE split = 'train' OR (split = 'valid' AND chunk = 0))"""


def _side(p: str, keys: str) -> str:
    each = ", ".join(f"count({a}_ts) AS {p}_{a}_n, (max({a}_ts) - any_value(t0)) / 3600.0 AS {p}_{a}_last" for a in ACTIONS)
    return f"{p} AS (SELECT chunk, {keys}, count(*) AS {p}_total, count(coalesce(reply_ts, retweet_ts, comment_ts, like_ts)) AS {p}_pos, {each} FROM h GROUP BY ALL)"


def _out(p: str) -> str:
    each = ", ".join(
        f"coalesce({p}_{a}_n, 0) AS {p}_{a}_n, round(coalesce({p}_{a}_last, 0), 6) AS {p}_{a}_last, round(coalesce({p}_{a}_n * 1.0 / {p}_total, 0), 6) AS {p}_{a}_norm" for a in ACTIONS
    )
    return f"coalesce({p}_total, 0) AS {p}_total, coalesce({p}_pos, 0) AS {p}_pos, {each}"


@query("window_features", f"""{_W5}, {_side('u', 'user_id')}, {_side('c', 'creator_id')}, {_side('b', 'user_id, creator_id')}
SELECT tg.chunk, engage_index, split, {_out('u')}, {_out('c')}, {_out('b')} FROM tg LEFT JOIN u ON u.chunk = tg.chunk AND u.user_id = tg.user_id
 LEFT JOIN c ON c.chunk = tg.chunk AND c.creator_id = tg.creator_id LEFT JOIN b ON b.chunk = tg.chunk AND b.user_id = tg.user_id AND b.creator_id = tg.creator_id""")
def window_features(spark, d):
    """Every window's rows with the history that window may see, for five windows from one pass over the log."""
    log, t0, cut = stored_log(spark, d)
    out = windows.window_features(windows.with_mask(log, cutoff=cut), start=t0, unit=float(HOUR))
    names = {c: c.replace("with_", "b_", 1) for c in out.columns if c.startswith("with_")}
    cols = [c for c in out.columns if c[:2] in ("u_", "c_") or c in names]
    own = [(r(F.col(c)) if c.endswith(("_last", "_norm")) else F.col(c)).alias(names.get(c, c)) for c in cols]
    return out.select("chunk", "engage_index", "split", *own)


@query("unseen_ids", BASE + """SELECT tweet_id, chunk, min(engage_index) AS engage_index, 0 AS again FROM (SELECT tweet_id, engage_index, CAST(engage_index % 3 AS INT) AS chunk, min(engage_index % 3) OVER (PARTITION BY tweet_id) AS first FROM imp) WHERE chunk = first GROUP BY ALL""")
def unseen_ids(spark, d):
    """Items that no earlier one of three chunks showed, with the first row of each; the second chunk runs twice.

    ``again`` is 1 for rows that only one of the two runs gave.
    """
    log, _, _ = stored_log(spark, d)
    rows = log.select("tweet_id", "engage_index", (F.col("engage_index") % 3).cast("int").alias("chunk"))
    state = increments.SeenIds(spark, shared_folder(spark, "seen"), "tweet_id")
    runs, out = {}, None
    for chunk in (0, 1, 1, 2):
        new = state.add(rows.filter(F.col("chunk") == chunk).select("tweet_id", "engage_index"), chunk)
        # stored, as a rerun writes the state anew
        runs[chunk] = [*runs.get(chunk, []), stored(new.withColumn("chunk", F.lit(chunk)))]
    for own in runs.values():
        both = own[0] if len(own) == 1 else own[0].unionByName(own[1])
        part = both.groupBy("tweet_id", "chunk", "engage_index").agg((F.count("*") != len(own)).cast("int").alias("again"))
        out = part if out is None else out.unionByName(part)
    return out


@query("stream_unseen", BASE + "SELECT tweet_id, count(*) AS n FROM (SELECT DISTINCT tweet_id FROM imp) GROUP BY tweet_id")
def stream_unseen(spark, d):
    """New items of a stream in two runs: the second one starts from the first one's state, on more files."""
    log, _, _ = stored_log(spark, d)
    rows = log.select("tweet_id", "engage_index")
    src, sink, state = (shared_folder(spark, n) for n in ("stream", "sink", "state"))
    for part in (0, 1):
        rows.filter(F.col("engage_index") % 2 == part).write.mode("append").parquet(src)
        increments.stream_unseen(spark, src, rows.schema, "tweet_id", sink, state).awaitTermination()
    return spark.read.parquet(sink).groupBy("tweet_id").agg(F.count("*").alias("n"))


@query("window_languages", BASE + _CON + """, a AS (SELECT user_id, lang, (cut - t) // 86400 AS day FROM imp JOIN con USING (tweet_id), lim WHERE t <= cut)
SELECT user_id, CAST(days AS INT) AS days, count(DISTINCT lang) AS languages FROM a, (VALUES (1), (2), (4), (7)) w(days) WHERE day < days GROUP BY ALL""")
def window_languages(spark, d):
    """Languages that each user saw in the last 1, 2, 4 and 7 days before the cut-off, from stored sketches of days."""
    log, _, cut = stored_log(spark, d)
    rows = log.join(contents(spark, d).select("tweet_id", "language"), "tweet_id")
    days = stored(windows.day_sketches(rows, "user_id", "language", cutoff=cut), "sketches")
    return windows.trailing_distinct(days, "user_id", [1, 2, 4, 7]).withColumnRenamed("distinct", "languages")


@query("vector_arithmetic", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, v, list_transform(v, lambda x: x * 2) AS w, list_reverse(v) AS u FROM e)
SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda p: p[1] + p[2])), 4) + 0.0 AS added, round(list_min(list_transform(list_zip(v, u), lambda p: p[1] - p[2])), 4) + 0.0 AS least, round(list_max(list_transform(list_zip(w, u), lambda p: greatest(p[1], p[2]))), 4) + 0.0 AS most,
 round(list_sum(list_transform(list_zip(v, u), lambda p: least(p[1], p[2]) / 4)), 4) + 0.0 AS quarter FROM x""")
def vector_arithmetic(spark, d):
    """Each vector and its reverse: sum of sums, least difference, largest of the doubled one and the reverse, a quarter of the smaller ones."""
    v = vectors(spark, d).select(F.col("id").alias("vec_id"), F.transform("vec", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("u", F.reverse("v"))
    a, u = F.col("v"), F.col("u")
    return v.select(
        "vec_id", (r(similarity.extremes(similarity.combine(a, u, "add"))["sum"], 4) + 0.0).alias("added"),
        (r(similarity.extremes(similarity.combine(a, u, "subtract"))["min"], 4) + 0.0).alias("least"),
        (r(similarity.extremes(similarity.combine(similarity.scaled(a, 2), u, "max"))["max"], 4) + 0.0).alias("most"),
        (r(similarity.extremes(similarity.scaled(similarity.combine(a, u, "min"), 4, divide=True))["sum"], 4) + 0.0).alias("quarter"),
    )


_COLS = ["user_total", "user_pos", "user_ratio", *[f"with_{a}_n" for a in ACTIONS], *[f"c_{a}_n" for a in ACTIONS]]


@query("boosted_trees")
def boosted_trees(spark, d):
    """Second-order boosted trees on history features, scored on the validation rows."""
    rows = stored(history_features(spark, d))
    model = trees.fit(rows.filter("split = 'train'"), _COLS, "like_label", depth=3, rounds=4, rate=0.3)
    return model.score(rows.filter("split = 'valid'"), ["engage_index", "like_label"])


@query("stacked_trees")
def stacked_trees(spark, d):
    """A second model on the first one's out-of-fold scores: train rows scored by trees that never saw them, folds by a portable
    hash; the stack is fitted on those and applied to validation rows."""
    rows = stored(history_features(spark, d).withColumn("fold", F.conv(F.substring(splits.portable(F.col("engage_index"), 5), 1, 8), 16, 10).cast("long") % 3))
    train, valid = rows.filter("split = 'train'"), rows.filter("split = 'valid'")
    settings = {"depth": 2, "rounds": 2, "rate": 0.3}
    keep = ["engage_index", "like_label", "fold", "split", "user_ratio"]
    first = stored(trees.out_of_fold(train, _COLS, "like_label", "fold", 3, keep, "first", **settings))
    whole = trees.fit(train, _COLS, "like_label", **settings).score(valid, keep, "first")
    second = trees.fit(first, ["first", "user_ratio"], "like_label", **settings)
    return second.score(whole, ["engage_index", "like_label", "first"])


@query("validate_trees")
def validate_trees(spark, d):
    """Trees of two actions scored on the validation rows, written, read back and evaluated."""
    rows = stored(history_features(spark, d))
    scored = {}
    for a in ("reply", "like"):
        model = trees.fit(rows.filter("split = 'train'"), _COLS, f"{a}_label", depth=2, rounds=2, rate=0.3)
        out = model.score(rows.filter("split = 'valid'"), ["engage_index", "user_id", f"{a}_label"])
        scored[a] = out.withColumnsRenamed({"engage_index": "tweet_id", f"{a}_label": "label"})
    return models.validate(scored, shared_folder(spark))


@query("joint_blend")
def joint_blend(spark, d):
    """All models' scores of all actions blended jointly to four actions: fitted on 40% of the rows, applied to the others."""
    m, rows = ["m0", "m1", "m2"], stored(keyed(spark, d))
    wide = blend.features(rows, m, ACTIONS)
    truth = rows.filter("model = 'm0'").groupBy("tweet_id").pivot("action", ACTIONS).agg(F.first("label"))
    wide = stored(splits.holdout(wide.join(truth.toDF("tweet_id", *[f"{a}_label" for a in ACTIONS]), "tweet_id"), "tweet_id"))
    start = {f"{a}_label": {f"{x}_{a}": 1 / len(m) for x in m} for a in ACTIONS}
    fitted = blend.fit_joint(wide.filter("eval"), [f"{x}_{a}" for x in m for a in ACTIONS], [f"{a}_label" for a in ACTIONS], start)
    out = blend.apply_joint(wide.filter("not eval"), fitted)
    return out.select("tweet_id", "user_id", *[f"{a}_label_score" for a in ACTIONS])


@query("power_optimum")
def power_optimum(spark, d):
    """The likeliest power of every column, searched for together."""
    m = matrix(spark, d).withColumn("value", F.col("value") / 10000)
    return transforms.optimal_yeo_johnson(m).params.select("col", r(F.col("lam")).alias("lam"))


@query("text_indexes", """SELECT CAST(doc_id AS VARCHAR) AS tweet_id, row_number() OVER (ORDER BY doc_id) - 1 AS tweet_index FROM documents""")
def text_indexes(spark, d):
    """Positions of items written as CSV with a header and read as typed columns."""
    from tidemark.operators.order import global_index

    p = shared_folder(spark)
    rows = global_index(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id", name="at")
    rows.select(F.concat(F.lit(" "), "doc_id").alias("Item"), "at").write.option("header", True).csv(p)
    return readers.read_columns(spark, p, {"Item": "string", "at": "long"}).select(F.col("Item").alias("tweet_id"), F.col("at").alias("tweet_index"))


@query("text_pipeline", """SELECT doc_id AS tweet_id, length(text) AS size, upper(lang) AS name FROM documents""")
def text_pipeline(spark, d):
    """Column functions as stages of a pipeline."""
    from pyspark.ml import Pipeline

    stages = [models.TextTransform(lambda c: F.length(c).cast("long"), "text", "size"), models.TextTransform(F.upper, "language", "name")]
    c = contents(spark, d)
    return Pipeline(stages=stages).fit(c).transform(c).select("tweet_id", "size", "name")


@query("saved_scaler", """WITH m0 AS (SELECT user_id AS "row", CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS col, round(value * 100) AS value FROM events), m AS (SELECT "row", col, sum(value) AS value FROM m0 GROUP BY ALL HAVING sum(value) <> 0),
f AS (SELECT col, avg(value) AS mean, stddev_pop(value) AS std FROM m WHERE "row" % 2 = 0 GROUP BY col) SELECT "row", col, round(least(greatest((value - mean) / std, -2), 2), 6) AS value FROM m JOIN f USING (col) WHERE "row" % 2 = 1 AND std > 0 AND abs(value - mean) >= 1e-5""")
def saved_scaler(spark, d):
    """A pipeline with a fitted scaler saved, loaded and applied."""
    from pyspark.ml import Pipeline, PipelineModel

    m, p = stored(matrix(spark, d)), shared_folder(spark)
    train = m.filter("row % 2 = 0")
    Pipeline(stages=[models.ColumnScaler("standardise", clip=2.0)]).fit(train).save(p)
    known = train.groupBy("col").agg(F.stddev_pop("value").alias("s")).filter("s > 0").select("col")
    out = PipelineModel.load(p).transform(m.filter("row % 2 = 1")).join(known, "col", "left_semi")
    return out.select("row", "col", r(F.col("value")).alias("value"))


@query("token_tfidf", """WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS category FROM documents), nz AS (SELECT doc_id, category, count(*) AS n FROM tok GROUP BY ALL),
f AS (SELECT category, count(*) AS df FROM nz GROUP BY category HAVING count(*) > 20), k AS (SELECT category, df, row_number() OVER (ORDER BY category) - 1 AS cat FROM f)
SELECT doc_id AS "row", cat AS col, round(ln(1 + n) * ln((SELECT count(*) FROM documents) * 1.0 / df), 6) AS value FROM nz JOIN k USING (category)""")
def token_tfidf(spark, d):
    """Weights of the tokens of more than 20 items, by their uses and their items."""
    c = item_tokens(spark, d)
    m = ids.encode_frequent(c, "tweet_id", "tokens", 20).select(F.col("tweet_id").alias("row"), F.col("cat").alias("col"), "value")
    m = stored(m)
    fitted = transforms.tf_idf(m, spark.read.parquet(f"{d}/documents.parquet").count())
    fitted.params = small(stored(fitted.params))  # a row a token, so the weights join without shuffling the counts
    return fitted.apply(m).withColumn("value", r(F.col("value")))
