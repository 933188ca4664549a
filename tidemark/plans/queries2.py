"""More queries over the driver's tables: matrices, similarity, embeddings, transforms, metrics, files, models, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blend, embeddings, factors, ids, metrics, models, similarity, splits, transforms
from tidemark.operators.impressions import ACTIONS, contents, from_events, labels, unpivot_actions
from tidemark.operators.history import interactions
from tidemark.operators.order import shared_folder as folder
from tidemark.operators.order import stored
from tidemark.plans.queries import _CON, BASE, parts, r
from tidemark.sources import readers, writers
from tidemark.streaming.apply import apply_stream

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def matrix(spark, d):
    """(row, col, value): value of events by user and item, whole cents."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("row"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("col"), F.round(F.col("value") * 100).alias("value")).groupBy("row", "col").agg(
        F.sum("value").alias("value")).filter("value <> 0")


_M = """m0 AS (SELECT user_id AS "row", CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS col, round(value * 100) AS value FROM events),
m AS (SELECT "row", col, sum(value) AS value FROM m0 GROUP BY ALL HAVING sum(value) <> 0)"""
MAT = f"WITH {_M}"


@query("matrix_sums", MAT + """ SELECT col, sum(value) AS total, count(*) AS nnz, round(sum(abs(value)), 4) AS l1, round(sqrt(sum(value * value)), 4) AS l2, max("row") + 1 AS height,
 round(sum(value) / (SELECT count(DISTINCT "row") FROM m), 4) AS mean FROM m GROUP BY col""")
def matrix_sums(spark, d):
    """Sums, nonzeros, norms and means of columns."""
    m = matrix(spark, d)
    out = m.groupBy("col").agg(F.sum("value").alias("total"), F.count("*").alias("nnz"), (F.max("row") + 1).alias("height"))
    out = out.join(transforms.lp_norm(m, "col", 1).select("col", r(F.col("norm"), 4).alias("l1")), "col")
    out = out.join(transforms.lp_norm(m, "col", 2).select("col", r(F.col("norm"), 4).alias("l2")), "col")
    return out.join(transforms.vectors_mean(m, m.select("row").distinct().count()).select("col", r(F.col("value"), 4).alias("mean")), "col")


@query("matrix_product", MAT + """ SELECT a.col AS "row", b.col, round(sum(a.value * b.value) / 1e6, 3) AS value FROM m a JOIN m b USING ("row") GROUP BY a.col, b.col""")
def matrix_product(spark, d):
    """Products of all columns with each other."""
    return similarity.gram(matrix(spark, d)).withColumn("value", r(F.col("value") / 1e6, 3))


@query("matrix_vector", MAT + """ SELECT a.index, a.value, b.value AS back FROM (SELECT "row" AS index, sum(value * (col % 3)) AS value FROM m GROUP BY "row") a LEFT JOIN
 (SELECT col AS index, sum(value * ("row" % 2)) AS value FROM m GROUP BY col) b USING (index)""")
def matrix_vector(spark, d):
    """The matrix times a vector, and a vector times the matrix."""
    m = matrix(spark, d)
    right = m.select(F.col("col").alias("index"), (F.col("col") % 3).alias("v")).distinct()
    left = m.select(F.col("row").alias("index"), (F.col("row") % 2).alias("v")).distinct()
    back = similarity.times_vector(m, left, left=True).withColumnRenamed("value", "back")
    return similarity.times_vector(m, right).join(back, "index", "left")


@query("matrix_concat", MAT + """ SELECT "row", col, value FROM m UNION ALL SELECT "row", col + 100, 1.0 FROM m UNION ALL SELECT col + 2000, "row", value FROM m""")
def matrix_concat(spark, d):
    """Side by side with its own pattern, above its transpose."""
    m = matrix(spark, d)
    wide = transforms.concat_columns([(m, 100), (transforms.binarise(m), 100)])
    return transforms.concat_rows([(wide, 2000), (similarity.transpose(m).select("row", "col", "value"), 100)])


@query("merge_dated", BASE + """, a AS (SELECT user_id AS "row", tweet_id AS col, count(*) AS value, max(t) AS date FROM imp WHERE engage_index % 2 = 0 GROUP BY ALL), b AS (SELECT user_id AS "row", tweet_id AS col, count(*) AS value, max(t) AS date FROM imp WHERE engage_index % 3 = 0 GROUP BY ALL)
SELECT "row", col, CAST(sum(value) AS BIGINT) AS value, max(date) AS date FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def merge_dated(spark, d):
    """Two dated matrices merged."""
    imps = from_events(spark, d)
    def part(k):
        rows = imps.filter(F.col("engage_index") % k == 0)
        return rows.groupBy(F.col("user_id").alias("row"), F.col("tweet_id").alias("col")).agg(F.count("*").alias("value"), F.max("t").alias("date"))
    return transforms.merge_dated(part(2), part(3))


@query("dense_columns", """SELECT lab, i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label AS lab, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY lab, i""")
def dense_columns(spark, d):
    """Mean and deviation of every embedding element per label."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("lab"), F.posexplode("embedding").alias("i", "x"))
    e = e.withColumn("x", F.col("x").cast("double"))
    return e.groupBy("lab", F.col("i").cast("long").alias("i")).agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("std"))


@query("column_scalers", MAT + """, s AS (SELECT col, sqrt(sum(value * value)) AS nrm, least(min(value), CASE WHEN max(CAST("row" = (SELECT min("row") FROM m) AS INT)) = 0 THEN 0 ELSE min(value) END) AS lo,
 greatest(max(value), CASE WHEN max(CAST("row" = (SELECT min("row") FROM m) AS INT)) = 0 THEN 0 ELSE max(value) END) AS hi, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS df FROM m GROUP BY col),
rn AS (SELECT "row", sqrt(sum(value * value)) AS rnorm FROM m GROUP BY "row")
SELECT "row", col, round(value / nrm, 6) AS normed, round(value / rnorm, 6) AS row_normed, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 1 END, 6) AS scaled,
 round(least(greatest((value - mean) / std, -2), 2), 6) AS standard, round(ln(1 + abs(value)) * ln((SELECT count(DISTINCT "row") FROM m) * 1.0 / df), 6) AS tfidf FROM m JOIN s USING (col) JOIN rn USING ("row")""")
def column_scalers(spark, d):
    """Every value under five fitted transforms."""
    m = matrix(spark, d)
    out = transforms.column_norm(m).apply(m).withColumnRenamed("value", "normed")
    more = {
        "row_normed": transforms.row_norm(m), "scaled": transforms.min_max(m).apply(m),
        "standard": transforms.standardise(m, 2.0).apply(m), "tfidf": transforms.tf_idf(m, m.select("row").distinct().count()).apply(m.withColumn("value", F.abs("value"))),
    }
    for name, f in more.items():
        out = out.join(f.withColumnRenamed("value", name), ["row", "col"], "left")
    return out.select("row", "col", *[r(F.col(c)).alias(c) for c in ("normed", *more)])


@query("outlier_clip", MAT + """, k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) AS u, row_number() OVER (PARTITION BY col ORDER BY value DESC) AS w, count(*) OVER (PARTITION BY col) AS n FROM m),
c AS (SELECT col, max(CASE WHEN u = least(ceil(n * 0.05) + 1, n) THEN value END) AS lo, max(CASE WHEN w = least(ceil(n * 0.05) + 1, n) THEN value END) AS hi FROM k GROUP BY col)
SELECT "row", col, least(greatest(value, lo), hi) AS value FROM m JOIN c USING (col)""")
def outlier_clip(spark, d):
    """Values clipped to each column's inner nine tenths."""
    m = matrix(spark, d)
    return transforms.outlier_clip(m, 0.05).apply(m)


@query("dense_standard", """SELECT c_custkey, round(least(greatest((c_acctbal - m) / s, -1.5), 1.5), 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)""")
def dense_standard(spark, d):
    """Balances standardised and clipped."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    return transforms.dense_standardise(c, ["c_acctbal"], 1.5).withColumn("c_acctbal", r(F.col("c_acctbal")))


_LAM = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.5]
_YJ = "CASE WHEN v >= 0 THEN CASE WHEN abs(lam) > 1e-12 THEN (pow(v + 1, lam) - 1) / lam ELSE ln(1 + v) END ELSE CASE WHEN abs(lam - 2) > 1e-12 THEN -(pow(1 - v, 2 - lam) - 1) / (2 - lam) ELSE -ln(1 - v) END END"


@query("power_transform", MAT + f""", x AS (SELECT col, value / 10000 AS v FROM m), g AS (SELECT unnest({_LAM})::DOUBLE AS lam), y AS (SELECT col, lam, v, {_YJ} AS y FROM x, g),
s AS (SELECT col, lam, -count(*) / 2.0 * ln(var_pop(y)) + (lam - 1) * sum(sign(v) * ln(1 + abs(v))) AS ll FROM y GROUP BY col, lam), b AS (SELECT col, arg_max(lam, ll) AS lam FROM s GROUP BY col)
SELECT col, b.lam, count(*) AS n, round(avg(abs(y)), 5) AS size FROM y JOIN b USING (col) WHERE y.lam = b.lam GROUP BY col, b.lam""")
def power_transform(spark, d):
    """The likeliest power of every column."""
    m = matrix(spark, d).withColumn("value", F.col("value") / 10000)
    fit = transforms.fit_yeo_johnson(m, _LAM).params.select("col", "lam")
    rows = m.join(fit, "col").withColumn("y", transforms.yeo_johnson(F.col("value"), F.col("lam")))
    return rows.groupBy("col", "lam").agg(F.count("*").alias("n"), r(F.avg(F.abs("y")), 5).alias("size"))


_SIM = """, pr AS (SELECT DISTINCT tgt.tweet_id AS a, hact.tweet_id AS b FROM tgt JOIN hact USING (user_id)),
cr AS (SELECT x.creator_id AS ca, y.creator_id AS cb, CAST(sum(x.n * y.n) AS DOUBLE) AS seen_by FROM cnt x JOIN cnt y USING (user_id) GROUP BY ALL),
cs AS (SELECT x.user_id AS ca, y.user_id AS cb, CAST(sum(x.n * y.n) AS DOUBLE) AS sees FROM (SELECT * FROM cnt WHERE user_id < 20) x JOIN (SELECT * FROM cnt WHERE user_id < 20) y USING (creator_id) GROUP BY ALL),
si AS (SELECT a, b, CAST(x.lang = y.lang AS INT) AS language, CAST(x.source = y.source AS INT) AS domain, CAST(x.type = y.type AS INT) AS type, len(list_intersect(list_distinct(x.media), list_distinct(y.media))) AS media, len(list_intersect(list_distinct(x.links), list_distinct(y.links))) AS links, len(list_intersect(list_distinct(x.tokens), list_distinct(y.tokens))) AS tokens,
 len(list_intersect(list_distinct(x.tags), list_distinct(y.tags))) AS hashtags, coalesce(seen_by, 0) AS seen_by, coalesce(sees, 0) AS sees
 FROM pr JOIN con x ON x.tweet_id = a JOIN con y ON y.tweet_id = b LEFT JOIN cr ON cr.ca = a % 20 AND cr.cb = b % 20 LEFT JOIN cs ON cs.ca = a % 20 AND cs.cb = b % 20)"""


@query("item_similarity", BASE + _CON + _SIM + "SELECT a, b, language, type, domain, tokens, media, links, hashtags, seen_by, sees FROM si")
def item_similarity(spark, d):
    """Likenesses of the items to predict and those their users acted on."""
    _, target, hist, _, _ = parts(spark, d)
    acted = unpivot_actions(hist).select("user_id", F.col("tweet_id").alias("b")).distinct()
    pairs = target.select("user_id", F.col("tweet_id").alias("a")).distinct().join(acted, "user_id").select("a", "b").distinct()
    out = similarity.item_similarity(pairs, contents(spark, d), interactions(hist))
    return out.withColumns({c: F.col(c).cast("long") for c in ("tokens", "media", "links", "hashtags")})


_MEANS = ", ".join(f"round(avg({c}), 5) AS {c}" for c in similarity.SIMILARITIES)


@query("user_item_similarity", BASE + _CON + _SIM + f"SELECT tgt.engage_index, action, {_MEANS} FROM tgt JOIN hact USING (user_id) JOIN si ON si.a = tgt.tweet_id AND si.b = hact.tweet_id GROUP BY ALL")
def user_item_similarity(spark, d):
    """Mean likeness to what the user acted on, per action."""
    _, target, hist, _, _ = parts(spark, d)
    out = similarity.user_item_similarity(target, hist, contents(spark, d), interactions(hist))
    return out.select("engage_index", "action", *[r(F.col(c), 5).alias(c) for c in similarity.SIMILARITIES])


_NRM = """, n1 AS (SELECT creator_id, user_id, n / sqrt(sum(n * n) OVER (PARTITION BY user_id)) AS v FROM cnt), n2 AS (SELECT creator_id, user_id, v / sqrt(sum(v * v) OVER (PARTITION BY creator_id)) AS v FROM n1), want AS (SELECT DISTINCT user_id, creator_id FROM tgt)"""


@query("item_scores", BASE + _NRM + """SELECT w.user_id, w.creator_id, round(coalesce(sum(x.v * y.v), 0), 6) AS score FROM want w LEFT JOIN cnt c ON c.user_id = w.user_id LEFT JOIN n2 x ON x.creator_id = c.creator_id
 LEFT JOIN n2 y ON y.creator_id = w.creator_id AND y.user_id = x.user_id GROUP BY ALL""")
def item_scores(spark, d):
    """Creator-based neighbour scores of the pairs to predict."""
    _, target, hist, _, _ = parts(spark, d)
    return similarity.item_scores(interactions(hist), target).withColumn("score", r(F.col("score")))


@query("user_scores", BASE + """, want AS (SELECT DISTINCT user_id, creator_id FROM tgt) SELECT w.user_id, w.creator_id, CAST(coalesce(sum(x.n * y.n), 0) AS DOUBLE) AS score FROM want w LEFT JOIN cnt c ON c.creator_id = w.creator_id LEFT JOIN cnt x ON x.user_id = c.user_id
 LEFT JOIN cnt y ON y.user_id = w.user_id AND y.creator_id = x.creator_id GROUP BY ALL""")
def user_scores(spark, d):
    """User-based neighbour scores of the pairs to predict."""
    _, target, hist, _, _ = parts(spark, d)
    return similarity.user_scores(interactions(hist), target)


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


_VEC = ", ve AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), vn AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM ve)"


@query("embedding_scores", BASE + _VEC + """, p AS (SELECT DISTINCT user_id * 7 % 600 AS a, tweet_id AS b FROM imp) SELECT p.a, p.b, round(coalesce(sum(x.x * y.x), 0), 5) AS score FROM p LEFT JOIN vn x ON x.id = p.a LEFT JOIN vn y ON y.id = p.b AND y.i = x.i GROUP BY ALL""")
def embedding_scores(spark, d):
    """Cosines of pairs of ids, 0 where one has no vector."""
    pairs = from_events(spark, d).select((F.col("user_id") * 7 % 600).alias("a"), F.col("tweet_id").alias("b")).distinct()
    return embeddings.pair_scores(pairs, vectors(spark, d), cosine=True).withColumn("score", r(F.col("score"), 5))


@query("profile_scores", BASE + _VEC + """, pf AS (SELECT user_id, i, avg(x) AS x FROM hact JOIN vn ON vn.id = hact.tweet_id GROUP BY ALL)
SELECT engage_index, round(coalesce(sum(pf.x * vn.x), 0), 5) AS score FROM tgt LEFT JOIN pf USING (user_id) LEFT JOIN vn ON vn.id = tweet_id AND vn.i = pf.i GROUP BY engage_index""")
def profile_scores(spark, d):
    """Likeness of each row's item to its user's mean vector."""
    _, target, hist, _, _ = parts(spark, d)
    return embeddings.profile_scores(target, hist, vectors(spark, d)).withColumn("score", r(F.col("score"), 5))


_POOL = "WITH f AS (SELECT vec_id // 10 AS seq, vec_id % 10 AS pos, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@query("pooling", _POOL + """ SELECT seq, CAST(dim AS BIGINT) AS dim, round(sum(CASE WHEN pos > 0 THEN value ELSE 0 END) / count(*), 6) AS mean, round(max(CASE WHEN pos > 0 THEN value END), 6) AS top, round(max(CASE WHEN pos = 0 THEN value END), 6) AS first FROM f GROUP BY ALL""")
def pooling(spark, d):
    """Sequences of ten vectors pooled in three ways."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    long = v.select(F.floor(F.col("vec_id") / 10).alias("seq"), (F.col("vec_id") % 10).alias("pos"), F.posexplode("embedding").alias("dim", "value"))
    long = long.withColumns({"value": F.col("value").cast("double"), "dim": F.col("dim").cast("long")})
    kinds = {"mean": "mean", "top": "max", "first": "first"}
    out = None
    for name, kind in kinds.items():
        p = embeddings.pool(long, kind).select("seq", "dim", r(F.col("value")).alias(name))
        out = p if out is None else out.join(p, ["seq", "dim"], "left")
    return out


@query("attention", _POOL + """, k AS (SELECT seq, pos, sum(f.value * q.value) AS s FROM f JOIN (SELECT seq, dim, value FROM f WHERE pos = 0) q USING (seq, dim) GROUP BY ALL), w AS (SELECT seq, pos, exp(s) / sum(exp(s)) OVER (PARTITION BY seq) AS a FROM k)
SELECT seq AS "row", CAST(dim AS BIGINT) AS i, round(sum(a * value), 5) AS value FROM f JOIN w USING (seq, pos) GROUP BY ALL""")
def attention(spark, d):
    """Sequences of ten vectors weighted by their likeness to the first."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", embeddings.doubles(F.col("embedding")).alias("vec"))
    slots = v.select(F.floor(F.col("vec_id") / 10).alias("row"), (F.col("vec_id") % 10).alias("slot"), "vec", F.lit(True).alias("mask"))
    first = slots.filter("slot = 0").select("row", F.col("vec").alias("query"))
    return embeddings.attention(slots, first).select("row", F.col("i").cast("long").alias("i"), r(F.col("value"), 5).alias("value"))


@query("history_slots", BASE + """, o AS (SELECT user_id, tweet_id, row_number() OVER (PARTITION BY user_id ORDER BY engage_index) AS k FROM hist), g AS (SELECT user_id, k, tweet_id FROM o WHERE k <= 10)
SELECT u.user_id AS "row", CAST(s - 1 AS INT) AS slot, coalesce(g.tweet_id, -1) AS id, embeddings.vec_id IS NOT NULL AS found, s = 1 OR g.tweet_id IS NOT NULL AS mask FROM (SELECT DISTINCT user_id FROM hist) u CROSS JOIN range(1, 11) r(s) LEFT JOIN g ON g.user_id = u.user_id AND g.k = s LEFT JOIN embeddings ON vec_id = g.tweet_id""")
def history_slots(spark, d):
    """Vectors of every user's first ten items, padded and masked."""
    from pyspark.sql import Window as W

    from tidemark.operators.history import pad

    hist = parts(spark, d)[2]
    k = F.row_number().over(W.partitionBy("user_id").orderBy("engage_index"))
    own = hist.withColumn("k", k).filter("k <= 10").groupBy(F.col("user_id").alias("row")).agg(F.sort_array(F.collect_list(F.struct("k", "tweet_id"))).alias("x"))
    rows = own.select("row", pad(F.col("x.tweet_id")).alias("items"))
    return embeddings.history_slots(rows, ["items"], vectors(spark, d)).select("row", "slot", "id", F.col("vec").isNotNull().alias("found"), "mask")


_PRED = """, pred AS (SELECT tweet_id, user_id, action, model, (hashv % 9973 + CASE WHEN at2 IS NOT NULL THEN 2500 ELSE 0 END + 1) / 13000.0 AS score, CAST(at2 IS NOT NULL AS INT) AS label, engage_index FROM
 (SELECT engage_index, tweet_id, user_id, a.action, m.model, (engage_index * 7919 + a.ai * 104729 + m.mi * 1299709) AS hashv, CASE a.action WHEN 'reply' THEN reply_ts WHEN 'retweet' THEN retweet_ts WHEN 'comment' THEN comment_ts ELSE like_ts END AS at2
 FROM imp, (VALUES ('reply', 0), ('retweet', 1), ('comment', 2), ('like', 3)) a(action, ai), (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) m(model, mi)))"""


def predictions(spark, d):
    """Made-up scores of three models for every impression and action, above chance, with labels."""
    imps = stored(from_events(spark, d).drop("tweet_ts", "t", "follow"), "log")
    acts = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(i).alias("ai"), F.col(f"{a}_ts").isNotNull().cast("int").alias("label")) for i, a in enumerate(ACTIONS)])
    mods = F.array(*[F.struct(F.lit(f"m{i}").alias("model"), F.lit(i).alias("mi")) for i in range(3)])
    rows = imps.select("engage_index", "tweet_id", "user_id", F.explode(acts).alias("a")).withColumn("m", F.explode(mods))
    h = F.col("engage_index") * 7919 + F.col("a.ai") * 104729 + F.col("m.mi") * 1299709
    score = (h % 9973 + F.when(F.col("a.label") == 1, 2500).otherwise(0) + 1) / 13000.0
    return rows.select("tweet_id", "user_id", "a.action", "m.model", score.alias("score"), "a.label", "engage_index")


_ONE = _PRED + ", p0 AS (SELECT action, engage_index, label, score FROM pred WHERE model = 'm0')"
_CURVE = """, st AS (SELECT action, score, sum(label) AS tp, count(*) AS n FROM p0 GROUP BY ALL), cu AS (SELECT action, score, sum(tp) OVER w * 1.0 / sum(n) OVER w AS p, sum(tp) OVER w * 1.0 / sum(tp) OVER (PARTITION BY action) AS r FROM st WINDOW w AS (PARTITION BY action ORDER BY score DESC)),
ar AS (SELECT action, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS a FROM cu WINDOW w AS (PARTITION BY action ORDER BY score DESC)), pa AS (SELECT action, sum(a) AS pr_auc FROM ar GROUP BY action),
rc AS (SELECT action, avg(label) AS ctr, (1 - avg(-(label * ln(score) + (1 - label) * ln(1 - score))) / -(avg(label) * ln(avg(label)) + (1 - avg(label)) * ln(1 - avg(label)))) * 100 AS rce FROM p0 GROUP BY action)"""


@query("metric_report", BASE + _ONE + _CURVE + " SELECT action, round(pr_auc, 6) AS pr_auc, round(rce, 5) AS rce FROM pa JOIN rc USING (action) UNION ALL SELECT 'mean', round(avg(pr_auc), 6), round(avg(rce), 5) FROM pa JOIN rc USING (action)")
def metric_report(spark, d):
    """Area under the curve and relative cross-entropy per action, and their means."""
    rows = predictions(spark, d).filter("model = 'm0'")
    return metrics.report(rows).select("action", r(F.col("pr_auc")).alias("pr_auc"), r(F.col("rce"), 5).alias("rce"))


@query("pr_auc_rows", BASE + _ONE + """, w AS (SELECT action, sum(label) OVER x * 1.0 / row_number() OVER x AS p, sum(label) OVER x * 1.0 / sum(label) OVER (PARTITION BY action) AS r, row_number() OVER x AS k FROM p0 WINDOW x AS (PARTITION BY action ORDER BY score DESC, engage_index ROWS UNBOUNDED PRECEDING)),
a AS (SELECT action, (r - lag(r) OVER x) * (p + lag(p) OVER x) / 2 AS a FROM w WINDOW x AS (PARTITION BY action ORDER BY k)) SELECT action, round(sum(a), 6) AS pr_auc FROM a GROUP BY action""")
def pr_auc_rows(spark, d):
    """Area under the curve through all rows."""
    rows = predictions(spark, d).filter("model = 'm0'")
    return metrics.pr_auc_rows(rows, "engage_index").withColumn("pr_auc", r(F.col("pr_auc")))


@query("ranks_and_tops", BASE + _ONE + """, t AS (SELECT action, engage_index, score, rank() OVER (PARTITION BY action ORDER BY score DESC) AS rk FROM p0), x AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY score DESC, engage_index) AS rank FROM t WHERE engage_index % 5 <> 0)
SELECT action, engage_index, CAST(rk AS INT) AS place, CAST(rank AS INT) AS rank FROM x WHERE rank <= 25""")
def ranks_and_tops(spark, d):
    """Competition ranks, and the 25 best rows of each action without excluded ones."""
    rows = predictions(spark, d).filter("model = 'm0'").select("action", "engage_index", "score")
    placed = metrics.rank_desc(rows, "action", "score").withColumnRenamed("rank", "place")
    skip = rows.filter("engage_index % 5 = 0").select("action", "engage_index")
    return metrics.top_n(placed, "action", "engage_index", "score", 25, skip).select("action", "engage_index", "place", "rank")


@query("standard_within", BASE + _ONE + "SELECT action, engage_index, round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 5) AS score FROM p0 WINDOW w AS (PARTITION BY action)")
def standard_within(spark, d):
    """Scores standardised inside each action."""
    rows = predictions(spark, d).filter("model = 'm0'").select("action", "engage_index", "score")
    return metrics.standardise_within(rows, "action", "score").withColumn("score", r(F.col("score"), 5))


_LG = "ln(least(greatest({x}, 1e-7), 1 - 1e-7) / (1 - least(greatest({x}, 1e-7), 1 - 1e-7)))"
_TEMP = "CASE action WHEN 'reply' THEN 1.05 WHEN 'retweet' THEN 1.15 WHEN 'comment' THEN 1.05 ELSE 1.25 END"


@query("temperature", BASE + _ONE + f""", z AS (SELECT *, {_LG.format(x='score')} AS z FROM p0), y AS (SELECT *, avg(z) OVER (PARTITION BY action) AS mu FROM z)
SELECT action, engage_index, round(1 / (1 + exp(-((z - mu) / {_TEMP} + mu + CASE WHEN action = 'like' THEN -0.1 ELSE 0 END))), 6) AS score FROM y""")
def temperature(spark, d):
    """Scores drawn to their mean by each action's temperature."""
    return blend.scale(predictions(spark, d).filter("model = 'm0'")).select("action", "engage_index", r(F.col("score")).alias("score"))


@query("temperature_grid", BASE + _ONE + f""", z AS (SELECT action, label, {_LG.format(x='score')} AS z FROM p0), y AS (SELECT action, label, z, avg(z) OVER (PARTITION BY action) AS mu FROM z), g AS (SELECT round(0.8 + 0.05 * range, 2) AS t FROM range(10)),
s AS (SELECT action, CAST(t AS DOUBLE) AS t, label, 1 / (1 + exp(-((z - mu) / t + mu))) AS p FROM y, g) SELECT action, t, round((1 - avg(-(label * ln(p) + (1 - label) * ln(1 - p))) / -(avg(label) * ln(avg(label)) + (1 - avg(label)) * ln(1 - avg(label)))) * 100, 4) AS rce FROM s GROUP BY action, t""")
def temperature_grid(spark, d):
    """Relative cross-entropy at each temperature of a grid."""
    return blend.grid_search(predictions(spark, d).filter("model = 'm0'")).withColumn("rce", r(F.col("rce"), 4))


_KEY = "SELECT engage_index * 1000 + tweet_id AS tweet_id, user_id, action, model, score FROM pred"


@query("blend_average", BASE + _PRED + f", k AS ({_KEY}) SELECT tweet_id, user_id, action, round(avg(score), 6) AS score FROM k GROUP BY ALL")
def blend_average(spark, d):
    """Mean of all models' scores."""
    return blend.average(keyed(spark, d)).withColumn("score", r(F.col("score")))


def keyed(spark, d):
    return predictions(spark, d).withColumn("tweet_id", F.col("engage_index") * 1000 + F.col("tweet_id"))


_W = " + ".join(f"{w} * {_LG.format(x=m)}" for m, w in (("m0", 0.5), ("m1", 0.3), ("m2", 0.2)))


@query("blend_linear", BASE + _PRED + f""", k AS ({_KEY}), x AS (SELECT tweet_id, user_id, action, max(CASE WHEN model = 'm0' THEN score END) AS m0, max(CASE WHEN model = 'm1' THEN score END) AS m1, max(CASE WHEN model = 'm2' THEN score END) AS m2 FROM k WHERE NOT (model = 'm2' AND tweet_id % 11 = 0) GROUP BY ALL)
SELECT tweet_id, user_id, action, round(1 / (1 + exp(-({_W}))), 6) AS score FROM x WHERE m2 IS NOT NULL""")
def blend_linear(spark, d):
    """Weighted logits of the models, for the rows that all of them have."""
    preds = keyed(spark, d).filter("not (model = 'm2' and tweet_id % 11 = 0)")
    out = blend.apply_weights(blend.merge(preds, ["m0", "m1", "m2"]), {"m0": 0.5, "m1": 0.3, "m2": 0.2})
    return out.select("tweet_id", "user_id", "action", r(F.col("score")).alias("score"))


@query("blend_features", BASE + _PRED + f""", k AS ({_KEY}) SELECT tweet_id, user_id, {", ".join(f"max(CASE WHEN model = '{m}' AND action = '{a}' THEN round(score, 6) END) AS {m}_{a}" for m in ("m0", "m1", "m2") for a in ACTIONS)} FROM k GROUP BY ALL""")
def blend_features(spark, d):
    """All scores of a row side by side."""
    preds = keyed(spark, d).withColumn("score", r(F.col("score")))
    return blend.features(preds, ["m0", "m1", "m2"], ACTIONS)


@query("blend_fitted")
def blend_fitted(spark, d):
    """A logistic blend fitted on 40% of the rows and applied to the others."""
    m = ["m0", "m1", "m2"]
    preds = keyed(spark, d).filter("action = 'like'")
    wide = blend.merge(preds, m).join(preds.filter("model = 'm0'").select("tweet_id", "label"), "tweet_id")
    wide = splits.holdout(wide, "tweet_id")
    model = blend.fit_linear(wide.filter("eval"), m)
    return models.score(model, blend.with_logits(wide.filter("not eval"), m), ["tweet_id", "user_id"])


@query("best_rounds", """SELECT user_id, max(value) AS metric, arg_max(CAST(event_id AS BIGINT), struct_pack(a := value, b := -event_id)) AS iteration FROM events GROUP BY user_id""")
def best_rounds(spark, d):
    """Each user's best value and when it came."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("value").alias("metric"), F.col("event_id").alias("iteration"))
    return metrics.best_iteration(e, "user_id").select("user_id", "metric", "iteration")


@query("tree_scores")
def tree_scores(spark, d):
    """Boosted trees on history features, scored on the validation rows."""
    from tidemark.plans.queries import history_features

    rows = history_features(spark, d)
    groups = {"user": ["user_total", "user_pos", "user_ratio"], "pair": [f"with_{a}_n" for a in ACTIONS], "creator": [f"c_{a}_n" for a in ACTIONS]}
    cols = models.without_groups(groups, ["creator"])
    model = models.train_trees(rows.filter("split = 'train'"), cols, "like_label", depth=3, rounds=5)
    return models.score(model, rows.filter("split = 'valid'"), ["engage_index", "like_label"])


@query("batch_scores", """SELECT doc_id AS tweet_id, round(list_avg(list_transform(regexp_split_to_array(text, '[ \\n]+'), lambda x: length(x))), 6) AS mean_size FROM documents""")
def batch_scores(spark, d):
    """Scores by a caller's batch function over token arrays."""
    def make():
        return lambda arrays, masks: (arrays["sizes"].sum(axis=1) / masks["sizes"].sum(axis=1)).reshape(-1, 1)

    c = contents(spark, d).select("tweet_id", F.transform("tokens", F.length).alias("sizes"))
    return models.batch_score(c, ["tweet_id"], ["sizes"], ["mean_size"], make).withColumn("mean_size", r(F.col("mean_size")))


@query("low_rank")
def low_rank(spark, d):
    """Factors of the ten largest singular values of the user x creator counts: both sides' vectors."""
    counts = interactions(parts(spark, d)[2]).select(F.col("user_id").alias("row"), F.col("creator_id").alias("col"), F.col("n").alias("value"))
    values, left, right = factors.low_rank(counts, 10)
    scaled = F.zip_with("vec", F.array(*[F.lit(float(v)) for v in values]), lambda x, s: x * s)  # the sides' product is the matrix
    out = left.select(F.lit("user").alias("side"), "index", scaled.alias("vec"))
    return out.unionByName(right.select(F.lit("creator").alias("side"), "index", "vec"))


@query("file_round_trip", BASE + _PRED + """ SELECT model, action, CAST(tweet_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, round(sum(round(score, 8)), 6) AS score FROM pred GROUP BY ALL""")
def file_round_trip(spark, d):
    """All models' predictions written with eight decimals, a folder for each action, and read back."""
    rows, p, out = stored(predictions(spark, d)), folder(spark), None
    for m in ("m0", "m1", "m2"):
        writers.write_predictions(rows.filter(F.col("model") == m), f"{p}/{m}")
        for a in ACTIONS:
            back = readers.read_predictions(spark, f"{p}/{m}/action={a}").withColumns({"model": F.lit(m), "action": F.lit(a)})
            out = back if out is None else out.unionByName(back)
    return out.groupBy("model", "action", "tweet_id", "user_id").agg(F.count("*").alias("n"), r(F.sum("score")).alias("score"))


@query("libsvm_round_trip", MAT + """ SELECT CAST("row" % 2 AS DOUBLE) AS label, col, count(*) AS n, sum(value) AS value FROM m GROUP BY ALL""")
def libsvm_round_trip(spark, d):
    """Nonzeros written as label and pairs, read back and summed."""
    m, p = matrix(spark, d), folder(spark)
    lab = m.select("row").distinct().withColumns({"label": (F.col("row") % 2).cast("int"), "action": F.lit("like"), "split": F.lit("train")})
    writers.write_libsvm(m, lab, p, partition_by=["action", "split"])
    back = readers.read_libsvm(spark, f"{p}/action=like/split=train")
    return back.groupBy("label", "col").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query("log_round_trip", BASE + "SELECT tweet_id, user_id, creator_id, tweet_ts, CAST(follow AS INT) AS follow, reply_ts, like_ts FROM imp")
def log_round_trip(spark, d):
    """Impressions written as lines of the log and parsed again."""
    imps, p = from_events(spark, d), folder(spark)
    have = {"tweet_id": "tweet_id", "creator_id": "creator_id", "user_id": "user_id", "tweet_timestamp": "tweet_ts", "creator_follows_user": "follow"} | {f"{a}_ts": f"{a}_ts" for a in ACTIONS}
    fields = [F.coalesce(F.col(have[n]).cast("string"), F.lit("")) if n in have else F.lit("a\tb" if k == "list" else "") for n, k in readers.COLUMNS]
    imps.select(F.concat_ws("\u0001", *fields).alias("value")).write.text(p)
    back = readers.read_impressions(spark, p)
    return back.select(*[F.col(c).cast("long").alias(c) for c in ("tweet_id", "user_id", "creator_id")], F.col("tweet_timestamp").alias("tweet_ts"), F.col("creator_follows_user").alias("follow"), "reply_ts", "like_ts")


@query("interaction_round_trip", """SELECT CAST(user_id AS INT) AS user, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS item, CAST(count(*) AS DOUBLE) AS weight, max(event_id) AS date FROM events GROUP BY ALL""")
def interaction_round_trip(spark, d):
    """Interactions written as CSV and merged on reading."""
    p = folder(spark)
    spark.read.parquet(f"{d}/events.parquet").select("user_id", F.regexp_extract("props", "([0-9]+)", 1), F.lit(1.0), "event_id").write.csv(p)
    return readers.read_interactions(spark, p, weight=True, date=True)


@query("stream_labels", BASE + "SELECT engage_index, CAST(reply_ts IS NOT NULL AS INT) AS reply_label, CAST(like_ts IS NOT NULL AS INT) AS like_label FROM imp")
def stream_labels(spark, d):
    """A transform over a stream of impressions in files, batch by batch."""
    src, p = folder(spark), folder(spark)
    imps = from_events(spark, d)
    imps.write.parquet(src)
    apply_stream(spark, src, imps.schema, lambda b: labels(b).select("engage_index", "reply_label", "like_label"), f"{p}/out", f"{p}/state").awaitTermination()
    return spark.read.parquet(f"{p}/out").select("engage_index", "reply_label", "like_label")


@query("frequent_set_ops", BASE + """SELECT tweet_id, count(DISTINCT user_id) AS users FROM (SELECT tweet_id, user_id FROM hist UNION SELECT tweet_id, user_id FROM tgt) WHERE tweet_id NOT IN (SELECT tweet_id FROM tgt WHERE split = 'valid') GROUP BY tweet_id""")
def frequent_set_ops(spark, d):
    """Distinct users of items that no validation row shows."""
    _, target, hist, _, _ = parts(spark, d)
    both = hist.select("tweet_id", "user_id").union(target.select("tweet_id", "user_id")).distinct()
    return splits.members(both, target.filter("split = 'valid'"), "tweet_id", inside=False).groupBy("tweet_id").agg(F.count_distinct("user_id").alias("users"))
