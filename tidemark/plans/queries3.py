"""Queries of files, dictionaries, samples and joins that the other two modules don't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import blend, embeddings, history, ids, metrics, models, similarity, splits, transforms
from tidemark.operators.impressions import ACTIONS, all_before, bounds, contents, from_events, labels
from tidemark.plans.queries import _CLEAN, _CON, _TWEET, _WS, BASE, history_features, parts, r, tweets
from tidemark.plans.queries2 import _NRM, _PRED, MAT, folder, keyed, matrix, vectors
from tidemark.sources import readers, writers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


@query("tagged_logs", BASE + """SELECT CASE WHEN engage_index % 2 = 0 THEN 'train' ELSE 'test' END AS dataset, count(*) AS n, count(DISTINCT user_id) AS users, sum(CASE WHEN engage_index % 2 = 0 AND like_ts IS NOT NULL THEN 1 ELSE 0 END) AS likes FROM imp GROUP BY 1""")
def tagged_logs(spark, d):
    """A labelled and an unlabelled log read together, each row with its data set."""
    imps, p = from_events(spark, d), folder(spark)
    have = {"tweet_id": "tweet_id", "creator_id": "creator_id", "user_id": "user_id", "tweet_timestamp": "tweet_ts"} | {f"{a}_ts": f"{a}_ts" for a in ACTIONS}
    for name, part, cols in (("train", 0, readers.COLUMNS), ("test", 1, readers.COLUMNS[:-4])):
        fields = [F.coalesce(F.col(have[n]).cast("string"), F.lit("")) if n in have else F.lit("") for n, _ in cols]
        imps.filter(F.col("engage_index") % 2 == part).select(F.concat_ws("\u0001", *fields).alias("value")).write.text(f"{p}/{name}")
    rows = readers.read_tagged(spark, {"train": (f"{p}/train", True), "test": (f"{p}/test", False)})
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count("like_ts").alias("likes"))


@query("id_texts", """SELECT CAST(doc_id AS VARCHAR) AS id, md5(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS digest FROM documents WHERE trim(replace(replace(text, chr(10), ' '), chr(13), ' ')) <> ''""")
def id_texts(spark, d):
    """Texts written a line each after their id, read back without blank ones."""
    p = folder(spark)
    line = F.translate("text", "\n\r", "  ")
    spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(","), line).alias("value")).write.text(p)
    return tx.non_blank(readers.read_id_text(spark, p), "text").select("id", F.md5("text").alias("digest"))


@query("dense_csv", """SELECT CAST(vec_id AS VARCHAR) AS id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) + 0.0 AS total, len(embedding) AS width FROM embeddings""")
def dense_csv(spark, d):
    """Dense feature rows written as wide CSV and cut into arrays again."""
    p = folder(spark)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", embeddings.doubles(F.col("embedding")).alias("f"), F.col("vec_id").alias("id"))
    writers.write_dense_csv(rows, p, labels=["label"], features="f", keys=["id"])
    width = rows.agg(F.max(F.size("f"))).first()[0]
    back = readers.read_feature_csv(spark, p, [("label", 1, "int"), ("f", width, "double"), ("id", 1, "string")])
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return back.select("id", "label", (r(total, 3) + 0.0).alias("total"), F.size("f").cast("long").alias("width"))


_FIRST = """, o AS (SELECT user_id, action, tweet_id, engage_index, row_number() OVER (PARTITION BY user_id, action ORDER BY engage_index) AS pos FROM hact), g AS (SELECT * FROM o WHERE pos <= 10)"""


@query("history_csv", BASE + _FIRST + """, m AS (SELECT user_id, action, string_agg(tweet_id, '|' ORDER BY pos) || '|' AS items, count(*) AS n, sum(tweet_id) AS total FROM g GROUP BY ALL) SELECT user_id AS "user", CAST(n > 3 AS INT) AS label, action, n AS size, items, n, CAST(total AS BIGINT) AS total FROM m""")
def history_csv(spark, d):
    """Histories written as ``id|id|`` columns beside an id map, read back and mapped to ids."""
    p = folder(spark)
    first = history.first_distinct_items(parts(spark, d)[2])
    used = first.select(F.explode("items").alias("tweet_id")).distinct()
    index = ids.assign_ids(used.withColumn("pos", F.col("tweet_id")), ["tweet_id"], "pos", id_col="tweet_id")
    writers.write_id_map(index.select("tweet_id", "index"), f"{p}/map")
    own = first.withColumns({"label": (F.size("items") > 3).cast("int"), "size": F.size("items").cast("long")})
    writers.write_history_csv(own, f"{p}/rows", labels=["label"], features=["action", "size"], histories=["items"], keys=["user_id"])
    back = readers.read_feature_csv(spark, f"{p}/rows", [("label", 1, "int"), ("action", 1, "string"), ("size", 1, "long"), ("items", 1, "string"), ("user", 1, "long")])
    one = back.select("*", F.explode(F.filter(F.split("items", r"\|"), lambda x: x != "")).alias("tweet_id"))
    known = one.join(readers.read_id_map(spark, f"{p}/map"), "tweet_id")
    back_ids = ids.index_to_id(known.drop("tweet_id"), index.select(F.col("tweet_id").alias("id"), "index"), "tweet_index")
    return back_ids.groupBy("user", "label", "action", "size", "items").agg(F.count("*").alias("n"), F.sum("tweet_index").alias("total"))


@query("chunk_files", BASE + """SELECT 'train' AS part, CAST(engage_index % 3 AS INT) AS chunk, count(*) AS n, sum(engage_index) AS total FROM tgt WHERE split = 'train' GROUP BY ALL UNION ALL SELECT 'valid', 0, count(*), sum(engage_index) FROM tgt WHERE split = 'valid'""")
def chunk_files(spark, d):
    """Train rows written by chunk with the validation rows beside chunk 0, kept as a snapshot and read again."""
    target, p = parts(spark, d)[1].select("engage_index", "split"), folder(spark)
    train = target.filter("split = 'train'").withColumn("chunk", (F.col("engage_index") % 3).cast("int"))
    writers.write_chunks(train, target.filter("split = 'valid'"), f"{p}/chunks")
    writers.write_snapshot(readers.read_snapshot(spark, f"{p}/chunks"), f"{p}/snapshot")
    back = readers.read_snapshot(spark, f"{p}/snapshot")
    return back.groupBy("part", F.col("chunk").cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.sum("engage_index").alias("total"))


@query("triplet_files", MAT + """ SELECT 'all' AS kind, "row", col, value FROM m UNION ALL SELECT 'between', "row", col, value FROM m WHERE "row" >= 3 AND "row" < 9 UNION ALL SELECT 'listed', v.n, col, value FROM m JOIN (VALUES (5, 0), (2, 1), (5, 2)) v(o, n) ON o = "row" """)
def triplet_files(spark, d):
    """Nonzeros dumped as triplets and read again, a range of rows, and rows by a list of positions."""
    p = folder(spark)
    writers.write_triplets(matrix(spark, d), p)
    m = spark.read.schema("row long, col long, value double").csv(p)
    listed = transforms.listed_rows(m, spark.createDataFrame([(5, 0), (2, 1), (5, 2)], "old long, new long"))
    each = [("all", m), ("between", readers.rows_between(m, "row", 3, 9)), ("listed", listed)]
    out = [x.select(F.lit(k).alias("kind"), "row", "col", "value") for k, x in each]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("corpus_lines", """SELECT count(*) AS lines, count(DISTINCT t) AS kinds, sum(length(t)) AS chars FROM (SELECT DISTINCT replace(replace(text, chr(10), ' '), chr(13), ' ') AS t FROM documents)""")
def corpus_lines(spark, d):
    """Distinct texts written a line each, and what counting lines finds."""
    p = folder(spark)
    writers.write_corpus(spark.read.parquet(f"{d}/documents.parquet").select(F.translate("text", "\n\r", "  ").alias("t")), "t", p)
    back = spark.read.text(p)
    out = back.agg(F.count_distinct("value").alias("kinds"), F.sum(F.length("value")).alias("chars"))
    return out.withColumn("lines", F.lit(readers.count_lines(spark, p)).cast("long"))


@query("embedding_segments", """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS e FROM embeddings), w AS (SELECT id, e, row_number() OVER (ORDER BY id) - 1 AS "row" FROM v)
SELECT "row", id, round(e[1]::DOUBLE, 5) AS first, round(e[2]::DOUBLE, 5) AS second, (SELECT count(*) FROM v WHERE id % 50 = 7) AS wrong FROM w""")
def embedding_segments(spark, d):
    """Two segments of vectors of which the later one wins, put in row order, with a spot check of the first values against the
    table's own, of which every fiftieth is made wrong."""
    v, p = vectors(spark, d), folder(spark)
    v.write.parquet(f"{p}/0")
    v.filter("id % 3 = 0").withColumn("vec", F.reverse("vec")).write.parquet(f"{p}/1")
    own = readers.read_embedding_segments(spark, [f"{p}/0", f"{p}/1"])
    rows = ids.assign_ids(own.withColumn("pos", F.col("id")), ["id"], "pos", name="row")
    out = writers.embedding_rows(rows, own)
    raw = vectors(spark, d).withColumn("vec", F.when(F.col("id") % 3 == 0, F.reverse("vec")).otherwise(F.col("vec")))
    head = F.slice("vec", 1, 2)
    expected = raw.select("id", F.when(F.col("id") % 50 == 7, F.transform(head, lambda x: (x + 1).cast("float"))).otherwise(head).alias("head"))
    wrong = embeddings.check_values(own, expected).count()
    return out.select("row", "id", r(F.col("vec")[0].cast("double"), 5).alias("first"), r(F.col("vec")[1].cast("double"), 5).alias("second"), F.lit(wrong).cast("long").alias("wrong"))


@query("dictionary_reuse", """WITH a AS (SELECT DISTINCT lang || '-' || source AS c FROM documents WHERE doc_id % 2 = 0), p AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS cat FROM a WHERE c < 'en-src5'),
n AS (SELECT c, row_number() OVER (ORDER BY c) - 1 + (SELECT count(*) FROM p) AS cat FROM a WHERE c NOT IN (SELECT c FROM p)), t AS (SELECT * FROM p UNION ALL SELECT * FROM n)
SELECT doc_id, cat, t.c AS name, (SELECT count(*) FROM t) AS width FROM documents JOIN t ON t.c = lang || '-' || source""")
def dictionary_reuse(spark, d):
    """A dictionary fitted on half of the rows after a preset one, stored, read again and applied to all rows."""
    p = folder(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("-", "lang", "source").alias("c"))
    half = docs.filter("doc_id % 2 = 0")
    preset = ids.Dictionary.fit(half.filter("c < 'en-src5'"), "c")
    ids.Dictionary.fit(half, "c", preset=preset.table).save(p)
    dic = ids.Dictionary.load(spark, p)
    coded = dic.transform(docs, "doc_id", "c")
    named = ids.index_to_id(coded.withColumn("name", F.col("cat")), dic.table, "name", id_col="category", name="cat")
    return named.select("doc_id", "cat", "name", F.lit(ids.width(coded, dic.table)).cast("long").alias("width"))


@query("numeric_features", """SELECT c_custkey AS "row", cat, value FROM (SELECT c_custkey, 0 AS cat, CAST(c_nationkey AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 1, CAST(c_acctbal AS DOUBLE) FROM customer) WHERE value <> 0""")
def numeric_features(spark, d):
    """Columns as (row, category, value) without zeros."""
    c = spark.read.parquet(f"{d}/customer.parquet").withColumnRenamed("c_custkey", "row")
    return ids.encode_numeric(c, "row", ["c_nationkey", "c_acctbal"])


@query("fitted_scaler", MAT + """, f AS (SELECT col, avg(value) AS mean, stddev_pop(value) AS std, max(abs(value)) AS top FROM m WHERE "row" % 2 = 0 GROUP BY col)
SELECT "row", col, round(least(greatest((value - mean) / std, -2), 2), 6) AS value, pow(value, 2) AS squared FROM m JOIN f USING (col) WHERE "row" % 2 = 1 AND std > 0 AND abs(value - mean) >= 1e-5""")
def fitted_scaler(spark, d):
    """Standard scores fitted on the even rows and applied to the odd ones, beside squares of the values."""
    m = matrix(spark, d)
    train, valid = m.filter("row % 2 = 0"), m.filter("row % 2 = 1")
    known = train.groupBy("col").agg(F.stddev_pop("value").alias("s")).filter("s > 0").select("col")
    model = models.ColumnScaler("standardise", clip=2.0).fit(train)
    out = model.transform(valid).join(known, "col", "left_semi").withColumn("value", r(F.col("value")))
    squares = transforms.power(valid, 2).withColumnRenamed("value", "squared")  # of whole cents, so exact
    return out.join(squares, ["row", "col"])


@query("dense_and_sparse", """WITH e AS (SELECT vec_id AS "row", unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings) SELECT "row", round(sum(value), 4) AS total, count(*) AS nonzeros, (SELECT CAST(max(len(embedding)) AS INT) FROM embeddings) AS width FROM e WHERE value > 0 GROUP BY "row" """)
def dense_and_sparse(spark, d):
    """Vectors without their negative elements, as nonzeros and filled up again."""
    v = vectors(spark, d).select("id", F.transform("vec", lambda x: F.when(x > 0, x.cast("double")).otherwise(0.0)).alias("vec"))
    dense = transforms.to_dense(transforms.to_sparse(v, "id", "vec"), v.agg(F.max(F.size("vec"))).first()[0])
    return dense.select("row", r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(F.filter("vec", lambda x: x > 0)).cast("long").alias("nonzeros"),
                        F.size("vec").alias("width"))


@query("first_statistics", f"""WITH t AS (SELECT source AS key, arg_min(text, doc_id) AS text FROM documents GROUP BY source), c AS (SELECT key, {_CLEAN} AS c FROM t), w AS (SELECT key, c, {_WS.format(t='c')} AS w FROM c)
SELECT key, CAST(len(regexp_extract_all(c, '[.|,:;!?'']')) AS DOUBLE) AS punctuation, CAST(len(w) AS DOUBLE) AS words,
 CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) AS DOUBLE) AS capitalised, CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{Ll}}'))) AS DOUBLE) AS uppercase,
 CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS max_length, round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0), 6) AS mean_length FROM w""")
def first_statistics(spark, d):
    """All statistics of each source's first text."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("source", "key")
    return tx.first_statistics(docs, "key", "doc_id", "text").withColumn("mean_length", r(F.col("mean_length")))


@query("mention_ids", f"""WITH t AS (SELECT doc_id AS tweet_id, {_TWEET} AS text FROM documents), x AS (SELECT tweet_id, 0 AS g, 0 AS p, nullif(regexp_extract(text, 'RT @ ([^,:]+) :', 1), '') AS name FROM t
 UNION ALL SELECT tweet_id, 1, generate_subscripts(m, 1), unnest(m) FROM (SELECT tweet_id, regexp_extract_all(regexp_replace(text, 'RT @ [^,:]+ :', '', 'g'), '@ (\\S*)', 1) AS m FROM t)),
y AS (SELECT tweet_id, g, p, substr(name, 1, 15) AS name FROM x WHERE name IS NOT NULL), i AS (SELECT name, row_number() OVER (ORDER BY min((tweet_id, g, p))) - 1 AS i FROM y GROUP BY name)
SELECT tweet_id, string_agg(i, ',' ORDER BY i) AS mentions FROM (SELECT DISTINCT tweet_id, i FROM y JOIN i USING (name)) GROUP BY tweet_id""")
def mention_ids(spark, d):
    """Ids of everyone a text mentions, in first-seen order."""
    out = tx.mention_lists(tweets(spark, d).withColumn("pos", F.col("tweet_id")), "tweet_id", "pos", "text")
    return out.select("tweet_id", F.array_join(F.transform("mentions", lambda x: x.cast("string")), ",").alias("mentions"))


@query("before_dates", BASE + """SELECT engage_index, coalesce(greatest(reply_ts, retweet_ts, comment_ts, like_ts) < cut, true) AS before, true AS always FROM imp, lim""")
def before_dates(spark, d):
    """Whether all actions of a row came before the cut-off; a negative date lets every row through."""
    imps = from_events(spark, d)
    cut = bounds(imps)[1] - splits.CUTOFF_BEFORE_END
    return imps.select("engage_index", all_before(F.lit(cut)).alias("before"), all_before(F.lit(-1)).alias("always"))


@query("weighted_rows", """SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 0 ORDER BY -ln((CAST('0x' || substr(md5(o_orderkey || ':3'), 1, 12) AS BIGINT) + 1) / 281474976710656.0) / o_totalprice, o_orderkey LIMIT 100""")
def weighted_rows(spark, d):
    """A hundred orders drawn with chances in proportion to their price."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return splits.weighted_choice(o, "key", "o_totalprice", 100, seed=3).select("key")


@query("shuffled_rows", """SELECT c_custkey AS key, row_number() OVER (ORDER BY md5(c_custkey || ':2'), c_custkey) - 1 AS at, [c_custkey % 3, c_custkey // 3 % 3, c_custkey // 9 % 3] AS digits FROM customer""")
def shuffled_rows(spark, d):
    """Customers in a seeded random order, and the choices their keys stand for."""
    from tidemark.operators.order import global_index

    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("key"))
    out = global_index(c, splits.portable(F.col("key"), 2), "key", name="at")
    return out.select("key", "at", splits.ith_choice(F.col("key"), 3, 3).alias("digits"))


_POISSON = [0.9048374180359595, 0.9953211598395555, 0.9998453469297354, 0.9999961531660748]


@query("sampled_rows", """WITH x AS (SELECT doc_id, (CAST('0x' || substr(md5(doc_id || ':4'), 1, 12) AS BIGINT) + 1) / 281474976710656.0 AS u FROM documents)
SELECT doc_id, CAST(u <= 0.1 AS INT) AS once, CAST(""" + " + ".join(f"CAST(u > {x} AS INT)" for x in _POISSON) + """ AS BIGINT) AS copies FROM x WHERE u <= 0.1 OR u > 0.9048374180359595""")
def sampled_rows(spark, d):
    """A tenth of the rows, and a tenth drawn with replacement: which rows each draw has, and how often."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    once = splits.drawn_rows(docs, "doc_id", 0.1, seed=4).withColumn("once", F.lit(1))
    more = splits.drawn_rows(docs, "doc_id", 0.1, replace=True, seed=4).groupBy("doc_id").agg(F.count("*").alias("copies"))
    return once.join(more, "doc_id", "full").select("doc_id", F.coalesce("once", F.lit(0)).alias("once"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


@query("random_cells", """WITH c AS (SELECT range AS "row" FROM range((SELECT count(*) FROM documents))), x AS (SELECT "row", i, (CAST('0x' || substr(md5("row" || ':' || i || ':5'), 1, 12) AS BIGINT) + 1) / 281474976710656.0 AS u, (CAST('0x' || substr(md5("row" || ':' || i || ':6'), 1, 12) AS BIGINT) + 1) / 281474976710656.0 AS v FROM c, range(3) r(i))
SELECT "row", i, round(u, 6) AS even, round(sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS normal FROM x""")
def random_cells(spark, d):
    """Uniform and normal random cells, as many rows as there are documents."""
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    a, b = (splits.random_matrix(spark, n, 3, normal=x, seed=5).select("row", F.posexplode("values").alias("i", name)) for x, name in ((False, "even"), (True, "normal")))
    return a.join(b, ["row", "i"]).select("row", F.col("i").cast("long").alias("i"), r(F.col("even")).alias("even"), r(F.col("normal")).alias("normal"))


@query("longest_texts", """SELECT doc_id, len(regexp_split_to_array(text, '[ \\n]+')) AS n, row_number() OVER (ORDER BY len(regexp_split_to_array(text, '[ \\n]+')) DESC, doc_id) - 1 AS place FROM documents""")
def longest_texts(spark, d):
    """Texts by falling number of tokens."""
    rows = splits.longest_first(contents(spark, d).select("tweet_id", "tokens"), "tokens", "tweet_id")
    return rows.select(F.col("tweet_id").alias("doc_id"), F.size("tokens").cast("long").alias("n"), "place")


@query("labelled_predictions", BASE + _PRED + """SELECT engage_index, action, model, round(score, 6) AS score, label FROM pred""")
def labelled_predictions(spark, d):
    """Predictions joined with labels, of which none may lack one."""
    preds = keyed(spark, d)
    truth = preds.filter("model = 'm0'").select("tweet_id", "user_id", "action", "label")
    own = preds.drop("label")
    return blend.labelled(own, truth, ["tweet_id", "user_id", "action"]).select("engage_index", "action", "model", r(F.col("score")).alias("score"), "label")


@query("feature_ranks")
def feature_ranks(spark, d):
    """Importance of history features in boosted trees, and the round that did best on the validation rows."""
    rows = history_features(spark, d)
    cols = ["user_total", "user_pos", "user_ratio", *[f"with_{a}_n" for a in ACTIONS]]
    model = models.train_trees(rows.filter("split = 'train'"), cols, "like_label", depth=3, rounds=5)
    best = models.validation_curve(model, rows.filter("split = 'valid'")).withColumn("run", F.lit(0))
    best = metrics.best_iteration(best, "run").select("iteration")
    ranked = [(i, *x) for i, x in enumerate(models.importances(model, cols))]
    return spark.createDataFrame(ranked, "rank int, feature string, importance double").join(best)


_ROLE = "SELECT {k} AS id, count(*) AS total, count(coalesce(reply_ts, retweet_ts, comment_ts, like_ts)) AS pos FROM hist GROUP BY {k}"


@query("role_features", BASE + f""", u AS ({_ROLE.format(k='user_id')}), c AS ({_ROLE.format(k='creator_id')})
SELECT engage_index, coalesce(uu.total, 0) AS user_as_user, coalesce(uu.pos, 0) AS user_as_user_pos, coalesce(uc.total, 0) AS user_as_creator, coalesce(uc.pos, 0) AS user_as_creator_pos,
 coalesce(cu.total, 0) AS creator_as_user, coalesce(cu.pos, 0) AS creator_as_user_pos, coalesce(cc.total, 0) AS creator_as_creator, coalesce(cc.pos, 0) AS creator_as_creator_pos
FROM tgt LEFT JOIN u uu ON uu.id = user_id LEFT JOIN c uc ON uc.id = user_id LEFT JOIN u cu ON cu.id = creator_id LEFT JOIN c cc ON cc.id = creator_id""")
def role_features(spark, d):
    """Counts of a row's user and creator in both roles."""
    _, target, hist, _, _ = parts(spark, d)
    out, names = target.select("engage_index", "user_id", "creator_id"), []
    for who in ("user", "creator"):
        for role in ("user", "creator"):
            name = f"{who}_as_{role}"
            counts = history.impression_counts(hist, f"{role}_id", name).select(F.col(f"{role}_id").alias(f"{who}_id"), F.col(f"{name}_total").alias(name), f"{name}_pos")
            out, names = history.attach(out, counts, f"{who}_id"), [*names, name, f"{name}_pos"]
    return out.select("engage_index", *names)


_STA = ", st AS (SELECT doc_id AS tweet_id, length(text) AS chars FROM documents), sc AS (SELECT creator_id AS id, avg(chars) AS x FROM hact JOIN st USING (tweet_id) GROUP BY 1), su AS (SELECT user_id AS id, avg(chars) AS x FROM hact JOIN st USING (tweet_id) GROUP BY 1)"


@query("role_statistics", BASE + _STA + """ SELECT engage_index, round(coalesce(a.x, 0), 4) AS creator_created, round(coalesce(b.x, 0), 4) AS user_created, round(coalesce(c.x, 0), 4) AS user_engaged FROM tgt LEFT JOIN sc a ON a.id = creator_id LEFT JOIN sc b ON b.id = user_id LEFT JOIN su c ON c.id = user_id""")
def role_statistics(spark, d):
    """Mean text size of what a row's creator and user made and of what its user acted on."""
    _, target, hist, _, _ = parts(spark, d)
    stats = contents(spark, d).select("tweet_id", F.length("text").alias("chars"))
    out = target.select("engage_index", "user_id", "creator_id")
    for name, entity, key in (("creator_created", "creator_id", "creator_id"), ("user_created", "creator_id", "user_id"), ("user_engaged", "user_id", "user_id")):
        own = history.mean_statistics(hist, stats, entity, ["chars"]).select(F.col(entity).alias(key), F.col("chars").alias(name))
        out = history.attach(out, own, key)
    return out.select("engage_index", *[r(F.col(c), 4).alias(c) for c in ("creator_created", "user_created", "user_engaged")])


@query("chunk_id_sets", BASE + _FIRST + """SELECT DISTINCT chunk, tweet_id FROM (SELECT engage_index % 3 AS chunk, tweet_id FROM tgt UNION ALL SELECT tgt.engage_index % 3, g.tweet_id FROM tgt JOIN g USING (user_id))""")
def chunk_id_sets(spark, d):
    """Items a chunk of target rows needs: its own and those of its users' histories."""
    _, target, hist, _, _ = parts(spark, d)
    past = history.first_distinct_items(hist).withColumn("items", history.pad(F.col("items")))
    return ids.chunk_ids(target.withColumn("chunk", F.col("engage_index") % 3), past, "chunk", "tweet_id", "user_id", "items")


@query("month_ends", """SELECT o_orderkey, CAST(last_day(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH) AS VARCHAR) AS ahead, CAST(last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH) AS VARCHAR) AS back, strftime(last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) + INTERVAL 47410 SECOND, '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def month_ends(spark, d):
    """Last days of months around each order, as a date and with a time of day."""
    day = F.to_date("o_orderdate")
    at = F.timestamp_seconds(F.unix_timestamp(day) + 47410)
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", history.month_end(day, 2).cast("string").alias("ahead"), history.month_end(day, -1).cast("string").alias("back"), F.date_format(history.month_end_time(at, 1), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("dated_rows", BASE + """, a AS (SELECT user_id AS "row", tweet_id AS col, count(*) AS value, max(t) AS date FROM imp GROUP BY ALL) SELECT date > cut AS late, count(DISTINCT "row") AS rows, count(*) AS entries, CAST(sum(value) AS BIGINT) AS total FROM a, lim GROUP BY 1""")
def dated_rows(spark, d):
    """Entries after the cut-off and up to it, and the rows that keep any."""
    imps = from_events(spark, d)
    cut = bounds(imps)[1] - splits.CUTOFF_BEFORE_END
    m = imps.groupBy(F.col("user_id").alias("row"), F.col("tweet_id").alias("col")).agg(F.count("*").alias("value"), F.max("t").alias("date"))
    each = [transforms.dated(m, cut, after=x).select(F.lit(x).alias("late"), "row", "value") for x in (True, False)]
    return each[0].unionByName(each[1]).groupBy("late").agg(F.count_distinct("row").alias("rows"), F.count("*").alias("entries"), F.sum("value").alias("total"))


@query("restricted_vectors", """WITH w AS (SELECT doc_id * 3 AS id FROM documents) SELECT (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT id FROM w)) AS kept, (SELECT count(*) FROM w WHERE id NOT IN (SELECT vec_id FROM embeddings)) AS skipped""")
def restricted_vectors(spark, d):
    """Vectors of wanted ids, and how many wanted ids have none."""
    wanted = spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") * 3).alias("id"))
    kept, missing = embeddings.restricted(vectors(spark, d), wanted)
    return kept.agg(F.count("*").alias("kept")).join(missing.agg(F.count("*").alias("skipped")))


@query("token_rows", BASE + _CON + """, c AS (SELECT DISTINCT engage_index % 3 AS chunk, tweet_id FROM imp), n AS (SELECT chunk, tweet_id, row_number() OVER (PARTITION BY chunk ORDER BY tweet_id) - 1 AS "row" FROM c) SELECT chunk, "row", tweet_id, len(tokens) AS n FROM n JOIN con USING (tweet_id)""")
def token_rows(spark, d):
    """Tokens of chunk rows by way of the rows' ids."""
    id_map = ids.chunk_row_ids(from_events(spark, d).withColumn("chunk", F.col("engage_index") % 3), "chunk", "tweet_id")
    rows = id_map.select("chunk", "row").withColumn("at", F.struct("chunk", "row")).select("at")
    named = id_map.select(F.struct("chunk", "row").alias("at"), "tweet_id")
    out = ids.two_hops(rows, named, contents(spark, d).select("tweet_id", F.size("tokens").cast("long").alias("n")), "at", "tweet_id")
    return out.select("at.chunk", "at.row", "tweet_id", "n")


@query("neighbour_report", BASE + _NRM + """, sc AS (SELECT w.user_id, w.creator_id, coalesce(sum(x.v * y.v), 0) AS score FROM want w LEFT JOIN cnt c ON c.user_id = w.user_id LEFT JOIN n2 x ON x.creator_id = c.creator_id LEFT JOIN n2 y ON y.creator_id = w.creator_id AND y.user_id = x.user_id GROUP BY ALL),
p0 AS (SELECT a.action, engage_index, round(score, 9) AS score, CAST(CASE a.action WHEN 'reply' THEN reply_ts WHEN 'retweet' THEN retweet_ts WHEN 'comment' THEN comment_ts ELSE like_ts END IS NOT NULL AS INT) AS label FROM tgt JOIN sc USING (user_id, creator_id), (VALUES ('reply'), ('retweet'), ('comment'), ('like')) a(action) WHERE split = 'valid'),
w AS (SELECT action, sum(label) OVER x * 1.0 / row_number() OVER x AS p, sum(label) OVER x * 1.0 / nullif(sum(label) OVER (PARTITION BY action), 0) AS r, row_number() OVER x AS k FROM p0 WINDOW x AS (PARTITION BY action ORDER BY score DESC, engage_index ROWS UNBOUNDED PRECEDING)),
a AS (SELECT action, (r - lag(r) OVER x) * (p + lag(p) OVER x) / 2 AS a FROM w WINDOW x AS (PARTITION BY action ORDER BY k)) SELECT action, round(coalesce(sum(a), 0), 5) AS pr_auc FROM a GROUP BY action""")
def neighbour_report(spark, d):
    """Neighbour scores alone, evaluated on the validation rows."""
    _, target, hist, _, _ = parts(spark, d)
    out = similarity.evaluate_scores(history.interactions(hist), labels(target.filter("split = 'valid'")))
    return out.withColumn("pr_auc", r(F.col("pr_auc"), 5))
