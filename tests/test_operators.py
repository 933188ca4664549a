"""Hand-made frames with worked results for rules that the tables don't exercise."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import blend, embeddings, history, ids, impressions, metrics, models, order, similarity, splits, transforms
from tidemark.sources import readers, writers


def rows(df, *order_by):
    return [tuple(r) for r in (df.orderBy(*order_by) if order_by else df).collect()]


IMP = "engage_index long, user_id long, tweet_id long, creator_id long, t long, tweet_ts long, reply_ts long, retweet_ts long, comment_ts long, like_ts long, follow boolean"


@pytest.fixture(scope="module")
def imps(spark):
    return spark.createDataFrame([
        (0, 1, 10, 5, 100, 100, None, None, None, None, True),
        (1, 1, 11, 5, 200, 200, 200, None, None, 210, False),
        (2, 2, 10, 5, 300, 100, None, 300, None, None, True),
        (3, 2, 12, 1, 400, 400, 400, 401, 402, 403, True),
    ], IMP)


def test_labels_and_unpivot(spark, imps):
    got = rows(impressions.labels(imps).select("engage_index", "reply_label", "like_label", "negative"), "engage_index")
    assert got == [(0, 0, 0, True), (1, 1, 1, False), (2, 0, 0, False), (3, 1, 1, False)]
    assert impressions.unpivot_actions(imps).count() == 7
    before = imps.select("engage_index", impressions.all_before(F.lit(300)).alias("b"), impressions.all_before(F.lit(-1)).alias("n"))
    assert rows(before, "engage_index") == [(0, True, True), (1, True, True), (2, False, True), (3, False, True)]


def test_split_bounds(spark, imps):
    # positives: an action after the cut-off, else in (start, end]; negatives by creation, strictly inside
    for start, end, cut, want in [(99, 300, 350, ["train", "train", "train", "valid"]), (100, 200, 300, [None, "train", None, "valid"])]:
        got = imps.withColumn("s", splits.split_by_create_date(imps, start=start, end=end, cutoff=cut)).orderBy("engage_index")
        assert [r["s"] for r in got.collect()] == want


def test_history_is_leakage_free(spark, imps):
    target = imps.filter("engage_index = 3")
    hist = history.history(imps, target)
    assert hist.count() == 3
    counts = rows(history.impression_counts(hist, "user_id", "u"), "user_id")
    assert counts == [(1, 2, 1, 0.5), (2, 1, 1, 1.0)]
    assert rows(history.interactions(hist), "user_id") == [(1, 5, 2), (2, 5, 1)]
    out = history.attach(imps, history.impression_counts(hist.filter("user_id = 1"), "user_id", "u"), "user_id").filter("user_id = 2")
    assert {r["u_total"] for r in out.collect()} == {0}


def test_first_distinct_items_counts_repeats(spark):
    data = [(i, 1, [7, 7, 8, 9, 7, 10][i], 5, i, 0, i, None, None, None, True) for i in range(6)]
    got = history.first_distinct_items(spark.createDataFrame(data, IMP), most=3).first()
    assert got["items"] == [7, 7, 8]
    padded = spark.createDataFrame([([3],)], "x array<long>").select(history.pad(F.col("x"), 3).alias("p")).first()
    assert padded["p"] == [3, -1, -1]


def test_dictionaries(spark):
    df = spark.createDataFrame([(0, "b", ["x", "y", "x"]), (1, "a", ["y", "z"]), (2, None, None)], "row long, c string, toks array<string>")
    assert rows(ids.assign_ids(df, ["c"], "row"), "index") == [("b", 0), ("a", 1)]
    dic = spark.createDataFrame([("x", 0), ("y", 1)], "category string, cat long")
    assert rows(ids.encode_multihot(df, "row", "toks", dic), "row", "cat") == [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 1.0)]
    more = ids.dictionary(spark.createDataFrame([("y",), ("w",)], "v string"), "v", preset=dic)
    assert rows(more, "cat") == [("x", 0), ("y", 1), ("w", 2)]
    kept, names = ids.select_columns(ids.encode_multihot(df, "row", "toks", dic), "row", 1)
    assert rows(kept.select("row", "cat", "value"), "row") == [(0, 0, 1.0), (1, 0, 1.0)]
    assert rows(ids.feature_names(spark.createDataFrame([("a b", 0)], "category string, cat long"), "p")) == [(0, "p_a_b")]
    assert ids.width(kept, dic) == 2
    assert rows(ids.encode_numeric(spark.createDataFrame([(1, 0.0, 2.0)], "row long, a double, b double"), "row", ["a", "b"])) == [(1, 1, 2.0)]


def test_global_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = rows(order.global_index(df, "k", name="i"), "k")
    assert [i for _, i in got] == list(range(1000))


def test_text_rules(spark):
    t = "RT @ a_b : [CLS] Hello @ bob WORLD 12 , see https : / / t. co / xyz # tag it's"
    c = spark.createDataFrame([(t,)], "t string")
    got = c.select(
        tx.main_mention(F.col("t")).alias("m"), tx.other_mentions(F.col("t")).alias("o"), tx.hashtags(F.col("t")).alias("h"),
        tx.first_url(F.col("t")).alias("u"), tx.clean_line(F.col("t")).alias("c"), tx.clean_variant(F.col("t"), replace=True).alias("r"),
        tx.repair_underscores(F.lit("a _b c_ d")).alias("us"),
    ).first()
    assert got["m"] == "a_b" and got["o"] == ["bob"] and got["h"] == ["tag"] and got["u"] == "https : / / t. co / xyz"
    assert got["c"] == "Hello WORLD 12 , see  # tag it's" and got["us"] == "a_b c_d"
    assert got["r"] == "<mention> Hello <mention> WORLD 12 , see <url> <hashtag> tag it's"
    s = spark.range(1).select(tx.statistics(F.lit("Hi YOU 12, it's |")).alias("s")).first()["s"]
    # signs , ' | ; tokens Hi YOU 12 its | ; those without a lower-case letter: YOU 12 |
    assert tuple(s) == (3.0, 5.0, 2.0, 3.0, 3.0, 2.2)
    empty = spark.range(1).select(tx.statistics(F.lit("")).alias("s")).first()["s"]
    assert tuple(empty) == (0.0,) * 6
    grams = spark.range(1).select(tx.analyze(F.lit("fooBar3 Éa")).alias("a"), tx.char_ngrams(F.array(F.lit("abc"), F.lit("x")), 2, 3).alias("g")).first()
    assert grams["a"] == ["foo", "bar", "3", "ea"] and grams["g"] == ["ab", "bc", "abc"]


def test_token_ids_and_masks(spark):
    vocab = spark.createDataFrame([("un", 1), ("##do", 2), ("it", 3), ("[UNK]", 0)], "piece string, token_id int")
    df = spark.createDataFrame([(1, ["un", "##do", "zz", "it"])], "k long, toks array<string>")
    enc = tx.encode(df, "k", "toks", vocab, most=3)
    assert rows(enc) == [(1, [1, 2, 0])]
    assert rows(tx.decode(enc, "k", "ids", vocab)) == [(1, "undo [UNK]")]
    big = spark.createDataFrame([(i, list(range(200))) for i in range(20)], "k long, ids array<int>")
    a, b = (tx.mask_tokens(big, "k", "ids", mask=3, size=200, special=5) for _ in range(2))
    assert rows(a, "k") == rows(b, "k")
    lab = [x for r in a.collect() for i, x in zip(range(200), r["labels"], strict=True)]
    assert 0.12 < sum(x != -100 for x in lab) / len(lab) < 0.18 and not any(0 <= x < 5 for x in lab)


def test_scalers(spark):
    m = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0), (1, 1, 5.0), (2, 1, 5.0)], "row long, col long, value double")
    assert rows(transforms.min_max(m).apply(m), "row", "col") == [(0, 0, 0.0), (1, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0)]
    # column 1 is constant and near its mean: its values go
    assert rows(transforms.standardise(m).apply(m), "row") == [(0, 0, -1.0), (1, 0, 1.0)]
    clip = transforms.outlier_clip(m, 0.1).apply(m)
    assert rows(clip, "row", "col")[:2] == [(0, 0, 4.0), (1, 0, 2.0)] or rows(clip, "row", "col")[0][2] in (2.0, 4.0)
    ident = spark.range(1).select(transforms.yeo_johnson(F.lit(3.0), F.lit(1.0)).alias("a"), transforms.yeo_johnson(F.lit(-2.0), F.lit(1.0)).alias("b"))
    assert tuple(ident.first()) == (3.0, -2.0)
    dense = transforms.to_dense(m, 3)
    assert rows(dense, "row") == [(0, [2.0, 0.0, 0.0]), (1, [4.0, 5.0, 0.0]), (2, [0.0, 5.0, 0.0])]
    assert transforms.to_sparse(dense, "row", "vec").count() == 4
    norm = rows(transforms.row_norm(m), "row", "col")
    assert norm[0][2] == 1.0 and abs(norm[1][2] ** 2 + norm[2][2] ** 2 - 1) < 1e-12


def test_metrics_with_ties_and_one_class(spark):
    data = [("a", 0, 1, 0.9), ("a", 1, 0, 0.9), ("a", 2, 1, 0.1), ("b", 3, 1, 0.5), ("b", 4, 1, 0.4), ("c", 5, 0, 0.3)]
    df = spark.createDataFrame(data, "action string, k long, label int, score double")
    auc = dict(rows(metrics.pr_auc(df)))
    assert abs(auc["a"] - (0.5 * (1 + 0.5) / 2 + 0.5 * (0.5 + 2 / 3) / 2)) < 1e-12 and auc["b"] == 1.0 and auc["c"] == 0.0
    rce = {r["action"]: r["rce"] for r in metrics.relative_cross_entropy(df).collect()}
    assert rce["b"] is None and rce["c"] is None and rce["a"] < 0
    ranks = rows(metrics.rank_desc(df.filter("action = 'a'"), "action", "score").select("k", "rank"), "k")
    assert ranks == [(0, 1), (1, 1), (2, 3)]


def test_blend(spark):
    p = spark.createDataFrame([(1, 1, "like", "m0", 0.5), (1, 1, "like", "m1", 0.7), (2, 1, "like", "m0", 0.4)], "tweet_id long, user_id long, action string, model string, score double")
    assert blend.merge(p, ["m0", "m1"]).count() == 1
    assert rows(blend.merge(p, ["m0", "m1"], complete=False), "tweet_id")[1][-1] == 0.0
    with pytest.raises(ValueError):
        blend.check_complete(p, p.filter("tweet_id = 1").select("tweet_id"), ["tweet_id"])
    one = blend.scale(p.filter("model = 'm0' and tweet_id = 1"), {"like": 2.0}, {}).first()["score"]
    assert abs(one - 0.5) < 1e-12


def test_similarity(spark):
    row = spark.createDataFrame([(["a", "b", "b"], ["b", "c"])], "x array<string>, y array<string>")
    got = row.select(similarity.overlap(F.col("x"), F.col("y")), similarity.overlap(F.col("x"), F.col("y"), scaled=True), similarity.overlap(F.col("x"), F.lit(None).cast("array<string>")),
                     similarity.same(F.lit("a"), F.lit(None))).first()
    assert tuple(got) == (1, 0.25, 0, 0)
    counts = spark.createDataFrame([(1, 5, 3), (1, 6, 4), (2, 6, 1)], "user_id long, creator_id long, n long")
    norm = {(r["row"], r["col"]): r["value"] for r in similarity.normalised(counts).collect()}
    assert abs(norm[5, 1] - 1) < 1e-12 and abs(norm[6, 1] - 0.8 / math.hypot(0.8, 1)) < 1e-12
    scores = rows(similarity.user_scores(counts, counts), "user_id", "creator_id")
    assert scores == [(1, 5, 25.0), (1, 6, 29.0), (2, 6, 5.0)]


def test_embeddings(spark):
    long = spark.createDataFrame([(0, p, 0, v) for p, v in enumerate([9.0, 1.0, 3.0])] + [(1, 0, 0, 4.0)], "seq long, pos long, dim long, value double")
    assert rows(embeddings.pool(long, "mean"), "seq") == [(0, 0, 4 / 3), (1, 0, 0.0)]
    assert rows(embeddings.pool(long, "max")) == [(0, 0, 3.0)]
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, vec array<double>")
    assert rows(v.select("id", embeddings.normalise(F.col("vec"))), "id") == [(1, [0.6, 0.8]), (2, [0.0, 0.0])]
    want = spark.createDataFrame([(1, [3.0]), (2, [1.0]), (3, [0.0])], "id long, head array<double>")
    assert [r["id"] for r in embeddings.check_values(v, want).orderBy("id").collect()] == [2, 3]


def test_sources_and_sinks(spark, tmp_path):
    line = "\u0001".join(["1\t2", "", "T", "", "", "", "TopLevel", "L", "7", "C", "1", "2", "true", "3", "U", "4", "5", "False", "6", "true", "", "9", "", ""])
    (tmp_path / "log").write_text(line + "\n")
    r = readers.read_impressions(spark, str(tmp_path / "log")).first()
    assert r["text_tokens"] == ["1", "2"] and r["hashtags"] is None and r["creator_verified"] == 1 and r["user_verified"] == 0 and r["retweet_ts"] == 9 and r["like_ts"] is None
    (tmp_path / "ids").write_text('a,"x, y"\nb,\n')
    assert rows(readers.read_id_text(spark, str(tmp_path / "ids")), "id") == [("a", '"x, y"'), ("b", "")]
    (tmp_path / "head.csv").write_text("a,b\n 1 ,\n")
    assert rows(readers.read_columns(spark, str(tmp_path / "head.csv"), {"a": "int", "b": "string"})) == [(1, None)]
    with pytest.raises(ValueError):
        readers.read_columns(spark, str(tmp_path / "head.csv"), {"z": "int"})
    m = spark.createDataFrame([(1, 3, 2.0), (1, 0, 0.5)], "row long, col long, value double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "row long, label int")
    assert [r["value"] for r in writers.libsvm_lines(m, labels).orderBy("row").collect()] == ["1 0:0.50000 3:2", "0"]
    with pytest.raises(ValueError):
        writers.embedding_rows(spark.createDataFrame([(0, 1)], "row long, id long"), spark.createDataFrame([(2, [1.0])], "id long, vec array<double>"))
    writers.write_dense_csv(spark.createDataFrame([(1, [0.5], "t"), (0, [1.0, 2.0], "u")], "label int, f array<double>, id string"), str(tmp_path / "d"), labels=["label"], features="f", keys=["id"])
    back = readers.read_feature_csv(spark, str(tmp_path / "d"), [("label", 1, "int"), ("f", 2, "double"), ("id", 1, "string")])
    assert rows(back, "id") == [(1, [0.5, 0.0], "t"), (0, [1.0, 2.0], "u")]


def test_models(spark):
    assert models.without_groups({"a": ["x"], "b": ["y", "z"]}, ["a"]) == ["y", "z"]
    m = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0)], "row long, col long, value double")
    fitted = models.ColumnScaler("min_max").fit(m)
    assert rows(fitted.transform(m), "row") == [(0, 0, 0.0), (1, 0, 1.0)]
    out = models.TextTransform(F.upper, "t", "u").transform(spark.createDataFrame([("a",)], "t string")).first()
    assert out["u"] == "A"


def test_ith_choice(spark):
    got = spark.range(4).select(splits.ith_choice(F.col("id"), 2, 2).alias("c")).collect()
    assert [r["c"] for r in got] == [[0, 0], [1, 0], [0, 1], [1, 1]]
