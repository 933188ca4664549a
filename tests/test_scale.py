"""Window histories, incremental ids, grids for heavy keys and distributed factors against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors, increments, metrics, order, similarity, windows
from tidemark.operators.impressions import ACTIONS

IMP = "engage_index long, user_id long, tweet_id long, creator_id long, t long, tweet_ts long, reply_ts long, retweet_ts long, comment_ts long, like_ts long, follow boolean"


def made_log(n=400, seed=0):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        t = rnd.randrange(1000)
        acts = [t + rnd.randrange(300) if rnd.random() < 0.25 else None for _ in ACTIONS]
        rows.append((i, 7 if rnd.random() < 0.5 else rnd.randrange(12), rnd.randrange(30), rnd.randrange(4), t, t, *acts, True))
    return rows


def test_every_window_sees_its_own_history(spark):
    rows, cut, step, n = made_log(), 900, 150, 4
    masked = windows.with_mask(spark.createDataFrame(rows, IMP), cutoff=cut, interval=step, n=n)
    got = windows.window_features(masked, start=0, unit=10.0, n=n).collect()

    def split(r, i):
        acts, start, end = [t for t in r[6:10] if t is not None], cut - (i + 1) * step, cut - i * step
        if acts:
            return "valid" if max(acts) > cut else "train" if any(start < t <= end for t in acts) else None
        return "valid" if r[5] > cut else "train" if start < r[5] < end else None

    want = {(i, r[0]): split(r, i) for i in range(n) for r in rows if split(r, i) == "train" or (split(r, i) == "valid" and i == 0)}
    assert {(g["chunk"], g["engage_index"]): g["split"] for g in got} == want
    for g in got:
        hist = [r for r in rows if split(r, g["chunk"]) is None]
        for prefix, own in (("u", [r for r in hist if r[1] == g["user_id"]]), ("c", [r for r in hist if r[3] == g["creator_id"]]),
                            ("with", [r for r in hist if r[1] == g["user_id"] and r[3] == g["creator_id"]])):
            assert g[f"{prefix}_total"] == len(own) and g[f"{prefix}_pos"] == sum(any(t is not None for t in r[6:10]) for r in own)
            for k, a in enumerate(ACTIONS):
                at = [r[6 + k] for r in own if r[6 + k] is not None]
                assert g[f"{prefix}_{a}_n"] == len(at) and g[f"{prefix}_{a}_last"] == max(at, default=0) / 10


def test_masks_hold_thirty_windows(spark):
    with pytest.raises(ValueError, match="30"):
        windows.with_mask(spark.createDataFrame([], IMP), cutoff=1, n=31)


def test_unseen_ids_by_chunk(spark, tmp_path):
    state = increments.SeenIds(spark, f"file://{tmp_path}/seen", "id", words=64)  # so few words that most ids are false alarms
    rnd, seen = random.Random(1), set()
    chunks = [[(rnd.randrange(300), j) for j in range(120)] + [(None, 1)] for _ in range(4)]
    for no, rows in enumerate([*chunks[:2], chunks[1], *chunks[2:]]):
        no = no if no < 2 else no - 1
        before = {i for c in chunks[:no] for i, _ in c}
        want = {i: min(j for k, j in rows if k == i) for i, _ in rows if i is not None and i not in before}
        got = state.add(spark.createDataFrame(rows, "id long, row long"), no)
        assert got.columns == ["id", "row"] and {r["id"]: r["row"] for r in got.collect()} == want
        seen |= set(want)
    assert state.add(spark.createDataFrame([], "id long, row long"), 4).count() == 0
    assert state.add(spark.createDataFrame([(i, 0) for i in seen] + [(10_000, 5)], "id long, row long"), 5).collect() == [(10_000, 5)]


def test_filters_have_no_false_negatives(spark):
    ids = spark.range(5000).select(F.col("id") * 7919)
    table = increments.bloom(ids.toDF("id"), "id", 256)
    hit = ids.toDF("id").withColumn("place", increments.bloom_place(F.col("id"), 256)).join(table, "place", "left")
    assert hit.filter(F.col("bits").bitwiseAND(increments.bloom_bits(F.col("id"))) == increments.bloom_bits(F.col("id"))).count() == 5000
    assert table.count() <= 256


def test_streamed_ids_survive_a_restart(spark, tmp_path):
    src, sink, state = (f"file://{tmp_path}/{x}" for x in ("src", "sink", "state"))
    for part in ([(1, 0), (2, 0), (1, 0), (None, 0)], [(2, 1), (3, 1)], []):
        df = spark.createDataFrame(part, "id long, run int")
        df.write.mode("append").parquet(src)
        increments.stream_unseen(spark, src, df.schema, "id", sink, state).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, 0), (2, 0), (3, 1)]


@pytest.mark.parametrize("heavy", [5, 40, 100_000])
def test_grid_join_of_a_heavy_key(spark, heavy):
    """One key holds half of the rows of both sides."""
    rnd = random.Random(heavy)
    a = [(0 if i % 2 else rnd.randrange(20), i) for i in range(150)] + [(None, 900)]
    b = [(0 if i % 2 else rnd.randrange(20), -i) for i in range(90)] + [(None, -900)]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    got = similarity.grid_join(left, right, "k", "x", "y", heavy)
    assert got.columns == ["k", "x", "y"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, x, y) for k, x in a for j, y in b if k == j and k is not None)


def test_scores_with_a_user_who_holds_half_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HEAVY", 6)
    rnd = random.Random(2)
    count = {}
    for _ in range(300):
        key = (1 if rnd.random() < 0.5 else rnd.randrange(10), rnd.randrange(25))
        count[key] = count.get(key, 0) + 1
    df = spark.createDataFrame([(u, c, n) for (u, c), n in count.items()], "user_id long, creator_id long, n long")
    m = np.zeros((25, 10))
    for (u, c), n in count.items():
        m[c, u] = n
    norm = np.linalg.norm(m, axis=0)
    m = m / np.where(norm > 1e-10, norm, 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm > 1e-5, norm, 1)
    want = {(u, c): sum(m[k] @ m[c] for k in range(25) if (u, k) in count) for u in range(10) for c in range(25)}
    pairs = spark.createDataFrame([(u, c) for u in range(10) for c in range(25)], "user_id long, creator_id long")
    got = {(r["user_id"], r["creator_id"]): r["score"] for r in similarity.item_scores(df, pairs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    long = df.select(F.col("user_id").alias("row"), F.col("creator_id").alias("col"), F.col("n").cast("double").alias("value"))
    x = np.zeros((10, 25))
    for (u, c), n in count.items():
        x[u, c] = n
    got = {(r["row"], r["col"]): r["value"] for r in similarity.gram(long).collect()}
    assert all(abs(got.get((i, j), 0.0) - (x.T @ x)[i, j]) < 1e-9 for i in range(25) for j in range(25))


def test_factors_equal_numpy(spark):
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 30)) * (np.arange(1, 31) / 5) * 3
    dense[:, 4] = 0
    rows = [(i + 1000, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    s, left, right = factors.low_rank(spark.createDataFrame(rows, "row int, col long, value double"), 5, more=4)
    want = np.linalg.svd(dense)[1][:5]
    assert np.allclose(s, want, rtol=1e-9)
    u, v = np.zeros((80, 5)), np.zeros((30, 5))
    for r in left.collect():
        u[r["index"] - 1000] = r["vec"]
    for r in right.collect():
        v[r["index"]] = r["vec"]
    assert np.allclose(u.T @ u, np.eye(5), atol=1e-8) and np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    assert np.allclose(u.T @ dense @ v, np.diag(s), atol=1e-6)
    assert len(factors.low_rank(spark.createDataFrame([], "row int, col long, value double"), 3)[0]) == 0


def test_positions_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        order.shared_folder(Session)
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        order.shared_folder(Session)
    Context.master = "local[4]"
    assert order.shared_folder(Session).startswith("file:///tmp/")


def test_running_sums_of_rows_that_tie(spark):
    """Nine of ten rows have score 0: they are cut by their key, and no range holds more than its share."""
    rnd = random.Random(9)
    rows = [("ab"[i % 2], i, 0.0 if rnd.random() < 0.9 else rnd.randrange(50) / 10, rnd.randrange(2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "action string, key int, score double, label int")
    got = {r["key"]: (r["label_upto"], r["n_upto"]) for r in metrics.running(df.withColumn("n", F.lit(1)), "action", "score", ["label", "n"], "key").collect()}
    for a in "ab":
        tp = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == a), key=lambda r: (-r[2], r[1])), 1):
            tp += r[3]
            assert got[r[1]] == (tp, n)
    plan = metrics.running(df.withColumn("n", F.lit(1)), "action", "score", ["label", "n"], "key")
    assert "_sub" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_scores_cost_users_histories_not_creators_users(spark, monkeypatch):
    """Every user acted with all of four creators: pairs of creators meet over users, no user meets all other users."""
    made, join = [], similarity.grid_join

    def counted(*args, **more):
        out = join(*args, **more)
        made.append(out.count())
        return out

    monkeypatch.setattr(similarity, "grid_join", counted)
    df = spark.range(1000).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("creator_id"), F.lit(2).cast("long").alias("n"))
    got = [r["score"] for r in similarity.item_scores(df, df.filter("user_id < 50")).collect()]
    assert len(got) == 200 and all(abs(x - 4.0) < 1e-9 for x in got)
    assert max(made) <= 1000 * 4 * 4


def test_cuts_of_running_sums_are_made_once(spark):
    """Ranges of rows and their totals must come from the same cuts; a sketch that is worked out again may give others."""
    df = spark.range(300).select(F.lit("a").alias("action"), F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("score"), F.lit(1).alias("n"))
    for ties in (None, "key"):
        plan = metrics.running(df, "action", "score", ["n"], ties)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx" not in plan


@pytest.mark.parametrize("name", ["encode_tokens", "token_tfidf", "decode_whole", "masked_tokens"])
def test_tokens_are_not_shuffled(spark, name):
    """Texts are dealt by item once; tokens meet a broadcast dictionary where they are."""
    from tidemark.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan


def test_labels_are_joined_once(spark):
    """The check that no prediction lacks a label reads the joined rows; the result isn't joined again."""
    from tidemark.operators import blend
    from tidemark.plans import registry

    assert "Join" not in registry.QUERIES["labelled_predictions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    preds = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, score double")
    truth = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "k int, label int")
    assert sorted(tuple(r) for r in blend.labelled(preds, truth, ["k"]).collect()) == [(1, 0.5, 1), (2, 0.25, 0)]
    with pytest.raises(ValueError, match="without a label"):
        blend.labelled(preds, truth.filter("k = 1"), ["k"])


def test_profiles_are_a_row_a_user(spark):
    """Vectors wider than a block and of two lengths; an element's mean is over those that have it."""
    from tidemark.operators import embeddings, impressions

    vecs = {1: [1.0] * 70, 2: [2.0] + [0.0] * 69, 3: [0.0, 3.0]}
    times = {f"{a}_ts": F.lit(None).cast("long") for a in impressions.ACTIONS} | {"like_ts": F.lit(5).cast("long")}
    acted = [(7, 1), (7, 2), (7, 3), (8, 3), (8, 99)]
    hist = spark.createDataFrame(acted, "user_id long, tweet_id long").withColumns(times)
    got = {r["user_id"]: r["profile"] for r in embeddings.profiles(hist, spark.createDataFrame(list(vecs.items()), "id long, vec array<double>")).collect()}
    one = 70 ** -0.5
    assert np.allclose(got[7], [(one + 1) / 3, (one + 1) / 3] + [one / 2] * 68) and np.allclose(got[8], [0.0, 1.0]) and len(got) == 2


def test_large_vocabularies_are_looked_up_in_groups(spark, monkeypatch):
    """What a broadcast vocabulary gives, without exchanging tokens one by one: keys that repeat or are null, arrays that are
    empty or null, null and unknown tokens."""
    from tidemark.functions import text as tx
    from tidemark.operators import ids

    rnd = random.Random(2)
    data = [(rnd.choice([None, *range(60)]), rnd.choice([None, [], *[[rnd.choice([None, *"abcdefghij"]) for _ in range(rnd.randrange(1, 9))]] * 8])) for _ in range(200)]
    data += [(100, ["zz", None]), (101, ["<unk>"] * 3)]
    df = spark.createDataFrame(data, "k long, w array<string>").repartition(3)
    known = spark.createDataFrame([(c, i) for i, c in enumerate("acdeghi", 1)], "piece string, token_id long")
    vocab = known.unionByName(spark.createDataFrame([("<unk>", 0)], "piece string, token_id long"))

    def both():
        enc = tx.encode(df, "k", "w", known, most=None)
        dec = tx.decode(enc.withColumn("ids", F.concat("ids", F.array(F.lit(77).cast("long")))), "k", "ids", vocab, size="n")
        plans = "".join(x._jdf.queryExecution().executedPlan().toString() for x in (enc, dec))
        return [sorted(map(repr, map(tuple, x.collect()))) for x in (enc, dec)], plans

    want, _ = both()
    assert len(want[0]) == len({k for k, w in data if w}) and any("None" in x for x in want[0])
    parts = [ids.looked_up(df, "k", "w", known, "piece", "token_id", missing=0, cells=n) for n in (1, 7, 1000)]
    gone = ids.looked_up(df, "k", "w", known, "piece", "token_id", cells=5).collect()
    assert all(sorted(map(repr, map(tuple, x.collect()))) == want[0] for x in parts)
    assert {r[0]: [i for i in r[1]] for r in gone} == {k: [i for i in v if i] for k, v in map(eval, want[0]) if any(v)}
    monkeypatch.setattr(order, "BROADCAST_ROWS", 3, raising=False)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, plans = both()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert got == want and "Generate" not in plans


@pytest.mark.parametrize("name", ["decode_whole", "encode_decode", "masked_tokens"])
def test_queries_by_a_large_vocabulary(spark, monkeypatch, name):
    from tidemark.plans import registry

    want = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(order, "BROADCAST_ROWS", 10, raising=False)
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema.simpleString() == want.schema.simpleString()


@pytest.mark.parametrize("most", [10, 0])
def test_texts_that_use_marks_of_pieces(spark, tmp_path, monkeypatch, most):
    """A text's own <unk> is one token, whether or not it is frequent; words that begin with ## are words."""
    import duckdb

    from tidemark.plans import registry

    texts = ["<unk> <unk> a a a", "<unk> <unk> <unk> b", "a a b  c\n", "", None, "## ##d ## ##d\n##d ## ##d ## ##d ##"]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(order, "BROADCAST_ROWS", most, raising=False)
    for name in ("decode_whole", "encode_decode", "masked_tokens"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
