"""Queries over the driver's tables and the SQL with the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import blend, embeddings, history, ids, metrics, similarity, splits, transforms
from tidemark.operators.order import dealt, stored
from tidemark.operators.impressions import ACTIONS, DAY, HOUR, bounds, contents, from_events, labels, profiles, unpivot_actions

QUERIES, ORACLES = {}, {}

# Fixed value: the epoch second from which ages of accounts are counted.
NOW = 1580947211

_ACT = " UNION ALL ".join(
    f"SELECT engage_index, user_id, tweet_id, creator_id, t, tweet_ts, follow, '{a}' AS action, {a}_ts AS at FROM imp WHERE {a}_ts IS NOT NULL"
    for a in ACTIONS
)
_HIT = " OR ".join(f"coalesce({a}_ts > cut - 86400 AND {a}_ts <= cut, false)" for a in ACTIONS)
_ANY = "greatest(reply_ts, retweet_ts, comment_ts, like_ts)"
_NEG = "coalesce(reply_ts, retweet_ts, comment_ts, like_ts) IS NULL"
BASE = f"""WITH log AS (SELECT event_id AS engage_index, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tweet_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS k, value FROM events),
imp AS (SELECT engage_index, user_id, tweet_id, tweet_id % 20 AS creator_id, t, min(t) OVER (PARTITION BY tweet_id) AS tweet_ts,
  CASE WHEN k = 'error' THEN t END AS reply_ts, CASE WHEN k = 'signup' THEN t END AS retweet_ts,
  CASE WHEN k = 'click' THEN t END AS comment_ts,
  CASE WHEN k = 'purchase' OR (k <> 'view' AND value >= 100) THEN t END AS like_ts, (user_id + tweet_id % 20) % 3 = 0 AS follow FROM log),
lim AS (SELECT min(t) AS t0, max(t) AS t1, max(t) - 14400 AS cut FROM imp),
act AS ({_ACT}),
sp AS (SELECT imp.*, CASE WHEN {_NEG} THEN CASE WHEN tweet_ts > cut THEN 'valid' WHEN tweet_ts > cut - 86400 AND tweet_ts < cut THEN 'train' END
  WHEN {_ANY} > cut THEN 'valid' WHEN {_HIT} THEN 'train' END AS split FROM imp, lim),
hist AS (SELECT * FROM sp WHERE split IS NULL), tgt AS (SELECT * FROM sp WHERE split IS NOT NULL),
hact AS (SELECT act.* FROM act JOIN hist USING (engage_index)),
cnt AS (SELECT user_id, creator_id, count(*) AS n FROM hact GROUP BY ALL)
"""  # fmt: skip


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def stored_log(spark, d):
    """Impressions, stored so that the events are read once; first second, cut-off."""
    imps = stored(from_events(spark, d), "log")
    t0, t1 = bounds(imps)
    return imps, t0, t1 - splits.CUTOFF_BEFORE_END


def parts(spark, d):
    """Impressions, those to predict (first window and validation) with their split, the history, first second, cut-off."""
    imps, t0, cut = stored_log(spark, d)
    own = imps.withColumn("split", splits.split_by_create_date(imps, start=cut - DAY, end=cut, cutoff=cut))
    target = own.filter("split is not null")
    return imps, target, history.history(imps, target), t0, cut


def r(c, n=6):
    return F.round(c, n)


_UA = ", ".join(
    f"count({a}_ts) AS u_{a}_n, coalesce((max({a}_ts) - min(t0)) / 3600.0, 0) AS u_{a}_last, count({a}_ts) * 1.0 / count(*) AS u_{a}_norm" for a in ACTIONS
)
_CA = ", ".join(f"count({a}_ts) AS c_{a}_n, coalesce((max({a}_ts) - min(t0)) / 1.0, 0) AS c_{a}_last" for a in ACTIONS)
_UO = ", ".join(f"coalesce(u_{a}_n, 0) AS u_{a}_n, round(coalesce(u_{a}_last, 0), 6) AS u_{a}_last, round(coalesce(u_{a}_norm, 0), 6) AS u_{a}_norm" for a in ACTIONS)
_CO = ", ".join(f"coalesce(c_{a}_n, 0) AS c_{a}_n, round(coalesce(c_{a}_last, 0), 6) AS c_{a}_last" for a in ACTIONS)
_WO = ", ".join(f"coalesce(w_{a}, 0) AS with_{a}_n" for a in ACTIONS)
_WC = ", ".join(f"count({a}_ts) AS w_{a}" for a in ACTIONS)


@query("history_features", BASE + f""", u AS (SELECT user_id, count(*) AS total, count(coalesce(reply_ts, retweet_ts, comment_ts, like_ts)) AS pos, {_UA}
  FROM hist, lim GROUP BY user_id), c AS (SELECT creator_id, {_CA} FROM hist, lim GROUP BY creator_id),
w AS (SELECT user_id, creator_id, {_WC} FROM hist GROUP BY ALL)
SELECT tgt.engage_index, tgt.user_id, tgt.creator_id, split, CAST(reply_ts IS NOT NULL AS INT) AS reply_label, CAST(like_ts IS NOT NULL AS INT) AS like_label,
 coalesce(total, 0) AS user_total, coalesce(pos, 0) AS user_pos, round(coalesce(pos * 1.0 / total, 0), 6) AS user_ratio, {_UO}, {_CO}, {_WO}
FROM tgt LEFT JOIN u USING (user_id) LEFT JOIN c USING (creator_id) LEFT JOIN w ON w.user_id = tgt.user_id AND w.creator_id = tgt.creator_id""")
def history_features(spark, d):
    """Features of every row to predict: what its user, its creator and the pair did before, leakage-free."""
    _, target, hist, t0, _ = parts(spark, d)
    users = history.impression_counts(hist, "user_id", "user")
    u = history.action_counts(hist, "user_id", "u", start=t0, unit=float(HOUR))
    c = history.action_counts(hist, "creator_id", "c", start=t0, unit=1.0).drop(*[f"c_{a}_norm" for a in ACTIONS])
    out = history.attach(history.attach(history.attach(labels(target), users, "user_id"), u, "user_id"), c, "creator_id")
    out = out.join(history.pair_counts(hist), ["user_id", "creator_id"], "left").fillna(0, [f"with_{a}_n" for a in ACTIONS])
    return out.select(
        "engage_index", "user_id", "creator_id", "split", "reply_label", "like_label", "user_total", "user_pos", r(F.col("user_ratio")).alias("user_ratio"),
        *[x for a in ACTIONS for x in (f"u_{a}_n", r(F.col(f"u_{a}_last")).alias(f"u_{a}_last"), r(F.col(f"u_{a}_norm")).alias(f"u_{a}_norm"))],
        *[x for a in ACTIONS for x in (f"c_{a}_n", r(F.col(f"c_{a}_last")).alias(f"c_{a}_last"))], *[f"with_{a}_n" for a in ACTIONS],
    )


@query("profile_features", BASE + """, p AS (SELECT c_custkey AS id, c_nationkey * 10 AS following,
 abs(CAST(trunc(c_acctbal) AS INT)) AS followers, CAST(c_mktsegment = 'BUILDING' AS INT) AS verified, c_custkey FROM customer)
SELECT engage_index, coalesce(followers, 0) AS followers, coalesce(following, 0) AS following, round(coalesce(CASE WHEN following > 0 THEN followers * 1.0 / following ELSE 0 END, 0), 6) AS ratio,
 coalesce(verified, 0) AS verified, round(coalesce((1580947211 - (t0 - 86400 * (c_custkey + 1))) / 86400.0, 0), 6) AS age_days,
 CAST(isodow(make_timestamp(t * 1000000)) AS INT) AS weekday, CAST(hour(make_timestamp(t * 1000000)) AS INT) AS hour
FROM imp JOIN lim ON true LEFT JOIN p ON p.id = imp.user_id""")
def profile_features(spark, d):
    """Profile columns of each impression's user: counts, safe ratio, account age, and the day and hour shown."""
    imps = from_events(spark, d)
    t0, _ = bounds(imps)
    p = profiles(spark, d, t0).withColumnRenamed("id", "user_id")
    out = imps.join(p, "user_id", "left")
    age = history.account_age(F.col("created"), NOW)
    weekday, hour = history.day_and_hour(F.col("t"))
    return out.select(
        "engage_index", F.coalesce("followers", F.lit(0)).alias("followers"), F.coalesce("following", F.lit(0)).alias("following"),
        r(F.coalesce(history.ratio(F.col("followers"), F.col("following")), F.lit(0.0))).alias("ratio"),
        F.coalesce(F.col("verified").cast("int"), F.lit(0)).alias("verified"), r(F.coalesce(age, F.lit(0.0))).alias("age_days"),
        weekday.alias("weekday"), hour.alias("hour"),
    )


@query("assign_ids", BASE + """, s AS (SELECT creator_id AS id, engage_index * 2 AS p FROM imp UNION ALL SELECT user_id, engage_index * 2 + 1 FROM imp)
SELECT id, row_number() OVER (ORDER BY min(p)) - 1 AS index FROM s GROUP BY id""")
def assign_ids(spark, d):
    """One id space for creators and users, in first-seen order."""
    return ids.assign_ids(from_events(spark, d), ["creator_id", "user_id"], "engage_index")


@query("first_records", BASE + """SELECT tweet_id, arg_min(user_id, engage_index) AS user_id, arg_min(t, engage_index) AS t, count(DISTINCT user_id) AS user_id_kinds, count(DISTINCT t) AS t_kinds FROM imp GROUP BY tweet_id""")
def first_records(spark, d):
    """Attributes of each item from its first row, and conflicts with later rows."""
    return ids.first_record_wins(from_events(spark, d), "tweet_id", "engage_index", ["user_id", "t"])


_TOK = "SELECT doc_id AS tweet_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS category FROM documents"


def item_texts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("tweet_id"), "text")


def tokens():
    return F.split("text", r"[ \n]+")


def item_tokens(spark, d):
    """Items' tokens, dealt by the item while they are still texts."""
    return dealt(item_texts(spark, d), "tweet_id").select("tweet_id", tokens().alias("tokens"))


@query("encode_tokens", f"""WITH tok AS ({_TOK}), dic AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS cat FROM (SELECT DISTINCT category FROM tok)),
nz AS (SELECT tweet_id, cat, count(*) AS value FROM tok JOIN dic USING (category) GROUP BY ALL),
keep AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS new FROM (SELECT cat FROM nz GROUP BY cat HAVING count(DISTINCT tweet_id) > 20))
SELECT tweet_id, new AS cat, CAST(value AS DOUBLE) AS value FROM nz JOIN keep USING (cat)""")
def encode_tokens(spark, d):
    """Token counts of items over the dictionary, cut to tokens of more than 20 items and renumbered."""
    return ids.encode_frequent(item_tokens(spark, d), "tweet_id", "tokens", 20)


@query("encode_categories", """WITH dic AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS cat FROM (SELECT lang AS category FROM documents UNION SELECT source FROM documents))
SELECT doc_id AS tweet_id, a.cat AS language, b.cat AS domain, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE 'other' END AS name,
 replace('domain_' || source, ' ', '_') AS feature FROM documents JOIN dic a ON a.category = lang JOIN dic b ON b.category = source""")
def encode_categories(spark, d):
    """Language and domain encoded by one shared dictionary, with readable names."""
    c = contents(spark, d)
    dic = ids.shared_dictionary([(c, "language"), (c, "domain")])
    a = ids.encode_category(c, "tweet_id", "language", dic).select("tweet_id", F.col("cat").alias("language"))
    b = ids.encode_category(c, "tweet_id", "domain", dic).select("tweet_id", F.col("cat").alias("domain"), "cat")
    names = ids.feature_names(dic, "domain").select("cat", F.col("name").alias("feature"))
    out = a.join(b, "tweet_id").join(names, "cat").join(c.select("tweet_id", ids.language_name(F.col("language")).alias("name")), "tweet_id")
    return out.select("tweet_id", "language", "domain", "name", "feature")


@query("frequent_users", BASE + """, f AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS i, count(*) AS n FROM imp GROUP BY user_id HAVING count(*) >= 65)
SELECT engage_index, coalesce(i, (SELECT count(*) FROM f)) AS user_id_index FROM imp LEFT JOIN f USING (user_id)""")
def frequent_users(spark, d):
    """Users with 65 rows or more by falling frequency, all others as one."""
    return ids.reindex_frequent(from_events(spark, d), "user_id", 65).select("engage_index", "user_id_index")


@query("chunk_rows", BASE + """SELECT CAST(engage_index % 3 AS BIGINT) AS chunk, tweet_id, dense_rank() OVER (PARTITION BY engage_index % 3 ORDER BY tweet_id) - 1 AS "row" FROM imp GROUP BY engage_index % 3, tweet_id""")
def chunk_rows(spark, d):
    """Items numbered inside each of three chunks."""
    return ids.chunk_row_ids(from_events(spark, d).withColumn("chunk", F.col("engage_index") % 3), "chunk", "tweet_id").withColumn("row", F.col("row").cast("long"))


@query("cross_tab", BASE + "SELECT user_id, creator_id, count(*) AS value FROM imp GROUP BY ALL")
def cross_tab(spark, d):
    """Impressions of each user and creator."""
    return ids.cross_tab(from_events(spark, d), "user_id", "creator_id")


_WS = "list_filter(regexp_split_to_array(regexp_replace({t}, '[.,:;!?'')(}}{{]', '', 'g'), '\\s+'), lambda x: x <> '')"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s_', '_', 'g'), '_\\s', '_', 'g'), '\\[CLS\\]|\\[SEP\\]|\\[UNK\\]', '', 'g'), 'RT @ [^,:]+ :', '', 'g'), '@ \\S+ ', '', 'g'), 'https : / / t\\. co / \\S*', '', 'g'), ' ')"


@query("text_statistics", f"""WITH c AS (SELECT doc_id AS tweet_id, {_CLEAN} AS c FROM documents), w AS (SELECT tweet_id, c, {_WS.format(t='c')} AS w FROM c)
SELECT tweet_id, CAST(len(regexp_extract_all(c, '[.|,:;!?'']')) AS DOUBLE) AS punctuation, CAST(len(w) AS DOUBLE) AS words,
 CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) AS DOUBLE) AS capitalised, CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{Ll}}'))) AS DOUBLE) AS uppercase,
 CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS max_length, round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0), 6) AS mean_length FROM w""")
def text_statistics(spark, d):
    """Six statistics of each cleaned text."""
    out = tx.with_statistics(contents(spark, d), "text", ["tweet_id"])
    return out.withColumn("mean_length", r(F.col("mean_length")))


_TWEET = "'RT @ ' || source || ' : ' || replace(text, chr(10), ' ') || ' @ ' || lang || ' # t' || doc_id % 7 || ' https : / / t. co / ' || doc_id || ' [UNK]'"


def tweets(spark, d):
    """Texts in the log's spelling, made from each whole document."""
    doc = spark.read.parquet(f"{d}/documents.parquet")
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    made = F.concat(F.lit("RT @ "), "source", F.lit(" : "), line, F.lit(" @ "), "lang", F.lit(" # t"), (F.col("doc_id") % 7).cast("string"),
                    F.lit(" https : / / t. co / "), F.col("doc_id").cast("string"), F.lit(" [UNK]"))
    return doc.select(F.col("doc_id").alias("tweet_id"), made.alias("text"), F.col("lang").alias("language"))


def _variant(replace: bool) -> str:
    m, h, u, k = ("<mention>", "<hashtag>", "<url>", "<unk>") if replace else ("", "", "", "")
    x = "text"
    for a, b in ((r"\[CLS\]|\[SEP\]", ""), (r"\[UNK\]", k), (r"RT @ [^,:]+ :", m), (r"@ \S+", m), (r"https : / / t\. co / \S*", u), ("#" if replace else r"# \S*", h), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"trim({x})"


@query("text_extraction", f"""WITH t AS (SELECT doc_id AS tweet_id, {_TWEET} AS text FROM documents)
SELECT tweet_id, nullif(regexp_extract(text, 'RT @ ([^,:]+) :', 1), '') AS main_mention, array_to_string(regexp_extract_all(regexp_replace(text, 'RT @ [^,:]+ :', '', 'g'), '@ (\\S*)', 1), '|') AS mentions,
 array_to_string(regexp_extract_all(text, '# (\\S*)', 1), '|') AS hashtags, replace(nullif(regexp_extract(text, '(https : / / t\\. co / \\S*)', 1), ''), ' ', '') AS url, {_variant(True)} AS replaced, {_variant(False)} AS removed,
 len(list_filter(regexp_split_to_array({_variant(False)}, '\\s+'), lambda x: x <> '')) AS words, length({_variant(False)}) AS chars FROM t""")
def text_extraction(spark, d):
    """Mentions, tags, links, cleaned texts and their sizes."""
    c, removed = F.col("text"), F.col("removed")
    return tweets(spark, d).withColumn("removed", tx.clean_variant(c, replace=False)).select(
        "tweet_id", tx.main_mention(c).alias("main_mention"), F.array_join(tx.list_without_spaces(tx.other_mentions(c)), "|").alias("mentions"),
        F.array_join(tx.hashtags(c), "|").alias("hashtags"), tx.without_spaces(tx.first_url(c)).alias("url"), tx.clean_variant(c, replace=True).alias("replaced"),
        removed, tx.word_count(removed).cast("long").alias("words"), F.length(removed).cast("long").alias("chars"),
    )


@query("text_fidelity", """WITH t AS (SELECT lang, regexp_matches(text, '#[A-Za-z]') AS tag, len(regexp_extract_all(text, '(#[^ \\n]+)', 1)) > 0 AS given_tag, regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') AS link, contains(text, '.com') AS given_link FROM documents)
SELECT lang AS language, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share, round(avg(CAST(tag AND NOT given_tag AS INT)), 6) AS tag_found_only, round(avg(CAST(given_tag AND NOT tag AS INT)), 6) AS tag_given_only,
 round(avg(CAST(link AND NOT given_link AS INT)), 6) AS link_found_only, round(avg(CAST(given_link AND NOT link AS INT)), 6) AS link_given_only FROM t GROUP BY lang""")
def text_fidelity(spark, d):
    """Language shares, and how well signs found in texts agree with the log's tags and links, per language."""
    c = contents(spark, d)
    tags = tx.fidelity(c, F.rlike("text", F.lit("#[A-Za-z]")), F.size("hashtags") > 0, ["language"]).toDF("language", "tag_found_only", "tag_given_only")
    links = tx.fidelity(c, F.size("links") > 0, F.contains("text", F.lit(".com")), ["language"]).toDF("language", "link_found_only", "link_given_only")
    out = tx.shares(c, "language").join(tags, "language").join(links, "language")
    return out.select("language", "n", *[r(F.col(x)).alias(x) for x in ("share", "tag_found_only", "tag_given_only", "link_found_only", "link_given_only")])


@query("analyzed_tokens", """WITH a AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(text, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{L})(\\p{N})|(\\p{N})(\\p{L})', '\\1\\3 \\2\\4', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, unnest(string_split(translate(t, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), ' ')) AS token FROM a)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs, md5(array_to_string(list_sort(list_concat(list_transform(range(1, length(token) - 1), lambda i: substr(token, i, 3)), list_transform(range(1, length(token) - 2), lambda i: substr(token, i, 4)))), '|')) AS grams FROM w WHERE token <> '' GROUP BY token""")
def analyzed_tokens(spark, d):
    """Analysed tokens of all texts: uses, texts, and a digest of the runs of 3 to 4 characters of each."""
    rows = contents(spark, d).select("tweet_id", F.explode(tx.analyze(F.col("text"))).alias("token"))
    out = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("tweet_id").alias("docs"))
    return out.withColumn("grams", F.md5(F.array_join(F.array_sort(tx.char_ngrams(F.array("token"), 3, 4)), "|")))


_VOC = """WITH tok AS (SELECT doc_id AS tweet_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents), f AS (SELECT tweet_id, unnest(w) AS piece, generate_subscripts(w, 1) AS p FROM tok),
v AS (SELECT piece, row_number() OVER (ORDER BY piece) AS token_id FROM (SELECT piece FROM f GROUP BY piece HAVING count(*) >= 5))"""


def vocabulary(spark, d):
    """Items' texts, and a vocabulary (piece, token_id) of the tokens that all texts use five times; 0 is the unknown one."""
    used = contents(spark, d).select(F.explode("tokens").alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).filter("n >= 5")
    vocab = ids.dictionary(used, "piece").select(F.col("category").alias("piece"), (F.col("cat") + 1).alias("token_id"))
    return item_texts(spark, d), stored(vocab.unionByName(spark.createDataFrame([("<unk>", 0)], "piece string, token_id long")), "vocabulary")


def encoded(texts, vocab, **more):
    """Ids of texts' tokens; a text's own <unk> is the piece of that name if there is one."""
    return tx.encode(texts, "tweet_id", tokens(), vocab.filter("token_id > 0"), **more)


@query("encode_decode", _VOC + """ SELECT tweet_id, string_agg(CASE WHEN v.piece IS NULL THEN '<unk>' ELSE f.piece END, ' ' ORDER BY p) AS text FROM f LEFT JOIN v USING (piece) WHERE p <= 100 GROUP BY tweet_id""")
def encode_decode(spark, d):
    """Texts cut to a hundred tokens as ids of the vocabulary, and back."""
    c, vocab = vocabulary(spark, d)
    return tx.decode(encoded(c, vocab), "tweet_id", "ids", vocab, continues=None)


@query("decode_whole", _VOC + """ SELECT tweet_id, count(*) AS n, md5(string_agg(CASE WHEN v.piece IS NULL THEN '<unk>' ELSE f.piece END, ' ' ORDER BY p)) AS digest FROM f LEFT JOIN v USING (piece) GROUP BY tweet_id""")
def decode_whole(spark, d):
    """Whole texts as ids of the vocabulary, and back."""
    c, vocab = vocabulary(spark, d)
    enc = encoded(c, vocab, most=None)
    return tx.decode(enc, "tweet_id", "ids", vocab, size="n", continues=None).select("tweet_id", F.md5("text").alias("digest"), "n")


@query("token_blocks", """WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM s),
n AS (SELECT token, row_number() OVER (ORDER BY doc_id, p) - 1 AS i FROM f) SELECT i // 128 AS block, md5(string_agg(token, ' ' ORDER BY i)) AS digest FROM n GROUP BY i // 128 HAVING count(*) = 128""")
def token_blocks(spark, d):
    """All texts' tokens in blocks of 128."""
    return tx.fixed_blocks(contents(spark, d).select("tweet_id", "tokens"), "tweet_id", "tokens", 128).select("block", F.md5(F.array_join("tokens", " ")).alias("digest"))


_DRAW = "CAST('0x' || substr(md5(tweet_id || ':' || (p - 1) || ':{seed}'), 1, 12) AS BIGINT) % {n}"


@query("masked_tokens", _VOC + f""", i AS (SELECT tweet_id, p, coalesce(token_id, 0) + 5 AS i FROM f LEFT JOIN v USING (piece)), z AS (SELECT count(*) + 6 AS size FROM v),
x AS (SELECT tweet_id, p, i, {_DRAW.format(seed=0, n=1000000)} < 150000 AND i >= 6 AS chosen, {_DRAW.format(seed=1, n=1000000)} AS d, {_DRAW.format(seed=2, n='size')} AS w FROM i, z)
SELECT tweet_id, md5(string_agg(CASE WHEN chosen AND d < 800000 THEN 4 WHEN chosen AND d < 900000 THEN w ELSE i END, ' ' ORDER BY p)) AS inputs, md5(string_agg(CASE WHEN chosen THEN i ELSE -100 END, ' ' ORDER BY p)) AS labels FROM x GROUP BY tweet_id""")
def masked_tokens(spark, d):
    """Inputs and labels of masked training over whole texts; ids start after five special ones and the unknown one."""
    c, vocab = vocabulary(spark, d)
    enc = encoded(c, vocab, most=None).select("tweet_id", F.transform("ids", lambda x: (x + 5).cast("int")).alias("ids"))
    out = tx.mask_tokens(enc, "tweet_id", "ids", mask=4, size=vocab.count() + 5, special=6, portable=True)
    return out.select("tweet_id", *[F.md5(F.array_join(F.transform(x, lambda v: v.cast("string")), " ")).alias(x) for x in ("inputs", "labels")])


@query("date_windows", BASE + """, w AS (SELECT CAST(range AS INT) AS chunk, cut - (range + 1) * 86400 AS s, cut - range * 86400 AS e FROM lim, range(5))
SELECT chunk, action, count(*) AS n, min(s) AS start, count(DISTINCT user_id) AS users FROM act JOIN w ON "at" > s AND "at" <= e GROUP BY chunk, action""")
def date_windows(spark, d):
    """Actions in each of five one-day windows."""
    imps = from_events(spark, d)
    cut = bounds(imps)[1] - splits.CUTOFF_BEFORE_END
    rows = splits.action_window(unpivot_actions(imps), cutoff=cut).join(F.broadcast(splits.date_windows(spark, cutoff=cut)), "chunk")
    return rows.groupBy("chunk", "action").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.count_distinct("user_id").alias("users"))


@query("split_create_date", BASE + "SELECT engage_index, split FROM tgt")
def split_create_date(spark, d):
    """Train and validation rows by actions and creation dates."""
    return parts(spark, d)[1].select("engage_index", "split")


@query("split_blend", BASE + """SELECT engage_index, CASE WHEN x > cut THEN 'valid' WHEN x > cut - 86400 THEN 'train' END AS split FROM (SELECT engage_index, cut, coalesce(least(reply_ts, retweet_ts, comment_ts, like_ts), tweet_ts) AS x FROM imp, lim) WHERE x > cut - 86400""")
def split_blend(spark, d):
    """Train and validation rows of a blend, by the earliest action."""
    imps = from_events(spark, d)
    cut = bounds(imps)[1] - splits.CUTOFF_BEFORE_END
    return imps.withColumn("split", splits.split_blend(imps, train=cut - DAY, valid=cut)).filter("split is not null").select("engage_index", "split")


@query("split_random_negatives", BASE + f""", p AS (SELECT engage_index, CASE WHEN {_ANY} > cut THEN 'valid' WHEN {_ANY} > cut - 86400 THEN 'train' END AS split FROM imp, lim WHERE NOT ({_NEG})),
q AS (SELECT * FROM p WHERE split IS NOT NULL), g AS (SELECT engage_index, row_number() OVER (ORDER BY md5(engage_index || ':0')) - 1 AS i FROM imp WHERE {_NEG})
SELECT * FROM q UNION ALL SELECT engage_index, CASE WHEN i < (SELECT count(*) FROM q WHERE split = 'valid') THEN 'valid' ELSE 'train' END FROM g WHERE i < (SELECT count(*) FROM q)""")
def split_random_negatives(spark, d):
    """As many negatives as positives, in hash order."""
    imps = from_events(spark, d)
    cut = bounds(imps)[1] - splits.CUTOFF_BEFORE_END
    return splits.split_random_negatives(imps, train=cut - DAY, valid=cut).select("engage_index", "split")


_WHIT = _HIT.replace("cut - 86400", "s").replace("<= cut", "<= e")


@query("window_sets", BASE + f""", w AS (SELECT CAST(range AS INT) AS chunk, cut - (range + 1) * 86400 AS s, cut - range * 86400 AS e, cut FROM lim, range(5)),
x AS (SELECT chunk, engage_index, CASE WHEN {_NEG} THEN CASE WHEN tweet_ts > cut THEN 'valid' WHEN tweet_ts > s AND tweet_ts < e THEN 'train' END WHEN {_ANY} > cut THEN 'valid' WHEN {_WHIT} THEN 'train' END AS split FROM imp, w)
SELECT chunk, engage_index, split FROM x WHERE split = 'train' OR (split = 'valid' AND chunk = 0)""")
def window_sets(spark, d):
    """Train rows of each window, validation rows with the first."""
    imps = from_events(spark, d)
    cut = bounds(imps)[1] - splits.CUTOFF_BEFORE_END
    return splits.window_sets(imps, cutoff=cut).select("chunk", "engage_index", "split")


@query("chunks_and_holdout", BASE + """SELECT engage_index, CAST(least(i // (n // 3), 2) AS INT) AS chunk, CAST('0x' || substr(md5(engage_index || ':0'), 1, 8) AS BIGINT) < 1717986918 AS eval
FROM (SELECT engage_index, row_number() OVER (ORDER BY md5(engage_index || ':0')) - 1 AS i, count(*) OVER () AS n FROM imp)""")
def chunks_and_holdout(spark, d):
    """Three near-equal chunks and a hold-out of 40%, both in hash order."""
    return splits.holdout(splits.k_chunks(from_events(spark, d), "engage_index", 3), "engage_index").select("engage_index", "chunk", "eval")


@query("length_batches", """WITH b AS (SELECT doc_id, CAST(n_chars >= 500 AS INT) + CAST(n_chars >= 1000 AS INT) + CAST(n_chars >= 4000 AS INT) AS bin FROM documents),
x AS (SELECT doc_id, bin, (row_number() OVER (PARTITION BY bin ORDER BY md5(doc_id || ':0'), doc_id) - 1) // 16 AS batch FROM b)
SELECT doc_id, bin, batch FROM x QUALIFY count(*) OVER (PARTITION BY bin, batch) = 16""")
def length_batches(spark, d):
    """Full batches of 16 texts of like length."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    return splits.length_batches(docs, "doc_id", "n_chars", bins=[500, 1000, 4000], batch=16).select("doc_id", "bin", "batch")


@query("corpus_sets", """WITH a AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents), x AS (SELECT text, arg_min(doc_id, doc_id) AS doc_id FROM a WHERE words >= 7 GROUP BY text)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'valid' ELSE 'train' END AS split, md5(text) AS digest FROM x""")
def corpus_sets(spark, d):
    """Unique texts of seven words or more, those with a good label for validation."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", tx.word_count(F.col("text")).alias("words"))
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1")
    half = F.col("doc_id") % 2 == 0
    out = splits.corpus_sets(docs.filter(half), docs.filter(~half), good, key="doc_id", own="text", words="words")
    return out.select("doc_id", "split", F.md5("text").alias("digest"))


@query("action_sets", BASE + f"""SELECT user_id, action, count(*) AS n, min(engage_index) AS first_row, max(engage_index) AS last_row FROM (SELECT user_id, engage_index, action FROM hact UNION ALL SELECT user_id, engage_index, 'none' FROM hist WHERE {_NEG}) GROUP BY ALL""")
def action_sets(spark, d):
    """Rows of each user's actions, and of none."""
    return history.action_sets(parts(spark, d)[2], "user_id")


_CON = ", con AS (SELECT doc_id AS tweet_id, lang, source, regexp_split_to_array(text, '[ \\n]+') AS tokens, regexp_extract_all(text, '(#[^ \\n]+)', 1) AS tags, CASE WHEN n_chars >= 1000 THEN 'long' ELSE 'short' END AS type, regexp_extract_all(text, '([A-Z]{3,})', 1) AS media, regexp_extract_all(text, '([a-z0-9.]+@[a-z0-9.]+)', 1) AS links FROM documents)"


@query("mean_content", BASE + _CON + """, per AS (SELECT tweet_id, len(list_distinct(tags)) AS tags, len(list_distinct(tokens)) AS words, len(list_distinct(media)) AS media, len(list_distinct(links)) AS links, CAST(source IS NOT NULL AS INT) AS domains FROM con),
pf AS (SELECT c_custkey AS creator_id, CAST(c_mktsegment = 'BUILDING' AS INT) AS verified FROM customer)
SELECT user_id, action, round(avg(coalesce(tags, 0)), 6) AS tags, round(avg(coalesce(words, 0)), 6) AS words, round(avg(coalesce(media, 0)), 6) AS media, round(avg(coalesce(links, 0)), 6) AS links, round(avg(coalesce(domains, 0)), 6) AS domains,
 round(avg(CAST(follow AS INT)), 6) AS follow, round(avg(coalesce(verified, 0)), 6) AS verified FROM hact LEFT JOIN per USING (tweet_id) LEFT JOIN pf USING (creator_id) GROUP BY ALL""")
def mean_content(spark, d):
    """Mean content of what users acted on."""
    _, _, hist, t0, _ = parts(spark, d)
    out = history.mean_content(hist, contents(spark, d), profiles(spark, d, t0))
    return out.select("user_id", "action", *[r(F.col(c)).alias(c) for c in ("tags", "words", "media", "links", "domains", "follow", "verified")])


@query("distinct_languages", BASE + _CON + f"SELECT user_id, count(DISTINCT lang) AS languages FROM hist JOIN con USING (tweet_id) WHERE NOT ({_NEG}) GROUP BY user_id")
def distinct_languages(spark, d):
    """Languages of what users acted on."""
    return history.distinct_languages(parts(spark, d)[2], contents(spark, d))


@query("mean_statistics", BASE + """, st AS (SELECT doc_id AS tweet_id, length(text) AS chars, len(regexp_extract_all(text, '\\n')) AS breaks FROM documents)
SELECT creator_id, round(avg(chars), 4) AS chars, round(avg(breaks), 4) AS breaks FROM hact JOIN st USING (tweet_id) GROUP BY creator_id""")
def mean_statistics(spark, d):
    """Mean text statistics per creator over (row, action) pairs."""
    st = contents(spark, d).select("tweet_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit("\n")).alias("breaks"))
    out = history.mean_statistics(parts(spark, d)[2], st, "creator_id", ["chars", "breaks"])
    return out.select("creator_id", r(F.col("chars"), 4).alias("chars"), r(F.col("breaks"), 4).alias("breaks"))


@query("interactions", BASE + "SELECT user_id, creator_id, n FROM cnt")
def interactions(spark, d):
    """(row, action) pairs of users and creators."""
    return history.interactions(parts(spark, d)[2])


@query("first_items", BASE + """, o AS (SELECT user_id, action, tweet_id, engage_index, CAST(row_number() OVER (PARTITION BY user_id, action, tweet_id ORDER BY engage_index) = 1 AS INT) AS new FROM hact),
k AS (SELECT *, sum(new) OVER w AS kinds, row_number() OVER w AS pos FROM o WINDOW w AS (PARTITION BY user_id, action ORDER BY engage_index))
SELECT user_id, action, string_agg(tweet_id, '|' ORDER BY engage_index) || repeat('|-1', CAST(10 - count(*) AS INT)) AS items FROM k WHERE (kinds < 10 OR (kinds = 10 AND new = 1)) AND pos <= 10 GROUP BY ALL""")
def first_items(spark, d):
    """The first ten items of each user and action, padded."""
    out = history.first_distinct_items(parts(spark, d)[2])
    return out.select("user_id", "action", F.array_join(history.pad(F.col("items")), "|").alias("items"))


@query("cold_start", BASE + """SELECT avg(CAST(u.user_id IS NULL AS INT)) AS new_users, avg(CAST(c.creator_id IS NULL AS INT)) AS new_creators, count(*) AS n, (SELECT count(DISTINCT user_id) FROM hist) AS users,
 (SELECT count(*) FROM (SELECT user_id AS i FROM hist INTERSECT SELECT creator_id FROM hist)) AS both_roles, (SELECT count(*) FROM (SELECT user_id AS i FROM hist UNION SELECT creator_id FROM hist)) AS all_ids,
 round((SELECT count(*) FROM (SELECT user_id AS i FROM hist INTERSECT SELECT creator_id FROM hist)) * 1.0 / (SELECT count(DISTINCT user_id) FROM hist), 6) AS of_users,
 round((SELECT count(*) FROM (SELECT user_id AS i FROM hist INTERSECT SELECT creator_id FROM hist)) * 1.0 / (SELECT count(DISTINCT creator_id) FROM hist), 6) AS of_creators,
 round((SELECT count(*) FROM (SELECT user_id AS i FROM hist INTERSECT SELECT creator_id FROM hist)) * 1.0 / (SELECT count(*) FROM (SELECT user_id AS i FROM hist UNION SELECT creator_id FROM hist)), 6) AS of_all
FROM tgt LEFT JOIN (SELECT DISTINCT user_id FROM hist) u USING (user_id) LEFT JOIN (SELECT DISTINCT creator_id FROM hist) c USING (creator_id)""")
def cold_start(spark, d):
    """Unseen users and creators among the rows to predict, and the overlap of the two roles' ids."""
    _, target, hist, _, _ = parts(spark, d)
    u, c = hist.select("user_id").distinct(), hist.select("creator_id").distinct()
    rows = target.join(u.withColumn("hu", F.lit(1)), "user_id", "left").join(c.withColumn("hc", F.lit(1)), "creator_id", "left")
    out = rows.agg(F.avg(F.col("hu").isNull().cast("int")).alias("new_users"), F.avg(F.col("hc").isNull().cast("int")).alias("new_creators"), F.count("*").alias("n"))
    a, b = u.select(F.col("user_id").alias("i")), c.select(F.col("creator_id").alias("i"))
    sizes = {"users": u.count(), "both_roles": a.intersect(b).count(), "all_ids": a.union(b).distinct().count()}
    shares = history.id_overlap(a, b, "i").first()
    ratios = {"of_all": shares["of_either"], "of_users": shares["of_first"], "of_creators": shares["of_second"]}
    return out.withColumns({k: F.lit(v).cast("long") for k, v in sizes.items()} | {k: r(F.lit(v)) for k, v in ratios.items()})
