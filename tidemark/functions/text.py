"""Text functions on columns: cleaning, statistics, extraction, tokens. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Patterns of the log's texts, which put spaces around signs.
MARKS = r"\[CLS\]|\[SEP\]|\[UNK\]"
RT_MENTION = r"RT @ [^,:]+ :"
MENTION = r"@ \S+ ?"
URL = r"https : / / t\. co / \S*"
HASHTAG = r"# (\S*)"
PUNCTUATION = r"[.|,:;!?']"
STRIPPED = r"[.,:;!?')(}{]"
STATISTICS = ["punctuation", "words", "capitalised", "uppercase", "max_length", "mean_length"]


def repair_underscores(c: Column) -> Column:
    """Joins underscores with what a space cut them off from."""
    return F.regexp_replace(F.regexp_replace(c, r"\s_", "_"), r"_\s", "_")


def clean_line(c: Column) -> Column:
    """Without markers, the forwarding mention, other mentions and links, trimmed."""
    for pattern in (MARKS, RT_MENTION, r"@ \S+ ", URL):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def tokens(c: Column, strip: str = STRIPPED) -> Column:
    """Non-empty runs between white space after the given signs are gone."""
    return F.filter(F.split(F.regexp_replace(c, strip, ""), r"\s+"), lambda x: x != "")


def statistics(c: Column) -> Column:
    """Struct of STATISTICS of a cleaned text: signs, tokens, tokens with an upper-case first letter, tokens equal to
    their upper case (numbers count), longest and mean length (0 without tokens)."""
    own = tokens(c)
    sizes = F.transform(own, F.length)
    upper_first = F.size(F.filter(own, lambda x: x.rlike(r"^\p{Lu}")))
    all_upper = F.size(F.filter(own, lambda x: ~x.rlike(r"\p{Ll}")))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    mean = F.when(F.size(own) > 0, total / F.size(own)).otherwise(0.0)
    values = [F.regexp_count(c, F.lit(PUNCTUATION)), F.size(own), upper_first, all_upper, F.coalesce(F.array_max(sizes), F.lit(0)), mean]
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(STATISTICS, values, strict=True)])


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the STATISTICS of a text, cleaned first. Tokens and their sizes are columns of their own, made once each."""
    c = df.select(*keep, clean_line(repair_underscores(F.col(text))).alias("_c"))
    c = c.select(*keep, F.regexp_count("_c", F.lit(PUNCTUATION)).alias("_p"), tokens(F.col("_c")).alias("_t"))
    c = c.select(*keep, "_p", "_t", F.transform("_t", F.length).alias("_n"))
    total = F.aggregate("_n", F.lit(0), lambda a, x: a + x)
    upper_first = F.size(F.filter("_t", lambda x: x.rlike(r"^\p{Lu}")))
    all_upper = F.size(F.filter("_t", lambda x: ~x.rlike(r"\p{Ll}")))
    mean = F.when(F.size("_n") > 0, total / F.size("_n")).otherwise(0.0)
    values = [F.col("_p"), F.size("_t"), upper_first, all_upper, F.coalesce(F.array_max("_n"), F.lit(0)), mean]
    return c.select(*keep, *[v.cast("double").alias(n) for n, v in zip(STATISTICS, values, strict=True)])


def first_statistics(df: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Statistics of each key's first text by position."""
    first = df.groupBy(key).agg(F.min_by(text, pos).alias("text"))
    return with_statistics(first, "text", [key])


def main_mention(c: Column) -> Column:
    """Whom a forwarded text is from; null if it isn't one."""
    return F.nullif(F.regexp_extract(c, r"RT @ ([^,:]+) :", 1), F.lit(""))


def other_mentions(c: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(c, RT_MENTION, ""), F.lit(r"@ (\S*)"), 1)


def hashtags(c: Column) -> Column:
    """List of tags, null if there are none."""
    got = F.regexp_extract_all(c, F.lit(HASHTAG), 1)
    return F.when(F.size(got) > 0, got)


def first_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(https : / / t\. co / \S*)", 1), F.lit(""))


def clean_variant(c: Column, *, replace: bool) -> Column:
    """Mentions, tags and links removed, or replaced by their kind."""
    to = {"mention": "<mention>", "hashtag": "<hashtag>", "url": "<url>"} if replace else dict.fromkeys(("mention", "hashtag", "url"), "")
    c = F.regexp_replace(c, r"\[CLS\]|\[SEP\]", "")
    c = F.regexp_replace(c, r"\[UNK\]", "<unk>" if replace else "")
    c = F.regexp_replace(c, RT_MENTION, to["mention"])
    c = F.regexp_replace(c, r"@ \S+", to["mention"])
    c = F.regexp_replace(c, URL, to["url"])
    c = F.regexp_replace(c, "#" if replace else r"# \S*", to["hashtag"])
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def list_without_spaces(c: Column) -> Column:
    return F.transform(c, without_spaces)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def fidelity(df: DataFrame, found: Column, given: Column, by: list[str] | None = None) -> DataFrame:
    """Shares of rows where something was found that the log doesn't give, and the converse; of all rows or per group."""
    return df.groupBy(*(by or [])).agg(
        F.avg((found & ~given).cast("double")).alias("found_only"), F.avg((~found & given).cast("double")).alias("given_only")
    )


def shares(df: DataFrame, col: str) -> DataFrame:
    """Counts of a column's values and their shares of all rows."""
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(float(df.count())))


def analyze(c: Column) -> Column:
    """Tokens split on case changes, digits and signs, lower-cased, accents folded, blanks dropped."""
    c = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{L})(\p{N})|(\p{N})(\p{L})", "$1$3 $2$4")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    c = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(c, " "), lambda x: x != "")


def char_ngrams(own: Column, least: int, most: int) -> Column:
    """All runs of least ... most characters of each token."""
    def runs(t: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(t) - n + 1)
        own = F.transform(starts, lambda i: F.substr(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, own).otherwise(F.array().cast("array<string>"))

    def grams(t: Column) -> Column:
        return F.concat(*[runs(t, n) for n in range(least, most + 1)])

    return F.flatten(F.transform(own, grams))


def decode(df: DataFrame, key: str, ids: str, vocabulary: DataFrame, *, size: str | None = None, continues: str | None = "##") -> DataFrame:
    """Token ids -> text by a vocabulary (token_id, piece); pieces that begin with ``continues`` continue the one before
    (None: all are words).

    ``size`` names a column for the number of pieces. Rows dealt by ``key`` are exchanged no more if the vocabulary is small
    enough to broadcast; by a larger one they are stored and looked up in groups.
    """
    from tidemark.operators.ids import looked_up
    from tidemark.operators.order import few, stored

    if few(vocabulary):
        pos = df.select(key, F.posexplode(ids).alias("p", "token_id"))
        got = pos.join(F.broadcast(vocabulary), "token_id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("p", "piece"))).alias("x"))
        got = got.select(key, F.col("x.piece").alias("x"))
    else:
        got = looked_up(stored(df.select(key, ids), "ids"), key, ids, vocabulary, "token_id", "piece").toDF(key, "x")
    more = [F.size("x").cast("long").alias(size)] if size else []
    text = F.array_join("x", " ")
    return got.select(key, (F.replace(text, F.lit(f" {continues}"), F.lit("")) if continues else text).alias("text"), *more)


def encode(df: DataFrame, key: str, own: Column | str, vocabulary: DataFrame, *, most: int | None = 100, unknown: int = 0) -> DataFrame:
    """Tokens -> ids by a vocabulary (piece, token_id) of distinct pieces, cut to ``most`` (None: all); others get the unknown
    id. Rows are dealt by ``key`` before tokens are made, so give ``own`` as an expression of shorter columns."""
    from tidemark.operators.ids import looked_up
    from tidemark.operators.order import dealt, few

    own = F.slice(own, 1, most) if most else own
    if not few(vocabulary):
        return looked_up(df, key, own, vocabulary, "piece", "token_id", missing=unknown).toDF(key, "ids")
    cut = dealt(df, key).select(key, F.posexplode(own).alias("p", "piece"))
    got = cut.join(F.broadcast(vocabulary), "piece", "left").groupBy(key)
    got = got.agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("token_id", F.lit(unknown)).alias("i")))).alias("x"))
    return got.select(key, F.col("x.i").alias("ids"))


def mask_tokens(df: DataFrame, key: str, ids: str, *, mask: int, size: int, special: int, rate: float = 0.15, seed: int = 0,
                portable: bool = False) -> DataFrame:
    """Inputs and labels of masked training: of chosen places 80% get the mask, 10% another id, the rest stay; labels
    elsewhere are -100. Choices are hashes of key, place and seed, so reruns agree; ``portable`` ones (md5, slower) are the
    same in other engines."""
    def draw(p: Column, seed: int, n: int):
        if portable:
            own = F.md5(F.concat_ws(":", F.col(key).cast("string"), p.cast("string"), F.lit(str(seed))))
            return F.pmod(F.conv(F.substring(own, 1, 12), 16, 10).cast("long"), F.lit(n))
        return F.pmod(F.xxhash64(F.col(key), p, F.lit(seed)), F.lit(n))

    million = 1_000_000
    def chosen(i: Column, p: Column):
        return F.coalesce((i >= special) & (draw(p, seed, million) / million < rate), F.lit(False))

    def new(x: Column):
        v, w = draw(x["p"], seed + 1, million) / million, draw(x["p"], seed + 2, size).cast("int")
        return F.when(~x["chosen"], x["i"]).when(v < 0.8, mask).when(v < 0.9, w).otherwise(x["i"])

    # within each row: nothing is exploded, and only chosen places draw again
    rows = df.filter(F.size(ids) > 0).select(key, F.transform(ids, lambda i, p: F.struct(i.alias("i"), p.alias("p"), chosen(i, p).alias("chosen"))).alias("x"))
    labels = F.transform("x", lambda x: F.when(x["chosen"], x["i"]).otherwise(-100))
    return rows.select(key, F.transform("x", new).alias("inputs"), labels.alias("labels"))


def fixed_blocks(df: DataFrame, key: str, own: str, n: int) -> DataFrame:
    """Blocks of exactly n tokens of all rows' tokens in key order; the last partial one is dropped.

    Offsets of rows come from sizes alone; tokens are shuffled once, by block.
    """
    from tidemark.operators.order import global_index

    sizes = global_index(df.select(key, F.size(own).cast("long").alias("n")), key, name="at")
    part = (F.col("at") / 4096).cast("long")
    sums = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("part", part).withColumn("inside", inside).join(before.select("part", "before"), "part")
    flat = df.join(starts.select(key, (F.col("inside") + F.col("before")).alias("start")), key).select("start", F.posexplode(own).alias("p", "token"))
    at = F.col("start") + F.col("p")
    rows = flat.select(F.floor(at / n).alias("block"), (at % n).alias("i"), "token").groupBy("block")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("x"))
    return rows.filter(F.size("x") == n).select("block", F.col("x.token").alias("tokens"))


def non_blank(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.trim(c) != "")


def mention_lists(df: DataFrame, key: str, pos: str, text: str, most: int = 15) -> DataFrame:
    """Sorted distinct ids of everyone a text mentions, names cut to ``most`` characters, ids in first-seen order."""
    from tidemark.operators.ids import assign_ids

    main = F.when(main_mention(F.col(text)).isNotNull(), F.array(main_mention(F.col(text)))).otherwise(F.array().cast("array<string>"))
    names = df.select(key, pos, F.posexplode(F.concat(main, other_mentions(F.col(text)))).alias("p", "name"))
    width = (names.agg(F.max("p")).first()[0] or 0) + 1  # as many places as the longest list has
    names = names.select(key, (F.col(pos) * width + F.col("p")).alias("at"), F.substring("name", 1, most).alias("name"))
    return names.join(assign_ids(names, ["name"], "at", id_col="name"), "name").groupBy(key).agg(F.sort_array(F.collect_set("index")).alias("mentions"))
