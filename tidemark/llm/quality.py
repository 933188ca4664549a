"""Quality rules in DataFrame functions only: counts of a text, and how far it diverges from its language.

A language's reference is what all its documents together look like: shares of character classes, and shares of its most
common words (one more bin holds all other words). A document is held against both by Jensen-Shannon distance (base 2,
0 to 1); texts too short for a histogram aren't judged by it. All of a document's numbers come from its own row, by
higher-order functions whose cost is linear in the text (sorting apart), so nothing of a document is ever exploded or
shuffled; only word counts of languages are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, Scratch, read, small

BLANK = r"[\x20\x09-\x0D]+"
#: Classes of characters in words, each counted in what the ones before it leave; what remains is a class too.
CLASSES = (r"[a-z]+", r"[A-Z]+", r"\p{L}+", r"[.,;:'!?()\x22-]+", r"[0-9]+")
SYMBOLS = r"[#*$%&|<>]+"
#: Words of a window; a word is common from one in so many words on; places of a table of the hashes of common words.
WINDOW, COMMON, PLACES = 8, 400, 16_384
#: Characters and words that a text, and words that a reference needs for its histogram to be judged.
LEAST_CHARS, LEAST_WORDS, LEAST_REFERENCE = 200, 50, 1000
#: Distances beyond which a text isn't like its language.
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.52
#: Languages up to which references are broadcast: about twenty kilobytes each.
LANGUAGES = 2_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def removed(text: Column, runs: str) -> Column:
    """A text without the matches of a pattern."""
    return F.regexp_replace(text, runs, "")


def words_of(text: Column) -> Column:
    """Words: what runs of the six ASCII white-space characters separate."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def class_counts(words: Column) -> Column:
    """Characters of each class, in order, and of none, in a text without its white space."""

    def strip(rest: Column, k: int, counts: list[Column]) -> Column:
        if k == len(CLASSES):
            return F.array(*counts, F.length(rest))
        return let(removed(rest, CLASSES[k]), lambda left: strip(left, k + 1, [*counts, F.length(rest) - F.length(left)]))

    return strip(words, 0, [])


def hashed(word: Column) -> Column:
    """Place of a word in a table of PLACES."""
    return F.pmod(F.xxhash64(word), F.lit(PLACES)).cast("int")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own)))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of 8 words, by doubling: of two, then four, then eight."""

    def twice(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda one: let(twice(one, 1), lambda two: let(twice(two, 2), lambda four: F.slice(twice(four, 4), F.lit(1), F.greatest(F.size(four) - (WINDOW - 1), F.lit(0))))),
    )


def repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes: of n windows about n^2 / 2^65 pairs are taken for equal by chance, a hundred
    millionth of a pair in a text of a million words.
    """

    def covered(h: Column) -> Column:
        def spans(at: Column) -> Column:
            each = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(each, F.lit(0), lambda a, n: a + n)

        def places(own: Column) -> Column:
            same = F.transform(own, lambda x, i: F.when((x["h"] == F.get(own, i - 1)["h"]) | (x["h"] == F.get(own, i + 1)["h"]), x["i"]))
            return F.array_sort(F.filter(same, lambda p: p.isNotNull()))

        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, lambda own: let(places(own), spans)))

    return let(window_hashes(words), covered)


def divergence(pairs: Column, rest: Column, rest_q: Column) -> Column:
    """Jensen-Shannon distance of two histograms: structs (p, q) of the bins with p > 0, the shares of one more bin; the q that
    is missing from 1 stands in bins with p = 0."""

    def part(p: Column, q: Column) -> Column:
        both = (p + q) / 2
        left = F.when(p > 0, p * F.log2(p / both)).otherwise(0.0)
        return left + F.when(q > 0, q * F.log2(q / both)).otherwise(0.0)

    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))
    total = F.aggregate(pairs, zero, lambda a, x: F.struct((a["d"] + part(x["p"], x["q"])).alias("d"), (a["q"] + x["q"]).alias("q")))
    jsd = let(total, lambda t: (t["d"] + part(rest, rest_q) + F.greatest(1.0 - rest_q - t["q"], F.lit(0.0))) / 2)
    return F.sqrt(F.greatest(jsd, F.lit(0.0)))


def class_distance(counts: Column, reference: Column) -> Column:
    """Of class counts and the shares of a reference; null without characters or reference."""

    def compare(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        pairs = F.zip_with(own, reference, lambda c, q: F.struct(c.alias("p"), q.alias("q")))
        return let(total, lambda n: F.when(n > 0, divergence(F.transform(F.filter(pairs, lambda x: x["p"] > 0), lambda x: F.struct((x["p"] / n).alias("p"), x["q"].alias("q"))), F.lit(0.0), F.lit(0.0))))

    return F.when(reference.isNotNull(), let(counts, compare))


def word_distance(words: Column, common: Column, shares: Column, table: Column) -> Column:
    """Of a text's words and the common words of a language with their shares; null without words or reference.

    ``table`` is true at the places of common words' hashes, so that few other words are compared with all of them.
    """

    def compare(found: Column) -> Column:
        # found: places of the text's common words, ascending; runs of equal ones are counted
        starts = F.filter(F.transform(found, lambda x, i: F.when(F.coalesce(x != F.get(found, i - 1), F.lit(True)), i)), lambda i: i.isNotNull())

        def judge(at: Column) -> Column:
            bins = F.transform(at, lambda s, i: F.struct(
                ((F.coalesce(F.get(at, i + 1), F.size(found)) - s) / F.size(words)).alias("p"),
                F.get(shares, (F.get(found, s) - 1).cast("int")).alias("q"),
            ))
            others = (F.size(words) - F.size(found)) / F.size(words)
            return divergence(bins, others, 1.0 - F.aggregate(shares, F.lit(0.0), lambda a, q: a + q))

        return let(starts, judge)

    likely = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: F.get(table, hashed(w)))
    places = F.array_sort(F.filter(F.transform(likely, lambda w: F.array_position(common, w)), lambda k: k > 0))
    return F.when(common.isNotNull() & (F.size(words) > 0), let(places, compare))


def references(docs: DataFrame, keep: Scratch) -> DataFrame:
    """A row a language (null is one too) of (lang, text): lang, ref_words (number), classes (shares), common (words), shares, table.

    Common words are those with at least one in COMMON of all words, so at most COMMON. A first pass counts words by place
    of their hash, a second one counts the words themselves at places that are common: a whole vocabulary is never shuffled.
    """
    classes = docs.select("lang", F.posexplode(class_counts(removed(F.col("text"), BLANK))).alias("k", "n"))
    classes = classes.groupBy("lang", "k").agg(F.sum("n").alias("n")).groupBy(F.col("lang").alias("l1"))
    classes = classes.agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("k", "n"))).alias("x"))
    classes = classes.select("l1", F.transform("x", lambda x: x["n"] / F.greatest(F.col("all"), F.lit(1))).alias("classes"))
    lower = words_of(F.lower("text"))
    places = docs.select("lang", F.explode(F.transform(lower, hashed)).alias("place")).groupBy("lang", "place").agg(F.count("*").alias("n"))
    places = places.groupBy("lang").agg(F.sum("n").alias("ref_words"), F.collect_list(F.struct("place", "n")).alias("x"))
    held = F.transform(F.filter("x", lambda x: x["n"] * COMMON >= F.col("ref_words")), lambda x: x["place"])
    table = let(held, lambda at: F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.array_contains(at, i)))
    places = keep(places.select(F.col("lang").alias("l2"), "ref_words", table.alias("table")))
    words = docs.join(small(places, LANGUAGES), F.col("lang").eqNullSafe(F.col("l2")))
    words = words.select("lang", F.explode(F.filter(lower, lambda w: F.get(F.col("table"), hashed(w)))).alias("word"))
    words = words.groupBy(F.col("lang").alias("l3"), "word").agg(F.count("*").alias("n"))
    words = words.join(places.select("l2", F.col("ref_words").alias("all")), F.col("l3").eqNullSafe(F.col("l2"))).filter(F.col("n") * COMMON >= F.col("all"))
    words = words.groupBy("l3").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("word")))).alias("x"))
    out = places.join(classes, F.col("l1").eqNullSafe(F.col("l2"))).join(words, F.col("l3").eqNullSafe(F.col("l2")))
    return keep(out.select(
        F.col("l2").alias("lang"), "ref_words", "classes", F.col("x.word").alias("common"),
        F.transform("x", lambda x: -x["n"] / F.col("ref_words")).alias("shares"), "table",
    ))


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """Counts and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept.

    A text fails the base rules with fewer than 20 words or more than 30% of them in repeated windows of 8 words. Of the
    others those go that are further than ``class_limit`` from their language's character classes (200 characters at
    least), or than ``word_limit`` from its common words (50 words at least). A reference counts from 1000 words on.

    Null and blank texts have counts 0 and fail; distances are null where there is nothing to compare; a null language is
    one of its own; repeated rows and ids are rows of their own; words that tie for being common are all common; long texts
    are read whole; an empty table gives no rows; other columns aren't read.
    """
    keep = Scratch(docs.sparkSession, "quality")
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = small(references(own, keep).filter(F.col("ref_words") >= LEAST_REFERENCE).withColumnRenamed("lang", "ref_lang"), LANGUAGES)
    own = own.join(known, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    text, words, solid = F.col("text"), F.col("words"), F.col("solid")
    own = own.withColumns({"words": words_of(text), "solid": removed(text, BLANK)}).select(
        "id", F.size(words).cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"),
        (F.length(solid) - F.length(removed(solid, SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"), repeated_words(words).cast("long").alias("n_repeat_words"),
        F.when(F.length(solid) >= LEAST_CHARS, class_distance(class_counts(solid), F.col("classes"))).alias("class_distance"),
        F.when(F.size(words) >= LEAST_WORDS, word_distance(words, F.col("common"), F.col("shares"), F.col("table"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return own.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``."""
    got = judge(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
