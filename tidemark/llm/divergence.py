"""How far the sources of a language differ in their terms: pairs of sources over all terms, and each source's own terms.

The value of a pair is a sum over every kept term of the language, of a rounded function of the term's shares in both
sources. Most terms are absent from most sources, so the sum is that of absent terms plus corrections, and corrections
come from a frequent-pattern tree: a term is the list of its nonzero counts in the order of the sources; equal lists are
one row with a multiplicity; rows that begin alike share a path. What a node's source and an ancestor's source add to
their pair is then worked out once, for all terms that pass through both.

The tree isn't held anywhere: rows are dealt by range and sorted, so rows that share a path are neighbours, and a task
keeps only the path it is on. A path that two tasks share is worked out by both for their own terms; sums stay exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm._common import Scratch, bounded, give_back, partitions_for, read, small, text_batches

#: Shares are whole billionths.
SCALE = 1_000_000_000
#: Distinct terms a task holds before it passes its counts on, and pairs of a node and an ancestor likewise.
HELD = 400_000
#: In UTF-8: A-Z become a-z, other letters and all bytes beyond ASCII stay, the rest of ASCII separates.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WIDE = T.DecimalType(38, 0)


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of anything beyond ASCII in UTF-8; only A-Z are lower-cased."""
    return text.translate(_TO_TERMS).split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows (lang, source, text), summed over what a task has read since it last passed on."""
    uses, docs, held = {}, {}, 0
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in uses.items():
            words, seen = list(own), docs[lang, source]
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                columns += [pa.array([x[w] for w in part], pa.int64()) for x in (own, seen)]
                yield pa.record_batch(columns, schema=kinds)
        uses.clear()
        docs.clear()
        give_back()

    for batch in batches:
        for part in bounded(batch, "text", 4_000_000):
            langs, sources, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(langs, sources, texts, strict=True):
                own = uses.setdefault((lang, source), Counter())
                seen = docs.setdefault((lang, source), Counter())
                before, found = len(own), terms(text)
                own.update(found)
                seen.update(set(found))
                held += len(own) - before
                if held > HELD:
                    yield from out()
                    held = 0
    yield from out()


def div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / size), exact; null where the size is 0."""
    up = (count.cast(T.DecimalType(20, 0)) + 1) * F.lit(SCALE).cast(T.DecimalType(10, 0))
    return F.when(size > 0, div(up, size.cast(T.DecimalType(20, 0))) + 1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs up to about 10^9, so that the square is a long."""
    return div((p - q) * (p - q), q)


def gaps(p, q) -> np.ndarray:
    """The same for arrays."""
    return (p - q) ** 2 // q


def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corrections (lang, a, b, value) of sorted rows (lang, at, p, none, n): sources, shares, shares of absent terms, terms.

    The path holds for every node its source, both shares and the terms that passed so far. When the path leaves a node, the
    node and its ancestors are noted, and worked out together with those of many nodes.
    """
    at, p, none, mult = (np.zeros(16, "i8") for _ in range(4))
    depth, lang = 0, None
    nodes, ancestors, held = [], ([], [], []), 0

    def leave(to: int) -> None:
        """Note the nodes below depth ``to``, deepest first; their terms count for the node above."""
        nonlocal depth, held
        while depth > to:
            depth -= 1
            d = depth
            if d:
                mult[d - 1] += mult[d]
                nodes.append((d, at[d], p[d], none[d], mult[d]))
                for x, y in zip(ancestors, (at, p, none), strict=True):
                    x.append(y[:d].copy())
                held += d

    def out() -> pd.DataFrame:
        """What the noted nodes, all of one language, add to the pairs of sources, as group and as item."""
        nonlocal held
        d, *node = np.array(nodes, "i8").T
        a, pa_, na, m = (np.repeat(x, d) for x in node)
        b, pb, nb = (np.concatenate(x) for x in ancestors)
        nodes.clear()
        held = 0
        for x in ancestors:
            x.clear()
        # both are there, less what each alone was said to add
        one = gaps(pa_, pb) - gaps(pa_, nb) - gaps(na, pb) + gaps(na, nb)
        two = gaps(pb, pa_) - gaps(pb, na) - gaps(nb, pa_) + gaps(nb, na)
        a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([one * m, two * m])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        return pd.DataFrame({"lang": lang, "a": a[first], "b": b[first], "value": np.add.reduceat(value[order], first)})

    for frame in frames:
        for own, path, shares, absent, n in zip(frame["lang"], frame["at"], frame["p"], frame["none"], frame["n"], strict=True):
            if len(path) > len(at):
                at, p, none, mult = (np.concatenate([x, np.zeros(len(path), "i8")]) for x in (at, p, none, mult))
            k = min(depth, len(path)) if own == lang else 0
            differ = np.flatnonzero((at[:k] != path[:k]) | (p[:k] != shares[:k]))
            leave(int(differ[0]) if len(differ) else k)
            if held > HELD or held and own != lang:
                yield out()
            lang = own
            new = slice(depth, len(path))
            at[new], p[new], none[new], mult[new] = path[new], shares[new], absent[new], 0
            depth = len(path)
            mult[depth - 1] += n
    leave(0)
    if held:
        yield out()


def divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               least_docs: int = 3, top: int = 200) -> DataFrame:
    """Audit of sources: (lang, source, part, item, value, rank).

    Terms are the runs of letters and characters beyond ASCII, A-Z lower-cased; a language keeps the V terms of at least
    ``least_docs`` of its rows. A source of a language (and the language) gives a term with count c the share
    p = 1 + floor(10^9 (c + 1) / (N + V)), N being its uses of kept terms, and f = floor((p - q)^2 / q). Part ``pair``: the
    item is another source of the language with share q, the value f summed over all kept terms, absent ones too. Part
    ``term``: the item is a term that occurs in the source with p above the language's q, value f, ranks to ``top``. Ranks
    go by falling value, then item.

    Null language, source and text are ''. Repeated rows are rows of their own; a group without kept terms has pairs all the
    same (value 0 if the language keeps none); an empty table gives no rows; other columns aren't read. Sums are exact while a
    language has fewer than 10^9 kept terms.
    """
    spark = docs.sparkSession
    text_batches(spark)
    keep = Scratch(spark, "audit")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    parts = own.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    used = keep(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    # a row a term of a language: at most one entry a source
    entry = F.struct("source", "n")
    rows = used.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(entry).alias("by"))
    rows = keep(rows.filter(F.col("docs") >= least_docs).select("lang", "term", "all", "by"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    sizes = rows.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = own.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "lang_n", "n")])
    place = F.row_number().over(W.partitionBy("lang").orderBy("source"))
    groups = groups.withColumns({"at": place.cast("long"), "size": F.col("n") + F.col("v"), "lang_size": F.col("lang_n") + F.col("v")})
    groups = keep(groups.withColumn("none", share(F.lit(0), F.col("size"))))
    few = small(groups)

    entries = rows.select("lang", "term", "all", F.explode("by").alias("x")).select("lang", "term", "all", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    entries = entries.join(few.select("lang", "source", "at", "none", "size", "lang_size"), ["lang", "source"])
    entries = entries.withColumns({"p": share(F.col("n"), F.col("size")), "q": share(F.col("all"), F.col("lang_size"))})
    entries = keep(entries.select("lang", "source", "term", "at", "none", "p", "q"))
    out = pairs(groups, few, entries).unionByName(own_terms(entries, top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def own_terms(entries: DataFrame, top: int) -> DataFrame:
    """Part ``term``: ranks are cut in every task before the exchange, so a hot source sends ``top`` rows a task."""
    got = entries.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")
    )
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def corrections(entries: DataFrame) -> DataFrame:
    """What terms in two sources at once add to their pairs: (lang, a, b, value) of both directions."""
    path = F.array_sort(F.collect_list(F.struct("at", "p", "none")))
    lists = entries.groupBy("lang", "term").agg(path.alias("path")).filter(F.size("path") > 1)
    rows = lists.groupBy("lang", "path").agg(F.count("*").alias("n"))
    # ranges by where paths begin: bounds come from a sample on the driver, which short keys keep small
    begin = [F.get("path", F.lit(0))["at"], F.get("path", F.lit(0))["p"], F.get("path", F.lit(1))["at"], F.get("path", F.lit(1))["p"], F.get("path", F.lit(2))["at"]]
    rows = rows.repartitionByRange(partitions_for(entries), "lang", *begin).sortWithinPartitions("lang", "path")
    rows = rows.select("lang", F.col("path.at").alias("at"), F.col("path.p").alias("p"), F.col("path.none").alias("none"), "n")
    return rows.mapInPandas(walked, "lang string, a long, b long, value long")


def pairs(groups: DataFrame, few: DataFrame, entries: DataFrame) -> DataFrame:
    """Part ``pair``: V absent terms, what each source's own terms change, and the tree's corrections."""
    shares = entries.groupBy("lang", "at", "none", "p").agg(F.count("*").alias("n"))
    rows = shares.unionByName(groups.select("lang", "at", "none", F.lit(None).cast("long").alias("p"), F.col("v").alias("n")))
    other = few.select("lang", F.col("at").alias("b"), F.col("none").alias("q"))
    rows = rows.join(other, "lang").filter("at != b")
    n, p, none, q = (F.col(c) for c in ("n", "p", "none", "q"))
    base = F.struct(F.col("at").alias("a"), F.col("b"), (n * gap(none, q)).alias("value"))
    one = F.struct(F.col("at").alias("a"), F.col("b"), (n * (gap(p, q) - gap(none, q))).alias("value"))
    two = F.struct(F.col("b").alias("a"), F.col("at").alias("b"), (n * (gap(q, p) - gap(q, none))).alias("value"))
    rows = rows.select("lang", F.explode(F.when(p.isNull(), F.array(base)).otherwise(F.array(one, two))).alias("x")).select("lang", "x.*")
    got = rows.unionByName(corrections(entries)).groupBy("lang", "a", "b")
    got = got.agg(F.coalesce(F.sum(F.col("value").cast(_WIDE)), F.lit(0)).cast("long").alias("value"))
    name = few.select("lang", "at", "source")
    got = got.join(name.withColumnRenamed("at", "a"), ["lang", "a"])
    got = got.join(name.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return got.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the sources of all ``documents``."""
    return divergence(read(spark, sf_dir, "documents"))
