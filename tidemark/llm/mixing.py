"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document starts with rate 1. The rates nearest to that in (two-sided) relative entropy under the token
constraint of each source are exponentially tilted ones, ``r = c * e^(l x) / (c - 1 + e^(l x))`` with the document's
scaled size ``x`` and the copy limit ``c``; the multiplier ``l`` of a source solves its convex dual. Distributed Newton
steps find all multipliers together: sizes are first counted per (source, size), so a step is one small equi-join and
one aggregation with map-side combine, whatever share of the rows a source holds.

Rates become copies by shifted threshold rounding: a document gets the next whole copy if its hash minus the
fractional part of its rate lies below a threshold of its source. Thresholds come from histograms of a fixed number
of bins, first for long documents, then for ever shorter ones that make up what the long ones left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm._common import WORD, Scratch, numbered, read

#: Bins of a rounding histogram; two passes give BINS * BINS thresholds.
BINS = 512
#: Documents of at least so many words are rounded together, long ones first.
CLASSES = (4096, 512, 64, 0)
STEPS = 60


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: list[float], share: float, limit: float, keep: Scratch) -> DataFrame:
    """Targets of sources: weight shares of ``share`` times all words, none above ``limit`` times its source's words.

    ``per_source`` has src, source_size. What a limited source can't take is shared again by weight among the others
    until no target is above its limit. Adds wt, target.
    """
    # global ranks without one task for all: ranks inside ranges of sources, plus the rows of the ranges before
    ranged = keep(per_source.repartitionByRange(F.col("src").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    order = W.partitionBy("part").orderBy(F.col("src").asc_nulls_last())
    starts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    before = starts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranged.join(before, "part").withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("wt", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = keep(ranked.withColumn("most", F.col("source_size") * F.lit(float(limit))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:  # each turn is one aggregation to a single row; the set of limited sources only grows
        over = F.lit(False) if level is None else F.col("most") <= F.col("wt") * F.lit(level)
        got = ranked.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.sum(F.when(over, F.col("most"))).alias("full"),
            F.sum(F.when(~over, F.col("wt"))).alias("open"),
        ).first()
        if got["n"] == held or not got["open"]:
            break
        held, level = got["n"], (share * total - (got["full"] or 0.0)) / got["open"]
    target = F.least("most", F.col("wt") * F.lit(level if level is not None else 0.0))
    return ranked.select("src", "source_size", "most", "wt", target.alias("target"))


def tilt(multiplier: Column, size: Column, mean: Column, limit: float) -> Column:
    """Rate of a document: 1 at multiplier 0, between 0 and ``limit``."""
    up = F.exp(F.least(F.greatest(multiplier * size / mean, F.lit(-700.0)), F.lit(700.0)))
    return F.lit(limit) * up / (F.lit(limit - 1.0) + up)


def multipliers(hist: DataFrame, targets: DataFrame, limit: float, keep: Scratch) -> DataFrame:
    """Newton steps on the dual of every source at once, kept inside a bracket; returns src key, lam, mean.

    hist: src, size, n (documents); targets: src, source_size, target, most. A source whose target is its limit gets no
    multiplier (null: every document at the limit); one with target 0 gets none of its documents either (mean null). A dual that
    isn't solved to 1e-9 after STEPS steps, of which those outside the bracket halve it, is an error.
    """
    docs = hist.groupBy(F.col("src").alias("s2")).agg(F.sum("n").alias("docs"))
    state = targets.join(docs, F.col("src").eqNullSafe(F.col("s2")))
    state = state.select(
        "src", "target", "most", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(1.0).alias("err"),
    )
    todo = (F.col("target") > 0) & (F.col("target") < F.col("most") * (1 - 1e-12))
    for _ in range(STEPS):
        r = tilt(F.col("lam"), F.col("size"), F.col("mean"), limit)
        # dr/dl = x r (1 - r / limit)
        sums = (
            hist.withColumnRenamed("src", "s2")
            .join(state.filter(todo), F.col("src").eqNullSafe(F.col("s2")))
            .groupBy("s2")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("f"),
                F.sum(F.col("n") * F.col("size") * (F.col("size") / F.col("mean")) * r * (1 - r / limit)).alias("d"),
            )
        )
        nxt = state.join(sums, F.col("src").eqNullSafe(F.col("s2")), "left")
        gap = F.col("f") - F.col("target")
        nxt = nxt.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
        nxt = nxt.withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        wide = F.greatest(F.lit(2.0), F.abs("lam"))
        step = F.greatest(-wide, F.least(wide, -gap / F.col("d")))
        step = F.when(F.col("d") > 0, step).otherwise(F.when(gap > 0, -wide).otherwise(wide))
        raw = F.col("lam") + step
        mid = (F.col("lo") + F.col("hi")) / 2
        out = (F.col("lo").isNotNull() & (raw <= F.col("lo"))) | (F.col("hi").isNotNull() & (raw >= F.col("hi")))
        new = F.when(gap.isNull() | (gap == 0), F.col("lam")).otherwise(
            F.when(out & mid.isNotNull(), mid).otherwise(raw)
        )
        state = keep(
            nxt.select("src", "target", "most", "source_size", "mean", new.alias("lam"), "lo", "hi",
                       F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)).alias("err"))
        )
        err = state.agg(F.max("err")).first()[0] or 0.0
        if err < 1e-9:
            return state
    raise RuntimeError(f"multipliers are off by {err} of a target after {STEPS} steps")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, seed: int = 7,
) -> DataFrame:
    """Decide the copies of every document in a mix of sources.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words; a target stops at
    ``limit`` times its source's words. Returns every row of ``docs`` as (id, source, size, source_size, target, rate,
    copies, taken). Null text has size 0 and takes nothing; a null source is a source of its own; documents without words
    get copies 0; repeated rows are separate documents that are rounded alike; an empty table gives no rows. Further
    columns of ``docs`` are not read. ``limit`` is a whole number of copies.
    """
    spark_docs = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), sizes(docs, text_col).alias("size")
    )
    keep = Scratch(docs.sparkSession, "mix")
    base = keep(spark_docs)
    hist = keep(base.filter("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")))
    per = base.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(per, list(weights), share, limit, keep))
    state = multipliers(hist, targets, limit, keep)

    goal = targets.withColumnRenamed("src", "s2").join(
        state.select(F.col("src").alias("s3"), "mean", "lam"), F.col("s2").eqNullSafe(F.col("s3")), "left"
    )
    full = F.col("target") >= F.col("most") * (1 - 1e-12)
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0)).when(full, F.lit(float(limit)))
    # rounded, as sums of doubles in another order differ in their last bits and reruns must agree
    rate = rate.otherwise(tilt(F.round("lam", 9), F.col("size"), F.col("mean"), limit))
    rated = base.join(goal, F.col("src").eqNullSafe(F.col("s2")), "left").withColumn("rate", rate)
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.least(F.floor("rate"), F.lit(int(limit)))
    rated = rated.select(
        "id", "src", "size", "source_size", "target", "rate", whole.alias("whole"),
        (unit - (F.col("rate") - whole)).alias("d"),  # below 0: an unshifted rounding takes the extra copy
    )
    rated = keep(rated)
    cuts = thresholds(rated, targets, int(limit), keep)
    keep.clear(rated, cuts)
    klass = F.lit(len(CLASSES) - 1)
    for i in reversed(range(len(CLASSES) - 1)):
        klass = F.when(F.col("size") >= CLASSES[i], F.lit(i)).otherwise(klass)
    done = rated.withColumn("klass", klass).join(
        cuts, F.col("src").eqNullSafe(F.col("s2")) & (F.col("klass") == F.col("k2")), "left"
    )
    extra = (F.col("whole") < int(limit)) & (F.col("size") > 0) & (F.col("rate") > 0) & (F.col("d") < F.col("cut"))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return done.select(
        "id", F.col("src").alias("source"), "size", "source_size", "target", "rate", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def thresholds(rated: DataFrame, targets: DataFrame, limit: int, keep: Scratch) -> DataFrame:
    """Rounding threshold per source and size class: s2, k2, cut."""
    left = targets.select(F.col("src").alias("s2"), F.col("target").alias("due"))
    base = rated.groupBy(F.col("src").alias("s3")).agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    # what whole copies don't cover, less what rounding gives to the classes yet to come when unshifted
    left = keep(
        left.join(base, F.col("s2").eqNullSafe(F.col("s3")), "left").select(
            "s2", (F.col("due") - F.coalesce("sure", F.lit(0))).alias("due")
        )
    )
    open_ = rated.filter((F.col("size") > 0) & (F.col("whole") < limit) & (F.col("rate") > 0))
    cuts = None
    for k, least in enumerate(CLASSES):
        most = CLASSES[k - 1] if k else None
        own = open_.filter(F.col("size") >= max(least, 1))
        own = own if most is None else own.filter(F.col("size") < most)
        later = open_.filter(F.col("size") < max(least, 1))
        # the fractional parts of shorter documents stay theirs; this class aims at the rest
        rest = later.groupBy(F.col("src").alias("s3")).agg(
            F.sum(F.col("size") * (F.col("rate") - F.col("whole"))).alias("later")
        )
        aim = keep(
            left.join(rest, F.col("s2").eqNullSafe(F.col("s3")), "left").select(
                "s2", "due", (F.col("due") - F.coalesce("later", F.lit(0.0))).alias("aim")
            )
        )
        lo, width = aim.select("s2", "due", "aim", F.lit(-1.0).alias("lo"), F.lit(0).cast("long").alias("got")), 2.0
        for _ in range(2):
            lo = keep(narrow(own, lo, width))
            width /= BINS
        part = lo.select("s2", F.lit(k).alias("k2"), F.col("cut"))
        cuts = part if cuts is None else cuts.unionByName(part)
        left = lo.select("s2", (F.col("due") - F.col("took")).alias("due"))
    return keep(cuts)


def narrow(own: DataFrame, state: DataFrame, width: float) -> DataFrame:
    """One histogram pass: the bin in which the running words of extra copies cross the aim of each source.

    state: s2, due, aim, lo (start of the interval), got (words below it). Adds cut, took: the bin edge with the nearest
    sum. Bins are at most BINS a source, so the running sum works on a bounded group.
    """
    keep = state.select("s2", "due", "aim", "lo", "got")
    one = width / BINS
    bins = own.join(keep.select("s2", "lo"), F.col("src").eqNullSafe(F.col("s2")))
    bins = bins.filter((F.col("d") >= F.col("lo")) & (F.col("d") < F.col("lo") + F.lit(width)))
    at = F.least(F.floor((F.col("d") - F.col("lo")) / F.lit(one)), F.lit(BINS - 1)).cast("int")
    bins = bins.groupBy(F.col("src").alias("s3"), at.alias("bin")).agg(F.sum("size").alias("w"))
    run = W.partitionBy("s3").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = bins.select("s3", "bin", "w", F.sum("w").over(run).alias("upto"))
    seen = run.join(keep, F.col("s2").eqNullSafe(F.col("s3")))
    seen = seen.select("s3", "bin", "w", "upto", "aim", "got", (F.col("aim") - F.col("got")).alias("need"))
    best = seen.groupBy("s3").agg(
        F.min(F.when(F.col("upto") > F.col("need"), F.struct("bin", F.col("upto").alias("upto"), "w"))).alias("cross"),
        F.sum("w").alias("all"),
    )
    out = keep.join(best, F.col("s2").eqNullSafe(F.col("s3")), "left")
    none = F.col("cross").isNull()
    below = F.col("got") + F.when(none, F.coalesce("all", F.lit(0))).otherwise(F.col("cross.upto") - F.col("cross.w"))
    start = F.when(none, F.col("lo") + F.lit(width - one)).otherwise(F.col("lo") + F.col("cross.bin") * F.lit(one))
    above = F.col("got") + F.col("cross.upto")
    up = ~none & (above - F.col("aim") < F.col("aim") - below)
    cut = F.when(none, F.col("lo") + F.lit(width)).when(up, start + F.lit(one)).otherwise(start)
    took = F.when(up, above).otherwise(below)
    # a source whose sum never crosses keeps what it has; the next pass looks at an empty interval
    return out.select(
        "s2", "due", "aim", F.when(none, F.lit(9.0)).otherwise(start).alias("lo"), below.cast("long").alias("got"),
        F.when(F.col("lo") >= 9.0, F.lit(9.0)).otherwise(cut).alias("cut"), took.cast("long").alias("took"),
    )


def repeat_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                **settings) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as its copies say, rows without copies left out.

    Columns stay as they are. Settings are those of ``mix``.
    """
    own, name = numbered(docs)
    key, text, source = name[id_col], name[text_col], name[source_col]
    got = mix(own, id_col=key, text_col=text, source_col=source, **settings)
    got = got.filter("copies > 0").select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    ).distinct()
    same = (
        F.col(key).eqNullSafe(F.col("_id"))
        & F.col(source).cast("string").eqNullSafe(F.col("_source"))
        & (sizes(own, text) == F.col("_size"))
    )
    out = own.join(got, same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*name.values()).toDF(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents`` at production settings."""
    got = mix(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "source", "rate")
