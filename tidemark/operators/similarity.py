"""Set overlaps, sparse products in long form (row, col, value), and neighbour scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.impressions import unpivot_actions
from tidemark.operators.order import small, stored

#: Rows of a key that one task joins; keys of more on either side are dealt over a grid.
HEAVY = 100_000


def same(a: Column, b: Column) -> Column:
    """1 if both are equal and not null."""
    return F.coalesce((a == b).cast("int"), F.lit(0))


def overlap(a: Column, b: Column, *, scaled: bool = False, skip: Column | None = None) -> Column:
    """Distinct common elements, over the product of the sizes if scaled; elements of ``skip`` don't count."""
    empty = F.array().cast("array<string>")
    a, b = F.array_distinct(F.coalesce(a, empty)), F.array_distinct(F.coalesce(b, empty))
    both = F.array_intersect(a, b)
    n = F.size(both if skip is None else F.array_except(both, skip))
    size = F.size(a) * F.size(b)
    return F.when(size > 0, n / size).otherwise(0.0) if scaled else n


def dot(a: Column, b: Column) -> Column:
    """Product of two arrays of one length; 0 if one is null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def combine(a: Column, b: Column, how: str) -> Column:
    """Element-wise ``add``, ``subtract``, ``multiply``, ``min`` or ``max`` of two arrays of one length (null past the shorter one)."""
    ops = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "min": F.least, "max": F.greatest}
    return F.zip_with(a, b, lambda x, y: ops[how](x.cast("double"), y.cast("double")))


def scaled(a: Column, by: Column | float, *, divide: bool = False) -> Column:
    """An array times or divided by a number (null if that is 0)."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), by) if divide else x.cast("double") * by)


def extremes(a: Column) -> Column:
    """Struct of an array's sum, smallest and largest element; of an empty one 0 and nulls."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.struct(total.alias("sum"), F.array_min(a).alias("min"), F.array_max(a).alias("max"))


def combine_sparse(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """The same for matrices in long form, where what is absent is 0 and zeros of the result are left out."""
    left, right = (m.select("row", "col", F.col("value").alias(n)) for m, n in ((a, "x"), (b, "y")))
    both = left.join(right, ["row", "col"], "inner" if how == "multiply" else "full").fillna(0.0, ["x", "y"])
    x, y = F.col("x"), F.col("y")
    ops = {"add": x + y, "subtract": x - y, "multiply": x * y, "min": F.least(x, y), "max": F.greatest(x, y)}
    return both.select("row", "col", ops[how].alias("value")).filter("value <> 0")


def grid_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, heavy: int | None = None) -> DataFrame:
    """Inner join of two stored frames on ``key``, whose pairs of rows are all wanted, without a task for a heavy key.

    Degrees come first. A key with more than ``heavy`` rows on a side is cut into blocks of about so many by hashes of
    ``left_id`` and ``right_id``, and every block of one side meets every block of the other in a task of its own; all other
    keys are joined plainly. Null keys match nothing.
    """
    heavy = heavy or HEAVY
    down = left.groupBy(key).agg(F.count("*").alias("_l"))
    across = right.groupBy(key).agg(F.count("*").alias("_r"))
    grid = down.join(across, key).filter((F.col("_l") > heavy) | (F.col("_r") > heavy))
    grid = stored(grid.select(key, F.ceil(F.col("_l") / heavy).cast("int").alias("_down"), F.ceil(F.col("_r") / heavy).cast("int").alias("_across")), "grid")
    if grid.isEmpty():
        return left.join(right, key)
    grid = small(grid)

    def dealt(df: DataFrame, own: str, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64(own), F.coalesce(mine, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)) - 1))
        out = df.join(grid, key, "left").withColumns({"_own": block, "_other": every})
        a, b = ("_own", "_other") if mine == "_down" else ("_other", "_own")
        return out.select(*df.columns, F.col(a).alias("_i"), F.col(b).alias("_j"))

    both = dealt(left, left_id, "_down", "_across").join(dealt(right, right_id, "_across", "_down"), [key, "_i", "_j"])
    return both.drop("_i", "_j")


def sparse_dots(m: DataFrame, pairs: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Products of the rows (a, b) asked for: a, b, value (0 if nothing in common)."""
    asked = stored(pairs.select("a", "b").distinct(), "pairs")
    left = grid_join(asked, stored(m.select(F.col(row).alias("a"), F.col(col).alias("c"), F.col("value").alias("x")), "left"), "a", "b", "c")
    right = m.select(F.col(row).alias("b"), F.col(col).alias("c"), F.col("value").alias("y"))
    got = left.join(right, ["b", "c"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    return asked.join(got, ["a", "b"], "left").fillna(0.0, ["value"])


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse matrix product of (row, col, value) frames; an inner index that is heavy in both is dealt over a grid."""
    left = stored(a.select(F.col("row"), F.col("col").alias("k"), F.col("value").alias("x")), "left")
    right = stored(b.select(F.col("row").alias("k"), F.col("col"), F.col("value").alias("y")), "right")
    return grid_join(left, right, "k", "row", "col").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), *[c for c in m.columns if c not in ("row", "col")])


def times_vector(m: DataFrame, v: DataFrame, *, left: bool = False) -> DataFrame:
    """Matrix times vector (index, v), or vector times matrix: index, value."""
    by, out = ("row", "col") if left else ("col", "row")
    got = m.join(v.withColumnRenamed("index", by), by).groupBy(F.col(out).alias("index"))
    return got.agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def gram(m: DataFrame) -> DataFrame:
    """Products of all columns with each other."""
    return product(transpose(m), m)


def item_similarity(pairs: DataFrame, contents: DataFrame, counts: DataFrame) -> DataFrame:
    """Likenesses of item pairs (a, b): same language and type; common tokens, media, domains, links and tags; and the products
    of their creators as columns and as rows of the user x creator counts.

    ``contents`` has a row an item with its creator. Products are made once per pair of creators, overlaps once per pair of
    items. An item without contents is unlike all others.
    """
    cols = ["language", "type", "tokens", "media", "domain", "links", "hashtags"]
    a = contents.select(F.col("tweet_id").alias("a"), F.col("creator_id").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = contents.select(F.col("tweet_id").alias("b"), F.col("creator_id").alias("cb"), *[F.col(c).alias(f"b_{c}") for c in cols])
    made = contents.select("tweet_id", "creator_id")
    pairs = pairs.select("a", "b").distinct()
    makers = pairs.join(made.toDF("a", "ca"), "a").join(made.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    by_creator = counts.select(F.col("creator_id").alias("row"), F.col("user_id").alias("col"), F.col("n").cast("double").alias("value"))
    seen = sparse_dots(by_creator, makers).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("value").alias("seen_by"))
    sees = sparse_dots(transpose(by_creator), makers).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("value").alias("sees"))
    out = pairs.join(a, "a", "left").join(b, "b", "left").join(seen, ["ca", "cb"], "left").join(sees, ["ca", "cb"], "left")
    return out.select(
        "a", "b", *[same(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(c) for c in ("language", "type", "domain")],
        *[overlap(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(c) for c in ("tokens", "media", "links", "hashtags")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("seen_by", "sees")],
    )


SIMILARITIES = ["language", "type", "domain", "tokens", "media", "links", "hashtags", "seen_by", "sees"]


def user_item_similarity(targets: DataFrame, hist: DataFrame, contents: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean likeness of each target row's item to the items its user acted on, per action.

    A user's actions are first counted per item, so a pair of items is compared once and weighted.
    """
    acted = unpivot_actions(hist).groupBy("user_id", "action", F.col("tweet_id").alias("b")).agg(F.count("*").alias("w"))
    asked = stored(targets.select("engage_index", "user_id", F.col("tweet_id").alias("a")), "asked")
    rows = stored(grid_join(asked, stored(acted, "acted"), "user_id", "engage_index", "b"), "rows")
    sims = item_similarity(rows.select("a", "b"), contents, counts)
    got = rows.join(sims, ["a", "b"]).groupBy("engage_index", "action")
    return got.agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in SIMILARITIES])


def normalised(counts: DataFrame) -> DataFrame:
    """creator x user counts with every user's column, then every creator's row, scaled to length one: row, col, value."""
    m = counts.select(F.col("creator_id").alias("row"), F.col("user_id").alias("col"), F.col("n").cast("double").alias("value"))
    for by, least in (("col", 1e-10), ("row", 1e-5)):
        norms = m.groupBy(by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        m = m.join(norms, by).withColumn("value", F.when(F.col("norm") > least, F.col("value") / F.col("norm")).otherwise(F.col("value"))).drop("norm")
    return m


def item_scores(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of (user_id, creator_id): the sum, over creators the user acted with, of their rows' product with this one.

    Creators' rows are multiplied first, over the columns that two of them share: a user costs the square of the creators in
    their own history, not the users of each of those. Only rows of the asked users' creators meet the creators asked for.
    """
    counts = stored(counts, "counts")
    m = stored(normalised(counts), "normalised")
    wanted = stored(pairs.select("user_id", "creator_id").distinct(), "wanted")
    users = counts.join(wanted.select("user_id").distinct(), "user_id", "left_semi").select("user_id", F.col("creator_id").alias("own"))
    users = stored(users, "users")
    own = m.join(users.select(F.col("own").alias("row")).distinct(), "row", "left_semi").select("col", F.col("row").alias("own"), F.col("value").alias("x"))
    asked = m.join(wanted.select(F.col("creator_id").alias("row")).distinct(), "row", "left_semi")
    asked = asked.select("col", F.col("row").alias("creator_id"), F.col("value").alias("y"))
    likes = grid_join(stored(own, "own"), stored(asked, "asked"), "col", "own", "creator_id")
    likes = stored(likes.groupBy("own", "creator_id").agg(F.sum(F.col("x") * F.col("y")).alias("value")), "likes")
    got = grid_join(wanted, users, "user_id", "creator_id", "own").join(small(likes), ["own", "creator_id"])
    got = got.groupBy("user_id", "creator_id").agg(F.sum("value").alias("score"))
    return wanted.join(got, ["user_id", "creator_id"], "left").fillna(0.0, ["score"])


def user_scores(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of (user_id, creator_id): the sum, over users who acted with the creator, of their rows' product with the user's."""
    m = counts.select("user_id", F.col("creator_id").alias("col"), F.col("n").cast("double").alias("value"))
    wanted = pairs.select("user_id", "creator_id").distinct()
    who = counts.select(F.col("user_id").alias("v"), "creator_id").join(wanted.select("creator_id").distinct(), "creator_id", "left_semi")
    sums = who.join(m.select(F.col("user_id").alias("v"), "col", "value"), "v").groupBy("creator_id", "col").agg(F.sum("value").alias("s"))
    got = wanted.join(sums, "creator_id").join(m, ["user_id", "col"])
    got = got.groupBy("user_id", "creator_id").agg(F.sum(F.col("s") * F.col("value")).alias("score"))
    return wanted.join(got, ["user_id", "creator_id"], "left").fillna(0.0, ["score"])


def evaluate_scores(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Neighbour scores by themselves: area under the curve through the rows (engage_index, user_id, creator_id and a label per
    action), ordered by ``item_scores``, per action."""
    from tidemark.operators.impressions import ACTIONS
    from tidemark.operators.metrics import pr_auc_rows

    scores = item_scores(counts, rows).withColumn("score", F.round("score", 9))  # sums in another order must not reorder ties
    scored = rows.join(scores, ["user_id", "creator_id"], "left").fillna(0.0, ["score"])
    each = F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"{a}_label").alias("label")) for a in ACTIONS])
    long = scored.select("engage_index", "score", F.explode(each).alias("x")).select("engage_index", "score", "x.*")
    return pr_auc_rows(long, "engage_index")
