"""Writers of features, predictions and matrices. All go through Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(v: Column) -> Column:
    """Whole numbers without decimals, others with five."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.5f", v))


def libsvm_lines(m: DataFrame, labels: DataFrame, *, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``label index:value ...`` per row of (row, col, value), columns ascending; rows without nonzeros have the label only."""
    pairs = F.sort_array(F.collect_list(F.struct("col", F.concat_ws(":", F.col("col").cast("string"), number(F.col("value"))).alias("p"))))
    text = m.groupBy("row").agg(pairs.alias("x")).select("row", F.array_join("x.p", " ").alias("t"))
    line = F.concat_ws(" ", F.col("label").cast("string"), F.nullif("t", F.lit("")))
    return labels.join(text, "row", "left").select("row", *keep, line.alias("value"))


def write_libsvm(m: DataFrame, labels: DataFrame, path: str, *, partition_by: list[str]) -> None:
    """A folder for each combination of the partition columns (action, split), one line a row."""
    libsvm_lines(m, labels, keep=partition_by).drop("row").write.partitionBy(*partition_by).text(path)


def write_dense_csv(df: DataFrame, path: str, *, labels: list[str], features: str, keys: list[str]) -> None:
    """Zero-filled feature arrays as columns between labels (none for unlabelled data) and ids."""
    n = df.select(F.max(F.size(features))).first()[0] or 0
    flat = [F.coalesce(F.get(features, F.lit(i)), F.lit(0.0)).alias(f"f{i}") for i in range(n)]
    df.select(*labels, *flat, *keys).write.csv(path)


def history_text(items: Column) -> Column:
    """``id|id|`` of a list."""
    return F.concat(F.array_join(items, "|"), F.when(F.size(items) > 0, F.lit("|")).otherwise(F.lit("")))


def write_history_csv(df: DataFrame, path: str, *, labels: list[str], features: list[str], histories: list[str], keys: list[str]) -> None:
    df.select(*labels, *features, *[history_text(F.col(h)).alias(h) for h in histories], *keys).write.csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """tweet,user,score with eight decimals, in a folder for each action."""
    df.select("action", "tweet_id", "user_id", F.format_string("%.8f", "score").alias("score")).write.partitionBy("action").csv(path)


def write_chunks(train: DataFrame, valid: DataFrame, path: str) -> None:
    """All chunks of a training set at once, the validation rows with chunk 0."""
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumns({"part": F.lit("valid"), "chunk": F.lit(0)}))
    both.write.partitionBy("part", "chunk").mode("overwrite").parquet(path)


def write_snapshot(df: DataFrame, path: str, *, compression: str = "gzip") -> None:
    df.write.option("compression", compression).parquet(path)


def write_triplets(m: DataFrame, path: str) -> None:
    """row, col, value[, date] of every nonzero."""
    m.filter("value <> 0").write.csv(path)


def write_corpus(df: DataFrame, col: str, path: str) -> None:
    """One distinct text a line."""
    df.select(col).distinct().write.text(path)


def embedding_rows(rows: DataFrame, vecs: DataFrame) -> DataFrame:
    """(row, id) with the ids' vectors in row order; raises if an id has none or a row is given twice."""
    out = rows.join(vecs, "id", "left")
    bad = out.groupBy("row").agg(F.count("*").alias("n"), F.count("vec").alias("v")).filter("n <> 1 or v <> 1")
    if not bad.isEmpty():
        raise ValueError("embedding rows that aren't filled exactly once")
    return out.orderBy("row")


def write_id_map(ids: DataFrame, path: str) -> None:
    ids.write.csv(path)
