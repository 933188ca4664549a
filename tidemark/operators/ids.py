"""Identities, dictionaries and encodings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.order import global_index, small, stored

# The log's codes of its most frequent languages, and two-letter codes of other sources; any other is "other".
LANGUAGES = {
    "D3164C7FBCF2565DDF915B1B3AEFB1DC": "english",
    "22C448FF81263D4BAF2A176145EE9EAD": "japanese",
    "06D61DCBBE938971E1EA0C38BD9B5446": "spanish",
    "ECED8A16BE2A5E8871FD55F4842F16B1": "portuguese",
    "B9175601E87101A984A50F8A62A1C374": "croatian",
    "4DC22C3F31C5C43721E6B5815A595ED6": "turkish",
    "167115458A0DBDFF7E9C0C53A83BAC9B": "arabic",
    "022EC308651FACB02794A8147AEE1B78": "thai",
    "FA3F382BC409C271E3D6EAF8BE4648DD": "french",
    "125C57F4FA6D4E110983FB11B52EFD4E": "korean",
    "9BF3403E0EB7EA8A256DA9019C0B0716": "indonesian",
    "975B38F44D65EE42A547283787FF5A21": "hindi",
    "2996EB2FE8162C076D070A4C8D6532CD": "filipino",
    "FF60A88F53E63000266F8B9149E35AD9": "german",
    "717293301FE296B0B61950D041485825": "italian",
    "3820C29CBCA409A33BADF68852057C4A": "russian",
    "3E16B11B7ADE3A22DDFC4423FBCEAD5D": "persian",
    "9ECD42BC079C20F156F53CB3B99E600E": "polish",
    "76B8A9C3013AE6414A3E6012413CDC3B": "chinese",
    "AEF22666801F0A5846D853B9CEB2E327": "urdu",
    "190BA7DA361BC06BC1D7E824C378064D": "catalan",
    "1FFD2FE4297F5E70EBC6C3230D95CB9C": "dutch",
    "D413F5FE5236E5650A46FD983AB39212": "tamil",
    "A0C7021AD8299ADF0C9EBE326C115F6F": "telugu",
    "48236EC80FDDDFADE99420ABC9210DDF": "swahili",
    "en": "english", "fr": "french", "de": "german", "es": "spanish", "ja": "japanese", "pt": "portuguese",
}


def assign_ids(df: DataFrame, cols: list[str], pos: str, *, id_col: str = "id", name: str = "index") -> DataFrame:
    """Dense 0-based ids of the distinct values of ``cols``, one id space, in first-seen order.

    A row's columns count in the order given; ``pos`` is the position of a row. Nulls get no id.
    """
    n = len(cols)
    pairs = F.array(*[F.struct(F.col(c).alias("v"), (F.col(pos) * n + i).alias("p")) for i, c in enumerate(cols)])
    seen = df.select(F.explode(pairs).alias("x")).filter("x.v is not null")
    first = seen.groupBy(F.col("x.v").alias(id_col)).agg(F.min("x.p").alias("first"))
    return global_index(first, "first", name=name).select(id_col, name)


def index_to_id(df: DataFrame, dictionary: DataFrame, index: str, *, id_col: str = "id", name: str = "index") -> DataFrame:
    """Replaces an index column by the id it stands for (null if unknown)."""
    d = dictionary.select(F.col(name).alias("_i"), F.col(id_col).alias("_id"))
    return df.join(d, F.col(index) == F.col("_i"), "left").drop("_i", index).withColumnRenamed("_id", index)


def first_record_wins(df: DataFrame, key: str, pos: str, cols: list[str]) -> DataFrame:
    """Attributes of each entity from the first row that mentions it, and how many distinct values each ever had."""
    firsts = [F.min_by(F.struct(*cols), F.col(pos)).alias("f")]
    kinds = [F.count_distinct(c).alias(f"{c}_kinds") for c in cols]
    out = df.groupBy(key).agg(*firsts, *kinds)
    return out.select(key, *[F.col(f"f.{c}").alias(c) for c in cols], *[f"{c}_kinds" for c in cols])


def dictionary(values: DataFrame, col: str, *, preset: DataFrame | None = None, pos: str | None = None) -> DataFrame:
    """category -> cat: first-seen order by ``pos``, or by value without one; new ones go after a preset dictionary."""
    order = F.min(pos) if pos else F.min(col)
    first = values.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(order.alias("first"))
    if preset is None:
        return global_index(first, "first", "category", name="cat").select("category", "cat")
    start = preset.agg(F.coalesce(F.max("cat") + 1, F.lit(0))).first()[0]
    new = global_index(first.join(preset, "category", "left_anti"), "first", "category", name="cat")
    return preset.select("category", "cat").unionByName(new.select("category", (F.col("cat") + start).alias("cat")))


def shared_dictionary(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """One dictionary over columns of several frames."""
    return dictionary(reduce(DataFrame.unionByName, [f.select(F.col(c).alias("v")) for f, c in frames]), "v")


def encode_multihot(df: DataFrame, row: str, col: str, dictionary: DataFrame, weight: Column | None = None) -> DataFrame:
    """Array of tokens -> (row, cat, value): repeats are summed, tokens the dictionary lacks are dropped."""
    one = F.lit(1.0) if weight is None else weight
    tokens = df.select(row, F.explode(col).alias("category"), one.alias("w"))
    return tokens.join(dictionary, "category").groupBy(row, "cat").agg(F.sum("w").alias("value"))


def encode_category(df: DataFrame, row: str, col: str, dictionary: DataFrame) -> DataFrame:
    """A whole string is one category of value 1; unknown ones give no row."""
    d = dictionary.withColumnRenamed("category", col)
    return df.select(row, col).join(d, col).select(row, "cat", F.lit(1.0).alias("value"))


def encode_numeric(df: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """Columns as (row, cat, value) nonzeros."""
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("cat"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    return df.select(row, F.explode(F.filter(pairs, lambda p: p["value"] != 0)).alias("p")).select(row, "p.*")


def select_columns(nonzeros: DataFrame, row: str, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Keeps categories that occur in more than ``cutoff`` rows, renumbered in their order; also old -> new."""
    counts = nonzeros.groupBy("cat").agg(F.count("*").alias("rows")).filter(F.col("rows") > cutoff)  # a row has a category once
    kept = global_index(counts.select("cat"), "cat", name="new")
    return nonzeros.join(kept, "cat").drop("cat").withColumnRenamed("new", "cat"), kept


def encode_frequent(df: DataFrame, row: str, col: str, cutoff: int) -> DataFrame:
    """Array of tokens -> (row, cat, value) for tokens of more than ``cutoff`` rows, numbered in their own order.

    The same as a dictionary of all tokens, ``encode_multihot`` and ``select_columns``, but repeats are counted before
    anything is joined and only frequent tokens get a number. Counts are stored, and shuffled only if ``df`` isn't dealt by ``row``.
    """
    counts = df.select(row, F.explode(col).alias("category")).groupBy(row, "category").agg(F.count("*").cast("double").alias("value"))
    counts = stored(counts, "counts")
    often = counts.groupBy("category").agg(F.count("*").alias("rows")).filter(F.col("rows") > cutoff)
    kept = global_index(often.filter("category is not null").select("category"), "category", name="cat")
    return counts.join(small(stored(kept, "kept")), "category").select(row, "cat", "value")


def looked_up(df: DataFrame, key: str, own: Column | str, table: DataFrame, on: str, value: str, *, missing=None, cells: int = 1 << 21) -> DataFrame:
    """(key, array) with the values that a table of distinct ``on`` has for an array's elements; those it lacks become
    ``missing``, or go if that is None. Rows of one key become one, by place and value; a key without elements is left out.

    For tables too large to broadcast: rows are dealt by key into groups of about ``cells`` elements, a group asks the table
    once for each of its different elements, and answers meet its rows in Arrow. So elements aren't exchanged one by one.
    """
    kind = {c: table.schema[c].dataType.simpleString() for c in (on, value)}
    own = (F.col(own) if isinstance(own, str) else own).cast(f"array<{kind[on]}>")
    groups = (df.agg(F.sum(F.greatest(F.size(own), F.lit(0)).cast("long"))).first()[0] or 0) // cells + 1
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups)
    # arrays are made after the exchange, which both uses of the rows share
    rows = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).repartition(parts, "_group").select("_group", key, own.alias("_own"))

    def asked(rows: pa.Table) -> pa.Table:
        own = pc.unique(pc.list_flatten(rows["_own"])).drop_null()
        return pa.table({"_group": pa.repeat(rows["_group"][0], len(own)), "_on": own})

    def answered(rows: pa.Table, got: pa.Table) -> pa.Table:
        sizes = pc.fill_null(pc.list_value_length(rows["_own"]), 0).to_numpy()
        keys = rows[key].combine_chunks().dictionary_encode(null_encoding="encode")
        owner = np.repeat(keys.indices.to_numpy(), sizes)
        at = pc.index_in(pc.list_flatten(rows["_own"]), value_set=got["_on"]).combine_chunks()
        values = got["_value"].combine_chunks().take(at)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if missing is None:
            known = at.is_valid().to_numpy(zero_copy_only=False)
            values, owner, place = values.filter(pa.array(known)), owner[known], place[known]
        else:
            values = values.fill_null(missing)
        if len(keys.dictionary) < len(sizes):  # keys repeat
            flat = pa.table({"owner": owner, "place": place, "value": values})
            values = values.take(pc.sort_indices(flat, [(c, "ascending") for c in flat.column_names], null_placement="at_start"))
        counts = np.bincount(owner, minlength=len(keys.dictionary))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.table({key: keys.dictionary, "_values": pa.ListArray.from_arrays(ends, values)}).filter(pa.array(counts > 0))

    wanted = rows.groupBy("_group").applyInArrow(asked, f"_group long, _on {kind[on]}")
    answers = wanted.join(table.select(F.col(on).alias("_on"), F.col(value).alias("_value")), "_on").select("_group", "_on", "_value")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, _values array<{kind[value]}>"
    return rows.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(answered, schema)


@dataclass
class Dictionary:
    """A fitted dictionary (category, cat) that encodes other frames, and can be stored and read again."""

    table: DataFrame

    @classmethod
    def fit(cls, values: DataFrame, col: str, *, preset: DataFrame | None = None, pos: str | None = None) -> Dictionary:
        return cls(dictionary(values, col, preset=preset, pos=pos))

    def transform(self, df: DataFrame, row: str, col: str) -> DataFrame:
        """(row, cat, value): a string is one category, an array one a token; categories unknown at the fit are dropped."""
        many = df.schema[col].dataType.typeName() == "array"
        return (encode_multihot if many else encode_category)(df, row, col, self.table)

    def save(self, path: str) -> None:
        self.table.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        return cls(spark.read.parquet(path))


def feature_names(dictionary: DataFrame, prefix: str, kept: DataFrame | None = None) -> DataFrame:
    """cat, name: the prefix and the category with white space replaced, for the kept categories if given."""
    name = F.regexp_replace(F.concat_ws("_", F.lit(prefix), F.col("category").cast("string")), r"\s", "_")
    if kept is None:
        return dictionary.select("cat", name.alias("name"))
    return dictionary.join(kept, "cat").select(F.col("new").alias("cat"), name.alias("name"))


def width(nonzeros: DataFrame, dictionary: DataFrame | None = None) -> int:
    """One more than the largest column, at least the dictionary's size."""
    got = nonzeros.agg(F.coalesce(F.max("cat") + 1, F.lit(0))).first()[0]
    return max(got, dictionary.count()) if dictionary is not None else got


def reindex_frequent(df: DataFrame, col: str, least: int, *, where: Column | None = None) -> DataFrame:
    """Ids with at least ``least`` rows become 0 ... k-1 by falling frequency (then id), all others k."""
    rows = df if where is None else df.filter(where)
    counts = rows.groupBy(col).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    ranked = global_index(counts, F.desc("n"), F.col(col), name=f"{col}_index").select(col, f"{col}_index")
    k = counts.count()
    return df.join(ranked, col, "left").fillna({f"{col}_index": k})


def chunk_row_ids(df: DataFrame, chunk: str, key: str) -> DataFrame:
    """Numbers the distinct keys of each chunk in key order from 0: global positions less those of the chunks before."""
    rows = global_index(df.select(chunk, key).distinct(), chunk, key, name="_at")
    starts = rows.groupBy(chunk).agg(F.min("_at").alias("_start"))
    return rows.join(starts, chunk).select(chunk, key, (F.col("_at") - F.col("_start")).alias("row"))


def chunk_ids(targets: DataFrame, histories: DataFrame, chunk: str, key: str, user: str, items: str) -> DataFrame:
    """Distinct ids (chunk, key) that a chunk's target rows hold themselves or in their user's history lists; -1 is padding."""
    own = targets.select(chunk, key)
    past = targets.select(chunk, user).distinct().join(histories.select(user, F.explode(items).alias(key)), user).select(chunk, key)
    return own.unionByName(past).filter(F.col(key) >= 0).distinct()


def two_hops(rows: DataFrame, id_map: DataFrame, values: DataFrame, row: str, key: str) -> DataFrame:
    """Rows -> their ids -> what is known of the ids; rows that the map or the values lack are left out."""
    return rows.join(id_map, row).join(values, key)


def language_name(code: Column) -> Column:
    """Name of a language code, ``other`` if there is none."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, code), F.lit("other"))


def cross_tab(df: DataFrame, row: str, col: str, value: Column | None = None) -> DataFrame:
    """(row, col, value) with duplicates summed."""
    return df.groupBy(row, col).agg((F.count("*") if value is None else F.sum(value)).alias("value"))
