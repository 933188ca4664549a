"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position gets a non-zero vector of GF(2)^(r+1); the mask of a non-zero vector v keeps the positions whose
vector has an odd product with v. Two fingerprints that differ in at most r bits leave some v orthogonal to all of
them, so they agree under that mask: every pair within the radius collides in at least one of the 2^(r+1) - 1 tables.

A bucket with more fingerprints than a limit is split by the same construction over the bits its mask leaves free,
again and again; the guarantee holds at each level and free bits run out, so no bucket is ever compared whole when it is
large and no pair within the radius is lost.

The pipeline verifies links on the shingles themselves and finds by shared rare shingles what fingerprints can't see; see
``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm._common import M1, Scratch, bounded, components, durable, give_back, mix, numbered, read, small, text_batches, union_all, word_hashes

BITS = 64
#: Largest bucket whose fingerprints are compared with each other.
BUCKET = 64
CHUNK = 50_000
#: Characters of text a step works on at once, about.
CHUNK_CHARS = 4_000_000
#: Documents of the sample of shingles from which on a shingle counts as frequent, and tasks it is dealt over.
FREQUENT, SALTS = 60, 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(free: list[int], radius: int) -> list[int]:
    """One mask per table over the given bit positions."""
    size = 1 << (radius + 1)
    return [
        sum(1 << b for i, b in enumerate(free) if ((i % (size - 1) + 1) & v).bit_count() & 1) for v in range(1, size)
    ]


def mask_levels(radius: int) -> list[list[int]]:
    """Masks of each level, a level's table t splitting into tables t * m ... t * m + m - 1 of the next."""
    levels, now = [], [0]
    while True:
        nxt = []
        for mask in now:
            free = [b for b in range(BITS) if not mask >> b & 1]
            nxt += [mask | m for m in covering_masks(free, radius)]
        levels.append(nxt)
        now = nxt
        if max(BITS - m.bit_count() for m in now) <= (BUCKET.bit_length() - 1) or len(now) * 7 > 20_000:
            return levels


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """SimHash of the XXH64 values of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return 0
    line = b" ".join(own)
    lens = np.fromiter(map(len, own), "i8", len(own))
    starts = np.cumsum(lens + 1) - lens - 1
    n = max(1, len(own) - words + 1)
    ends = (starts + lens)[-n:].tolist()
    starts, counts, digest = starts[:n].tolist(), np.zeros(BITS, "i8"), xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = [_signed(fingerprint("" if pd.isna(t) else t, words)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": np.array(fps, "i8")})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (s, a, b) that connect distinct fingerprints (s, fp) of one seed s exactly as all pairs within the radius do.
    Without a column s all have one seed.

    Buckets of two are decided by their smallest and largest member, buckets up to BUCKET by comparing their members,
    larger ones are split. Within a bucket only a spanning forest comes out.
    """
    levels, fan = mask_levels(radius), (1 << (radius + 1)) - 1
    rows, found, bucket, keep = None, [], ["s", "t", "key"], Scratch(fps.sparkSession, "simhash")
    fps = fps if "s" in fps.columns else fps.withColumn("s", F.lit(0))
    for depth, masks in enumerate(levels):
        literal = F.array(*[F.lit(_signed(m)) for m in masks])
        if rows is None:
            keys = F.transform(literal, lambda m: F.col("fp").bitwiseAND(m))
            keyed = fps.select("s", "fp", F.posexplode(keys).alias("t", "key"))
        else:
            step = F.explode(F.sequence(F.col("t") * fan, F.col("t") * fan + fan - 1)).alias("t")
            keyed = rows.select("s", "fp", step)
            keyed = keyed.select("s", "fp", "t", F.col("fp").bitwiseAND(F.element_at(literal, F.col("t") + 1)).alias("key"))
        keyed = keep(keyed) if depth else keyed
        sized = keyed.groupBy(bucket).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sized = keep(sized.filter("n > 1"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        found.append(sized.filter(F.col("n") == 2).filter(near).select("s", "a", "b"))
        last = depth == len(levels) - 1
        most = max(BUCKET, 1 << max(BITS - m.bit_count() for m in masks)) if last else BUCKET
        some = sized.filter(F.col("n").between(3, most)).select(bucket)
        groups = keyed.join(some, bucket).groupBy(bucket).agg(F.collect_list("fp").alias("fps"))
        found.append(groups.select("s", "fps").mapInPandas(lambda it: _forests(it, radius), "s int, a long, b long"))
        large = sized.filter(F.col("n") > BUCKET).select(bucket)
        if last or large.isEmpty():
            break
        rows = keep(keyed.join(large, bucket).select("s", "fp", "t"))
    out = keep(union_all(found).distinct())
    keep.clear(out)
    return out


def _forests(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for s, fps in zip(b["s"].tolist(), b["fps"], strict=True):
            x = np.asarray(fps, "i8").view("u8")
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            label = np.arange(len(x))
            while True:  # smallest index reachable
                new = np.where(near, label[None, :], len(x)).min(axis=1)
                if np.array_equal(new, label):
                    break
                label = new
            out += [(s, int(fps[label[i]]), int(fps[i])) for i in range(len(x)) if label[i] != i]
        yield pd.DataFrame(out, columns=["s", "a", "b"], dtype="i8")


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or through others, within ``radius`` bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the group) per row. Null, empty and
    wordless texts have fingerprint zero and are linked like any other; shorter texts than a shingle are one shingle;
    repeated rows stay; null ids never name a group unless all its ids are null. Other columns are not read.
    Equal fingerprints are one node, so groups of copies cost no pairs.
    """
    keep = Scratch(docs.sparkSession, "simhash")
    base = keep(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
    nodes = keep(base.groupBy("fp").agg(F.min("doc_id").alias("first")))
    near = links(nodes.select("fp"), radius)
    named = nodes.join(components(near, "a", "b"), F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(named.join(least, "root").select("fp", "component_id"))
    keep.clear(base, named)
    return base.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``words`` words of every text (fewer words: of the whole sequence), and where each text's end.

    A-Z are lower-cased; words are what the six ASCII white-space characters separate. A text without words has one hash.
    """
    h, ends = word_hashes(pc.ascii_lower(texts), 7)
    n = max(0, len(h) - words + 1)
    run = np.zeros(n, np.uint64)
    for j in range(words):
        run += h[j : j + n] * np.uint64(pow(int(M1), j, 1 << 64))
    run = mix(run)
    size = np.diff(ends)
    inside = np.ones(n, bool)
    for back in range(1, words):  # runs that reach into the next text
        at = ends[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    short = np.flatnonzero(size < words)
    count = np.where(size < words, 0, size - words + 1)
    if not len(short):
        return run[inside], np.cumsum(count)
    # texts of fewer words: their one hash goes where their runs would be
    whole = [mix(np.array([sum(int(x) * pow(int(M1), j, 1 << 64) for j, x in enumerate(h[ends[d] : ends[d + 1]])) + 1 & (1 << 64) - 1], np.uint64))[0] for d in short]
    return np.insert(run[inside], (np.cumsum(count) - count)[short], whole), np.cumsum(np.maximum(count, 1))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of a power of two of classes of hashes, about as many as hashes: whether their number is odd.

    Two sets whose bits differ in d places differ in d elements at least; halves of the bits may be folded by exclusive or.
    """
    size = max(64, 1 << (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).view("i8"), minlength=size) & 1).astype(bool)).tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """A lower bound of how many elements are in one of two sets only, from their ``parities``."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shingle_sets(docs: DataFrame, words: int, order: tuple[np.ndarray, np.ndarray], least: float | None = None) -> DataFrame:
    """Of every row: doc_id, a digest of its set of shingles, n of them, and ``shingles``, their ascending hashes.

    With ``least`` not all hashes come out but ``fp``, the set's SimHash, ``marks``, see ``parities``, and ``first``, some hashes one of which any set
    that is ``least`` alike has among its own ``first`` too: those of ``order`` are left out first, the commonest first.
    """
    import xxhash

    common, times = order

    def sets(texts: pa.Array) -> Iterator[tuple]:
        hashes, ends = shingles(texts, words)
        rank = np.zeros(len(hashes), "i8")
        if least is not None and len(common):
            at = np.searchsorted(common, hashes).clip(max=len(common) - 1)
            rank = np.where(common[at] == hashes, times[at], 0)
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            x, at = np.unique(hashes[a:z], return_index=True)
            row = (xxhash.xxh128_digest(x.tobytes()), len(x))
            if least is None:
                yield *row, x.view("i8")
                continue
            bits = np.unpackbits(x.byteswap().view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
            fp = int.from_bytes(np.packbits(bits * 2 > len(x)).tobytes(), "big")
            by = np.argsort(rank[a:z][at], kind="stable")
            yield *row, _signed(fp), parities(x), x[by[: len(x) - math.ceil(least * len(x) - 1e-9) + 1]].view("i8")

    names = ["digest", "n", "shingles"] if least is None else ["digest", "n", "fp", "marks", "first"]
    kinds = {"digest": pa.binary(), "n": pa.int32(), "fp": pa.int64(), "marks": pa.binary(), "shingles": pa.list_(pa.int64()), "first": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for part in bounded(b, "text", CHUNK_CHARS):
                    cols = list(zip(*sets(pc.fill_null(part["text"], "")), strict=True)) or [()] * len(names)
                    table = pa.table({"doc_id": part["doc_id"]} | {c: pa.array(list(v), kinds[c]) for c, v in zip(names, cols, strict=True)})
                    yield from table.to_batches()
        finally:
            give_back()

    kind = {"digest": "binary", "n": "int", "fp": "long", "marks": "binary", "shingles": "array<long>", "first": "array<long>"}
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {kind[c]}" for c in names))


def shingle_order(docs: DataFrame, words: int, sample: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``sample`` documents hold, ascending, and in how many.

    They only say which shingles come last in the order that all documents share, and which are known to be frequent.
    Results are the same under any order.
    """
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    some = shingle_sets(docs.filter(draw), words, (np.zeros(0, np.uint64), np.zeros(0, "i8")))
    often = some.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    got = [(r["key"], r["n"]) for r in often.orderBy(F.desc("n"), "key").limit(100_000).collect()]
    keys, times = np.array([k for k, _ in got], "i8").view("u8"), np.array([k for _, k in got], "i8")
    by = np.argsort(keys)
    return keys[by], times[by]


def buckets(first: DataFrame, frequent: list[int]) -> DataFrame:
    """key, id, n, pos: the first shingles (doc_id, n, first) that several documents have among their own.

    Keys known to be ``frequent`` are dealt over many tasks; what is left of those needs no neighbour to be kept.
    """
    rows = first.select(F.posexplode("first").alias("pos", "key"), F.col("doc_id").alias("id"), "n")
    often = F.col("key").isin(frequent) if frequent else F.lit(False)
    rows = rows.withColumn("often", often).withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    rows = rows.withColumn("members", F.count("*").over(W.partitionBy("key", "salt")))
    return rows.filter("often or members > 1").select("key", "id", "n", "pos")


class Verifier:
    """Compares pairs of documents: first by the parities of their sets (``marks``: doc_id, n, marks), which rule most pairs out
    for certain, then by the whole sets of shingles, made from the texts of those documents that are still in a pair."""

    def __init__(self, docs: DataFrame, marks: DataFrame, words: int, least: float, keep: Scratch):
        self.docs, self.marks, self.words, self.least, self.keep = docs, marks, words, least, keep

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets don't differ in too many elements: sets that are d alike differ in (1 - d) / (1 + d) of their sizes' sum."""
        share = (1 - self.least) / (1 + self.least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                most = share * (t["n"].to_numpy() + t["n2"].to_numpy()) + 1e-6
                marks = zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)
                differ = np.fromiter((fewest_differences(a, b) for a, b in marks), "i8", len(t))
                yield t.select(["id", "m"]).filter(pa.array(differ <= most))

        own, other = self.marks.toDF("id", "n", "a"), self.marks.toDF("m", "n2", "b")
        both = pairs.join(own, "id").join(other, "m").select("id", "m", "n", "n2", "a", "b")
        return both.mapInArrow(run, "id long, m long")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (id, m) whose sets have a Jaccard similarity of ``least`` or more.

        Both joins with the sets are plain equi-joins: a document in very many pairs is a skewed key that adaptive execution
        splits.
        """
        pairs, least = self.keep(self.possible(pairs)), self.least
        if pairs.isEmpty():
            return pairs
        ids = self.keep(pairs.select("id").union(pairs.select("m")).distinct().toDF("doc_id"))
        none = (np.zeros(0, np.uint64), np.zeros(0, "i8"))
        sets = self.keep(shingle_sets(self.docs.join(small(ids), "doc_id", "left_semi"), self.words, none).select("doc_id", "shingles"))
        own = sets.toDF("id", "a").join(small(pairs), "id")
        leaders = sets.toDF("m", "b").join(small(self.keep(pairs.select("m").distinct())), "m", "left_semi")
        both = own.join(leaders, "m").select("id", "m", "a", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ok = []
                for a, b in zip(t["a"], t["b"], strict=True):
                    x, y = a.values.to_numpy(), b.values.to_numpy()
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(n >= least * (len(x) + len(y) - n) - 1e-9)
                yield t.select(["id", "m"]).filter(pa.array(ok, pa.bool_()))

        return self.keep(both.mapInArrow(run, "id long, m long"))


def rooted(left: DataFrame, roots: DataFrame, keep: Scratch) -> DataFrame:
    """``left`` (key, id, n, pos) with the component of every id, without keys whose ids are all in one component."""
    own = left.drop("root").join(small(roots), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    own = keep(own.select("key", "id", "n", "pos", "root"))
    open_ = keep(own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key"))
    return keep(own.join(small(open_), "key", "left_semi"))


def links_by_shingles(left: DataFrame, edges: DataFrame, verify: Verifier, *others: DataFrame) -> DataFrame:
    """Roots (node, root) of the components that all pairs of sets with at least ``least`` of Jaccard similarity make.

    ``edges`` (id, m) are the links found so far. Two sets that are ``least`` alike share one of their first ``n - ceil(least *
    n) + 1`` shingles in the common order, so the buckets ``left`` of equal such shingles hold every pair. In a round the
    members of a bucket are compared with its smallest one (then 16, then 256, ...) unless both are in one component by now; these leaders then leave the bucket, as does everything once a bucket is of one component. So a group of
    thousands of near copies costs about a comparison a member, and no pair of unlike components is left out.
    """
    keep, least = verify.keep, verify.least
    low, high = F.least("n", "n2"), F.greatest("n", "n2")
    room = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))  # all that may be shared from the first one on
    able = (low >= F.lit(least) * high - 1e-9) & (room * (1 + least) >= F.lit(least) * (F.col("n") + F.col("n2")) - 1e-9)
    roots = keep(components(edges, "id", "m"))
    first, left = 1, rooted(left, roots, keep)
    while not left.isEmpty():
        lead = left.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("id"))).filter(F.col("rank") <= first)
        lead = keep(lead.select("key", F.col("id").alias("m"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2")))
        pairs = left.join(lead, "key").filter("m < id and root <> root2").filter(able).select("id", "m").distinct()
        new = verify(pairs)
        if not new.isEmpty():
            edges = keep(edges.unionByName(new))
            roots = keep(components(edges, "id", "m"))
        done = lead.select(F.col("key").alias("k"), "m")
        rest = left.join(done, (F.col("key") == F.col("k")) & (F.col("id") == F.col("m")), "left_anti")
        left = rooted(rest, roots, keep)
        keep.clear(left, edges, roots, *others)
        first *= 16
    return roots


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, least: float = 0.8, radius: int = 2, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one document left of each group of near-duplicates, the smallest id.

    Two documents are linked if the Jaccard similarity of their ``words``-word shingles is ``least`` or more; a group is what
    links connect. Links are found by covering masks over the fingerprints of the shingle sets, within ``radius`` bits, and
    verified on the sets. Fingerprints this far apart only hold the closest pairs (at a similarity of 0.8 about ten of 64 bits
    differ), so every other pair is then found by shared rare shingles, see ``links_by_shingles``: no link is lost.

    Rows that repeat an id are one document, the one of the smallest text. Rows without an id stay. Texts without words are
    copies of each other, null ones too. An empty table stays empty. All columns stay as they are, whatever their names.
    """
    text_batches(docs.sparkSession)
    every, name = numbered(docs)
    key, text, keep = name[id_col], name[text_col], Scratch(docs.sparkSession, "near")
    every = one_row_an_id(every, key, text)
    own = every.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    order = shingle_order(own, words)
    each = keep(shingle_sets(own, words, order, least))
    # equal sets are one node
    nodes = keep(each.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    mine = each.join(small(nodes), "doc_id", "left_semi")
    left = keep(buckets(mine, order[0][order[1] >= FREQUENT].view("i8").tolist()))

    fps = keep(mine.select("fp", "doc_id"))
    first = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("m")))
    near = links(first.select("fp"), radius)
    a, b = first.select(F.col("fp").alias("a"), F.col("m").alias("x")), first.select(F.col("fp").alias("b"), F.col("m").alias("y"))
    pairs = near.join(a, "a").join(b, "b").select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("m"))
    pairs = keep(pairs.unionByName(fps.join(first, "fp").select(F.col("doc_id").alias("id"), "m")).filter("m < id").distinct())
    marks = keep(mine.select("doc_id", "n", "marks"))
    keep.clear(nodes, left, pairs, marks)
    verify = Verifier(own, marks, words, least, keep)
    roots = links_by_shingles(left, verify(pairs), verify, nodes, marks)
    gone = roots.filter("node <> root").select(F.col("node").alias("doc_id"))
    stay = keep(nodes.join(gone, "doc_id", "left_anti").toDF("_stay"))
    keep.clear(stay)
    kept = every.join(small(stay), F.col(key).cast("long") == F.col("_stay"), "left_semi")
    return kept.unionByName(every.filter(F.col(key).isNull())).toDF(*docs.columns)


def one_row_an_id(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with one row of those that share an id, the one of the smallest text (a null one last)."""
    repeated = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).count().filter("count > 1").select("_id")
    repeated = durable(repeated, "near")
    if repeated.isEmpty():
        return rows
    same = F.col(key) == F.col("_id")
    order = F.struct(F.col(text).isNull(), F.col(text), F.to_json(F.struct(*rows.columns)))
    one = rows.join(small(repeated), same, "left_semi").groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    one = one.select("_row.*")
    return rows.join(small(repeated), same, "left_anti").unionByName(durable(one, "near"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    return near_duplicates(read(spark, sf_dir, "documents"))
