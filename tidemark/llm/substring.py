"""Removal of passages that repeat across documents, by a compacted de Bruijn graph of word k-mers.

Every k consecutive words of a document are an edge that leaves the node of its first k - 1 words. The plan:

1. ``edges``: documents are dealt into batches; a batch sends each distinct edge once, packed by node, with the smallest
   of its documents, so a passage that a third of all rows share costs one entry a batch and not one a document.
2. ``repeats``: where all edges of a node meet, an edge with a smaller document elsewhere is answered to the batch with
   that source and with whether the node branches (several edges leave it, or a text ends there).
3. ``paths``: in each document answered edges are chained into nonbranching paths of one source; a join with grouped
   paths compacts what all documents share to one row (source, first edge, length, digest).
4. ``confirmed``: each path is looked up at its coordinates in the source, and the words there are compared; a path that
   its source doesn't hold (a collision of hashes) isn't cut.
5. ``cut``: confirmed paths leave the texts.

The documents are shuffled once, by batch; all steps read that exchange.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import M1, give_back, mix, numbered, partitions_for, read, text_batches, word_hashes

#: Characters of text in a batch, about.
BATCH_CHARS = 2_000_000
#: Bits of an edge that tell the edges of one node apart; the others are its node's.
_LOW, _SHIFT = np.uint64((1 << 24) - 1), np.uint64(24)
_WORD32 = np.uint64(0xFFFFFFFF)
_NULL, SEED = -(1 << 63), 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def runs(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k - 1 words, and of those k words that start with it (one fewer): a polynomial over words."""
    n = max(0, len(hashes) - k + 2)
    node = np.zeros(n, np.uint64)
    for j in range(k - 1):
        node += hashes[j : j + n] * np.uint64(pow(int(M1), j, 1 << 64))
    edge = node[:-1] + hashes[k - 1 :] * np.uint64(pow(int(M1), k - 1, 1 << 64)) if n else node
    return mix(node), mix(edge)


def batch_frame(table: pa.Table) -> pd.DataFrame:
    """ids (a number below all others for null), texts and places in the table, in the order all steps agree on: by id, then text."""
    docs = pd.DataFrame({"doc_id": table["doc_id"].fill_null(_NULL).to_numpy(), "text": table["text"].to_pandas()})
    return docs.sort_values(["doc_id", "text"], na_position="first")


def grouped(docs: DataFrame, f, schema: str, other: DataFrame | None = None) -> DataFrame:
    """``f(batch number, Arrow table of the batch[, frame of its rows of other])`` for every batch, on Arrow tables: columns
    that a step doesn't touch pass as they are. The functions return frames or tables."""
    kinds = pa_schema(schema)

    def one(key, table):
        return out(f(key[0].as_py(), table))

    def two(key, table, more):
        return out(f(key[0].as_py(), table, more.to_pandas()))

    def out(got) -> pa.Table:
        give_back()
        return got if isinstance(got, pa.Table) else pa.Table.from_pandas(got, schema=kinds, preserve_index=False)

    if other is None:
        return docs.groupBy("batch").applyInArrow(one, schema)
    return docs.groupBy("batch").cogroup(other.groupBy("batch")).applyInArrow(two, schema)


def pa_schema(schema: str) -> pa.Schema:
    """Arrow types of a schema string of plain columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.rsplit(" ", 1) for c in schema.split(", "))])


class Batch:
    """Edges of a batch in text order, and its distinct edges in ascending order.

    An edge is 40 bits of its left node's hash over 24 bits of its own, so edges of a node are neighbours in the order.
    The end of a text is an edge too, with own bits 0: a node where some text ends branches. Hence the edge after a node
    that doesn't branch follows wherever the edge before it is found.
    """

    def __init__(self, table: pa.Table, k: int):
        docs = batch_frame(table)
        self.ids, self.texts, self.last = docs["doc_id"].to_numpy(), docs["text"], (-1, [])
        own = [t if i != _NULL else "" for i, t in zip(self.ids.tolist(), docs["text"], strict=True)]
        # all texts in one array; runs that reach into the next text are left out
        hashes, ends = word_hashes(pa.array(own, pa.large_string(), from_pandas=True).fill_null(""), SEED)
        size, ends = np.diff(ends), ends[1:]
        node, edge = runs(hashes, k)
        whole = np.repeat(np.arange(len(size), dtype="i4"), size)[: len(edge)]
        inside = np.arange(len(edge)) + k <= ends[whole] if len(edge) else np.zeros(0, bool)
        self.edge, self.doc = self.join(node[: len(edge)][inside], edge[inside]), whole[inside]
        del hashes, edge, whole, inside, own
        count = np.maximum(size - k + 1, 0)
        self.starts = np.cumsum(count) - count
        closed = np.flatnonzero(size >= k - 1)
        every = np.concatenate([self.edge, node[ends[closed] - (k - 1)] & ~_LOW])
        doc = np.concatenate([self.doc, closed.astype("i4")])
        del node
        order = np.argsort(every)
        e = every[order]
        del every
        first = np.ones(len(e), bool)
        first[1:] = e[1:] != e[:-1]
        self.distinct = e[first]
        back = np.empty(len(e), "i8")
        back[order] = np.cumsum(first) - 1
        self.back = back[: len(self.edge)]
        # documents are in the order of their ids: the smallest of each distinct edge
        self.low = self.ids[np.minimum.reduceat(doc[order], np.flatnonzero(first))] if len(e) else self.ids[:0]

    @staticmethod
    def join(node: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return node & ~_LOW | np.maximum(edge & _LOW, np.uint64(1))

    def words(self, doc: int) -> list[bytes]:
        """Words of one document, the last one's kept."""
        if self.last[0] != doc:
            self.last = (doc, _words(self.texts.iloc[doc]))
        return self.last[1]

    @classmethod
    def edges_of(cls, hashes: np.ndarray, k: int) -> np.ndarray:
        """Edges of one text."""
        node, edge = runs(hashes, k)
        return cls.join(node[: len(edge)], edge)

    def slices(self, buckets: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the distinct edges: buckets are equal ranges of nodes. No edges: no buckets."""
        if not len(self.distinct):
            return []
        to = ((self.distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i4")  # of 32 top bits
        at = np.flatnonzero(np.diff(to, prepend=-1))
        return list(zip(to[at].tolist(), at.tolist(), [*at[1:].tolist(), len(to)], strict=True))


def twins(distinct: np.ndarray) -> np.ndarray:
    """Which of ascending distinct edges share their node with another."""
    node = distinct >> _SHIFT
    same = node[1:] == node[:-1]
    return np.append(same, False) | np.insert(same, 0, False) if len(node) else np.zeros(0, bool)


def _squeezed(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: small numbers leave their upper planes empty."""
    import zstandard

    planes = np.ascontiguousarray(x.view("u1").reshape(len(x), -1).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _opened(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1")
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _planes(x: np.ndarray) -> bytes:
    """Ascending integers as differences."""
    return _squeezed(np.diff(x, prepend=x[:1] * 0))


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_opened(raw, kind), dtype=kind)


def _packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Few distinct values as their list and two-byte (or four-byte) places in it."""
    own, place = np.unique(values, return_inverse=True)
    return _planes(own), _squeezed(place.astype("u2" if len(own) <= 65536 else "u4"))


def _unpacked(own: bytes, place: bytes) -> np.ndarray:
    own = _from_planes(own, "i8")
    return own[_opened(place, "u2" if len(own) <= 65536 else "u4")]


def dealt(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, int]:
    """doc_id, text, carried columns, batch; and the number of batches. Rows with one id share a batch, rows without are spread."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(partitions_for(docs), -(-chars // BATCH_CHARS))
    spread = F.when(F.col("doc_id").isNull(), batch_of(F.col("text"), n)).otherwise(batch_of(F.col("doc_id"), n))
    return own.withColumn("batch", spread), n


def batch_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def edges(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Distinct edges of every batch, packed by bucket of nodes: batch, bucket, high, low, docs, place."""

    def send(batch: int, table: pa.Table) -> pd.DataFrame:
        b, out = Batch(table, k), []
        for bucket, a, z in b.slices(buckets):
            e = b.distinct[a:z]
            high, low = (e >> np.uint64(32)).astype("u4"), (e & _WORD32).astype("u4")
            out.append((batch, bucket, _planes(high), low.tobytes(), *_packed(b.low[a:z])))
        return pd.DataFrame(out, columns=["batch", "bucket", "high", "low", "docs", "place"])

    schema = "batch int, bucket int, high binary, low binary, docs binary, place binary"
    return grouped(docs, send, schema)


def repeats(sent: DataFrame) -> DataFrame:
    """Answers: for a batch and bucket, which of its edges have a smaller document elsewhere, and which one."""

    def answer(key, got: pd.DataFrame) -> pd.DataFrame:
        es, ds = [], []
        for r in got.itertuples(index=False):
            es.append(_from_planes(r.high, "u4").astype(np.uint64) << np.uint64(32) | np.frombuffer(r.low, "u4"))
            ds.append(_unpacked(r.docs, r.place))
        size = np.array([len(e) for e in es], "i8")
        starts = np.cumsum(size) - size
        e, doc = np.concatenate(es), np.concatenate(ds)
        order = np.argsort(e)
        e = e[order]
        first = np.ones(len(e), bool)
        first[1:] = e[1:] != e[:-1]
        at = np.flatnonzero(first)
        source = np.minimum.reduceat(doc[order], at)
        branch, real = twins(e[at]), (e[at] & _LOW) > 0
        back = np.empty(len(e), "i8")
        back[order] = np.cumsum(first) - 1
        out = []
        for batch, a, n in zip(got["batch"].tolist(), starts.tolist(), size.tolist(), strict=True):
            g = back[a : a + n]
            late = np.flatnonzero((source[g] < doc[a : a + n]) & real[g])
            if len(late):
                rows = g[late]
                out.append((batch, int(key[0]), _planes(late.astype("u4")), *_packed(source[rows]),
                            np.packbits(branch[rows]).tobytes()))
        return pd.DataFrame(out, columns=["batch", "bucket", "at", "docs", "place", "branch"])

    schema = "batch int, bucket int, at binary, docs binary, place binary, branch binary"
    return sent.groupBy("bucket").applyInPandas(answer, schema)


def paths(docs: DataFrame, answers: DataFrame, k: int, buckets: int) -> DataFrame:
    """Paths of every document: doc_id, row (in its batch), start, edges, source, first edge, digest of the words."""
    cols = ["batch", "row", "start", "edges", "source", "first", "digest"]

    def chain(batch: int, table: pa.Table, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(table):
            return pd.DataFrame(columns=cols)
        b, rows = Batch(table, k), []
        source, branch = b.low.copy(), twins(b.distinct)
        base = {bucket: a for bucket, a, _ in b.slices(buckets)}
        for r in answers.itertuples(index=False):
            at = _from_planes(r.at, "u4").astype("i8") + base[r.bucket]
            source[at] = _unpacked(r.docs, r.place)
            branch[at] |= np.unpackbits(np.frombuffer(r.branch, "u1"), count=len(at)).astype(bool)
        source, branch = source[b.back], branch[b.back]
        at = np.flatnonzero(source < b.ids[b.doc])
        if len(at):
            new = np.ones(len(at), bool)
            here, before = at[1:], at[:-1]
            new[1:] = (here - before > 1) | (b.doc[here] != b.doc[before]) | (source[here] != source[before]) | branch[here]
            begin = np.flatnonzero(new)
            for s, n in zip(at[begin].tolist(), np.diff(np.append(begin, len(at))).tolist(), strict=True):
                d = int(b.doc[s])
                w = s - int(b.starts[d])
                rows.append((batch, d, w, n, int(source[s]), int(b.edge[s].view("i8")),
                             _digest(b.words(d)[w : w + n + k - 1])))
        return pd.DataFrame(rows, columns=cols)

    schema = "batch int, row int, start int, edges int, source long, first long, digest binary"
    return grouped(docs, chain, schema, answers)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def confirmed(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Of compacted paths (batch of the source, source, first, edges, digest) those that the source's words confirm."""
    cols = ["source", "first", "edges", "digest"]

    def check(batch: int, table: pa.Table, want: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(want):
            docs = batch_frame(table)
            docs = docs[docs["doc_id"].isin(want["source"])]
            hashes, ends = word_hashes(pa.array(docs["text"], pa.large_string(), from_pandas=True).fill_null(""), SEED)
            by = {}
            for i, t, a, z in zip(docs["doc_id"].tolist(), docs["text"], ends.tolist(), ends[1:].tolist(), strict=False):
                by.setdefault(i, []).append((hashes[a:z], _words(t)))
            for source, group in want.groupby("source"):
                firsts = group["first"].to_numpy("i8")
                for own, words in by.get(int(source), []):
                    e = Batch.edges_of(own, k).view("i8")
                    order = np.argsort(e, kind="stable")
                    lo, hi = (np.searchsorted(e, firsts, side, sorter=order).tolist() for side in ("left", "right"))
                    for r, a, z in zip(group.itertuples(index=False), lo, hi, strict=True):
                        if any(_digest(words[s : s + r.edges + k - 1]) == r.digest for s in order[a:z].tolist()):
                            out.append((r.source, r.first, r.edges, r.digest))
        return pd.DataFrame(sorted(set(out)), columns=cols)

    schema = "source long, first long, edges int, digest binary"
    return grouped(docs, check, schema, wanted)


def cut(docs: DataFrame, gone: DataFrame, k: int, texts: bool, carry: list[str]) -> DataFrame:
    """What is left of every document when paths (batch, row, start, edges) are taken out."""

    def leave(batch: int, table: pa.Table, gone: pd.DataFrame) -> pa.Table:
        own, spans, rows = batch_frame(table), {}, []
        for r in gone.itertuples(index=False):
            spans.setdefault(r.row, []).append((r.start, r.start + r.edges + k - 1))
        for i, text in enumerate(own["text"]):
            words, kept = _words(text), text
            n = len(words)
            if i in spans:
                keep = np.ones(n, bool)
                for a, z in spans[i]:
                    keep[a:z] = False
                at = np.flatnonzero(keep).tolist()
                words = [words[j] for j in at]
                if texts:
                    ends = [m.span() for m in _WORD.finditer(text)]
                    kept = text[: ends[0][0]] + "".join([text[ends[j][0] : ends[j][1]] for j in at])
            rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), kept))
        table = table.take(pa.array(own.index.to_numpy()))
        n_words, n_removed, digest, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        new = {
            "doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
        }
        if texts:
            new["text"] = pa.array([None if t is None or t != t else t for t in kept], pa.string())
        return pa.table(new | {c: table[c] for c in carry})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts
    for c in carry:
        schema += f", {c} {docs.schema[c].dataType.simpleString()}"
    left = docs.groupBy("batch").cogroup(gone.groupBy("batch"))

    def group(key, t, more):
        got = leave(key[0].as_py(), t, more.to_pandas())
        give_back()
        return got

    return left.applyInArrow(group, schema)


def remove_repeats(docs: DataFrame, *, k: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut every word that lies in a window of ``k`` words which also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) and, with ``texts``,
    text: unchanged if nothing was cut, else without the cut words and the white space after them (null stays null).
    Null, empty and short texts keep all; rows that repeat an id are judged by that id, so they don't count against each
    other; rows without an id keep all and cut nothing, as no id is larger or smaller than theirs. Rows stay, in number and with repeats; an empty table gives no rows;
    columns of ``carry`` come along, others are not read.
    """
    text_batches(docs.sparkSession)
    carry = list(carry)
    own, n = dealt(docs, id_col, text_col, carry)
    parts = partitions_for(docs)
    buckets = max(parts, -(-n // 4))  # a bucket of nodes has at most about as many edges as four batches, whatever the corpus
    # dealt by batch once more, so that both uses of the paths read one exchange
    key = ["source", "first", "edges", "digest"]
    found = paths(own, repeats(edges(own, k, buckets)), k, buckets)
    found = found.filter(" and ".join(f"{c} is not null" for c in key)).repartition(parts, "batch")
    # an occurrence of each path goes along, and the join's null checks come before the exchange: with equal columns and
    # filters both readers of the paths share it
    holder = F.min(F.col("batch").cast("long") * (1 << 31) + F.col("row")).alias("holder")
    wanted = found.groupBy(*key).agg(holder, F.min("start").alias("start"))
    sure = confirmed(own, wanted.select(batch_of(F.col("source"), n).alias("batch"), *key, "holder", "start"), k)
    return cut(own, found.join(sure, key).select("batch", "row", "start", "edges"), k, texts, carry)


def drop_repeats(docs: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                 size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` (one row an id) without passages of ``k`` words or more that a document with a smaller id holds.

    The text column changes, and with ``size_col`` that column becomes its length where something was cut; all others
    stay as they are. A document of which nothing is left goes. Rows without an id and unchanged rows stay as they are.
    """
    own, name = numbered(docs)
    key, text = name[id_col], name[text_col]
    got = remove_repeats(own.filter(F.col(key).isNotNull()), k=k, id_col=key, text_col=text, carry=tuple(c for c in name.values() if c != text))
    got = got.filter("n_removed < n_words or n_removed = 0").withColumn(text, F.col("text"))
    if size_col in name:
        old, kind = F.col(name[size_col]), docs.schema[size_col].dataType
        got = got.withColumn(name[size_col], F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(old))
    out = got.select(*name.values()).unionByName(own.filter(F.col(key).isNull()))
    return out.toDF(*docs.columns)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the 13-word windows of smaller documents."""
    return remove_repeats(read(spark, sf_dir, "documents"), texts=False)
