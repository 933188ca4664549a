"""Token-ID output: short arrays compressed one by one against a shared dictionary, with an offset index.

A packed folder holds three Parquet tables:

``dictionary``  one row: sha256 of the zstandard dictionary and its bytes (empty if none could be trained)
``blocks``      shard, block, dictionary (its hash), first_id, last_id, first (tokens of the shard before the block),
                payload (concatenated zstandard frames, one per document), and the index arrays doc_ids, offsets
                (one more than documents) and n_tokens
``shards``      shard, start (tokens of all shards before), n_tokens

Shards ascend with the document id, as do documents inside a shard, so a reader finds a document by the id ranges of
the blocks, cuts one frame out of one payload and decompresses that alone. Spark's committer writes the tables, so a
task that is run again leaves nothing twice.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bounded, bucket_of, partitions_for, range_bounds, read, shared_dir

BLOCK_BYTES = 1 << 20
#: Bytes of text that are split into words at once, about.
CHUNK_BYTES = 8_000_000
BLOCK_SCHEMA = (
    "shard int, block int, dictionary string, first_id long, last_id long, first long, payload binary, "
    "doc_ids array<long>, offsets array<long>, n_tokens array<long>"
)
_LONGS = pa.list_(pa.int64())
BLOCK_TYPES = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("first", pa.int64()), ("payload", pa.binary()), ("doc_ids", _LONGS), ("offsets", _LONGS), ("n_tokens", _LONGS),
])
#: Words that are lower-cased here; beyond Latin and at odd white space that is left to the library.
_PLAIN = r"^[\x21-\x7e\xa1-ɏ]*$"


class Ids:
    """Ids of strings in one growing array; those met in one chunk only are forgotten when there are too many."""

    def __init__(self, keep: int):
        self.keep, self.at = keep, {}
        self.starts, self.sizes, self.hits = (np.zeros(0, "i8") for _ in range(3))
        self.flat = np.zeros(0, "<u4")

    def places(self, keys: list[str]) -> np.ndarray:
        """Place of each of distinct keys, -1 for those without ids yet; there is room for these afterwards."""
        got = np.fromiter(map(self.at.get, keys, repeat(-1)), "i8", len(keys))
        if len(self.at) + (got < 0).sum() > self.keep:
            stay = np.flatnonzero(self.hits > 1)
            stay = stay[np.argsort(-self.hits[stay], kind="stable")][: self.keep // 2]
            names, flat, sizes, hits = list(self.at), self.of(stay), self.sizes[stay], self.hits[stay] - 1
            self.__init__(self.keep)
            self.add([names[i] for i in stay.tolist()], flat, sizes)
            self.hits = hits
            got = np.fromiter(map(self.at.get, keys, repeat(-1)), "i8", len(keys))
        self.hits[got[got >= 0]] += 1
        return got

    def add(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.hits = np.concatenate([self.hits, np.ones(len(sizes), "i8")])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, places: np.ndarray) -> np.ndarray:
        """Ids of all places, one after another."""
        n = self.sizes[places]
        first = self.starts[places] - np.cumsum(n) + n
        return self.flat[np.repeat(first, n) + np.arange(n.sum())]


class WordEncoder:
    """The tokenizers library's ids of whole texts, remembering the ids of words.

    For tokenizers that lower-case, drop white space and mark word ends, the ids of a text are those of its pre-tokens
    in turn. Distinct pre-tokens go through the library in long texts; the end-of-word mark tells where each stops.
    Any other tokenizer, and any text with a special token's string or a combining mark, is encoded whole.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        form = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in form.get("added_tokens") or []]
        norm = form.get("normalizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [norm]) if n]
        pre = form.get("pre_tokenizer") or {}
        split = next((p for p in pre.get("pretokenizers", [pre]) if p and p.get("type") == "Split"), None)
        suffix = form["model"].get("end_of_word_suffix")
        self.by_word = bool(
            kinds == ["NFC", "Replace", "Lowercase"] and suffix and split and split["invert"] and not form["truncation"]
        )
        if self.by_word:
            import regex

            self.pattern = regex.compile(split["pattern"]["Regex"] + "|\n")
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.words, self.pieces = Ids(keep), Ids(keep)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        odd = pa.array(np.full(len(texts), not self.by_word))
        if self.by_word:
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, s))
            # a mark may compose with a capital but not with its small letter, or the other way round
            odd = pc.or_(odd, pc.match_substring_regex(texts, r"\p{M}"))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if self.by_word:
            flat, ends = self.chunk(pc.ascii_lower(texts))
        else:
            flat, ends = np.zeros(0, "<u4"), np.zeros(len(texts), "i8")
        if not len(odd):
            return flat, ends
        own = np.split(flat, ends[:-1])
        for i in odd.tolist():
            own[i] = self.whole(texts[i].as_py())
        return np.concatenate(own), np.cumsum([len(x) for x in own])

    def chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        places = self.words.places(_strings(coded.dictionary))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self.learn(coded.dictionary.take(new))
        places = places[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.words.sizes[places])])
        return self.words.of(places), ends[split.offsets.to_numpy()[1:]]

    def learn(self, words: pa.Array) -> np.ndarray:
        """Places of new words."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        out, own = np.zeros(len(words), "i8"), _strings(words.filter(plain))
        if own:
            found = self.pattern.findall(unicodedata.normalize("NFC", "\n".join(own)).lower())
            coded = pa.array(found, pa.string()).dictionary_encode()
            places = self.pieces.places(_strings(coded.dictionary))
            new = np.flatnonzero(places < 0)
            places[new] = len(self.pieces.at) + np.arange(len(new))
            self.encode_pieces(_strings(coded.dictionary.take(new)))
            at = coded.indices.to_numpy()
            stop = coded.dictionary.index("\n").as_py()
            word, places = np.cumsum(at == stop), places[at]
            sizes = np.bincount(word, self.pieces.sizes[places], len(own)).astype("i8")
            out[plain] = len(self.words.at) + np.arange(len(own))
            self.words.add(own, self.pieces.of(places), sizes)
        if len(own) < len(words):
            rest = _strings(words.filter(~plain))
            ids = [self.whole(w) for w in rest]
            out[~plain] = len(self.words.at) + np.arange(len(rest))
            self.words.add(rest, np.concatenate(ids), np.array([len(x) for x in ids], "i8"))
        return out

    def encode_pieces(self, pieces: list[str]) -> None:
        """Ids of new pieces in their order; the break between words has none."""
        for at in range(0, len(pieces), 5000):
            own = pieces[at : at + 5000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if "\n" in own:
                stops = np.insert(stops, i := own.index("\n"), stops[i - 1] if i else 0)
            if len(stops) == len(own):
                self.pieces.add(own, ids, np.diff(stops, prepend=0))
            else:
                each = [self.whole(p) for p in own]
                self.pieces.add(own, np.concatenate(each), np.array([len(x) for x in each], "i8"))


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


def enc_all(enc: WordEncoder, batch: pa.RecordBatch) -> Iterator[memoryview]:
    """Ids of every text of a batch as little-endian unsigned 32-bit integers, a bounded amount of text at a time."""
    for part in bounded(batch, "text", CHUNK_BYTES):
        flat, ends = enc(pc.fill_null(part["text"], ""))
        raw = memoryview(flat.tobytes())
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield raw[4 * a : 4 * z]


def train_dictionary(docs: DataFrame, tokenizer: str, *, sample: int = 1000, sample_chars: int = 65_536,
                     sample_bytes: int = 16_384, dict_bytes: int = 65_536, least_bytes: int = 4096) -> bytes:
    """Dictionary from the serialized ids of about ``sample`` documents, chosen by a hash of their id.

    Training sees at most ``4 * sample`` documents, of each at most ``sample_chars`` characters and ``sample_bytes`` of their
    ids, so the driver holds a bounded amount whatever the corpus; what is compressed with the dictionary are whole documents.
    Less than ``least_bytes`` to train on gives no dictionary (empty bytes).
    """
    n = docs.count()
    most = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < most).limit(4 * sample)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            raws = [raw[:sample_bytes] for raw in enc_all(enc, b)]
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary())], ["ids"])

    import zstandard

    part = chosen.select(F.substring("text", 1, sample_chars).alias("text"))
    got = sorted(bytes(r["ids"]) for r in part.mapInArrow(ids, "ids binary").collect() if r["ids"])
    if sum(map(len, got)) < least_bytes:
        return b""
    size = min(dict_bytes, sum(map(len, got)) // 8)
    try:
        return zstandard.train_dictionary(size, got).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(docs: DataFrame, out: str, *, tokenizer: str, end_id: int | None = 2, level: int = 3,
         id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write a packed folder at ``out``.

    Null text counts as empty; with an end id every document has at least that one. Rows that repeat an id are
    documents of their own, in order of their text; a null id comes first. An empty table writes empty tables. Other
    columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark, parts = docs.sparkSession, partitions_for(docs)
    raw = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "dictionary string, bytes binary").coalesce(1).write.parquet(
        f"{out}/dictionary"
    )
    bounds = range_bounds(docs, "doc_id", parts)
    ranged = docs.withColumn("shard", bucket_of(F.col("doc_id"), bounds))
    ranged = ranged.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer)
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        shard, no, first, done = None, 0, 0, 0
        frames, ids, counts, offsets = [], [], [], [0]

        def block():
            row = (shard, no, digest, ids[0], ids[-1], first, b"".join(frames), ids, offsets, counts)
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK_TYPES.names, row, strict=True))], BLOCK_TYPES)

        for b in batches:
            for s, key, own in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), enc_all(enc, b), strict=True):
                if ids and (s != shard or offsets[-1] >= BLOCK_BYTES):
                    yield block()
                    no, first = no + 1, done
                    frames, ids, counts, offsets = [], [], [], [0]
                if s != shard:
                    shard, no, first, done = s, 0, 0, 0
                raw_ids = b"".join((own, end))
                frame = press.compress(raw_ids)
                frames.append(frame)
                ids.append(key)
                counts.append(len(raw_ids) // 4)
                offsets.append(offsets[-1] + len(frame))
                done += len(raw_ids) // 4
        if ids:
            yield block()

    ranged.select("shard", "doc_id", "text").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{out}/blocks")
    # as many rows as shards, which the number of partitions bounds
    sums = (
        spark.read.parquet(f"{out}/blocks")
        .groupBy("shard")
        .agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
        .orderBy("shard")
        .collect()
    )
    rows, start = [], 0
    for r in sums:
        rows.append((r["shard"], start, r["n"]))
        start += r["n"]
    spark.createDataFrame(rows, "shard int, start long, n_tokens long").coalesce(1).write.parquet(f"{out}/shards")


def _frames(raw: bytes, digest: str):
    import zstandard

    shared = zstandard.ZstdCompressionDict(raw) if raw else None
    opener = zstandard.ZstdDecompressor(dict_data=shared)

    def frame(row, i: int) -> bytes:
        if row.dictionary != digest:
            raise ValueError(f"block {row.shard}/{row.block} was written with dictionary {row.dictionary}")
        return opener.decompress(memoryview(row.payload)[row.offsets[i] : row.offsets[i + 1]])

    return frame


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(row["bytes"])
    if hashlib.sha256(raw).hexdigest() != row["dictionary"]:
        raise ValueError("the dictionary doesn't match its hash")
    return row["dictionary"], raw


def unpack(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """All documents of a packed folder: doc_id, start, n_tokens, ids_crc32[, ids as little-endian bytes]."""
    digest, raw = _dictionary(spark, folder)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = _frames(raw, digest)
        for b in batches:
            for row in b.itertuples(index=False):
                own = [frame(row, i) for i in range(len(row.doc_ids))]
                n = np.array([len(x) // 4 for x in own], "int64")
                if not np.array_equal(n, row.n_tokens):
                    raise ValueError(f"block {row.shard}/{row.block} doesn't match its index")
                out = {
                    "shard": row.shard, "doc_id": pd.array(list(row.doc_ids), "Int64"), "at": row.first + np.cumsum(n) - n,
                    "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in own],
                }
                yield pd.DataFrame(out | ({"ids": own} if with_ids else {}))

    schema = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = spark.read.parquet(f"{folder}/blocks").mapInPandas(documents, schema)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "start")  # a row per shard
    docs = docs.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("at"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents: only blocks whose range holds one are read, only their frames decompressed."""
    digest, raw = _dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    near = F.lit(False)
    for i in doc_ids:
        near |= (F.col("first_id") <= i) & (F.col("last_id") >= i)
    want = set(doc_ids)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = _frames(raw, digest)
        for b in batches:
            for row in b.itertuples(index=False):
                got = [(k, np.frombuffer(frame(row, i), "<u4").tolist()) for i, k in enumerate(row.doc_ids) if k in want]
                if got:
                    yield pd.DataFrame(got, columns=["doc_id", "ids"])

    return blocks.filter(near).mapInPandas(some, "doc_id long, ids array<long>")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written to packed token files and read back from them."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    pack(read(spark, sf_dir, "documents"), folder, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return unpack(spark, folder)
