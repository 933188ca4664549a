"""Byte-level BPE by a sentencepiece model serialised from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bounded, give_back, read, text_batches

#: A lone space between two visible characters starts a match of the default pattern, so texts can be cut there.
CHUNK_CHARS = 1_000_000
_BLANK = re.compile(r"[\s\x1c-\x1f\x85]")
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(no: int, data: bytes) -> bytes:
    return _varint(no << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: byte-mapped pieces scored by negative rank, identity normalisation.

    A piece's id is its rank; one unknown piece follows, which no text can reach as every byte is a piece.
    """
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")
    trainer = b"\x18\x02" + _varint(40 << 3) + _varint(len(tokens))  # model_type BPE, unk_id
    trainer += b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43))  # no bos, eos, pad
    normal = _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"  # no prefix, white space kept and not escaped
    return bytes(out) + _field(2, trainer) + _field(3, normal)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f) if a}
    return [ranks[i] for i in range(len(ranks))]


class ByteBPE:
    """Encoder and decoder; remembers the ids of units of text between single spaces."""

    def __init__(self, path: str, pattern: str, default: bool, keep: int = 100_000):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.chars = dict(enumerate(byte_chars()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.pattern, self.default, self.keep = regex.compile(pattern), default, keep
        self.units: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.found: dict[str, list[str]] = {}

    def forget(self) -> None:
        """Give back the memory of remembered ids, as Python workers outlive their tasks."""
        for x in (self.units, self.pieces, self.found):
            x.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; each match of the pattern is encoded by itself."""
        out, some, size = [], [], 0
        for t in texts:  # a bounded amount of split text at a time
            some.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                out += self.chunk(some)
                some, size = [], 0
        return out + self.chunk(some)

    def chunk(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if self.default else [t] for t in texts]
        new = set().union(*[islice(u, 1, None) for u in split]) - self.units.keys()
        if len(self.units) + len(new) > self.keep:
            self.units.clear()
            new = set().union(*[islice(u, 1, None) for u in split])
        first = {u[0] for u in split if u}
        self.learn([*first, *[" " + u for u in new]])
        for u in new:
            # cutting before a space is right between visible characters only: None makes a text take the slower way
            self.units[u] = None if not u or _BLANK.match(u[0]) or _BLANK.match(u[-1]) else self.joined(" " + u)
        get, out = self.units.__getitem__, []
        for text, u in zip(texts, split, strict=True):
            rest = list(map(get, islice(u, 1, None)))
            if None in rest or rest and (not u[0] or _BLANK.match(u[0][-1])):
                cut = _CUT.split(text)
                cut = [cut[0], *[" " + x for x in cut[1:]]]
                self.learn(cut)
                out.append(b"".join(map(self.joined, cut)))
            else:
                out.append(self.joined(u[0]) + b"".join(rest))
        self.found.clear()
        return out

    def joined(self, unit: str) -> bytes:
        got = self.found[unit]
        return self.pieces[got[0]] if len(got) == 1 else b"".join([self.pieces[p] for p in got])

    def learn(self, units: list[str]) -> None:
        """Matches of each unit, and the ids of those that are new."""
        find = self.pattern.findall
        self.found.update({u: find(u) for u in units if u not in self.found})
        if len(self.pieces) > self.keep:
            self.pieces.clear()
            units = list(self.found)
        miss, mapped, raws = [], [], {p for u in units for p in self.found[u]} - self.pieces.keys()
        for p in raws:
            raw = p.encode("utf-8", "surrogatepass")
            rank = self.whole.get(raw)
            if rank is not None:  # a match that is a token is that token, whatever merges would make of it
                self.pieces[p] = struct.pack("<I", rank)
            else:
                miss.append(p)
                mapped.append(raw.decode("latin-1").translate(self.chars))
        if miss:
            for p, ids in zip(miss, self.model.encode(mapped, num_threads=1), strict=True):
                self.pieces[p] = struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> bytes:
        """Inverse mapping: the bytes of each id."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str | None) -> ByteBPE:
    """One per Python worker. No pattern: the default one."""
    if pattern is None:
        import public_tokenizers

        return ByteBPE(path, public_tokenizers.PATTERN, True)
    return ByteBPE(path, pattern, False)


def encode(docs: DataFrame, *, ranks: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode whole texts and decode the ids again, one row out per row in, without a shuffle.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids (``raw``), with ``decoded`` the decoded
    bytes. Null text is empty (no tokens); repeated rows and null ids stay; other columns are not read.
    """
    text_batches(docs.sparkSession)
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["raw"] if ids else []), *(["decoded"] if decoded else [])]
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "raw": pa.binary(), "decoded": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        try:
            for b in batches:
                for part in bounded(b, "text", CHUNK_CHARS):
                    out = {c: [] for c in cols[1:]}
                    for raw in own.encode(pc.fill_null(part["text"], "").to_pylist()):
                        back = own.decode(raw)
                        row = (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), raw, back)
                        for c, v in zip(("n_tokens", "ids_sha256", "decoded_sha256", "raw", "decoded"), row, strict=True):
                            if c in out:
                                out[c].append(v)
                    made = [pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *made], cols)
        finally:
            own.forget()
            give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", raw binary" * ids + ", decoded binary" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` through the multilingual byte-level vocabulary and back."""
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), ranks=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False, decoded=False)
