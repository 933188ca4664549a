"""Ogg media columns: texts stored as 8-bit samples in Ogg pages, and read back page by page.

Writing: each 576-sample frame is a packet; frames alternate between two logical streams whose pages interleave, every
stream opening with a header packet on a page of its own. A page's granule position counts the samples of its stream
up to the last packet that ends on it (-1 if none ends).

Reading: the checksum of every page is verified, lacing values cut the body into packets (255 continues, also over
pages), pages are dealt to logical streams by serial number with their sequence numbers checked, and granule positions
give the time at which each page ends.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import read

FRAME = 576
RATE = 8000
#: Header packet of a sample stream: name, version, rate, streams, place of this one, frame length.
HEAD = struct.Struct("<8sBIBBH")
NAME = b"samples8"
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_LACING = 255
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, neither reflected nor inverted, by way of zlib's reflected one."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(body: bytes, lacing: bytes, *, flags: int, granule: int, serial: int, number: int) -> bytes:
    """One page with its checksum set."""
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    raw = head + lacing + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def lace(packet: bytes) -> bytes:
    """Lacing values of one packet."""
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def pages(packets: list[bytes], *, serial: int, number: int = 0, granules: list[int], first: bool = False,
          last: bool = False, most: int = MAX_LACING) -> list[bytes]:
    """Pages of a logical stream; a packet that doesn't fit goes on on the next page."""
    lacing = [(v, i, j == len(vs) - 1) for i, vs in enumerate(map(lace, packets)) for j, v in enumerate(vs)]
    body, at, out = b"".join(packets), 0, []
    for k in range(0, len(lacing), most):
        part = lacing[k : k + most]
        ended = [i for _, i, end in part if end]
        flags = CONTINUED * (k > 0 and not lacing[k - 1][2]) | FIRST * (first and k == 0)
        flags |= LAST * (last and k + most >= len(lacing))
        size = sum(v for v, _, _ in part)
        granule = granules[ended[-1]] if ended else -1
        out.append(page(body[at : at + size], bytes(v for v, _, _ in part), flags=flags, granule=granule,
                        serial=serial, number=number + len(out)))
        at += size
    return out


@dataclass
class Stream:
    """What reading has found of one logical stream."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    pages: int = 0
    open: list[bytes] = field(default_factory=list)
    ended: bool = False


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises ValueError for a damaged, missing or misplaced page."""
    at, found, view = 0, {}, memoryview(media)
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise ValueError(f"cut page at {at}")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = media[at + PAGE.size : at + PAGE.size + n]
        start = at + PAGE.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError(f"cut page at {at}")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise ValueError(f"wrong checksum of the page at {at}")
        own = found.get(serial)
        if flags & FIRST:
            if own:
                raise ValueError(f"stream {serial} begins twice")
            own = found[serial] = Stream(serial)
        if own is None or own.ended or own.pages != number or bool(flags & CONTINUED) != bool(own.open):
            raise ValueError(f"page {number} of stream {serial} is out of place")
        own.pages, own.ended = number + 1, bool(flags & LAST)
        size, done = 0, False
        for v in lacing:
            size += v
            if v < 255:
                own.open.append(media[start : start + size])
                own.packets.append(own.open[0] if len(own.open) == 1 else b"".join(own.open))
                own.open, start, size, done = [], start + size, 0, True
        if size or n and lacing[-1] == 255:
            own.open.append(media[start : start + size])
        if done != (granule >= 0):
            raise ValueError(f"page {number} of stream {serial} has no time")
        if done:
            if own.times and granule < own.times[-1]:
                raise ValueError(f"time of stream {serial} runs backwards")
            own.times.append(granule)
        at = end
    if any(s.open or not s.ended for s in found.values()):
        raise ValueError("a stream ends early")
    return found


def store(payload: bytes) -> bytes:
    """A payload (a multiple of the frame length) as an Ogg file; equal payloads give equal files."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    serials = [serial, serial | 1]
    heads, bodies = [], []
    for place, serial in enumerate(serials):
        own = frames[place::2]
        head = HEAD.pack(NAME, 1, RATE, 2, place, FRAME)
        heads += pages([head], serial=serial, granules=[0], first=True, last=not own)
        ends = [FRAME * (i + 1) for i in range(len(own))]
        bodies.append(pages(own, serial=serial, number=1, granules=ends, last=True))
    mixed = [p for i in range(max(map(len, bodies))) for b in bodies for p in b[i : i + 1]]
    return b"".join(heads + mixed)


def load(media: bytes) -> tuple[bytes, dict]:
    """Samples of an Ogg file that ``store`` wrote, and what its structure says."""
    streams = {}
    for s in demultiplex(media).values():
        name, version, rate, of, place, frame = HEAD.unpack(s.packets[0])
        if name != NAME or version != 1 or place in streams:
            raise ValueError("not a sample stream")
        if s.times[-1] != frame * (len(s.packets) - 1):
            raise ValueError(f"the time of stream {s.serial} doesn't match its packets")
        streams[place] = (s, rate, of)
    a, rate, of = streams[0]
    if sorted(streams) != list(range(of)):
        raise ValueError("a stream is missing")
    out = [b""] * sum(len(s.packets) - 1 for s, _, _ in streams.values())
    for place, (s, _, _) in streams.items():
        out[place::of] = s.packets[1:]
    about = {
        "streams": of, "pages": sum(s.pages for s, _, _ in streams.values()), "packets": len(out),
        "samples": sum(s.times[-1] for s, _, _ in streams.values()), "rate": rate,
    }
    return b"".join(out), about


def features(samples: bytes, about: dict) -> str:
    """Structure, duration and sample statistics as text; integers only, so equal samples give equal strings."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256, dtype="int64")
    total, square = int(counts @ level), int(counts @ (level * level))
    high = x >= 128
    ms = about["samples"] * 1000 // about["rate"]
    return (
        f"streams={about['streams']};pages={about['pages']};packets={about['packets']};ms={ms};"
        f"sum={total};squares={square};peak={int(level[counts > 0][-1])};levels={int((counts > 0).sum())};"
        f"crossings={int((high[1:] != high[:-1]).sum())}"
    )


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Store every whole text as Ogg samples, read the stored bytes back and describe them; one row per row.

    The payload is the text's UTF-8 and bytes 255 up to the next positive multiple of 576: null and empty texts are one
    frame of 255. Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature and, with ``keep``, the Ogg bytes. Repeated rows and null ids stay; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"].fillna("").tolist():
                raw = text.encode("utf-8", "surrogatepass")
                stored = store(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)))
                back, about = load(stored)
                row = (
                    len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored),
                    hashlib.sha256(stored).hexdigest(), features(back, about),
                )
                rows.append((*row, stored) if keep else row)
            cols = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            out = pd.DataFrame(rows, columns=cols + ["media"] * keep)
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string" + ", media binary" * keep
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as Ogg media and back."""
    return media(read(spark, sf_dir, "documents"), keep=False)
