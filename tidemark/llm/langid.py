"""Language identification by a byte convolutional network.

Filters of several widths slide over fixed-length windows of UTF-8 bytes, each filter's largest response in a window is
kept, and a softmax layer turns these into language probabilities. A document's probabilities are the mean over all its
windows, weighted by their bytes. The network is trained in numpy on a bounded sample of labelled windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import bounded, free_name, give_back, numbered, read, text_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
UNKNOWN = "und"
#: Bytes of text whose windows are made at once, about; a longer text is still taken whole.
CHUNK = 1 << 20


@dataclass
class Network:
    """Weights: ``conv[i]`` is (width, 256, filters) for WIDTHS[i]; ``out`` is (all filters + 1, languages)."""

    languages: list[str]
    conv: list[np.ndarray]
    out: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses by byte pair: the first two bytes of every filter, the third of width 3, the last two of width 4."""
        two = [(w[0][:, None, :] + w[1][None, :, :]).reshape(65536, -1) for w in self.conv]
        tail = (self.conv[2][2][:, None, :] + self.conv[2][3][None, :, :]).reshape(65536, -1)
        return tuple(np.ascontiguousarray(x, "f4") for x in (np.hstack(two), self.conv[1][2], tail))

    def responses(self, windows: np.ndarray, tables) -> tuple[list[np.ndarray]]:
        head, third, tail = tables
        pair = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        first, f = head[pair], FILTERS
        return [
            first[:, :, :f],
            first[:, :-1, f : 2 * f] + third[windows[:, 2:]],
            first[:, :-2, 2 * f :] + tail[pair[:, 2:]],
        ]

    def predict(self, windows: np.ndarray, tables) -> np.ndarray:
        """Probabilities of windows, a thousand at a time."""
        got = []
        for at in range(0, len(windows), 1024):
            pooled = [r.max(axis=1) for r in self.responses(windows[at : at + 1024], tables)]
            got.append(softmax(hidden(pooled) @ self.out))
        return np.concatenate(got) if got else np.zeros((0, len(self.languages)))


def hidden(pooled: list[np.ndarray]) -> np.ndarray:
    """ReLU of the pooled responses, and a column of ones."""
    h = np.maximum(np.hstack(pooled), 0)
    return np.hstack([h, np.ones((len(h), 1), h.dtype)])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, epochs: int = 12, steps: int = 400,
          batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
    """Minimise cross-entropy with Adam in ``epochs``, or in more that make ``steps``; order and start follow from ``seed``."""
    epochs = max(epochs, -(-steps // -(-len(labels) // batch)))
    rng = np.random.default_rng(seed)
    conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS]
    net = Network(languages, conv, rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(languages))).astype("f4"))
    params = [*net.conv, net.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(labels) / (len(languages) * np.bincount(labels, minlength=len(languages)).clip(1))
    total = epochs * -(-len(labels) // batch)
    cell = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], labels[rows]
            got = net.responses(x, net.tables())
            where = [r.argmax(axis=1) for r in got]
            pooled = [np.take_along_axis(r, p[:, None, :], 1)[:, 0] for r, p in zip(got, where, strict=True)]
            h = hidden(pooled)
            gap = softmax(h @ net.out)
            gap[np.arange(len(y)), y] -= 1
            gap *= (weight[y] / len(y))[:, None]
            back = (gap @ net.out[:-1].T) * (h[:, :-1] > 0)
            grads = []
            for i, width in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                hit = [x[np.arange(len(x))[:, None], where[i] + j].astype("i8") * FILTERS + cell for j in range(width)]
                grads.append(np.stack([
                    np.bincount(k.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in hit
                ]))
            grads.append(h.T @ gap)
            step += 1
            now = rate * (1 - (step - 1) / total)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts, the last of each filled up with zero bytes, and the number of windows of each text."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], "i8")
    raw = b"".join([t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist(), strict=True)])
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW), n


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def noise_windows(data: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` windows of no language: sampled windows with their bytes in random order, and random hexadecimal digits, base64,
    digits with signs, letters and printable bytes, each of 64 bytes or more."""
    rng = np.random.default_rng([seed, 1])
    sets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789 .,-:;/#$%&*()[]{}<>|=+_~^",
            "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ", "".join(map(chr, range(32, 127)))]
    out = data[rng.integers(0, len(data), n)].copy()
    for i in range(n):
        size = int((out[i] > 0).sum())
        if i % 2 == 0 and size >= 64:
            out[i, :size] = rng.permutation(out[i, :size])
        else:
            size = int(rng.integers(64, WINDOW + 1))
            own = np.frombuffer(sets[i // 2 % len(sets)].encode(), np.uint8)
            out[i] = 0
            out[i, :size] = own[rng.integers(0, len(own), size)]
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 8000,
        windows: int = 4, seed: int = 5, epochs: int = 12, noise: bool = False) -> Network | None:
    """Train on about ``sample`` documents in equal shares of languages, ``windows`` windows of each at most.

    Documents come from the labelled ones that aren't held out, by a hash of their id, so the driver gets about
    ``sample * windows`` windows of 256 bytes whatever the corpus. Rows with one id or none share a hash, so they are chosen
    together; rows in excess of four times the sample are left out by their hash. With ``noise`` windows made of random bytes
    are one more class, ``und``. Without a labelled text: None.
    """
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(sample).collect()}
    if not counts:
        return None
    share = sample // len(counts) or 1
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
    fraction = F.lit(0.0)
    for lang, n in counts.items():
        fraction = F.when(F.col(lang_col) == lang, F.lit(share / n)).otherwise(fraction)
    order = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col))  # of rows with one id
    chosen = known.filter(draw < fraction).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("order"))
    chosen = chosen.orderBy("order").limit(4 * sample)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n = max(1, -(-len(raw) // WINDOW))
                for k in sorted({int(i * (n - 1) / max(1, windows - 1)) for i in range(windows)}):
                    rows.append((lang, raw[k * WINDOW : (k + 1) * WINDOW].ljust(WINDOW, b"\0")))
            yield pd.DataFrame(rows, columns=["lang", "window"])

    got = chosen.mapInPandas(some, "lang string, window binary").collect()
    got = sorted((r["lang"], bytes(r["window"])) for r in got)
    languages = sorted({x for x, _ in got})
    if not languages:
        return None
    index = {x: i for i, x in enumerate(languages)}
    data = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    labels = np.array([index[x] for x, _ in got])
    if noise:
        more = noise_windows(data, -(-len(data) // len(languages)), seed)
        data, labels = np.concatenate([data, more]), np.append(labels, np.full(len(more), len(languages)))
        languages = [*languages, UNKNOWN]
    net = train(data, labels, languages, seed=seed, epochs=epochs)
    give_back()
    return net


def annotate(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the language and the score of every whole text, and the names of those two columns.

    The names are new to ``docs``. Texts that are null, empty or without a letter are ``und`` with score 0, as is
    everything if there is no network.
    """
    text_batches(docs.sparkSession)
    pred_col, score_col = free_name(docs, "lang_pred"), free_name(docs, "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        try:
            for b in batches:
                for part in bounded(b, text_col, 4 * CHUNK):
                    texts = ["" if t is None else t for t in part.column(at).to_pylist()]
                    pred, score = label(texts, net, tables)
                    cols = [*part.columns, pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, pred_col, score_col])
        finally:
            give_back()

    schema = T.StructType([*docs.schema.fields]).add(pred_col, "string").add(score_col, "double")
    return docs.mapInArrow(run, schema), pred_col, score_col


def label(texts: list[str], net: Network | None, tables) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
    at = 0
    while at < len(known):  # about a megabyte of whole texts at a time
        part, size = [], 0
        while at < len(known) and (not part or size < CHUNK):
            part.append(known[at])
            size += len(texts[known[at]])
            at += 1
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in part]
        x, n = cut(raw)
        starts = np.cumsum(n) - n
        fill = np.full(len(x), float(WINDOW))
        fill[starts + n - 1] = [len(r) - WINDOW * (k - 1) for r, k in zip(raw, n.tolist(), strict=True)]
        p = np.add.reduceat(net.predict(x, tables) * fill[:, None], starts) / np.add.reduceat(fill, starts)[:, None]
        best = p.argmax(axis=1)
        pred[part] = [net.languages[i] for i in best]
        score[part] = np.clip(p[np.arange(len(p)), best], 0, 1)
    return pred, score


def identify(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, without a shuffle.

    See ``annotate`` for texts without a language. Repeated rows stay; null ids aren't held out; other columns are not
    read; an empty table gives no rows.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    )
    return annotate(own, net)[0].select("doc_id", "held_out", "lang_pred", "score")


def reject(docs: DataFrame, net: Network | None, *, sure: float = 0.9, text_col: str = "text") -> DataFrame:
    """``docs`` without texts in no language: those without a letter, and those that a network trained with ``noise`` takes for
    random bytes with a mean probability of ``sure`` or more over all their windows.

    A text in some language stays however unsure which: texts that mix languages score low but are clean. All columns stay
    as they are. Without a network, or with one that knows no noise, only texts without a letter go.
    """
    own, name = numbered(docs)  # so that no name of a caller's can clash or need quotes
    text = name[text_col]
    if net is None or UNKNOWN not in net.languages:
        return own.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).toDF(*docs.columns)
    got, pred, score = annotate(own, net, text_col=text)
    junk = (F.col(pred) == UNKNOWN) & ((F.col(score) >= sure) | (F.col(score) == 0))
    return got.filter(~junk).select(*name.values()).toDF(*docs.columns)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents`` by a network trained on those that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
