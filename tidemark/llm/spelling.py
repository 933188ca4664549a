"""Spelling variants: which words of a corpus are one edit apart, and which frequent form each belongs to.

Two words that differ by one edit share their left or their right half exactly (halves of the one that asks). The words
are therefore dealt by half: a word asks under both of its halves and is found under every half that a word of its length,
or of one more or less, can have in common with it. Each group of halves gets a bidirectional FM-index of its delimited
words, ``$w1$w2...`` read as a ring: intervals of the sorted rotations of the text and of its reverse are kept in step.
Search schemes then match one half exactly, delimiter included, and extend across the other with one error up to the
closing delimiter; mirrored sides give the scheme for the right half. A half that very many words share is a grid of
blocks of words to find and words that ask, so no group grows with it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, bounded, give_back, partitions_for, read, small, text_batches

#: Distinct words a task holds before it passes its counts on.
HELD = 200_000
#: Words of an index, about, and cells of a matrix of words that ask together.
BLOCK, CELLS = 20_000, 500_000
#: Words in Latin-1: A-Z become a-z, other letters stay, anything else is a blank; and the codes of letters, from 1.
_LETTERS = bytes([*range(97, 123), *range(0xC0, 0x100)])
_TO_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))
_CODE = np.zeros(256, "u1")
_CODE[list(_LETTERS)] = np.arange(1, len(_LETTERS) + 1)
_BITS = 7


class _Utf8(dict):
    def __missing__(self, word: bytes) -> bytes:
        got = self[word] = word if word.isascii() else word.decode("latin-1").encode()
        return got


def counted(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of rows (doc_id, text), summed over what a task has read since it last passed on.

    A run whose hash with its row's id divides by ``every`` loses the character its hash points at.
    """
    total, utf8, crc = Counter(), _Utf8(), zlib.crc32

    def out() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in total]
        got = pa.record_batch([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        utf8.clear()
        give_back()
        return got

    for batch in batches:
        for part in bounded(batch, "text", 4_000_000):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                # what Latin-1 lacks becomes a question mark, which is no letter either
                words = [w for w in text.encode("latin-1", "replace").translate(_TO_LETTERS).split() if len(w) >= least]
                total.update(words)
                base = crc(b"%s:" % (b"" if doc is None else b"%d" % doc))
                for w in [w for w in set(words) if not crc(utf8[w], base) % every] if every else ():
                    n, at = words.count(w), crc(utf8[w], base) % len(w)
                    total[w] -= n
                    if len(w) > least:
                        total[w[:at] + w[at + 1 :]] += n
                if len(total) > HELD or len(utf8) > HELD:
                    yield out()
    yield out()


class Side:
    """One direction of the index: sorted rotations of a ring, their preceding characters as a wavelet matrix."""

    def __init__(self, ring: np.ndarray):
        n = len(ring)
        rank, step = np.unique(ring, return_inverse=True)[1].astype("i8"), 1  # below n, for the keys
        while True:  # prefix doubling; words are distinct, so rotations are
            key = rank * n + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, "i8")
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            step *= 2
        self.last = ring[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ring, minlength=1 << _BITS))])
        starts = np.flatnonzero(ring == 0)
        self.word = np.empty(len(starts), "i8")
        self.word[rank[starts]] = np.arange(len(starts))  # rotations that begin with a delimiter come first
        self.levels, row = [], self.last
        for b in reversed(range(_BITS)):
            bit = row >> b & 1
            ones = np.zeros(n + 1, "i4")
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, n - int(ones[-1]), ones))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        every = np.arange(1 << _BITS)
        self.base = np.zeros(1 << _BITS, "i8")
        self.base = self.below(every, np.zeros_like(every), np.zeros_like(every))[0]

    def below(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the characters before rotations [lo, hi): how many c there are before lo and before hi, and how many smaller ones inside."""
        less = np.zeros(len(c), "i8")
        lo, hi = lo.astype("i8"), hi.astype("i8")
        for b, zeros, ones in self.levels:
            bit, l1, h1 = (c >> b & 1).astype(bool), ones[lo].astype("i8"), ones[hi].astype("i8")
            less += np.where(bit, hi - h1 - lo + l1, 0)
            lo, hi = np.where(bit, zeros + l1, lo - l1), np.where(bit, zeros + h1, hi - h1)
        return lo - self.base[c], hi - self.base[c], less


class Index:
    """Bidirectional FM-index of distinct words (codes of letters)."""

    def __init__(self, words: list[np.ndarray]):
        ring = np.zeros(sum(map(len, words)) + len(words), "u1")
        ends = np.cumsum([len(w) + 1 for w in words])
        for w, z in zip(words, ends.tolist(), strict=True):
            ring[z - len(w) : z] = w
        self.size = len(ring)
        self.text, self.back = Side(ring), Side(ring[::-1].copy())
        # word i is the i-th of the ring, and in the reversed ring the delimiter before it is that of the word after it
        self.back.word = (len(words) - 1 - self.back.word - 1) % len(words)

    def near(self, codes: np.ndarray, sizes: np.ndarray, halves: np.ndarray, mirrored: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of words that share the first ``halves`` letters of a row of ``codes`` and differ by one edit in the
        rest. ``mirrored``: rows are reversed words, so it is their last letters that are shared."""
        text, back = (self.back, self.text) if mirrored else (self.text, self.back)
        rows = np.arange(len(codes))
        lo, lr, n = np.zeros(len(codes), "i8"), np.zeros(len(codes), "i8"), np.full(len(codes), self.size)
        # the exact half, from its end to the delimiter before it: intervals of the text grow to the left
        for j in range(int(halves.max(initial=0)), -1, -1):
            on = np.flatnonzero((halves >= j) & (n > 0))
            c = codes[on, j - 1] if j else np.zeros(len(on), "u1")
            a, z, less = text.below(c, lo[on], lo[on] + n[on])
            lo[on], lr[on], n[on] = text.start[c] + a, lr[on] + less, z - a
        on = np.flatnonzero(n > 0)
        state = [rows[on], lo[on], lr[on], n[on], halves[on].astype("i8"), np.zeros(len(on), bool)]
        hits = []
        while len(state[0]):
            row, lo, lr, n, j, used = state
            end = j == sizes[row]
            closing = np.flatnonzero(end & used)
            if len(closing):
                a, b, c = self._right(back, np.zeros(len(closing), "u1"), lo[closing], lr[closing], n[closing])
                hits.append((row[closing][c > 0], text.word[a[c > 0]]))
            parts = []
            go = np.flatnonzero(~end)
            c = codes[row[go], j[go]]
            parts.append((row[go], *self._right(back, c, lo[go], lr[go], n[go]), j[go] + 1, used[go]))
            free = np.flatnonzero(~used)
            skip = free[~end[free]]  # a letter of the row is missing in the word
            parts.append((row[skip], lo[skip], lr[skip], n[skip], j[skip] + 1, np.ones(len(skip), bool)))
            at, c = self._letters(back, lr[free], n[free])
            at = free[at]
            a, b, w = self._right(back, c, lo[at], lr[at], n[at])
            parts.append((row[at], a, b, w, j[at], np.ones(len(at), bool)))  # the word has a letter more
            other = np.flatnonzero(~end[at] & (codes[row[at], np.minimum(j[at], codes.shape[1] - 1)] != c))
            parts.append((row[at][other], a[other], b[other], w[other], j[at][other] + 1, np.ones(len(other), bool)))
            state = [np.concatenate(x) for x in zip(*parts, strict=True)]
            some = state[3] > 0
            state = [x[some] for x in state]
            if len(state[0]) > 4 * len(codes):  # edits of runs of one letter lead to the same place
                once = np.unique(np.stack([x.astype("i8") for x in state]), axis=1)
                state = [*once[:5], once[5].astype(bool)]
        if not hits:
            return rows[:0], rows[:0]
        got = np.unique(np.stack([np.concatenate(x) for x in zip(*hits, strict=True)]), axis=1)
        return got[0], got[1]

    @staticmethod
    def _right(back: Side, c, lo, lr, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of text and reverse, and their size, one letter further to the right."""
        a, z, less = back.below(c, lr, lr + n)
        return lo + less, back.start[c] + a, z - a

    @staticmethod
    def _letters(back: Side, lr: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) of the letters that follow each state: narrow intervals are read, wide ones try every letter."""
        few, many = np.flatnonzero(n <= len(_LETTERS)), np.flatnonzero(n > len(_LETTERS))
        at = np.repeat(few, n[few])
        inside = np.arange(len(at)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
        pair = np.unique(at * 256 + back.last[lr[at] + inside]) if len(at) else at
        pair = np.concatenate([pair, (many[:, None] * 256 + np.arange(1, len(_LETTERS) + 1)).ravel()])
        pair = pair[pair % 256 > 0]
        return pair // 256, (pair % 256).astype("u1")


def matched(group: pa.Table) -> pd.DataFrame:
    """Answers of one group of (word, n, side, asks): word, n_near, best_n, best, for every word that asks and finds."""
    rows = group.to_pandas()
    there = rows[~rows["asks"]].drop_duplicates("word")
    asks = rows[rows["asks"]].drop_duplicates(["word", "side"])
    cols = ["word", "n_near", "best_n", "best"]
    if not len(there) or not len(asks):
        return pd.DataFrame(columns=cols)
    words, counts = there["word"].tolist(), there["n"].to_numpy("i8")
    index = Index([_coded(w) for w in words])
    place = np.argsort(np.argsort(np.array([w.encode("latin-1") for w in words], object)))  # code points in order
    out = []
    asks = asks.assign(size=asks["word"].str.len()).sort_values("size")
    for side, own in asks.groupby("side"):
        a, sizes, texts = 0, own["size"].to_numpy("i8"), own["word"].tolist()
        while a < len(sizes):
            z = a + 1
            while z < len(sizes) and (z - a + 1) * sizes[z] <= CELLS:
                z += 1
            part = texts[a:z]
            codes = np.zeros((z - a, int(sizes[z - 1])), "u1")
            for i, w in enumerate(part):
                codes[i, : len(w)] = _coded(w) if side == "l" else _coded(w)[::-1]
            left = sizes[a:z] // 2
            row, word = index.near(codes, sizes[a:z], left if side == "l" else sizes[a:z] - left, side == "r")
            if side == "r":  # a pair that shares its left half too was found there
                new = [not words[v].startswith(part[q][: len(part[q]) // 2]) for q, v in zip(row.tolist(), word.tolist(), strict=True)]
                row, word = row[new], word[new]
            if len(row):
                order = np.lexsort((place[word], -counts[word], row))
                row, word = row[order], word[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                n = np.diff(np.append(first, len(row)))
                out += zip([part[q] for q in row[first].tolist()], n.tolist(), counts[word[first]].tolist(), [words[v] for v in word[first].tolist()], strict=True)
            a = z
    return pd.DataFrame(out, columns=cols)


def _coded(word: str) -> np.ndarray:
    return _CODE[np.frombuffer(word.encode("latin-1"), "u1")]


def halves(words: DataFrame) -> DataFrame:
    """Rows (word, n, side, half, asks): each word under the halves it asks with and those it may be found under."""
    m, word = F.length("word"), F.col("word")
    left = [F.floor((m + d) / 2).cast("int") for d in (-1, 0, 1)]
    right = [F.ceil((m + d) / 2).cast("int") for d in (-1, 0, 1)]

    def under(side: str, half: Column, asks: bool) -> Column:
        return F.struct(F.lit(side).alias("side"), half.alias("half"), F.lit(asks).alias("asks"))

    def first(k: Column) -> Column:
        return F.substring(word, F.lit(1), k)

    def end(k: Column) -> Column:
        return F.substring(word, m - k + 1, k)

    found = F.array_distinct(F.array(*[under("l", first(k), False) for k in left], *[under("r", end(k), False) for k in right]))
    ask = F.array(under("l", first(left[1]), True), under("r", end(right[1]), True))
    return words.select("word", "n", F.explode(F.concat(found, ask)).alias("x")).select("word", "n", "x.*")


def neighbours(words: DataFrame, keep: Scratch) -> DataFrame:
    """(word, n_near, best_n, best) of distinct words (word, n) that have a near one."""
    rows = keep(halves(words))
    parts = partitions_for(words)
    count = rows.groupBy("side", "half").agg(F.count(F.when(~F.col("asks"), 1)).alias("there"), F.count(F.when(F.col("asks"), 1)).alias("ask"))
    grid = count.select("side", "half", F.ceil(F.col("there") / BLOCK).cast("int").alias("down"), F.ceil(F.col("ask") / BLOCK).cast("int").alias("across"))
    grid = small(keep(grid.filter("down > 1 or across > 1")))
    n = max(parts, -(-rows.filter("not asks").count() // BLOCK))
    dealt = rows.join(grid, ["side", "half"], "left").withColumns({"down": F.coalesce("down", F.lit(0)), "across": F.coalesce("across", F.lit(0))})
    # a large half is a group a block; all others share groups by hash. A large half nobody asks under has no block
    own = F.pmod(F.xxhash64("word"), F.greatest(F.when(F.col("asks"), F.col("across")).otherwise(F.col("down")), F.lit(1))).cast("int")
    every = F.when(F.col("asks"), F.col("down")).otherwise(F.col("across"))
    every = F.when(F.greatest("down", "across") == 0, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), every), lambda i: i < every))
    dealt = dealt.withColumns({"mine": own, "theirs": F.explode(every)})
    large = F.greatest("down", "across") > 0
    dealt = dealt.select(
        "word", "n", "side", "asks",
        F.when(large, F.concat("side", "half")).otherwise(F.pmod(F.xxhash64("side", "half"), F.lit(n)).cast("string")).alias("bin"),
        F.when(~large, 0).when(F.col("asks"), F.col("theirs")).otherwise(F.col("mine")).alias("row"),
        F.when(~large, 0).when(F.col("asks"), F.col("mine")).otherwise(F.col("theirs")).alias("col"),
    )
    kinds = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def search(group: pa.Table) -> pa.Table:
        got = pa.Table.from_pandas(matched(group), schema=kinds, preserve_index=False)
        give_back()
        return got

    got = dealt.groupBy("bin", "row", "col").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("x")
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def roots(forms: DataFrame, keep: Scratch) -> DataFrame:
    """(word, root) of rows (word, form): where following forms ends. Links double in reach every turn; forms at least
    double in number of uses, so a chain of k forms needs 2^k uses and the turns are few."""
    state = keep(forms.select("word", F.col("form").alias("to")))
    while True:
        onward = state.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        nxt = keep(state.join(small(onward), "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        if not nxt.filter("moved").limit(1).count():
            return nxt.select("word", F.col("to").alias("root"))
        state = nxt.select("word", "to")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_uses: int = 3,
             every: int = 97, factor: int = 2) -> DataFrame:
    """Words of all texts with their near words and forms: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run loses one letter where ``every`` divides
    the crc32 of ``<id>:<run>`` (``every`` 0: never). Those of ``least_length`` letters or more with ``least_uses`` uses count.
    Near words are one inserted, deleted or replaced letter apart. A word's form is its near word with most uses (ties:
    smallest), if that has at least ``factor`` times its own; the root is where forms lead.

    Null texts have no words; a null id is written as nothing; repeated rows count as often as they are there; words of any
    length are indexed whole; an empty table gives no rows; other columns aren't read.
    """
    text_batches(docs.sparkSession)
    keep = Scratch(docs.sparkSession, "spelling")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        return counted(batches, least_length, every)

    words = own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = keep(words.filter(F.col("n") >= least_uses))
    near = words.join(neighbours(words, keep), "word", "left")
    form = F.col("best_n") >= factor * F.col("n")
    near = keep(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")))
    ends = roots(near.filter("form is not null"), keep)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all ``documents``."""
    return variants(read(spark, sf_dir, "documents"))
