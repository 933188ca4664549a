"""Spelling variants, source audit and quality rules against brute force and odd input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from tidemark.llm import divergence, quality, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, at int, _w string, term string"


def frame(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 1, "x", 7, 8, "y", "z") for r in rows], DOCS)


def letters(rows, every=97):
    """Uses of every word by the definition."""
    count = Counter()
    for doc, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows, every=97):
    words, out = letters(rows, every), {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def made_texts(seed, n=400):
    rnd = random.Random(seed)
    alphabet = "abé" if seed % 2 else "abcdefghijÿ×À"
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rnd.randint(0, 40)):
            w = rnd.choice(base[: rnd.randint(1, 60)])
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(alphabet) + w[k:], w[:k] + rnd.choice(alphabet) + w[k + 1 :]])
            ws.append(w.upper() if w.isascii() and rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice([" ", "7", "\n", "Ł", ". "]).join(ws)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_variants_equal_brute_force(spark, seed, monkeypatch):
    rows = made_texts(seed)
    rows += [(500, None), (501, ""), (502, " \n"), (None, "lonely lonely lonely lonelly lonelly lonelly"), (7, rows[7][1])]
    rows += [(600 + i, "q" * 2_000 + " " + "q" * 1_999) for i in range(4)]
    if seed:  # halves of more words than a block: a grid of groups
        monkeypatch.setattr(spelling, "BLOCK", 7)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame(spark, rows)).collect()}
    assert got == slow_variants(rows)


def test_deleted_letters(spark):
    """Every second (row, run) loses a letter, so most variants are made by the deletion."""
    rows = [(i, "Wonderful straße naïveté encyclopædia") for i in range(200)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame(spark, rows), every=2).collect()}
    assert got == slow_variants(rows, 2) and len(got) > 20


def test_chains_of_forms_lead_to_their_root(spark):
    rows = [(i, " ".join(["aaaaaa"] * (1 if i < 3 else 0) + ["aaaaab"] * (i < 6) + ["aaaabb"] * (i < 12) + ["aaabbb"] * (i < 24) + ["aabbbb"] * (i < 48))) for i in range(50)]
    got = {r["word"]: r["root"] for r in spelling.variants(frame(spark, rows), every=0).collect()}
    assert set(got.values()) == {"aabbbb"} and len(got) == 5


def test_no_variants(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "one two")])).count() == 0


def slow_audit(rows, least=3, top=200):
    uses, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for w in found:
            uses[lang, source, w] += 1
        for w in set(found):
            docs[lang, w] += 1
    kept = defaultdict(list)
    for (lang, w), n in docs.items():
        if n >= least:
            kept[lang].append(w)

    def shares(lang, sources):
        v, n = len(kept[lang]), {w: sum(uses[lang, s, w] for s in sources) for w in kept[lang]}
        total = sum(n.values())
        return {w: 1 + 10**9 * (c + 1) // (total + v) for w, c in n.items()}

    out = []
    for lang, source in groups:
        own, mates = shares(lang, [source]), [s for x, s in groups if x == lang]
        found = [("pair", s, sum((own[w] - q) ** 2 // q for w, q in shares(lang, [s]).items())) for s in mates if s != source]
        every = shares(lang, mates)
        found += [("term", w, (own[w] - q) ** 2 // q) for w, q in every.items() if uses[lang, source, w] and own[w] > q]
        for part in ("pair", "term"):
            ranked = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
            out += [(lang, source, *x, i) for i, x in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_audit_equals_brute_force(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(divergence, "HELD", 20)
    vocab = [f"{'éßÀa'[i % 4]}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(300):
        source = rnd.choice(["a", "a", "a", "b", "c", "é", "Z", None])
        words = [rnd.choice(vocab[: rnd.choice([5, 40, 120])]) for _ in range(rnd.randint(0, 30))]
        rows.append((i, rnd.choice([" ", "1", ", "]).join(words).swapcase(), rnd.choice(["en", "en", "xx", None]), source))
    rows += [(900, None, "en", "empty"), (901, "", "zz", "a"), (902, " \n\x07", "zz", "b"), (3, *rows[3][1:]), (904, "once", "yy", "a")]
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows), top=25).collect())
    assert got == slow_audit(rows, top=25)


def test_audit_of_nothing(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    assert divergence.divergence(frame(spark, [(1, "a b", "en", "s")])).count() == 0


def js(p, q):
    """Jensen-Shannon distance of two histograms as dicts of shares."""
    total = 0.0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0), q.get(k, 0)
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0)
    return math.sqrt(max(total, 0) / 2)


def slow_quality(rows):
    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]

    def classes(t):
        count = Counter()
        for c in "".join(words(t)):
            count[next((i for i, x in enumerate(("[a-z]", "[A-Z]", r"\p{L}", r"[.,;:'!?()\x22-]", "[0-9]")) if regex.fullmatch(x, c)), 5)] += 1
        return count

    langs, chars = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in rows:
        langs[lang].update(w.lower() for w in words(t))
        chars[lang].update(classes(t))
    out = []
    for i, t, lang in rows:
        w, n = words(t), len(words(t))
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams, cover = Counter(tuple(w[j : j + 8]) for j in range(n - 7)), set()
        for j in range(n - 7):
            if grams[tuple(w[j : j + 8])] > 1:
                cover |= set(range(j, j + 8))
        total, own = langs[lang].total(), classes(t)
        common = {x: c / total for x, c in langs[lang].items() if c * 400 >= total}
        far = False
        if total >= 1000:
            if own.total() >= 200:
                far = js({k: c / own.total() for k, c in own.items()}, {k: c / chars[lang].total() for k, c in chars[lang].items()}) > 0.3
            if n >= 50:
                mine = Counter(x.lower() if x.lower() in common else None for x in w)
                far |= js({k: c / n for k, c in mine.items()}, common | {None: 1 - sum(common.values())}) > 0.52
        failed = n < 20 or 100 * len(cover) > 30 * n
        out.append((i, n, own.total(), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed, not failed and not far))
    return sorted(out, key=str)


def quality_rows():
    rnd = random.Random(3)
    common, rare = ["the", "The", "of", "und", "é", "et,"], [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrß"]
    rows = []
    for i in range(200):
        lang = rnd.choice(["en", "en", "de", None, f"x{i % 3}"])
        own = [rnd.choice(common) if rnd.random() < 0.5 else rnd.choice(rare) for _ in range(rnd.choice([5, 30, 80, 200]))]
        kind = rnd.random()
        if kind < 0.15:
            own = [w.upper() + "!!" for w in own]
        elif kind < 0.3:
            own = [w + "###$" for w in own]
        elif kind < 0.4:
            own = [rnd.choice(rare) + "|" for _ in own]
        elif kind < 0.6:
            k = rnd.randrange(len(own))
            own = own[:k] + own[k : k + 12] * rnd.randint(1, 4) + own[k:]
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", "\n", "\n\n", "\t\x0b "]) for w in own), lang))
    rows += [(300, None, "en"), (301, "", None), (302, " \n\t\n ", "en"), (303, "a\na\na \n\nb\nb", "en"), (None, rows[0][1], "en"), (5, rows[5][1], rows[5][2]), (304, "of the " * 30_000, "en")]
    return rows


def test_quality_equals_brute_force(spark):
    rows = quality_rows()
    got = quality.judge(frame(spark, rows))
    got = got.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = slow_quality(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert 10 < sum(r[-1] for r in want) and any(not r[-1] and not r[-2] for r in want)


def test_quality_distances_and_empty_tables(spark):
    rows = [(i, "alpha beta gamma delta " * 30, "en") for i in range(20)] + [(99, "OMEGA#1 " * 120, "en")]
    got = {r["id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert got[99]["class_distance"] > 0.5 > 0.3 > got[0]["class_distance"] and got[99]["word_distance"] > got[0]["word_distance"]
    assert quality.judge(frame(spark, [])).count() == 0
    alone = quality.judge(frame(spark, [(1, "a b c", "en")])).collect()[0]  # too small a reference
    assert alone["class_distance"] is None and alone["word_distance"] is None and not alone["kept"]
