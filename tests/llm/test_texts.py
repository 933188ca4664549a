"""Token output, byte BPE, languages, Ogg, licences and pages against libraries, brute force and odd input."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, html_extract, langid, licenses, ogg, packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, batch int, fp string, size double"
ODD = [None, "", " ", "\n\t", "a", "É ß 漢字 \U0001f600", "x" * 30_000, "one two  three\n four five\x1csix ", "12 &&& it's <|endoftext|> end"]


def frame(spark, texts, ids=None, lang="en"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", 1, 7, 7, "x", 0.5) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def noise():
    rnd = random.Random(3)
    letters = "ab 's\n\t\r\x1c\x1f\x85\xa0   é ñ漢字\U0001f600 12 .,  !'t 're \x00́ ßİΣ"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]


def test_word_encoder_equals_whole_texts(noise):
    enc = packing.WordEncoder(WORD_BPE, keep=500)
    texts = [t for t in ODD if t is not None] + noise
    for part in (texts[:1500], texts[1500:], ["aB\u030c J\u030c \u0130\u0307", "Abc abc ABC", ""]):
        flat, ends = enc(pa.array(part))
        for text, got in zip(part, np.split(flat, ends[:-1]), strict=True):
            assert got.tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_byte_bpe_equals_tiktoken(noise):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN, True, keep=500)
    texts = [t for t in ODD if t is not None] + noise
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode_ordinary(text)
        assert own.decode(got) == text.encode()


def test_byte_bpe_rows(spark):
    got = byte_bpe.encode(frame(spark, ODD + ["a", "a"], [*range(9), 4, None]), ranks=RANKS).orderBy("doc_id").collect()
    assert len(got) == 11 and got[0]["doc_id"] is None
    for r in got:
        assert hashlib.sha256(r["raw"]).hexdigest() == r["ids_sha256"] and r["n_tokens"] == len(r["raw"]) // 4
    assert bytes(got[1]["decoded"]) == b"" and got[1]["n_tokens"] == 0
    assert byte_bpe.encode(frame(spark, []), ranks=RANKS).count() == 0


def test_packing_round_trip(spark, tmp_path):
    texts = [*ODD, *[f"word{i % 17} and {i} more words here" for i in range(400)], "dup b", "dup a"]
    ids = [*range(100, 109), *range(1000, 600, -1), 5, 5]
    out = f"file://{tmp_path}/p"
    packing.pack(frame(spark, texts, ids), out, tokenizer=WORD_BPE)
    enc = packing.WordEncoder(WORD_BPE)
    got = packing.unpack(spark, out, with_ids=True).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(zip(ids, [t or "" for t in texts], strict=True)), strict=True):
        want = enc.whole(t).tobytes() + b"\2\0\0\0"
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(want) // 4, zlib.crc32(want)) and bytes(r["ids"]) == want
        at += len(want) // 4
    few = {r["doc_id"]: r["ids"] for r in packing.lookup(spark, out, [700, 101, 9]).collect()}
    assert set(few) == {700, 101} and few[101] == [2]
    packing.pack(frame(spark, []), f"{out}-none", tokenizer=WORD_BPE)
    assert packing.unpack(spark, f"{out}-none").count() == 0
    packing.pack(frame(spark, ["a", "b"], [None, 1]), f"{out}-null", tokenizer=WORD_BPE)
    assert [r["doc_id"] for r in packing.unpack(spark, f"{out}-null").orderBy("start").collect()] == [None, 1]


def test_packing_rejects_another_dictionary(spark, tmp_path):
    out = f"file://{tmp_path}/q"
    packing.pack(frame(spark, [f"some words {i}" for i in range(50)]), out, tokenizer=WORD_BPE)
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "dictionary string, bytes binary").write.mode("overwrite").parquet(f"{out}/dictionary")
    with pytest.raises(ValueError):
        packing.unpack(spark, out)


def test_ogg_checksum_and_pages():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow(data)
    packets = [b"x" * 1000, b"", b"y" * 255, b"z" * 70_000]
    raw = b"".join(ogg.pages(packets, serial=9, granules=[1, 2, 3, 4], first=True, last=True, most=7))
    found = ogg.demultiplex(raw)[9]
    assert found.packets == packets and found.times[-1] == 4
    for at in (0, 10, 30, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.demultiplex(bytes(bad))
    with pytest.raises(ValueError):
        ogg.demultiplex(raw[:-5])


@pytest.mark.parametrize("n", [1, 2, 84, 85, 86, 170, 171, 400])
def test_ogg_store_and_load(n):
    payload = np.random.default_rng(n).integers(0, 256, n * ogg.FRAME, dtype=np.uint8).tobytes()
    back, about = ogg.load(ogg.store(payload))
    assert back == payload and about["samples"] == len(payload) and about["packets"] == n and about["streams"] == 2


def test_ogg_rows(spark):
    got = ogg.media(frame(spark, ODD + ["a"], [*range(9), 4])).orderBy("doc_id").collect()
    for r, t in zip(got, [*ODD[:5], "a", *ODD[5:]], strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and ogg.load(bytes(r["media"]))[0] == payload
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[4]["feature"] == got[5]["feature"]
    assert ogg.media(frame(spark, [])).count() == 0


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    net = langid.fit(docs, sample=1500, epochs=6)
    got = langid.identify(docs, net).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 1000 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = langid.identify(frame(spark, [None, "", "12 !!", "²", "the and of to in"]), net).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:4]] == ["und"] * 4 and odd[4]["lang_pred"] != "und"
    rnd = random.Random(4)
    junk = [rnd.randbytes(200).hex(), base64.b64encode(rnd.randbytes(300)).decode(), "".join(rnd.choice("qwrtzpxcvbjk ") for _ in range(300))]
    more = langid.fit(docs, sample=1500, epochs=6, noise=True)
    for one, want in ((net, [2, 3, 4, 5]), (more, [2])):
        kept = langid.reject(frame(spark, [None, "12 !!", docs.first()["text"], *junk]), one)
        assert kept.columns == frame(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert docs.count() - langid.reject(docs, more).count() <= 4


def test_language_training_is_repeatable_and_ignores_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = langid.fit(docs, sample=40, epochs=1)
    spoilt = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    b = langid.fit(spoilt, sample=40, epochs=1)
    assert a.languages == b.languages and np.array_equal(a.out, b.out)
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit(2))
    assert langid.reject(clash, langid.fit(docs, sample=40, epochs=1, noise=True)).columns == clash.columns


def test_rejection_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "ein Text", 5), (2, "123", 6), (3, None, 7)], "doc_id long, text string, `odd``na me.x` int")
    got = langid.reject(df, None)
    assert got.columns == df.columns and [r["doc_id"] for r in got.collect()] == [1]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("odd`na me.x", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = langid.reject(docs, langid.fit(docs, noise=True))
    assert got.columns == docs.columns and got.count() > 190 and {r["lang_pred"] for r in got.collect()} == {"x"}


def plain_forward(net, window):
    """Probabilities of one window by convolutions written out."""
    pooled = []
    for conv in net.conv:
        width = len(conv)
        at = [sum(conv[j][window[i + j]] for j in range(width)) for i in range(len(window) - width + 1)]
        pooled.append(np.max(at, axis=0))
    z = np.append(np.maximum(np.concatenate(pooled), 0), 1.0) @ net.out
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(3)
    conv = [rng.normal(0, 0.3, (w, 256, langid.FILTERS)).astype("f4") for w in langid.WIDTHS]
    net = langid.Network(["a", "b", "c"], conv, rng.normal(0, 1, (len(langid.WIDTHS) * langid.FILTERS + 1, 3)).astype("f4"))
    x = rng.integers(0, 256, (6, langid.WINDOW), dtype=np.uint8)
    got = net.predict(x, net.tables())
    assert np.allclose(got, [plain_forward(net, w) for w in x], atol=1e-5) and np.allclose(got.sum(axis=1), 1)


def test_training_lowers_the_loss_of_what_it_sees():
    """Gradients point the right way: three alphabets are told apart after a few steps, from a start at chance."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    x = (rng.integers(97, 107, (300, langid.WINDOW)) + 7 * y[:, None]).astype(np.uint8)
    early, late = (langid.train(x, y, ["a", "b", "c"], epochs=e, steps=1, seed=1) for e in (1, 12))
    loss = [-np.log(n.predict(x, n.tables())[np.arange(300), y]).mean() for n in (early, late)]
    assert loss[1] < 0.5 * loss[0] and (late.predict(x, late.tables()).argmax(axis=1) == y).all()


def test_languages_of_ties_repeats_and_long_texts(spark):
    rows = [(i // 2, "der die und das " * 20 if i % 4 < 2 else "the of and to " * 20, "de" if i % 4 < 2 else "en") for i in range(80)]
    df = spark.createDataFrame([(i, t, lang, "s", 1, 7, 7, "x", 0.5) for i, t, lang in rows] + [(None, rows[0][1], "de", "s", 1, 7, 7, "x", 0.5)] * 3, DOCS)
    a, b = (langid.fit(df, sample=20, epochs=2) for _ in range(2))
    assert all(np.array_equal(x, y) for x, y in zip([*a.conv, a.out], [*b.conv, b.out], strict=True))
    long = "the of and to " * 100_000
    got = langid.identify(frame(spark, [long, "the", "der", long], [1, 2, 3, 1]), a).orderBy("doc_id").collect()
    assert len(got) == 4 and got[0]["lang_pred"] == got[1]["lang_pred"] == "en" and got[0]["score"] == got[1]["score"]


def test_windows_cover_whole_texts():
    x, n = langid.cut([b"", b"a" * 256, b"b" * 257])
    assert n.tolist() == [1, 1, 2] and x.shape == (4, 256) and x[3, 0] == ord("b") and x[3, 1] == 0


def brute_licences(text, templates, least=0.8):
    """Every run of words against every template."""
    own, out = licenses.words(text or ""), {}
    wanted = [(name, licenses.bigrams(licenses.words(t))) for name, t in templates]
    for a in range(len(own)):
        for z in range(a + 2, len(own) + 1):
            g = licenses.bigrams(own[a:z])
            for name, h in wanted:
                dice = 2 * len(g & h) / (len(g) + len(h))
                if dice >= least:
                    out[name] = max(out.get(name, 0), dice)
    return out


def test_licences_equal_brute_force(spark):
    rnd = random.Random(1)
    notices = [t for t in licenses.TEMPLATES if len(licenses.words(t[1])) < 45]
    vocabulary = sorted({w for _, t in notices for w in licenses.words(t)})
    texts = [None, "", "\n\n", "it is licensed", "Licensed under the\nApache License, Version 2.0.\nof the and",
             "foo bar. Licensed under the MIT License. four five", "licensed under cc by 4.0\nreleased under the mit license " * 2]
    for _ in range(40):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 8))]
        for _ in range(rnd.randint(0, 2)):
            t = licenses.words(rnd.choice(notices)[1])
            for _ in range(rnd.randint(0, 1 + len(t) // 10)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            w += t + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 6))]
        texts.append(" ".join(w))
    texts.append(texts[-1])
    rows = licenses.scan(frame(spark, texts), templates=notices).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = brute_licences(t, notices)
        assert {m["name"]: round(m["dice"], 9) for m in r["matches"]} == {k: round(v, 9) for k, v in want.items()}
        assert r["n_licenses"] == len(want) and (r["dice"] is None) == (not want)
    assert licenses.scan(frame(spark, [])).count() == 0
    assert licenses.scan(frame(spark, ["a b c"]), templates=[("X", "a b c d")], least=0.7).first()["license"] == "X"


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_licence_passages_of_longer_templates(seed):
    """Skipped starts lose nothing: mutated, doubled and cut copies of a template of 60 words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    template = [("X", " ".join(rnd.choice(vocabulary) for _ in range(60)))]
    own = template[0][1].split()
    w = []
    for _ in range(3):
        part = list(own[rnd.randint(0, 8) : 60 - rnd.randint(0, 8)])
        for _ in range(rnd.randint(0, 6)):
            part[rnd.randrange(len(part))] = rnd.choice(vocabulary)
        w += part + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 20))]
    want = brute_licences(" ".join(w), template)
    assert {n: d for n, d, _, _ in licenses.Scanner(template, 0.8).scan(" ".join(w))} == want


def test_full_licence_texts_are_found_anywhere():
    scanner = licenses.Scanner(licenses.TEMPLATES + licenses.full_texts(), 0.8)
    for name, text in licenses.full_texts():
        got = scanner.scan("word " * 300 + text.replace("\n", " ") + " tail" * 300)
        assert got[0][:2] == (name, 1.0) and got[0][2] == 300
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    assert scanner.scan("word " * 300 + mit + " tail" * 300)[0][:3] == ("MIT", 1.0, 300)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content post-%d"><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>   para<br>graph &eacute;.
<p>Second &lt;tag&gt; one<div class="ad">Buy</div><form><input>Name</form><ul><li>item one<li>item two</ul><!-- x -->
<aside>side</aside></div><div class="sidebar">Links and more links</div></div><section id="comments"><p>%s</p></section><footer>&copy;</footer></body></html>"""


def test_pages_by_consensus(spark):
    long_comment = "what a long comment this is " * 40
    rows = [(i, "http://h.example/%d" % i, PAGE % (i, "short" if i else long_comment)) for i in range(6)]
    rows += [(6, None, None), (7, "", ""), (8, "http://x.example", "plain text only"), (9, "http://h.example/9", "<p>no container"), (6, None, "<nav>n</nav>"), (None, "bad", "<div><p>q")]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "page_id long, url string, html string, host string, text int")
    got = html_extract.main_text(df).collect()
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] != 6}
    for i in range(6):
        assert by[i] == "Head & line First bold para graph é. Second <tag> one item one item two"
    assert by[7] == "" and by[8] == "plain text only" and by[9] == "no container" and by[None] == "q"
    assert [r["text"] for r in got if r["page_id"] == 6] == ["", ""] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_pages_against_a_plain_reading(spark):
    """The tables' pages keep their text in one article element."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        body = re.sub(r"</?(?:h1|p|br|li|ul|div)[^>]*>", " ", re.sub(r"<!--.*?-->", "", body, flags=re.S))
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())


@pytest.mark.parametrize(("page", "want"), [
    ("<body><article><h1>Head</h1><p>Lead.</p><section><p>%s</p></section><section><p>%s</p></section></article><div>c</div></body>", "Head Lead. {0} {0}"),
    ("<body><article><div class=intro><p>Intro here.</p></div><div class=body><p>%s</p><p>%s</p></div></article></body>", "Intro here. {0} {0}"),
    ("<body><div id=page><div class=intro><p>Intro here.</p></div><div class=text><p>%s</p><p>%s</p></div></div><div><a href=/x>one</a> <a href=/y>two</a></div></body>", "Intro here. {0} {0}"),
    ("<body><article><p>%s<table><tr><td>Cell one<td>Cell two</table><blockquote>Quote.</blockquote><p>%s</article></body>", "{0} Cell one Cell two Quote. {0}"),
    ("<body><nav><a>n</a></nav><main><h1>Head</h1><div class=lead>Lead.</div><p>%s</p><p>%s</p></main><footer>f</footer></body>", "Head Lead. {0} {0}"),
])
def test_articles_keep_all_their_parts(page, want):
    words = "many words of the story are told here and there " * 8
    page = page % (words, words)
    assert html_extract.extract(page, {}) == want.format(words.strip())


STORY = "many words of the story are told here and there " * 8
SIDE = "<div class='sidebar'><a href=/a>one</a> <a href=/b>two</a></div>"


@pytest.mark.parametrize(("page", "want"), [
    ("<body><div class='content has-sidebar'><p>{0}</p></div>" + SIDE + "</body>", "{0}"),
    ("<body><main class='with-sidebar'><p>{0}</p></main>" + SIDE + "</body>", "{0}"),
    ("<body><article class='post category-social'><p>{0}</p></article>" + SIDE, "{0}"),
    ("<body><article class='post tag-advertising'><p>{0}</p></article><p>Outside.</p>", "{0}"),
    ("<body><form id=aspnet><input type=hidden name=v><div class=content><p>{0}</p></div></form></body>", "{0}"),
    ("<body><article><p>{0}</p><section class='related-work'><p>{0}</p></section></article></body>", "{0} {0}"),
    ("<body><article><p>{0}</p><section class='related-posts'><p>Others.</p></section></article></body>", "{0}"),
    ("<body><article><p>{0}</p><div class='share-buttons'>Share it</div><div class='ad-slot'>Buy</div></article></body>", "{0}"),
    ("<body><article><a href=/whole><p>{0}</p></a></article><div><p>A small block.</p></div></body>", "{0}"),
    ("<body class='menu'><div class='promo'><p>{0}</p></div></body>", "{0}"),
    ("<body><div class='newsletter'><div class='widget'><p>{0}</p></div></div><nav>n</nav></body>", "{0}"),
    ("<body><article><form><label>Name</label><input><select><option>a</select><button>Go</button></form><p>{0}</p></article></body>", "{0}"),
    ("<body><div class='entry no-comments'><p>{0}</p></div><div class='comments'><p>Said a reader.</p></div></body>", "{0}"),
    ("<body><article><p>{0}</p></article><section class=comments><article class=comment><p>" + "said a reader " * 60 + "</p></article></section></body>", "{0}"),
    ("<body><div role=banner><p>{0}</p></div><article role=main><h1>Head</h1><p>{0}</p></article></body>", "Head {0}"),
    ("<body><div id='cookie-consent'><p>{0} {0}</p></div><div id=story><p>{0}</p></div></body>", "{0}"),
    ("<body><div class='is-widget story'><p>{0}</p></div></body>", "{0}"),
    ("<body><td><article hidden><p>Not shown.</p></article><article><p>{0}</p></article></td></body>", "{0}"),
    ("<body><div class='menu-item-list'><p>{0}</p></div><div class='post-body'><p>{0} Here.</p></div></body>", "{0} Here."),
    ("<body><nav><p>{0}</p></nav></body>", ""),
    ("<body><main>" + "<p>{0}</p>" * 400 + "</main></body>", " ".join(["{0}"] * 400)),
])
def test_twenty_ordinary_layouts(page, want):
    assert html_extract.extract(page.replace("{0}", STORY), {}) == want.replace("{0}", STORY.strip())


def test_pages_follow_their_hosts_votes(spark):
    """Brute force over the votes: 30 layouts on one host, none of them cut off, and a page whose text lies elsewhere."""
    rows = []
    for layout in range(30):
        for j in range(3):
            body = f"<div class='box{chr(97 + layout % 26)}{layout // 26}'><p>Story {layout} {j} is told in these words.</p></div>"
            noise = "<div class='extras'><p>%s</p></div>" % ("what readers said about it " * (4 if j == 2 else 1))
            rows.append((layout * 10 + j, f"http://h.example/{layout}/{j}", f"<body><div>{body}<div><a>x</a></div></div><hr>{noise}</body>"))
    rows += [(900 + j, f"http://h.example/o/{j}", "<body><div class=lone%s><p>%s</p></div><div class=extras><p>said</p></div></body>" % ("xyz"[j], "Another tale altogether is here. " * 4)) for j in range(3)]
    host = {}
    for _, _, page in rows:
        for p, n in html_extract.votes(page).items():
            got = host.setdefault(p, [0, 0])
            host[p] = [got[0] + n, got[1] + 1]
    host = {p: n for p, (n, pages) in host.items() if pages > 1}
    assert len(host) > 5
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    assert got == {i: html_extract.extract(page, host) for i, _, page in rows}
    assert all(got[900 + j].startswith("Another tale") for j in range(3))
