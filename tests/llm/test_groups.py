"""Mixing, near-duplicates, repeats, embeddings and the pipeline against brute force and odd input."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import _common, mixing, nn_descent, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, _id long, size int, batch string"


def frame(spark, rows):
    """rows: (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 7, 8, 9, "x") for r in rows], DOCS)


def closure(nodes, linked):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    pairs += [(7, 7), (None, 3), pairs[0]]
    got = {r["node"]: r["root"] for r in _common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = closure({x for p in real for x in p}, real)
    assert got == want
    assert _common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def water(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(limit * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if w[s] * level >= limit * sizes[s]}
        if not new:
            return {s: limit * sizes[s] if s in full else w[s] * level for s in names}
        full |= new


def test_mixing_reaches_targets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rnd.lognormvariate(4, 1))), rnd.choice(["a", "b", "b", "b", "Z", "é", None])) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \n", "empty"), (5, rows[5][1], rows[5][2])]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = water(dict(sizes)), defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and 0 <= r["rate"] <= 2
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(8, 0.01 * t)
    again = {(r["id"], r["source"], r["size"]): r["copies"] for r in mixing.mix(frame(spark, rows)).collect()}
    assert all(again[r["id"], r["source"], r["size"]] == r["copies"] for r in got)


def test_mixing_rates_solve_the_dual(spark):
    """Rates are the exponential tilt of one multiplier a source and meet the token constraint before rounding."""
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 300)), "abc"[i % 3]) for i in range(600)]
    by = defaultdict(list)
    for r in mixing.mix(frame(spark, rows)).collect():
        by[r["source"]].append((r["size"], r["rate"], r["target"]))
    for own in by.values():
        n, rate, target = map(np.array, zip(*own, strict=True))
        assert abs((n * rate).sum() - target[0]) < 1e-4 * target[0]
        if rate.max() < 2:
            lam = np.log(rate / (2 - rate)) / n
            assert np.allclose(lam, lam[0], rtol=1e-6, atol=1e-9)


def test_mixing_keeps_columns_and_repeats(spark):
    df = frame(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e", None), (3, None, "s")])
    got = mixing.repeat_rows(df)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} <= {1, 2}
    assert mixing.repeat_rows(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def slow_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\x0b\x0c\r":
        w = w.replace(s, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_groups(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    for j, t in enumerate(base * 6):  # many near copies
        w = t.split()
        w[rnd.randrange(len(w))] = "other"
        rows.append((100 + j, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B"), (505, "É"), (3, base[3]), (None, base[4])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    want = [(i, slow_fingerprint(t)) for i, t in rows]
    assert sorted((i or -1, f) for i, f in want) == sorted((r["doc_id"] or -1, int(r["fingerprint"], 16)) for r in got)
    nodes = {f for _, f in want}
    root = closure(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in want:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    for i, f in want:
        assert fps[i, f"{f:016x}"] == least[root[f]]
    assert simhash.near_duplicates(frame(spark, []), words=5).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    from itertools import combinations

    masks = simhash.covering_masks(list(range(20)), radius)
    for flips in combinations(range(20), radius):
        diff = sum(1 << b for b in flips)
        assert any(m & diff == 0 and m for m in masks)


def test_links_of_dense_fingerprints(spark):
    """Buckets beyond the limit are split without losing a component."""
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = set(base)
    for b in base:
        for _ in range(400):
            x = b
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [simhash._signed(x) for x in fps]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 64 for a, b in edges)
    arr = np.array(sorted(fps), "u8")
    near = np.bitwise_count(arr[:, None] ^ arr[None]) <= 2
    real = [(simhash._signed(int(arr[i])), simhash._signed(int(arr[j]))) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    assert closure(signed, edges) == closure(signed, real)


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_near_duplicates_are_dropped_by_similarity(spark):
    rnd = random.Random(6)
    docs = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(150)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(docs)]
    for i, t in enumerate(docs[:30]):
        w = t.split()
        for _ in range(1 + i % 2):
            w[rnd.randrange(150)] = "new"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, docs[50]), (201, docs[50]), (51, docs[51]), (None, docs[52]), (300, None), (301, "")]
    df = frame(spark, rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    text = {i: t for i, t in rows if i is not None}
    for i in set(text) - set(ids):
        assert any(j < i and len(shingles(text[i]) & shingles(text[j])) >= 0.8 * len(shingles(text[i]) | shingles(text[j])) for j in ids)
    assert set(range(60)) <= set(ids) and len(ids) == len(set(ids)) and not {200, 201, 301} & set(ids)
    assert ids == smallest_of_groups([(i, t) for i, t in text.items() if t is not None and i != 301] + [(300, "")])
    other = frame(spark, [(1, "b c", "x"), (1, "a c", "y"), (1, None, "z"), (2, "b c", "x")])
    assert [(r["doc_id"], r["source"]) for r in simhash.drop_near_duplicates(other).orderBy("doc_id").collect()] == [(1, "y"), (2, "x")]
    assert kept.filter("doc_id is null").count() == 1
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def smallest_of_groups(rows, least=0.8):
    """Smallest id of every group that pairs of similar shingle sets connect."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    near = [(i, j) for k, j in enumerate(ids) for i in ids[:k] if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return sorted(set(closure(ids, near).values()))


def test_every_leader_of_a_group_drops_its_copies(spark):
    """Texts of the same words in other orders are unlike each other; each has copies, however many there are."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.sample(words, 60)) for _ in range(20)]
    rows = list(enumerate(base)) + [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, f"{t} end") for i, t in enumerate(base)]
    assert smallest_of_groups(rows) == list(range(20))
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == list(range(20))


def test_many_groups_share_their_rare_shingles(spark):
    """Twelve groups of near copies whose texts all hold one passage: buckets stay open until every pair of groups was compared."""
    rnd = random.Random(13)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(12):
        own = passage + [f"g{g}x{i}" for i in range(60)]
        for j in range(5):
            w = list(own)
            w[rnd.randrange(100)] = f"e{g}{j}"
            rows.append((rnd.randrange(10**6), " ".join(w)))
    want = smallest_of_groups(rows)
    assert len(want) == 12
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == want


def test_near_duplicates_equal_brute_force(spark):
    """Edits, appended passages, cuts, repeats and chains of texts from far below to far above the similarity."""
    rnd = random.Random(12)
    docs = [[f"w{rnd.randint(0, 4000)}" for _ in range(rnd.choice([12, 60, 150, 400]))] for _ in range(50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    for i, w in enumerate(docs):
        for j, share in enumerate([0.05, 0.12, 0.18, 0.22, 0.25, 0.3]):
            n = max(1, int(len(w) * share))
            rows.append((1000 + 10 * i + j, " ".join(w + [f"n{rnd.randint(0, 9999)}" for _ in range(n)])))
            rows.append((2000 + 10 * i + j, " ".join(w[: len(w) - n])))
            v = list(w)
            for _ in range(max(1, int(n / 7))):
                v[rnd.randrange(len(v))] = f"e{rnd.randint(0, 9999)}"
            rows.append((3000 + 10 * i + j, " ".join(v)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(5000 + rnd.randint(0, 10**6), " ".join(chain[i : i + 100])) for i in range(0, 300, 3)]
    want = smallest_of_groups(rows)
    sets = [shingles(t) for _, t in rows]
    shared = (len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert sum(0.8 <= x <= 0.9 for x in shared) > 300
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == want


def test_simhash_links_take_part_in_near_dedup(spark, monkeypatch):
    """Without the exact pass the covering masks alone still drop copies that differ in a word of many."""
    monkeypatch.setattr(simhash, "links_by_shingles", lambda left, edges, verify, *_: verify.keep(_common.components(edges, "id", "m")))
    rnd = random.Random(14)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    rows = [(i, " ".join(base[:i] + [f"e{i}"] + base[i:])) for i in range(20)] + [(100, " ".join(f"o{i}" for i in range(50)))]
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert 100 in got and len(got) < 12


def slow_repeats(rows, k):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1 if i is not None else 0):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        own, keep = -(1 << 63) if i is None else i, [True] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < own:
                keep[j : j + k] = [False] * k
        left = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "k", "vocab"), [(0, 3, 3), (1, 4, 4), (2, 13, 50), (3, 2, 4)])
def test_repeats_equal_brute_force(spark, seed, k, vocab):
    """Small vocabularies make every kind of branch, loop and overlap."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(80):
        w = [f"v{rnd.randrange(vocab)}" if vocab < 10 else f"v{rnd.randrange(5000)}" for _ in range(rnd.randint(0, 25))]
        if i % 3 == 0:
            a = rnd.randrange(20)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + 20]
        rows.append((rnd.randrange(60), " ".join(w)))
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, rows[0][1]), (None, rows[3][1]), (94, "tab\tnew\nline kept")]
    got = sorted((tuple(r) for r in substring.remove_repeats(frame(spark, rows), k=k, texts=False).collect()), key=str)
    assert got == slow_repeats(rows, k)


@pytest.mark.parametrize("texts", [["", None, " \n"], ["a b", "a b", "c"], ["x" * 300_000, None], [None, "w " * 100, "w " * 100]])
def test_repeats_in_batches_without_long_texts(spark, texts):
    """More batches than documents: most hold nothing, or no text of k - 1 words."""
    rows = list(enumerate(texts))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = sorted((tuple(r) for r in substring.remove_repeats(frame(spark, rows), texts=False).collect()), key=str)
        kept = {r["doc_id"]: r["text"] for r in substring.drop_repeats(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == slow_repeats(rows, 13)
    assert all(kept[i] == t for i, t in rows if i in kept) and len(kept) >= len(rows) - 1


def test_repeats_leave_texts(spark):
    own = " ".join(f"x{i}" for i in range(60))
    df = frame(spark, [(1, own), (2, f"  before\n{own}\nafter  that"), (3, "nothing  here "), (4, own), (5, None), (None, own)])
    got = {r["doc_id"]: r for r in substring.drop_repeats(df).collect()}
    assert df.columns == substring.drop_repeats(df).columns
    assert got[2]["text"] == "  before\nafter  that" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[3]["text"] == "nothing  here " and got[3]["n_chars"] == 1 and got[1]["text"] == own and 4 not in got
    assert got[5]["text"] is None and got[None]["text"] == own
    assert substring.drop_repeats(df.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, near = [], rng.normal(size=(6, 16))
    for i in range(150):
        rows.append((i, rng.normal(size=16).tolist(), int(i % 2), "a", 1))
    for i in range(200):
        rows.append((1000 + i, (near[i % 6] + rng.normal(size=16) * 0.15).tolist(), int(i % 6 % 2), "a", 1))
    rows += [(2000 + i, rows[160][1], rows[160][2], "a", 1) for i in range(5)] + [rows[10], rows[10]]
    rows += [(3000, None, 0, "a", 1), (3001, [0.0] * 16, 0, "a", 1), (3002, [float("nan")] + [1.0] * 15, 0, "a", 1), (3003, rows[160][1], None, "a", 1),
             (3004, [], 0, "a", 1), (3005, [None] + [1.0] * 15, 0, "a", 1), (3006, [1.0, 2.0], 0, "a", 1), (None, rows[160][1], rows[160][2], "a", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, copies int")
    got = sorted((tuple(r) for r in nn_descent.near_duplicates(df).collect()), key=str)

    def usable(r):
        return r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    live = [(i, np.array(r[1]) / np.linalg.norm(r[1]), r[2]) for i, r in enumerate(rows) if usable(r)]
    n, linked = defaultdict(int), []
    for a, x, la in live:
        for b, y, lb in live:
            if a < b and la == lb and len(x) == len(y) and x @ y >= 0.93:
                n[a] += 1
                n[b] += 1
                linked.append((rows[a][0], rows[b][0]))
    root = closure({r[0] for r in rows if r[0] is not None}, linked)
    want = sorted(((r[0], n[i], root.get(r[0]), True if r[0] is None else root[r[0]] == r[0]) for i, r in enumerate(rows)), key=str)
    assert got == want
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_embedding_components_beyond_a_block(spark, monkeypatch):
    """Cells of a few vectors each give the same counts."""
    monkeypatch.setattr(nn_descent, "BLOCK", 7)
    rng = np.random.default_rng(2)
    turn = np.linspace(0, 2.5, 120)  # a chain: neighbours link, ends don't
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 1) for i, a in enumerate(turn)]
    rows += [(500 + i, (np.array([1.0, 1.0, 1.0]) + rng.normal(size=3) * 0.01).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows[:120]])
    n = (x @ x.T >= 0.93).sum(1) - 1
    assert [got[i] for i in range(120)] == [(int(k), 0) for k in n]
    assert {got[500 + i] for i in range(60)} == {(59, 500)}


def test_dense_clusters_with_one_bridge_are_one_component(spark):
    """All vectors have more links than a list holds; one pair in 3600 links the two clusters of a label."""
    rng, size, rows = np.random.default_rng(3), 80, []
    tilt, apart = np.radians(10), np.radians(21)
    for label in range(10):
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for k, centre in enumerate([q[0], np.cos(apart) * q[0] + np.sin(apart) * q[1]]):
            for i in range(60):
                side = q[2] if i == 0 else rng.normal(size=size - 3) @ q[3:]
                side = side / np.linalg.norm(side)
                rows.append((label * 1000 + k * 100 + i, (np.cos(tilt) * centre + np.sin(tilt) * side).tolist(), label))
    x = np.array([r[1] for r in rows]).reshape(10, 120, size)
    near = np.einsum("lid,ljd->lij", x, x) >= 0.93
    assert near[:, :60, 60:].sum() == 10 and (near.sum(2) > 17).all()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()}
    assert got == {i: (int(n) - 1, label * 1000) for (i, _, label), n in zip(rows, near.sum(2).ravel(), strict=True)}


def test_recall_below_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "SETS", 1)
    monkeypatch.setattr(nn_descent, "audit", lambda *_: (0.5, 9))
    df = spark.createDataFrame([(i, [1.0, i / 100], 1) for i in range(5)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError):
        nn_descent.near_duplicates(df)


def test_of_different_texts_under_one_id_the_smallest_stays(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "cab"]
    rows = [(5, texts[0]), (5, texts[1]), (5, None), (6, texts[2]), (7, texts[2] + " more")]
    got = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, texts[1]), (6, texts[2])]


def test_audit_needs_evidence(spark):
    """Without a link there is no figure; with components torn apart it is the share of links that stay inside."""
    nodes = spark.createDataFrame([(i, "a", np.eye(40)[i].tobytes()) for i in range(20)], "id long, label string, vec binary")
    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")
    found, links = nn_descent.audit(nodes, *none, 0.93)
    assert np.isnan(found) and links == 0
    pairs = nodes.unionByName(nodes.selectExpr("id + 100 as id", "label", "vec"))
    edges = spark.createDataFrame([(i, i + 100) for i in range(20)], "a long, b long")
    roots = spark.createDataFrame([(i + d, i) for i in range(15) for d in (0, 100)], "node long, root long")
    found, links = nn_descent.audit(pairs, edges, roots, 0.93)
    assert links == 40 and found == 0.75


def test_pipeline_stages(spark):
    rnd = random.Random(8)
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    passage = " ".join(f"the{rnd.randrange(9999)}" for _ in range(60))
    docs = real + [(9000, "123 !!!", "en", "src0", 7), (9001, real[5][1], "en", "src0", 9), (9002, f"{real[6][1][:300]} {passage}", "en", "src1", 0), (9003, f"{passage} {real[9][1][:300]}", "en", "src1", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    one = stages[names[0]](spark, df, None)
    assert one.columns == df.columns and {r[0] for r in docs} - {r["doc_id"] for r in one.collect()} == {9000}
    two = stages[names[1]](spark, df, None)
    gone = {r[0] for r in docs} - {r["doc_id"] for r in two.collect()}
    text = {r[0]: r[1] for r in docs}
    assert 9001 in gone
    for i in gone:
        assert any(j < i and len(shingles(text[i]) & shingles(text[j])) >= 0.8 * len(shingles(text[i]) | shingles(text[j])) for j in text)
    three = {r["doc_id"]: r for r in stages[names[2]](spark, df, None).collect()}
    assert passage in three[9002]["text"] and passage not in three[9003]["text"] and three[9003]["n_chars"] == len(three[9003]["text"])
    four = stages[names[3]](spark, df, None)
    assert four.columns == df.columns and four.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    five = stages[names[4]](spark, df, None)
    assert five.count() == len(docs)
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in five.collect())


def test_core_of_a_dense_group_is_counted_not_compared(spark, monkeypatch):
    """A tight group with a looser rim: all pairs of its core are known to link."""
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    x = np.array([centre / np.linalg.norm(centre) + rng.normal(size=24) * (0.02 if i < 150 else 0.055) for i in range(220)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    assert not near.all() and near[:150, :150].all()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()}
    root = closure(range(220), [(i, j) for i in range(220) for j in range(i) if near[i, j]])
    assert got == {i: (int(near[i].sum()) - 1, root[i]) for i in range(220)}


def test_a_cosine_at_the_threshold_links(spark):
    """0.6 in exact arithmetic, whichever way the sums are rounded."""
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [0.6, 0.8, 0.0], 1), (3, [3.0, 0.0, 4.0], 1), (4, [0.3, 0.4, 5.0], 2), (5, [0.1 * 3, 0.4, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_duplicates(df, threshold=0.6).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 0, 5: 2}


def test_links_between_sparse_pairs_are_found(spark):
    """Borderline pairs that no cluster helps to find: recall of what is returned against brute force."""
    rng = np.random.default_rng(7)
    rows, turn = [], np.arccos(0.94)
    for i in range(400):
        a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 32)))
        b = b - (a @ b) * a
        rows += [(2 * i, a.tolist(), i % 2), (2 * i + 1, (np.cos(turn) * a + np.sin(turn) * b / np.linalg.norm(b)).tolist(), i % 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_duplicates(df).collect()}
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None])).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want.tolist()))


def test_parities_bound_differences_from_below():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000))).astype("u8"))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 1 << 63, int(rng.integers(1, 500))).astype("u8")]))
        least = simhash.fewest_differences(simhash.parities(a), simhash.parities(b))
        assert least <= len(np.setxor1d(a, b))
    assert simhash.fewest_differences(simhash.parities(a), simhash.parities(a)) == 0


def test_pipeline_runs_from_documents_to_ids(spark, tmp_path):
    """All stages one after another on odd rows and on an empty table; each later row follows from the stages' own results."""
    rnd = random.Random(21)
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    long = " ".join(f"word{rnd.randrange(40_000)}" for _ in range(40_000))
    odd = [(9000, None, "en", "src0", 0), (9001, real[5][1], "en", "src0", 9), (9002, "", None, None, 0), (9003, "12 !!", "en", "src1", 5), (9004, long, "en", "src1", 1), (None, real[7][1], "en", "src2", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(real + odd, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert not ids & {9000, 9001, 9002, 9003} and None in ids and ids <= {r[0] for r in real + odd}
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_limits_that_are_reached_are_errors(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        _common.components(chain, "a", "b", rounds=1)
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix(frame(spark, [(i, "w " * (i % 50), "ab"[i % 2]) for i in range(200)]))
