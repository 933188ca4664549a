"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from neighbours in sorted random-projection keys and is refined by joins of neighbours of
neighbours. Only pairs of cosine ``2 t^2 - 1`` or more are kept on the way: two vectors that both link to a third at the
threshold ``t`` can't be further apart, so weaker pairs lead to no link. Lists hold K entries; a vector whose list is full
of links is saturated, and its list is enlarged to its whole component by an exact blocked comparison inside components.
So that saturated vectors of two components can still be joined, every vector then gets a second list, of the K best that
are in other components, and vectors of two dense components that have edges between them are compared exactly. Links found
are those whose ends are in one component; their recall is audited on a sample of vectors against all others. While it is below
target, more keys are added, and if that doesn't help there is an error.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm._common import components, durable, partitions_for, read, small

_LOG = logging.getLogger(__name__)
K = 16
BLOCK = 512
#: Sets of keys after which a recall below target is an error.
SETS = 16
#: Components up to which their mean vectors and cells are broadcast: tens of megabytes.
PIVOTS = 20_000


def unit_vectors(vecs: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label (null: links with nothing), vec: float64 bytes of length one, null if the vector can't link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["vec"]:
                x = np.array([np.nan if e is None else e for e in v], "f8") if v is not None else np.zeros(0)
                ok = len(x) and np.isfinite(x).all()
                top = np.abs(x).max() if ok else 0.0
                out.append(((x / top) / np.sqrt(((x / top) ** 2).sum())).tobytes() if top > 0 else None)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "label": b["label"], "vec": out})

    own = vecs.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec")
    )
    return own.mapInPandas(run, "id long, label string, vec binary")


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), "f8").reshape(len(col), -1)


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches; a run may span batches."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        for k in key:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, z in zip(starts, starts[1:]):
            yield b.iloc[a:z]
        rest = b.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def sorted_keys(nodes: DataFrame, tables: range, bits: int, floor: float, reach: int = 4) -> DataFrame:
    """First edges: each vector against the next few in the order of its (dimension, label, sign bits, projection).

    Rows are dealt by ranges of that order, so one dense key spreads over many tasks. Returns a < b, sim.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = {}
        for b in batches:
            size = b["vec"].map(len).to_numpy()
            for n in np.unique(size):
                own = b[size == n]
                x = _matrix(own["vec"])
                for t in tables:
                    if (t, n) not in planes:
                        planes[t, n] = np.random.default_rng([t, int(n)]).normal(size=(x.shape[1], bits + 1))
                    p = x @ planes[t, n]
                    sign = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype="i8"))
                    yield pd.DataFrame({"t": t, "n": n, "label": own["label"], "sign": sign, "p": p[:, bits],
                                        "id": own["id"], "vec": own["vec"]})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for b in batches:
            if tail is not None:
                b = pd.concat([tail, b], ignore_index=True)
            ids, out = b["id"].to_numpy("i8"), []
            lab, size = b["label"].to_numpy(), b["n"].to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = _matrix(b["vec"].iloc[at])
                for s in range(1, reach + 1):
                    i, j = np.arange(len(at) - s), np.arange(s, len(at))
                    same = lab[at[i]] == lab[at[j]]
                    i, j = i[same], j[same]
                    sim = np.einsum("ij,ij->i", x[i], x[j])
                    ok = sim >= floor
                    a, z = ids[at[i[ok]]], ids[at[j[ok]]]
                    out.append(pd.DataFrame({"a": np.minimum(a, z), "b": np.maximum(a, z), "sim": sim[ok]}))
            tail = b.iloc[-reach:]
            yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "sim": []})

    order = ["t", "n", "label", "sign", "p", "id"]
    # the keys are written first: dealing by range reads its input twice
    keyed = durable(
        nodes.mapInPandas(keys, "t int, n int, label string, sign long, p double, id long, vec binary"), "nnd"
    )
    dealt = keyed.repartitionByRange(partitions_for(nodes), *order).sortWithinPartitions(*order)
    return dealt.mapInPandas(near, "a long, b long, sim double").filter("a <> b")


def refine(edges: DataFrame, nodes: DataFrame, threshold: float, floor: float, roots: DataFrame | None = None) -> DataFrame:
    """Candidates from one join of neighbours of neighbours: a < b, sim, at or above the floor.

    Every vector gathers the K best of its neighbours in both directions. Pairs among them are scored where one of the
    two edges is new and one end isn't saturated yet. With ``roots`` a vector also gathers the K best of other components
    than its own, and saturated ends are scored where they are in two components.
    """
    both = edges.select(F.col("a").alias("w"), F.col("b").alias("u"), "sim", "new").unionByName(
        edges.select(F.col("b").alias("w"), F.col("a").alias("u"), "sim", "new")
    )
    links = both.groupBy("w").agg(F.count(F.when(F.col("sim") >= threshold, 1)).alias("links"))
    both = both.withColumn("far", F.lit(False)).withColumn("root", F.lit(0).cast("long"))
    if roots is not None:
        own, other = roots.toDF("w", "root_w"), roots.toDF("u", "root_u")
        both = both.join(own, "w", "left").join(other, "u", "left").withColumn("root", F.coalesce("root_u", "u"))
        both = both.withColumn("far", F.col("root") != F.coalesce("root_w", "w"))
    best = W.partitionBy("w", "far").orderBy(F.desc("sim"), "u")
    lists = both.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= K).select("w", "u", "new", "root")
    full = links.select(F.col("w").alias("u"), (F.col("links") >= K).alias("full"))
    lists = lists.join(full, "u").join(nodes.select(F.col("id").alias("u"), "vec"), "u")
    lists = lists.repartition(partitions_for(edges), "w").sortWithinPartitions("w", "u")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _groups(batches, ["w"]):
            new, full = g["new"].to_numpy(bool), g["full"].to_numpy(bool)
            root = g["root"].to_numpy("i8")
            apart = root[:, None] != root[None, :]
            if len(g) < 2 or not new.any() or full.all() and not apart.any():
                continue
            x, ids = _matrix(g["vec"]), g["u"].to_numpy("i8")
            s = x @ x.T
            i, j = np.nonzero(np.triu((s >= floor) & (new[:, None] | new[None, :]) & (apart | ~(full[:, None] & full[None, :])), 1))
            out.append(np.column_stack([ids[i], ids[j], s[i, j].view("i8")]))
            if sum(map(len, out)) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return lists.mapInPandas(pairs, "a long, b long, sim double")


def bridges(edges: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Links between two components of more than K vectors each: a < b, sim.

    Of two such components all vectors with an edge into the other one are compared exactly, in cells of about BLOCK.
    """
    dense = roots.groupBy("root").agg(F.count("*").alias("k")).filter(F.col("k") > K).select("root")
    known = durable(roots.join(dense, "root").select("node", "root"), "nnd")
    both = edges.join(known.toDF("a", "ra"), "a").join(known.toDF("b", "rb"), "b").filter("ra <> rb")
    r = [F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2")]
    ends = both.select(F.col("a").alias("id"), *r, (F.col("ra") < F.col("rb")).alias("left")).unionByName(
        both.select(F.col("b").alias("id"), *r, (F.col("rb") < F.col("ra")).alias("left"))
    )
    ends = durable(ends.distinct(), "nnd")
    parts = [F.ceil(F.count(F.when(F.col("left") == side, 1)) / BLOCK).cast("int").alias(n) for side, n in ((True, "n1"), (False, "n2"))]
    placed = ends.join(ends.groupBy("r1", "r2").agg(*parts), ["r1", "r2"])
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("left"), F.col("n1")).otherwise(F.col("n2"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("left"), F.col("n2")).otherwise(F.col("n1")) - 1)
    sent = placed.select("r1", "r2", "left", "id", mine.alias("mine"), F.explode(meets).alias("its"))
    p1, p2 = F.when(F.col("left"), F.col("mine")).otherwise(F.col("its")), F.when(F.col("left"), F.col("its")).otherwise(F.col("mine"))
    sent = sent.select("r1", "r2", p1.alias("p1"), p2.alias("p2"), "left", "id").join(nodes.select("id", "vec"), "id")
    key = ["r1", "r2", "p1", "p2"]
    sent = sent.repartition(partitions_for(nodes), *key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, key):
            left = g["left"].to_numpy(bool)
            if left.all() or not left.any():
                continue
            x, ids = _matrix(g["vec"]), g["id"].to_numpy("i8")
            s = x[left] @ x[~left].T
            i, j = np.nonzero(s >= threshold)
            yield _pairs([np.column_stack([ids[left][i], ids[~left][j], s[i, j].view("i8")])])

    return sent.mapInPandas(compare, "a long, b long, sim double")


def _pairs(parts: list[np.ndarray]) -> pd.DataFrame:
    x = np.concatenate(parts) if parts else np.zeros((0, 3), "i8")
    return pd.DataFrame({"a": np.minimum(x[:, 0], x[:, 1]), "b": np.maximum(x[:, 0], x[:, 1]),
                         "sim": np.ascontiguousarray(x[:, 2]).view("f8")})


def audit(nodes: DataFrame, edges: DataFrame, roots: DataFrame, threshold: float, sample: int = 2048,
          links: int = 200, most: int = 16_384) -> tuple[float, int]:
    """Share of the sampled vectors' true links whose ends are in one component, and the number of those links.

    About ``sample`` of all vectors and as many of those that have an edge, chosen by a hash of their id, are compared with all
    vectors in blocks. While they have fewer than ``links`` true links, the sample grows fourfold, up to ``most`` or all. Without
    any true link there is no evidence: nan.
    """
    near = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("near", F.lit(True))
    known = durable(nodes.select("id", "label", "vec").join(near, "id", "left"), "nnd")
    n, some = known.agg(F.count("*"), F.count("near")).first()
    while True:
        draw = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) / float(1 << 30)
        rows = known.filter(draw < F.when(F.col("near"), sample / max(some, 1)).otherwise(sample / max(n, 1))).collect()
        hit, true = _audited(nodes, roots, threshold, rows)
        if true >= links or sample >= min(n, most):
            return hit / true if true else math.nan, true
        sample *= 4


def _audited(nodes: DataFrame, roots: DataFrame, threshold: float, rows: list) -> tuple[int, int]:
    """Links of the given vectors found in components, and all of them."""
    by = {}
    for r in rows:
        by.setdefault((r["label"], len(r["vec"])), []).append((r["id"], bytes(r["vec"])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["vec"].map(len).to_numpy()
            for (label, n), own in by.items():
                part = b[(b["label"] == label).to_numpy() & (size == n)]
                if not len(part):
                    continue
                its, ids = _matrix(part["vec"]), part["id"].to_numpy("i8")
                for k in range(0, len(own), 2048):
                    i, j = np.nonzero(_matrix([v for _, v in own[k : k + 2048]]) @ its.T >= threshold)
                    q, v = np.array([x for x, _ in own[k : k + 2048]], "i8")[i], ids[j]
                    yield pd.DataFrame({"q": q[q != v], "v": v[q != v]})

    true = nodes.mapInPandas(score, "q long, v long")
    a = roots.select(F.col("node").alias("q"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("v"), F.col("root").alias("rb"))
    got = true.join(a, "q", "left").join(b, "v", "left")
    all_, hit = got.agg(F.count("*"), F.count(F.when(F.col("ra") == F.col("rb"), 1))).first()
    return hit, all_


def count_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Exact numbers of links inside components: id, n (weighted by copies, its own others included).

    Members are dealt into rings by their angle to the component's mean direction. Those within half the threshold's angle all
    link to each other, so this core is counted and not compared, which is what makes a large group of near copies cheap.
    Cells of about BLOCK members of two rings meet only if the rings' angles lie within the threshold's of each other. A
    component of any size spreads over its pairs of cells.
    """
    angle = math.acos(max(-1.0, min(1.0, threshold))) or 1e-9
    member = roots.join(nodes, F.col("node") == F.col("id")).select("root", "id", "copies", "vec")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = {r: _matrix(g).sum(axis=0).tobytes() for r, g in b.groupby("root")["vec"]}
            yield pd.DataFrame({"root": list(own), "part": list(own.values())}, columns=["root", "part"])

    def mean(g: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(g["part"]).sum(axis=0)
        size = np.sqrt((x * x).sum())
        x = x / size if size > 1e-9 else np.eye(1, len(x))[0]
        return pd.DataFrame({"root": [g["root"].iloc[0]], "pivot": [x.tobytes()]})

    # a row a component and batch of vectors
    parts = member.select("root", "vec").mapInPandas(sums, "root long, part binary")
    pivots = durable(parts.groupBy("root").applyInPandas(mean, "root long, pivot binary"), "nnd")
    member = member.join(small(pivots, PIVOTS), "root")

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dots = np.array([np.frombuffer(v, "f8") @ np.frombuffer(p, "f8") for v, p in zip(b["vec"], b["pivot"])])
            turn = np.arccos(np.clip(dots, -1, 1)) if len(b) else np.zeros(0)
            # a hair narrower than the threshold's angle would be wrong, a hair wider is safe; the core is a hair smaller
            ring = np.floor(turn / (angle * (1 + 1e-9))).astype("i4")
            yield b.drop(columns="pivot").assign(ring=np.where(turn < angle / 2 - 1e-6, -1, ring).astype("i4"))

    member = durable(member.mapInPandas(rings, "root long, id long, copies long, vec binary, ring int"), "nnd")
    core = member.filter("ring = -1").groupBy("root").agg(F.sum("copies").alias("core"))
    inner = member.filter("ring = -1").join(core, "root").select("id", (F.col("core") - F.col("copies")).alias("n"))
    cells = member.groupBy("root", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cells = cells.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("ring", "parts"))).alias("cells"))  # few rings
    cells = small(durable(cells, "nnd"), PIVOTS)
    ring, part = F.col("ring"), F.col("part")
    placed = member.join(cells, "root").withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(F.col("cells"), ring)).cast("int"))

    def pair(r1, p1, r2, p2):
        return F.struct(r1.alias("r1"), p1.alias("p1"), r2.alias("r2"), p2.alias("p2"))

    # a member goes to each pair its cell is in: with its own ring, the next and the one before; the core is ring -1, meets the
    # rings 0 and 1, and not itself
    near = F.when(ring == -1, F.array(F.lit(0), F.lit(1))).when(ring <= 1, F.array(ring, ring + 1, ring - 1, F.lit(-1))).otherwise(
        F.array(ring, ring + 1, ring - 1)
    )
    near = F.filter(F.array_distinct(near), lambda q: F.map_contains_key(F.col("cells"), q))
    meets = F.flatten(F.transform(near, lambda q: F.transform(
        F.sequence(F.lit(0), F.element_at(F.col("cells"), q) - 1),
        lambda k: F.when(q == ring, pair(ring, F.least(part, k), ring, F.greatest(part, k))).when(q > ring, pair(ring, part, q, k)).otherwise(pair(q, k, ring, part)),
    )))
    sent = placed.select("root", "id", "copies", "vec", F.struct(ring.alias("r1"), part.alias("p1")).alias("cell"), F.explode(meets).alias("m"))
    key = ["root", "r1", "p1", "r2", "p2"]
    sent = sent.select("root", "m.*", "id", "copies", "vec",
                       ((F.col("cell.r1") == F.col("m.r1")) & (F.col("cell.p1") == F.col("m.p1"))).alias("left"))
    sent = sent.repartition(partitions_for(nodes), *key).sortWithinPartitions(*key)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, key):
            x, n, left = _matrix(g["vec"]), g["copies"].to_numpy("i8"), g["left"].to_numpy(bool)
            ids = g["id"].to_numpy("i8")
            if left.all():  # a cell with itself
                s = x @ x.T >= threshold
                np.fill_diagonal(s, False)
                yield pd.DataFrame({"id": ids, "n": s @ n})
            elif left.any():
                s = x[left] @ x[~left].T >= threshold
                yield pd.DataFrame({"id": np.concatenate([ids[left], ids[~left]]),
                                    "n": np.concatenate([s @ n[~left], s.T @ n[left]])})

    return sent.mapInPandas(count, "id long, n long").unionByName(inner).groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vecs: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", tables: int = 16, rounds: int = 6, recall: float = 0.999) -> DataFrame:
    """Links of vectors of one label whose cosine reaches ``threshold``, as counts and components.

    Returns vec_id, n_links, component_id, kept per row. Vectors that are null, empty, zero or hold a null or non-finite
    component, and rows without a label, link with nothing and keep their own id; vectors of unlike length never link.
    Identical vectors of one label are one node with a number of copies, which count as links of each other; repeated
    rows are such copies. Of several vectors under one id the first by label and bytes is compared, the others link with
    nothing. Null ids are returned unlinked. An empty table gives no rows. Other columns are not read.

    A cosine within 1e-12 of the threshold counts as reaching it, whichever way its sum was rounded. Of the links of sampled
    vectors at least ``recall`` are found, or more keys are tried, SETS times at most; then it is an error. The figure is logged;
    it is nan where the sample (all vectors of a small table) has no link at all.
    """
    threshold -= 1e-12
    base = durable(unit_vectors(vecs, id_col, vec_col, label_col), "nnd")
    able = base.filter("vec is not null and label is not null and id is not null")
    nodes = durable(able.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nnd")
    one = F.row_number().over(W.partitionBy("id").orderBy("label", "vec")) == 1
    nodes = durable(nodes.withColumn("one", one).filter("one").drop("one"), "nnd")
    floor = 2 * threshold**2 - 1
    n = nodes.count()
    bits = max(6, min(40, int(math.log2(max(n, 2))) - 4))
    edges, done = None, 0
    for _ in range(SETS):
        more = sorted_keys(nodes.select("id", "label", "vec"), range(done, done + tables), bits, floor)
        more, done = more.withColumn("new", F.lit(True)), done + tables
        edges = more if edges is None else edges.withColumn("new", F.lit(False)).unionByName(more)
        edges = durable(edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new")), "nnd")
        roots = None
        for _ in range(2):  # inside components, then between them
            edges = edges if roots is None else edges.withColumn("new", F.lit(True))
            had = edges.count()
            for _ in range(rounds):
                got = refine(edges, nodes, threshold, floor, roots).withColumn("new", F.lit(True))
                old = edges.withColumn("new", F.lit(False))
                edges = durable(
                    old.unionByName(got).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new")), "nnd"
                )
                now = edges.count()
                if now - had <= had // 200:
                    break
                had = now
            roots = durable(components(edges.filter(F.col("sim") >= threshold), "a", "b"), "nnd")
        more = durable(bridges(edges, nodes, roots, threshold), "nnd")
        if not more.isEmpty():
            edges = durable(edges.unionByName(more.withColumn("new", F.lit(True))), "nnd")
            roots = durable(components(edges.filter(F.col("sim") >= threshold), "a", "b"), "nnd")
        found, links = audit(nodes, edges, roots, threshold)
        _LOG.info("recall %s of %d audited links after %d keys", found, links, done)
        if not found < recall:
            break
    else:
        raise RuntimeError(f"recall {found:.4f} after {done} keys is below {recall}")
    counts = count_links(nodes, roots, threshold)
    node = nodes.join(roots, F.col("node") == F.col("id"), "left").select(
        "label", "vec", "copies", F.col("id").alias("rep"), F.coalesce("root", "id").alias("component_id")
    )
    node = node.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
    node = node.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = base.join(node, (base["label"] == node["label"]) & (base["vec"] == node["vec"]) & base["id"].isNotNull(), "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all ``embeddings``."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
