"""Exact near-duplicate links between embeddings by dual traversal of cover trees.

Vectors of one label are compared on the unit sphere, where cosine >= t is distance <= r. Equal
vectors are one class with a count. Classes are dealt to top-level nodes, the nearest of a few centres
chosen from a bounded sample (any choice gives the same links), and nodes over BLOCK vectors are cut,
so no node is large. Pairs of nodes whose centres are further apart than both covering radii and r
are pruned. Every node gets a cover tree once (nested levels with halving radii; distances are found
as points are dealt to centres, not beforehand), which travels with its vectors; each pair of nodes
that is left traverses both trees at once, pruning by covering radii. Pairs that are left are checked
by cosine in double precision. Tasks return sums of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, materialise

BLOCK = 2048
SAMPLE = 1024  # vectors from which centres are chosen
CENTRES = 12  # a label
SALTS = 16
LISTED = 64  # nodes whose pairs with all others of a label one task lists
BROADCAST_ROWS = 100_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Levels from the root down; a level's nodes are (centre, covering radius), and know their children in the next.

    A node's points within half its level's radius of its centre stay with it, so levels are nested; the
    first of the others is a new centre for those near it, and so on. Only distances from a new centre
    to points that are still to be dealt are ever taken."""

    def __init__(self, x: np.ndarray, least: float):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # centres, covering radii
        self.children: list[np.ndarray] = []  # of each level but the last: offsets into the next
        nodes, radius = [(0, np.arange(len(x)), distances(x, x[:1])[:, 0])], 2.0
        while True:
            self.levels.append((np.array([c for c, _, _ in nodes]), np.array([d.max() for _, _, d in nodes])))
            if radius < least or len(nodes) == len(x):
                break
            radius /= 2
            below, offsets = [], [0]
            for centre, left, d in nodes:
                while len(left) > 1:
                    near = d <= radius
                    below.append((centre, left[near], d[near]))
                    left = left[~near]
                    if len(left):
                        centre = int(left[0])
                        d = distances(x[left], x[centre : centre + 1])[:, 0]
                        d[0] = 0.0
                if len(left):
                    below.append((centre, left, d[:1] if len(d) == 1 else np.zeros(1)))
                offsets.append(len(below))
            self.children.append(np.array(offsets))
            nodes = below
        self.points = [p for _, p, _ in nodes]

    def packed(self) -> bytes:
        """All but the vectors."""
        return pickle.dumps((self.levels, self.children, np.concatenate(self.points), np.array([len(p) for p in self.points])))

    @classmethod
    def unpacked(cls, x: np.ndarray, data: bytes) -> CoverTree:
        out = cls.__new__(cls)
        out.x = x
        out.levels, out.children, flat, sizes = pickle.loads(data)
        out.points = np.split(flat, np.cumsum(sizes)[:-1])
        return out


def _expand(offsets: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes a, and which entry of a each belongs to."""
    size = offsets[a + 1] - offsets[a]
    who = np.repeat(np.arange(len(a)), size)
    return np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + offsets[a][who], who


def dual_pairs(s: CoverTree, t: CoverTree, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Point pairs (of s, of t) that no pair of nodes rules out; a superset of those within r."""
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    slack = r + 1e-7
    for level in range(max(len(s.levels), len(t.levels))):
        (ca, ra), (cb, rb) = s.levels[min(level, len(s.levels) - 1)], t.levels[min(level, len(t.levels) - 1)]
        if len(a) * 8 > len(ca) * len(cb):
            d = distances(s.x[ca], t.x[cb])[a, b]
        else:
            d = np.concatenate([np.zeros(0)] + [np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", s.x[ca[a[i : i + 50_000]]], t.x[cb[b[i : i + 50_000]]]), 0)) for i in range(0, len(a), 50_000)])
        keep = d <= ra[a] + rb[b] + slack
        a, b = a[keep], b[keep]
        if level < len(s.children):
            a, who = _expand(s.children[level], a)
            b = b[who]
        if level < len(t.children):
            b, who = _expand(t.children[level], b)
            a = a[who]
    sizes, sizet = np.array([len(p) for p in s.points]), np.array([len(p) for p in t.points])
    flat_s, flat_t = np.concatenate(s.points), np.concatenate(t.points)
    i, who = _expand(np.concatenate([[0], np.cumsum(sizes)]), a)
    j, who2 = _expand(np.concatenate([[0], np.cumsum(sizet)]), b[who])
    return flat_s[i[who2]], flat_t[j]


def reach(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold))


def tree(x: np.ndarray, threshold: float) -> CoverTree:
    return CoverTree(unit(x), reach(threshold) / 4)


def links(x: np.ndarray, y: np.ndarray | None, threshold: float, trees: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold between rows of x and of y, or within x (then i < j)."""
    r = reach(threshold)
    s, t = trees or (tree(x, threshold), None if y is None else tree(y, threshold))
    t = s if t is None else t
    i, j = dual_pairs(s, t, r)
    if y is None:
        i, j = i[i < j], j[i < j]
        y = x
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    ok = [np.zeros(0, bool)]
    for lo in range(0, len(i), 100_000):
        p, q = i[lo : lo + 100_000], j[lo : lo + 100_000]
        ok.append(np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold)
    keep = np.concatenate(ok)
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches by the links."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _centres(sample: list, dims: int) -> np.ndarray:
    """Some vectors of a sample, each the furthest from those before."""
    x = unit(np.array(sample, np.float64).reshape(-1, dims))
    chosen, far = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(CENTRES, len(x)) and far.max() > 0.5:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a row of `vectors` (vec_id, embedding, label).

    A null label or id, a null, empty or zero vector, and one with null or non-finite components link
    with nothing and are kept; so do vectors of different lengths. Rows that repeat a vec_id count as
    vectors of their own that share a node. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound &= F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False))
    classes = materialise(rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    by: dict = {}
    for r in classes.orderBy(F.xxhash64("id")).limit(SAMPLE).collect():
        by.setdefault((str(r["label"]), len(r["embedding"])), []).append(r["embedding"])
    centres = spark.sparkContext.broadcast({k: _centres(v, k[1]) for k, v in by.items()})

    def deal(batches):
        for batch in batches:
            labels, vec = batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
            cell, group = np.zeros(batch.num_rows, np.int64), {}
            for k, (lab, v) in enumerate(zip(labels, vec)):
                group.setdefault((str(lab), len(v)), []).append(k)
            for key, own in group.items():
                if key in centres.value:
                    c = centres.value[key]
                    for lo in range(0, len(own), 4096):
                        part = own[lo : lo + 4096]
                        cell[part] = distances(unit(np.array([vec[k] for k in part], np.float64)), c).argmin(1)
            names = [f"{lab}/{len(v)}" for lab, v in zip(labels, vec)]
            yield pa.record_batch([pa.array(names), pa.array(cell), batch.column("id"), batch.column("n"), batch.column("embedding")], names=["space", "cell", "id", "n", "embedding"])

    dealt = materialise(classes.select("label", "embedding", "id", "n").mapInArrow(deal, "space string, cell long, id long, n long, embedding array<float>"), "vector-cells")
    sizes = dealt.groupBy("space", "cell").agg(F.ceil(F.count("*") / (0.7 * BLOCK)).alias("parts"))  # one row a node
    blocked = dealt.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, ["space", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(table: pa.Table) -> pa.Table:
        x = np.array(table.column("embedding").to_pylist(), np.float32)
        u = unit(x.astype(np.float64))
        mid = u.mean(0)
        name = (table.column("space")[0].as_py(), f"{table.column('cell')[0].as_py()}-{table.column('part')[0].as_py()}")
        out = [[name[0]], [name[1]], [x.shape[1]], [table.column("id").to_numpy().tobytes()], [table.column("n").to_numpy().tobytes()], [x.tobytes()], [mid.tolist()], [float(np.sqrt(((u - mid) ** 2).sum(1)).max())], [tree(x.astype(np.float64), threshold).packed()]]
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.binary()))], names=["space", "block", "dims", "ids", "counts", "vectors", "mid", "radius", "tree"])

    blocks = materialise(blocked.groupBy("space", "cell", "part").applyInArrow(pack, "space string, block string, dims int, ids binary, counts binary, vectors binary, mid array<double>, radius double, tree binary"), "vector-blocks")
    parts = blocks.groupBy("space").agg(F.ceil(F.count("*") / LISTED).cast("int").alias("parts"))  # a label's pairs are listed by so many tasks
    listed = blocks.select("space", "block", "mid", "radius").join(F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts, "space")
    one = listed.withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    two = listed.select("space", F.col("block").alias("block2"), F.col("mid").alias("mid2"), F.col("radius").alias("radius2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    apart = F.sqrt(F.aggregate(F.zip_with("mid", "mid2", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    pairs = materialise(one.join(two, ["space", "part"]).where("block <= block2").where(apart <= F.col("radius") + F.col("radius2") + reach(threshold) + 1e-7).select("space", "block", "block2"), "vector-block-pairs")
    right = blocks.select("space", F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"), F.col("vectors").alias("vectors2"), F.col("tree").alias("tree2"))
    tasks = pairs.join(blocks.select("space", "block", "dims", "ids", "counts", "vectors", "tree"), ["space", "block"]).join(right, ["space", "block2"])
    n = max(1, pairs.count())
    tasks = tasks.repartition(min(4096, n), "space", "block", "block2")

    def compare(batches):
        for batch in batches:
            for same, dims, ids, counts, vecs, own, ids2, counts2, vecs2, other in zip(*(batch.column(c).to_pylist() for c in ("same", "dims", "ids", "counts", "vectors", "tree", "ids2", "counts2", "vectors2", "tree2"))):
                ids, n1 = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
                x = np.frombuffer(vecs, np.float32).reshape(-1, dims).astype(np.float64)
                own = CoverTree.unpacked(unit(x), own)
                if same:
                    i, j = links(x, None, threshold, (own, None))
                    all_ids, total = ids, np.bincount(i, n1[j], len(ids)) + np.bincount(j, n1[i], len(ids))
                else:
                    y = np.frombuffer(vecs2, np.float32).reshape(-1, dims).astype(np.float64)
                    i, j = links(x, y, threshold, (own, CoverTree.unpacked(unit(y), other)))
                    more, n2 = np.frombuffer(ids2, np.int64), np.frombuffer(counts2, np.int64)
                    all_ids = np.concatenate([ids, more])
                    total = np.concatenate([np.bincount(i, n2[j], len(ids)), np.bincount(j, n1[i], len(more))])
                    j = j + len(ids)
                low = forest(len(all_ids), i, j)
                hit = np.flatnonzero(total > 0)
                yield pa.record_batch([pa.array(all_ids[hit]), pa.array(all_ids[low[hit]]), pa.array(total[hit].astype(np.int64))], names=["id", "root", "links"])

    found = tasks.select((F.col("block") == F.col("block2")).alias("same"), "dims", "ids", "counts", "vectors", "tree", "ids2", "counts2", "vectors2", "tree2").mapInArrow(compare, "id long, root long, links long")
    found = materialise(found, "vector-links")
    for t in (dealt, blocks, pairs):
        drop(t)
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(groups, F.col("id") == F.col("node"), "left").select("id", "links", "component")
    many = classes.where("n > 1").select("label", "embedding", F.col("id").alias("class_id"), "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.withColumn("sound", sound).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    own = out.join(many, ["label", "embedding", "salt"], "left").select("vec_id", "sound", F.coalesce(F.when(F.col("sound"), F.col("class_id")), F.col("vec_id")).alias("id"), F.when(F.col("sound") & F.col("n").isNotNull(), F.col("n") - 1).otherwise(0).alias("copies"))
    own = own.join(linked, "id", "left")
    component = F.coalesce(F.when(F.col("sound"), F.least(F.col("component"), F.col("id"))), F.col("id"))
    return own.select("vec_id", (F.col("copies") + F.when(F.col("sound"), F.coalesce("links", F.lit(0))).otherwise(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same by plain joins; for small tables.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.98),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
g AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(g.component, m.vec_id) AS component_id, coalesce(g.component, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN g ON g.node = m.vec_id
"""
