"""Exact Jaccard join of word-shingle sets by pivots, Voronoi regions and windows, and its components.

Jaccard distance is a metric, so pivots cut the documents into regions, and the triangle inequality
says which documents must also be looked at in a region that isn't their own. A document drawn at
random is at distance 1 from nearly every other, though, and such pivots put everything into one
region. So the first cut is by other points of that space, the sets of a single shingle: a document is
nearer than 1 to pivot {s} exactly if it holds s, and its region is that of its first shingle in one
global order. Within the regions documents are alike, and documents serve as pivots.

1. Equal sets are one class. A class of n shingles is replicated to the regions of its window, its
   first floor((1 - t) n) + c shingles: partners within the limit share at least c of them.
2. A region with one class is dropped, and so is a class left with fewer shared regions than any
   partner would need.
3. In TURNS turns, the classes of each region are compared with HUBS of them, chosen by a hash that
   changes with the turn, unless they are of one component already; the links that hold contract the
   region's classes to components, so a large group of near copies costs a few pairs a member.
4. Regions with several components are joined exactly. In small ones the pairs between different
   components that meet in as many regions as the bound says are listed. Large ones are cut by pivots
   (voronoi): each class goes to its nearest pivot, and to those before it where the triangle
   inequality allows it a partner; what is far from all pivots forms a region too. Regions are cut
   again and again until they hold BLOCK classes, which are compared at once. A region that pivots
   can't cut, as all of it is about as far apart, is dealt in blocks instead, pair by pair of blocks.

Pairs are compared on their whole sets, once their bitmaps don't rule a link out. Frequent shingles, found in a sample of documents that
grows with the table, come last in the order, the most frequent at the end; any order gives the same links, this one keeps regions small
however large the table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, claim, components, drop, materialise, slices
from .words import hashed_words, mix, shingles, space_class

SAMPLE = 4_000  # documents at least in which frequent shingles are looked for
PART = 8  # of the documents, the share that is looked at in larger tables
FREQUENT = 4  # documents of the sample: a shingle that is not frequent has a region of about SMALL classes
MOST_FREQUENT = 2_000_000  # shingles that are put last, at most
RANGE_BYTES = 6_000_000
BROADCAST_IDS = 2_000_000
SALTS = 16
HUBS, TURNS = 2, 2
TRIED = 40  # shingles of the smaller set a region in which a class must meet a hub to be compared with it
SMALL = 32  # classes up to which a region's pairs are listed
BLOCK = 256  # classes of a larger one that are compared at once
PIVOTS = 12  # a region that is cut
NEAR = 0.5  # classes further from all pivots form the outer region


def sets(column: pa.Array, k: int):
    """Row and sorted distinct shingle hashes of each text of a column."""
    claim("shingles")
    raw, off = buffers(column)
    inside = space_class()
    for lo, hi in slices(off, 1_000_000):
        h, first = hashed_words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], inside)
        for i in range(hi - lo):
            yield lo + i, np.unique(shingles(h[first[i] : first[i + 1]], k))


def signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        whole = np.sum(mix(s + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) if len(s) else np.uint64(0)
    return int(whole.astype(np.int64))


def share(n: int, distance: float) -> int:
    """Regions of its window, beyond the distance limit, that a set of n shingles takes."""
    return max(1, -(-n // 10))


def window(n: int, distance: float) -> int:
    return min(n, int(distance * n + 1e-9) + share(n, distance))


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sig) of every document; n = 0 without words."""

    def run(batches):
        for batch in batches:
            n, sig = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in sets(batch.column(1), k):
                n[i], sig[i] = len(s), signature(s)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(sig)], names=["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long")


def _chosen(docs: DataFrame, ids: DataFrame, small: bool) -> DataFrame:
    """(doc_id, text) of the documents that `ids` (id) names."""
    return docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("id"), "left_semi")


def marks(s: np.ndarray) -> bytes:
    """A bitmap of a set of n shingles, of 2 n to 4 n bits: whether an odd number of them falls to a place."""
    size = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.bincount((mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the larger one folded to the other's size: to each falls a shingle that one set alone holds."""
    if len(x) < len(y):
        x, y = y, x
    one, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        one = one >> size ^ one & (1 << size) - 1
    return (one ^ int.from_bytes(y, "little")).bit_count()


def hold(docs: DataFrame, ids: DataFrame, k: int, small: bool) -> DataFrame:
    """(id, shingles, n, bits): the packed sorted set of each document that `ids` (id) names, under its signature, its
    size and its bitmap."""

    def run(batches):
        for batch in batches:
            found = [(signature(s), s.tobytes(), len(s), marks(s)) for _, s in sets(batch.column(1), k)]
            yield pa.record_batch([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["id", "shingles", "n", "bits"])

    return _chosen(docs, ids, small).mapInArrow(run, "id long, shingles binary, n long, bits binary")


def frequent(docs: DataFrame, meta: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of FREQUENT or more documents of a sample, sorted, and the number of bits of their counts."""
    known = meta.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"))
    size = max(SAMPLE, known.count() // PART)
    ids = known.orderBy(F.xxhash64("id")).limit(size)

    def run(batches):
        for batch in batches:
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, s in sets(batch.column(1), k))]), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    counted = _chosen(docs, ids, size <= BROADCAST_IDS).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    counted = materialise(counted, "frequent-shingles")
    found = counted.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).toArrow()
    drop(counted)
    h, c = (found.column(x).to_numpy().astype(np.int64) for x in ("h", "c"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], np.frexp(c[order].astype(np.float64))[1].astype(np.uint8)


def replicate(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], ranges: int, k: int, distance: float) -> DataFrame:
    """(range, entries): packed (shingle, class) pairs of all windows, by range of shingle."""
    held = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        heavy, level = held.value

        def flush():
            a = np.unique(np.concatenate(got).reshape(-1, 2), axis=0) if got else np.zeros((0, 2), np.uint64)
            where = (mix(a[:, 0]) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            a, where = a[order], where[order]
            own, first = np.unique(where, return_index=True)
            cut = [*first.tolist(), len(a)]
            return pa.record_batch([pa.array(own), pa.array([a[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["range", "entries"])

        got, size = [], 0
        for batch in batches:
            for _, s in sets(batch.column(0), k):
                if not len(s):
                    continue
                p = window(len(s), distance)
                sig = np.uint64(signature(s) & 0xFFFFFFFFFFFFFFFF)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    s = s[np.argsort(np.where(heavy[at] == s, level[at], 0), kind="stable")]
                entry = np.empty((p, 2), np.uint64)
                entry[:, 0], entry[:, 1] = s[:p], sig
                got.append(entry)
                size += p
                if size > 400_000:
                    yield flush()
                    got, size = [], 0
        if got:
            yield flush()

    return docs.select("text").mapInArrow(run, "range long, entries binary")


def shared_regions(packed: DataFrame) -> DataFrame:
    """(h, sig): entries of regions that hold two classes or more."""

    def run(table: pa.Table) -> pa.Table:
        a = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.uint64).reshape(-1, 2)
        a = a[np.lexsort((a[:, 1], a[:, 0]))]
        if len(a):
            a = a[np.concatenate([[True], (a[1:] != a[:-1]).any(1)])]
        _, back, count = np.unique(a[:, 0], return_inverse=True, return_counts=True)
        a = a[count[back] > 1].view(np.int64)
        return pa.table([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["h", "sig"])

    return packed.groupBy("range").applyInArrow(run, "h long, sig long")


def likely(pairs: DataFrame, held: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule a link out. Sets that link differ in (100 - t) / (100 + t) of the sum of
    their sizes at most, and neither their sizes nor their bitmaps differ by more than sets, so no link is lost."""

    def run(batches):
        for batch in batches:
            x, y, n, m = (batch.column(k).to_pylist() for k in range(2, 6))
            mask = pa.array([(100 + t) * max(abs(z[2] - z[3]), apart(*z[:2])) <= (100 - t) * (z[2] + z[3]) for z in zip(x, y, n, m)], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one, two = (held.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def compare(pairs: DataFrame, held: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of t (in hundredths) or more. Most pairs that meet in a
    region are unlike; their bitmaps, a twentieth of the sets, tell, and only the sets of the others are shuffled."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep.append(100 * both >= t * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    found = materialise(likely(pairs, held, t), "likely-pairs")
    ids = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
    sets_of = held.select("id", "shingles").join(F.broadcast(ids) if found.count() <= BROADCAST_IDS // 2 else ids, "id", "left_semi")
    one, two = sets_of.withColumnsRenamed({"id": "a", "shingles": "s"}), sets_of.withColumnsRenamed({"id": "b", "shingles": "s2"})
    return found.join(one, "a").join(two, "b").select("a", "b", "s", "s2").mapInArrow(run, "a long, b long")


def between(regions: DataFrame, ranges: int, t: float) -> DataFrame:
    """(a, b, c): pairs of classes of different components that meet in regions, sizes apart by the
    limit at most, and in how many. regions: (h, id, n, component)."""

    def run(table: pa.Table) -> pa.Table:
        h, i, n, g = (table.column(c).to_numpy() for c in ("h", "id", "n", "component"))
        order = np.lexsort((n, h))
        h, i, n, g = h[order], i[order], n[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        out = []
        total: dict = {}
        for lo, hi in zip(first, [*first[1:], len(h)]):
            # sizes ascend, so partners of a class are those up to 1 / t times its size
            end = lo + np.searchsorted(n[lo:hi] * t, n[lo:hi] * 100, side="right")
            for k in range(lo, hi - 1):
                other = np.arange(k + 1, end[k - lo])
                other = other[g[other] != g[k]]
                if len(other):
                    out.append(np.stack([np.minimum(i[k], i[other]), np.maximum(i[k], i[other])], 1))
            if sum(map(len, out)) > 1_000_000:
                _merge(total, out)
                out = []
        _merge(total, out)
        a = np.array(list(total), np.int64).reshape(-1, 2)
        return pa.table([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(list(total.values()), pa.int64())], names=["a", "b", "c"])

    return regions.withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges))).groupBy("range").applyInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _common(sets_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and the sizes of all intersections, by products of incidence matrices; no pairs are listed."""
    size = np.array([len(x) for x in sets_], np.int64)
    _, col, count = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets_)), size)
    place = np.cumsum(count > 1) - 1
    keep = count[col] > 1
    row, col = row[keep], place[col[keep]]
    both = np.zeros((len(sets_), len(sets_)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, (lo, lo + 4096))
        m = np.zeros((len(sets_), 4096), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        both += m @ m.T
    return size, both


def _linked(t: float):
    """Links that connect what all pairs of a group connect: a spanning forest of them comes out."""
    from .embed_dedup import forest

    def run(table: pa.Table) -> pa.Table:
        ids, group = table.column("id").to_numpy(), table.column("component").to_numpy()
        size, both = _common([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()])
        i, j = np.nonzero(100 * both >= t * (size[:, None] + size - both))
        keep = (i < j) & (group[i] != group[j])
        low = forest(len(ids), i[keep], j[keep])
        at = np.flatnonzero(low != np.arange(len(ids)))
        return pa.table([pa.array(ids[low[at]]), pa.array(ids[at])], names=["a", "b"])

    return run


def compare_blocks(regions: DataFrame, held: DataFrame, t: float) -> DataFrame:
    """(a, b): links within each region (region, id, component). It is dealt into blocks by a hash, and
    each pair of blocks is a task that gets both blocks' sets."""
    parts = regions.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = regions.join(parts, "region").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own = own.select("region", "id", "component", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    own = own.select("region", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id", "component")
    return own.join(held.select("id", "shingles"), "id").groupBy("region", "one", "two").applyInArrow(_linked(t), "a long, b long")


def cells(size: np.ndarray, both: np.ndarray, pivot: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, cell) of every class in its Voronoi cell and of those that windows replicate; the last cell is the outer one.

    Cells are balls of radius NEAR about pivots. If x of cell k has a partner y, then y is at most
    NEAR + limit from pivot k, and at most twice the limit further from it than from its own pivot."""
    apart = 1 - both[:, pivot] / np.maximum(size[:, None] + size[pivot] - both[:, pivot], 1)
    nearest = apart.argmin(1)
    best = apart[np.arange(len(size)), nearest]
    own = np.where(best <= NEAR, nearest, len(pivot))
    reach = np.minimum(NEAR + limit, np.where(own < len(pivot), best, NEAR + limit) + 2 * limit) + 1e-9
    guest, cell = np.nonzero((apart <= reach[:, None]) & (np.arange(len(pivot)) < own[:, None]))
    return np.concatenate([np.arange(len(size)), guest]), np.concatenate([own, cell])


def cut(regions: DataFrame, held: DataFrame, limit: float, depth: int) -> DataFrame:
    """(region, id, component, parent, was) of the cells of each region (region, id, component, was): its pivots
    go to all tasks that its classes are dealt to."""
    chosen = [F.min(F.struct(F.xxhash64("id", F.lit(depth * PIVOTS + k)).alias("x"), "id")) for k in range(PIVOTS)]
    about = regions.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.array_distinct(F.transform(F.array(*chosen), lambda x: x["id"])).alias("pivots"))
    own = regions.join(about, "region").select("region", "id", "component", "was", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("pivot"))
    middle = about.select("region", F.explode("pivots").alias("id"), "parts").select("region", "id", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("was"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("pivot"))

    def run(table: pa.Table) -> pa.Table:
        pivot = np.asarray(table.column("pivot"))
        ids, region = table.column("id").to_numpy(), table.column("region").to_numpy()[:1]
        order = np.argsort(ids, kind="stable")  # pivots have the same numbers in every task
        at = order[pivot[order]]
        size, both = _common([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()])
        member, cell = cells(size, both, at, limit)
        keep = ~pivot[member]
        member, cell = member[keep], cell[keep]
        with np.errstate(over="ignore"):
            name = mix(region.view(np.uint64) * np.uint64(31) + cell.astype(np.uint64) + np.uint64(1 + depth * 4099)).view(np.int64)
        picked = table.select(["id", "component", "was"]).take(pa.array(member))
        return pa.table([pa.array(name), *picked.columns[:2], pa.array(np.repeat(region, len(member))), picked.column(2)], names=["region", "id", "component", "parent", "was"])

    return own.unionByName(middle).join(held.select("id", "shingles"), "id").groupBy("region", "part").applyInArrow(run, "region long, id long, component long, parent long, was long")


def voronoi(large: DataFrame, held: DataFrame, t: float) -> DataFrame:
    """(a, b): links that connect what all pairs within each group (head, id, component) connect.

    Cut by pivots level by level. Cells with one component are done. A region is cut no further if it
    holds BLOCK classes at most, and not by pivots if its cells together would hold twice its classes
    or one of them three quarters. So every level shrinks all regions and there are few."""
    live = large.select(F.col("head").alias("region"), "id", "component")
    small, odd, depth = [], [], 0
    while True:
        sized = live.join(live.groupBy("region").agg(F.count("*").alias("was"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").drop("lo", "hi"), "region")
        sized = materialise(sized, "regions-to-cut")
        small.append(sized.where(F.col("was") <= BLOCK).select("region", "id", "component"))
        big = sized.where(F.col("was") > BLOCK)
        if not big.limit(1).count():
            break
        made = materialise(cut(big, held, 1 - t / 100, depth), "cells")
        each = made.groupBy("parent", "region").agg(F.count("*").alias("n"), F.first("was").alias("was"))
        bad = materialise(each.groupBy("parent").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.first("was").alias("was")).where("n > 2 * was or 4 * most > 3 * was").select("parent"), "uncut-regions")
        odd.append(big.join(bad, big["region"] == bad["parent"], "left_semi").select("region", "id", "component"))
        live = made.join(bad, "parent", "left_anti").select("region", "id", "component")
        depth += 1
    found = reduce(DataFrame.unionByName, small).join(held.select("id", "shingles"), "id").groupBy("region").applyInArrow(_linked(t), "a long, b long")
    return found.unionByName(compare_blocks(reduce(DataFrame.unionByName, odd), held, t)) if odd else found


def _merge(total: dict, parts: list) -> None:
    if parts:
        u, c = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        for (a, b), n in zip(u.tolist(), c.tolist()):
            total[a, b] = total.get((a, b), 0) + n


def _mixed(regions: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(h, id, n, component) of the regions that hold several components still."""
    own = regions.withColumn("component", F.col("id")) if groups is None else regions.join(groups, F.col("id") == F.col("node"), "left").select("h", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = own.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    return materialise(own.join(mixed, "h"), "mixed-regions")


def join(docs: DataFrame, t: int = 80, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, classes, component of each class that links): meta (doc_id, n, sig) has a row a document,
    classes (sig, n, id, copies) one a distinct set; id is its smallest doc_id. Until the end classes go
    by their signatures, as rows may repeat a doc_id with other texts; a component is its smallest doc_id."""
    spark: SparkSession = docs.sparkSession
    distance = 1 - t / 100
    docs = docs.select("doc_id", "text")
    meta = materialise(sketch(docs, k), "shingle-counts")
    classes = materialise(meta.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "shingle-classes")
    entries = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    ranges = max(256, -(-entries * 5 // RANGE_BYTES))  # 16 bytes each, 30 of 100 shingles
    often = frequent(docs, meta, k)
    shared = materialise(shared_regions(replicate(docs.where("doc_id is not null"), often, ranges, k, distance)), "shared-regions")
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * t / 100 / 10 - 1e-9))
    active = shared.groupBy("sig").agg(F.count("*").alias("met")).join(classes, "sig").where(F.col("met") >= need).select(F.col("sig").alias("id"), F.col("id").alias("doc_id"), "n")
    active = materialise(active, "active-classes")
    regions = shared.join(active, F.col("sig") == F.col("id")).select("h", "id", "n")
    regions = materialise(regions, "regions")
    ids = active.select(F.col("doc_id").alias("id")).distinct()
    held = hold(docs, ids, k, ids.count() <= BROADCAST_IDS)
    if classes.agg(F.sum("copies")).first()[0] != meta.where("n > 0").select("doc_id").distinct().where("doc_id is not null").count():
        held = held.dropDuplicates(["id"])  # a doc_id stands for several rows
    held = materialise(held, "shingle-sets")
    drop(shared)
    links = groups = None
    for turn in range(TURNS):
        live = _mixed(regions, groups)
        if not live.limit(1).count():
            break
        seeds = [F.min(F.struct(F.xxhash64("id", F.lit(turn * HUBS + k)).alias("x"), "id", "n", "component")) for k in range(HUBS)]
        seeds += [F.min(F.struct(F.col("id").alias("x"), "id", "n", "component"))] if not turn else []
        hubs = live.groupBy("h").agg(F.array(*seeds).alias("hubs"))
        tried = live.join(hubs, "h").select("id", "n", "component", F.explode(F.array_distinct("hubs")).alias("hub")).where(F.expr("component <> hub.component") & (t * F.greatest("n", "hub.n") <= 100 * F.least("n", "hub.n")))
        tried = tried.groupBy(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"), F.least("n", "hub.n").alias("least")).count()
        # pairs that met by chance, in few regions, are most of them; a link that is left out here is found below
        found = compare(tried.where(TRIED * F.col("count") >= F.col("least")).select("a", "b"), held, t)
        links = materialise(found if links is None else links.unionByName(found), "hub-links")
        groups = materialise(components(links), "hub-components")
        drop(live)
    live = _mixed(regions, groups)
    heads = materialise(live.groupBy("h").agg(F.count("*").alias("members"), F.min("id").alias("head")), "region-heads")
    pairs = between(live.join(heads.where(F.col("members") <= SMALL), "h").select("h", "id", "n", "component"), ranges, t)
    large = live.join(heads.where(F.col("members") > SMALL), "h").select("head", "id", "component").distinct()
    blocked = materialise(voronoi(large, held, t), "block-links")
    size1, size2 = active.select(F.col("id").alias("a"), F.col("n").alias("na")), active.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    least = F.greatest(F.lit(1), F.ceil(F.least("na", "nb") / 10))
    pairs = pairs.join(size1, "a").join(size2, "b").where(F.col("c") >= least).select("a", "b")
    found = compare(pairs, held, t).unionByName(blocked)
    known = meta.where("n > 0 and doc_id is not null")
    several = materialise(known.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("top")).where("a <> top").select("doc_id", "a"), "repeated-ids")
    if several.limit(1).count():  # rows of one doc_id are one node
        found = found.unionByName(known.join(several, "doc_id").select("a", F.col("sig").alias("b")).where("a <> b").distinct())
    sets_of = materialise(components(found if links is None else links.unionByName(found)), "set-components")
    member = sets_of.select("node", "component").unionByName(sets_of.select(F.col("component").alias("node"), "component")).distinct()
    first = member.join(classes, F.col("node") == F.col("sig")).groupBy("component").agg(F.min("id").alias("first"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = member.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    out = materialise(own.join(first, ["component", "salt"]).select("node", F.col("first").alias("component")), "class-components")
    drop(sets_of)
    drop(several)
    for x in (regions, live, heads, blocked, held, *([groups] if groups else [])):
        drop(x)
    return meta, classes, out


def near_duplicates(docs: DataFrame, t: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a row of `docs`; the smallest doc_id reachable by links.

    Sets hold 64-bit hashes of shingles, so a link is exact but for collisions of hashes, whose chance is
    about shingles**2 / 2**65; words built to collide are not guarded against. A text without words has an empty set and links with nothing.
    A null doc_id links with nothing and has a null component. Rows that repeat a doc_id share a node.
    Other columns are left out.
    """
    meta, classes, linked = join(docs, t, k)
    named = classes.join(linked, F.col("sig") == F.col("node"), "left").select("sig", "n", "id", "copies", F.coalesce("component", "id").alias("component"))
    named = materialise(named, "named-classes")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    many = named.where("copies > 1").select("sig", "n", F.col("component").alias("group"), salts)
    alone = named.where("copies = 1 and component <> id").select(F.col("id").alias("alone_id"), F.col("sig").alias("alone_sig"), F.col("component").alias("alone"))
    rows = meta.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(many, ["sig", "n", "salt"], "left").join(alone, (F.col("doc_id") == F.col("alone_id")) & (F.col("sig") == F.col("alone_sig")), "left")
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("group", "alone", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, t: int = 80, k: int = 5) -> DataFrame:
    """Rows of docs that stay when each component keeps its document of smallest doc_id.

    Texts without words and rows with a null doc_id all stay; equal rows that repeat a doc_id become one."""
    found = materialise(near_duplicates(docs, t, k), "components")
    go = materialise(found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    out = docs.join(F.broadcast(go) if go.count() <= BROADCAST_IDS else go, "doc_id", "left_anti").select(*docs.columns)
    return out.dropDuplicates(["doc_id", "text"]) if repeats else out


#: The same by plain joins on the shingles themselves; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
g AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(g.component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN g ON g.node = w.doc_id
"""
