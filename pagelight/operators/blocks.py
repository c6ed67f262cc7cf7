"""Exhaustive scoring of vectors against queries, block by block.

Both sides are packed, where they lie, into rows that hold a matrix; every block of queries meets every block of
vectors. A task keeps the k best of each query over all blocks it sees, so k rows a task and query are shuffled.
Vectors may be lists of vectors (late interaction): for each of a query's the best product with a page's, summed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK_BYTES = 4 << 20  # of a block's matrix
QUERY_BYTES = 64 << 20  # of all queries' matrices, up to which they are broadcast
CELLS = 2 << 20  # products that are made at once
RANKED = 128 << 20  # bytes of the scores that a task ranks at once
MOST_RANKED = 8 << 20  # vectors whose scores with one query a task holds
SLACK = 2e-9  # scores are rounded to nine digits after the tasks, so what lies this near to a k-th best stays


def _rows(column: pa.Array, over_length: bool):
    """Of vectors or lists of vectors: which rows are sound, tokens a row, and the tokens as a matrix a dimension.

    Sound: not null, not empty, all vectors of one dimension, all numbers finite (after division by the length)."""
    if not (pa.types.is_list(column.type.value_type) or pa.types.is_large_list(column.type.value_type)):
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        many, dims, flat = (sizes > 0).astype(np.int64), sizes, column.flatten()
    else:
        many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = column.flatten()
        each = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(many)), many)
        low, dims = np.full(len(many), np.iinfo(np.int64).max), np.zeros(len(many), np.int64)
        np.minimum.at(low, row, each)
        np.maximum.at(dims, row, each)
        uneven = low != dims
        taken = pa.array(np.repeat(~uneven, many))
        many, dims, flat = np.where(uneven, 0, many), np.where(uneven, 0, dims), inner.filter(taken).flatten()
    width = many * dims
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(width) - width
    for dim in np.unique(dims[width > 0]):
        at = np.nonzero((dims == dim) & (width > 0))[0]
        index = np.concatenate([np.arange(start[i], start[i] + width[i]) for i in at])
        matrix = numbers[index].reshape(-1, dim)
        if over_length:
            with np.errstate(invalid="ignore"):
                matrix = matrix / np.maximum(np.sqrt(np.einsum("ij,ij->i", matrix, matrix)), 1e-12)[:, None]
        ok = np.logical_and.reduceat(np.isfinite(matrix).all(1), np.cumsum(many[at]) - many[at])
        yield at[ok], many[at][ok], matrix[np.repeat(ok, many[at])]


def _pack(keys: int, over_length: bool, names: list[str], nulls: bool, most: int | None = None):
    """Rows (keys, vec) to blocks: number, dimension, lists of keys and sizes, matrix."""

    def run(batches):
        task = TaskContext.get()
        number = itertools.count((task.partitionId() if task else 0) << 33)
        for batch in batches:
            for k in range(0 if nulls else keys):
                batch = batch.filter(pc.is_valid(batch.column(k)))
            for at, many, matrix in _rows(batch.column(keys), over_length):
                step = max(1, BLOCK_BYTES // (8 * matrix.shape[1]))
                ends = np.cumsum(many)
                lo = 0
                while lo < len(at):
                    base = ends[lo] - many[lo]
                    hi = min(max(lo + 1, int(np.searchsorted(ends, base + step, side="right"))), lo + (most or len(at)))
                    lists = [pa.array([batch.column(k).take(pa.array(at[lo:hi])).to_pylist()], pa.list_(batch.schema.field(k).type)) for k in range(keys)]
                    part = np.ascontiguousarray(matrix[base : ends[hi - 1]])
                    yield pa.record_batch([pa.array([next(number)]), pa.array([matrix.shape[1]], pa.int32()), *lists, pa.array([many[lo:hi].tolist()], pa.list_(pa.int64())), pa.array([part.tobytes()])], names=names)
                    lo = hi

    return run


def pack(df: DataFrame, keys: list[str], vec: str, over_length: bool, prefix: str, nulls: bool = False, most: int | None = None) -> DataFrame:
    """Blocks of a table of vectors, of `most` at most; rows of null keys are left out unless `nulls`."""
    kinds = {c.name: c.dataType.simpleString() for c in df.select(*keys).schema}
    names = [f"{prefix}_block", f"{prefix}_dim", *keys, f"{prefix}_sizes", f"{prefix}_matrix"]
    schema = ", ".join([f"{names[0]} long, {names[1]} int", *[f"{k} array<{kinds[k]}>" for k in keys], f"{names[-2]} array<long>, {names[-1]} binary"])
    return df.select(*keys, vec).mapInArrow(_pack(len(keys), over_length, names, nulls, most), schema)


def _scored(q_sizes: np.ndarray, q_matrix: np.ndarray, v_sizes: np.ndarray, v_matrix: np.ndarray, half: bool):
    """Scores of a block of queries with a block of pages, some queries after the other: the first one's place, and
    a matrix (query, page) made of at most CELLS products, or of one query's."""
    ends, starts = np.cumsum(q_sizes), np.cumsum(v_sizes) - v_sizes
    lo = 0
    while lo < len(q_sizes):
        base = ends[lo] - q_sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + CELLS // max(1, len(v_matrix)), side="right")))
        score = q_matrix[base : ends[hi - 1]] @ v_matrix.T
        if (v_sizes > 1).any():
            score = np.maximum.reduceat(score, starts, axis=1)
        if (q_sizes[lo:hi] != 1).any():
            score = np.add.reduceat(score, ends[lo:hi] - q_sizes[lo:hi] - base, axis=0)
        yield lo, (score + 1) / 2 if half else score
        lo = hi


class _Best:
    """The best k pages of each query of a block, over the blocks of pages seen so far."""

    def __init__(self, ids, sizes: np.ndarray, matrix: np.ndarray, k: int, half: bool):
        self.ids, self.k, self.half, self.sizes, self.matrix = ids, k, half, sizes, matrix
        self.starts = np.cumsum(sizes) - sizes
        self.single = bool((sizes == 1).all())
        self.least = np.full(len(sizes), -np.inf)
        self.held: list[tuple] = []
        self.skipped = 0

    def over_tokens(self, s: np.ndarray) -> np.ndarray:
        return s if self.single else np.add.reduceat(s, self.starts, axis=0)

    def meet(self, doc: np.ndarray, page: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> None:
        starts = np.cumsum(sizes) - sizes
        if (sizes > 1).any() and np.isfinite(self.least).all():
            # no product with a page's vectors is over that with their mean, plus the query's length times their spread
            mean = np.add.reduceat(matrix, starts, axis=0) / sizes[:, None]
            spread = np.sqrt(np.maximum.reduceat(((matrix - np.repeat(mean, sizes, axis=0)) ** 2).sum(1), starts))
            most = self.over_tokens(self.matrix @ mean.T + np.sqrt((self.matrix**2).sum(1))[:, None] * spread)
            live = (most * (1 + 1e-9) + 1e-9 >= self.least[:, None]).any(0)
            self.skipped += int((~live).sum())
            if not live.any():
                return
            matrix, doc, page, sizes = matrix[np.repeat(live, sizes)], doc[live], page[live], sizes[live]
        for lo, score in _scored(self.sizes, self.matrix, sizes, matrix, self.half):
            hi = lo + len(score)
            own = np.partition(score, -self.k, axis=1)[:, -self.k] if score.shape[1] > self.k else np.full(len(score), -np.inf)
            self.least[lo:hi] = np.maximum(self.least[lo:hi], own - SLACK)
            q, n = np.nonzero(score >= self.least[lo:hi, None])
            self.held.append((q + lo, score[q, n], doc[n], page[n]))
        if sum(len(h[0]) for h in self.held) > 4 * self.k * len(self.sizes) + 100_000:
            self.shrink()

    def shrink(self) -> None:
        q, score, doc, page = (np.concatenate(x) for x in zip(*self.held))
        by = np.lexsort((-score, q))
        q, score, doc, page = q[by], score[by], doc[by], page[by]
        at = np.searchsorted(q, np.arange(len(self.least))) + self.k - 1
        full = (at < len(q)) & (q[np.minimum(at, len(q) - 1)] == np.arange(len(self.least)))
        self.least = np.where(full, np.maximum(self.least, score[np.minimum(at, len(q) - 1)] - SLACK), self.least)
        keep = score >= self.least[q]
        q, score, doc, page = q[keep], score[keep], doc[keep], page[keep]
        self.held = [(q, score, doc, page)]


def _best(k: int, half: bool):
    """Pairs of blocks to (query_id, doc_id, page, score)."""

    def run(batches):
        queries: dict[int, _Best] = {}
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type.value_type for c in ("query_id", "doc_id", "page")]
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                dim = row["q_dim"].as_py()
                if dim != row["v_dim"].as_py():
                    continue
                number = row["q_block"].as_py()
                if number not in queries:
                    queries[number] = _Best(row["query_id"].values, row["q_sizes"].values.to_numpy(), np.frombuffer(row["q_matrix"].as_buffer()).reshape(-1, dim), k, half)
                keys = [np.array(row[c].values.to_pylist(), object) if not pa.types.is_integer(row[c].values.type) else row[c].values.to_numpy() for c in ("doc_id", "page")]
                queries[number].meet(*keys, row["v_sizes"].values.to_numpy(), np.frombuffer(row["v_matrix"].as_buffer()).reshape(-1, dim))
        for best in queries.values():
            if best.held:
                best.shrink()
                q, score, doc, page = best.held[0]
                for lo in range(0, len(q), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.record_batch([best.ids.take(pa.array(q[part])), pa.array(doc[part], kinds[1]), pa.array(page[part], kinds[2]), pa.array(score[part])], names=["query_id", "doc_id", "page", "score"])

    return run


def _each(keys: list[str], group: list[str], k: int | None, half: bool):
    """Pairs of blocks to (query_id, keys, score, n), given out pair by pair; nothing is kept."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                dim = row["q_dim"].as_py()
                if dim != row["v_dim"].as_py():
                    continue
                ids, held = row["query_id"].values, [row[c].values for c in keys]
                blocks = [x for side in "qv" for x in (row[f"{side}_sizes"].values.to_numpy(), np.frombuffer(row[f"{side}_matrix"].as_buffer()).reshape(-1, dim))]
                many = len(blocks[2])
                if k is not None:
                    code = np.zeros(many, np.int64)
                    for c in group:
                        _, code = np.unique(code * (many + 1) + row[c].values.dictionary_encode(null_encoding="encode").indices.to_numpy(), return_inverse=True)
                    order = np.argsort(code, kind="stable")
                    first = np.flatnonzero(np.diff(code[order], prepend=-1))
                    size = np.diff(first, append=many)
                for lo, score in _scored(*blocks, half):
                    if k is None:
                        q, v = np.nonzero(np.isfinite(score))
                        found, n = score[q, v], np.ones(len(q), np.int64)
                    else:
                        score = score[:, order]
                        least = np.full((len(score), len(first)), -np.inf)
                        if k == 1:
                            least = np.maximum.reduceat(score, first, axis=1) - SLACK
                        for g in np.flatnonzero(size > k) if k > 1 else ():
                            least[:, g] = np.partition(score[:, first[g] : first[g] + size[g]], size[g] - k, axis=1)[:, size[g] - k] - SLACK
                        keep = score >= np.repeat(least, size, axis=1)
                        q, v = np.nonzero(keep)
                        found, n = score[q, v], np.ones(len(q), np.int64)
                        # the first that is kept of a group stands for those that aren't, too
                        at = np.flatnonzero(np.diff(q * len(first) + code[order][v], prepend=-1))
                        kept = np.add.reduceat(keep, first, axis=1, dtype=np.int64)
                        n[at] += (size - kept)[kept > 0]
                        v = order[v]
                    for a in range(0, len(q), 50_000):
                        part = slice(a, a + 50_000)
                        yield pa.record_batch([ids.take(pa.array(q[part] + lo)), *[c.take(pa.array(v[part])) for c in held], pa.array(found[part]), pa.array(n[part])], names=["query_id", *keys, "score", "n"])

    return run


def group_scores(queries: DataFrame, pages: DataFrame, vec: tuple[str, str], keys: list[str], group: list[str], k: int | None, over_length: bool = True, half: bool = False) -> DataFrame:
    """(query_id, keys, score, n) of queries (query_id, vec) and pages (keys, vec), unrounded: of each pair of blocks all, or
    the k best of a query in each group of pages, ties included; n is how many pages a row stands for.

    Groups are pages of like values, null among them, in the columns `group` of `keys`. A task holds a pair of blocks."""
    return _pairs(queries, pages, vec, keys, over_length, True).mapInArrow(_each(keys, group, k, half), ", ".join(f"{c} {t}" for c, t in (*_kinds(queries, ["query_id"]), *_kinds(pages, keys), ("score", "double"), ("n", "long"))))


def _modes(by: str):
    """Blocks of queries, each beside all blocks of vectors in turn, to rows of modes()."""

    def ranked(query, parts):
        """Rows of a block of queries; parts: (tiles, by, scores of all queries)."""
        n = sum(len(p[0]) for p in parts)
        if not n:
            return
        tile = np.concatenate([p[0] for p in parts])
        names = pa.chunked_array([p[1] for p in parts]).combine_chunks().dictionary_encode(null_encoding="encode")
        code = names.indices.to_numpy().astype(np.uint16 if len(names.dictionary) < 1 << 16 else np.int64)
        order = np.argsort(tile, kind="stable")  # ties go to the smaller tile
        code, many = code[order], len(names.dictionary)
        for q in range(len(query)):
            score = np.concatenate([p[2][q] for p in parts])[order]
            by_score = np.argsort(-score, kind="stable")
            by_score = by_score[np.isfinite(score[by_score])]
            score, of = score[by_score], code[by_score]
            rrf = np.bincount(of, 1.0 / (61 + np.arange(len(of))), many)
            hits = np.bincount(of, minlength=many)
            place = np.argsort(of, kind="stable")
            there = np.flatnonzero(hits)
            first, out = (np.cumsum(hits) - hits)[there], []
            for k in (1, 3, 5):
                total = np.zeros(len(there))
                for j in range(k):
                    at = np.minimum(first + j, len(place) - 1)
                    total += np.where(j < hits[there], score[place[at]], 0) if len(there) else 0
                out.append(total / np.minimum(hits[there], k))
            yield pa.record_batch([query.take(pa.array(np.full(len(there), q))), names.dictionary.take(pa.array(there)), *map(pa.array, out), pa.array(rrf[there]), pa.array(hits[there])], names=["query_id", by, "max_score", "mean3", "mean5", "rrf", "hits"])

    def run(batches):
        now, query, parts = None, None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                number = row["q_block"].as_py()
                if number != now:
                    if parts:
                        yield from ranked(query, parts)
                    now, query, parts = number, row["query_id"].values, []
                dim = row["q_dim"].as_py()
                if dim != row["v_dim"].as_py():
                    continue
                blocks = [x for side in "qv" for x in (row[f"{side}_sizes"].values.to_numpy(), np.frombuffer(row[f"{side}_matrix"].as_buffer()).reshape(-1, dim))]
                found = np.concatenate([score for _, score in _scored(*blocks, False)])
                found *= 1e9  # rounded half away from zero, as SQL does
                found = np.copysign(np.floor(np.abs(found) + 0.5), found) / 1e9
                tile = row["tile"].values
                sound = np.flatnonzero(tile.is_valid().to_numpy(zero_copy_only=False))
                if len(sound) < len(tile):
                    tile, found = tile.take(pa.array(sound)), found[:, sound]
                parts.append((tile.to_numpy(), row[by].values.take(pa.array(sound)), found))
        if parts:
            yield from ranked(query, parts)

    return run


def modes(queries: DataFrame, tiles: DataFrame, vec: tuple[str, str], by: str, over_length: bool = True) -> DataFrame | None:
    """(query_id, by, max_score, mean3, mean5, rrf, hits) of queries (query_id, vec) and tiles (by, tile, vec): of a query's
    tiles, ranked by their scores with nine digits and then by tile, the best, the means of the best three and five of each
    group, the sum of 1 / (60 + rank), and how many there are. `tile` is a whole number.

    A task takes few queries at once, and all vectors pass it block by block: it keeps their scores alone, RANKED bytes or
    those of one query, and no pair leaves it. None if there are more vectors than MOST_RANKED, or a query has several rows."""
    n = tiles.count()
    if n > MOST_RANKED or queries.groupBy("query_id").count().where("count > 1").limit(1).count():
        return None
    q = pack(queries, ["query_id"], vec[0], over_length, "q", most=max(1, RANKED // (8 * max(n, 1))))
    v = pack(tiles, [by, "tile"], vec[1], over_length, "v", True)
    kinds = dict(_kinds(queries, ["query_id"]) + _kinds(tiles, [by]))
    # one partition of vectors: the product of the tables then gives a task some blocks of queries, and each all vectors
    held = written(v, "vector-blocks").coalesce(1)
    held = written(q, "query-blocks").repartition(max(8, tiles.sparkSession.sparkContext.defaultParallelism), "q_block").hint("shuffle_replicate_nl").crossJoin(held)
    schema = f"query_id {kinds['query_id']}, {by} {kinds[by]}, max_score double, mean3 double, mean5 double, rrf double, hits long"
    return held.mapInArrow(_modes(by), schema)


def _kinds(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    return [(c.name, c.dataType.simpleString()) for c in df.select(*columns).schema]


def scores(queries: DataFrame, pages: DataFrame, vec: tuple[str, str], k: int | None, over_length: bool = True, half: bool = False) -> DataFrame:
    """(query_id, doc_id, page, score) of queries (query_id, vec) and pages (doc_id, page, vec), rounded to nine digits; of
    each task the k best of a query, ties included, or all, as they come.

    A count of the queries' numbers says whether they are broadcast; else blocks meet blocks as a product of
    two tables of blocks, each of BLOCK_BYTES at most. Both score alike."""
    if k is None:
        return group_scores(queries, pages, vec, ["doc_id", "page"], [], None, over_length, half).where("doc_id is not null and page is not null").drop("n").withColumn("score", F.round("score", 9))
    kinds = ", ".join(f"{c} {t}" for c, t in (*_kinds(queries, ["query_id"]), *_kinds(pages, ["doc_id", "page"])))
    return _pairs(queries, pages, vec, ["doc_id", "page"], over_length, False).mapInArrow(_best(k, half), f"{kinds}, score double").withColumn("score", F.round("score", 9))


def _pairs(queries: DataFrame, pages: DataFrame, vec: tuple[str, str], keys: list[str], over_length: bool, nulls: bool) -> DataFrame:
    """Every block of queries beside every block of pages."""
    q = pack(queries, ["query_id"], vec[0], over_length, "q")
    v = pack(pages, keys, vec[1], over_length, "v", nulls)
    size: Column = F.size(vec[0])
    if queries.schema[vec[0]].dataType.elementType.typeName() == "array":
        size = F.aggregate(vec[0], F.lit(0), lambda s, x: s + F.coalesce(F.size(x), F.lit(0)))
    few = (queries.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0) * 8 <= QUERY_BYTES
    return v.crossJoin(F.broadcast(q) if few else q)
