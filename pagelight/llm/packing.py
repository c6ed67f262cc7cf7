"""Best-fit packing of documents into sequences by linear grouping.

Planned on the histogram of piece lengths, which has at most as many entries as a sequence has
tokens, whatever the size of the corpus; documents themselves never come to the driver.

1. Large lengths (over capacity / 8) are cut, in order of length, into groups of equal cardinality
   and rounded up to the largest length of their group.
2. With so few sizes, configurations (how many of each size share a sequence) are optimised: the
   linear program over all of them is solved by column generation, and each is used a whole number
   of times.
3. Actual documents take the places of the rounded sizes, in order of length. Runs of sequences
   whose places hold the same actual lengths stay one entry of the plan.
4. What is left, small lengths above all, goes, longest first, each into the sequence with the least
   room that still holds it.

Several numbers of groups are planned, none among them, and the plan of the fewest sequences counts.

The plan is a list of intervals (length, first rank, sequence, places a sequence, offset). A document's
rank among those of its length finds its interval, and with it its sequence and place.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoder

GROUPS = 48
SALTS = 64  # at least; one more for every SALT_ROWS pieces
SALT_ROWS = 1_000_000
BROADCAST_ROWS = 500_000


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of every document: (doc_id, copy, piece, start, length, ids_crc32).

    A null or empty text is its end id alone. Only documents over `capacity` are cut. Rows that
    repeat a doc_id are documents of their own. Other columns are left out.
    """

    def run(batches):
        e, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), e.encode_all(part.column(1).to_pylist())):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The sequence of the greatest worth: how many of each size, by a knapsack over filled lengths."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for k, size in enumerate(sizes):
        if worth[k] <= 1e-12:
            continue
        old = best
        best = old.copy()
        for n in range(1, capacity // size + 1):
            new = old[: capacity + 1 - n * size] + n * worth[k]
            more = new > best[n * size :] + 1e-12
            best[n * size :][more] = new[more]
            taken[k, n * size :][more] = n
    pattern, at = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        pattern[k] = taken[k, at]
        at -= pattern[k] * sizes[k]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 3000) -> list[tuple[list[int], int]]:
    """(how many of each size, how often): few sequences for `counts`, by column generation.

    Sizes decrease. The linear program over all sequences that can be filled is solved with a basis of
    as many configurations as there are sizes; a knapsack priced by its duals finds the one to enter.
    Each is used a whole number of times; what is left of the counts is the caller's to place."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(counts, np.float64)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, need), np.linalg.solve(basis, pattern.astype(np.float64))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    x = np.linalg.solve(basis, need)
    left, out = need.astype(np.int64), []
    for j in np.argsort(-x, kind="stable").tolist():
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        often = min(int(x[j] + 1e-6), int((left[used] // pattern[used]).min()))
        if often > 0:
            out.append((pattern.tolist(), often))
            left -= often * pattern
    return out


class _Plan:
    """Intervals, and the room that is left in runs of sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.histogram = capacity, histogram
        self.intervals: list[tuple[int, int, int, int, int, int]] = []
        self.rank: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)
        self.rooms: list[int] = []

    def put(self, length: int, n: int, first: int, places: int, offset: int) -> None:
        self.intervals.append((length, self.rank[length], n, first, places, offset))
        self.rank[length] += n

    def leave(self, space: int, first: int, n: int) -> None:
        if space:
            if space not in self.room:
                bisect.insort(self.rooms, space)
                self.room[space] = []
            self.room[space].append((first, n))

    def group(self, groups: int) -> None:
        """Linear grouping of the large lengths, configurations of their rounded sizes, and actual lengths in their places."""
        capacity = self.capacity
        large = sorted((x for x in self.histogram if x > capacity // 8), reverse=True)
        total = sum(self.histogram[x] for x in large)
        if not total:
            return
        # equal cardinality: a group is a range of ranks among the large, longest first
        bounds = sorted({round(total * k / groups) for k in range(groups + 1)})
        starts, at = [], 0
        for x in large:
            starts.append(at)
            at += self.histogram[x]
        length_at = lambda r: large[bisect.bisect_right(starts, r) - 1]
        sizes, counts, heads = [], [], []
        for lo, hi in zip(bounds, bounds[1:]):
            if sizes and sizes[-1] == length_at(lo):
                counts[-1] += hi - lo
            else:
                sizes.append(length_at(lo))
                counts.append(hi - lo)
                heads.append(lo)
        cursor = list(heads)
        for pattern, often in configurations(sizes, counts, capacity):
            slots = [(k, i) for k, n in enumerate(pattern) for i in range(n)]
            first = {(k, i): cursor[k] + i * often for k, i in slots}
            # a run ends where some place's actual length changes
            cuts = {0, often}
            for s in slots:
                j = bisect.bisect_right(starts, first[s])
                while j < len(starts) and starts[j] < first[s] + often:
                    cuts.add(starts[j] - first[s])
                    j += 1
            cuts_ = sorted(cuts)
            for lo, hi in zip(cuts_, cuts_[1:]):
                offset = 0
                for s in slots:
                    x = length_at(first[s] + lo)
                    self.put(x, hi - lo, self.sequences + lo, 1, offset)
                    offset += x
                self.leave(capacity - offset, self.sequences + lo, hi - lo)
            self.sequences += often
            for k, n in enumerate(pattern):
                cursor[k] += n * often

    def fit(self) -> None:
        """All that isn't placed yet, longest first, each into the sequence with the least room that still holds it."""
        for x in sorted(self.histogram, reverse=True):
            left = self.histogram[x] - self.rank[x]
            while left:
                i = bisect.bisect_left(self.rooms, x)
                if i == len(self.rooms):
                    n = -(-left // (self.capacity // x))
                    runs, space = [(self.sequences, n)], self.capacity
                    self.sequences += n
                else:
                    space = self.rooms.pop(i)
                    runs = self.room.pop(space)
                each = space // x
                for first, n in runs:
                    full = min(n, left // each)
                    if full:
                        self.put(x, full * each, first, each, self.capacity - space)
                        left -= full * each
                        self.leave(space - each * x, first, full)
                    if full < n and left:
                        self.put(x, left, first + full, left, self.capacity - space)
                        self.leave(space - left * x, first + full, 1)
                        full, left = full + 1, 0
                    if full < n:
                        self.leave(space, first + full, n - full)


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, first rank, ranks, first sequence, places a sequence, offset of the first place).

    Ranks first..first+ranks-1 of that length go to sequences first sequence, first sequence + 1, ...;
    `places` of them to each, one behind the other from the offset on. Linear grouping with `groups`
    groups, half or twice as many, or none (then all lengths are small ones, fitted longest first),
    whichever gives the fewest sequences: rounding up costs room that a finer plan may save."""
    best: _Plan | None = None
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    for g in dict.fromkeys((groups, 0, groups // 2, 2 * groups)):
        p = _Plan(histogram, capacity)
        if g:
            p.group(g)
        p.fit()
        if best is None or p.sequences < best.sequences:
            best = p
        if best.sequences == least:  # no packing has fewer
            break
    return best.intervals if best else []


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """`pieces` (with doc_id, piece, length) and where each goes: sequence_id, offset.

    Ranks are dealt out by length and a salt, so a length that a third of all pieces share is
    counted and numbered in many tasks. `pieces` is read twice: it should be a written table.
    """
    spark = pieces.sparkSession
    salts = max(SALTS, -(-pieces.count() // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = materialise(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    intervals = plan(histogram, capacity)
    by: dict[int, list] = defaultdict(list)
    for x in intervals:
        by[x[0]].append(x[1:])
    table = {k: np.array(v, np.int64) for k, v in by.items()}
    held = spark.sparkContext.broadcast(table)  # bounded by lengths and configurations, not by documents
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    few = len(histogram) * salts <= BROADCAST_ROWS
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(before) if few else before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                t = held.value[int(x)]
                i = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                r = rank[own] - t[i, 0]
                sequence[own] = t[i, 2] + r // t[i, 3]
                offset[own] = t[i, 4] + r % t[i, 3] * x
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Pack all documents: one row a piece with its sequence and offset. No documents, no rows."""
    return pack(materialise(tokenize(docs, tokenizer, capacity), "packing-pieces"), capacity)
