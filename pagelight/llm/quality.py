"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams.

Counts come from trusted text (labelled quality 1 and not toxic), all of it but a held-out fold.
Every order's counts, history sums and probabilities are DataFrame aggregations and joins by
n-gram. For scoring the model is dealt into shards by the two bytes before the predicted one; a
shard has about SHARD_ROWS rows, so its broadcast is bounded however large the model grows. Documents
are joined to one shard after the other, each adding the positions that are its own; sums are written
between two shards, and a shard's broadcast goes before the next is made, so that neither the driver
nor a worker ever holds two.

A document's perplexity is exp of its mean negative log probability a byte, drawn towards its
language's median by PRIOR bytes, so that short texts aren't judged on little evidence. It is
rejected where that exceeds its language's limit: the QUANTILE of held-out trusted documents times
1 + SLACK. A language with fewer held-out documents than a parameter (MIN_HELD by default) has no
quantile of its own to speak of and takes the limit over all languages; the column limit_of says which.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, claim, drop, materialise, slices

ORDER = 5
HELD_OUT = 5  # one trusted document in so many sets limits and trains nothing
QUANTILE = 0.99
SLACK = 0.05
PRIOR = 100
MIN_HELD = 20
SHARD_ROWS = 4_000_000
BROADCAST_IDS = 2_000_000  # trusted ids are broadcast up to here, joined by a shuffle beyond
NONE = 1.0  # stands for a probability that there isn't; logarithms are 0 at most
_MASK = [(1 << (8 * k)) - 1 for k in range(9)]


def _padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each behind ORDER - 1 zero bytes; the places of texts' bytes in it; the text of each."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(raw)) + (doc + 1) * (ORDER - 1)
    out = np.zeros(len(raw) + len(n) * (ORDER - 1), np.uint64)
    out[place] = raw
    return out, place, doc


def _keys(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each place, as one number."""
    key = np.zeros(len(place), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        key = key << np.uint64(8) | padded[place - k]
    return key


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(key, c) of the highest order over column text; combined in the worker, then before the shuffle."""

    def run(batches):
        claim("quality")
        for batch in batches:
            raw, off = buffers(batch.column(0))
            for lo, hi in slices(off, 1_000_000):
                padded, place, _ = _padded(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                key, c = np.unique(_keys(padded, place), return_counts=True)
                yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(c)], names=["key", "c"])

    return texts.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * after / now if now else 0.5 * k for k, now, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05 * k), 0.99 * k) for k, x in zip((1, 2, 3), d))  # type: ignore[return-value]


def train(texts: DataFrame) -> DataFrame:
    """The model: (n, key, logp, logbow). logbow is the weight that a history gives to the order below it.

    n is the order; rows of n = 0 hold the weight of the empty history. Without text it has no rows.
    """
    counts = materialise(count_ngrams(texts), "ngrams")
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct bytes before an n-gram
        now = orders[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(_MASK[k])).alias("key")).agg(F.count("*").alias("c"))
        orders[k] = materialise(now, f"continuations-{k}")
    below: DataFrame | None = None
    tables, bows = {}, {}
    for k in range(1, ORDER + 1):
        d = discounts({r["c"]: r["n"] for r in orders[k].where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()})
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = orders[k].withColumn("h", F.shiftright("key", 8)).withColumn("cut", cut)
        history = t.groupBy("h").agg(F.sum("c").alias("total"), F.sum("cut").alias("given")).select("h", "total", (F.col("given") / F.col("total")).alias("bow"))
        bows[k - 1] = history.select(F.col("h").alias("key"), F.log("bow").alias("logbow"))
        t = t.join(history, "h").withColumn("low", F.col("key").bitwiseAND(F.lit(_MASK[k - 1])))
        own = (F.col("c") - F.col("cut")) / F.col("total")
        t = t.select("key", (own + F.col("bow") / 256).alias("p")) if below is None else t.join(below, "low").select("key", (own + F.col("bow") * F.col("p_low")).alias("p"))
        tables[k] = t = materialise(t, f"probabilities-{k}")
        below = t.select(F.col("key").alias("low"), F.col("p").alias("p_low"))
    rows = bows[0].select(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("logp"), "logbow")
    bows[ORDER] = bows[0].limit(0)
    for k in range(1, ORDER + 1):
        t = tables[k].select(F.lit(k).alias("n"), "key", F.log("p").alias("logp"))
        # a history of bytes before the text is no n-gram itself: a weight without a probability
        both = t.drop("n").join(bows[k], "key", "full").select(F.lit(k).alias("n"), "key", F.coalesce("logp", F.lit(NONE)).alias("logp"), F.coalesce("logbow", F.lit(0.0)).alias("logbow"))
        rows = rows.unionByName(both if k < ORDER else t.withColumn("logbow", F.lit(0.0)))
    model = materialise(rows, "model")
    for t in [*orders.values(), *tables.values()]:
        drop(t)
    return model


class Lookup:
    """An open-addressing table from 64-bit keys to rows of values."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.values = [np.zeros(size, np.float32) for _ in values]
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[first]
            self.keys[slot[who]] = keys[left[who]]
            for mine, given in zip(self.values, values):
                mine[slot[who]] = given[left[who]]
            rest = np.ones(len(left), bool)
            rest[who] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the key is there."""
        slot = self._slot(keys)
        at = self.keys[slot]
        hit = at == keys
        open_ = np.flatnonzero(~hit & (at >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            same = at == keys[open_]
            hit[open_[same]] = True
            open_ = open_[~same & (at >= 0)]
        return slot, hit


class Shard:
    def __init__(self, n: np.ndarray, key: np.ndarray, logp: np.ndarray, logbow: np.ndarray):
        self.tables = [Lookup(key[n == k], logp[n == k], logbow[n == k]) for k in range(ORDER + 1)]

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each key, given those before."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            t = self.tables[k]
            now = (keys[left] & np.uint64(_MASK[k])).astype(np.int64)
            slot, hit = t.find(now)
            hit &= t.values[0][slot] < NONE
            out[left[hit]] += t.values[0][slot[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            t = self.tables[k - 1]
            slot, hit = t.find(now >> 8)
            out[left[hit]] += t.values[1][slot[hit]]
        out[left] -= math.log(256)
        return out


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs' columns, then n_bytes and nll (sum of negative log probabilities, natural) of each text; 0 for null or empty."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // SHARD_ROWS))
    names = docs.columns
    out, before = docs.withColumn("_nll", F.lit(0.0)), None
    for s in range(shards):
        # bytes before the predicted one: the last two of a history, the two above the last of an n-gram
        own = (F.col("n") <= 2) if shards > 1 else F.lit(True)
        pair = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
        history = F.col("key").bitwiseAND(F.lit(0xFFFF))
        part = model.where(own | (F.pmod(pair, F.lit(shards)) == s) | ((F.col("n") < ORDER) & (F.pmod(history, F.lit(shards)) == s))).toArrow()
        held = spark.sparkContext.broadcast([part.column(c).to_numpy() for c in ("n", "key", "logp", "logbow")])
        out = out.mapInArrow(_scorer(held, s, shards, names.index("text"), len(names)), out.schema)
        if s < shards - 1:
            out = materialise(out, "scored-by-shard")
            held.destroy()
            if before is not None:
                drop(before)
            before = out
    return out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumnRenamed("_nll", "nll")


def _scorer(held, s: int, shards: int, text: int, nll: int):
    def run(batches):
        claim("quality")
        shard = Shard(*held.value)
        for batch in batches:
            raw, off = buffers(batch.column(text))
            total = np.zeros(batch.num_rows)
            for lo, hi in slices(off, 250_000):
                padded, place, doc = _padded(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                keys = _keys(padded, place)
                if shards > 1:
                    own = (keys >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(shards) == s
                    keys, doc = keys[own], doc[own]
                total[lo:hi] = np.bincount(doc, shard.score(keys), hi - lo)
            columns = list(batch.columns)
            columns[nll] = pa.array(columns[nll].to_numpy(zero_copy_only=False) - total)
            yield pa.record_batch(columns, schema=batch.schema)

    return run


def classify(docs: DataFrame, labels: DataFrame, carry: bool = False, min_held: int = MIN_HELD) -> DataFrame:
    """Perplexity, limit and decision of every document, one row a row of `docs`.

    (doc_id, lang, n_bytes, perplexity, threshold, limit_of, kept); with `carry` docs' columns come first,
    those of the same names replaced. limit_of: "language", or "all" where a language has fewer than
    `min_held` held-out trusted documents and the quantile over all languages stands in.
    Labels: rows with quality 1 and toxic not 1 name trusted documents; nulls and repeats don't count.
    A null or empty text has the median perplexity of its language and is kept; without any trusted
    text every document is kept and the figures are null. Null languages form a group of their own.
    """
    spark = docs.sparkSession
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    trusted = materialise(trusted, "trusted-ids")
    small = trusted.count() <= BROADCAST_IDS
    ids = F.broadcast(trusted) if small else trusted
    fold = F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT))
    model = train(docs.select("doc_id", "text").join(ids.where(fold != 0), F.col("doc_id") == F.col("trusted_id"), "left_semi"))
    source = docs.drop("_nll", "nll", "n_bytes", "perplexity", "threshold", "limit_of", "kept") if carry else docs.select("doc_id", "text", "lang")
    scored = score(source, model)
    if not carry:
        scored = materialise(scored.drop("text"), "scores")
    else:
        scored = materialise(scored, "scored-documents")
    entropy = F.when(F.col("n_bytes") > 0, F.col("nll") / F.col("n_bytes"))
    held = scored.select("doc_id", "lang", "n_bytes", "nll", entropy.alias("entropy")).join(ids.where(fold == 0), F.col("doc_id") == F.col("trusted_id"), "left_semi").where("n_bytes > 0")
    # one row a language: few, and bounded by the number of language codes
    middle = held.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 10000).alias("mid"), F.count("*").alias("n"))
    all_ = held.agg(F.percentile_approx("entropy", 0.5, 10000).alias("mid_all")).first()["mid_all"]
    if all_ is None:  # no held-out text: the model's own mean serves, and nothing is rejected
        limits, middles, rest = {}, {}, None
    else:
        middles = {r["lang"]: r["mid"] for r in middle.collect() if r["n"] >= min_held}
        drawn = (F.col("nll") + PRIOR * _by_language(middles, all_)) / (F.col("n_bytes") + PRIOR)
        q = held.select("lang", drawn.alias("drawn"))
        rest = q.agg(F.percentile_approx("drawn", QUANTILE, 10000).alias("q")).first()["q"]
        limits = {r["lang"]: r["q"] for r in q.groupBy("lang").agg(F.percentile_approx("drawn", QUANTILE, 10000).alias("q")).collect() if r["lang"] in middles}
    if rest is None:
        figures = scored.select("*", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("string").alias("limit_of"), F.lit(True).alias("kept"))
    else:
        drawn = (F.col("nll") + PRIOR * _by_language(middles, all_)) / (F.col("n_bytes") + PRIOR)
        scope = F.lit("all")
        for lang in limits:
            scope = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit("language")).otherwise(scope)
        limit = _by_language(limits, rest) + F.log(F.lit(1 + SLACK))
        figures = scored.select("*", F.exp(drawn).alias("perplexity"), F.exp(limit).alias("threshold"), scope.alias("limit_of"), (drawn <= limit).alias("kept"))
    if carry:
        return figures
    return figures.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", "limit_of", "kept")


def _by_language(values: dict, rest: float) -> F.Column:
    out = F.lit(float(rest))
    for lang, x in values.items():
        out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(float(x))).otherwise(out)
    return out
