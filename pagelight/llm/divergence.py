"""How the sources of a language differ in their terms.

With p = 1 + floor(10**9 (count + 5) / (N + 5 V)) and z a group's p of an absent term, the distance of two
groups, the sum of |p - q| over all V kept terms of the language, follows from inclusion and exclusion over
the terms that either holds: V |z - z'| for all terms; for either group the change |p - z'| - |z - z'| of each
term it holds, which depends on the count alone and is priced from the group's histogram of counts; and, for
terms that both hold, |p - q| - |p - z'| - |z - q| + |z - z'|, from a join of postings. No group is ever laid
out over all terms.

Defined cases: null text, language and source are empty strings; a group without kept terms has N = 0; a
language without kept terms (V = 0) has distance 0 between its sources and no rows of terms; a row without text
still makes its group occur; repeated rows are documents of their own; a table without rows gives no rows. Other
columns are ignored. Counts and sums are 64-bit integers, products beyond them decimals; nothing is rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, materialise

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms
MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
HELD = 400_000  # rows of counts that a task holds before it passes them on
FEW_GROUPS = 20_000  # groups up to which their sizes are broadcast

POSTINGS = "lang string, term string, posts array<struct<source:string, cnt:bigint, docs:bigint>>"


def _terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, cnt, docs) of a batch of (lang, source, text)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), pattern=BETWEEN)
    doc, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    there = pc.not_equal(term, "")
    coded = term.filter(there).dictionary_encode()
    width = max(1, len(coded.dictionary))
    key, count = np.unique(doc.filter(there).to_numpy().astype(np.int64) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    doc = pa.array(key // width)
    rows = pa.table({"lang": batch.column(0).take(doc), "source": batch.column(1).take(doc), "term": coded.dictionary.take(pa.array(key % width)), "cnt": pa.array(count, pa.int64()), "docs": pa.array(np.ones(len(key), np.int64))})
    return _summed([rows])


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("cnt", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "cnt_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "cnt", "docs"])


def _by_term(rows: pa.Table) -> list[pa.RecordBatch]:
    """A row a term: its sources share the key, which is most of what is shuffled."""
    lists = rows.group_by(["lang", "term"]).aggregate([("source", "list"), ("cnt", "list"), ("docs", "list")]).combine_chunks()
    out = []
    for b in lists.to_batches(max_chunksize=50_000):
        source = b.column("source_list")
        parts = [b.column(f"{c}_list").flatten() for c in ("source", "cnt", "docs")]
        offsets = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(source).to_numpy())]).astype(np.int32))
        posts = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["source", "cnt", "docs"]))
        out.append(pa.record_batch([b.column("lang"), b.column("term"), posts], names=["lang", "term", "posts"]))
    return out


def _count(batches):
    claim("divergence")
    held: list[pa.Table] = []
    for batch in batches:
        held.append(_terms(batch))
        if sum(t.num_rows for t in held) > HELD:
            held = [_summed(held)]
            if held[0].num_rows > HELD // 2:
                yield from _by_term(held.pop())
    if held:
        yield from _by_term(_summed(held))


def kept_postings(docs: DataFrame) -> DataFrame:
    """(lang, term, source, cnt, total) of the terms that MIN_DOCS documents of their language hold; total: the language's count.

    Tasks count their texts' terms before the one shuffle by language and term; a term then has a row a source."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    posts = texts.mapInArrow(_count, POSTINGS).repartition("lang", "term").select("lang", "term", F.inline("posts"))
    counts = posts.groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    return counts.withColumns({"total": F.sum("cnt").over(w), "all_docs": F.sum("docs").over(w)}).where(F.col("all_docs") >= MIN_DOCS).select("lang", "term", "source", "cnt", "total")


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (n + 5 v)), exactly; null if v is 0."""
    over, under = count.cast("long") + SMOOTH, n + SMOOTH * v
    under = F.when(v > 0, under)
    exact = lambda a, b: F.call_function("div", a, b)
    return 1 + F.when(over <= (1 << 63) // SCALE - 1, exact(over * SCALE, under)).otherwise(exact(over.cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), under.cast("decimal(38,0)")))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language, and the TOP terms
    that a source uses more than its language does.

    Sizes of groups are broadcast where a count of the written table finds few."""
    kept = materialise(kept_postings(docs), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("cnt").alias("n"))
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = materialise(groups.withColumn("z", F.coalesce(probability(F.lit(0), F.col("n"), F.col("v")), F.lit(0))), "groups")
    few = F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups
    priced = kept.join(few, ["lang", "source"]).withColumn("p", probability(F.col("cnt"), F.col("n"), F.col("v")))

    this = lambda df: df.select("lang", *[F.col(c).alias(f"{c}_a") for c in df.columns if c not in ("lang", "term", "v")], *(["term"] if "term" in df.columns else []))
    that = lambda df: df.select("lang", *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in ("lang", "term")], *(["term"] if "term" in df.columns else []))
    p, q, z, y = F.col("p_a"), F.col("p_b"), F.col("z_a"), F.col("z_b")
    apart = F.abs(z - y)
    ordered = F.col("source_a") < F.col("source_b")
    pair = lambda value: (F.col("lang"), "source_a", "source_b", value.alias("value"))
    sized = groups.select("lang", "source", "z", "v")
    constant = this(sized).join(that(sized), "lang").where(ordered).select(*pair(F.col("v_b") * apart))
    histogram = priced.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("h"))
    one_sided = this(histogram).join(that(sized), "lang").where(F.col("source_a") != F.col("source_b")).select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), (F.col("h_a") * (F.abs(p - y) - apart)).alias("value"))
    posts = priced.select("lang", "source", "z", "p", "term")
    both = this(posts).join(that(posts), ["lang", "term"]).where(ordered).select(*pair(F.abs(p - q) - F.abs(p - y) - F.abs(z - q) + apart))
    parts = [x.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")) for x in (constant, one_sided, both)]
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x")).select("lang", "x.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    more = priced.withColumn("value", F.col("p") - probability(F.col("total"), F.col("lang_n"), F.col("v"))).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named(pairs, "pair").unionByName(named(more, "term"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN langs USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
laid AS (SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (s.n + 5 * s.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
  FROM sizes s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM laid a JOIN laid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INT AS rank FROM laid WHERE c > 0 AND p > q QUALIFY rank <= 50"""
