"""What five filters remove alone, together and in every order.

Joint failures are counted for all 32 sets of filters (the product of the set's failure flags, summed over
documents); survivors, unique failures, redundancy and Shapley values follow from those counts by Möbius
inversion, so no order of filters is ever applied to a document.

Defined cases: a null text is empty (it fails A, and nothing else unless another empty text has a smaller
doc_id); a null source is the empty string; a null doc_id is smaller than none, so such a row never fails E and
has no labels; rows of one doc_id and one text fail E alike; several label rows of a doc_id count as good or
toxic if one of them says so; a table without rows gives no rows. Columns beyond doc_id, text, source and
those of labels are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
SPACE = " \t\n\x0b\x0c\r"
WEIGHTS = ("n", "good", "toxic")

MIN_WORDS = 200
MIN_DISTINCT = 50  # distinct words a hundred
MAX_CAPITALS = 2  # capitals a hundred code points
SYMBOLS = "[#$%&*|]"


def flags(text: Column) -> list[Column]:
    """Failures of A to D, 0 or 1."""
    words = F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words), 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(SYMBOLS)
    return [f.cast("int") for f in fails]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, A, B, C, D, E, good, toxic, n): documents by source, failures and labels.

    Only digests and flags are shuffled. The smallest doc_id of a text is found by an aggregation that combines
    before its shuffle and joined back on id and digest, so a text held by a third of all rows is no hot key;
    rows without an id are dealt by their digest."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.sha2(text, 256).alias("digest"), *[f.alias(c) for f, c in zip(flags(text), "ABCD")])
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]).withColumn("pad", F.lit(0))
    pad = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest", "source"), F.lit(1 << 16))).otherwise(0).cast("int")
    rows = materialise(rows.withColumn("pad", pad).join(marks, ["doc_id", "pad"], "left").drop("pad").fillna(0, ["good", "toxic"]), "filter-flags")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(1))
    rows = rows.join(least, ["digest", "doc_id"], "left").withColumn("E", (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int"))
    return rows.groupBy("source", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def joint_counts(failed: DataFrame) -> DataFrame:
    """(source, n, good, toxic): arrays of 32 joint-failure counts; place S counts documents that fail all filters of S.

    Failures come in at most 128 kinds a source, so the products are made of those and not of documents."""
    sets = F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))).alias("set")
    product = F.lit(1)
    for k, f in enumerate(FILTERS):
        product = product * F.when(F.getbit("set", F.lit(k)) == 1, F.col(f)).otherwise(1)
    weight = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    joint = failed.select("*", sets).groupBy("source", "set").agg(*[F.sum(product * w).alias(c) for c, w in weight.items()])
    held = F.array_sort(F.collect_list(F.struct("set", *WEIGHTS)))  # 32 entries
    return joint.groupBy("source").agg(held.alias("j")).select("source", *[F.col(f"j.{c}").alias(c) for c in WEIGHTS])


def sign(s: Column) -> Column:
    return 1 - 2 * (F.bit_count(s) % 2)


def survivors(joint: Column) -> Column:
    """Place P: documents that fail no filter of P, by Möbius inversion over the subsets of P."""
    part = lambda p: F.aggregate(F.transform(joint, lambda c, s: F.when(s.bitwiseAND(p) == s, sign(s) * c).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), part)


def unique_failures(joint: Column, f: Column) -> Column:
    """Documents that fail filter f (its place) and no other: inversion over the supersets of {f}."""
    terms = F.transform(joint, lambda c, s: F.when(F.getbit(s, f) == 1, -sign(s) * c).otherwise(0))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def shapley(joint: Column, f: Column) -> Column:
    """120 times the Shapley value of f in the game "documents removed by a set of filters", whose Harsanyi
    dividend of a set is its signed joint count, shared equally by its members (120 is divisible by 1 to 5)."""
    terms = F.transform(joint, lambda c, s: F.when(F.getbit(s, f) == 1, -sign(s) * c * 120 / F.bit_count(s)).otherwise(0).cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row
    a source, order of the filters and step."""
    bits = lambda order: [FILTERS.index(x) for x in order]
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.array(*[F.lit(k) for k in bits(o)]).alias("places")) for o in orders])
    out = joint_counts(failures(docs, labels)).withColumns({f"left_{c}": survivors(F.col(c)) for c in WEIGHTS})
    places = F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))
    out = out.withColumns({"unique": F.transform(places, lambda k: unique_failures(F.col("n"), k)), "values": F.transform(places, lambda k: shapley(F.col("n"), k))})
    out = out.withColumn("o", F.explode(steps)).select("*", "o.*").select("*", F.posexplode("places").alias("at", "place"))
    one = lambda k: F.pow(F.lit(2), k).cast("int")
    before = F.aggregate(F.slice("places", F.lit(1), F.col("at")), F.lit(0), lambda a, k: a + one(k))
    out = out.withColumns({"before": before, "one": one(F.col("place"))})
    gone = lambda c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", F.col("before") + F.col("one"))
    out = out.withColumns({f"gone_{c}": gone(c) for c in WEIGHTS})
    return out.select(
        F.col("source").alias("part"), "filter_order", (F.col("at") + 1).cast("int").alias("step"), F.get("left_n", F.col("before") + F.col("one")).alias("kept"), F.col("gone_n").alias("removed"), (F.get("n", F.col("one")) - F.col("gone_n")).alias("redundant"),
        F.get("unique", F.col("place")).alias("unique_fails"), F.col("gone_good").alias("good_lost"), F.col("gone_toxic").alias("toxic_lost"), F.get("values", F.col("place")).alias("shapley"),
    )


SQL = r"""WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
   coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY text), false)] AS f
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
kinds AS (SELECT part, good, toxic, f, count(*) AS n FROM fails GROUP BY ALL),
steps AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
places AS (SELECT *, list_transform(string_split(filter_order, ''), lambda x: ascii(x) - 64) AS pos FROM steps),
seen AS (SELECT part, filter_order, step, n, good, toxic, f[pos[step]] AS here, list_bool_or(list_transform(pos[1:step - 1], lambda k: f[k])) IS TRUE AS before, list_sum(list_transform(f, lambda x: x::INT)) AS fails FROM kinds, places),
rows AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, coalesce(sum(n) FILTER (WHERE NOT here AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE here AND before), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE here AND fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n * good) FILTER (WHERE here AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (WHERE here AND NOT before), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM rows"""
