"""Merkle trees of texts: roots test equality, branches that differ locate edits.

Leaves are the pieces of a text's paragraphs (lines): at most PIECE code points, a paragraph's newlines at the
end of its last one, so that pieces begin anew with every paragraph and cover the text. A piece that ends in an
empty line, or whose hash ends in 0 as one in sixteen does, ends a section, so an edit moves no bounds of
sections but its own. A leaf's hash is the first half of its SHA-256; a section's is that of its leaves' hashes, and
the root is the SHA-256 of the sections' hashes.

A fingerprint is a string: the root, then for every section "/", its hash in 16 digits, ":" and 8 digits of every
leaf's hash. The likeness of two fingerprints is 1 if their roots are equal, else the share of the nodes (leaves,
sections, root) of either tree that stand in both.

Defined cases: a null text is empty; an empty text has a root and no sections, and is like another empty text
only. The next document is that of the next greater doc_id, null ids first; rows of one doc_id follow one another in
the order of a digest, and rows that repeat doc_id and text are each other's next but for the last one. After the
last comes the first, and a single row is its own next. A table without rows gives no rows; other columns are
ignored. Everything is built from DataFrame functions; rows that repeat doc_id and text meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PIECE = 64
PIECES = rf"[^\n]{{1,{PIECE}}}\n*|\n+"
NODE, SECTION, LEAF = 32, 16, 8  # hexadecimal digits that are hashed, shown of a section, shown of a leaf
ROOT = 64


def digest(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, NODE)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and the fingerprint of a text column. Each level of the tree is a projection of its own, for Spark to
    compute it once."""
    leaf = lambda x: F.concat(digest(x), F.when(F.endswith(x, F.lit("\n\n")), ".").otherwise(""))
    out = df.withColumn("_leaves", F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0)), leaf))
    out = out.withColumn("_sections", F.filter(F.split(F.array_join("_leaves", ","), "(?<=[0.]),"), lambda s: s != ""))
    out = out.withColumn("_nodes", F.transform("_sections", digest))
    leaves = lambda s: F.regexp_replace(s, rf"([0-9a-f]{{{LEAF}}})[0-9a-f]{{{NODE - LEAF}}}\.?,?", "$1")
    shown = F.zip_with("_nodes", "_sections", lambda n, s: F.concat(F.substring(n, 1, SECTION), F.lit(":"), leaves(s)))
    return out.withColumn(name, F.array_join(F.concat(F.array(F.sha2(F.array_join("_nodes", "/"), 256)), shown), "/")).drop("_leaves", "_sections", "_nodes")


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, ROOT)


def nodes(fingerprint: Column) -> Column:
    """The hashes that a fingerprint shows."""
    below = F.regexp_extract_all(F.substring(fingerprint, ROOT + 1, 1 << 30), F.lit(rf"[0-9a-f]{{{SECTION}}}(?=:)|[0-9a-f]{{{LEAF}}}"), F.lit(0))
    return F.concat(F.array(root(fingerprint)), below)


def likeness_of(a: Column, b: Column, same: Column) -> Column:
    """Likeness by the nodes of two trees, and whether their roots are the same."""
    return F.when(same, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    return likeness_of(nodes(a), nodes(b), root(a) == root(b))


def edits(a: Column, b: Column) -> Column:
    """Where the first text of two differs: array of (section, leaves), the numbers from 0 of the sections of `a` whose
    hash no section of `b` has, and in each of them those of the leaves that no section of `b` has."""
    parts = lambda x: F.slice(F.split(x, "/"), 2, 1 << 30)
    leaves = lambda s: F.regexp_extract_all(F.substring(s, SECTION + 2, 1 << 30), F.lit(rf"[0-9a-f]{{{LEAF}}}"), F.lit(0))
    there = F.transform(parts(b), lambda s: F.substring(s, 1, SECTION))
    held = F.flatten(F.transform(parts(b), leaves))
    changed = lambda s: F.filter(F.transform(leaves(s), lambda x, i: F.when(~F.array_contains(held, x), i)), lambda i: i.isNotNull())
    listed = F.transform(parts(a), lambda s, i: F.when(~F.array_contains(there, F.substring(s, 1, SECTION)), F.struct(i.alias("section"), changed(s).alias("leaves"))))
    return F.filter(listed, lambda x: x.isNotNull())


def followers(ids: DataFrame) -> DataFrame:
    """ids (doc_id, key, times, n_chars) and next_key, the key that follows in the order of doc_id and key.

    Ids are dealt out in ranges and written with their range's number, so a window sees one range alone; the
    last of a range is followed by the first of the next, which come as one row of as many entries as there are
    ranges."""
    placed = materialise(ids.repartitionByRange("doc_id", "key").withColumn("place", F.spark_partition_id()), "ranges")
    firsts = placed.groupBy("place").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key"))
    heads = firsts.agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("heads"))
    later = F.get(F.filter("heads", lambda h: h["place"] > F.col("place")), 0)["key"]
    after = F.lead("key").over(Window.partitionBy("place").orderBy("doc_id", "key"))
    return placed.withColumn("next_key", after).crossJoin(F.broadcast(heads)).withColumn("next_key", F.coalesce("next_key", later, F.get("heads", 0)["key"])).drop("place", "heads")


def compare_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Whole texts are shuffled once, by a digest of id and text; a text's beginning and fingerprint, which the
    document before it needs, once more."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256)))
    ids = materialise(keyed.groupBy("doc_id", "key", F.length("text").alias("n_chars")).agg(F.count("*").alias("times")), "ids")
    texts = keyed.select("key", "text").repartition("key").distinct()
    to = F.struct(F.col("next_key").alias("key"), F.lit(1).cast("long").alias("rows"))
    again = F.struct("key", (F.col("times") - 1).alias("rows"))  # rows that repeat are each other's next
    links = followers(ids).select(F.col("key").alias("to"), "doc_id", "n_chars", F.explode(F.filter(F.array(to, again), lambda x: x["rows"] > 0)).alias("x")).select("to", "doc_id", F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"), "x.*")
    given = with_fingerprint(texts.join(links, "key"), "text", "next_fingerprint")
    given = given.select(F.col("to").alias("key"), "doc_id", "quarter", "rows", F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("begins"), "next_fingerprint")
    out = with_fingerprint(texts.join(given, "key"), "text", "fingerprint").withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int")), "begins"))
    out = with_fingerprint(out, "edited", "edited_fingerprint").withColumns({f"_{c}": nodes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    near = lambda c: likeness_of(F.col("_fingerprint"), F.col(f"_{c}"), root(F.col("fingerprint")) == root(F.col(c)))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"), "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")
