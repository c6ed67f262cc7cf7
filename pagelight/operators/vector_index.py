"""Vector indexes in shards, and whether an index finds what it holds (SRC10, SNK7, RET19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .retrieval import dot, unit


def write_shards(pages: DataFrame, path: str, per_shard: int = 100_000) -> None:
    """SNK7: pages (doc_id, page, vecs array<array>) in shards of about `per_shard` pages, and a table `metadata`
    (doc_id, page, shard, tokens, dim). Refused if vecs are null or empty, or their vectors differ in dimension."""
    sizes = F.transform("vecs", lambda v: F.coalesce(F.size(v), F.lit(-1)))
    of = pages.agg(F.count("*").alias("n"), F.min(F.array_min(sizes)).alias("low"), F.max(F.array_max(sizes)).alias("high"), F.count_if(F.coalesce(F.size("vecs"), F.lit(0)) < 1).alias("empty")).first()
    if of["n"] and (of["empty"] or of["low"] != of["high"] or of["low"] < 1):
        raise ValueError("pages need vectors, and all vectors one dimension")
    shards = max(1, -(-of["n"] // per_shard))
    out = pages.withColumn("shard", F.pmod(F.xxhash64("doc_id", "page"), F.lit(shards)).cast("int"))
    out.repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards")
    about = pages.sparkSession.read.parquet(f"{path}/shards") if of["n"] else out
    about.select("doc_id", "page", "shard", F.size("vecs").alias("tokens"), F.size(F.get("vecs", 0)).alias("dim")).write.mode("overwrite").parquet(f"{path}/metadata")


def read_shards(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """SRC10: (doc_id, page, vecs, shard) of all shards, or of some: others aren't read. An error if shards and metadata
    differ in their number of pages."""
    about = spark.read.parquet(f"{path}/metadata")
    if not about.limit(1).count():
        return about.select("doc_id", "page", F.lit(None).cast("array<array<double>>").alias("vecs"), "shard")
    out = spark.read.parquet(f"{path}/shards")
    if only is not None:
        about, out = about.where(F.col("shard").isin(only)), out.where(F.col("shard").isin(only))
    if about.count() != out.count():
        raise ValueError("shards and metadata differ in size")
    return out


def sampled(df: DataFrame, keys: list[str], samples: int, seed: int) -> DataFrame:
    """The `samples` rows whose keys hash lowest: the same ones for a seed however the table is laid out."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(samples)


def self_retrieval(stored: DataFrame, fresh: DataFrame, samples: int = 20, k: int = 5, seed: int = 53) -> DataFrame:
    """RET19: (doc_id, page, self_rank, stored_vs_fresh, hit_at_1, hit_at_k) of sampled pages.

    stored and fresh: (doc_id, page, vec), the index and pages encoded anew. A sampled page's fresh vector is the query;
    its rank counts the stored vectors that score higher, or as high with smaller doc_id and page. The sample is
    bounded by its parameter; all stored vectors count. A page without a sound vector on either side has no rank."""
    few = F.broadcast(sampled(stored.select("doc_id", "page"), ["doc_id", "page"], samples, seed).withColumn("query_id", F.struct("doc_id", "page")))
    asked = fresh.join(few, ["doc_id", "page"]).select(F.xxhash64("doc_id", "page").alias("query_id"), "doc_id", "page", "vec")
    own = stored.join(F.broadcast(asked.select("query_id", "doc_id", "page", F.col("vec").alias("f"))), ["doc_id", "page"])
    own = own.select("query_id", F.col("doc_id").alias("own_doc"), F.col("page").alias("own_page"), F.round(dot(unit("vec"), unit("f")), 9).alias("own"))
    scored = blocks.scores(asked.select("query_id", "vec"), stored, ("vec", "vec"), None).join(F.broadcast(own), "query_id")
    mine = (F.col("doc_id") == F.col("own_doc")) & (F.col("page") == F.col("own_page"))
    before = (F.col("score") > F.col("own")) | (F.col("score") == F.col("own")) & (F.struct("doc_id", "page") < F.struct(F.col("own_doc"), F.col("own_page")))
    ranks = scored.groupBy("query_id").agg((1 + F.count_if(before & ~mine)).alias("rank"), F.max(F.when(mine, F.col("own"))).alias("stored_vs_fresh"))
    rank = F.when(F.col("stored_vs_fresh").isNotNull(), F.col("rank"))
    out = few.select("doc_id", "page", F.xxhash64("doc_id", "page").alias("query_id")).join(ranks, "query_id", "left")
    hit = lambda n: F.coalesce(rank <= n, F.lit(False)).cast("int")
    return out.select("doc_id", "page", rank.alias("self_rank"), "stored_vs_fresh", hit(1).alias("hit_at_1"), hit(k).alias("hit_at_k"))


def self_recall(rows: DataFrame) -> DataFrame:
    """RET19: one row (samples, self_recall_at_1, self_recall_at_k, stored_vs_fresh_mean)."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(F.count("*").alias("samples"), F.round(F.sum("hit_at_1") / n, 6).alias("self_recall_at_1"), F.round(F.sum("hit_at_k") / n, 6).alias("self_recall_at_k"), F.round(F.avg("stored_vs_fresh"), 6).alias("stored_vs_fresh_mean"))


def aligned_cosine(a: Column, b: Column) -> Column:
    """Mean cosine of two lists of vectors, place by place; null if they differ in shape."""
    size = lambda v: F.coalesce(F.size(v), F.lit(-1))
    same = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: size(x) == size(y)), lambda s: s)
    each = F.zip_with(a, b, lambda x, y: dot(x, y) / F.greatest(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(1e-8)))
    return F.when(same & (F.size(a) > 0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def validate_pages(stored: DataFrame, fresh: DataFrame, samples: int = 20, seed: int = 53) -> DataFrame:
    """RET19: (doc_id, page, stored_tokens, fresh_tokens, shape_match, mean_aligned_cosine) of sampled pages (doc_id, page, vecs)."""
    few = F.broadcast(sampled(stored.select("doc_id", "page"), ["doc_id", "page"], samples, seed))
    out = stored.join(few, ["doc_id", "page"]).join(fresh.join(few, ["doc_id", "page"]).select("doc_id", "page", F.col("vecs").alias("new")), ["doc_id", "page"])
    cosine = aligned_cosine(F.col("vecs"), F.col("new"))
    return out.select("doc_id", "page", F.size("vecs").alias("stored_tokens"), F.size("new").alias("fresh_tokens"), cosine.isNotNull().alias("shape_match"), F.round(cosine, 9).alias("mean_aligned_cosine"))


def validation_summary(rows: DataFrame) -> DataFrame:
    """RET19: one row (samples, shape_match_rate, mean_aligned_cosine_mean, mean_aligned_cosine_min)."""
    c = "mean_aligned_cosine"
    return rows.agg(F.count("*").alias("samples"), F.round(F.count_if("shape_match") / F.greatest(F.count("*"), F.lit(1)), 6).alias("shape_match_rate"), F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.min(c), 6).alias(f"{c}_min"))
