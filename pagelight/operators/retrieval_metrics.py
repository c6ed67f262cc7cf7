"""Metrics of ranked lists: rows (query_id, doc_id[, page], rank) against relevant ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import table_heavy

from .ranking import dehub


def _marked(ranked: DataFrame, relevant: DataFrame, ids: list[str]) -> DataFrame:
    """Ranked rows with hit 0 or 1."""
    rel = relevant.select("query_id", *ids).distinct().withColumn("hit", F.lit(1))
    return ranked.join(rel, ["query_id", *ids], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def precision_recall(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int, ids: list[str] = ["doc_id"]) -> DataFrame:
    """RTM1: distinct hits in the first k over k, and over the relevant (0 without any)."""
    hits = _marked(ranked.where(F.col("rank") <= k), relevant, ids).where("hit = 1").groupBy("query_id").agg(F.count_distinct(*ids).alias("hits"))
    total = relevant.groupBy("query_id").agg(F.count_distinct(*ids).alias("relevant"))
    out = queries.select("query_id").join(hits, "query_id", "left").join(total, "query_id", "left").fillna(0)
    return out.select("query_id", F.round(F.col("hits") / k, 9).alias("precision"), F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0), 9).alias("recall"))


def average_precision(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, ids: list[str] = ["doc_id"]) -> DataFrame:
    """RTM2: running hits over rank at each hit, summed over the number of relevant ones."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    part = _marked(ranked, relevant, ids).withColumn("part", F.when(F.col("hit") == 1, F.sum("hit").over(w) / F.col("rank")).otherwise(0.0))
    total = relevant.groupBy("query_id").agg(F.count_distinct(*ids).alias("relevant"))
    out = queries.select("query_id").join(part.groupBy("query_id").agg(F.sum("part").alias("s")), "query_id", "left").join(total, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce(F.try_divide("s", "relevant"), F.lit(0.0)), 9).alias("average_precision"))


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, cutoff: int | None = None, ids: list[str] = ["doc_id"]) -> DataFrame:
    """RTM3, RTM5: 1 over the first relevant rank, else 0."""
    hits = _marked(ranked if cutoff is None else ranked.where(F.col("rank") <= cutoff), relevant, ids)
    first = hits.where("hit = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 9).alias("rr"))


def ndcg(ranked: DataFrame, graded: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RTM4: gains over log2(rank + 1) in the first k, over those of the best order of all graded documents.

    graded: (query_id, doc_id, gain)."""
    gain = ranked.where(F.col("rank") <= k).join(graded, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    best = graded.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("n") + 1)).alias("ideal"))
    out = queries.select("query_id").join(gain, "query_id", "left").join(best, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)), 9).alias("ndcg"))


def hit_at(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int], ids: list[str] = ["doc_id"]) -> DataFrame:
    """RTM6, RTM7, RTM8: whether a gold row is among the first k; null for queries without gold."""
    hits = _marked(ranked, gold, ids).groupBy("query_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hit_{k}") for k in ks])
    known = gold.select("query_id").distinct().withColumn("known", F.lit(1))
    out = queries.select("query_id").join(known, "query_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", *[F.when(F.col("known") == 1, F.coalesce(f"hit_{k}", F.lit(0)).cast("double")).alias(f"hit_{k}") for k in ks])


def page_hit_any_document(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """RTM7 as published numbers have it: a page number counts on any document."""
    return hit_at(ranked, gold, queries, ks, ["page"])


def selected_hits(questions: DataFrame, selected: DataFrame, oracle: DataFrame, tables: DataFrame) -> DataFrame:
    """RTM8: (query_id, doc_hit, page_hit, table_hit) of the pages selected for each question.

    questions: (query_id, question, doc_id), the expected document; selected: (query_id, doc_id, page); oracle and tables:
    (query_id, page), pages of the expected document. Null where nothing is expected; without table pages a question
    that asks for tables has its page hit."""
    mine = selected.join(questions.select("query_id", F.col("doc_id").alias("expected")), "query_id").where("doc_id = expected").select("query_id", "page")
    docs = mine.select("query_id").distinct().withColumn("doc", F.lit(1.0))

    def hits(pages: DataFrame, name: str) -> DataFrame:
        pages = pages.select("query_id", "page").distinct()
        there = pages.join(mine.distinct().withColumn("hit", F.lit(1.0)), ["query_id", "page"], "left")
        return there.groupBy("query_id").agg(F.coalesce(F.max("hit"), F.lit(0.0)).alias(name))

    out = questions.join(docs, "query_id", "left").join(hits(oracle, "page_hit"), "query_id", "left").join(hits(tables, "own_table"), "query_id", "left")
    table = F.coalesce("own_table", F.when(table_heavy(F.col("question")), F.col("page_hit")))
    return out.select("query_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("doc", F.lit(0.0))).alias("doc_hit"), "page_hit", table.alias("table_hit"))


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """AGG17: the k values that occur most, with their counts; of equal counts the smaller value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def recall_curve(ranked: DataFrame, gold_docs: DataFrame, gold_pages: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """RTM9: share of queries whose gold document is in the first k (of all), and gold page (of those that have one)."""
    rank_of = lambda gold, ids, name: _marked(ranked, gold, ids).where("hit = 1").groupBy("query_id").agg(F.min("rank").alias(name))
    have = gold_pages.select("query_id").distinct().withColumn("has_page", F.lit(1))
    q = queries.select("query_id").join(rank_of(gold_docs, ["doc_id"], "doc_rank"), "query_id", "left").join(rank_of(gold_pages, ["doc_id", "page"], "page_rank"), "query_id", "left").join(have, "query_id", "left")
    whole = q.agg(*[F.round(F.avg(F.coalesce((F.col("doc_rank") <= k).cast("double"), F.lit(0.0))), 9).alias(f"doc_{k}") for k in ks], *[F.round(F.avg(F.when(F.col("has_page") == 1, F.coalesce((F.col("page_rank") <= k).cast("double"), F.lit(0.0)))), 9).alias(f"page_{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"doc_{k}").alias("doc_recall"), F.col(f"page_{k}").alias("page_recall")) for k in ks])
    return whole.select(F.inline(rows))


def hubness(ranked: DataFrame, queries: DataFrame, k: int = 10, top: int = 10) -> DataFrame:
    """RTM10, AGG17: documents by how many queries have them first and among the first k; the most frequent."""
    n = queries.agg(F.count("*").alias("n"))
    out = ranked.where(F.col("rank") <= k).groupBy("doc_id").agg(F.sum((F.col("rank") == 1).cast("long")).alias("top1"), F.count("*").alias("topk")).crossJoin(F.broadcast(n))
    w = Window.orderBy(F.desc("topk"), "doc_id")
    out = out.orderBy(F.desc("topk"), "doc_id").limit(top)  # a top-k report
    return out.select("doc_id", "top1", "topk", F.round(F.col("topk") / F.col("n"), 9).alias("share"), F.row_number().over(w).alias("position"))


def dehub_recall(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int], **penalties) -> DataFrame:
    """RTM11: hits of the raw and the dehubbed ranking side by side."""
    new = dehub(ranked, **penalties).select("query_id", "doc_id", "page", F.col("dehub_rank").alias("rank"))
    mean = lambda df, name: hit_at(df, gold, queries, ks).agg(*[F.round(F.avg(f"hit_{k}"), 9).alias(f"hit_{k}") for k in ks]).withColumn("ranking", F.lit(name))
    return mean(ranked, "raw").unionByName(mean(new, "dehub"))


def vector_diagnostics(vectors: DataFrame) -> DataFrame:
    """RTM12: norms, mean standard deviation of a dimension, rows that repeat another to six places."""
    from .retrieval import dot

    norms = vectors.agg(F.count("*").alias("n"), *[F.round(f(F.sqrt(dot("vec", "vec"))), 6).alias(f"norm_{name}") for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])
    dims = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.stddev_pop(F.col("x").cast("double")).alias("s")).agg(F.round(F.avg("s"), 6).alias("mean_std"), F.count("*").alias("dims"))
    rounded = vectors.groupBy(F.transform("vec", lambda x: F.bround(x.cast("double"), 6)).alias("v")).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicates"))
    return norms.crossJoin(dims).crossJoin(rounded)


def score_gaps(ranked: DataFrame, k: int = 10) -> DataFrame:
    """RTM13: spread of each query's scores, and the first less the fifth and the last."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    r = lambda c, name: F.round(c, 6).alias(name)
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(r(F.min("score"), "min"), r(F.avg("score"), "mean"), r(F.max("score"), "max"), r(F.stddev_pop("score"), "std"), r(at(1) - at(5), "gap5"), r(at(1) - F.min("score"), "gap_last"))


def shift_audit(vectors: DataFrame, window: int = 2) -> DataFrame:
    """RTM14: for each vector (doc_id, page, vec), the most similar other page of its document within a
    window of pages; the offsets' counts. A band join, as an equi-join on exploded neighbours."""
    from .retrieval import dot, unit

    v = vectors.select("doc_id", "page", unit("vec").alias("v"))
    near = v.withColumn("other", F.explode(F.filter(F.sequence(F.col("page") - window, F.col("page") + window), lambda p: p != F.col("page"))))
    pairs = near.join(v.select("doc_id", F.col("page").alias("other"), F.col("v").alias("w")), ["doc_id", "other"])
    best = pairs.groupBy("doc_id", "page").agg(F.max_by(F.col("other") - F.col("page"), F.struct(F.round(dot("v", "w"), 9), -F.col("other"))).alias("shift"))
    return best.groupBy("shift").agg(F.count("*").alias("n"))
