"""Ranking: top-k, normalisation, fusion, neighbours, votes, aggregation of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(score: str, ties: list[str]) -> list[Column]:
    return [F.col(score).desc_nulls_last(), *[F.col(t).asc() for t in ties]]


def top_k(df: DataFrame, k: int | None, by: list[str] = ["query_id"], score: str = "score", ties: list[str] = ["doc_id", "page"], rank: str = "rank") -> DataFrame:
    """The k best rows of each group and their rank. Plans to a group limit before the shuffle."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*_order(score, ties))))
    return out if k is None else out.where(F.col(rank) <= k)


def min_max(score: Column, by: list[str] = ["query_id"], constant: float = 1.0) -> Column:
    """FUS1: scores of a group to 0..1 over its finite values; non-finite ones become 0, equal ones `constant`."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    w = Window.partitionBy(*by)
    lo, hi = F.min(F.when(finite, score)).over(w), F.max(F.when(finite, score)).over(w)
    return F.when(~F.coalesce(finite, F.lit(False)), 0.0).when(hi - lo <= 1e-12, constant).otherwise((score - lo) / (hi - lo))


def rrf(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None, top: int | None = None, ids: list[str] = ["doc_id", "page"]) -> DataFrame:
    """FUS7 and FUS8: reciprocal rank fusion of ranked lists (query_id, ids, rank); one shuffle of their union."""
    whole = None
    for n, df in enumerate(lists):
        part = df.select("query_id", *ids, (F.lit(1.0 if weights is None else weights[n]) / (k + F.col("rank"))).alias("part"), F.lit(n).alias("module"))
        whole = part if whole is None else whole.unionByName(part)
    fused = whole.groupBy("query_id", *ids).agg(F.sum("part").alias("score"), F.min("module").alias("first_module"), F.count("*").alias("n_modules"))
    return top_k(fused.withColumn("score", F.round("score", 12)), top, ties=ids)


def weighted_fusion(df: DataFrame, alpha=1.0, beta=0.2, gamma=1.0, number=0.05, keyword=0.05, phrase=0.05, header=0.20) -> DataFrame:
    """FUS6 over (score, text_rerank_score, rerank_score) and the four feature columns; ranks 1..n."""
    out = df.withColumns({
        "retrieval_norm": min_max(F.col("score")),
        "text_norm": min_max(F.coalesce(F.col("text_rerank_score"), F.lit(0.0))),
        "image_norm": min_max(F.coalesce(F.col("rerank_score"), F.lit(0.0))),
    })
    base = alpha * F.col("retrieval_norm") + beta * F.col("text_norm") + gamma * F.col("image_norm")
    boost = number * F.col("number_match") + keyword * F.col("keyword_match") + phrase * F.col("exact_phrase_match") + header * F.col("table_header_match")
    out = out.withColumns({"base_score": F.round(base, 9), "boost_score": F.round(boost, 9), "fusion_score": F.round(base + boost, 9)})
    return top_k(out, None, score="fusion_score", ties=["rank"], rank="fusion_rank")


def neighbours(df: DataFrame, pages: DataFrame, radius: int = 1, limit: int | None = None) -> DataFrame:
    """CND1: pages beside the candidates, if they exist; the first to bring a page wins; beside ones score 0.8.

    df: (query_id, doc_id, page, score, rank); pages: (doc_id, page)."""
    out = df.withColumn("delta", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("page", F.col("page") + F.col("delta")).where("page >= 1")
    out = out.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    first = Window.partitionBy("query_id", "doc_id", "page").orderBy("rank", "delta")
    out = out.withColumn("n", F.row_number().over(first)).where("n = 1")
    out = out.select("query_id", "doc_id", "page", F.when(F.col("delta") == 0, F.col("score")).otherwise(F.col("score") * 0.8).alias("score"), F.col("rank").alias("source_rank"), "delta")
    return top_k(out, limit, ties=["source_rank", "delta"])


def neighbours_in_order(df: DataFrame, pages: DataFrame, radius: int = 1) -> DataFrame:
    """CND2: as neighbours, in candidate order, scores unchanged."""
    out = df.withColumn("neighbor_delta", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("page", F.col("page") + F.col("neighbor_delta")).where("page >= 1")
    out = out.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id", "page").orderBy("rank", "neighbor_delta"))).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("rank", "neighbor_delta")
    return out.select("query_id", "doc_id", "page", "score", "neighbor_delta", F.row_number().over(order).alias("rank"))


def vote(df: DataFrame, k: int, least: int = 1) -> DataFrame:
    """CND3: the most frequent document among the first k (ties: best rank) comes first with all its pages,
    then the other seeds; the seeds alone if it has fewer than `least` of them."""
    seed = df.where(F.col("rank") <= k)
    counts = seed.groupBy("query_id", "doc_id").agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "best")
    winner = counts.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", F.col("doc_id").alias("winner"), "votes")
    out = df.join(winner, "query_id")
    of_winner = (F.col("doc_id") == F.col("winner")) & (F.col("votes") >= least)
    out = out.where(of_winner | (F.col("rank") <= k)).withColumn("late", (~of_winner).cast("int"))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id", "page").orderBy("rank"))).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("late", "rank")
    return out.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query_id", "doc_id", "page", "score", F.col("new_rank").alias("rank"), "votes")


def tiles_to_pages(df: DataFrame) -> DataFrame:
    """CND4: best tile of each page, plus 0.001 for each of up to five more. A row stands for n tiles if there is a column n."""
    tiles = F.sum("n") if "n" in df.columns else F.count("*")
    out = df.groupBy("query_id", "doc_id", "page").agg(F.max("score").alias("best"), tiles.alias("tiles"), F.max_by("tile", F.struct("score", -F.col("tile"))).alias("tile"))
    score = F.col("best") + F.when(F.col("tiles") > 1, 0.001 * F.least(F.col("tiles") - 1, F.lit(5))).otherwise(0.0)
    return top_k(out.withColumn("score", score).drop("best"), None)


def tile_modes(df: DataFrame, by: list[str]) -> DataFrame:
    """CND5: tiles to pages or documents by maximum, mean of the best three and five, and reciprocal ranks."""
    w = Window.partitionBy("query_id", *by).orderBy(F.col("score").desc(), "tile")
    out = df.withColumn("n", F.row_number().over(w)).groupBy("query_id", *by)
    mean = lambda k: F.avg(F.when(F.col("n") <= k, F.col("score")))
    return out.agg(F.max("score").alias("max_score"), mean(3).alias("mean3"), mean(5).alias("mean5"), F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"), F.count("*").alias("hits"))


def dehub(df: DataFrame, doc_penalty: float = 0.05, page_penalty: float = 0.02, k: int = 10) -> DataFrame:
    """RRK10: scores less the log of how often a document and a page stand in the first k of any query."""
    near = df.where(F.col("rank") <= k)
    docs = near.groupBy("doc_id").agg(F.count("*").alias("doc_hits"))
    pages = near.groupBy("doc_id", "page").agg(F.count("*").alias("page_hits"))
    out = df.join(docs, "doc_id", "left").join(pages, ["doc_id", "page"], "left").fillna(0, ["doc_hits", "page_hits"])
    score = F.col("score") - doc_penalty * F.log1p("doc_hits") - page_penalty * F.log1p("page_hits")
    return top_k(out.withColumn("dehub_score", F.round(score, 9)), None, score="dehub_score", ties=["rank"], rank="dehub_rank")


def page_labels(df: DataFrame) -> DataFrame:
    """CND7: "doc/page" labels of a query in rank order."""
    label = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    return df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))), lambda x: x["label"]), ",").alias("labels"))


def normalised(df: DataFrame, k: int, constant: float = 1.0) -> DataFrame:
    """RET13: fusion_score or score, to 0..1 where a query has spread and more than one row, clamped, cut."""
    w = Window.partitionBy("query_id")
    n, lo, hi = F.count("*").over(w), F.min("score").over(w), F.max("score").over(w)
    score = F.when((n > 1) & (hi > lo), (F.col("score") - lo) / (hi - lo)).otherwise(F.col("score"))
    return top_k(df.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9)), k, ties=["rank"], rank="new_rank")
