"""Retrieval: BM25 in three forms, dense and multi-vector search, cascades, document routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks
from .ranking import min_max, top_k

#: Rows up to which a query side is broadcast; beyond, the join shuffles on its term.
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> bool:
    """Whether df is small enough for a broadcast; at most BROADCAST_ROWS + 1 of its rows are made to find out."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if it is small; its size is checked."""
    return F.broadcast(df) if few(df) else df


class Bm25:
    """RET1: an index over (doc_id, page, text): postings with document lengths, and one row of totals.

    Postings hold dl beside tf, so a search joins query terms with postings and nothing else. `terms`
    limits postings to the terms of known queries before the shuffle; document frequencies and
    lengths are those of the whole corpus all the same."""

    def __init__(self, corpus: DataFrame, terms: DataFrame | None = None):
        pages = corpus.select("doc_id", "page", T.bm25_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).withColumn("dl", F.size("tokens"))
        self.totals = pages.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
        words = pages.select("doc_id", "page", "dl", F.explode("tokens").alias("term"))
        if terms is not None:
            words = words.join(small(terms.select("term").distinct()), "term", "left_semi")
        self.postings = words.groupBy("doc_id", "page", "dl", "term").agg(F.count("*").alias("tf"))
        self.frequencies = self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, idf: str = "plus_one", scope: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, page, score > 0) of queries (query_id, term, qf). scope: (query_id, doc_id) pairs
        to which scoring is limited; statistics stay global (RET4)."""
        n, df, dl, tf = F.col("n"), F.col("df"), F.col("dl"), F.col("tf")
        known = queries.join(self.frequencies, "term").crossJoin(F.broadcast(self.totals))
        if idf == "plus_one":
            known = known.withColumn("idf", F.log1p((n - df + 0.5) / (df + 0.5)))
        else:  # Okapi: terms that most documents hold take a quarter of the mean idf
            raw = F.log((n - df + 0.5) / (df + 0.5))
            mean = self.frequencies.crossJoin(F.broadcast(self.totals)).agg(F.avg(raw).alias("mean_idf"))
            known = known.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(raw < 0, 0.25 * F.col("mean_idf")).otherwise(raw))
        # known has a row for each of the query's terms at most, so the query's size says whether to broadcast it
        known = known.select("query_id", "term", "qf", "idf", "avgdl")
        hits = self.postings.join(F.broadcast(known) if few(queries) else known, "term")
        if scope is not None:
            hits = hits.join(scope.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(F.col("avgdl"), F.lit(1e-9)))) * F.col("qf")
        return hits.groupBy("query_id", "doc_id", "page").agg(F.round(F.sum(part), 9).alias("score"))

    def search(self, queries: DataFrame, k: int = 30, **options) -> DataFrame:
        """RET2: the k best pages of each query; only scores above 0."""
        return top_k(self.scores(queries, **options).where("score > 0"), k)


def query_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, qf) of questions (query_id, question)."""
    return questions.select("query_id", F.explode(T.bm25_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def serving_search(index: Bm25, queries: DataFrame, k: int = 5, k1: float = 2.5, b: float = 0.9) -> DataFrame:
    """RET3: Okapi scores to 0..1 over all documents of the corpus (those without a query term score 0), kept above 0.01.

    A query that matches nothing returns nothing."""
    scores = index.scores(queries, k1, b, idf="okapi")
    w = Window.partitionBy("query_id")
    lo, hi = F.least(F.min("score").over(w), F.when(F.count("*").over(w) < F.col("n"), F.lit(0.0))), F.max("score").over(w)
    scores = scores.crossJoin(F.broadcast(index.totals)).withColumns({"lo": lo, "hi": hi}).where("hi > 0")
    score = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return top_k(scores.withColumn("score", F.round(score, 9)).where("score > 0.01").select("query_id", "doc_id", "page", "score"), k)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    """A vector over its length (at least 1e-12)."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, score: str = "dot") -> DataFrame:
    """RET5, RET6, RET10: exhaustive inner product of (query_id, vec) with (doc_id, page, vec), both over their length.

    score: dot, or half (dot + 1) / 2. Vectors that are null, hold null or non-finite numbers or have another length
    than a query are not found by it; neither do such queries find anything."""
    return top_k(blocks.scores(queries, vectors, ("vec", "vec"), k, half=score == "half"), k)


def max_sim(queries: DataFrame, pages: DataFrame, k: int = 10) -> DataFrame:
    """RET7: late interaction: for each query token the best dot product with a page's tokens, summed.

    queries: (query_id, tok, vec), one array a query; pages: (doc_id, page, vecs array<array>), in shards or not."""
    q = queries.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "vec"))), lambda x: x["vec"]).alias("qs"))
    return top_k(blocks.scores(q, pages, ("qs", "vecs"), k, over_length=False), k)


def cascade(lexical: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """RET9: 0.3 of the lexical score and 0.7 of (dot + 1) / 2 over the lexical candidates, to 0..1 a query."""
    out = lexical.join(vectors.select("doc_id", unit("vec").alias("v")), "doc_id").join(small(queries.select("query_id", unit("vec").alias("q"))), "query_id")
    out = out.withColumn("mixed", 0.3 * F.col("score") + 0.7 * (dot("q", "v") + 1) / 2)
    return top_k(out.select("query_id", "doc_id", "page", F.round(min_max(F.col("mixed")), 9).alias("score")), k)


def centroids(vectors: DataFrame) -> DataFrame:
    """(doc_id, vec): the mean of each document's vectors, over its length."""
    mean = vectors.select("doc_id", F.posexplode("vec").alias("dim", "x")).groupBy("doc_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("vec"))


def route_documents(queries: DataFrame, vectors: DataFrame, mode: str, k: int = 5) -> DataFrame:
    """RET18: documents by centroid, best page, or the mean of the best five pages."""
    if mode == "centroid":
        return dense_search(queries, centroids(vectors).withColumn("page", F.lit(0)), k).drop("page")
    best = 5 if mode == "top5" else 1
    pages = blocks.group_scores(queries, vectors, ("vec", "vec"), ["doc_id", "page"], ["doc_id"], best)
    if mode == "top5":
        pages = top_k(pages, best, by=["query_id", "doc_id"], ties=["page"])
    fold = F.avg("score") if mode == "top5" else F.max("score")
    return top_k(pages.groupBy("query_id", "doc_id").agg(F.round(fold, 9).alias("score")), k, ties=["doc_id"])


def in_document(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """RET17: pages of the gold document in order of inner product; queries: (query_id, gold_doc, vec)."""
    out = vectors.select("doc_id", "page", unit("vec").alias("v")).join(queries.select("query_id", F.col("gold_doc").alias("doc_id"), unit("vec").alias("q")), "doc_id")
    return top_k(out.select("query_id", "doc_id", "page", F.round(dot("q", "v"), 9).alias("score")), None)


def answer_pages(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """RET15: pages of the gold document that hold an answer. questions: (query_id, doc_id, answer, evidence).

    Exact containment, share of the answer's numbers (also without %), share of the keywords of answer
    and evidence; kept if exact, some number, or a quarter of the keywords."""
    from ..functions.numbers import oracle_numbers

    q = questions.select("query_id", "doc_id", T.oracle_text(F.col("answer")).alias("a"), F.array_distinct(oracle_numbers(T.text_of(F.col("answer")))).alias("numbers"), F.array_distinct(F.concat(T.keywords(F.col("answer")), T.keywords(F.col("evidence")))).alias("keys"))
    p = corpus.join(small(q.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "page", T.oracle_text(F.col("text")).alias("t")).withColumns({"page_numbers": oracle_numbers(F.col("t")), "page_keys": F.array_distinct(T.keywords(F.col("t")))})
    out = p.join(small(q), "doc_id")
    hit = F.filter("numbers", lambda n: F.array_contains("page_numbers", n) | F.array_contains("page_numbers", F.regexp_replace(n, "%+$", "")))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(0.0)
    out = out.select("query_id", "doc_id", "page", ((F.col("a") != "") & F.contains("t", "a")).alias("exact_answer"), F.round(share(hit, F.col("numbers")), 9).alias("number_recall"), F.round(share(F.array_intersect("keys", "page_keys"), F.col("keys")), 9).alias("keyword_recall"))
    out = out.where("exact_answer or number_recall > 0 or keyword_recall >= 0.25")
    order = Window.partitionBy("query_id").orderBy(F.desc("exact_answer"), F.desc("number_recall"), F.desc("keyword_recall"), "page")
    return out.withColumn("rank", F.row_number().over(order))
