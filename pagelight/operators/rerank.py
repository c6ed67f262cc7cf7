"""Reranking: lexical, injected scorers, fusion features, adaptive and threshold routes."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import numbers as N
from ..functions import text as T
from .ranking import top_k

#: Scorers by name: (question, text) -> column. RRK4: models are added by register().
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"lexical": lambda q, t: T.jaccard(T.lexical_tokens(q), T.lexical_tokens(t))}


def register(name: str, scorer: Callable[[Column, Column], Column]) -> None:
    """Add a scorer of (question, text)."""
    SCORERS[name] = scorer


_models: dict[str, object] = {}  # of this worker process, by name


def once(name: str, load: Callable[[], object]) -> object:
    """A model of this worker process; loaded when it is first asked for, and kept as long as Spark keeps the worker (RRK9)."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def model_scorer(name: str, load: Callable[[], object], batch_size: int = 16) -> Callable[[Column, Column], Column]:
    """RRK3, RRK5: a scorer around a model, for register().

    load() gives an object whose predict(pairs) returns a score a pair, or None for one that can't be scored (as an
    image that can't be opened); it is called once a worker, and not at all where no row is. Pairs go to the model in
    batches of like length, so that little of a batch is padding; scores come back in the rows' order. Null texts
    are empty; a model that returns another number of scores is an error; NaN counts as no score."""

    @F.pandas_udf("double")
    def score(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in rows:
            pairs = list(zip(questions.fillna("").astype(str), texts.fillna("").astype(str)))
            out = np.full(len(pairs), np.nan)
            order = np.argsort([len(q) + len(t) for q, t in pairs], kind="stable")
            for lo in range(0, len(pairs), batch_size):
                part = order[lo : lo + batch_size]
                found = once(name, load).predict([pairs[i] for i in part])
                if len(found) != len(part):
                    raise ValueError(f"{name}: {len(found)} scores for {len(part)} pairs")
                out[part] = [np.nan if x is None else float(x) for x in found]
            yield pd.Series(out)

    return lambda q, t: F.nanvl(score(q, t), F.lit(None).cast("double"))


def rerank(df: DataFrame, scorer: str = "lexical", text: str = "text", drop_unscored: bool = False) -> DataFrame:
    """RRK2, RRK3, RRK5: rows (query_id, question, rank, text) ordered anew; ties keep their order.

    drop_unscored leaves out rows without a score, as for images that can't be opened."""
    out = df.withColumn("rerank_score", F.round(SCORERS[scorer](F.col("question"), F.col(text)), 9))
    out = out.where("rerank_score is not null") if drop_unscored else out
    return top_k(out, None, score="rerank_score", ties=["rank"], rank="rerank_rank")


def truncate(c: Column, most: int) -> Column:
    """EVD8."""
    return F.lit("") if most <= 0 else F.substring(T.text_of(c), 1, most)


def number_match(q: Column, e: Column) -> Column:
    """FUS2."""
    a, b = N.fusion_numbers(q), N.fusion_numbers(e)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def keyword_match(q: Column, e: Column) -> Column:
    """FUS3."""
    a = F.array_except(T.fusion_tokens(q), T.words(*T.FUSION_STOP))
    return F.size(F.array_intersect(a, T.fusion_tokens(e))) / F.greatest(F.size(a), F.lit(1))


def phrase_match(q: Column, e: Column) -> Column:
    """FUS4: share of the question's 5-, 4- or 3-token runs that are substrings of the evidence's joined tokens; the best n."""
    tokens, joined = T.fusion_tokens(q), F.array_join(T.fusion_tokens(e), " ")

    def share(n: int) -> Column:
        total = F.size(tokens) - n + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
        return F.when(total >= 1, F.size(F.filter(runs, lambda r: F.contains(joined, r))) / F.greatest(total, F.lit(1))).otherwise(0.0)

    return F.when((F.size(tokens) < 3) | (joined == ""), 0.0).otherwise(F.greatest(share(5), share(4), share(3)))


def header_match(q: Column, e: Column) -> Column:
    """FUS5: an explicit reference decides alone; else words of tables, figures and metrics add up."""
    question, evidence = F.lower(T.text_of(q)), F.lower(T.text_of(e))
    pattern = r"\b(table|figure|fig\.?|chart|graph)\s*(\d+[a-z]?)\b"
    labels, numbers = (F.regexp_extract_all(question, F.lit(pattern), F.lit(k)) for k in (1, 2))
    needles = F.zip_with(labels, numbers, lambda a, n: F.concat_ws(" ", F.when(F.replace(a, F.lit("."), F.lit("")) == "fig", "figure").otherwise(F.replace(a, F.lit("."), F.lit(""))), n))
    tokens = T.fusion_tokens(question)
    has = lambda *names: F.arrays_overlap(tokens, T.words(*names))
    says = lambda *names: F.exists(T.words(*names), lambda x: F.contains(evidence, x))
    score = F.when(has("table", "row", "column", "accuracy", "score", "f1", "ppl", "bleu") & says("[table_text]", "table "), 0.5).otherwise(0.0)
    score = score + F.when(has("figure", "fig", "chart", "graph", "plot", "diagram") & says("[caption]", "figure ", "fig ", "chart ", "graph "), 0.5).otherwise(0.0)
    metrics = ("accuracy", "score", "f1", "ppl", "bleu", "wer", "auc")
    score = score + F.when(has(*metrics) & says(*metrics), 0.25).otherwise(0.0)
    return F.when(F.size(needles) > 0, F.exists(needles, lambda x: F.contains(evidence, x)).cast("double")).otherwise(F.least(score, F.lit(1.0)))


def fusion_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df (question, text) and the four features, rounded to nine places."""
    q, e = F.col("question"), F.col(text)
    parts = {"number_match": number_match, "keyword_match": keyword_match, "exact_phrase_match": phrase_match, "table_header_match": header_match}
    return df.withColumns({name: F.round(f(q, e).cast("double"), 9) for name, f in parts.items()})


def confidence(df: DataFrame) -> DataFrame:
    """WIN3: (query_id, top1, top2, gap, relative_gap, n) of ranked candidates."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    out = df.groupBy("query_id").agg(at(1).alias("top1"), at(2).alias("top2"), F.count("*").alias("n"))
    return out.withColumns({"gap": F.col("top1") - F.col("top2"), "relative_gap": I.relative_gap(F.col("top1"), F.col("top2"))})


STRATEGIES = {"high_confidence": "none", "table_or_text": "text_image", "visual": "image", "unknown": "text_image"}


def adaptive(df: DataFrame, scorers: dict[str, Callable[[Column, Column], Column]], t1: float | None = None, gap: float | None = None) -> DataFrame:
    """RRK7: routes each query by its question, type and confidence, and reranks by its route's strategy.

    df: (query_id, question, qtype, doc_id, page, score, rank, text). A strategy without a scorer
    passes its candidates on and counts as skipped."""
    w = Window.partitionBy("query_id")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score"))).over(w)
    out = df.withColumn("route", I.route(F.col("question"), F.col("qtype"), I.confident(at(1), at(2), t1, gap)))
    strategy, score, known = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(False)
    for route, name in STRATEGIES.items():
        here = F.col("route") == route
        strategy = F.when(here, name).otherwise(strategy)
        if name in scorers:
            score = F.when(here, scorers[name](F.col("question"), F.col("text"))).otherwise(score)
            known = known | here
    out = out.withColumns({"strategy": strategy, "skipped": ~known, "rerank_score": F.round(score.cast("double"), 9)})
    return top_k(out, None, score="rerank_score", ties=["rank"], rank="new_rank")


def threshold_skip(df: DataFrame, scorer: Callable[[Column, Column], Column], t1: float, gap: float) -> DataFrame:
    """RRK8: queries that are sure keep their order, the others are reranked; with the reason."""
    stats = confidence(df).withColumn("reason", I.skip_reason(F.col("top1"), F.col("top2"), t1, gap))
    out = df.join(stats.select("query_id", "reason"), "query_id")
    skip = F.col("reason") == "top1_and_gap_passed"
    out = out.withColumn("skipped", skip).withColumn("rerank_score", F.when(~skip, F.round(scorer(F.col("question"), F.col("text")).cast("double"), 9)))
    return top_k(out, None, score="rerank_score", ties=["rank"], rank="new_rank")
