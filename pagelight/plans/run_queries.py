"""Registered queries over runs of experiments, which are made from customers and their orders; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as I
from ..operators.order import numbered
from . import fixtures as D
from . import report as P
from .queries import _SCORED, _scored, query, words

RETRIEVERS = ["page_bm25", "text_encoder", "page_image", "page_multivector", "mixed"]
RERANKERS = ["None", "lexical", "cross_encoder", "vl_image"]
VLMS, EVIDENCE = ["vlm_8b", "vlm_30b"], ["page_text", "ocr", "full_page"]
FAMILIES = ["BM25 text reranking", "Text evidence encoder", "Image retriever", "Multi-vector", "Fusion"]
COMPONENTS = {"Family": "family", "Retriever": "retriever", "Reranker": "reranker", "VLM": "vlm", "Evidence": "evidence"}


def _configuration(sql: bool) -> dict[str, str]:
    """What a run is made of, by its customer's number, for DuckDB or for Spark."""
    div = lambda n: f"(o_custkey // {n})" if sql else f"(o_custkey div {n})"

    def pick(names: list[str], of: str) -> str:
        listed = ", ".join(f"'{n}'" for n in names)
        return f"[{listed}][1 + {of} % {len(names)}]" if sql else f"array({listed})[cast({of} % {len(names)} as int)]"

    return {"retriever": pick(RETRIEVERS, "o_custkey"), "family": pick(FAMILIES, "o_custkey"), "reranker": pick(RERANKERS, div(5)), "vlm": pick(VLMS, div(20)), "evidence": pick(EVIDENCE, div(40)), "series": div(120)}


def _mean_score(where: str) -> str:
    return f"cast(sum(CASE WHEN {where} THEN {_SCORE} END) as double) / count(CASE WHEN {where} THEN 1 END) / 1000"


_SCORE = "(o_orderkey * 7919 + o_custkey * 31) % 1000"
_MEANS = {
    "mean_f1": _mean_score("true"),
    "f1_gt_0_5": f"cast(sum(CASE WHEN {_SCORE} > 500 THEN 1 ELSE 0 END) as double) / count(*)",
    "multimodal_t_mean_f1": _mean_score("o_orderkey % 2 = 0"),
    "multimodal_f_mean_f1": _mean_score("o_orderkey % 2 = 1"),
    "latency_mean": "cast(sum(cast(o_totalprice as decimal(18, 2))) as double) / count(*) / 10000",
}


def _named(parts: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in parts.items()]


_RUN = f"""x AS (SELECT concat('run_', o_custkey) AS experiment, o_custkey AS k, {', '.join(_named(_configuration(True) | _MEANS))} FROM orders GROUP BY o_custkey)"""
_PAIR = f"""{_RUN}, p AS (SELECT concat(a.retriever, ' ', b.reranker, ' ', b.vlm, ' ', b.evidence, ' ', b.series) AS comparison, a.mean_f1 AS fa, b.mean_f1 AS fb, a.latency_mean AS la, b.latency_mean AS lb FROM x a JOIN x b ON a.reranker = 'None' AND b.reranker <> 'None' AND a.retriever = b.retriever AND a.vlm = b.vlm AND a.evidence = b.evidence AND a.series = b.series),
ab AS (SELECT comparison, fa AS mean_f1_no, fb AS mean_f1_with, round(fb - fa, 6) AS delta_mean_f1, la AS latency_no, lb AS latency_with, round(lb - la, 6) AS delta_latency, CASE WHEN fb > fa AND lb > la THEN 'Quality improves, latency increases' ELSE 'Mixed' END AS verdict FROM p)"""


def runs(spark, d):
    """A run a customer: what it is made of follows from its number, its means from the customer's orders."""
    out = D.table(spark, d, "orders").groupBy("o_custkey").agg(*[F.expr(e).alias(name) for name, e in _MEANS.items()])
    return out.selectExpr("concat('run_', o_custkey) AS experiment", "o_custkey AS k", *_named(_configuration(False)), *_MEANS)


def _pairs(spark, d):
    x = runs(spark, d)
    same = ["retriever", "vlm", "evidence", "series"]
    name = F.concat_ws(" ", "retriever", "reranker", "vlm", "evidence", "series")
    return x.where("reranker = 'None'").select(*same, F.col("experiment").alias("without")).join(x.where("reranker <> 'None'").select(*same, name.alias("comparison"), F.col("experiment").alias("with")), same).select("comparison", "without", "with")


@query(f"WITH {_PAIR} SELECT * FROM ab")
def paired_ablation(spark, d):
    """RPT3: every run without a reranker against those with one that are alike otherwise."""
    return P.ablation(runs(spark, d), _pairs(spark, d))


@query(f"WITH {_PAIR} SELECT round(avg(delta_mean_f1), 6) AS mean_delta_f1, round(avg(delta_latency), 6) AS mean_delta_latency, arg_min(comparison, (-delta_mean_f1, comparison)) AS best_f1_gain, arg_min(comparison, (delta_latency, comparison)) AS least_latency FROM ab")
def ablation_summary(spark, d):
    """AGG14."""
    return P.ablation_summary(P.ablation(runs(spark, d), _pairs(spark, d)))


_UNPIVOT = " UNION ALL ".join(f"SELECT '{name}' AS component, {c} AS value, * FROM x" for name, c in COMPONENTS.items())


@query(f"""WITH {_RUN}, u AS ({_UNPIVOT})
SELECT component, value, count(*) AS count_experiments, round(max(mean_f1), 6) AS max_mean_f1, round(avg(mean_f1), 6) AS mean_mean_f1, round(avg(f1_gt_0_5), 6) AS mean_f1_gt_0_5, round(avg(multimodal_t_mean_f1), 6) AS mean_mm_t_f1, round(avg(multimodal_f_mean_f1), 6) AS mean_mm_f_f1, round(avg(latency_mean), 6) AS mean_latency, arg_min(experiment, (-mean_f1, experiment)) AS best_experiment FROM u GROUP BY component, value""")
def component_aggregation(spark, d):
    """AGG12, AGG13: five components."""
    return P.component_aggregation(runs(spark, d), COMPONENTS)


_DERIVED = f"{_RUN}, y AS (SELECT *, round(coalesce(multimodal_t_mean_f1, 0) - coalesce(multimodal_f_mean_f1, 0), 6) AS mm_gap, round(mean_f1 / nullif(ln(1 + greatest(latency_mean, 0)), 0), 6) AS balanced_score FROM x)"


@query(f"WITH {_DERIVED} SELECT vlm, count(*) AS count_experiments, round(avg(multimodal_t_mean_f1), 6) AS mean_mm_t_f1, round(avg(multimodal_f_mean_f1), 6) AS mean_mm_f_f1, round(avg(mm_gap), 6) AS mean_mm_gap, arg_min(experiment, (-coalesce(multimodal_f_mean_f1, -1), experiment)) AS best_mmf_experiment FROM y GROUP BY vlm")
def modality_by_vlm(spark, d):
    """AGG13."""
    return P.modality_by(runs(spark, d), "vlm")


@query(f"""WITH {_DERIVED} SELECT 'Best quality' AS category, arg_min(experiment, (-mean_f1, experiment)) AS experiment FROM y
UNION ALL SELECT 'Best speed', arg_min(experiment, (mean_f1 < 0.65, latency_mean, experiment)) FROM y UNION ALL SELECT 'Best balanced', arg_min(experiment, (-coalesce(balanced_score, -1), experiment)) FROM y
UNION ALL SELECT 'Best text-only baseline', arg_min(experiment, (CASE family WHEN 'BM25 text reranking' THEN 0 WHEN 'Text evidence encoder' THEN 1 ELSE 2 END, -mean_f1, experiment)) FROM y UNION ALL SELECT 'Best no-reranker variant', arg_min(experiment, (reranker <> 'None', -mean_f1, experiment)) FROM y""")
def recommendations(spark, d):
    """RPT2, RPT4."""
    return P.recommendations(runs(spark, d))


@query(f"""WITH {_DERIVED}, z AS (SELECT *, max(mean_f1) OVER () AS top FROM y), r AS (SELECT 'best' AS category, arg_min(experiment, (-mean_f1, experiment)) AS experiment FROM z UNION ALL SELECT 'near_best_fast', arg_min(experiment, (latency_mean, experiment)) FROM z WHERE mean_f1 >= top - 0.01
UNION ALL SELECT 'balanced', arg_min(experiment, (-balanced_score, experiment)) FROM z WHERE mean_f1 >= 0.67 UNION ALL SELECT 'fast', arg_min(experiment, (latency_mean, experiment)) FROM z WHERE mean_f1 >= 0.65) SELECT * FROM r WHERE experiment IS NOT NULL""")
def run_choices(spark, d):
    """TOP6."""
    return P.choices(runs(spark, d))


@query(f"WITH {_RUN} SELECT experiment, mean_f1, latency_mean, CASE WHEN contains(retriever, 'multivector') OR contains(retriever, 'colvision') THEN 'multi-vector' WHEN contains(retriever, 'image') THEN 'image embedding' WHEN contains(retriever, 'encoder') THEN 'text embedding' WHEN contains(retriever, 'bm25') THEN 'bm25' ELSE 'other' END AS family, row_number() OVER (ORDER BY -mean_f1, experiment) AS position FROM x")
def experiment_ranking(spark, d):
    """WIN8, RPT5, TOP4."""
    x = runs(spark, d).withColumns({"down": -F.col("mean_f1"), "family": P.family(F.col("retriever"))})
    return numbered(x, ["down", "experiment"], "position").select("experiment", "mean_f1", "latency_mean", "family", "position")


_ROUTED = "r AS (SELECT query_id, f1, latency, CASE query_id % 4 WHEN 0 THEN 'high_confidence' WHEN 1 THEN 'table_or_text' WHEN 2 THEN 'visual' END AS route, query_id % 4 = 0 AS skipped, CASE WHEN query_id % 4 <> 0 THEN latency / 4 END AS rerank_latency FROM mt)"
_ROUTE = "count(*) AS questions, round(avg(f1), 6) AS mean_f1, round(avg(latency), 6) AS mean_latency, round(avg(rerank_latency), 6) AS mean_rerank_latency, count(*) FILTER (skipped) AS skipped, round(count(*) FILTER (skipped) / count(*), 6) AS skipped_share"


@query(f"WITH {_SCORED}, {_ROUTED} SELECT coalesce(route, 'unknown') AS route, {_ROUTE} FROM r GROUP BY 1 UNION ALL SELECT 'all', {_ROUTE} FROM r")
def route_report(spark, d):
    """AGG16."""
    route = F.expr("CASE query_id % 4 WHEN 0 THEN 'high_confidence' WHEN 1 THEN 'table_or_text' WHEN 2 THEN 'visual' END")
    m = _scored(spark, d).withColumns({"route": route, "skipped": F.expr("query_id % 4 = 0"), "rerank_latency": F.expr("CASE WHEN query_id % 4 <> 0 THEN latency / 4 END")})
    return P.route_report(m)


_BASE = {"best": (0.6, 2.5), "no_reranker": (0.4, 1.5), "fast_fusion": (0.5, 2.0)}
_GRID = "g AS (SELECT unnest([20, 30, 40])::DOUBLE AS t1), g2 AS (SELECT unnest([1, 5, 10])::DOUBLE AS gap_t), gr AS (SELECT t1, gap_t, f1, exact_match, qtype, latency, query_id % 53 >= t1 AND query_id % 17 >= gap_t AS skipped FROM mt, g, g2)"


@query(f"""WITH {_SCORED}, {_GRID} SELECT t1, gap_t, round(avg(f1), 6) AS mean_f1, round(avg(latency), 6) AS latency_mean, round(avg(exact_match), 6) AS exact_match, round(avg((f1 > 0.5)::INT), 6) AS f1_gt_0_5, round(avg(f1) FILTER (qtype = 'multimodal-t'), 6) AS mm_t_f1, round(avg(f1) FILTER (qtype = 'multimodal-f'), 6) AS mm_f_f1,
round(avg(skipped::INT), 6) AS skip_rate, count(*) FILTER (skipped) AS number_skipped, count(*) FILTER (NOT skipped) AS number_reranked, round(quantile_cont(latency, 0.5), 6) AS latency_p50, round(quantile_cont(latency, 0.95), 6) AS latency_p95,
{', '.join(f"round(avg(f1) - {q}::DOUBLE, 6) AS quality_delta_vs_{n}, round(avg(latency) - {t}::DOUBLE, 6) AS latency_delta_vs_{n}" for n, (q, t) in _BASE.items())} FROM gr GROUP BY t1, gap_t""")
def grid_result(spark, d):
    """RPT8: every answer under nine pairs of thresholds, against three baselines."""
    grid = spark.createDataFrame([(float(a), float(b)) for a in (20, 30, 40) for b in (1, 5, 10)], "t1 double, gap_t double")
    m = _scored(spark, d).select("query_id", "f1", "exact_match", "qtype", "latency")
    return P.grid_rows(m.crossJoin(F.broadcast(grid)).withColumn("skipped", F.expr("query_id % 53 >= t1 AND query_id % 17 >= gap_t")), _BASE)


def _most(lists: dict[str, list[str]], none: str) -> str:
    counts = [f"len(list_filter({words(*terms)}, lambda x: contains(lower(question), x)))" for terms in lists.values()]
    best = f"list_max([{', '.join(counts)}])"
    return f"CASE WHEN {best} = 0 THEN '{none}' ELSE {words(*lists)}[list_position([{', '.join(counts)}], {best})] END"


_LIMITS = "MAP {" + ", ".join(f"'{d} {k}': [{', '.join(map(str, v))}]" for d, kinds in I.CONTEXT_LIMITS.items() for k, v in kinds.items()) + "}"


@query(f"WITH {D.ASKED}, c AS (SELECT query_id, {_most(I.QUESTION_KINDS, 'text')} AS kind, {_most(I.DOMAINS, 'academic')} AS domain FROM k), l AS (SELECT *, {_LIMITS}[domain || ' ' || kind] AS m FROM c) SELECT query_id, kind, domain, m[1]::BIGINT AS max_pages, m[2]::BIGINT AS max_tables, m[3]::BIGINT AS max_images FROM l")
def question_classes(spark, d):
    """PRD16."""
    q = D.asked(spark, d).select("query_id", I.question_kind(F.col("question")).alias("kind"), I.question_domain(F.col("question")).alias("domain"))
    return q.select("*", I.context_limits(F.col("kind"), F.col("domain")).alias("m")).select("query_id", "kind", "domain", "m.*")
