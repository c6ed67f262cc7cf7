"""Registered queries of the serving operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..operators import retrieval as S
from ..operators import serving as V
from . import fixtures as D
from .queries import _CAND, _LEXSCORE, _SCORED, _candidates, _scored, query


@query(f"""WITH {D.dense_top(50)}, r AS (SELECT dt.query_id, dt.doc_id, dt.page, dt.rank AS first_rank, round(1 / (1 + list_sum(list_transform(list_zip(q.v, u.v), lambda z: abs(z[1] - z[2])))), 9) AS score FROM dt JOIN u USING (doc_id, page) JOIN u q ON q.vec_id = dt.query_id)
SELECT query_id, doc_id, page, first_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM r QUALIFY rank <= 10""")
def two_stage_search(spark, d):
    """RET8: fifty by inner product, ten by the sum of differences, which stands for a slower model."""
    nearness = lambda q, v: 1 / (1 + F.aggregate(F.zip_with(q, v, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    return V.two_stage(D.vector_queries(spark, d), D.vectors(spark, d), 10, nearness)


@query(f"""WITH {D.VECTORS}, t AS (SELECT doc_id, (vec_id % 3 <> 0 AND doc_id % 5 <> 0)::INT::DOUBLE AS mask, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM v),
m AS (SELECT doc_id, dim, sum(x * mask) / greatest(sum(mask), 1e-9) AS x FROM t GROUP BY ALL), n AS (SELECT doc_id, greatest(sqrt(sum(x * x)), 1e-12) AS len FROM m GROUP BY doc_id)
SELECT m.doc_id, dim::BIGINT AS dim, round(x / len, 6) + 0.0 AS x FROM m JOIN n USING (doc_id)""")
def pooled_vectors(spark, d):
    """RET11: tokens are the vectors of a document, some masked."""
    tokens = D.vectors(spark, d).select("doc_id", F.expr("vec_id % 3 <> 0 AND doc_id % 5 <> 0").cast("int").alias("mask"), "vec")
    return V.mean_pooled(tokens).select("doc_id", F.posexplode("vec").alias("dim", "x")).select("doc_id", (F.col("dim") + 1).cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


_NORMAL = f"""{D.top(9)}, nw AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi FROM top WINDOW w AS (PARTITION BY query_id)),
nr AS (SELECT query_id, doc_id, page, round(greatest(0.0, least(1.0, CASE WHEN n > 1 AND hi > lo THEN (score - lo) / (hi - lo) ELSE score END)), 9) AS score, rank FROM nw)"""


@query(f"WITH {_NORMAL} SELECT query_id, doc_id, page, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM nr QUALIFY new_rank <= 5")
def normalised_results(spark, d):
    """RET13."""
    return R.normalised(D.ranked(spark, d, 9), 5).select("query_id", "doc_id", "page", "score", "new_rank")


@query(f"""WITH {_NORMAL}, t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_found FROM nr),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM t WHERE score >= 0.1 QUALIFY position <= 3)
SELECT query_id, position, k.doc_id, round(score, 3) AS score, substring(text, 1, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END AS preview, total_found FROM k JOIN documents d ON d.doc_id = k.doc_id""")
def answer_context(spark, d):
    """RET14."""
    found = R.normalised(D.ranked(spark, d, 9), 9).drop("rank").withColumnRenamed("new_rank", "rank")
    kept = V.answer_context(D.corpus(spark, d).select("doc_id", "text").join(S.small(found), "doc_id"))
    return kept.select("query_id", "position", "doc_id", "score", "preview", "total_found")


@query(f"WITH {D.top(10)} SELECT query_id, doc_id, page, score, rank, rank AS rerank_rank FROM top")
def no_rerank(spark, d):
    """RRK0, RRK1."""
    return D.ranked(spark, d, 10).transform(V.unchanged)


_CUT = _LEXSCORE.replace("lower(text)", "lower(substring(text, 1, 4096))")


@query(f"WITH {_CAND} SELECT query_id, doc_id, page, {_CUT} AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY {_CUT} DESC, rank) AS rerank_rank FROM cd")
def evidence_rerank(spark, d):
    """RRK6, EVD7: the scorer's limit is 4096 characters."""
    out = V.rerank_with_evidence(_candidates(spark, d), D.corpus(spark, d))
    return out.select("query_id", "doc_id", "page", "rerank_score", "rerank_rank")


_ASK = """mq AS (SELECT doc_id AS query_id, doc_id, 'meta-data' AS qtype, CASE doc_id % 6 WHEN 0 THEN 'What is on Page ' || (doc_id % 4 + 1) || '?' WHEN 1 THEN 'How many pages are there?' WHEN 2 THEN 'How often does it mention ''the''?' WHEN 3 THEN 'How many times is mentioned the word of' WHEN 4 THEN 'Who wrote it?' ELSE 'How often does the text mention The?' END AS question FROM documents)"""


@query(f"""WITH {_ASK}, ml AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
mp AS (SELECT doc_id, n // 8 + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM ml GROUP BY ALL),
mt AS (SELECT query_id, doc_id, CASE query_id % 6 WHEN 0 THEN 'page_direct' WHEN 1 THEN 'page_count' WHEN 4 THEN NULL ELSE 'mention_count' END AS tool, CASE query_id % 6 WHEN 0 THEN query_id % 4 + 1 END AS named, CASE query_id % 6 WHEN 2 THEN 'the' WHEN 3 THEN 'of' WHEN 5 THEN 'the' END AS phrase FROM mq)
SELECT query_id, tool, max(CASE WHEN page = named THEN page END) AS page, CASE tool WHEN 'page_count' THEN max(page)::VARCHAR WHEN 'mention_count' THEN sum((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase))::BIGINT::VARCHAR END AS answer
FROM mt JOIN mp USING (doc_id) WHERE tool IS NOT NULL GROUP BY query_id, tool""")
def metadata_answers(spark, d):
    """PRD12."""
    ask = F.expr("CASE doc_id % 6 WHEN 0 THEN concat('What is on Page ', doc_id % 4 + 1, '?') WHEN 1 THEN 'How many pages are there?' WHEN 2 THEN \"How often does it mention 'the'?\" WHEN 3 THEN 'How many times is mentioned the word of' WHEN 4 THEN 'Who wrote it?' ELSE 'How often does the text mention The?' END")
    q = D.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "doc_id", F.lit("meta-data").alias("qtype"), ask.alias("question"))
    return V.metadata_answers(q, D.pages(spark, d))


@query(f"WITH {D.ASKED} SELECT query_id, CASE WHEN qtype LIKE 'multimodal%' THEN 'DOCBENCH_MULTIMODAL_PROMPT_V2' WHEN qtype = 'meta-data' THEN 'DOCBENCH_METADATA_PROMPT' WHEN qtype = 'unanswerable' THEN 'DOCBENCH_UNANSWERABLE_PROMPT' ELSE 'DOCBENCH_TEXT_ONLY_PROMPT' END AS prompt FROM (SELECT query_id, CASE query_id % 11 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'meta-data' ELSE qtype END AS qtype FROM k)")
def prompt_names(spark, d):
    """PRD17."""
    q = D.asked(spark, d).withColumn("qtype", F.expr("CASE query_id % 11 WHEN 0 THEN 'unanswerable' WHEN 1 THEN ' meta-data ' ELSE qtype END"))
    return q.select("query_id", V.prompt_name(F.col("qtype")).alias("prompt"))


_RUNS = "runs AS (SELECT o_orderkey AS run, ['Hybrid_v', 'smoke_', 'Bad_', 'bm25_', 'current_full_pipeline_'][1 + o_orderkey % 5] || o_custkey AS experiment, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'multimodal_308' END AS dataset, CASE WHEN o_orderkey % 7 = 0 THEN 20 ELSE 308 END AS total, CASE WHEN o_orderkey % 2 = 0 THEN 'bm25' END AS mode, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'local' END AS backend, CASE WHEN o_orderkey % 5 > 2 THEN 'm' || o_custkey % 3 END AS model, CASE WHEN o_orderkey % 6 = 0 THEN ['page_text', 'ocr'] END AS fields FROM orders)"


def _runs(spark, d):
    o = D.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("run"),
        F.expr("concat(array('Hybrid_v', 'smoke_', 'Bad_', 'bm25_', 'current_full_pipeline_')[cast(o_orderkey % 5 as int)], o_custkey)").alias("experiment"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'multimodal_308' END").alias("dataset"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 20 ELSE 308 END").alias("total"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'bm25' END").alias("mode"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'local' END").alias("backend"),
        F.expr("CASE WHEN o_orderkey % 5 > 2 THEN concat('m', o_custkey % 3) END").alias("model"),
        F.expr("CASE WHEN o_orderkey % 6 = 0 THEN array('page_text', 'ocr') END").alias("fields"),
    )


@query(f"WITH {_RUNS} SELECT run, experiment FROM runs WHERE dataset = 'multimodal_308' AND total = 308 AND NOT regexp_matches(lower(experiment), 'smoke|bad|current_full_pipeline')")
def paper_rows(spark, d):
    """PRD14."""
    return V.paper_rows(_runs(spark, d)).select("run", "experiment")


@query(f"""WITH {_RUNS}, l AS (SELECT *, array_to_string(list_filter([mode, backend, model], lambda x: x IS NOT NULL AND x <> ''), ' / ') AS label, array_to_string(list_filter([mode, model], lambda x: x IS NOT NULL), ' / ') AS crop FROM runs)
SELECT run, CASE WHEN label = '' THEN 'none' ELSE label END AS retriever, CASE WHEN fields IS NOT NULL THEN array_to_string(fields, '+') ELSE crop END AS evidence FROM l""")
def experiment_labels(spark, d):
    """RPT11."""
    c = F.col
    return _runs(spark, d).select("run", V.config_label(c("mode"), c("backend"), c("model"), "none").alias("retriever"), V.evidence_label(c("fields"), c("mode"), c("model")).alias("evidence"))


@query(f"WITH {_CAND} SELECT query_id, doc_id, page, score, rank, {_LEXSCORE} AS text_rerank_score FROM cd")
def candidate_rows(spark, d):
    """CND6."""
    from ..operators.rerank import SCORERS

    c = _candidates(spark, d).withColumn("text_rerank_score", F.round(SCORERS["lexical"](F.col("question"), F.col("text")), 9))
    return V.candidate_rows(c)


@query("""WITH p AS (SELECT o_orderkey AS query_id, 2 + o_orderkey % 3 AS n, o_orderkey % 4 AS pos, CASE WHEN o_orderkey % 5 > 0 THEN 'crop.png' END AS crop, CASE WHEN o_orderkey % 2 = 0 THEN 'full_page_plus_crop' ELSE 'crop_only' END AS mode FROM orders),
w AS (SELECT *, list_transform(range(0, n), lambda i: 'd/' || i || '.png') AS whole, CASE WHEN pos < n THEN pos ELSE 0 END AS own FROM p)
SELECT query_id, array_to_string(CASE WHEN crop IS NULL THEN whole WHEN mode = 'crop_only' THEN [crop] ELSE [whole[own + 1], crop] || list_filter(whole, lambda x: x <> whole[own + 1]) END, ',') AS images FROM w""")
def ordered_images(spark, d):
    """CND8."""
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"))
    paths = F.expr("transform(sequence(0, cast(1 + query_id % 3 as int)), i -> struct(concat('d/', i) as label, concat('d/', i, '.png') as path))")
    crop, mode = F.expr("CASE WHEN query_id % 5 > 0 THEN 'crop.png' END"), F.expr("CASE WHEN query_id % 2 = 0 THEN 'full_page_plus_crop' ELSE 'crop_only' END")
    o = o.select("query_id", paths.alias("paths"), crop.alias("crop"), F.expr("concat('d/', query_id % 4)").alias("label"), mode.alias("mode"))
    return o.select("query_id", F.array_join(V.ordered_images(F.col("paths"), F.col("crop"), F.col("label"), F.col("mode")), ",").alias("images"))


_CROPS = f"{_SCORED}, cr AS (SELECT query_id, qtype, f1, expected, generated, latency, query_id % 4 = 0 AS fallback_used, CASE WHEN query_id % 3 > 0 THEN 'c' || query_id || '.png' END AS crop_path, query_id % 5 = 1 AS crop_type_mismatch, CASE WHEN query_id % 7 > 0 THEN query_id % 2 = 0 END AS caption_match FROM mt)"


def _crops(spark, d):
    crop = F.struct(F.expr("query_id % 4 = 0").alias("fallback_used"), F.expr("CASE WHEN query_id % 3 > 0 THEN concat('c', query_id, '.png') END").alias("crop_path"), F.expr("query_id % 5 = 1").alias("crop_type_mismatch"), F.expr("CASE WHEN query_id % 7 > 0 THEN query_id % 2 = 0 END").alias("caption_match"))
    return _scored(spark, d).withColumn("crop", crop)


@query(f"""WITH {_CROPS} SELECT qtype, round(avg((NOT fallback_used AND crop_path IS NOT NULL)::INT), 9) AS crop_used_rate, round(avg(crop_type_mismatch::INT), 9) AS crop_type_mismatch_rate, round(avg(coalesce(caption_match, false)::INT), 9) AS caption_match_rate, round(avg(fallback_used::INT), 9) AS fallback_rate,
round(avg(f1) FILTER (crop_type_mismatch), 9) AS mean_f1_when_crop_type_mismatch_true, round(avg(f1) FILTER (caption_match), 9) AS mean_f1_when_caption_match_true FROM cr GROUP BY qtype""")
def crop_summary(spark, d):
    """AGG3."""
    return V.crop_summary(_crops(spark, d), ["qtype"])


@query(f"WITH {_CROPS} SELECT qtype AS type, expected, generated, f1, latency, crop_path AS selected_crop_path, crop_type_mismatch, caption_match, fallback_used, NOT fallback_used AND crop_path IS NOT NULL AS crop_used, query_id::VARCHAR AS question FROM cr")
def case_rows(spark, d):
    """SNK3: the columns that these rows have."""
    out = V.cases(_crops(spark, d).withColumn("type", F.col("qtype")).withColumn("question", F.col("query_id").cast("string")))
    return out.select("type", "expected", "generated", "f1", "latency", "selected_crop_path", "crop_type_mismatch", "caption_match", "fallback_used", "crop_used", "question")


_SAID = "['<ANSWER> ' || generated, 'Because of it. Answer: assistant: \"' || generated || '\"', generated, '  ', 'ANSWER: x Answer: ''' || expected || ''' '][1 + query_id % 5]"
_TAIL = "list_extract(string_split({x}, '{m}'), -1)"
_LAST = _TAIL.format(x=_TAIL.format(x=_TAIL.format(x="s", m="<ANSWER>"), m="Answer:"), m="ANSWER:")


@query(f"""WITH {D.ANSWERS}, x AS (SELECT query_id, {_SAID} AS s FROM a), y AS (SELECT query_id, s, trim(regexp_replace(trim(regexp_replace(trim({_LAST}), '^(?i:assistant)\\s*:\\s*', '')), '^["'']+|["'']+$', '', 'g')) AS f FROM x)
SELECT query_id, CASE WHEN f = '' THEN 'NOT FOUND' ELSE f END AS final, CASE WHEN contains(s, 'Answer:') THEN trim(string_split(s, 'Answer:')[1]) END AS reasoning, array_to_string(list_filter([f, ' ', s], lambda z: trim(z) <> ''), chr(10)) AS joined FROM y""")
def generated_parts(spark, d):
    """NRM8, NRM10, NRM11."""
    said = F.expr("array(concat('<ANSWER> ', generated), concat('Because of it. Answer: assistant: \"', generated, '\"'), generated, '  ', concat(\"ANSWER: x Answer: '\", expected, \"' \"))[cast(query_id % 5 as int)]")
    a = D.answers(spark, d).select("query_id", said.alias("s"))
    final = T.final_answer(F.col("s"))
    plain = F.when(final == "NOT FOUND", F.when(F.contains("s", F.lit("NOT FOUND")), final).otherwise("")).otherwise(final)
    return a.select("query_id", final.alias("final"), T.reasoning(F.col("s")).alias("reasoning"), T.joined(F.array(plain, F.lit(" "), F.col("s"))).alias("joined"))


