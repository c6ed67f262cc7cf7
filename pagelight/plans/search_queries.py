"""Registered queries of search strategies, of the hybrid run and of pages; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as I
from ..operators import ranking as R
from ..operators import rerank as K
from ..operators import retrieval_metrics as X
from ..operators.index import LexicalIndex, numbered_figures as by_number
from ..operators.strategy import Searchers, hybrid_run
from . import fixtures as D
from ..sources.shared import scratch
from .queries import _CAND, _FEATURES, _LEXSCORE, _MM, query


def _searchers(spark, d, encoder: bool = True) -> Searchers:
    """Vectors stand for documents and for questions of their number."""
    if not encoder:
        return Searchers(D.lexical_index(spark, d))
    v = D.vectors(spark, d)
    asked = v.join(D.questions(spark, d), F.col("vec_id") == F.col("query_id")).select("query_id", "vec")
    return Searchers(D.lexical_index(spark, d), v.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("page"), "vec"), asked)


def _search(spark, d, strategy, encoder: bool = True):
    return _searchers(spark, d, encoder).search(D.questions(spark, d), 5, strategy)


_CASCADE = f"""{D.top(100)}, {D.VECTORS}, {D.UNIT},
cm AS (SELECT top.query_id, top.doc_id, top.page, 0.3 * score + 0.7 * (list_dot_product(a.v, b.v) + 1) / 2 AS x FROM top JOIN u a ON a.vec_id = top.doc_id JOIN u b ON b.vec_id = top.query_id),
cw AS (SELECT query_id, doc_id, page, x, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM cm),
cs AS (SELECT query_id, doc_id, page, round(CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (x - lo) / (hi - lo) END, 9) AS score FROM cw),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM cs)"""
_FUSED = """fu AS (SELECT query_id, doc_id, page, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, page, rank FROM top WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, page, rank FROM ca WHERE rank <= 15) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank, 'fusion' AS strategy FROM fu QUALIFY rank <= 5"""


@query(f"WITH {_CASCADE} SELECT *, 'cascade' AS strategy FROM ca WHERE rank <= 5")
def strategy_auto(spark, d):
    """RET12: the encoder is ready."""
    return _search(spark, d, "auto")


@query(f"WITH {D.top(5)} SELECT query_id, doc_id, page, score, rank, 'bm25_only' AS strategy FROM top")
def strategy_auto_without_encoder(spark, d):
    """RET12."""
    return _search(spark, d, "auto", encoder=False)


@query(f"WITH {D.top(5)} SELECT query_id, doc_id, page, score, rank, 'bm25_only' AS strategy FROM top")
def strategy_bm25_only(spark, d):
    """RET12."""
    return _search(spark, d, "bm25_only")


@query(f"""WITH {D.QUESTIONS}, {D.VECTORS}, {D.UNIT}, s AS (SELECT q.query_id, u.vec_id AS doc_id, 1::BIGINT AS page, round((list_dot_product(a.v, u.v) + 1) / 2, 9) AS score FROM q JOIN u a ON a.vec_id = q.query_id JOIN u ON true)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank, 'encoder_only' AS strategy FROM s QUALIFY rank <= 5""")
def strategy_encoder_only(spark, d):
    """RET12."""
    return _search(spark, d, "encoder_only")


@query(f"WITH {_CASCADE}, {_FUSED}")
def strategy_all(spark, d):
    """RET12: 3 k of each module, fused."""
    return _search(spark, d, "all")


@query(f"WITH {_CASCADE}, {_FUSED.replace('FROM top WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, page, rank FROM ca WHERE rank <= 15', 'FROM ca WHERE rank <= 15')}")
def strategy_listed(spark, d):
    """RET12: a list of modules, one of which isn't active."""
    return _search(spark, d, ["encoder", "clip"])


@query(f"""WITH {D.paged(D.top(10))}, {D.GOLD_PAGES},
k AS (SELECT DISTINCT query_id FROM goldp), h AS (SELECT query_id, min(rank) AS r FROM top JOIN goldp USING (query_id, doc_id, page) GROUP BY 1), a AS (SELECT query_id, min(rank) AS r FROM top JOIN (SELECT DISTINCT query_id, page FROM goldp) USING (query_id, page) GROUP BY 1)
SELECT q.query_id, {', '.join(f"CASE WHEN k.query_id IS NOT NULL THEN coalesce(({t}.r <= {n})::INT, 0)::DOUBLE END AS {name}_{n}" for t, name in (("h", "page_hit"), ("a", "any_document")) for n in (1, 5, 10))}
FROM q LEFT JOIN k USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN a USING (query_id)""")
def page_hits(spark, d):
    """RTM7, RTM8: pages of eight lines, in their document and, as published numbers have it, in any."""
    ranked, gold, asked, ks = D.ranked_pages(spark, d), D.gold_pages(spark, d), D.questions(spark, d), [1, 5, 10]
    one = X.hit_at(ranked, gold, asked, ks, ["doc_id", "page"]).withColumnsRenamed({f"hit_{k}": f"page_hit_{k}" for k in ks})
    two = X.page_hit_any_document(ranked, gold, asked, ks).withColumnsRenamed({f"hit_{k}": f"any_document_{k}" for k in ks})
    return one.join(two, "query_id")


_KINDS = "CASE item_id % 7 WHEN 0 THEN 'meta-data' WHEN 1 THEN 'text-only' WHEN 2 THEN 'text-only' WHEN 3 THEN 'unanswerable' WHEN 4 THEN 'multimodal-t' WHEN 5 THEN 'multimodal-f' ELSE 'other' END"
_HQ = f"""{D.GOLD}, gd AS (SELECT query_id, min(doc_id) AS doc_id FROM gold GROUP BY 1),
hq AS (SELECT item_id AS query_id, CASE item_id % 7 WHEN 0 THEN 'How many pages are there?' WHEN 1 THEN 'What is on Page 2?' ELSE array_to_string(string_split(text, ' ')[1:12], ' ') END AS question, {_KINDS} AS qtype, doc_id FROM benchmark LEFT JOIN gd ON gd.query_id = item_id),
q AS (SELECT query_id, question FROM hq)"""


@query(f"""WITH {D.paged(D.SCORES).replace(D.QUESTIONS, _HQ)}, {D.VECTORS}, {D.UNIT},
np AS (SELECT doc_id, max(page) AS pages FROM pages8 GROUP BY 1),
tl AS (SELECT query_id, hq.doc_id, CASE WHEN qtype = 'meta-data' THEN 'page_count' ELSE 'page_direct' END AS tool, CASE WHEN qtype = 'meta-data' THEN pages::VARCHAR END AS answer, CASE WHEN qtype <> 'meta-data' AND pages >= 2 THEN 2 END AS page FROM hq JOIN np USING (doc_id) WHERE query_id % 7 IN (0, 1)),
gv AS (SELECT * FROM tl WHERE answer IS NOT NULL OR page IS NOT NULL),
bm AS (SELECT sc.query_id, sc.doc_id, sc.page, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, sc.page) AS rank FROM sc JOIN hq ON hq.query_id = sc.query_id AND hq.doc_id = sc.doc_id WHERE score > 0 AND qtype IN ('meta-data', 'text-only', 'unanswerable') AND sc.query_id NOT IN (SELECT query_id FROM gv) QUALIFY rank <= 5),
dt AS (SELECT hq.query_id, u.doc_id, u.page, round(list_dot_product(a.v, u.v), 9) AS score, row_number() OVER (PARTITION BY hq.query_id ORDER BY round(list_dot_product(a.v, u.v), 9) DESC, u.doc_id, u.page) AS rank FROM hq JOIN u a ON a.vec_id = hq.query_id JOIN u ON true WHERE starts_with(qtype, 'multimodal') QUALIFY rank <= 10),
e AS (SELECT dt.*, unnest([-1, 0, 1]) AS delta FROM dt), nb AS (SELECT e.query_id, e.doc_id, e.page + e.delta AS page, e.rank, e.delta, row_number() OVER (PARTITION BY e.query_id, e.doc_id, e.page + e.delta ORDER BY e.rank, e.delta) AS n FROM e SEMI JOIN v ON v.doc_id = e.doc_id AND v.page = e.page + e.delta QUALIFY n = 1),
nr AS (SELECT query_id, doc_id, page, row_number() OVER (PARTITION BY query_id ORDER BY rank, delta) AS rank FROM nb),
nl AS (SELECT nr.* FROM nr JOIN hq USING (query_id) WHERE rank <= CASE WHEN regexp_matches(lower(question), 'figure|fig\\.|chart|graph|plot|diagram|image|picture|photo|architecture|shown') OR qtype = 'multimodal-f' THEN 5 ELSE 3 END),
fo AS (SELECT query_id, doc_id, page, rank FROM bm UNION ALL SELECT query_id, doc_id, page, 1 FROM gv WHERE page IS NOT NULL UNION ALL SELECT * FROM nl),
fl AS (SELECT query_id, list(doc_id ORDER BY rank) AS docs, string_agg(doc_id || ':' || page, ',' ORDER BY rank) AS pages FROM fo GROUP BY 1),
z AS (SELECT hq.*, fl.docs, fl.pages, tl.tool, tl.answer, CASE WHEN qtype = 'other' THEN NULL WHEN starts_with(qtype, 'multimodal') THEN 'multimodal' ELSE 'text_bm25' END AS pipeline_used, tl.answer IS NOT NULL OR tl.page IS NOT NULL AS used, EXISTS (SELECT 1 FROM v WHERE v.vec_id = hq.query_id) AS encoded FROM hq LEFT JOIN fl USING (query_id) LEFT JOIN tl USING (query_id))
SELECT query_id, pipeline_used, CASE WHEN pipeline_used = 'multimodal' THEN 'visual' WHEN pipeline_used IS NULL THEN NULL WHEN used THEN tool ELSE 'bm25' END AS route_subtype, CASE WHEN used THEN tool END AS tool_used, answer, coalesce(pages, '') AS pages,
  CASE WHEN doc_id IS NOT NULL THEN coalesce(list_contains(docs[1:1], doc_id), false)::BIGINT END AS doc_hit_at_1, CASE WHEN doc_id IS NOT NULL THEN coalesce(list_contains(docs[1:5], doc_id), false)::BIGINT END AS doc_hit_at_5,
  CASE WHEN pipeline_used IS NULL THEN 'unsupported_type' WHEN pipeline_used = 'text_bm25' AND doc_id IS NULL THEN 'no_document' WHEN pipeline_used = 'text_bm25' AND answer IS NULL AND docs IS NULL THEN 'no_pages' WHEN pipeline_used = 'multimodal' AND NOT encoded THEN 'no_query_vector' WHEN pipeline_used = 'multimodal' AND docs IS NULL THEN 'no_pages' END AS error FROM z""")
def hybrid_rows(spark, d):
    """ORC9: text and visual questions in one plan; errors are rows."""
    b = D.table(spark, d, "benchmark")
    gold = D.gold(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    ask = F.expr("CASE item_id % 7 WHEN 0 THEN 'How many pages are there?' WHEN 1 THEN 'What is on Page 2?' ELSE array_join(slice(split(text, ' '), 1, 12), ' ') END")
    q = b.select(F.col("item_id").alias("query_id"), ask.alias("question"), F.expr(_KINDS).alias("qtype")).join(gold, "query_id", "left")
    v = D.vectors(spark, d)
    encoded = v.join(b.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "vec")
    return hybrid_run(q, D.pages(spark, d), Searchers(D.lexical_index(spark, d, D.pages), v, encoded))


_SQ = "gd AS (SELECT query_id, min(doc_id) AS doc_id FROM gold GROUP BY 1), sq AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'What is the total in the table' ELSE 'Who is it' END AS question, gd.doc_id FROM benchmark LEFT JOIN gd ON gd.query_id = item_id)"


@query(f"""WITH {D.paged(D.top(5))}, {D.GOLD}, {D.GOLD_PAGES}, {_SQ}, mine AS (SELECT DISTINCT top.query_id, page FROM top JOIN sq ON sq.query_id = top.query_id AND sq.doc_id = top.doc_id),
orc AS (SELECT DISTINCT goldp.query_id, page FROM goldp JOIN sq ON sq.query_id = goldp.query_id AND sq.doc_id = goldp.doc_id), tab AS (SELECT item_id AS query_id, 1 AS page FROM benchmark WHERE item_id % 3 = 0),
ph AS (SELECT orc.query_id, max((mine.page IS NOT NULL)::INT)::DOUBLE AS h FROM orc LEFT JOIN mine USING (query_id, page) GROUP BY 1), th AS (SELECT tab.query_id, max((mine.page IS NOT NULL)::INT)::DOUBLE AS h FROM tab LEFT JOIN mine USING (query_id, page) GROUP BY 1)
SELECT query_id, CASE WHEN doc_id IS NOT NULL THEN EXISTS (SELECT 1 FROM mine WHERE mine.query_id = sq.query_id)::INT::DOUBLE END AS doc_hit, ph.h AS page_hit, coalesce(th.h, CASE WHEN regexp_matches(lower(question), '{"|".join(I.TABLE_HEAVY)}') THEN ph.h END) AS table_hit FROM sq LEFT JOIN ph USING (query_id) LEFT JOIN th USING (query_id)""")
def selected_page_hits(spark, d):
    """RTM8: documents, pages and tables among the five pages selected."""
    b = D.table(spark, d, "benchmark")
    gold = D.gold(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    q = b.select(F.col("item_id").alias("query_id"), F.expr("CASE WHEN item_id % 4 = 0 THEN 'What is the total in the table' ELSE 'Who is it' END").alias("question")).join(gold, "query_id", "left")
    oracle = D.gold_pages(spark, d).join(gold, ["query_id", "doc_id"], "left_semi")
    return X.selected_hits(q, D.ranked_pages(spark, d, 5), oracle, b.where("item_id % 3 = 0").select(F.col("item_id").alias("query_id"), F.lit(1).alias("page")))


@query(f"WITH {D.top(10)} SELECT doc_id, count(*) AS n FROM top GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 10")
def most_common_documents(spark, d):
    """AGG17: a top-k report."""
    return X.most_common(D.ranked(spark, d, 10), "doc_id")


_CT = f"{D.CAPTIONED}, ct AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM cx GROUP BY doc_id)"
_NAMES = "q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'table ' || item_id % 50 WHEN 1 THEN 'figure ' || item_id % 9 END AS question FROM benchmark WHERE item_id % 3 < 2)"


@query(f"""WITH {_CT}, {D.top(15).replace(D.QUESTIONS, _NAMES).replace("FROM documents)", "FROM ct)", 1)},
h AS (SELECT top.query_id, top.doc_id, top.page, top.rank AS place FROM top JOIN q USING (query_id) JOIN ct ON ct.doc_id = top.doc_id WHERE contains(lower(ct.text), q.question))
SELECT query_id, doc_id, page, 999.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM h QUALIFY rank <= 5""")
def numbered_figures(spark, d):
    """RET16: over documents with captions."""
    pages = D.captioned(spark, d)
    ask = F.expr("CASE item_id % 3 WHEN 0 THEN concat('What is in Table ', item_id % 50, '?') WHEN 1 THEN concat('See Fig. ', item_id % 9, ' again') ELSE 'Who is it' END")
    q = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ask.alias("question"))
    return by_number(LexicalIndex(spark, scratch(spark, "captioned")).build(pages), pages, q)


_ASKS = "CASE {g} % 6 WHEN 0 THEN concat('What is the total in Table ', {g} % 50, '?') WHEN 1 THEN concat('What does Fig. ', {g} % 9, 'a say of table ', {g} % 50 + 1, '?') WHEN 2 THEN 'Which table row has the best accuracy score?' WHEN 3 THEN 'Which chart shows the plot of f1?' WHEN 4 THEN 'How high is the bleu score?' ELSE 'Who wrote it?' END"
_HEAD = r"'\b(table|figure|fig\.?|chart|graph)\s*(\d+[a-z]?)\b'"
_SAYS = lambda *names: "(" + " OR ".join(f"contains(lower(text), '{n}')" for n in names) + ")"
_HAS = lambda *names: "list_has_any(qt, [" + ", ".join(f"'{n}'" for n in names) + "])"
_METRIC = ("accuracy", "score", "f1", "ppl", "bleu", "wer", "auc")
_HEADED = f"""{_CT}, cd AS (SELECT doc_id // 10 AS query_id, doc_id, 1::BIGINT AS page, ((doc_id * 37) % 11)::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY (doc_id * 37) % 11 DESC, doc_id) AS rank, {_ASKS.format(g='(doc_id // 10)')} AS question, text FROM ct),
{_FEATURES.replace(_CAND + ', ', '', 1)}, hq AS (SELECT *, list_filter(regexp_extract_all(question, '[a-zA-Z0-9]+(?:[._+\\-][a-zA-Z0-9]+)*'), lambda x: length(x) > 2) AS qt0, list_transform(list_zip(regexp_extract_all(lower(question), {_HEAD}, 1), regexp_extract_all(lower(question), {_HEAD}, 2)), lambda z: concat(CASE WHEN replace(z[1], '.', '') = 'fig' THEN 'figure' ELSE replace(z[1], '.', '') END, ' ', z[2])) AS needles FROM f),
hr AS (SELECT * REPLACE (list_transform(qt0, lambda x: lower(x)) AS qt0), list_transform(qt0, lambda x: lower(x)) AS qt FROM hq),
hd AS (SELECT *, CASE WHEN len(needles) > 0 THEN (len(list_filter(needles, lambda x: contains(lower(text), x))) > 0)::INT::DOUBLE ELSE least(1.0, CASE WHEN {_HAS("table", "row", "column", "accuracy", "score", "f1", "ppl", "bleu")} AND {_SAYS("[table_text]", "table ")} THEN 0.5 ELSE 0 END + CASE WHEN {_HAS("figure", "fig", "chart", "graph", "plot", "diagram")} AND {_SAYS("[caption]", "figure ", "fig ", "chart ", "graph ")} THEN 0.5 ELSE 0 END + CASE WHEN {_HAS(*_METRIC)} AND {_SAYS(*_METRIC)} THEN 0.25 ELSE 0 END)::DOUBLE END AS table_header_match FROM hr)"""


def _headed(spark, d):
    """Ten captioned documents are the candidates of a question that asks for tables and figures."""
    c = D.captioned(spark, d).withColumns({"query_id": F.floor(F.col("doc_id") / 10), "score": F.expr("cast((doc_id * 37) % 11 as double)")})
    c = R.top_k(c.withColumn("question", F.expr(_ASKS.format(g="query_id"))), None, ties=["doc_id"])
    return K.fusion_features(c)


@query(f"WITH {_HEADED} SELECT query_id, doc_id, rank, table_header_match FROM hd")
def header_features(spark, d):
    """FUS5."""
    return _headed(spark, d).select("query_id", "doc_id", "rank", "table_header_match")


@query(f"""WITH {_HEADED}, l AS (SELECT *, {_LEXSCORE} AS lx FROM hd), n AS (SELECT *, {_MM.format(x='score')} AS a, {_MM.format(x='lx')} AS b FROM l WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, rank, round(a + 0.2 * b + 1.0, 9) AS base_score, round(a + 0.2 * b + 1.0 + 0.05 * number_match + 0.05 * keyword_match + 0.05 * exact_phrase_match + 0.2 * table_header_match, 9) AS fusion_score FROM n)
SELECT query_id, doc_id, base_score, fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, rank) AS fusion_rank FROM s""")
def headed_fusion(spark, d):
    """FUS6: with header matches."""
    c = _headed(spark, d).withColumns({"text_rerank_score": F.round(K.SCORERS["lexical"](F.col("question"), F.col("text")), 9), "rerank_score": F.lit(None).cast("double")})
    return R.weighted_fusion(c).select("query_id", "doc_id", "base_score", "fusion_score", "fusion_rank")
