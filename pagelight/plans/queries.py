"""Registered queries: each operator over its whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, ShortType

from ..functions import intent as I
from ..functions import numbers as N
from ..functions import text as T
from ..operators import answer_metrics as M
from ..operators import blocks as B
from ..operators import evidence as E
from ..operators import layout as L
from ..operators import ranking as R
from ..operators import rerank as K
from ..operators import retrieval as S
from ..operators import retrieval_metrics as X
from ..streaming import metrics as W
from . import fixtures as D
from . import report as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name; whole numbers come out as 64-bit ones."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            wide = {c.name: F.col(c.name).cast("long") for c in out.schema if isinstance(c.dataType, (IntegerType, ShortType))}
            return out.withColumns(wide) if wide else out

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def words(*names: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# -- retrieval ---------------------------------------------------------------


@query(f"WITH {D.top(10)} SELECT query_id, doc_id, page, score, rank FROM top")
def bm25_topk(spark, d):
    """RET1, RET2, TOK1, TOP1."""
    return D.ranked(spark, d, 10)


@query(f"WITH {D.top(10).replace(D.QUESTIONS, 'q AS (SELECT item_id AS query_id, text AS question FROM benchmark)')} SELECT query_id, doc_id, page, score, rank FROM top")
def bm25_passages(spark, d):
    """RET2: whole passages as questions."""
    q = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return D.lexical_index(spark, d).search(S.query_terms(q), 10)


@query(f"""WITH {D.top(10)}, {D.GOLD},
h AS (SELECT query_id, min(rank) AS r FROM top JOIN gold USING (query_id, doc_id, page) GROUP BY 1)
SELECT q.query_id, {', '.join(f"CASE WHEN g.query_id IS NOT NULL THEN coalesce((h.r <= {k})::INT, 0)::DOUBLE END AS hit_{k}" for k in (1, 5, 10))}
FROM q LEFT JOIN (SELECT DISTINCT query_id FROM gold) g USING (query_id) LEFT JOIN h USING (query_id)""")
def bm25_hit_at_k(spark, d):
    """RTM6 over RET2: the flagship."""
    return X.hit_at(D.ranked(spark, d, 10), D.gold(spark, d), D.questions(spark, d), [1, 5, 10])


@query(f"""WITH {D.SCORES}, {D.GOLD} SELECT sc.query_id, sc.doc_id, sc.page, sc.score, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, sc.doc_id, sc.page) AS rank
FROM sc JOIN gold ON gold.query_id = sc.query_id AND gold.doc_id = sc.doc_id WHERE score > 0""")
def bm25_doc_scoped(spark, d):
    """RET4: global statistics, ranking inside given documents."""
    index, terms = D.bm25(spark, d)
    return index.search(terms, None, scope=D.gold(spark, d))


@query(f"""WITH {D.POSTINGS}, ad AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, page, unnest(tokens) AS term FROM dl) GROUP BY term), i0 AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM ad, tot), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
s AS (SELECT query_id, doc_id, page, round(sum(idf * tf * 3.5 / (tf + 2.5 * (1 - 0.9 + 0.9 * dl / greatest(avgdl, 1e-9))) * qf), 9) AS score FROM qt JOIN i USING (term) JOIN po USING (term), tot GROUP BY ALL),
w AS (SELECT s.*, max(score) OVER (PARTITION BY query_id) AS hi, least(min(score) OVER (PARTITION BY query_id), CASE WHEN count(*) OVER (PARTITION BY query_id) < n THEN 0.0 END) AS lo FROM s, tot),
m AS (SELECT query_id, doc_id, page, round(CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END, 9) AS score FROM w WHERE hi > 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM m WHERE score > 0.01 QUALIFY rank <= 5""")
def bm25_minmax_cutoff(spark, d):
    """RET3: Okapi scores to 0..1, cut."""
    index, terms = D.bm25(spark, d)
    return S.serving_search(index, terms)


@query(f"WITH p AS (SELECT doc_id, {D.tokens('text')} AS t FROM documents) SELECT count(*) AS pages, count(DISTINCT doc_id) AS docs, sum(len(t))::BIGINT AS tokens, round(avg(len(t)), 6) AS avgdl FROM p WHERE len(t) > 0")
def corpus_stats(spark, d):
    """AGG15."""
    t = D.corpus(spark, d).select("doc_id", F.size(T.bm25_tokens(F.col("text"))).alias("n")).where("n > 0")
    return t.agg(F.count("*").alias("pages"), F.count_distinct("doc_id").alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("avgdl"))


@query(f"WITH {D.dense_top(10)} SELECT query_id, doc_id, page, score, rank FROM dt")
def dense_topk(spark, d):
    """RET5, RET6, TOP2."""
    return D.dense(spark, d)


@query(f"""WITH {D.VECTORS}, {D.UNIT}, s AS (SELECT q.vec_id AS query_id, u.doc_id, u.page, round((list_dot_product(q.v, u.v) + 1) / 2, 9) AS score FROM u JOIN u q ON q.vec_id % 50 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM s QUALIFY rank <= 5""")
def semantic_topk(spark, d):
    """RET10."""
    return S.dense_search(D.vector_queries(spark, d), D.vectors(spark, d), 5, "half")


def _multi(spark, d):
    v = D.vectors(spark, d)
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("page").alias("tok"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    p = v.groupBy("doc_id").agg(F.collect_list(F.transform("vec", lambda x: x.cast("double"))).alias("vecs")).withColumn("page", F.lit(1))
    return q, p


@query(f"""WITH {D.VECTORS}, t AS (SELECT q.doc_id AS query_id, q.page AS tok, p.doc_id, max(list_dot_product(q.vec, p.vec)) AS m FROM v q JOIN v p ON q.doc_id % 50 = 0 GROUP BY ALL),
s AS (SELECT query_id, doc_id, 1::BIGINT AS page, round(sum(m), 9) AS score FROM t GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM s QUALIFY rank <= 10""")
def maxsim_topk(spark, d):
    """RET7: four vectors make a page; each page has at most four."""
    return S.max_sim(*_multi(spark, d), 10)


@query(f"""WITH {D.top(100)}, {D.VECTORS}, {D.UNIT},
m AS (SELECT top.query_id, top.doc_id, top.page, 0.3 * score + 0.7 * (list_dot_product(a.v, b.v) + 1) / 2 AS x FROM top JOIN u a ON a.vec_id = top.doc_id JOIN u b ON b.vec_id = top.query_id),
w AS (SELECT query_id, doc_id, page, x, min(x) OVER (PARTITION BY query_id) AS lo, max(x) OVER (PARTITION BY query_id) AS hi FROM m),
s AS (SELECT query_id, doc_id, page, round(CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (x - lo) / (hi - lo) END, 9) AS score FROM w)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM s QUALIFY rank <= 10""")
def cascade_topk(spark, d):
    """RET9: vectors stand for documents and questions of their number."""
    v = D.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "vec")
    q = D.vectors(spark, d).join(D.questions(spark, d), F.col("vec_id") == F.col("query_id")).select("query_id", "vec")
    return S.cascade(D.ranked(spark, d, 100), q, v)


_ROUTE = f"""WITH {D.VECTORS}, {D.UNIT}, s AS (SELECT q.vec_id AS query_id, u.label::BIGINT AS doc_id, u.page, list_dot_product(q.v, u.v) AS score FROM u JOIN u q ON q.vec_id % 50 = 0)"""


def _labelled(spark, d):
    return D.vectors(spark, d).withColumn("doc_id", F.col("label").cast("long"))


@query(f"""{_ROUTE}, x AS (SELECT label::BIGINT AS doc_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM v), c0 AS (SELECT doc_id, i, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT doc_id, list(x ORDER BY i) AS v FROM c0 GROUP BY 1),
r AS (SELECT q.vec_id AS query_id, c.doc_id, round(list_dot_product(q.v, list_transform(c.v, lambda y: y / greatest(sqrt(list_sum(list_transform(c.v, lambda z: z * z))), 1e-12))), 9) AS score FROM c, u q WHERE q.vec_id % 50 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5""")
def doc_routing_centroid(spark, d):
    """RET18."""
    return S.route_documents(D.vector_queries(spark, d), _labelled(spark, d), "centroid")


@query(f"{_ROUTE}, r AS (SELECT query_id, doc_id, round(max(score), 9) AS score FROM s GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5")
def doc_routing_max(spark, d):
    """RET18."""
    return S.route_documents(D.vector_queries(spark, d), _labelled(spark, d), "max")


@query(f"""{_ROUTE}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC) AS n FROM s QUALIFY n <= 5), r AS (SELECT query_id, doc_id, round(avg(score), 9) AS score FROM t GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5""")
def doc_routing_top5(spark, d):
    """RET18."""
    return S.route_documents(D.vector_queries(spark, d), _labelled(spark, d), "top5")


@query(f"""WITH {D.VECTORS}, {D.UNIT}, s AS (SELECT q.vec_id AS query_id, u.doc_id, u.page, round(list_dot_product(q.v, u.v), 9) AS score FROM u JOIN u q ON q.vec_id % 50 = 0 AND u.doc_id = q.doc_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM s""")
def in_document_ranking(spark, d):
    """RET17."""
    return S.in_document(D.vector_queries(spark, d), D.vectors(spark, d))


_NORM = "trim(regexp_replace(regexp_replace(translate(lower(coalesce({c}, '')), '−–—', '---'), '(\\d),(\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g'), '\\s+', ' ', 'g'))"
_KEYS = "list_filter(regexp_extract_all({c}, '[a-z][a-z0-9_+\\-]*'), lambda t: length(t) >= 3 AND NOT list_contains(" + words(*T.KEYWORD_STOP) + ", t))"


@query(f"""WITH g AS (SELECT b.item_id AS query_id, d.doc_id, string_split(b.text, ' ')[1:6] AS w, b.text AS passage FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
qq AS (SELECT query_id, doc_id, {_NORM.format(c="array_to_string(w, ' ')")} AS a, list_distinct({_KEYS.format(c=_NORM.format(c="array_to_string(w, ' ')"))} || {_KEYS.format(c=_NORM.format(c="passage"))}) AS k, list_distinct(regexp_extract_all({_NORM.format(c="array_to_string(w, ' ')")}, '\\d+(?:\\.\\d+)?%?')) AS nn FROM g),
l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
pp AS (SELECT doc_id, n // 8 + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM l GROUP BY ALL),
pt AS (SELECT doc_id, page, {_NORM.format(c='text')} AS t FROM pp),
pk AS (SELECT *, {_KEYS.format(c='t')} AS pk, regexp_extract_all(t, '\\d+(?:\\.\\d+)?%?') AS pn FROM pt),
r AS (SELECT query_id, doc_id, page, (a <> '' AND contains(t, a)) AS exact_answer,
  round(CASE WHEN len(nn) > 0 THEN len(list_filter(nn, lambda x: list_contains(pn, x) OR list_contains(pn, rtrim(x, '%')))) / len(nn) ELSE 0.0 END, 9) AS number_recall,
  round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: list_contains(pk, x))) / len(k) ELSE 0.0 END, 9) AS keyword_recall FROM qq JOIN pk USING (doc_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_answer DESC, number_recall DESC, keyword_recall DESC, page, doc_id) AS rank FROM r WHERE exact_answer OR number_recall > 0 OR keyword_recall >= 0.25""")
def oracle_pages(spark, d):
    """RET15: pages of eight lines that hold the first words of a passage."""
    q = S.small(D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("answer"), F.col("text").alias("evidence")))
    g = D.gold(spark, d).select("query_id", "doc_id").join(q, "query_id")
    out = S.answer_pages(g, D.pages(spark, d)).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("exact_answer"), F.desc("number_recall"), F.desc("keyword_recall"), "page", "doc_id")
    return out.withColumn("rank", F.row_number().over(order))


# -- reranking and fusion ----------------------------------------------------


def _candidates(spark, d, k: int = 10, ranked: DataFrame | None = None) -> DataFrame:
    """The k best documents of each question with its words and their texts, which stay where they are."""
    q = S.small(D.questions(spark, d).select("query_id", "question"))
    found = S.small(D.ranked(spark, d, k) if ranked is None else ranked)
    return D.corpus(spark, d).join(found, ["doc_id", "page"]).join(q, "query_id")


_LEX = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 2))"
_CAND = f"{D.top(10)}, cd AS (SELECT top.*, q.question, d.text FROM top JOIN q USING (query_id) JOIN documents d ON d.doc_id = top.doc_id)"
_LEXSCORE = f"round(len(list_intersect({_LEX.format(c='question')}, {_LEX.format(c='text')})) / greatest(len(list_distinct(list_concat({_LEX.format(c='question')}, {_LEX.format(c='text')}))), 1), 9)"


@query(f"WITH {_CAND} SELECT query_id, doc_id, page, {_LEXSCORE} AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY {_LEXSCORE} DESC, rank) AS rerank_rank FROM cd")
def lexical_rerank(spark, d):
    """RRK2, TOK3."""
    return K.rerank(_candidates(spark, d)).select("query_id", "doc_id", "page", "rerank_score", "rerank_rank")


_FT = D.tokens("{c}", 2)
_FQ = _FT.replace("{c}", "question")
_FE = f"array_to_string({_FT.replace('{c}', 'text')}, ' ')"


def _phrase(n: int) -> str:
    return f"CASE WHEN len(qt) >= {n} THEN len(list_filter(list_transform(range(1, len(qt) - {n - 2}), lambda i: array_to_string(qt[i:i + {n - 1}], ' ')), lambda x: contains(ev, x))) / (len(qt) - {n - 1}) ELSE 0.0 END"


_FEATURES = f"""{_CAND}, f0 AS (SELECT *, {_FQ} AS qt, {_FT.replace('{c}', 'text')} AS et, {_FE} AS ev,
  list_distinct(list_transform(regexp_extract_all(question, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', ''))) AS qn, list_distinct(list_transform(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', ''))) AS en FROM cd),
f1 AS (SELECT *, list_filter(list_distinct(qt), lambda x: NOT list_contains({words(*T.FUSION_STOP)}, x)) AS qk FROM f0),
f AS (SELECT query_id, doc_id, page, score, rank, question, text, round(len(list_intersect(qn, en)) / greatest(len(qn), 1), 9) AS number_match, round(len(list_filter(qk, lambda x: list_contains(et, x))) / greatest(len(qk), 1), 9) AS keyword_match,
  round(CASE WHEN len(qt) < 3 OR ev = '' THEN 0.0 ELSE greatest({_phrase(5)}, {_phrase(4)}, {_phrase(3)}) END, 9) AS exact_phrase_match FROM f1)"""


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, page, number_match, keyword_match, exact_phrase_match FROM f")
def fusion_features(spark, d):
    """FUS2, FUS3, FUS4, TOK2, NUM6."""
    return K.fusion_features(_candidates(spark, d)).select("query_id", "doc_id", "page", "number_match", "keyword_match", "exact_phrase_match")


_MM = "CASE WHEN max({x}) OVER w - min({x}) OVER w <= 1e-12 THEN 1.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"


@query(f"""WITH {_FEATURES}, l AS (SELECT *, {_LEXSCORE} AS lx FROM f),
n AS (SELECT *, {_MM.format(x='score')} AS a, {_MM.format(x='lx')} AS b FROM l WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, page, rank, round(a + 0.2 * b + 1.0, 9) AS base_score, round(a + 0.2 * b + 1.0 + 0.05 * number_match + 0.05 * keyword_match + 0.05 * exact_phrase_match, 9) AS fusion_score FROM n)
SELECT query_id, doc_id, page, base_score, fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, rank) AS fusion_rank FROM s""")
def score_fusion(spark, d):
    """FUS1, FUS6: with a lexical text score and no image score; header matches are 0 for these questions."""
    c = K.fusion_features(_candidates(spark, d))
    c = c.withColumns({"text_rerank_score": F.round(K.SCORERS["lexical"](F.col("question"), F.col("text")), 9), "rerank_score": F.lit(None).cast("double")})
    return R.weighted_fusion(c).select("query_id", "doc_id", "page", "base_score", "fusion_score", "fusion_rank")


_LISTS = f"""{_CAND}, lx AS (SELECT query_id, doc_id, page, row_number() OVER (PARTITION BY query_id ORDER BY {_LEXSCORE} DESC, rank) AS rank FROM cd)"""


def _lists(spark, d):
    ranked = D.ranked(spark, d, 10)
    lexical = K.rerank(_candidates(spark, d, ranked=ranked)).select("query_id", "doc_id", "page", F.col("rerank_rank").alias("rank"))
    return [ranked, lexical]


def _rrf(a: float, b: float) -> str:
    return f"""WITH {_LISTS}, u AS (SELECT query_id, doc_id, page, {a} / (60 + rank) AS x, 0 AS m FROM top UNION ALL SELECT query_id, doc_id, page, {b} / (60 + rank), 1 FROM lx),
s AS (SELECT query_id, doc_id, page, round(sum(x), 12) AS score, min(m)::BIGINT AS first_module, count(*) AS n_modules FROM u GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM s QUALIFY rank <= 8"""


@query(_rrf(1.0, 1.0))
def rrf_fusion(spark, d):
    """FUS7."""
    return R.rrf(_lists(spark, d), top=8)


@query(_rrf(0.7, 1.5))
def weighted_rrf(spark, d):
    """FUS8."""
    return R.rrf(_lists(spark, d), weights=[0.7, 1.5], top=8)


_STATS = f"{D.top(10)}, st AS (SELECT query_id, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS top2, count(*) AS n FROM top GROUP BY 1)"
_REASON = "CASE WHEN top1 IS NULL THEN 'no_candidates' WHEN top2 IS NULL THEN 'not_enough_candidates_for_gap' WHEN top1 >= {a} AND top1 - top2 >= {b} THEN 'top1_and_gap_passed' WHEN top1 < {a} AND top1 - top2 < {b} THEN 'top1_and_gap_below_thresholds' WHEN top1 < {a} THEN 'top1_below_threshold' ELSE 'gap_below_threshold' END"


@query(f"WITH {_STATS} SELECT query_id, top1, top2, n, round(top1 - top2, 9) AS gap, round(CASE WHEN abs(top1) > 1e-12 THEN (top1 - top2) / abs(top1) END, 9) AS relative_gap, {_REASON.format(a=40, b=5)} AS reason FROM st")
def confidence_skip(spark, d):
    """PRD8, WIN3."""
    c = K.confidence(D.ranked(spark, d, 10))
    return c.select("query_id", "top1", "top2", "n", F.round("gap", 9).alias("gap"), F.round("relative_gap", 9).alias("relative_gap"), I.skip_reason(F.col("top1"), F.col("top2"), 40, 5).alias("reason"))


@query(f"""WITH {_STATS}, g AS (SELECT unnest([20, 30, 40])::DOUBLE AS t1), g2 AS (SELECT unnest([1, 5, 10])::DOUBLE AS gap_t), r AS (SELECT t1, gap_t, {_REASON.format(a='t1', b='gap_t')} AS reason FROM st, g, g2)
SELECT t1, gap_t, count(*) AS n, (count(*) FILTER (reason = 'top1_and_gap_passed'))::BIGINT AS skipped, round(avg((reason = 'top1_and_gap_passed')::INT), 6) AS skip_rate FROM r GROUP BY ALL""")
def threshold_grid(spark, d):
    """ORC4, RPT8, RPT9: nine pairs of thresholds in one job."""
    grid = spark.createDataFrame([(float(a), float(b)) for a in (20, 30, 40) for b in (1, 5, 10)], "t1 double, gap_t double")
    return P.threshold_grid(K.confidence(D.ranked(spark, d, 10)), grid)


_INTENT = r"""i AS (SELECT *, lower(question) AS lo, regexp_matches(question, '(?i)\b(table|figure|fig\.?)\s*([0-9]+[a-z]?)\b') AS has_ref, replace(lower(regexp_extract(question, '(?i)\b(table|figure|fig\.?)\s*([0-9]+[a-z]?)\b', 1)), '.', '') AS rk, lower(regexp_extract(question, '(?i)\b(table|figure|fig\.?)\s*([0-9]+[a-z]?)\b', 2)) AS rn FROM k),
j AS (SELECT *, CASE WHEN has_ref THEN concat(CASE WHEN starts_with(rk, 'fig') THEN 'figure' ELSE rk END, ' ', rn) END AS reference, regexp_matches(lo, '\btable\b') AS ht, regexp_matches(lo, '\b(figure|fig\.?|chart|graph|plot|diagram|architecture|component|image|picture|photo)\b') AS hv FROM i),
m AS (SELECT *, CASE WHEN reference IS NOT NULL THEN CASE WHEN starts_with(reference, 'table') THEN 'table' ELSE 'visual' END WHEN ht AND NOT hv THEN 'table' WHEN hv AND NOT ht THEN 'visual' ELSE 'unknown' END AS intent, list_filter(list_distinct(list_filter(regexp_extract_all(lo, '[a-z0-9]+'), lambda t: length(t) > 2)), lambda t: NOT list_contains(""" + words(*T.LAYOUT_STOP) + ", t)) AS lt FROM j)"


@query(f"""WITH {D.ASKED}, {_INTENT}
SELECT query_id, reference, intent,
  CASE WHEN list_contains(lt, 'table') OR regexp_matches(lo, '\\btable\\s*\\d+\\b') THEN 'table' WHEN list_has_any(lt, {words(*I.LAYOUT_VISUAL)}) OR qtype = 'multimodal-f' THEN 'figure' WHEN list_has_any(lt, {words(*I.LAYOUT_TABLE)}) THEN 'table' ELSE 'text' END AS target,
  regexp_matches(lo, 'figure|fig\\.|chart|graph|plot|diagram|image|picture|photo|architecture|shown') AS visual, regexp_matches(lo, '{"|".join(I.TABLE_HEAVY)}') AS table_heavy,
  (list_has_any(lt, {words(*I.LAYOUT_TABLE)}) OR regexp_matches(question, '(?i)\\b(total|difference|ratio|increase|decrease|percentage|score|accuracy|f1)\\b')) AS numeric_table_heavy,
  CASE WHEN regexp_matches(lo, 'figure|fig\\.|chart|graph|plot|diagram|image|picture|photo|architecture|shown') OR qtype = 'multimodal-f' THEN 5 ELSE 3 END::BIGINT AS pages FROM m""")
def question_intent(spark, d):
    """PRD1 to PRD5, PRD10, TOK4."""
    q, t = F.col("question"), F.col("qtype")
    return D.asked(spark, d).select("query_id", I.reference(q).alias("reference"), I.crop_intent(q).alias("intent"), I.target_type(q, t).alias("target"), I.visual_question(q).alias("visual"), I.table_heavy(q).alias("table_heavy"), I.numeric_table_heavy(q).alias("numeric_table_heavy"), I.context_pages(q, t).alias("pages"))


@query(f"""WITH {D.ASKED}, {_INTENT}, z AS (SELECT *, string_split_regex(translate(lo, '/-', '  '), '\\s+') AS tk, (query_id % 11)::DOUBLE / 10 AS top1, (query_id % 7)::DOUBLE / 10 AS top2 FROM m)
SELECT query_id, CASE WHEN top1 >= 0.7 AND top1 - top2 >= 0.25 THEN 'high_confidence' WHEN qtype = 'multimodal-f' OR intent = 'visual' OR list_has_any(tk, {words(*I.ROUTE_VISUAL)}) THEN 'visual' WHEN qtype = 'multimodal-t' OR intent = 'table' OR list_has_any(tk, {words(*I.ROUTE_TABLE)}) THEN 'table_or_text' ELSE 'unknown' END AS route,
  CASE WHEN qtype IN ('text-only', 'meta-data', 'unanswerable') THEN 'text' ELSE 'multimodal' END AS pipeline FROM z""")
def adaptive_route(spark, d):
    """PRD6, PRD7, PRD11."""
    top1, top2 = F.expr("cast(query_id % 11 as double) / 10"), F.expr("cast(query_id % 7 as double) / 10")
    return D.asked(spark, d).select("query_id", I.route(F.col("question"), F.col("qtype"), I.confident(top1, top2, 0.7, 0.25)).alias("route"), I.pipeline_of(F.col("qtype")).alias("pipeline"))


@query(f"""WITH {D.ASKED}, h AS (SELECT query_id, {', '.join(f"len(list_filter({words(*names)}, lambda x: contains(lower(question), x))) > 0 AS {m}" for m, names in I.ROUTER.items())} FROM k)
SELECT query_id, CASE WHEN NOT clip AND NOT layoutlm AND NOT e5 THEN 'bm25,e5' ELSE concat('bm25', CASE WHEN clip THEN ',clip' ELSE '' END, CASE WHEN layoutlm THEN ',layoutlm' ELSE '' END, CASE WHEN e5 THEN ',e5' ELSE '' END) END AS modules FROM h""")
def smart_router(spark, d):
    """PRD9."""
    return D.asked(spark, d).select("query_id", F.array_join(I.modules(F.col("question")), ",").alias("modules"))


def _typed(spark, d):
    return _candidates(spark, d).withColumn("qtype", F.expr("CASE query_id % 3 WHEN 0 THEN 'text-only' WHEN 1 THEN 'multimodal-t' ELSE 'multimodal-f' END"))


@query(f"""WITH {_CAND}, t AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'table_or_text' ELSE 'visual' END AS route FROM cd),
c AS (SELECT *, max(score) FILTER (rank = 1) OVER (PARTITION BY query_id) AS top1, max(score) FILTER (rank = 2) OVER (PARTITION BY query_id) AS top2 FROM t),
r AS (SELECT *, CASE WHEN coalesce(top1 >= 40 AND top1 - top2 >= 5, false) THEN 'high_confidence' ELSE route END AS rt FROM c),
s AS (SELECT query_id, doc_id, page, rank, rt AS route, rt IN ('high_confidence', 'visual') AS skipped, CASE WHEN rt NOT IN ('high_confidence', 'visual') THEN {_LEXSCORE} END AS rerank_score FROM r)
SELECT query_id, doc_id, page, route, skipped, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM s""")
def adaptive_rerank(spark, d):
    """RRK7, AGG16's input: a lexical scorer for text routes, none for images."""
    out = K.adaptive(_typed(spark, d), {"text_image": K.SCORERS["lexical"]}, 40, 5)
    return out.select("query_id", "doc_id", "page", "route", "skipped", "rerank_score", "new_rank")


@query(f"""WITH {_CAND}, c AS (SELECT *, max(score) FILTER (rank = 1) OVER (PARTITION BY query_id) AS top1, max(score) FILTER (rank = 2) OVER (PARTITION BY query_id) AS top2 FROM cd),
r AS (SELECT *, {_REASON.format(a=30, b=5)} AS reason FROM c), s AS (SELECT query_id, doc_id, page, rank, reason, CASE WHEN reason <> 'top1_and_gap_passed' THEN {_LEXSCORE} END AS rerank_score FROM r)
SELECT query_id, doc_id, page, reason, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM s""")
def threshold_rerank(spark, d):
    """RRK8."""
    return K.threshold_skip(_candidates(spark, d), K.SCORERS["lexical"], 30, 5).select("query_id", "doc_id", "page", "reason", "rerank_score", "new_rank")


# -- candidates --------------------------------------------------------------


@query(f"""WITH {D.dense_top(5)}, e AS (SELECT dt.*, unnest([-1, 0, 1]) AS delta FROM dt), p AS (SELECT e.query_id, e.doc_id, e.page + e.delta AS page, e.score, e.rank, e.delta FROM e),
x AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id, p.doc_id, p.page ORDER BY p.rank, p.delta) AS n FROM p SEMI JOIN v ON v.doc_id = p.doc_id AND v.page = p.page QUALIFY n = 1),
s AS (SELECT query_id, doc_id, page, CASE WHEN delta = 0 THEN score ELSE score * 0.8 END AS score, rank AS source_rank, delta::BIGINT AS delta FROM x)
SELECT query_id, doc_id, page, round(score, 9) AS score, source_rank, delta, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_rank, delta) AS rank FROM s QUALIFY rank <= 8""")
def neighbor_expand(spark, d):
    """CND1."""
    return R.neighbours(D.dense(spark, d, 5), D.vectors(spark, d), 1, 8).withColumn("score", F.round("score", 9))


@query(f"""WITH {D.dense_top(5)}, e AS (SELECT dt.*, unnest([-1, 0, 1]) AS delta FROM dt), p AS (SELECT e.query_id, e.doc_id, e.page + e.delta AS page, e.score, e.rank, e.delta FROM e),
x AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id, p.doc_id, p.page ORDER BY p.rank, p.delta) AS n FROM p SEMI JOIN v ON v.doc_id = p.doc_id AND v.page = p.page QUALIFY n = 1)
SELECT query_id, doc_id, page, score, delta::BIGINT AS neighbor_delta, row_number() OVER (PARTITION BY query_id ORDER BY x.rank, delta) AS rank FROM x""")
def neighbor_in_order(spark, d):
    """CND2."""
    return R.neighbours_in_order(D.dense(spark, d, 5), D.vectors(spark, d), 1)


@query(f"""WITH {_ROUTE[5:]}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM (SELECT query_id, doc_id, page, round(score, 9) AS score FROM s) QUALIFY rank <= 20),
c AS (SELECT query_id, doc_id, count(*) AS votes, min(rank) AS best FROM t WHERE rank <= 8 GROUP BY ALL), w AS (SELECT query_id, doc_id AS winner, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best) AS n FROM c QUALIFY n = 1),
y AS (SELECT t.*, votes, (doc_id = winner AND votes >= 3) AS won FROM t JOIN w USING (query_id)), z AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, page ORDER BY rank) AS m FROM y WHERE won OR rank <= 8 QUALIFY m = 1)
SELECT query_id, doc_id, page, score, votes, row_number() OVER (PARTITION BY query_id ORDER BY won DESC, z.rank) AS new_rank FROM z QUALIFY new_rank <= 8""")
def folder_vote(spark, d):
    """CND3 (vote3): labels stand for documents."""
    full = S.dense_search(D.vector_queries(spark, d), _labelled(spark, d), 20)
    return R.vote(full, 8, 3).withColumnRenamed("rank", "new_rank")


_TILES = f"""{D.VECTORS}, {D.UNIT}, ti AS (SELECT q.vec_id AS query_id, u.label::BIGINT AS doc_id, (u.vec_id // 10) % 20 AS page, u.vec_id AS tile, round(list_dot_product(q.v, u.v), 9) AS score FROM u JOIN u q ON q.vec_id % 50 = 0),
tt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile) AS rank FROM ti)"""


def _tiles(spark, d, best: int | None = None):
    """Tiles of pages by their scores; of each query and page all, or what holds the best ones, and how many tiles a row stands for."""
    v = D.vectors(spark, d).select(F.col("label").cast("long").alias("doc_id"), F.expr("floor(vec_id / 10) % 20").alias("page"), F.col("vec_id").alias("tile"), "vec")
    found = B.group_scores(D.vector_queries(spark, d), v, ("vec", "vec"), ["doc_id", "page", "tile"], ["doc_id", "page"], best)
    return found.where("tile is not null").withColumn("score", F.round("score", 9))


@query(f"""WITH {_TILES}, g AS (SELECT query_id, doc_id, page, count(*) AS tiles, arg_max(tile, (score, -tile)) AS tile, max(score) + CASE WHEN count(*) > 1 THEN 0.001 * least(count(*) - 1, 5) ELSE 0 END AS score FROM tt GROUP BY ALL)
SELECT query_id, doc_id, page, tiles, tile, round(score, 9) AS score FROM g""")
def tile_to_page(spark, d):
    """CND4."""
    return R.tiles_to_pages(_tiles(spark, d, 1)).select("query_id", "doc_id", "page", "tiles", "tile", F.round("score", 9).alias("score"))


@query(f"""WITH {_TILES}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, tile) AS n FROM tt)
SELECT query_id, doc_id, max(score) AS max_score, round(avg(score) FILTER (n <= 3), 9) AS mean3, round(avg(score) FILTER (n <= 5), 9) AS mean5, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, count(*) AS hits FROM n GROUP BY ALL""")
def tile_modes(spark, d):
    """CND5."""
    v = D.vectors(spark, d).select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("tile"), "vec")
    out = B.modes(D.vector_queries(spark, d), v, ("vec", "vec"), "doc_id")
    if out is None:
        out = R.tile_modes(R.top_k(_tiles(spark, d), None, ties=["tile"]), ["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean3", "mean5", "rrf")})


_HUB = f"""{D.top(10)}, dh AS (SELECT doc_id, count(*) AS c FROM top GROUP BY 1),
hb AS (SELECT top.*, round(score - 0.05 * ln(1 + dh.c) - 0.02 * ln(1 + dh.c), 9) AS dehub_score FROM top JOIN dh USING (doc_id))"""


@query(f"WITH {_HUB} SELECT query_id, doc_id, page, dehub_score, row_number() OVER (PARTITION BY query_id ORDER BY dehub_score DESC, rank) AS dehub_rank FROM hb")
def dehub_rerank(spark, d):
    """RRK10."""
    return R.dehub(D.ranked(spark, d, 10)).select("query_id", "doc_id", "page", "dehub_score", "dehub_rank")


@query(f"""WITH {_HUB}, {D.GOLD}, n AS (SELECT 'raw' AS ranking, query_id, doc_id, rank FROM top UNION ALL SELECT 'dehub', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dehub_score DESC, rank) FROM hb),
m AS (SELECT n.ranking, query_id, min(n.rank) AS r FROM n JOIN gold USING (query_id, doc_id) GROUP BY ALL), g AS (SELECT DISTINCT query_id, ranking FROM gold, (SELECT unnest(['raw', 'dehub']) AS ranking))
SELECT g.ranking, round(avg(coalesce((r <= 1)::INT, 0)), 9) AS hit_1, round(avg(coalesce((r <= 5)::INT, 0)), 9) AS hit_5 FROM g LEFT JOIN m USING (query_id, ranking) GROUP BY 1""")
def dehub_recall(spark, d):
    """RTM11."""
    return X.dehub_recall(D.ranked(spark, d, 10), D.gold(spark, d), D.questions(spark, d), [1, 5])


@query(f"""WITH {D.top(10)} SELECT doc_id, count(*) FILTER (rank = 1) AS top1, count(*) AS topk, round(count(*) / (SELECT count(*) FROM q), 9) AS share, row_number() OVER (ORDER BY count(*) DESC, doc_id) AS position FROM top GROUP BY 1 QUALIFY position <= 10""")
def hubness(spark, d):
    """RTM10, AGG17."""
    return X.hubness(D.ranked(spark, d, 10), D.questions(spark, d))


@query(f"WITH {D.top(10)} SELECT query_id, string_agg(concat(doc_id, '/', page), ',' ORDER BY rank) AS labels FROM top GROUP BY 1")
def page_labels(spark, d):
    """CND7."""
    return R.page_labels(D.ranked(spark, d, 10))


# -- evidence and context ----------------------------------------------------


_EVIDENCE = """x AS (SELECT doc_id, nullif(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '') AS t, CASE WHEN doc_id % 3 = 0 THEN concat('Table ', doc_id) END AS tb, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS cp FROM documents),
ev AS (SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN tb IS NOT NULL THEN concat('[TABLE_TEXT]', chr(10), tb) END, CASE WHEN cp <> '' THEN concat('[CAPTION]', chr(10), cp) END, CASE WHEN t IS NOT NULL THEN concat('[PAGE_TEXT]', chr(10), t) END) AS evidence,
array_to_string(list_filter([CASE WHEN tb IS NOT NULL THEN 'table_text' END, CASE WHEN cp <> '' THEN 'caption' END, CASE WHEN t IS NOT NULL THEN 'page_text' END], lambda z: z IS NOT NULL), ',') AS fields FROM x)"""


def _evidence(spark, d):
    x = D.table(spark, d, "documents").select("doc_id", F.col("text").alias("t"), F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('Table ', doc_id) END").alias("tb"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END").alias("cp"))
    return E.evidence_text(x, {"table_text": ["tb"], "caption": ["cp"], "page_text": ["t"]})


@query(f"WITH {_EVIDENCE} SELECT doc_id, md5(evidence) AS evidence, length(evidence) AS n_chars, fields FROM ev WHERE evidence <> ''")
def evidence_text(spark, d):
    """EVD2, EVD3: the whole text of each page, as a digest and its length."""
    return _evidence(spark, d).select("doc_id", F.md5("evidence").alias("evidence"), F.length("evidence").alias("n_chars"), F.array_join("available_fields", ",").alias("fields"))


@query(f"WITH {_EVIDENCE} SELECT doc_id, md5(substring(evidence, 1, 4096)) AS text, length(substring(evidence, 1, 4096)) AS n_chars FROM ev WHERE evidence <> ''")
def rerank_text(spark, d):
    """EVD8: evidence as the reranker reads it, at most its 4096 characters."""
    text = K.truncate(F.col("evidence"), 4096)
    return _evidence(spark, d).select("doc_id", F.md5(text).alias("text"), F.length(text).alias("n_chars"))


_CAP = r"(?i)^(?:table|figure|fig\.?|chart|graph)\s*[0-9]+[a-z]?\b"
_NEXT = r"CASE WHEN NOT regexp_matches({x}, '" + _CAP + r"') AND NOT regexp_matches({x}, '^\d+(\.\d+)*\.?\s+[A-Z]') AND length({x}) > 2 THEN {x} END"


@query(f"""WITH {D.CAPTIONED}, nx AS (SELECT *, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3 FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)),
c1 AS (SELECT *, {_NEXT.format(x='l1')} AS n1, {_NEXT.format(x='l2')} AS n2, {_NEXT.format(x='l3')} AS n3 FROM nx WHERE regexp_matches(line, '{_CAP}')),
c2 AS (SELECT doc_id, page, n AS pos, CASE WHEN n1 IS NULL THEN line WHEN n2 IS NULL THEN concat_ws(' ', line, n1) WHEN n3 IS NULL THEN concat_ws(' ', line, n1, n2) ELSE concat_ws(' ', line, n1, n2, n3) END AS caption,
  replace(lower(regexp_extract(line, '(?i)^(table|figure|fig\\.?|chart|graph)\\s*([0-9]+[a-z]?)\\b', 1)), '.', '') || ' ' || lower(regexp_extract(line, '(?i)^(table|figure|fig\\.?|chart|graph)\\s*([0-9]+[a-z]?)\\b', 2)) AS reference FROM c1)
SELECT doc_id, page, pos, caption, reference FROM c2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, lower(caption) ORDER BY pos) = 1""")
def captions(spark, d):
    """EVD4, NRM6, WIN6."""
    return E.captions(D.captioned(spark, d))


@query(f"""WITH {D.CAPTIONED}, b AS (SELECT doc_id, page, n AS pos, line, array_to_string(list(line) OVER (PARTITION BY doc_id, page ORDER BY n ROWS BETWEEN 28 PRECEDING AND 10 FOLLOWING), chr(10)) AS block FROM ln)
SELECT doc_id, page, pos, md5(block) AS block FROM b WHERE regexp_matches(line, '(?i)^table\\s*[0-9]+[a-z]?\\b') QUALIFY row_number() OVER (PARTITION BY doc_id, page, regexp_replace(lower(block), '\\s+', ' ', 'g') ORDER BY pos) = 1""")
def table_blocks(spark, d):
    """EVD5, WIN7."""
    return E.table_blocks(D.captioned(spark, d)).withColumn("block", F.md5("block"))


_PACK = f"""{_CAND}, pk AS (SELECT query_id, rank, concat('[rank=', rank, ' doc_id=', doc_id, ' page=', page, ']', chr(10)) AS head, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) AS body FROM cd),
ru AS (SELECT *, 12000 - coalesce(sum(length(head) + length(body) + {{sep}}) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(head) AS room FROM pk WHERE body <> '')
SELECT query_id, md5(string_agg(head || substring(body, 1, room::BIGINT), chr(10) || chr(10) ORDER BY rank) FILTER (room > 0)) AS context, count(*) FILTER (room > 0) AS n_blocks, bool_or(room < length(body)) AS truncated FROM ru GROUP BY 1"""


@query(f"WITH {_PACK.format(sep=2)}")
def pack_context(spark, d):
    """CTX1, WIN4."""
    return E.pack_context(_candidates(spark, d), 12000).withColumn("context", F.md5("context"))


@query(f"WITH {_PACK.format(sep=0)}")
def pack_text_context(spark, d):
    """CTX2."""
    return E.pack_context(_candidates(spark, d), 12000, 0).withColumn("context", F.md5("context"))


@query(f"""WITH {_CAND}, n AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k, text FROM cd WHERE length(trim(text)) > 10 QUALIFY k <= 5)
SELECT query_id, md5(string_agg(concat('[', k, '] ', substring(text, 1, 4000)), chr(10) || chr(10) ORDER BY k)) AS context FROM n GROUP BY 1""")
def numbered_context(spark, d):
    """CTX3."""
    return E.numbered_context(_candidates(spark, d)).withColumn("context", F.md5("context"))


# -- answers -----------------------------------------------------------------

_NA = "trim(regexp_replace(replace(trim(lower({c})), ',', ''), '\\s+', ' ', 'g'))"
_NUMA = r"list_transform(list_transform(regexp_extract_all({c}, '[$€£₹]?\d[\d,]*(?:\.\d+)?%?'), lambda t: regexp_replace(rtrim(regexp_replace(lower(t), '[,$€£₹]', '', 'g'), '.'), '%$', '')), lambda x: CASE WHEN try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE)) THEN floor(try_cast(x AS DOUBLE))::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.6f', try_cast(x AS DOUBLE)), '0'), '.') END)"
_F1W = "list_distinct(list_filter(regexp_extract_all({c}, '[a-z][a-z0-9_\\-]*'), lambda t: length(t) > 2 AND NOT list_contains(" + words(*T.ANSWER_STOP) + ", t)))"
_F = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
_SCORED = f"""{D.ANSWERS}, n0 AS (SELECT *, {_NA.format(c='generated')} AS g, {_NA.format(c='expected')} AS e FROM a),
n1 AS (SELECT *, {_F1W.format(c='g')} AS gw, {_F1W.format(c='e')} AS ew, regexp_extract_all(g, '\\d+(?:\\.\\d+)?%?') AS gn, regexp_extract_all(e, '\\d+(?:\\.\\d+)?%?') AS en, regexp_replace(g, '[^a-z0-9]+', '', 'g') AS gc, regexp_replace(e, '[^a-z0-9]+', '', 'g') AS ec, {_NUMA.format(c='generated')} AS ga, {_NUMA.format(c='expected')} AS ea FROM n0),
n2 AS (SELECT *, len(list_intersect(gw, ew)) / greatest(len(gw), 1) AS wp, len(list_intersect(gw, ew)) / greatest(len(ew), 1) AS wr, len(list_intersect(list_distinct(gn), list_distinct(en))) / greatest(len(gn), 1) AS np, len(list_intersect(list_distinct(gn), list_distinct(en))) / greatest(len(en), 1) AS nr FROM n1),
n3 AS (SELECT *, CASE WHEN generated IN ('NOT FOUND', 'ERROR', 'TIMEOUT') THEN 0.0 ELSE round(CASE WHEN len(en) > 0 THEN 0.4 * ({_F.format(p='wp', r='wr')}) + 0.6 * ({_F.format(p='np', r='nr')}) ELSE {_F.format(p='wp', r='wr')} END, 9) END AS token_f1,
  coalesce(list_sum(list_transform(list_distinct(ea), lambda v: least(len(list_filter(ea, lambda y: y = v)), len(list_filter(ga, lambda y: y = v))))), 0) AS m FROM n2),
mt AS (SELECT query_id, expected, generated, qtype, latency, token_f1, token_f1 AS f1, (translate(g, ' %', '') = translate(e, ' %', ''))::INT::DOUBLE AS exact_match, (gc = ec)::INT::DOUBLE AS relaxed_exact, (ec <> '' AND contains(gc, ec))::INT::DOUBLE AS answer_contains_expected, (gc <> '' AND contains(ec, gc))::INT::DOUBLE AS expected_contains_answer,
  list_has_any(ea, ga)::INT::DOUBLE AS numeric_any_match, CASE WHEN len(ea) > 0 THEN (m = len(ea))::INT ELSE (len(ga) = 0)::INT END::DOUBLE AS numeric_all_recall, round(CASE WHEN len(ga) > 0 THEN m / len(ga) ELSE (len(ea) = 0)::INT END, 9)::DOUBLE AS numeric_precision, round(CASE WHEN len(ea) > 0 THEN m / len(ea) ELSE (len(ga) = 0)::INT END, 9)::DOUBLE AS numeric_recall FROM n3)"""
_METRICS = ["exact_match", "token_f1", "relaxed_exact", "answer_contains_expected", "expected_contains_answer", "numeric_any_match", "numeric_all_recall", "numeric_precision", "numeric_recall"]


def _scored(spark, d):
    return M.row_metrics(D.answers(spark, d)).withColumn("f1", F.col("token_f1"))


@query(f"WITH {_SCORED} SELECT query_id, token_f1 FROM mt")
def token_f1(spark, d):
    """MET1, NRM1."""
    return D.answers(spark, d).select("query_id", M.token_f1(F.col("generated"), F.col("expected")).alias("token_f1"))


@query(f"WITH {_SCORED} SELECT query_id, {', '.join(_METRICS)} FROM mt")
def row_metrics(spark, d):
    """MET3, NUM1, NUM2, NRM4, NRM5."""
    return M.row_metrics(D.answers(spark, d)).select("query_id", *_METRICS)


_SIGNED = r"list_transform(regexp_extract_all({c}, '[$₹€£]?\s*-?\d[\d,]*(?:\.\d+)?\s*%?'), lambda t: {{'raw': trim(t), 'value': try_cast(trim(regexp_replace(trim(t), '[,$₹€£%]', '', 'g')) AS DOUBLE)}})"


@query(f"""WITH {D.ANSWERS}, x AS (SELECT query_id, {_SIGNED.format(c='generated')} AS g, {_SIGNED.format(c='expected')} AS e FROM a)
SELECT query_id, CASE WHEN len(e) > 0 THEN (list_sort(list_transform(g, lambda v: v.value)) = list_sort(list_transform(e, lambda v: v.value)))::INT::DOUBLE END AS numeric_exact_match, len(e) AS n_expected, round(list_sum(list_transform(e, lambda v: v.value)), 6) AS total FROM x""")
def numeric_match(spark, d):
    """NUM3, NUM4, NUM8."""
    v = lambda c: N.numeric_values(F.col(c))
    plain = lambda c: F.transform(v(c), lambda x: x["normalized"])
    total = F.when(F.size(v("expected")) > 0, F.aggregate(v("expected"), F.lit(0.0), lambda s, x: s + x["value"]))
    return D.answers(spark, d).select("query_id", N.multiset_exact(plain("generated"), plain("expected")).alias("numeric_exact_match"), F.size(v("expected")).alias("n_expected"), F.round(total, 6).alias("total"))


_FIT = "CASE WHEN v.pct OR {e}.pct THEN abs(v.value - {e}.value) <= 0.1 WHEN {e}.whole THEN v.value = {e}.value ELSE abs(v.value - {e}.value) / greatest(abs({e}.value), 1e-12) <= 0.01 END"
_VALUES = "list_filter(list_transform({x}, lambda v: {{'value': v.value, 'pct': contains(v.raw, '%'), 'whole': v.value = floor(v.value) AND NOT contains(v.raw, '.')}}), lambda v: v.value IS NOT NULL)"
_MENTION = rf"(?i)([$€£₹])?\s*(-?\d[\d,]*(?:\.\d+)?)\s*({N.MENTION_UNITS})?"
_MENTION_ALIAS = "MAP {" + ", ".join(f"'{n}': '{u}'" for n, u in N.MENTION_ALIASES.items()) + "}"
_MENTIONS = f"""list_filter(list_transform(list_zip(regexp_extract_all({{c}}, '{_MENTION}', 1), regexp_extract_all({{c}}, '{_MENTION}', 2), regexp_extract_all({{c}}, '{_MENTION}', 3)), lambda z: {{'value': try_cast(replace(z[2], ',', '') AS DOUBLE), 'whole': NOT contains(z[2], '.'),
  'unit': coalesce({_MENTION_ALIAS}[lower(coalesce(nullif(z[3], ''), nullif(z[1], ''), ''))], lower(coalesce(nullif(z[3], ''), nullif(z[1], ''), '')))}}), lambda v: v.value IS NOT NULL)"""
_PLAIN = "list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains(" + words(*N.PLAIN_SUFFIXES) + ", x))"


@query(f"""WITH RECURSIVE {D.ANSWERS}, x0 AS (SELECT query_id, {_SIGNED.format(c='generated')} AS g, {_SIGNED.format(c='expected')} AS e FROM a), x AS (SELECT query_id, {_VALUES.format(x='g')} AS g, {_VALUES.format(x='e')} AS e FROM x0),
st AS (SELECT query_id, 1 AS i, g AS rest, e FROM x UNION ALL SELECT query_id, i + 1, CASE WHEN spot > 0 THEN list_concat(rest[1:spot - 1], rest[spot + 1:]) END, e FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda v: {_FIT.format(e='e[i]')}), true), 0) AS spot FROM st WHERE i <= len(e) AND rest IS NOT NULL)),
rm AS (SELECT query_id, CASE WHEN len(any_value(e)) > 0 THEN bool_or(i = len(e) + 1 AND rest IS NOT NULL)::INT::DOUBLE END AS numeric_relaxed_match FROM st GROUP BY 1),
m AS (SELECT query_id, {_MENTIONS.replace('{c}', 'generated')} AS g, {_MENTIONS.replace('{c}', 'expected')} AS e, {_PLAIN.format(c='generated')} AS gp, {_PLAIN.format(c='expected')} AS ep FROM a),
w AS (SELECT *, list_distinct(list_filter(list_transform(g, lambda v: v.unit), lambda u: u <> '')) AS gu, list_distinct(list_filter(list_transform(e, lambda v: v.unit), lambda u: u <> '')) AS eu, array_to_string(gp, ' ') AS gs, array_to_string(ep, ' ') AS es FROM m)
SELECT query_id, numeric_relaxed_match,
  CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: len(list_filter(g, lambda v: abs(x.value - v.value) <= 1e-9)) = 0)) = 0 END AS all_numbers_exact,
  CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: len(list_filter(g, lambda v: CASE WHEN x.unit = '%' OR v.unit = '%' THEN abs(x.value - v.value) <= 0.1 WHEN x.whole AND v.whole THEN abs(x.value - v.value) <= 1e-9 ELSE abs(x.value - v.value) / greatest(abs(x.value), 1e-9) <= 0.01 END)) = 0)) = 0 END AS all_numbers_relaxed,
  CASE WHEN len(eu) > 0 THEN (len(list_filter(eu, lambda u: NOT list_contains(gu, u))) = 0)::INT::DOUBLE END AS mention_unit_match,
  CASE WHEN es <> '' AND NOT regexp_matches(es, '^[\\d\\s.%\\-]+$') THEN contains(gs, es) OR contains(es, gs) OR len(list_filter(list_distinct(ep), lambda x: list_contains(gp, x))) / greatest(len(list_distinct(ep)), 1) >= 0.8 END AS plain_entity_match
FROM w JOIN rm USING (query_id)""")
def numeric_relaxed(spark, d):
    """NUM9, NUM10, NUM7, NUM11."""
    out = M.mention_metrics(M.extended_metrics(D.answers(spark, d)))
    return out.select("query_id", "numeric_relaxed_match", "all_numbers_exact", "all_numbers_relaxed", "mention_unit_match", "plain_entity_match")


_ALIAS = "MAP {" + ", ".join(f"'{n}': '{u}'" for n, u in N.UNIT_ALIASES.items()) + "}"
_MT = "trim(regexp_replace(regexp_replace(translate(replace(replace(lower({c}), 'co2-e', 'co2e'), 'co2 e', 'co2e'), '−–—', '---'), '(\\d),(\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g'), '\\s+', ' ', 'g'))"


def _texts(spark, d):
    """Answers with their metric texts, each made once."""
    return D.answers(spark, d).withColumns({"gt": T.metric_text(F.col("generated")), "et": T.metric_text(F.col("expected"))})


def _units(c: str) -> str:
    t = _MT.format(c=c)
    phrases = ", ".join(f"CASE WHEN contains({t}, '{p}') THEN '{u}' END" for p, u in N.UNIT_PHRASES.items())
    marks = ", ".join(f"CASE WHEN contains({c}, '{s}') THEN '{u}' END" for s, u in N.SYMBOLS.items())
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({t}, '[a-z%$€₹][a-z0-9%$€₹\\-]*'), lambda z: ({_ALIAS})[regexp_replace(z, '^[ .,:;()\\[\\]{{}}]+|[ .,:;()\\[\\]{{}}]+$', '', 'g')]) || [CASE WHEN contains({t}, '%') THEN '%' END, {marks}, {phrases}], lambda z: z IS NOT NULL)))"


@query(f"""WITH {D.ANSWERS}, x AS (SELECT query_id, {_units('generated')} AS g, {_units('expected')} AS e FROM a)
SELECT query_id, array_to_string(g, ',') AS generated_units, array_to_string(e, ',') AS expected_units, CASE WHEN len(e) > 0 THEN (len(list_filter(e, lambda z: NOT list_contains(g, z))) = 0)::INT::DOUBLE END AS unit_match FROM x""")
def unit_match(spark, d):
    """UNIT1, UNIT2, NRM2."""
    a = _texts(spark, d)
    a = a.withColumns({"g": N.units(F.col("generated"), F.col("gt")), "e": N.units(F.col("expected"), F.col("et"))})
    g, e = F.col("g"), F.col("e")
    return a.select("query_id", F.array_join(g, ",").alias("generated_units"), F.array_join(e, ",").alias("expected_units"), N.subset(e, g).alias("unit_match"))


_NB = "trim(regexp_replace(replace(" + _MT + ", ',', ''), '\\s+', ' ', 'g'))"
_F2W = "list_distinct(list_filter(regexp_extract_all({c}, '[a-z][a-z0-9_\\-]*'), lambda t: length(t) > 2 AND NOT list_contains(" + words(*M.SIMILARITY_STOP) + ", t)))"
#: Answers that the table's own ones lack: negations, yes and no, words of the answer stop words alone.
_SPOKEN = "a UNION ALL BY NAME SELECT -query_id AS query_id, ['Yes', 'No, it does not', 'the answer', 'This is how', 'COUNT of 1,200 items'][1 + query_id % 5] AS generated, ['yes', 'No', 'The question', 'that was why', '1200 items, counted'][1 + query_id % 5] AS expected FROM a"


def _similarity(form: str) -> str:
    n = "len(list_intersect(list_distinct(gn), list_distinct(en)))"
    f = lambda b, x, y: _F.format(p=f"({b} / greatest(len({x}), 1))", r=f"({b} / greatest(len({y}), 1))")
    w = f("len(list_intersect(gw, ew))", "gw", "ew")
    return f"""s0 AS (SELECT query_id, generated, {form.format(c='generated')} AS g, {form.format(c='expected')} AS e FROM aa),
s1 AS (SELECT *, {_F2W.format(c='g')} AS gw, {_F2W.format(c='e')} AS ew, regexp_extract_all(g, '\\d+(?:\\.\\d+)?%?') AS gn, regexp_extract_all(e, '\\d+(?:\\.\\d+)?%?') AS en FROM s0),
s2 AS (SELECT query_id, generated IN ('NOT FOUND', 'ERROR', 'TIMEOUT') AS bad, translate(g, ' %', '') = translate(e, ' %', '') AS same, len(en) > 0 AS numeric_, {w} AS w, {f(n, "gn", "en")} AS n FROM s1)
SELECT query_id, CASE WHEN bad THEN 0.0 ELSE same::INT END::DOUBLE AS exact, CASE WHEN bad THEN 0.0 ELSE round(CASE WHEN numeric_ THEN 0.4 * w + 0.6 * n ELSE w END, 9) END::DOUBLE AS f1 FROM s2"""


def _spoken(spark, d) -> DataFrame:
    a = D.answers(spark, d).select("query_id", "generated", "expected")
    pick = lambda *x: F.array(*map(F.lit, x))[(F.col("query_id") % 5).cast("int")]
    more = a.select((-F.col("query_id")).alias("query_id"), pick("Yes", "No, it does not", "the answer", "This is how", "COUNT of 1,200 items").alias("generated"), pick("yes", "No", "The question", "that was why", "1200 items, counted").alias("expected"))
    return a.unionByName(more)


@query(f"WITH {D.ANSWERS}, aa AS (SELECT query_id, generated, expected FROM {_SPOKEN}), {_similarity(_NB)}")
def similarity(spark, d):
    """MET2 over NRM2."""
    return _spoken(spark, d).select("query_id", M.similarity(F.col("generated"), F.col("expected")).alias("s")).select("query_id", "s.exact", "s.f1")


@query(f"WITH {D.ANSWERS}, aa AS (SELECT query_id, generated, expected FROM {_SPOKEN}), {_similarity(_NA)}")
def similarity_plain(spark, d):
    """MET2 over NRM1."""
    return _spoken(spark, d).select("query_id", M.similarity(F.col("generated"), F.col("expected"), T.answer_a).alias("s")).select("query_id", "s.exact", "s.f1")


def _entities(c: str) -> str:
    t = f"regexp_replace({_MT.format(c=c)}, '[$₹€£]?\\s*-?\\d[\\d,]*(?:\\.\\d+)?\\s*%?', ' ', 'g')"
    return f"list_sort(list_filter(list_distinct(list_transform(regexp_extract_all({t}, '[a-z][a-z0-9&+\\-]*'), lambda z: regexp_replace(z, '^-+|-+$', '', 'g'))), lambda z: z <> '' AND NOT list_contains({words(*N.ENTITY_STOP, *N.ENTITY_SUFFIXES)}, z) AND ({_ALIAS})[z] IS NULL))"


@query(f"""WITH {D.ANSWERS}, x AS (SELECT query_id, {_entities('generated')} AS g, {_entities('expected')} AS e FROM a), y AS (SELECT *, len(list_intersect(g, e)) AS b, len(list_distinct(list_concat(g, e))) AS u FROM x)
SELECT query_id, array_to_string(e, ' ') AS expected_tokens, CASE WHEN len(e) > 0 THEN CASE WHEN len(g) = 0 THEN 0.0 ELSE (b = len(e) OR b / greatest(u, 1) >= 0.8 OR b / len(e) >= 0.9)::INT::DOUBLE END END AS entity_match FROM y""")
def entity_match(spark, d):
    """ENT1, ENT2."""
    a = _texts(spark, d)
    a = a.withColumns({"g": N.entity_tokens(F.col("generated"), F.col("gt")), "e": N.entity_tokens(F.col("expected"), F.col("et"))})
    g, e = F.col("g"), F.col("e")
    return a.select("query_id", F.array_join(e, " ").alias("expected_tokens"), N.entity_match(g, e).alias("entity_match"))


@query(f"""WITH {_SCORED} SELECT query_id, CASE WHEN f1 <= 0 THEN '0' WHEN f1 < 0.25 THEN '0-0.25' WHEN f1 < 0.5 THEN '0.25-0.5' WHEN f1 < 0.75 THEN '0.5-0.75' WHEN f1 < 1 THEN '0.75-1' ELSE '1' END AS bin,
CASE WHEN generated = 'NOT FOUND' THEN 'not_found' WHEN f1 >= 0.5 THEN '' WHEN numeric_any_match = 0 AND regexp_matches(expected, '[0-9]') THEN 'wrong_row_or_column' WHEN trim(generated) <> '' AND generated <> 'ERROR' THEN 'formatting_issue' ELSE 'wrong_page' END AS error_type,
array_to_string(list_filter([CASE WHEN trim(generated) = '' THEN 'empty' END, CASE WHEN generated IN ('NOT FOUND', 'ERROR', 'TIMEOUT') THEN 'refused' END, CASE WHEN f1 < 0.5 THEN 'low_f1' END, CASE WHEN numeric_recall < 1 THEN 'missing_number' END, CASE WHEN answer_contains_expected = 1 AND f1 < 0.5 THEN 'verbose' END, CASE WHEN f1 >= 0.9 THEN 'good' END], lambda z: z IS NOT NULL), ',') AS labels FROM mt""")
def error_labels(spark, d):
    """MET6, MET8, SNK2's column."""
    m = _scored(spark, d)
    return m.select("query_id", M.f1_bin(F.col("f1")).alias("bin"), M.suspected_error(m).alias("error_type"), F.array_join(M.error_labels(F.col("f1"), F.col("generated"), F.col("numeric_recall"), F.col("answer_contains_expected")), ",").alias("labels"))


@query(f"""WITH {_SCORED}, h AS (SELECT *, (query_id % 2)::DOUBLE AS dh, (query_id % 3 > 0)::INT::DOUBLE AS ph FROM mt)
SELECT query_id, CASE WHEN f1 >= 0.9 THEN 'correct' WHEN generated = 'ERROR' THEN 'generation_error' WHEN generated = 'TIMEOUT' THEN 'timeout' WHEN trim(generated) = '' THEN 'empty_answer' WHEN generated = 'NOT FOUND' AND ph = 1 THEN 'missed_evidence' WHEN generated = 'NOT FOUND' THEN 'not_found' WHEN dh = 0 THEN 'wrong_document' WHEN ph = 0 THEN 'wrong_page' WHEN answer_contains_expected = 1 AND f1 < 0.5 THEN 'over_generation' WHEN numeric_recall = 0 THEN 'wrong_number' WHEN numeric_recall < 1 THEN 'partial_number' WHEN f1 >= 0.5 THEN 'partially_correct' WHEN f1 > 0 THEN 'low_overlap' ELSE 'unrelated' END AS mode FROM h""")
def failure_mode(spark, d):
    """MET7."""
    m = _scored(spark, d)
    return m.select("query_id", M.failure_mode(F.col("f1"), F.col("generated"), F.expr("cast(query_id % 2 as double)"), F.expr("cast(query_id % 3 > 0 as double)"), F.col("numeric_recall"), F.col("answer_contains_expected")).alias("mode"))


# -- retrieval metrics -------------------------------------------------------

_REL = f"{D.top(10)}, {D.GOLD}, hit AS (SELECT top.*, (g.doc_id IS NOT NULL)::INT AS hit FROM top LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM gold) g ON g.query_id = top.query_id AND g.doc_id = top.doc_id), rl AS (SELECT query_id, count(DISTINCT doc_id) AS rel FROM gold GROUP BY 1)"


def _ranked_gold(spark, d):
    return D.ranked(spark, d, 10), D.gold(spark, d), D.questions(spark, d)


@query(f"WITH {_REL}, h AS (SELECT query_id, sum(hit) AS h FROM hit WHERE rank <= 5 GROUP BY 1) SELECT q.query_id, round(coalesce(h, 0) / 5, 9) AS precision, round(CASE WHEN rel > 0 THEN coalesce(h, 0) / rel ELSE 0.0 END, 9) AS recall FROM q LEFT JOIN h USING (query_id) LEFT JOIN rl USING (query_id)")
def precision_recall_at_k(spark, d):
    """RTM1."""
    return X.precision_recall(*_ranked_gold(spark, d), 5)


@query(f"""WITH {_REL}, c AS (SELECT query_id, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank ELSE 0 END AS p FROM hit), s AS (SELECT query_id, sum(p) AS s FROM c GROUP BY 1)
SELECT q.query_id, round(coalesce(s / rel, 0), 9)::DOUBLE AS average_precision FROM q LEFT JOIN s USING (query_id) LEFT JOIN rl USING (query_id)""")
def average_precision(spark, d):
    """RTM2, WIN5."""
    return X.average_precision(*_ranked_gold(spark, d))


@query(f"WITH {_REL}, m AS (SELECT query_id, min(rank) AS r FROM hit WHERE hit = 1 GROUP BY 1) SELECT q.query_id, round(coalesce(1.0::DOUBLE / r, 0), 9)::DOUBLE AS rr FROM q LEFT JOIN m USING (query_id)")
def mrr(spark, d):
    """RTM3, RTM5."""
    return X.reciprocal_rank(*_ranked_gold(spark, d))


@query(f"""WITH {D.top(10)}, gr AS (SELECT top.query_id, doc_id, quality::DOUBLE AS gain FROM top JOIN labels USING (doc_id)), dc AS (SELECT query_id, sum(gain / log2(rank + 1)) AS dcg FROM top JOIN gr USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1),
b AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS n FROM gr), i AS (SELECT query_id, sum(gain / log2(n + 1)) AS ideal FROM b WHERE n <= 5 GROUP BY 1)
SELECT q.query_id, round(coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0), 9)::DOUBLE AS ndcg FROM q LEFT JOIN dc USING (query_id) LEFT JOIN i USING (query_id)""")
def ndcg(spark, d):
    """RTM4: quality labels of candidates as grades."""
    r = D.ranked(spark, d, 10)
    graded = r.join(D.table(spark, d, "labels"), "doc_id").select("query_id", "doc_id", F.col("quality").cast("double").alias("gain"))
    return X.ndcg(r, graded, D.questions(spark, d), 5)


@query(f"""WITH {_REL}, m AS (SELECT query_id, min(rank) AS r FROM hit WHERE hit = 1 GROUP BY 1), k AS (SELECT unnest([1, 5, 10])::BIGINT AS k)
SELECT k, round(avg(coalesce((r <= k)::INT, 0)), 9) AS doc_recall, round(avg(CASE WHEN rel > 0 THEN coalesce((r <= k)::INT, 0) END), 9) AS page_recall FROM k, q LEFT JOIN m USING (query_id) LEFT JOIN rl USING (query_id) GROUP BY 1""")
def recall_curve(spark, d):
    """RTM9, RTM7, RTM8."""
    r, g, q = _ranked_gold(spark, d)
    return X.recall_curve(r, g.select("query_id", "doc_id"), g, q, [1, 5, 10])


@query(f"""WITH {D.VECTORS}, n AS (SELECT sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM v), x AS (SELECT unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM v), s AS (SELECT i, stddev_pop(x) AS s FROM x GROUP BY 1)
SELECT (SELECT count(*) FROM v) AS n, (SELECT round(min(n), 6) FROM n) AS norm_min, (SELECT round(avg(n), 6) FROM n) AS norm_mean, (SELECT round(max(n), 6) FROM n) AS norm_max, (SELECT round(avg(s), 6) FROM s) AS mean_std, (SELECT count(*) FROM s) AS dims, (SELECT sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM v GROUP BY list_transform(vec, lambda x: round_even(x, 6)))) AS duplicates""")
def vector_stats(spark, d):
    """RTM12."""
    return X.vector_diagnostics(D.vectors(spark, d))


@query(f"WITH {D.top(10)} SELECT query_id, round(min(score), 6) AS min, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(stddev_pop(score), 6) AS std, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 5), 6) AS gap5, round(max(score) FILTER (rank = 1) - min(score), 6) AS gap_last FROM top GROUP BY 1")
def score_gaps(spark, d):
    """RTM13."""
    return X.score_gaps(D.ranked(spark, d, 10))


@query(f"""WITH {D.VECTORS}, {D.UNIT}, p AS (SELECT a.doc_id, a.page, b.page AS o, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.page <> b.page AND abs(a.page - b.page) <= 2),
m AS (SELECT doc_id, page, arg_max(o - page, (s, -o)) AS shift FROM p GROUP BY ALL) SELECT shift, count(*) AS n FROM m GROUP BY 1""")
def metadata_shift(spark, d):
    """RTM14."""
    return X.shift_audit(D.vectors(spark, d))


# -- summaries and reports ---------------------------------------------------


@query(f"""WITH {_SCORED}, x AS (SELECT *, CASE WHEN qtype IN ('text-only', 'meta-data') THEN 'text' ELSE 'multimodal' END AS pipeline FROM mt)
SELECT CASE WHEN grouping(qtype) = 0 THEN 'qtype' WHEN grouping(pipeline) = 0 THEN 'pipeline' ELSE 'overall' END AS group_kind, CASE WHEN grouping(qtype) = 0 THEN qtype WHEN grouping(pipeline) = 0 THEN pipeline ELSE 'all' END AS group_value, count(*) AS n, round(sum((f1 > 0.5)::INT) / count(*), 6) AS f1_gt_0_5,
round(avg(token_f1), 6) AS mean_token_f1, round(avg(exact_match), 6) AS mean_exact_match, round(avg(latency), 6) AS mean_latency, round(avg(numeric_recall), 6) AS mean_numeric_recall FROM x GROUP BY GROUPING SETS ((), (qtype), (pipeline))""")
def summary_grouping_sets(spark, d):
    """AGG1, AGG2, AGG5, AGG6."""
    m = _scored(spark, d).withColumn("pipeline", I.pipeline_of(F.col("qtype")))
    return P.summary(m, ["qtype", "pipeline"], ["token_f1", "exact_match", "latency"], ["numeric_recall"])


@query(f"""WITH {_SCORED}, g AS (SELECT 'overall' AS grp, * FROM mt UNION ALL SELECT 'f1_lt_0_5', * FROM mt WHERE f1 < 0.5 UNION ALL SELECT concat('type_', qtype), * FROM mt)
SELECT grp, count(*) AS n, count(f1) AS f1_count, round(avg(f1), 6) AS f1_mean, count(numeric_recall) AS numeric_recall_count, round(avg(numeric_recall), 6) AS numeric_recall_mean FROM g GROUP BY 1""")
def metric_groups(spark, d):
    """AGG7."""
    return P.metric_groups(_scored(spark, d), "qtype", ["f1", "numeric_recall"])


_LAT = "count(value) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95))


@query(f"SELECT event_type AS group_value, {_LAT} FROM events GROUP BY 1 UNION ALL SELECT 'all', {_LAT} FROM events")
def latency_percentiles(spark, d):
    """AGG4, AGG8, AGG9, AGG11."""
    return P.latency_summary(D.table(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, " + ", ".join(f"list_sort(list(value))[floor(count(*) * {p})::BIGINT + 1] AS i{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")
def latency_index_percentiles(spark, d):
    """AGG10."""
    return P.indexed_percentile(D.table(spark, d, "events"), "event_type", "value", [0.5, 0.95, 0.99])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY ALL")
def windowed_metrics(spark, d):
    """An extension: AGG8 by day, the batch form of the streaming query."""
    return W.windowed(D.table(spark, d, "events"))


@query("""SELECT p_partkey, p_retailprice, p_size::BIGINT AS p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))""")
def pareto_frontier(spark, d):
    """RPT1: parts by price against size; by a running maximum."""
    return P.pareto(D.table(spark, d, "part").withColumn("size", F.col("p_size").cast("double")), "p_retailprice", "size", "p_partkey").select("p_partkey", "p_retailprice", F.col("p_size"))


@query(f"""WITH {_SCORED}, n AS (SELECT query_id, qtype, f1 AS b, CASE WHEN query_id % 3 = 0 THEN least(1.0, f1 + 0.2) WHEN query_id % 3 = 1 THEN greatest(0.0, f1 - 0.1) ELSE f1 END AS n FROM mt), g AS (SELECT * FROM n UNION ALL SELECT query_id, 'all', b, n FROM n)
SELECT qtype, count(*) AS n, count(*) FILTER (n > b) AS improved, count(*) FILTER (n < b) AS regressed, count(*) FILTER (n = b) AS unchanged, count(*) FILTER (b < 0.5 AND n < 0.5) AS still_bad, round(avg(n - b), 6) AS mean_delta FROM g GROUP BY 1""")
def ablation_diff(spark, d):
    """RPT6."""
    m = _scored(spark, d).select("query_id", "qtype", "f1")
    new = m.withColumn("f1", F.expr("CASE WHEN query_id % 3 = 0 THEN least(1.0D, f1 + 0.2D) WHEN query_id % 3 = 1 THEN greatest(0.0D, f1 - 0.1D) ELSE f1 END"))
    return P.compare_runs(m, new)


@query(f"WITH {_SCORED} SELECT query_id, expected, generated, f1, CASE WHEN generated = 'NOT FOUND' THEN 'not_found' WHEN numeric_any_match = 0 AND regexp_matches(expected, '[0-9]') THEN 'wrong_row_or_column' WHEN trim(generated) <> '' AND generated <> 'ERROR' THEN 'formatting_issue' ELSE 'wrong_page' END AS error_type FROM mt WHERE f1 < 0.5")
def error_cases(spark, d):
    """SNK2, RPT7."""
    return P.case_rows(_scored(spark, d)).select("query_id", "expected", "generated", "f1", "error_type")


@query(f"""WITH {_SCORED} SELECT query_id, array_to_string(list_filter([CASE WHEN query_id % 13 = 0 THEN 'runtime_error' END, CASE WHEN query_id % 4 = 0 THEN 'no_pages' END, CASE WHEN trim(generated) = '' THEN 'empty_answer' END], lambda z: z IS NOT NULL), ',') AS errors FROM mt""")
def validity_filter(spark, d):
    """PRD13."""
    m = _scored(spark, d)
    return m.select("query_id", F.array_join(M.row_errors({"generated": F.col("generated"), "error": F.expr("CASE WHEN query_id % 13 = 0 THEN 'x' END"), "n_pages": F.expr("query_id % 4"), "latency": F.col("latency"), "f1": F.col("f1")}), ",").alias("errors"))


@query("""SELECT conv_id, turn, trim(regexp_replace(trim(lower(coalesce(text, ''))), '\\s+', ' ', 'g')) AS key, CASE WHEN regexp_matches(lower(trim(text)), 'not found|not mentioned|not specified|not provided|no information|cannot be determined|can''t be determined|not available|does not contain|unanswerable') OR trim(text) = '' THEN 'NOT FOUND' WHEN regexp_matches(lower(trim(text)), '^yes\\b') THEN 'Yes' WHEN regexp_matches(lower(trim(text)), '^no\\b') THEN 'No' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations""")
def normalised_turns(spark, d):
    """NRM7, NRM9."""
    return D.table(spark, d, "conversations").select("conv_id", "turn", T.question_key(F.col("text")).alias("key"), T.text_route_answer(F.col("text")).alias("answer"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains(""" + words(*T.SERVING_STOP) + """, t)) AS t FROM documents) SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM w""")
def serving_tokens(spark, d):
    """TOK5."""
    return D.table(spark, d, "documents").select("doc_id", T.serving_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS question_id, conv_id, turn FROM conversations WHERE role = 'user') SELECT * FROM n WHERE question_id > 10 AND question_id <= 60""")
def question_slice(spark, d):
    """SRC4, TOP5: numbered before the slice."""
    from ..sources.readers import numbered

    return numbered(D.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"], 10, 50).select("question_id", "conv_id", "turn")


def _regions(spark, d):
    a = D.asked(spark, d)
    r = a.withColumn("region", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return r.withColumns({
        "crop_type": F.expr("element_at(array('table', 'figure', 'text'), cast((query_id + region) % 3 as int) + 1)"),
        "confidence": F.expr("cast((query_id * 7 + region * 3) % 10 as double) / 10"),
        "page_rank": F.expr("region + 1"),
        "ocr_text": F.expr("concat('Table ', query_id % 40, ' total revenue\n', 'Figure ', region, 'b accuracy of the chart')"),
    })


_LINE = "list_filter(list_transform(string_split(ocr_text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: regexp_matches(x, '{p}'))[1]"
_REF = r"'(?i)\b(table|figure|fig\.?)\s*([0-9]+[a-z]?)\b'"
_TOK = "list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 2)), lambda t: NOT list_contains(" + words(*T.LAYOUT_STOP) + ", t))"
_SIM = "CASE WHEN len(lt) = 0 OR len(ot) = 0 THEN 0.0 ELSE len(list_filter(lt, lambda t: list_contains(ot, t))) / len(list_distinct(list_concat(lt, ot))) END"
_REGIONS = f"""{D.ASKED}, {_INTENT},
rg AS (SELECT m.*, region, ['table', 'figure', 'text'][1 + (query_id + region) % 3] AS crop_type, ((query_id * 7 + region * 3) % 10)::DOUBLE / 10 AS confidence, region + 1 AS page_rank, concat('Table ', query_id % 40, ' total revenue', chr(10), 'Figure ', region, 'b accuracy of the chart') AS ocr_text FROM m, (SELECT unnest(range(0, 4)) AS region)),
ro AS (SELECT *, {_TOK.format(c='ocr_text')} AS ot, lower(regexp_replace(ocr_text, '\\s+', ' ', 'g')) AS flat,
  CASE WHEN list_contains(lt, 'table') OR regexp_matches(lo, '\\btable\\s*\\d+\\b') THEN 'table' WHEN list_has_any(lt, {words(*I.LAYOUT_VISUAL)}) OR qtype = 'multimodal-f' THEN 'figure' WHEN list_has_any(lt, {words(*I.LAYOUT_TABLE)}) THEN 'table' ELSE 'text' END AS target,
  coalesce(CASE crop_type WHEN 'table' THEN {_LINE.format(p='(?i)\\btable\\s*[0-9]+[a-z]?\\b')} WHEN 'figure' THEN {_LINE.format(p='(?i)\\b(fig\\.?|figure|chart|graph|diagram)\\s*[0-9]+[a-z]?\\b')} ELSE {_LINE.format(p='(?i)\\b(table|fig\\.?|figure|chart|graph|diagram)\\s*[0-9]+[a-z]?\\b')} END, {_LINE.format(p='(?i)\\b(table|fig\\.?|figure|chart|graph|diagram)\\b')}, '') AS caption FROM rg),
rs AS (SELECT *, {_SIM} AS sim, list_has_any(lt, {words(*I.LAYOUT_TABLE)}) AS ht_, list_has_any(lt, {words(*I.LAYOUT_VISUAL)}) AS hv_,
  CASE WHEN regexp_matches(caption, {_REF}) THEN concat(CASE WHEN starts_with(lower(regexp_extract(caption, {_REF}, 1)), 'fig') THEN 'figure' ELSE lower(regexp_extract(caption, {_REF}, 1)) END, ' ', lower(regexp_extract(caption, {_REF}, 2))) END AS found FROM ro),
rc AS (SELECT *, confidence + (target = crop_type)::INT + CASE WHEN target = 'figure' AND crop_type IN ('figure', 'text') THEN 0.25 ELSE 0 END + CASE WHEN target = 'table' AND crop_type = 'text' THEN 0.15 ELSE 0 END + 2 * sim + CASE WHEN reference IS NOT NULL AND contains(flat, reference) THEN 2.5 ELSE 0 END + CASE WHEN ht_ AND crop_type = 'table' THEN 0.5 ELSE 0 END + CASE WHEN hv_ AND crop_type = 'figure' THEN 0.5 ELSE 0 END AS s1,
  coalesce(caption <> '' AND found = reference, false) AS caption_match, coalesce(reference IS NOT NULL AND caption <> '' AND found <> reference, false) AS conflict, CASE intent WHEN 'visual' THEN crop_type = 'figure' WHEN 'table' THEN crop_type = 'table' ELSE true END AS allowed FROM rs),
sc2 AS (SELECT *, CASE WHEN allowed AND NOT conflict THEN round(confidence + CASE WHEN intent <> 'unknown' THEN 1.5 WHEN (ht_ OR regexp_matches(question, '(?i)\\b(total|difference|ratio|increase|decrease|percentage|score|accuracy|f1)\\b')) AND crop_type = 'table' THEN 0.7 ELSE 0 END - 0.18 * greatest(0, page_rank - 1) + 1.5 * sim
  + CASE WHEN caption_match THEN 5 WHEN reference IS NOT NULL AND caption <> '' THEN -2 WHEN reference IS NOT NULL THEN -0.75 ELSE 0 END + CASE WHEN reference IS NOT NULL AND page_rank = 1 AND caption_match THEN 2 ELSE 0 END + CASE WHEN ht_ AND crop_type = 'table' THEN 0.4 ELSE 0 END + CASE WHEN hv_ AND crop_type = 'figure' THEN 0.4 ELSE 0 END, 9) END AS s2 FROM rc)"""


@query(f"WITH {_REGIONS} SELECT query_id, region, crop_type, round(s1, 9) AS score_v1, s2 AS score_v2, caption, caption_match FROM sc2")
def crop_scores(spark, d):
    """IMG6, IMG7, IMG9, EVD6, PRD15."""
    a = L.score_v1(_regions(spark, d)).withColumnRenamed("score", "score_v1")
    return L.score_v2(a).select("query_id", "region", "crop_type", "score_v1", F.col("score").alias("score_v2"), "caption", "caption_match")


@query(f"""WITH {_REGIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC NULLS LAST, page_rank, region) AS n FROM sc2 QUALIFY n = 1), c AS (SELECT *, coalesce(s2 >= CASE WHEN reference IS NOT NULL THEN 2.25 ELSE 1.15 END, false) AS ok FROM b)
SELECT query_id, intent, CASE WHEN ok THEN region END AS region, CASE WHEN ok THEN crop_type END AS crop_type, CASE WHEN ok THEN s2 END AS score, CASE WHEN NOT ok THEN CASE WHEN intent = 'visual' OR regexp_matches(lo, 'figure|fig\\.|chart|graph|plot|diagram|image|picture|photo|architecture|shown') THEN 'visual_main' ELSE 'none' END END AS fallback FROM c""")
def crop_choice(spark, d):
    """IMG8, ORC13."""
    return L.select_crop(L.score_v2(_regions(spark, d)))


@query("SELECT coalesce(l.quality::VARCHAR, 'unknown') AS domain, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def domain_distribution(spark, d):
    """RTM15."""
    out = D.table(spark, d, "documents").select("doc_id").join(D.table(spark, d, "labels"), "doc_id", "left")
    return out.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"""WITH {_FEATURES}, g AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a in (0.5, 1.0, 1.5) for b in (0.0, 0.2, 0.4))}) AS t(alpha, beta)), l AS (SELECT *, {_LEXSCORE} AS lx FROM f), n AS (SELECT *, {_MM.format(x='score')} AS a, {_MM.format(x='lx')} AS b FROM l WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT alpha, beta, query_id, doc_id, rank, round(alpha * a + beta * b + 0.05 * keyword_match + 0.05 * exact_phrase_match, 9) AS fs FROM n, g), o AS (SELECT *, row_number() OVER (PARTITION BY alpha, beta, query_id ORDER BY fs DESC, rank) AS r FROM s), {D.GOLD}, h AS (SELECT alpha, beta, query_id, min(r) AS r FROM o JOIN gold USING (query_id, doc_id) GROUP BY ALL)
SELECT alpha, beta, count(*) AS found, count(*) FILTER (r = 1) AS first FROM h GROUP BY ALL""")
def fusion_grid(spark, d):
    """ORC3: nine weight pairs in one job."""
    grid = F.broadcast(spark.createDataFrame([(a, b) for a in (0.5, 1.0, 1.5) for b in (0.0, 0.2, 0.4)], "alpha double, beta double"))
    c = K.fusion_features(_candidates(spark, d)).withColumn("lx", F.round(K.SCORERS["lexical"](F.col("question"), F.col("text")), 9))
    c = c.withColumns({"a": R.min_max(F.col("score")), "b": R.min_max(F.col("lx"))}).select("query_id", "doc_id", "rank", "a", "b", "keyword_match", "exact_phrase_match").crossJoin(grid)
    c = c.withColumn("fs", F.round(F.col("alpha") * F.col("a") + F.col("beta") * F.col("b") + 0.05 * F.col("keyword_match") + 0.05 * F.col("exact_phrase_match"), 9))
    c = R.top_k(c, None, by=["alpha", "beta", "query_id"], score="fs", ties=["rank"], rank="r")
    h = c.join(D.gold(spark, d).select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("alpha", "beta", "query_id").agg(F.min("r").alias("r"))
    return h.groupBy("alpha", "beta").agg(F.count("*").alias("found"), F.sum((F.col("r") == 1).cast("long")).alias("first"))


from . import index_queries, layout_queries, run_queries, search_queries, serving_queries  # noqa: E402, F401  register more
