"""Registered queries of indexes: validation, shards, a lexical index through its life; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as L
from ..operators import retrieval as S
from ..operators import vector_index as V
from ..sources.shared import scratch
from . import fixtures as D
from .queries import _multi, query

_FRESH = f"""{D.VECTORS}, fr AS (SELECT * REPLACE (list_transform(vec, lambda x: floor(x * 8) / 8) AS vec) FROM v),
sm AS (SELECT doc_id, page FROM v ORDER BY md5(concat('53:', doc_id, ':', page)), doc_id, page LIMIT 20)"""
_LEN = "greatest(sqrt(list_dot_product({x}, {x})), 1e-12)"
_COS = f"round(list_dot_product(list_transform(a.vec, lambda x: x / {_LEN.format(x='a.vec')}), list_transform(f.vec, lambda x: x / {_LEN.format(x='f.vec')})), 9)"
_SELF = f"""{_FRESH}, sc AS (SELECT f.doc_id AS own_doc, f.page AS own_page, a.doc_id, a.page, {_COS} AS s FROM v a JOIN fr f ON true JOIN sm ON sm.doc_id = f.doc_id AND sm.page = f.page),
ow AS (SELECT own_doc, own_page, s AS own FROM sc WHERE doc_id = own_doc AND page = own_page),
rk AS (SELECT own_doc AS doc_id, own_page AS page, 1 + count(*) FILTER (s > own OR s = own AND (sc.doc_id < own_doc OR sc.doc_id = own_doc AND sc.page < own_page)) AS self_rank, any_value(own) AS stored_vs_fresh FROM sc JOIN ow USING (own_doc, own_page) GROUP BY ALL),
sr AS (SELECT *, (self_rank = 1)::BIGINT AS hit_at_1, (self_rank <= 5)::BIGINT AS hit_at_k FROM rk)"""


def _fresh(spark, d):
    """Vectors to three binary digits, as from an encoder of less precision."""
    return D.vectors(spark, d).withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * 8) / 8))


@query(f"WITH {_SELF} SELECT * FROM sr")
def index_self_ranks(spark, d):
    """RET19: ranks of sampled pages among all."""
    return V.self_retrieval(D.vectors(spark, d), _fresh(spark, d))


@query(f"WITH {_SELF} SELECT count(*) AS samples, round(avg(hit_at_1), 6) AS self_recall_at_1, round(avg(hit_at_k), 6) AS self_recall_at_k, round(avg(stored_vs_fresh), 6) AS stored_vs_fresh_mean FROM sr")
def index_self_recall(spark, d):
    """RET19."""
    return V.self_recall(V.self_retrieval(D.vectors(spark, d), _fresh(spark, d)))


_PAGES = f"""{D.VECTORS}, st AS (SELECT doc_id, list(vec ORDER BY page) AS vecs FROM v GROUP BY doc_id), fe AS (SELECT doc_id, list(list_transform(vec, lambda x: floor(x * 8) / 8) ORDER BY page) FILTER (doc_id % 7 <> 0 OR page < 4) AS vecs FROM v GROUP BY doc_id),
sm AS (SELECT doc_id FROM st ORDER BY md5(concat('53:', doc_id, ':1')), doc_id LIMIT 100),
pr AS (SELECT doc_id, len(st.vecs) AS a, len(fe.vecs) AS b, unnest(list_zip(st.vecs, fe.vecs)) AS z FROM st JOIN fe USING (doc_id) JOIN sm USING (doc_id)),
va AS (SELECT doc_id, 1::BIGINT AS page, a AS stored_tokens, b AS fresh_tokens, a = b AS shape_match, CASE WHEN a = b THEN round(avg(list_dot_product(z[1], z[2]) / greatest(sqrt(list_dot_product(z[1], z[1])) * sqrt(list_dot_product(z[2], z[2])), 1e-8)), 9) END AS mean_aligned_cosine FROM pr GROUP BY doc_id, a, b)"""


def _validated(spark, d):
    page = lambda df: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "vec"))).alias("x")).select("doc_id", F.lit(1).alias("page"), F.transform("x", lambda r: F.transform(r["vec"], lambda y: y.cast("double"))).alias("vecs"))  # noqa: E731  four vectors
    return V.validate_pages(page(D.vectors(spark, d)), page(_fresh(spark, d).where("doc_id % 7 <> 0 OR page < 4")), 100)


@query(f"WITH {_PAGES} SELECT * FROM va")
def index_validation(spark, d):
    """RET19: stored pages of vectors against fresh ones, some of which lack a vector."""
    return _validated(spark, d)


@query(f"WITH {_PAGES} SELECT count(*) AS samples, round(avg(shape_match::INT), 6) AS shape_match_rate, round(avg(mean_aligned_cosine), 6) AS mean_aligned_cosine_mean, round(min(mean_aligned_cosine), 6) AS mean_aligned_cosine_min FROM va")
def index_validation_summary(spark, d):
    """RET19."""
    return V.validation_summary(_validated(spark, d))


@query(f"""WITH {D.VECTORS}, t AS (SELECT q.doc_id AS query_id, q.page AS tok, p.doc_id, max(list_dot_product(q.vec, p.vec)) AS m FROM v q JOIN v p ON q.doc_id % 50 = 0 GROUP BY ALL),
s AS (SELECT query_id, doc_id, 1::BIGINT AS page, round(sum(m), 9) AS score FROM t GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM s QUALIFY rank <= 10""")
def sharded_maxsim(spark, d):
    """SRC10, SNK7, RET7: pages written in shards, searched shard by shard."""
    q, p = _multi(spark, d)
    path = scratch(spark, "shards")
    V.write_shards(p, path, 200)
    return S.max_sim(q, V.read_shards(spark, path), 10)


_LIFE = D.top(10).replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)", 1)


@query(f"WITH {_LIFE} SELECT query_id, doc_id, page, score, rank FROM top")
def index_lifecycle(spark, d):
    """ORC11: half the documents indexed, the others appended, some of them again, a tenth deleted, then searched."""
    docs = D.corpus(spark, d)
    index = L.LexicalIndex(spark, scratch(spark, "lifecycle")).build(docs.where("doc_id % 2 = 0"))
    index = index.append(docs.where("doc_id % 2 = 1 OR doc_id % 20 = 6"))
    index = index.delete(docs.select("doc_id").where("doc_id % 10 = 3"))
    return index.search(S.query_terms(D.questions(spark, d)), 10)


@query(f"WITH {_LIFE} SELECT query_id, doc_id, page, score, rank FROM top")
def index_compacted(spark, d):
    """ORC11: as index_lifecycle, compacted."""
    docs = D.corpus(spark, d)
    index = L.LexicalIndex(spark, scratch(spark, "compacted")).build(docs.where("doc_id % 2 = 0")).append(docs.where("doc_id % 2 = 1"))
    index = index.delete(docs.select("doc_id").where("doc_id % 10 = 3")).compact().vacuum()
    return index.search(S.query_terms(D.questions(spark, d)), 10)
