"""DataFrame operators: retrieval, ranking, reranking, evidence, context, metrics.

Contract: candidates are rows (query_id, doc_id, page, score, rank); ranks begin at 1; equal scores
are ordered by document and page (or index) ascending, so every ranking is a total order.
"""
