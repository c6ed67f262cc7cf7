"""The kept lexical index against an index of the same pages built at once."""

import random

import pytest
from pyspark.sql import functions as F

from pagelight.operators import index as L
from pagelight.operators.retrieval import Bm25, query_terms
from pagelight.plans import fixtures as D

WORDS = [f"w{k}" for k in range(40)]


def page(k, seed):
    rng = random.Random(f"{k} {seed}")
    return " ".join(rng.choices(WORDS, weights=range(40, 0, -1), k=rng.randint(1, 30)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page int, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return query_terms(spark.createDataFrame([(q, page(q, "question")) for q in range(6)] + [(9, "absent"), (10, None)], "query_id long, question string"))


def same(index, spark, live, asked):
    corpus = frame(spark, [(d, p, t) for (d, p), t in live.items()])
    fresh = Bm25(corpus)
    for options in ({}, {"k1": 2.5, "b": 0.9, "idf": "okapi"}):
        want = sorted(map(tuple, fresh.search(asked, 7, **options).collect()))
        got = sorted(map(tuple, index.search(asked, 7, **options).collect()))
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)
    assert tuple(index.totals.first()) == tuple(fresh.totals.first())
    assert sorted(map(tuple, index.frequencies.collect())) == sorted(map(tuple, fresh.frequencies.collect()))


@pytest.mark.parametrize("per_part", [L.PAGES_A_PART, 30])
def test_lifecycle(spark, tmp_path, asked, monkeypatch, per_part):
    monkeypatch.setattr(L, "PAGES_A_PART", per_part)
    path = str(tmp_path / "index")
    live = {(d, p): page((d, p), 0) for d in range(40) for p in (1, 2)}
    index = L.LexicalIndex(spark, path).build(frame(spark, [(d, p, t) for (d, p), t in live.items()] + [(99, 1, None), (98, 1, "- ,")]), 3)
    same(index, spark, live, asked)
    more = {(d, p): page((d, p), 1) for d in range(35, 50) for p in (2, 3)}  # five pages are replaced
    index = index.append(frame(spark, [(d, p, t) for (d, p), t in more.items()]))
    live |= more
    same(index, spark, live, asked)
    index = index.delete(spark.createDataFrame([(3,), (41,), (77,)], "doc_id long"))
    live = {k: t for k, t in live.items() if k[0] not in (3, 41)}
    same(index, spark, live, asked)
    index = index.delete(spark.createDataFrame([(5, 1), (5, 9)], "doc_id long, page int"))
    live.pop((5, 1))
    index = index.append(frame(spark, [(3, 1, page(3, "again"))]))  # comes back
    live[3, 1] = page(3, "again")
    same(index, spark, live, asked)
    assert len(index.segments) == 5 and index.size == len(live)
    again = L.LexicalIndex(spark, path)  # as another session finds it
    same(again, spark, live, asked)
    index = again.compact()
    assert len(index.segments) == 1 and len(index.stale) == 5
    same(index, spark, live, asked)
    index = index.vacuum()
    assert not index.stale
    same(index, spark, live, asked)
    assert index.delete(spark.createDataFrame([(12345,)], "doc_id long")).size == len(live)


def test_a_failed_append_is_not_seen(spark, tmp_path, asked, monkeypatch):
    path = str(tmp_path / "index")
    live = {(d, 1): page(d, 2) for d in range(20)}
    index = L.LexicalIndex(spark, path).build(frame(spark, [(d, p, t) for (d, p), t in live.items()]), 2)
    monkeypatch.setattr(L.LexicalIndex, "_commit", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.append(frame(spark, [(50, 1, "w1 w2 w3")]))
    monkeypatch.undo()
    index = L.LexicalIndex(spark, path)
    same(index, spark, live, asked)
    same(index.append(frame(spark, [(51, 1, "w1 w2")])), spark, live | {(51, 1): "w1 w2"}, asked)


def test_nothing_indexed(spark, tmp_path, asked):
    index = L.LexicalIndex(spark, str(tmp_path / "index"))
    assert index.search(asked, 3).collect() == [] and index.size == 0
    index = index.build(frame(spark, []), 2)
    assert index.search(asked, 3).collect() == [] and index.frequencies.collect() == []
    assert index.append(frame(spark, [(1, 1, "w1")])).size == 1


def test_a_search_shuffles_no_postings_and_reads_no_text(spark, sf, monkeypatch):
    index, terms = D.bm25(spark, sf)
    assert D.bm25(spark, sf)[0] is index
    plan = index.search(terms, 10)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "FileScan" in plan
    want = sorted(map(tuple, index.search(terms, 10).collect()))
    monkeypatch.setattr(L, "few", lambda df: False)  # as with many queries: they are shuffled to the postings' buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.scores(terms)
        plan = found._jdf.queryExecution().executedPlan().toString()
        postings = next(x for x in plan.split("SortMergeJoin") if "tf#" in x and "Bucketed: true" in x)
        assert "Exchange" not in postings[: postings.index("FileScan")]
        assert sorted(map(tuple, index.search(terms, 10).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_that_hold_the_rarest_token(spark, tmp_path):
    live = {(d, 1): page(d, 5) for d in range(30)}
    index = L.LexicalIndex(spark, str(tmp_path / "index")).build(frame(spark, [(d, p, t) for (d, p), t in live.items()]), 2)
    index = index.delete(spark.createDataFrame([(4,)], "doc_id long"))
    live.pop((4, 1))
    held = {w: {k for k, t in live.items() if w in t.split()} for w in WORDS}
    texts = [(q, page(q, "x")) for q in range(8)] + [(8, "absent"), (9, None)]
    got = index.holding(index.rarest(spark.createDataFrame(texts, "key int, text string"), "key")).collect()
    for q, t in texts:
        known = [w for w in set((t or "").split()) if held.get(w)]
        want = held[min(known, key=lambda w: (len(held[w]), w))] if known else set()
        assert {(r.doc_id, r.page) for r in got if r.key == q} == want
