"""What a task of a search holds doesn't grow with the words of the index, the pages of other tasks or the texts of other candidates."""

import re

import pytest

from pagelight.operators import evidence as E
from pagelight.operators import index as L
from pagelight.operators.ranking import top_k
from pagelight.operators.retrieval import query_terms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def index(spark, tmp_path):
    rows = [(d, 1, f"common w{d % 7} w{d % 5} own{d}") for d in range(400)] + [(None, 1, "common w1"), (None, None, "common w2")]
    made = L.LexicalIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    return made.append(spark.createDataFrame([(7, 1, "common w3 w3"), (900, 1, "own1 w1")], "doc_id long, page int, text string"))


@pytest.fixture
def asked(spark):
    return query_terms(spark.createDataFrame([(1, "w0 w1 w1"), (2, "common"), (3, "none"), (None, "own1 own900 w3")], "query_id long, question string"))


def test_tasks_score_even_shares(spark, index, asked, monkeypatch):
    """A share of the pages is dealt to each task, unsorted; shares that were numbered first fell together."""
    monkeypatch.setattr(L, "PAGES_AT_ONCE", 25)
    got = index.search(asked, 4)
    found = plan(got)
    assert "MapInArrow" in found and "FlatMapGroupsInArrow" not in found
    near = lambda df: sorted(((*r[:3], round(r.score, 6), r["rank"]) for r in df.collect()), key=str)
    assert near(got) == near(top_k(index.scores(asked).where("score > 0"), 4))

    def pages(held, k, k1, b):
        def run(batches):
            own = {(d, p) for x in batches for d, p in zip(x.column("doc_id").to_pylist(), x.column("page").to_pylist())}
            yield L.pa.record_batch([L.pa.array([n], L.pa.int64()) for n in (0, len(own))] + [L.pa.array([1], L.pa.int32()), L.pa.array([1.0])], names=["query_id", "doc_id", "page", "score"])

        return run

    monkeypatch.setattr(L, "_scoring", pages)
    held = [r.doc_id for r in index._best(asked, 4, 1.5, 0.75, "plus_one").collect()]
    assert len(held) == 1 + 403 // 25 and sum(held) == 403 and max(held) <= 2.5 * 25 and min(held) > 0


def test_only_asked_terms_are_counted(spark, index, asked):
    whole = {r.term: r.df for r in index.frequencies.collect()}
    want = {r.term: whole[r.term] for r in asked.collect() if r.term in whole}
    counted = index._frequencies_of(asked)
    assert {r.term: r.df for r in counted.collect()} == want
    for found in (plan(counted), plan(index._known(asked, "plus_one")), plan(index.rarest(spark.createDataFrame([(1, "own5 common")], "key int, text string"), "key"))):
        assert re.search(r"BroadcastHashJoin \[term.*LeftSemi", found)
    assert index._known(asked, "okapi").where("idf is null").count() == 0


def test_evidence_of_few_candidates(spark):
    """No text but the candidates' goes into the shuffle."""
    kinds = "doc_id long, page int, text string"
    pages = spark.createDataFrame([(d, p, f"{d} {p}") for d in range(50) for p in (1, 2)] + [(3, 1, "again"), (None, 1, "x"), (4, 2, None)], kinds)
    candidates = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (1, 99, 1), (2, 3, 1), (2, None, 1)], "query_id int, doc_id long, page int")
    got = E.attach(candidates, pages)
    assert "LeftSemi" in plan(got)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "page", "text").collect()), key=str) == sorted([(1, 3, 1, "3 1"), (1, 3, 1, "again"), (1, 4, 2, "4 2"), (1, 4, 2, ""), (1, 99, 1, ""), (2, 3, 1, "3 1"), (2, 3, 1, "again"), (2, None, 1, "")], key=str)


def test_frequencies_of_few_terms_are_broadcast(spark, index, asked):
    """Else two sorts and a sum stand in the task that tells which terms are known."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(index._known(asked, "plus_one"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
