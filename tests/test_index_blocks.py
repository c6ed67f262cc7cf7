"""Postings are rows of many pages, words are cut as bytes, and texts stay where they lie when few of them are asked for."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelight.functions import text as T
from pagelight.operators import index as L
from pagelight.operators.evidence import pages_of
from pagelight.plans import fixtures as D
from pagelight.plans import queries as Q

rng = random.Random(5)
ODD = ["".join(rng.choices("aB1._+- \nçÉ中İKİ", k=rng.randint(0, 40))) for _ in range(800)] + ["", "a", "ab", "a.b", "-a.b-", ".", None, "x" * 5000]


@pytest.mark.parametrize("at_once", [4_000_000, 50])
def test_words_as_bytes(spark, monkeypatch, at_once):
    monkeypatch.setattr(L, "BYTES_AT_ONCE", at_once)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("page", F.lit(1))
    want = {r.doc_id: r.t for r in df.select("doc_id", T.bm25_tokens(F.col("text")).alias("t")).collect() if r.t}
    batch = pa.record_batch([pa.array(range(len(ODD))), pa.array([1] * len(ODD)), pa.array(ODD, pa.string())], names=["doc_id", "page", "text"])
    got = [r for b in L._worded([batch]) for r in b.to_pylist()]
    assert {r["doc_id"]: r["words"].split(" ") for r in got} == want
    assert all(r["dl"] == len(r["words"].split(" ")) for r in got)


def test_a_posting_row_holds_many_pages(spark, tmp_path):
    rows = [(d, 1, f"common w{d % 3} own{d}") for d in range(60)]
    index = L.LexicalIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(rows, "doc_id long, page int, text string").coalesce(1), 2)
    held = index._postings(index.segments[0]).where("term = 'common'").collect()
    assert len(held) == 1 and sorted(held[0].doc_id) == list(range(60))
    assert dict(map(tuple, index.frequencies.collect())) == {"common": 60, "w0": 20, "w1": 20, "w2": 20, **{f"own{d}": 1 for d in range(60)}}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_leave_texts_where_they_are(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(D.ranked(spark, sf, 10))
        found = plan(Q._candidates(spark, sf))
        assert "SortMergeJoin" not in found and "hashpartitioning(doc_id" not in found
        for cut in (D.captioned, D.pages):
            assert "Exchange" not in plan(cut(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_and_repeated_documents_are_cut_alike(spark, tmp_path):
    texts = ["\n".join(f"l{i} {d}" for i in range(n)) for d, n in enumerate([1, 7, 8, 9, 16, 17, 40])] + ["", "\n", "\n" * 8, None]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a\nb")], "doc_id long, text string")
    near = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert D.single(docs) and not D.single(docs.union(docs.limit(1))) and not D.single(docs.union(docs.where("doc_id is null")))
    assert near(pages_of(docs, single=True)) == near(pages_of(docs))
    docs.write.parquet(str(tmp_path / "one" / "documents.parquet"))
    docs.union(spark.createDataFrame([(77, "x\ny"), (77, None)], docs.schema)).write.parquet(str(tmp_path / "two" / "documents.parquet"))
    one, two = (D.captioned(spark, str(tmp_path / k)) for k in ("one", "two"))
    assert "Exchange" not in plan(one) and "Exchange" in plan(two)
    assert near(one) == near(two.where("doc_id is null or doc_id <> 77"))
