"""An index that grows has more buckets, and pages are scored part by part."""

from pagelight.operators import index as L
from pagelight.operators.retrieval import query_terms
from pagelight.operators.ranking import top_k


def test_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "TOKENS_A_BUCKET", 20)
    monkeypatch.setattr(L, "PAGES_AT_ONCE", 7)
    rows = [(d % 25, 1, " ".join(f"w{d * i % 11}" for i in range(d % 4 + 1))) for d in range(40)] + [(None, 1, "w1 w2")]  # some pages have two rows
    index = L.LexicalIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    assert index.segments[0].buckets == 1 + sum(len(t.split()) for *_, t in rows) // 20
    asked = query_terms(spark.createDataFrame([(1, "w0 w1 w1"), (2, "w2"), (3, "none")], "query_id long, question string"))
    near = lambda df: sorted(((*r[:3], round(r.score, 6), r["rank"]) for r in df.collect()), key=str)
    assert near(index.search(asked, 4)) == near(top_k(index.scores(asked).where("score > 0"), 4))
