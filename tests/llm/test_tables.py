"""Odd and empty tables through every operator and stage."""

import pytest

import corpus_pipeline
from pagelight.llm import embed_dedup, html_text, jaccard_join, licenses, media, packing, pieces, quality, suffix_dedup, tokenfile
from pagelight.llm.common import ship
from pagelight.llm.tokens import vocabulary

WORDS, PIECES = vocabulary(), vocabulary("piece_bpe_32k.model")
OPERATORS = {
    "licenses": licenses.scan_licenses,
    "media": lambda d: media.features(media.store(d)),
    "tokens": lambda d: tokenfile.read(tokenfile.write(d, WORDS)),
    "pieces": lambda d: pieces.round_trip(d, PIECES),
    "suffixes": lambda d: suffix_dedup.digest(suffix_dedup.dedup(d)),
    "jaccard": jaccard_join.near_duplicates,
    "quality": lambda d: quality.classify(d, d.sparkSession.createDataFrame([(4, 1, 0), (6, 1, None), (None, 1, 0), (7, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")),
    "html": lambda d: html_text.main_text(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "kept AS text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row(spark, odd, name):
    ship(spark)
    out = OPERATORS[name](odd).collect()
    assert len(out) == 12
    key = "page_id" if name == "html" else "doc_id"
    assert sorted(str(r[key]) for r in out) == sorted(str(r.doc_id) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, none, name):
    ship(spark)
    assert OPERATORS[name](none).collect() == []


def test_packing(spark, odd, none):
    ship(spark)
    rows = packing.best_fit(odd, WORDS).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) - 1  # one row repeats
    assert max(r.length for r in rows) == 4096
    assert packing.best_fit(none, WORDS).collect() == []


def test_embeddings(spark):
    ship(spark)
    v = [1.0, 0.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.5], 1), (7, [float("nan"), 0.0, 1.0], 1), (8, v, None), (None, v, 1), (9, [], 1), (10, v, 2), (11, [1.0, 0.0], 1), (2, v, 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept int, links string")
    out = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.near_duplicates(df).collect())
    assert len(out) == 13
    assert [r for r in out if r[0] in "123"] == [("1", 3, "1", True), ("2", 3, "1", False), ("2", 3, "1", False), ("3", 3, "1", False)]
    assert all(r[1] == 0 and r[0] == r[2] and r[3] for r in out if r[0] not in "123")
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, sf, odd, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd, sf)
    assert k == 3 or out.columns == odd.columns
    found = [r.doc_id for r in out.collect()]
    assert set(found) <= {r.doc_id for r in odd.collect()}
    if k == 1:
        assert found.count(5) == 0 and 4 in found and found.count(None) == 1 and 7 not in found
    assert stage(spark, none, sf).collect() == []
