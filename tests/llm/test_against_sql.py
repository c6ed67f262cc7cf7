"""The registered queries that have SQL against it, and a table of vectors with links."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagelight.llm import common, embed_dedup, queries


def compare(df, sql, **views):
    c = duckdb.connect()
    for name, path in views.items():
        c.sql(f"create view {name} as select * from '{path}'")
    r = c.sql(sql)
    want = sorted(tuple(map(str, x)) for x in r.fetchall())
    got = sorted(tuple(str(x[k]) for k in r.columns) for x in df.collect())
    assert sorted(df.columns) == sorted(r.columns) and got == want
    return want


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), queries.ORACLES[name], documents=f"{sf}/documents.parquet", embeddings=f"{sf}/embeddings.parquet", labels=f"{sf}/labels.parquet")


def test_links_of_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 60)
    common.ship(spark)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 16))
    near = base[rng.integers(0, 120, 200)] + rng.normal(scale=0.12, size=(200, 16))
    v = np.float32(np.concatenate([base, near, base[:15], np.zeros((2, 16))]))
    label = rng.integers(0, 2, len(v)).tolist()
    rows = [x.tolist() for x in v]
    rows[5] = None
    label[6] = None
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}), tmp_path / "embeddings.parquet")
    out = compare(queries.op5_embeddings(spark, str(tmp_path)), embed_dedup.SQL, embeddings=str(tmp_path / "embeddings.parquet"))
    assert sum(r[1] != "0" for r in out) > 50
