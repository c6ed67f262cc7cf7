"""Dense search in blocks against brute force, with ties, odd vectors and more queries than are broadcast."""

import math
import random

import pytest

import numpy as np

from pagelight.operators import blocks, retrieval
from pagelight.operators import vector_index as V


def brute(queries, pages, k):
    def unit(v):
        n = max(math.sqrt(sum(x * x for x in v)), 1e-12)
        return [x / n for x in v]

    sound = [(d, p, unit(v)) for d, p, v in pages if v is not None and None not in v and all(map(math.isfinite, v)) and len(v) == 4]
    out = []
    for q, v in queries:
        scored = sorted((-round(sum(a * b for a, b in zip(unit(v), w)), 9), d, p) for d, p, w in sound)
        out += [(q, d, p, -s + 0.0, r + 1) for r, (s, d, p) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("most", [blocks.QUERY_BYTES, 3])
@pytest.mark.parametrize("size", [blocks.BLOCK_BYTES, 200])
def test_dense_search(spark, most, size, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_BYTES", most)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rng = random.Random(1)
    made = lambda: [float(rng.randint(-2, 2)) for _ in range(4)]  # noqa: E731  many ties
    pages = [(d, p, made()) for d in range(60) for p in (1, 2)]
    pages += [(100, 1, None), (101, 1, [1.0, None, 0.0, 1.0]), (102, 1, [float("nan"), 1.0, 0.0, 0.0]), (104, 1, [0.0] * 4)]
    queries = [(q, made()) for q in range(7)]
    a = spark.createDataFrame(queries, "query_id long, vec array<float>")
    b = spark.createDataFrame(pages, "doc_id long, page int, vec array<float>").repartition(5)
    got = sorted((r.query_id, r.doc_id, r.page, r.score + 0.0, r["rank"]) for r in retrieval.dense_search(a, b, 10).collect())
    want = brute(queries, pages, 10)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and all(abs(x[3] - y[3]) < 1e-8 for x, y in zip(got, want))
    assert retrieval.dense_search(a.limit(0), b, 10).collect() == [] and retrieval.dense_search(a, b.limit(0), 10).collect() == []


def multi(rng, n, far=0.0):
    return [[[rng.gauss(far, 1) for _ in range(6)] for _ in range(rng.randint(1, 5))] for _ in range(n)]


def test_max_sim_of_shards(spark, tmp_path):
    rng = random.Random(3)
    pages, asked = multi(rng, 150), multi(rng, 6)
    p = spark.createDataFrame([(k, 1, v) for k, v in enumerate(pages)], "doc_id long, page int, vecs array<array<double>>").repartition(4)
    q = spark.createDataFrame([(k, t, v) for k, vs in enumerate(asked) for t, v in enumerate(vs)], "query_id long, tok int, vec array<double>")
    V.write_shards(p, str(tmp_path / "index"), 40)
    shards = V.read_shards(spark, str(tmp_path / "index"))
    assert shards.select("shard").distinct().count() == 4 and shards.count() == 150
    want = []
    for a, qs in enumerate(asked):
        scored = sorted((-round(sum(max(sum(x * y for x, y in zip(u, v)) for v in vs) for u in qs), 9), d) for d, vs in enumerate(pages))
        want += [(a, d, -s, r + 1) for r, (s, d) in enumerate(scored[:7])]
    for df in (p, shards):
        got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in retrieval.max_sim(q, df, 7).collect())
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want)] and all(abs(x[2] - y[2]) < 1e-8 for x, y in zip(got, sorted(want)))
    some = V.read_shards(spark, str(tmp_path / "index"), [0, 2])
    assert {r.shard for r in some.select("shard").distinct().collect()} == {0, 2}
    spark.read.parquet(str(tmp_path / "index" / "metadata")).limit(100).write.parquet(str(tmp_path / "less"))
    (tmp_path / "index" / "metadata").rename(tmp_path / "old")
    (tmp_path / "less").rename(tmp_path / "index" / "metadata")
    with pytest.raises(ValueError):
        V.read_shards(spark, str(tmp_path / "index"))


def test_pages_that_cannot_be_shards(spark, tmp_path):
    schema = "doc_id long, page int, vecs array<array<double>>"
    for vecs in (None, [], [[1.0], [1.0, 2.0]], [[]], [None]):
        with pytest.raises(ValueError):
            V.write_shards(spark.createDataFrame([(1, 1, [[1.0, 2.0]]), (2, 1, vecs)], schema), str(tmp_path / "bad"))
    V.write_shards(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert V.read_shards(spark, str(tmp_path / "none")).collect() == []


def test_bounds_skip_pages_and_lose_none():
    rng = np.random.default_rng(2)
    make = lambda n, centre, spread: [centre + rng.normal(0, spread, (int(rng.integers(1, 5)), 8)) for _ in range(n)]
    near, far = make(50, np.full(8, 3.0), 0.1), make(400, np.full(8, -3.0), 0.1)
    q = [np.full((3, 8), 1.0), np.full((2, 8), 0.5)]
    best = blocks._Best(None, np.array([3, 2]), np.concatenate(q), 5, False)
    pages = near + far
    for lo in range(0, len(pages), 50):
        part = pages[lo : lo + 50]
        best.meet(np.arange(lo, lo + len(part)), np.ones(len(part), int), np.array([len(x) for x in part]), np.concatenate(part))
    best.shrink()
    assert best.skipped == 400
    for k, x in enumerate(q):
        score = np.array([(x @ p.T).max(1).sum() for p in pages])
        held = {int(d) for n, d in zip(best.held[0][0], best.held[0][2]) if n == k}
        assert set(np.argsort(-score)[:5].tolist()) <= held


def test_self_ranks_by_brute_force(spark):
    rng = random.Random(8)
    stored = [(d, p, [float(rng.randint(-3, 3)) for _ in range(4)]) for d in range(40) for p in (1, 2)] + [(90, 1, None)]
    fresh = [(d, p, v and [x + rng.choice([0, 0, 1]) for x in v]) for d, p, v in stored]
    a, b = (spark.createDataFrame(x, "doc_id long, page int, vec array<double>") for x in (stored, fresh))
    rows = V.self_retrieval(a, b, 1000, 3).collect()
    want = {}
    for (d, p, v), (_, _, f) in zip(stored, fresh):
        order = [x[:3] for x in brute([(0, f)], [s for s in stored if s[2]], 1000)] if f else []
        full = sorted(((-x[3], x[1], x[2]) for x in brute([(0, f)], [s for s in stored if s[2]], 1000))) if f else []
        want[d, p] = 1 + [x[1:] for x in full].index((d, p)) if f else None
    assert {(r.doc_id, r.page): r.self_rank for r in rows} == want
    assert all(r.hit_at_1 == int(r.self_rank == 1) and r.hit_at_k == int((r.self_rank or 99) <= 3) for r in rows)
    assert [r.doc_id for r in V.self_retrieval(a, b, 5).collect()] == [r.doc_id for r in V.self_retrieval(a.repartition(7), b, 5).collect()]
    s = V.self_recall(V.self_retrieval(a, b, 1000, 3)).first()
    assert s.samples == 81 and s.self_recall_at_k >= s.self_recall_at_1
