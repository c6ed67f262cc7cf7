"""Scores of all pairs are given out as blocks come, and folded by groups where a query needs the best of each."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelight.operators import blocks


@pytest.mark.parametrize("cells", [1, 37, 2 << 20])
@pytest.mark.parametrize("k", [1, 2, None])
def test_pairs_are_not_kept(k, cells, monkeypatch):
    """A task that is given block after block holds one: before, it gave out nothing until the last."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = random.Random(2)
    vec = lambda: [float(rng.randint(-1, 2)) for _ in range(3)]  # noqa: E731  ties
    asked = [(q, vec()) for q in range(5)]
    made = [[(rng.choice([7, 8, None]), 100 * b + i, vec()) for i in range(20)] for b in range(3)]
    packed = lambda rows, keys, prefix: next(blocks._pack(keys, False, [f"{prefix}_block", f"{prefix}_dim", *(["query_id"] if prefix == "q" else ["doc_id", "tile"]), f"{prefix}_sizes", f"{prefix}_matrix"], True)([pa.table(list(map(pa.array, zip(*rows))), names=[*"abcd"[:keys], "vec"]).to_batches()[0]]))
    q = packed(asked, 1, "q")
    taken = []

    def pairs():
        for b, rows in enumerate(made):
            taken.append(b)
            v = packed(rows, 2, "v")
            yield pa.record_batch([*v.columns, *q.columns], names=[*v.schema.names, *q.schema.names])

    got, seen = [], []
    for batch in blocks._each(["doc_id", "tile"], ["doc_id"], k, False)(pairs()):
        seen.append(len(taken))
        got += zip(*[c.to_pylist() for c in batch.columns])
    assert seen[0] == 1
    want = []
    for rows in made:
        for n, a in asked:
            for doc in {d for d, _, _ in rows}:
                scored = sorted(((float(np.dot(a, v)), t) for d, t, v in rows if d == doc), reverse=True)
                least = scored[min(k or len(scored), len(scored)) - 1][0]
                want.append((n, doc, sorted((t, s) for s, t in scored if s >= least), len(scored)))
    held = {}
    for n, doc, tile, score, many in got:
        one = held.setdefault((n, doc, tile // 100), [[], 0])
        one[0].append((tile, score))
        one[1] += many
    assert sorted(((n, d, sorted(x), m) for (n, d, _), (x, m) in held.items()), key=str) == sorted(want, key=str)


def test_null_group(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    v = spark.createDataFrame([(None, 1, [1.0, 0.0]), (None, 2, [0.0, 1.0]), (3, 3, [1.0, 1.0])], "doc_id long, tile long, vec array<double>").coalesce(1)
    got = blocks.group_scores(q, v, ("vec", "vec"), ["doc_id", "tile"], ["doc_id"], 1).groupBy("doc_id").agg(F.max("score"), F.sum("n"))
    assert {r[0]: (round(r[1], 6), r[2]) for r in got.collect()} == {None: (1.0, 2), 3: (0.707107, 1)}
