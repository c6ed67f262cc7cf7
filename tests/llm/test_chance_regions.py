"""Documents that share a few passages by chance: at size these are most pairs, and none of them may be shuffled with a bitmap or a set."""

import random

import numpy as np

from pagelight.llm import jaccard_join


def test_chance_pairs_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    phrases = [" ".join(f"p{k}w{i}" for i in range(5)) for k in range(60)]
    rows = []
    for d in range(90):
        words = [[f"d{d}x{i}"] for i in range(150)]
        for p in rng.sample(phrases, 8):
            words.insert(rng.randrange(len(words)), p.split())
        rows.append((d, " ".join(w for part in words for w in part)))
    rows += [(100 + d, rows[d][1] + " and more") for d in range(0, 90, 9)]
    sent, plain = [], jaccard_join.likely
    monkeypatch.setattr(jaccard_join, "likely", lambda pairs, held, t: sent.append(pairs.count()) or plain(pairs, held, t))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: d - 100 if d >= 100 else d for d, _ in rows}
    assert sum(sent) <= 3 * 10


def test_bitmaps_are_small():
    rng = np.random.default_rng(8)
    for n in (1, 60, 65, 300, 5000):
        assert len(jaccard_join.marks(rng.integers(0, 2**63, n).astype(np.uint64))) <= max(8, n / 2)


def test_rarest_shingles_come_first(spark, monkeypatch):
    """Shingles of one document in ten were in no order, so their regions grew with the table; rarer ones come before frequent ones."""
    monkeypatch.setattr(jaccard_join, "SAMPLE", 300)
    rows = [(d, " ".join([f"s{d % 10}y{i}" for i in range(40)] + [f"t{d % 3}y{i}" for i in range(40)] + [f"d{d}x{i}" for i in range(60)])) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h, level = jaccard_join.frequent(docs, jaccard_join.sketch(docs, 5), 5)
    assert (h[1:] > h[:-1]).all() and sorted(set(level.tolist())) == [4, 5, 7] and len(h) == 10 * 36 + 3 * 36 + 30 * 4
    packed = jaccard_join.replicate(docs, (h, level), 4, 5, 0.2)
    assert jaccard_join.shared_regions(packed).count() == 0
