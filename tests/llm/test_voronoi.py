"""The recursive join of large regions against brute force, with limits that force many levels."""

import random

import numpy as np
import pytest

from pagelight.llm import common, jaccard_join


def clusters(rng, groups, members, words=60, kept=0.04):
    out, at = [], 0
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for _ in range(members):
            # one long common passage puts all of them into the same regions
            own = [w if rng.random() > kept else f"x{rng.randint(0, 99)}" for w in base]
            out.append((at, " ".join([f"common{k}" for k in range(12)] + own)))
            at += 1
    return out


def brute(rows, t):
    sets = {}
    for d, text in rows:
        w = text.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    ids = sorted(sets)
    forest = common.Forest(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if 100 * len(x & y) >= t * len(x | y):
                forest.join(i, j)
    return {a: ids[forest.find(i)] for i, a in enumerate(ids)}


@pytest.mark.parametrize("t", [50, 65, 80, 95])
def test_thresholds(spark, t):
    common.ship(spark)
    rng = random.Random(t)
    rows = []
    for k in range(12):  # sizes and similarities about the limit
        base = [f"b{k}w{i}" for i in range(rng.choice([9, 24, 54]))]
        for j in range(5):
            rows.append((len(rows), " ".join(base[: max(5, int(len(base) * rng.uniform(t / 100 - 0.1, 1)))])))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), t=t).collect()}
    assert got == brute(rows, t)


def test_regions_are_cut_again_and_again(spark, monkeypatch):
    common.ship(spark)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 5)
    monkeypatch.setattr(jaccard_join, "TURNS", 0)
    monkeypatch.setattr(jaccard_join, "window", lambda n, distance: n)  # all shingles are regions
    depths, plain = [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda regions, held, limit, depth: depths.append(depth) or plain(regions, held, limit, depth))
    rows = clusters(random.Random(1), 9, 7)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 80)
    assert max(depths) >= 1  # cells were cut once more


def test_blocks_of_what_pivots_cannot_cut(spark, monkeypatch):
    common.ship(spark)
    for name, value in (("SMALL", 2), ("BLOCK", 5), ("PIVOTS", 2), ("TURNS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    blocks, plain = [], jaccard_join.compare_blocks
    monkeypatch.setattr(jaccard_join, "compare_blocks", lambda regions, held, t: blocks.append(regions.count()) or plain(regions, held, t))
    rows = clusters(random.Random(2), 1, 30, kept=0.03)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 80) and sum(blocks) > 0


def test_windows_lose_no_link():
    """Every pair within the limit meets in some cell."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = [np.unique(rng.integers(0, 300, 40)) for _ in range(4)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.12], rng.integers(0, 300, 3)])).astype(np.uint64) for b in base for _ in range(8)]
        size, both = jaccard_join._common(sets)
        member, cell = jaccard_join.cells(size, both, rng.choice(len(sets), 5, replace=False), 0.2)
        held = [set(cell[member == k].tolist()) for k in range(len(sets))]
        i, j = np.nonzero(100 * both >= 80 * (size[:, None] + size - both))
        assert all(held[a] & held[b] for a, b in zip(i, j))


def test_bitmaps_rule_out_unlike_pairs_alone(spark):
    """Most pairs that share a region are unlike: their whole sets aren't shuffled (6 GB failed by disk), and no link is lost."""
    common.ship(spark)
    rng = np.random.default_rng(3)
    sets = {}
    for k in range(120):
        n = int(rng.integers(1, 900))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for j, share in enumerate((0, 0.02, 0.1, 0.2)):
            swap = rng.random(len(base)) < share
            sets[4 * k + j] = np.unique(np.where(swap, rng.integers(0, 2**63, len(base)).astype(np.uint64), base))
    for x in (np.arange(1, dtype=np.uint64), np.arange(5, dtype=np.uint64), np.arange(4000, dtype=np.uint64), np.arange(5000, dtype=np.uint64)):
        sets[len(sets)] = x
    held = spark.createDataFrame([(k, x.tobytes(), len(x), jaccard_join.marks(x)) for k, x in sets.items()], "id long, shingles binary, n long, bits binary")
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and (a // 4 == b // 4 or (a * b) % 11 == 0 or a >= len(ids) - 4)]
    for t in (50, 80, 95):
        want = set()
        for a, b in pairs:
            both = len(np.intersect1d(sets[a], sets[b]))
            apart = len(sets[a]) + len(sets[b]) - 2 * both
            assert jaccard_join.apart(jaccard_join.marks(sets[a]), jaccard_join.marks(sets[b])) <= apart
            if 100 * both >= t * (both + apart):
                want.add((a, b))
        df = spark.createDataFrame(pairs, "a long, b long")
        passed = {tuple(r) for r in jaccard_join.likely(df, held, t).collect()}
        assert want <= passed and len(passed - want) < len(pairs) / (5 if t == 50 else 20)
        assert {tuple(r) for r in jaccard_join.compare(df, held, t).collect()} == want
