"""Divergence of sources, fingerprints and the audit of filters against plain loops."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pyarrow.parquet as pq
import pytest

from pagelight.llm import divergence, filter_audit, fingerprints, queries
from pagelight.llm.common import ship
from pyspark.sql import functions as F

CASES = ["sf", "odd", "none"]


@pytest.fixture(params=CASES)
def case(request, spark, sf, odd, none):
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet") if request.param == "sf" else {"odd": odd, "none": none}[request.param]


# -- divergence ---------------------------------------------------------------


def plain_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(term.findall((text or "").translate(lower)))
        groups.add((lang, source))
        counts[lang, source].update(found)
        held.update((lang, t) for t in found)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted((t for g, t in held if g == lang and held[g, t] >= least), key=str.encode)
        total = sum((counts[g] for g in groups if g[0] == lang), Counter())

        def prices(c):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]

        p = {s: prices(counts[g, s]) for g, s in groups if g == lang}
        whole = prices(total)
        for s in p:
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in p if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            more = sorted((y - x, t.encode(), t) for x, y, t in zip(p[s], whole, kept) if counts[lang, s][t] > 0 and x > y)
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(more[:top])]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 30])
def test_divergence(case, least, monkeypatch):
    monkeypatch.setattr(divergence, "MIN_DOCS", least)
    rows = [(r.text, r.lang, r.source) for r in case.collect()]
    assert sorted(map(tuple, divergence.audit(case).collect())) == plain_divergence(rows, least, 50)


def test_divergence_of_sizes_beyond_a_broadcast(spark, sf, monkeypatch):
    df = queries.op11_divergence(spark, sf)
    want = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(divergence, "FEW_GROUPS", -1)
    assert sorted(map(tuple, queries.op11_divergence(spark, sf).collect())) == want


def test_counts_pass_on_in_parts(spark, sf):
    """A task that holds few rows passes counts on in between."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    batches = docs.toArrow().to_batches(max_chunksize=40)

    def total(held):
        saved, divergence.HELD = divergence.HELD, held
        try:
            found = Counter()
            for b in divergence._count(iter(batches)):
                for r in b.to_pylist():
                    for p in r["posts"]:
                        found[r["lang"], r["term"], p["source"], "n"] += p["cnt"]
                        found[r["lang"], r["term"], p["source"], "d"] += p["docs"]
            return found
        finally:
            divergence.HELD = saved

    assert total(500) == total(10**9)


def test_probability(spark):
    rows = [(c, n, v) for c in (0, 1, 7, 10**9, 9 * 10**9, 10**12, 10**14) for n in (0, 5, 10**9 + 7, 3 * 10**14) for v in (0, 1, 3, 10**6)]
    out = spark.createDataFrame(rows, "c long, n long, v long").select("*", divergence.probability(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    for r in out:
        want = 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) if r.v else None
        assert r.p == want or want > 10**15  # a count is at most n


# -- fingerprints -------------------------------------------------------------


def plain_tree(text):
    pieces = re.findall(r"[^\n]{1,64}\n*|\n+", text)
    assert "".join(pieces) == text
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:32]
    sections, now = [], []
    for x in pieces:
        now.append((short(x), "." * x.endswith("\n\n")))
        if now[-1][0][-1] == "0" or now[-1][1]:
            sections.append(now)
            now = []
    sections += [now] if now else []
    nodes = [short(",".join(a + b for a, b in s)) for s in sections]
    root = hashlib.sha256("/".join(nodes).encode()).hexdigest()
    shown = "/".join([root, *[n[:16] + ":" + "".join(a[:8] for a, _ in s) for n, s in zip(nodes, sections)]])
    return shown, {root, *[n[:16] for n in nodes], *[a[:8] for s in sections for a, _ in s]}


def plain_edits(rows):
    digest = lambda r: hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    out = []
    like = lambda a, b: 1.0 if a[0] == b[0] else len(a[1] & b[1]) / len(a[1] | b[1])
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        one, two, three = map(plain_tree, (t, edited, after))
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), one[0], two[0], like(one, two), like(one, three)))
    return sorted(out)


def test_fingerprints(case):
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in fingerprints.compare_edits(case).collect())
    assert got == plain_edits([(r.doc_id, r.text) for r in case.collect()])


def test_fingerprints_over_many_ranges(spark):
    ship(spark)
    rows = [(k // 2 if k % 7 else k, f"line {k % 5}\n\nand {'z' * (k % 90)}") for k in range(400)] + [(9, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in fingerprints.compare_edits(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_edits(rows)


def test_roots_and_branches(spark, sf):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 3000").limit(20).collect()]
    rows = [(a, a[:1500] + "#" + a[1501:]) for a in docs]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select("*", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near"), fingerprints.edits(F.col("fa"), F.col("fb")).alias("edits"), fingerprints.edits(F.col("fa"), F.col("fa")).alias("none")).collect():
        assert r.fa != r.fb and 0.7 < r.near < 1 and r.none == []
        assert 1 <= sum(len(e.leaves) for e in r.edits) <= 2
        pieces = re.findall(fingerprints.PIECES, r.a)
        leaves = [len(x) // 8 for x in (s.split(":")[1] for s in r.fa.split("/")[1:])]
        e = r.edits[0]
        k = sum(leaves[: e.section]) + e.leaves[0]
        assert len("".join(pieces[:k])) <= 1500 < len("".join(pieces[: k + 1]))


def test_equal_texts_alone_have_equal_fingerprints(spark, sf):
    rows = queries.op12_fingerprints(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = defaultdict(set)
    for r in rows:
        by[r.fingerprint].add(text[r.doc_id])
    assert len(rows) == len(text) and all(len(x) == 1 for x in by.values())
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4 > 0.1 > sum(r.near_next for r in rows) / len(rows)


# -- filters ------------------------------------------------------------------


def plain_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            here = rows
            for k, f in enumerate(order):
                gone, here = [r for r in here if r[0][f]], [r for r in here if not r[0][f]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), k + 1, len(here), len(gone), sum(r[0][f] for r in rows) - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def test_filter_audit(spark, sf, case):
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(4, 1, 0), (4, 0, None), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int").select("doc_id", F.col("quality"), F.col("toxic")), allowMissingColumns=True)
    got = sorted(map(tuple, filter_audit.audit(case, labels).collect()))
    assert got == plain_audit([(r.doc_id, r.text, r.source) for r in case.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_filter_audit_without_labels(spark, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    got = sorted(map(tuple, filter_audit.audit(odd, labels).collect()))
    assert got == plain_audit([(r.doc_id, r.text, r.source) for r in odd.collect()], [])
