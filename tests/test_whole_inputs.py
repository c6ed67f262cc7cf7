"""Registered queries over their whole inputs, against plain Python."""

import hashlib
import re

import numpy as np
import pytest

from pagelight.operators import evidence as E
from pagelight.plans import fixtures as D
from pagelight.plans import queries as Q


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], float)
    return ids, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), v


def test_dense_searches_every_fiftieth_in_all(spark, sf, vectors):
    ids, unit, _ = vectors
    for name, k in (("dense_topk", 10), ("semantic_topk", 5)):
        got = {}
        for r in Q.QUERIES[name](spark, sf).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id * 4 + r.page - 1))
        want = {}
        for i in np.flatnonzero(ids % 50 == 0):
            scores = np.round(unit @ unit[i], 9)
            want[ids[i]] = list(enumerate(ids[np.lexsort((ids, -scores))][:k].tolist(), 1))
        assert {q: sorted(x) for q, x in got.items()} == want


def test_max_sim_searches_every_fiftieth_in_all(spark, sf, vectors):
    ids, _, v = vectors
    pages = {int(d): v[ids // 4 == d] for d in set(ids // 4)}
    got = {}
    for r in Q.QUERIES["maxsim_topk"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    want = {}
    for q in pages:
        if q % 50 == 0:
            scores = {d: round(float((pages[q] @ p.T).max(axis=1).sum()), 9) for d, p in pages.items()}
            want[q] = list(enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:10], 1))
    assert {q: sorted(x) for q, x in got.items()} == want


@pytest.mark.parametrize("name", ["in_document_ranking", "doc_routing_centroid", "doc_routing_max", "doc_routing_top5", "neighbor_expand", "neighbor_in_order", "folder_vote", "tile_to_page", "tile_modes"])
def test_every_fiftieth_vector_is_asked(spark, sf, vectors, name):
    ids = vectors[0]
    assert {r.query_id for r in Q.QUERIES[name](spark, sf).collect()} == set(ids[ids % 50 == 0].tolist())


def test_all_vectors_are_tiles(spark, sf, vectors):
    hits = Q.QUERIES["tile_modes"](spark, sf).groupBy("query_id").sum("hits").collect()
    assert {r[1] for r in hits} == {len(vectors[0])}


def test_evidence_holds_the_whole_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in Q.QUERIES["evidence_text"](spark, sf).collect()}
    cut = {r.doc_id: r for r in Q.QUERIES["rerank_text"](spark, sf).collect()}
    assert len(got) == len(cut) == len(rows) and max(r.n_chars for r in got.values()) > 4096
    for r in rows:
        blocks = [f"[TABLE_TEXT]\nTable {r.doc_id}"] * (r.doc_id % 3 == 0) + [f"[CAPTION]\n{r.lang}"] * (r.doc_id % 2 == 0) + [f"[PAGE_TEXT]\n{r.text.strip()}"]
        text = "\n\n".join(blocks)
        assert (got[r.doc_id].evidence, got[r.doc_id].n_chars) == (digest(text), len(text))
        assert (cut[r.doc_id].text, cut[r.doc_id].n_chars) == (digest(text[:4096]), min(4096, len(text)))


@pytest.fixture(scope="module")
def labelled(spark, sf):
    """Lines of each document, collapsed, without empty ones, two of nine after a label."""
    out = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        lines = []
        for n, line in enumerate(r.text.split("\n")):
            label = {0: f"Table {r.doc_id % 50}: ", 4: f"Figure {n}a. "}.get((r.doc_id + n) % 9, "")
            lines.append(" ".join((label + line).split()))
        out[r.doc_id] = [x for x in lines if x]
    return out


def test_captions_hold_whole_lines(spark, sf, labelled):
    want = set()
    for d, lines in labelled.items():
        seen = set()
        for n, line in enumerate(lines):
            if re.match(r"(?i)(table|figure|fig\.?|chart|graph)\s*[0-9]+[a-z]?\b", line):
                text = [line]
                for more in lines[n + 1 : n + 4]:
                    if re.match(r"(?i)(table|figure|fig\.?|chart|graph)\s*[0-9]+[a-z]?\b", more) or re.match(r"\d+(\.\d+)*\.?\s+[A-Z]", more) or len(more) <= 2:
                        break
                    text.append(more)
                if (key := " ".join(text).lower()) not in seen:
                    want.add((d, n, " ".join(text)))
                seen.add(key)
    assert {(r.doc_id, r.pos, r.caption) for r in Q.QUERIES["captions"](spark, sf).collect()} == want


def test_table_blocks_hold_whole_lines(spark, sf, labelled):
    want = set()
    for d, lines in labelled.items():
        seen = set()
        for n, line in enumerate(lines):
            if re.match(r"(?i)table\s*[0-9]+[a-z]?\b", line):
                block = "\n".join(lines[max(0, n - 28) : n + 11])
                if (key := " ".join(block.lower().split())) not in seen:
                    want.add((d, n, digest(block)))
                seen.add(key)
    assert {(r.doc_id, r.pos, r.block) for r in Q.QUERIES["table_blocks"](spark, sf).collect()} == want


def test_captions_stop(spark):
    lines = ["Table 1: a", "goes on", "2.1 Results of it", "Figure 2b. c", "x", "not it", "Fig. 3 d", "one", "two", "three", "four"]
    out = E.captions(spark.createDataFrame([(1, 1, "\n".join(lines))], "doc_id long, page long, text string")).collect()
    assert [(r.caption, r.reference) for r in sorted(out, key=lambda r: r.pos)] == [("Table 1: a goes on", "table 1"), ("Figure 2b. c", "figure 2b"), ("Fig. 3 d one two three", "figure 3")]


@pytest.fixture(scope="module")
def found(spark, sf):
    """For each question its ten best pages: (rank, doc_id, page, text)."""
    out = {}
    for r in Q._candidates(spark, sf).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.page, r.text))
    return {q: sorted(x) for q, x in out.items()}


def test_contexts_have_the_reference_s_limits(spark, sf, found):
    for name, separator in (("pack_context", 2), ("pack_text_context", 0)):
        want = {}
        for q, pages in found.items():
            blocks, used, cut = [], 0, False
            for rank, doc, page, text in pages:
                head, body = f"[rank={rank} doc_id={doc} page={page}]\n", text.strip()
                room = 12000 - used - len(head)
                if not body or room <= 0:
                    cut |= bool(body)
                    continue
                blocks.append(head + body[:room])
                cut |= room < len(body)
                used += len(head) + len(body) + separator
            want[q] = digest("\n\n".join(blocks)), len(blocks), cut
        assert {r.query_id: (r.context, r.n_blocks, r.truncated) for r in Q.QUERIES[name](spark, sf).collect()} == want
    want = {q: digest("\n\n".join(f"[{k}] {text[:4000]}" for k, (*_, text) in enumerate([p for p in pages if len(p[3].strip()) > 10][:5], 1))) for q, pages in found.items()}
    assert {r.query_id: r.context for r in Q.QUERIES["numbered_context"](spark, sf).collect()} == want


def test_cascade_reranks_a_hundred(spark):
    sf = "/root/testdata/sf0.01"  # questions there have more than thirty candidates with a vector
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    at = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in rows}
    mixed = {}
    for r in D.ranked(spark, sf, 100).collect():
        if r.doc_id in at and r.query_id in at:
            mixed.setdefault(r.query_id, []).append((0.3 * r.score + 0.7 * (float(at[r.doc_id] @ at[r.query_id]) + 1) / 2, r.doc_id))
    want = {q: [d for _, d in sorted((-round((x - min(m)[0]) / (max(m)[0] - min(m)[0]) if max(m)[0] - min(m)[0] > 1e-12 else 1.0, 9), d) for x, d in m)][:10] for q, m in mixed.items()}
    got = {}
    for r in Q.QUERIES["cascade_topk"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    assert {q: [d for _, d in sorted(x)] for q, x in got.items()} == want
