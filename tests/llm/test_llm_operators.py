"""Each operator against brute force, a library or an exact round trip."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pagelight.llm import common, embed_dedup, html_text, jaccard_join, licenses, media, packing, pieces, quality, queries, suffix_dedup, tokenfile, tokens, words
from pagelight.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def docs(sf):
    return sorted(duckdb.connect().sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


# -- licences ----------------------------------------------------------------


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def test_licenses(spark, sf, docs):
    out = {r.doc_id: r for r in queries.op1_licenses(spark, sf).collect()}
    for i, text in docs:
        w, places, labels = plain_words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.encode().split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_matching_statistics():
    s = licenses.Scanner({"a b": "x"}, {"y": ["a b c d e", "c d a b"], "z": ["d e a"]})
    number = {w: k + 1 for k, w in enumerate("abcde")}
    rng = random.Random(3)
    strings = ["ab", "abcde", "cdab", "dea"]
    for _ in range(300):
        text = "".join(rng.choice("abcde") for _ in range(12))
        base, matches = s.scan([number[c] for c in text], 0)
        assert sorted(p for _, p in base) == [i for i in range(11) if text[i : i + 2] == "ab"]
        longest = [max(n for n in range(i + 2) if any(text[i + 1 - n : i + 1] in x for x in strings)) for i in range(12)]
        right = [(i, longest[i]) for i in range(12) if longest[i] >= licenses.MIN_MATCH and (i == 11 or longest[i + 1] <= longest[i])]
        assert [(e, n) for e, n, _ in matches] == right


def test_covered_templates(spark):
    text = "x " + licenses.TEMPLATES["isc"][0].replace("hereby", "here by") + " y"
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "isc" and 0.8 <= r.score < 1 and r.spans[0].first_word == 1


# -- tokens ------------------------------------------------------------------


def test_tokens_are_the_library_s(docs):
    e = tokens.encoder(vocabulary())
    rng = random.Random(2)
    made = ["".join(rng.choice("abcdeDÉéçßÿ÷×.,'!%&|<> \n\t#À̅Ωσς12٣") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts = [t for _, t in docs] + made + ["don't <|endoftext|>stop", "", "I'LL\tgo'", "<|ENDOFTEXT|>", "a\x1cb c"]
    assert all(e.whole(t) == x for t, x in zip(texts, e.encode_all(texts)))


def check_token_files(rows, docs):
    e, at = tokens.encoder(vocabulary()), 0
    out = {r.doc_id: r for r in rows}
    for i, text in docs:
        ids = e.whole(text or "") + np.array([2], "<u4").tobytes()
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_files(spark, sf, docs):
    check_token_files(queries.op4_token_files(spark, sf).collect(), docs)


def test_token_files_of_many_shards(spark, sf, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(tokenfile, "FILE_TOKENS", 2_000)
    path = str(tmp_path / "kept")
    written = tokenfile.write(common.table(spark, sf, "documents"), vocabulary(), path=path)
    assert written.select("shard").distinct().count() > 5 and written.where("file > 0").count() > 0
    check_token_files(tokenfile.read(tokenfile.files_at(spark, path)).collect(), docs)
    for r in tokenfile.export(written, str(tmp_path / "files")).collect():
        with open(r.path, "rb") as f:
            assert len(tokenfile.TokenFile(f.read()).tokens()) > 0


@pytest.mark.parametrize("n", [0, 1, 40, 300_000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 49_000 if n != 40 else 3, n)
    f = tokenfile.TokenFile(tokenfile.write_file([1, None, 5], np.array([n, 0, 0]), ids))
    assert (f.tokens() == ids).all() and f.doc_ids == [1, None, 5]
    for p in rng.integers(0, max(n, 1), 5).tolist() if n else []:
        t = int(ids[p])
        at = np.flatnonzero(ids == t)
        assert f.access(p) == t and f.count(t) == len(at) and f.occurrence(t, len(at) // 2) == at[len(at) // 2] and f.occurrence(t, len(at)) is None
        assert f.count(t, n // 4, n // 2) == ((at >= n // 4) & (at < n // 2)).sum()


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(25):
        h = Counter(min(4096, int(rng.lognormvariate(rng.choice([4, 6, 7]), 1)) + 1) for _ in range(rng.choice([1, 10, 500, 20_000])))
        got, sequences = Counter(), {}
        for length, first, n, sequence, places, offset in packing.plan(dict(h)):
            assert got[length] == first
            got[length] += n
            for q in range(n):
                sequences.setdefault(sequence + q // places, []).append((offset + q % places * length, length))
        assert got == h
        for held in sequences.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(sequences) <= best_fit_decreasing(h)


def best_fit_decreasing(histogram, capacity=4096):
    """Sequences that plain best fit of single documents, longest first, needs."""
    rooms, n = [], 0
    for x in sorted(histogram, reverse=True):
        for _ in range(histogram[x]):
            i = bisect.bisect_left(rooms, x)
            if i < len(rooms):
                room = rooms.pop(i)
            else:
                room, n = capacity, n + 1
            if room > x:
                bisect.insort(rooms, room - x)
    return n


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "bimodal", "pairs"])
def test_packing_needs_few_sequences(kind):
    rng = np.random.default_rng(5)
    x = {
        "uniform": lambda: rng.integers(1000, 3000, 2000),
        "lognormal": lambda: np.minimum(4096, rng.lognormal(7, 1, 2000).astype(int) + 1),
        "bimodal": lambda: np.concatenate([rng.integers(1300, 1500, 900), rng.integers(2500, 2800, 800)]),
        "pairs": lambda: np.repeat([1366, 1365, 2048, 1024, 700], [300, 700, 200, 400, 90]),
    }[kind]()
    h = Counter(x.tolist())
    used = max(s + n // p for _, _, n, s, p, _ in packing.plan(dict(h)))
    bound = -(-sum(k * v for k, v in h.items()) // 4096)
    assert used <= best_fit_decreasing(h)
    assert kind != "pairs" or used <= 1.01 * bound + 1


def test_configurations_are_optimal():
    """Column generation against the sizes' own bound: 2 x 2000, 3 x 1300 and mixed ones."""
    found = packing.configurations([2000, 1300, 790], [100, 300, 200], 4096)
    got = np.sum([np.array(p) * n for p, n in found], 0)
    assert (got <= [100, 300, 200]).all() and got @ [2000, 1300, 790] >= 0.97 * (100 * 2000 + 300 * 1300 + 200 * 790)
    assert all(np.dot(p, [2000, 1300, 790]) <= 4096 for p, _ in found)
    assert sum(n for _, n in found) <= -(-(100 * 2000 + 300 * 1300 + 200 * 790) // 4000)


def test_packing(spark, sf, docs):
    e, by, sequences = tokens.encoder(vocabulary()), {}, {}
    for r in queries.op3_packing(spark, sf).collect():
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in docs:
        ids, at = e.whole(text or "") + np.array([1], "<u4").tobytes(), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert 4 * at == len(ids)
    total = sum(n for held in sequences.values() for _, n in held)
    assert len(sequences) == -(-total // 4096)  # on this table the bound is reached
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_pieces_are_the_library_s(docs):
    m = pieces.model(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(0)
    made = ["".join(rng.choice("aeionrst  ▁\n\té漢😀.,'0") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts = [t for _, t in docs] + made + ["", " ", "  a", "▁", "</s> <s> <0x0A>", "a" * 300, " " * 100 + "x", "\x00b"]
    got = pieces.encode_batch(m, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == m.library.encode(texts, num_threads=1)
    assert all(pieces.decode(m, x) == t.replace("▁", " ") for t, x in zip(texts, got))


# -- media and pages ---------------------------------------------------------


def test_media_round_trip():
    rng = np.random.default_rng(0)
    sizes = (0, 1, 576, 577, 5000, 200_000, media.IMAGE_BLOCKS, media.IMAGE_BLOCKS + 576)
    given = [media.pad(rng.integers(0, 256, n, dtype=np.uint8)) for n in sizes] + [np.full(576, 255, np.uint8)]
    held = media.encode_many(given)
    assert all((p == g).all() for p, (g, _) in zip(given, media.decode_many(held)))
    assert media.encode_many([given[4]]) == [held[4]]  # the same bytes whatever stands beside


def test_media_figures(spark, sf, docs):
    out = {r.doc_id: r for r in queries.op10_media(spark, sf).collect()}
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_pages_of_the_table(sf):
    import html

    for page in duckdb.connect().sql(f"select html from '{sf}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)(</article>|$)", page[0], re.S).group(1)
        body = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1)\b[^>]*>|<br>", " ", body))
        assert re.sub(r"\s+", " ", html_text.extract(page[0])) == re.sub(r"\s+", " ", html.unescape(body)).strip()


def test_boilerplate():
    good = "The house of the man was in the town and it was old, so that the people of the town had seen it for a long time. " * 2
    page = f"""<html><head><title>T</title></head><body><header>Site of things</header><div class="cookie-notice">We use the cookies of the site and you have to agree with it.</div>
    <main><article><h1>Head &amp; tail</h1><p>{good}</p><p>Short one.</p><form><label>Name</label></form><aside>Side note</aside><pre>a  b</pre><p>x<br>y &lt;z&gt;</p><script>var a = "<p>no</p>";</script></article>
    <section id="comments"><p>{good}</p></section></main><div class="sidebar">{good}</div><footer>&copy; all</footer></body></html>"""
    whole = " ".join(good.split())
    assert html_text.extract(page).split("\n") == ["Head & tail", whole, "Short one.", "a b", "x y <z>"]
    loose = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div>{good}</div><div>It is short</div><div>{good}</div><div class='ads'>Buy</div><div><a href=z>More of the same</a></div></body>"
    assert html_text.extract(loose).split("\n") == [whole, "It is short", whole]
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>a</nav>") == ""


# -- quality -----------------------------------------------------------------


def brute_model(texts):
    n, full = quality.ORDER, Counter()
    for t in texts:
        b = b"\0" * (n - 1) + t.encode()
        full.update(b[i : i + n] for i in range(len(b) - n + 1))
    levels = {n: full}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: quality.discounts(Counter(c.values())) for k, c in levels.items()}
    total, given = {}, {}
    for k, c in levels.items():
        for g, x in c.items():
            total[g[:-1], k] = total.get((g[:-1], k), 0) + x
            given[g[:-1], k] = given.get((g[:-1], k), 0) + cut[k][min(x, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, low = len(g), p(g[1:])
        if (g[:-1], k) not in total:
            return low
        x = levels[k].get(g, 0)
        return (x - cut[k][min(x, 3) - 1] if x else 0) / total[g[:-1], k] + given[g[:-1], k] / total[g[:-1], k] * low

    return p


@pytest.mark.parametrize("rows", [quality.SHARD_ROWS, 700])
def test_kneser_ney(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ROWS", rows)  # 700: the model in many shards
    common.ship(spark)
    texts = [t[:1500] for _, t in docs[:12]]
    p = brute_model(texts)
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    probe = [t[:300] for _, t in docs[10:16]] + ["", "zzzz éé", "\0\0"]
    rows = quality.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).collect()
    for r in rows:
        b = b"\0" * (quality.ORDER - 1) + probe[r.doc_id].encode()
        want = -sum(math.log(p(b[i : i + quality.ORDER])) for i in range(len(b) - quality.ORDER + 1))
        assert r.n_bytes == len(probe[r.doc_id].encode()) and abs(r.nll - want) < 1e-3 * max(1, want)
    assert abs(sum(p(b"the " + bytes([x])) for x in range(256)) - 1) < 1e-9


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in queries.op2_quality(spark, sf).collect()}
    labels = duckdb.connect().sql(f"select doc_id, quality from '{sf}/labels.parquet' where toxic = 0").fetchall()
    good, bad = [kept[i] for i, q in labels if q == 1], [kept[i] for i, q in labels if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.25


# -- duplicates --------------------------------------------------------------


def test_cover_tree_links():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        x = rng.normal(size=(n, 16))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.15, size=(n - n // 2, 16))
        y = np.concatenate([x[: n // 3 + 1] * 3 + rng.normal(scale=0.3, size=(n // 3 + 1, 16)), rng.normal(size=(5, 16))])
        cos = embed_dedup.unit(x) @ embed_dedup.unit(y).T
        i, j = embed_dedup.links(x, y, 0.98)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(cos >= 0.98))))
        own = embed_dedup.unit(x) @ embed_dedup.unit(x).T
        i, j = embed_dedup.links(x, None, 0.98)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*map(list, np.nonzero(own >= 0.98))) if a < b}


def test_cover_tree_is_one():
    """Nested levels, halving radii, covering radii that cover, all points once; also after packing."""
    rng = np.random.default_rng(2)
    x = embed_dedup.unit(np.concatenate([rng.normal(size=(150, 12)), np.repeat(rng.normal(size=(5, 12)), 20, 0) + rng.normal(scale=0.05, size=(100, 12))]))
    t = embed_dedup.CoverTree(x, 0.05)
    for tree in (t, embed_dedup.CoverTree.unpacked(x, t.packed())):
        assert sorted(np.concatenate(tree.points).tolist()) == list(range(250))
        held = [list(p) for p in tree.points]
        for level in range(len(tree.levels) - 1, -1, -1):
            centres, radii = tree.levels[level]
            assert level + 1 == len(tree.levels) or set(centres) <= set(tree.levels[level + 1][0])
            for c, r, own in zip(centres, radii, held):
                gaps = np.linalg.norm(x[own] - x[c], axis=1)
                assert gaps.max() <= r + 1e-6 and r <= 2.0 / 2**level + 1e-9 or level == 0
            if level:
                offsets = tree.children[level - 1]
                held = [sum(held[a:b], []) for a, b in zip(offsets, offsets[1:])]


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 12])
def test_embedding_components(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "LISTED", 3)
    rng = np.random.default_rng(8)
    common.ship(spark)
    base = rng.normal(size=(40, 8))
    v = np.float32(np.concatenate([base, base + rng.normal(scale=0.12, size=(40, 8)), base[:10], base[:10]]))
    lab = [int(k % 3) for k in range(100)]
    df = spark.createDataFrame([(k, v[k].tolist(), lab[k]) for k in range(100)], "vec_id long, embedding array<float>, label int")
    cos = embed_dedup.unit(v.astype(float)) @ embed_dedup.unit(v.astype(float)).T
    link = (cos >= 0.98) & (np.array(lab)[:, None] == np.array(lab)) & ~np.eye(100, dtype=bool)
    low = embed_dedup.forest(100, *np.nonzero(link))
    for r in embed_dedup.near_duplicates(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (link[r.vec_id].sum(), low[r.vec_id], low[r.vec_id] == r.vec_id)


def test_window_classes():
    rng = random.Random(6)
    for _ in range(50):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(70, 400)))
        raw = (raw + raw[10:60] + b"a" * 90)[:500]
        at = np.arange(len(raw) - 49)
        order, group = suffix_dedup.window_classes(np.frombuffer(raw + b"\0" * 8, np.uint8), at)
        held = [raw[at[i] : at[i] + 50] for i in order]
        assert [len({*x}) for x in (held, group.tolist())] == [len(set(held))] * 2
        assert all((held[k] == held[k + 1]) == (group[k] == group[k + 1]) for k in range(len(held) - 1))


def removed_by_brute_force(rows, length=50):
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, t in rows:
        b, end = (t or "").encode(), 0
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                lo, end = max(i, end), i + length
                gone[lo:end] = b"\1" * (end - lo)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_dedup(spark, docs):
    common.ship(spark)
    more = [(None, "x" * 200), (-1, "x" * 60), (-2, "x" * 300 + "é" * 100), (-2, "x" * 300), (-3, None), (-4, ""), (-5, "ab" * 200), (5_000_000, "ab" * 26 + "zz" + "ab" * 30), (5_000_001, "q" * 49), (5_000_002, "q" * 49)]
    rows = [*docs, *more]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in suffix_dedup.digest(suffix_dedup.dedup(df)).collect()), key=str)
    assert got == sorted((r[:5] for r in removed_by_brute_force(rows)), key=str)


def components_by_brute_force(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    forest = common.Forest(len(ids))
    for i, a in enumerate(ids):
        for j in range(i):
            x, y = sets[a], sets[ids[j]]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                forest.join(i, j)
    return {a: (len(sets[a]), ids[forest.find(i)]) for i, a in enumerate(ids)}


def test_jaccard(spark, docs):
    common.ship(spark)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    near = [(10_000 + k, " ".join(w if rng.random() > 0.02 else f"v{rng.randint(0, 9)}" for w in base)) for k in range(60)]
    rows = docs[:120] + near + [(20_000, " ".join(base).upper()), (20_001, "a b"), (20_002, "A\tb"), (20_003, "a  c"), (20_004, ""), (20_005, None)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = components_by_brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    forest, ids = common.Forest(1300), {x for a, b in edges if a != b for x in (a, b)}
    for a, b in edges:
        forest.join(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == forest.find(x) for x in ids)


def test_word_hashes():
    text = "Ab ab  é\n\x1cx ab".encode()
    h, first = words.hashed_words(np.frombuffer(text, np.uint8), np.array([0, 5, 5, len(text)]), words.space_class())
    assert first.tolist() == [0, 2, 2, 5] and h[0] == h[1] == h[4] and len(set(h.tolist())) == 3
    assert h[0] == words.word_hash("ab")


def test_word_hashes_across_spans(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc  \n") for _ in range(rng.choice([0, 1, 7, 40]))) for _ in range(60)] + ["a" * 50, "ab " * 30]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    h, first = words.hashed_words(raw, off, words.space_class())
    monkeypatch.setattr(words, "WINDOW", 8)
    words._powers.cache_clear()
    for span in (3, 16, 17, 1000):
        monkeypatch.setattr(words, "SPAN", span)
        h2, first2 = words.hashed_words(raw, off, words.space_class())
        assert (h == h2).all() and (first == first2).all()
    words._powers.cache_clear()
    whole = [w for t in texts for w in t.split()]
    assert len(h) == len(whole) and [words.word_hash(w) for w in whole] == h.tolist()
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]


# -- pipeline ----------------------------------------------------------------


def test_pipeline(spark, sf, docs):
    """Each stage on its own input against brute force; the classifier's decisions against its query."""
    steps = dict(corpus_pipeline.STAGES)
    whole = common.table(spark, sf, "documents")
    kept = steps["quality classifier"](spark, whole, sf).cache()
    assert kept.columns == whole.columns
    want = {r.doc_id for r in queries.op2_quality(spark, sf).collect() if r.kept}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == want
    one = common.materialise(steps["n-gram Jaccard join"](spark, kept, sf), "test")
    groups = components_by_brute_force(list(texts.items()))
    left = {r.doc_id: r.text for r in one.collect()}
    assert set(left) == {i for i, (_, c) in groups.items() if c == i}
    cut = {r.doc_id: r for r in steps["suffix-array dedup"](spark, one, sf).collect()}
    for d, n, gone, _, _, rest in removed_by_brute_force(list(left.items())):
        rest = rest.decode("utf-8", "ignore")
        assert (cut[d].text, cut[d].n_chars) == (rest, len(rest)) if not gone or rest.strip() else d not in cut
    e = tokens.encoder(vocabulary())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in rows) == sum(len(e.whole(r.text or "")) // 4 + 1 for r in cut.values())
