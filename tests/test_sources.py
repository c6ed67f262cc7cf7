"""Document folders with broken and odd files against a plain walk; sinks; the model seam."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pagelight.operators import rerank as K
from pagelight.sources import readers as S
from pagelight.sources import sidecars as C


def plain_text(v):
    if isinstance(v, list):
        return "\n".join(x for x in map(plain_text, v) if x)
    if isinstance(v, dict):
        keys = [k for k in ("text", "content", "caption", "table_text", "ocr_text") if k in v]
        return "\n".join(x for x in ([plain_text(v[k]) for k in keys] if keys else [f"{k}: {plain_text(x)}" for k, x in v.items()]) if x)
    return "" if v is None else str(v).strip()


def plain_rows(path):
    body = json.loads(path.read_text(encoding="utf-8"))
    if isinstance(body, dict):
        body = next(body[k] for k in ("pages", "records", "data") if isinstance(body.get(k), list))
    if not isinstance(body, list):
        raise ValueError(path)
    return [r for r in body if isinstance(r, dict)]


def paged(rows):
    for r in rows:
        try:
            yield int(r.get("page")), r
        except (TypeError, ValueError):
            pass


def field_text(row, field):
    return next((plain_text(row[k]) for k in C.FIELD_KEYS[field] if k in row and plain_text(row[k])), "")


def plain_sidecar(folder, field):
    for name in C.SIDE_FILES[field]:
        try:
            rows = plain_rows(folder / name)
        except Exception:
            continue
        found = {}
        for page, r in paged(rows):
            text = field_text(r, field) or plain_text(r)
            if text:
                found[page] = text
        return found
    return {}


def plain_evidence(root, fields):
    out = []
    for folder in root.iterdir():
        inner = folder / "extracted"
        first = next((inner / f for f in C.PAGE_FILES if (inner / f).exists()), None)
        if not folder.name.isdigit() or first is None:
            continue
        try:
            rows = plain_rows(first)
        except Exception:
            continue
        side = {f: plain_sidecar(inner, f) for f in fields if f != "page_text"}
        for page, r in paged(rows):
            blocks = [(f, field_text(r, f) or side.get(f, {}).get(page, "")) for f in fields]
            if any(t for _, t in blocks):
                out.append((int(folder.name), page, "\n\n".join(f"[{f.upper()}]\n{t}" for f, t in blocks if t), tuple(f for f, t in blocks if t)))
    return sorted(out)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    rng = random.Random(6)
    top = tmp_path_factory.mktemp("docs")
    keys = [k for names in C.FIELD_KEYS.values() for k in names] + ["content", "note"]
    value = lambda depth=0: rng.choice([None, "", "  a b ", "x\ny", 3, 2.5, True, "😀 é", *([[value(depth + 1), value(depth + 1)], {"text": value(depth + 1)}, {"k": value(depth + 1), "caption": value(depth + 1)}, {}] if depth < 2 else [])])
    page = lambda: rng.choice([1, 2, 3, "2", " 3 ", 1.9, "x", None, True, "2.0"])
    row = lambda: {"page": page()} | {k: value() for k in rng.sample(keys, rng.randint(0, 4))}

    def body():
        rows = [rng.choice([row(), row(), row(), "text", 5]) for _ in range(rng.randint(0, 6))]
        return rng.choice([json.dumps(rows), json.dumps({rng.choice(["pages", "records", "data"]): rows, "pages_": 1}), json.dumps({"pages": 3, "data": rows}), "{broken", json.dumps({"other": rows}), json.dumps("text"), ""])

    for k in [*range(40), "named"]:
        inner = top / str(k) / "extracted"
        inner.mkdir(parents=True)
        for name in [*C.PAGE_FILES, *[f for names in C.SIDE_FILES.values() for f in names]]:
            if rng.random() < 0.5:
                (inner / name).write_text(body(), encoding="utf-8")
    (top / "3" / "extracted" / "pages_ocr.json").write_bytes(b'[{"page": 1, "ocr": "\xff\xfe"}]')
    return top


@pytest.mark.parametrize("field", list(C.SIDE_FILES))
def test_sidecars(spark, root, field):
    got = {(r.folder, r.page): r.text for r in C.sidecar_texts(spark, str(root), field).collect()}
    want = {(int(f.name), p): t for f in root.iterdir() if f.name.isdigit() for p, t in plain_sidecar(f / "extracted", field).items()}
    assert got == want and len(got) > 5


@pytest.mark.parametrize("fields", [["page_text"], ["ocr", "page_text", "caption", "table_text"], ["tables", "ocr_text"]])
def test_page_evidence(spark, root, fields):
    from pagelight.operators.evidence import normalise_fields

    got = sorted((r.folder, r.page, r.text, tuple(r.available_fields)) for r in C.page_evidence(spark, str(root), fields).collect())
    assert got == plain_evidence(root, normalise_fields(fields)) and len(got) > 3


def test_no_files(spark, tmp_path):
    assert C.sidecar_texts(spark, str(tmp_path), "ocr").collect() == [] and C.page_evidence(spark, str(tmp_path)).collect() == []


def test_page_records_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "page int, text string")
    S.write_pages(df, str(tmp_path / "pages"))
    assert sorted(S.read_records(spark, str(tmp_path / "pages"), "page int, text string").collect()) == sorted(df.collect())
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "one.txt").write_text(" first\nfile ")
    (tmp_path / "t" / "sub" / "two.txt").write_text("second")
    (tmp_path / "t" / "no.md").write_text("left out")
    assert {r.text for r in S.texts(spark, str(tmp_path / "t"), "folder").collect()} == {"first\nfile", "second"}


def test_metrics_as_tables(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), ("c\nd", None)], "name string, f1 double").coalesce(1)
    for kind in ("json", "csv", "markdown"):
        S.write_metrics(df, str(tmp_path / kind), kind)
    assert {tuple(r) for r in S.metric_csv(spark, str(tmp_path / "csv"), ["f1"]).where("name like 'a%'").collect()} == {("a|b", 0.5)}
    lines = [x for part in ("0-head", "1-rows") for f in sorted((tmp_path / "markdown" / part).glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["| name | f1 |", "| --- | --- |", "| a\\|b | 0.5 |", "| c d |  |"]


def test_predictions_and_what_is_left(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "query_id long, generated string")
    errors = spark.createDataFrame([(1, []), (2, ["empty_answer"])], "query_id long, errors array<string>")
    assert S.write_predictions(df, str(tmp_path / "p"), errors) == {"rows": 2, "invalid": 1}
    done = S.predictions(spark, str(tmp_path / "p" / "rows"), "query_id long, generated string")
    assert {r.query_id for r in done.collect()} == {1, 3}
    assert [r.query_id for r in S.unfinished(df, done).collect()] == [2]
    assert tuple(spark.read.json(str(tmp_path / "p" / "log")).select("rows", "invalid").first()) == (2, 1)


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    seen = str(tmp_path)

    def load():
        open(os.path.join(seen, f"load-{os.getpid()}"), "a").write("x")

        class Model:
            def predict(self, pairs):
                sizes = [len(q) + len(t) for q, t in pairs]
                open(os.path.join(seen, f"batches-{os.getpid()}"), "a").write(f"{min(sizes)} {max(sizes)} {len(sizes)}\n")
                return [None if "unreadable" in t else float(len(t)) for _, t in pairs]

        return Model()

    K.register("made", K.model_scorer("made", load, 8))
    try:
        rng = random.Random(1)
        rows = [(k % 5, "q", k, "unreadable" if k % 10 == 3 else None if k == 4 else "w" * rng.randint(1, 60)) for k in range(200)]
        df = spark.createDataFrame(rows, "query_id int, question string, rank int, text string").repartition(6)
        out = K.rerank(df, "made", drop_unscored=True).collect()
        assert len(out) == 180 and all(r.rerank_score == len(r.text or "") for r in out)
        assert K.rerank(df, "made").where("rerank_score is null").count() == 20
        for q in range(5):
            mine = sorted((r.rerank_rank, -r.rerank_score, r["rank"]) for r in out if r.query_id == q)
            assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        loads = [f for f in os.listdir(seen) if f.startswith("load-")]
        assert loads and all(os.path.getsize(os.path.join(seen, f)) == 1 for f in loads)
        batches = [tuple(map(int, x.split())) for f in os.listdir(seen) if f.startswith("batches-") for x in open(os.path.join(seen, f))]
        assert max(n for *_, n in batches) == 8 and sum(hi - lo for lo, hi, _ in batches) / len(batches) < 30
        assert K.rerank(df.limit(0), "made").collect() == []
    finally:
        K.SCORERS.pop("made")
