"""Crops, sources, streams and small rules that SQL doesn't check."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from pagelight.operators import answer_metrics as M
from pagelight.operators import layout as L
from pagelight.operators import ranking as R
from pagelight.plans import report as P
from pagelight.sources import readers as S
from pagelight.streaming import metrics as W


def test_crop_rules(spark):
    rows = [
        (1, "What is in Table 3?", "t", 0, "table", 0.5, "Table 3: cells", 1),
        (1, "What is in Table 3?", "t", 1, "table", 0.9, "Table 4: cells", 1),
        (1, "What is in Table 3?", "t", 2, "figure", 0.9, "Table 3: cells", 1),
        (2, "Who is it", "t", 0, "text", 0.2, "nothing", 1),
    ]
    df = spark.createDataFrame(rows, "query_id int, question string, qtype string, region int, crop_type string, confidence double, ocr_text string, page_rank int")
    scored = L.score_v2(df)
    by = {(r.query_id, r.region): r for r in scored.collect()}
    assert by[1, 1].score is None and by[1, 2].score is None  # another caption; another type
    assert by[1, 0].caption_match and abs(by[1, 0].score - (0.5 + 1.5 + 1.5 / 2 + 5 + 2 + 0.4)) < 1e-9
    chosen = {r.query_id: r for r in L.select_crop(scored).collect()}
    assert chosen[1].region == 0 and chosen[2].region is None and chosen[2].fallback == "none"


def test_windows():
    assert L.windows(100, 100, 2, 2, 0.2)[0] == (0, 0, 55, 55)


def test_pareto_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(6)]), rng.choice([None, *range(6)])) for i in range(200)]
    df = spark.createDataFrame([(i, None if q is None else float(q), None if c is None else float(c)) for i, q, c in rows], "id int, q double, c double")
    full = [(i, -1 if q is None else q, 999999 if c is None else c) for i, q, c in rows]
    keep = {i for i, q, c in full if not any(a >= q and b <= c and (a > q or b < c) for _, a, b in full)}
    assert {r.id for r in P.pareto(df, "q", "c", "id").collect()} == keep


def test_min_max_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0), (2, float("nan")), (2, float("inf")), (3, None)], "query_id int, s double")
    out = sorted((r.query_id, r.x) for r in df.select("query_id", R.min_max(F.col("s")).alias("x")).collect())
    assert out == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0), (2, 0.0), (2, 1.0), (3, 0.0)]


def test_enrich_keeps_what_is_there(spark):
    df = spark.createDataFrame([("a 7", "7", None)], "generated string, expected string, numeric_recall double")
    r = M.enrich(df).first()
    assert r.numeric_recall is None and r.f1 == r.token_f1 and r.numeric_all_recall == 1.0


def test_sources(spark, tmp_path):
    qa = tmp_path / "12"
    qa.mkdir()
    (qa / "12_qa.jsonl").write_text('{"question": "q1", "answer": "a", "type": "text-only"}\n\n{"question": "q2", "answer": "b", "type": "meta-data", "evidence": "e"}\n')
    (qa / "doc_report.json").write_text('{"domain": null}')
    assert {(r.folder, r.question, r.evidence) for r in S.questions(spark, str(tmp_path)).collect()} == {("12", "q1", None), ("12", "q2", "e")}
    assert S.questions(spark, str(tmp_path), ["meta-data"]).count() == 1
    assert S.domains(spark, str(tmp_path)).first().domain == "unknown"
    for name, body in (("list", [{"page": 1, "text": "x"}, {"text": "no page"}]), ("wrapped", {"records": [{"page": 2, "text": "y"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert [r.page for r in S.page_rows(spark, str(tmp_path / f"{name}.json")).collect()] == [1 if name == "list" else 2]
    (tmp_path / "m.csv").write_text("name,f1\nx,0.5\ny,bad\n")
    assert [r.f1 for r in S.metric_csv(spark, str(tmp_path / "m.csv"), ["f1"]).orderBy("name").collect()] == [0.5, None]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "c0"}, {"context": "c1"}]}]}))
    assert [r.id for r in S.squad(spark, str(tmp_path / "s.json"), "train").collect()] == ["squad_train_0_0", "squad_train_0_1"]


def test_index(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id int, vec array<double>")
    S.write_index(good, str(tmp_path / "i"))
    assert S.read_index(spark, str(tmp_path / "i"), good).count() == 2
    for bad in (good.unionByName(spark.createDataFrame([(3, [1.0])], "id int, vec array<double>")), good.withColumn("vec", F.when(F.col("id") == 1, F.col("vec")))):
        try:
            S.write_index(bad, str(tmp_path / "j"))
            raise AssertionError("a bad index was written")
        except ValueError:
            pass


def test_tables_as_text(spark):
    df = spark.createDataFrame([("a|b", 1.5), (None, 2.0)], "x string, y double")
    assert P.markdown(df, ["x", "y"]).splitlines()[2] == "| a\\|b | 1.5 |"
    assert P.delimited(df, ["x", "y"], "\t").splitlines()[0] == "x\ty"


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = W.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windowed_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("windowed_out").collect())) == sorted(map(str, W.windowed(events).collect()))
