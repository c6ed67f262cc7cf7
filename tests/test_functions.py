"""Rules of the text, number, unit and entity functions, and order-dependent ones against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pagelight.functions import intent as I
from pagelight.functions import numbers as N
from pagelight.functions import text as T
from pagelight.operators import answer_metrics as M


def rows(spark, pairs):
    return spark.createDataFrame([(i, g, e) for i, (g, e) in enumerate(pairs)], "i int, generated string, expected string")


@pytest.mark.parametrize(
    ("generated", "expected", "metric", "value"),
    [
        ("2.230.", "2.23", "numeric_exact_match", 1.0),
        ("28.65%.", "28.7%", "numeric_relaxed_match", 1.0),
        ("153 stores", "152 stores", "numeric_relaxed_match", 0.0),
        ("$5,490 million", "5,490 million USD", "unit_match", 1.0),
        ("The owner is Acme Holdings Ltd, a bank.", "Acme Bank Ltd", "entity_match", 1.0),
        ("anything", "no figures", "numeric_exact_match", None),
        ("anything", "no figures", "unit_match", None),
        ("", "Acme", "entity_match", 0.0),
        ("5", "", "entity_match", None),
    ],
)
def test_extended(spark, generated, expected, metric, value):
    assert M.extended_metrics(rows(spark, [(generated, expected)])).first()[metric] == value


def test_empty_rules(spark):
    out = [r.asDict() for r in M.row_metrics(rows(spark, [("", ""), ("7", ""), ("", "7"), (None, None), ("a 7 7", "7")])).orderBy("i").collect()]
    assert [r["numeric_any_match"] for r in out] == [0, 0, 0, 0, 1]
    assert [r["numeric_all_recall"] for r in out] == [1, 0, 0, 1, 1]
    assert [r["numeric_precision"] for r in out] == [1, 0, 0, 1, 0.5]
    assert [r["answer_contains_expected"] for r in out] == [0, 0, 0, 0, 1]


def test_greedy_match(spark):
    rng = random.Random(5)

    def text():
        return " and ".join(rng.choice(["10", "10.05", "10.1", "9.95", "10%", "10.05%", "11"]) for _ in range(rng.randint(0, 4)))

    pairs = [(text(), text()) for _ in range(300)]

    def value(t):
        return [(float(x.rstrip("%")), "." not in x, x.endswith("%")) for x in t.split(" and ") if x]

    def close(g, e):
        if g[2] or e[2]:
            return abs(g[0] - e[0]) <= 0.1
        return g[0] == e[0] if e[1] else abs(g[0] - e[0]) / abs(e[0]) <= 0.01

    def greedy(g, e):
        left = value(g)
        for x in value(e):
            at = next((k for k, y in enumerate(left) if close(y, x)), None)
            if at is None:
                return 0.0
            left.pop(at)
        return 1.0 if value(e) else None

    got = [r.numeric_relaxed_match for r in M.extended_metrics(rows(spark, pairs)).orderBy("i").collect()]
    assert got == [greedy(g, e) for g, e in pairs]


def test_mentions(spark):
    out = M.mention_metrics(rows(spark, [("$5 million and 10%", "5 million"), ("", "Acme Ltd"), ("acme", "Acme Ltd"), ("3 tokens", "3 token")])).orderBy("i").collect()
    assert out[0].all_numbers_exact is True and out[0].mention_unit_match == 1.0
    assert out[1].plain_entity_match is True  # an empty text is contained in any
    assert out[2].plain_entity_match is True and out[2].all_numbers_exact is None
    assert out[3].mention_unit_match == 1.0


def test_normalisers(spark):
    df = spark.createDataFrame([("1,234,567 – CO2-e", "x Answer: 'Yes'.", "why\nAnswer: 4")], "a string, b string, c string")
    r = df.select(T.oracle_text(F.col("a")).alias("o"), T.answer_b(F.col("a")).alias("m"), T.final_answer(F.col("b")).alias("f"), T.reasoning(F.col("c")).alias("r"), T.final_answer(F.lit("")).alias("e"), T.joined(F.array(F.lit("p"), F.lit(" "), F.lit(None).cast("string"), F.lit("q"))).alias("j")).first()
    assert (r.o, r.m, r.f, r.r, r.e, r.j) == ("1234,567 - co2-e", "1234567 - co2e", "Yes'.", "why", "NOT FOUND", "p\nq")
    assert df.select(T.nfkc(F.lit("ﬁ½")).alias("n")).first().n == "fi1⁄2"


def test_intent(spark):
    df = spark.createDataFrame([("See Fig. 3B now", "t"), ("the table and the chart", "multimodal-f"), ("rows", None), (None, None)], "q string, t string")
    out = df.select(I.reference(F.col("q")).alias("r"), I.crop_intent(F.col("q")).alias("i"), I.target_type(F.col("q"), F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in out] == [("figure 3b", "visual", "figure"), (None, "unknown", "table"), (None, "unknown", "text"), (None, "unknown", "text")]
    assert N.MENTION_ALIASES["percent"] == "%"


def test_similarity_stop_words(spark):
    """Yes and no are words, not stop words."""
    rows = spark.createDataFrame([("Yes", "Yes"), ("no", "No"), ("NOT FOUND", "NOT FOUND"), ("what this", "what that")], "g string, e string")
    out = [tuple(r.s) for r in rows.select(M.similarity(F.col("g"), F.col("e")).alias("s")).collect()]
    assert out == [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.5)]


def test_bm25_tokens_by_the_plain_rule(spark):
    import random
    import re

    rng = random.Random(11)
    texts = ["".join(rng.choice("abZ09._+-é \nKKİ") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "a", "a.b", "A-", "x y", "__a1"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", T.bm25_tokens(F.col("t")).alias("tokens")).collect():
        assert r.tokens == [x.lower() for x in re.findall(r"[a-zA-Z0-9]+(?:[._+\-][a-zA-Z0-9]+)*", texts[r.k] or "") if len(x) > 1]
