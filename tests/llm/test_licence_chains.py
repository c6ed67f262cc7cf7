"""Licence notices whose words several templates share, and texts with several notices."""

import random

from pagelight.llm import licenses

BY = "This work is licensed under a Creative Commons Attribution 4.0 International License"


def spans(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, [(x.label, x.first_word, x.last_word) for x in r.spans]) for r in sorted(licenses.scan_licenses(df).collect(), key=lambda r: r.doc_id)]


def test_a_template_keeps_runs_that_another_goes_on_with(spark):
    by = BY.replace("under a", "under the")
    nc, sa = (by.replace("Attribution", f"Attribution-{x}") for x in ("NonCommercial", "ShareAlike"))
    assert spans(spark, by, nc, sa, BY) == [("cc-by", [("cc-by", 0, 12)]), ("cc-by-nc", [("cc-by-nc", 0, 13)]), ("cc-by-sa", [("cc-by-sa", 0, 13)]), ("cc-by", [("cc-by", 0, 12)])]


def test_all_notices_of_a_text(spark):
    far, near = " and so on" * 20 + " ", " "
    for between in (far, near):
        gap = 13 + len(between.split())
        got = spans(spark, between.join([BY, BY.replace("under a", "under the"), BY]))[0]
        assert got == ("cc-by", [("cc-by", k * gap, k * gap + 12) for k in range(3)])
    many = spans(spark, ". ".join(["Released under the MIT License"] * 3000))[0][1]
    assert many == [("mit", 5 * k, 5 * k + 4) for k in range(3000)]


def test_templates_whole_have_their_own_label(spark):
    all_ = [(label, t) for label, texts in licenses.TEMPLATES.items() for t in texts]
    for (label, t), (labels, got) in zip(all_, spans(spark, *(t for _, t in all_))):
        assert got == [(label, 0, len(licenses.split(t)) - 1)] and label in labels.split(",")


def test_runs_are_each_template_s_own():
    s = licenses.Scanner({"a b": "x"}, {"y": ["a b c d e", "c d a b c"], "z": ["d e a b"]})
    number = {w: k + 1 for k, w in enumerate("abcde")}
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abcde") for _ in range(14))
        runs: list = []
        s.scan([number[c] for c in text], 0, runs)
        want = set()
        for k, sequence in enumerate(["ab", "abcde", "cdabc", "deab"]):
            for i in range(14):
                for p in range(len(sequence)) if k else ():
                    n = 0
                    while n <= min(i, p) and text[i - n] == sequence[p - n]:
                        n += 1
                    if n >= licenses.MIN_MATCH and (i == 13 or p + 1 == len(sequence) or text[i + 1] != sequence[p + 1]):
                        want.add((i, p, n, k))
        assert len(runs) == len(set(runs)) and set(runs) == want
