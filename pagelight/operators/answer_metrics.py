"""Metrics of one answer against the expected one, and labels of what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

SENTINELS = ("NOT FOUND", "ERROR", "TIMEOUT")
# Stop words of the second answer form.
SIMILARITY_STOP = "the a an and or but in on at to for of with by from as is was are were been has have had does do did will would should could may might can answer question".split()


def _f1(both: Column, a: Column, b: Column) -> Column:
    p, r = F.coalesce(F.try_divide(both, a), F.lit(0.0)), F.coalesce(F.try_divide(both, b), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _words(x: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(T.found(x, r"[a-z][a-z0-9_\-]*"), lambda t: (F.length(t) > 2) & ~F.array_contains(T.words(*stop), t)))


def _digits(x: Column) -> Column:
    return T.found(x, r"\d+(?:\.\d+)?%?")


def _token_score(generated: Column, gw: Column, ew: Column, gn: Column, en: Column) -> Column:
    """MET1 of word sets and numbers."""
    word = _f1(F.size(F.array_intersect(gw, ew)), F.size(gw), F.size(ew))
    number = _f1(F.size(F.array_intersect(gn, en)), F.size(gn), F.size(en))
    score = F.when(F.size(en) > 0, 0.4 * word + 0.6 * number).otherwise(word)
    return F.when(T.text_of(generated).isin(*SENTINELS), 0.0).otherwise(F.round(score, 9))


def token_f1(generated: Column, expected: Column, form=T.answer_a, stop: list[str] = T.ANSWER_STOP) -> Column:
    """MET1: word sets, and numbers whose overlap counts distinct ones while lengths count repeats;
    0.4 word + 0.6 number score if numbers are expected. Sentinel answers score 0.

    MET2's score is the same with form answer_b and the longer stop list."""
    g, e = form(generated), form(expected)
    return _token_score(generated, _words(g, stop), _words(e, stop), _digits(g), _digits(e))


def exact(generated: Column, expected: Column, form=T.answer_a) -> Column:
    return (T.exact_form(form(generated)) == T.exact_form(form(expected))).cast("double")


def similarity(generated: Column, expected: Column, form=T.answer_b) -> Column:
    """MET2: struct(exact, f1) over the second answer form (or the first, by `form`); sentinels score (0, 0)."""
    bad = T.text_of(generated).isin(*SENTINELS)
    return F.struct(F.when(bad, 0.0).otherwise(exact(generated, expected, form)).alias("exact"), token_f1(generated, expected, form, SIMILARITY_STOP).alias("f1"))


def matched(a: Column, b: Column) -> Column:
    """How many elements of a multiset are in another, by counts."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v)))


def row_metrics(df: DataFrame, generated: str = "generated", expected: str = "expected") -> DataFrame:
    """MET3: df and eight metrics. Without expected numbers: any match 0; recalls and precision 1 if none are generated."""
    gc, ec = F.col(generated), F.col(expected)
    # each form is a projection of its own, used by several metrics and so not folded into them
    out = df.withColumns({"_ga": T.answer_a(gc), "_ea": T.answer_a(ec), "_g": N.numbers_a(gc), "_e": N.numbers_a(ec)})
    forms = {"w": lambda x: _words(x, T.ANSWER_STOP), "d": _digits, "c": T.compact, "x": T.exact_form}
    out = out.withColumns({f"_{side}{name}": f(F.col(f"_{side}a")) for name, f in forms.items() for side in "ge"}).withColumn("_m", matched(F.col("_e"), F.col("_g")))
    ng, ne, m = F.size("_g"), F.size("_e"), F.col("_m")
    out = out.withColumns({
        "exact_match": (F.col("_gx") == F.col("_ex")).cast("double"),
        "token_f1": _token_score(gc, F.col("_gw"), F.col("_ew"), F.col("_gd"), F.col("_ed")),
        "relaxed_exact": (F.col("_gc") == F.col("_ec")).cast("double"),
        "answer_contains_expected": ((F.col("_ec") != "") & F.contains("_gc", "_ec")).cast("double"),
        "expected_contains_answer": ((F.col("_gc") != "") & F.contains("_ec", "_gc")).cast("double"),
        "numeric_any_match": F.arrays_overlap("_e", "_g").cast("double"),
        "numeric_all_recall": F.when(ne > 0, (m == ne).cast("double")).otherwise((ng == 0).cast("double")),
        "numeric_precision": F.round(F.when(ng > 0, m / F.greatest(ng, F.lit(1))).otherwise((ne == 0).cast("double")), 9),
        "numeric_recall": F.round(F.when(ne > 0, m / F.greatest(ne, F.lit(1))).otherwise((ng == 0).cast("double")), 9),
    })
    return out.drop("_m", *[f"_{side}{name}" for side in "ge" for name in ("", "a", "w", "d", "c", "x")])


def extended_metrics(df: DataFrame, generated: str = "generated", expected: str = "expected") -> DataFrame:
    """df and numeric_exact_match, numeric_relaxed_match, unit_match, entity_match; null where nothing is expected."""
    gc, ec = F.col(generated), F.col(expected)
    gt, et = F.col("_gt"), F.col("_et")
    out = df.withColumns({"_gt": T.metric_text(gc), "_et": T.metric_text(ec)})
    out = out.withColumns({"_g": N.numeric_values(gc), "_e": N.numeric_values(ec), "_gu": N.units(gc, gt), "_eu": N.units(ec, et), "_gn": N.entity_tokens(gc, gt), "_en": N.entity_tokens(ec, et)})
    plain = lambda c: F.transform(c, lambda v: v["normalized"])
    out = out.withColumns({
        "numeric_exact_match": N.multiset_exact(plain("_g"), plain("_e")),
        "numeric_relaxed_match": N.relaxed_match(F.col("_g"), F.col("_e")),
        "unit_match": N.subset(F.col("_eu"), F.col("_gu")),
        "entity_match": N.entity_match(F.col("_gn"), F.col("_en")),
    })
    return out.drop("_gt", "_et", "_g", "_e", "_gu", "_eu", "_gn", "_en")


def mention_metrics(df: DataFrame, generated: str = "generated", expected: str = "expected") -> DataFrame:
    """MET5: every expected mention matched exactly or nearly, mention units, plain entity match."""
    gc, ec = F.col(generated), F.col(expected)
    out = df.withColumns({"_g": N.mentions(gc), "_e": N.mentions(ec)})
    kinds = lambda c: F.array_distinct(F.filter(F.transform(c, lambda v: v["unit"]), lambda u: u != ""))
    out = out.withColumns({
        "all_numbers_exact": N.all_mentioned(F.col("_g"), F.col("_e"), False),
        "all_numbers_relaxed": N.all_mentioned(F.col("_g"), F.col("_e"), True),
        "mention_unit_match": N.subset(kinds("_e"), kinds("_g")),
        "plain_entity_match": N.entity_match_plain(gc, ec),
    })
    return out.drop("_g", "_e")


def enrich(df: DataFrame) -> DataFrame:
    """MET4: fill what is absent; a column that is there keeps its nulls."""
    have = set(df.columns)
    out = row_metrics(df.select(*[F.col(c).alias(f"_own_{c}") if c not in ("generated", "expected") else F.col(c) for c in df.columns]))
    new = [c for c in out.columns if not c.startswith("_own_") and c not in ("generated", "expected") and c not in have]
    own = [F.col(f"_own_{c}").alias(c) if c not in ("generated", "expected") else F.col(c) for c in df.columns]
    extra = [] if "f1" in have else [F.col("token_f1").alias("f1")]
    return out.select(*own, *new, *extra)


def suspected_error(df: DataFrame) -> Column:
    """MET6: the first rule that holds; '' for answers with f1 >= 0.5. Columns that df lacks count as null."""
    col = lambda name, kind="string": F.col(name) if name in df.columns else F.lit(None).cast(kind)
    g = T.strip(T.text_of(col("generated")))
    table = lambda c: F.when(c, "wrong_table").otherwise("visual_reading_error")
    return (
        F.when(g == "NOT FOUND", "not_found")
        .when(F.coalesce(col("f1", "double"), F.lit(0.0)) >= 0.5, "")
        .when(F.coalesce(col("crop_type_mismatch", "boolean"), F.lit(False)), table(col("question_crop_intent") == "table"))
        .when((col("caption_match", "boolean") == F.lit(False)) & (T.text_of(col("explicit_reference")) != ""), table(F.contains(T.text_of(col("explicit_reference")), F.lit("table"))))
        .when((col("numeric_any_match", "double") == 0) & T.text_of(col("expected")).rlike("[0-9]"), "wrong_row_or_column")
        .when((g != "") & (g != "ERROR"), "formatting_issue")
        .otherwise("wrong_page")
    )


def f1_bin(c: Column) -> Column:
    """MET8: six bins."""
    return F.when(c <= 0, "0").when(c < 0.25, "0-0.25").when(c < 0.5, "0.25-0.5").when(c < 0.75, "0.5-0.75").when(c < 1, "0.75-1").otherwise("1")


def error_labels(f1: Column, generated: Column, numeric_recall: Column, contains: Column) -> Column:
    """MET8: all labels that hold."""
    g = T.strip(T.text_of(generated))
    return F.array_compact(F.array(F.when(g == "", "empty"), F.when(g.isin(*SENTINELS), "refused"), F.when(f1 < 0.5, "low_f1"), F.when(numeric_recall < 1, "missing_number"), F.when((contains == 1) & (f1 < 0.5), "verbose"), F.when(f1 >= 0.9, "good")))


def failure_mode(f1: Column, generated: Column, doc_hit: Column, page_hit: Column, numeric_recall: Column, contains: Column) -> Column:
    """MET7: the first mode that holds, from retrieval to wording."""
    g = T.strip(T.text_of(generated))
    return (
        F.when(f1 >= 0.9, "correct")
        .when(g == "ERROR", "generation_error")
        .when(g == "TIMEOUT", "timeout")
        .when(g == "", "empty_answer")
        .when((g == "NOT FOUND") & (page_hit == 1), "missed_evidence")
        .when(g == "NOT FOUND", "not_found")
        .when(doc_hit == 0, "wrong_document")
        .when(page_hit == 0, "wrong_page")
        .when((contains == 1) & (f1 < 0.5), "over_generation")
        .when(numeric_recall == 0, "wrong_number")
        .when(numeric_recall < 1, "partial_number")
        .when(f1 >= 0.5, "partially_correct")
        .when(f1 > 0, "low_overlap")
        .otherwise("unrelated")
    )


def row_errors(c: dict[str, Column]) -> Column:
    """PRD13: what keeps a result row from counting: array of names, empty for valid rows."""
    blank = T.strip(T.text_of(c["generated"])) == ""
    return F.array_compact(F.array(F.when(c["error"].isNotNull(), "runtime_error"), F.when(F.coalesce(c["n_pages"], F.lit(0)) == 0, "no_pages"), F.when(blank, "empty_answer"), F.when(c["latency"].isNull(), "no_latency"), F.when(c["f1"].isNull(), "no_f1")))
