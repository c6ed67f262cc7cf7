"""Layout crops: boxes, scores and the choice of a crop for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as T
from .evidence import crop_caption


def quarters(width: Column, height: Column) -> Column:
    """IMG1: the four quarters of a page as boxes [left, top, right, bottom]."""
    w, h = (F.floor(width / 2)).cast("int"), (F.floor(height / 2)).cast("int")
    z = F.lit(0)
    return F.array(F.array(z, z, w, h), F.array(w, z, width, h), F.array(z, h, w, height), F.array(w, h, width, height))


def windows(width: int, height: int, columns: int, rows: int, overlap: float) -> list[tuple[int, int, int, int]]:
    """IMG1: overlapping windows of a grid, clipped to the page."""
    w, h = width / columns, height / rows
    dx, dy = w * overlap / 2, h * overlap / 2
    return [(max(0, int(c * w - dx)), max(0, int(r * h - dy)), min(width, int((c + 1) * w + dx)), min(height, int((r + 1) * h + dy))) for r in range(rows) for c in range(columns)]


def similarity(a: Column, b: Column) -> Column:
    """IMG9: Jaccard of layout tokens; 0 if either has none."""
    x, y = T.layout_tokens(a), T.layout_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(T.jaccard(x, y))


def _has(c: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(T.layout_tokens(c), T.words(*terms))


def score_v1(df: DataFrame) -> DataFrame:
    """IMG6: regions (question, qtype, crop_type, confidence, ocr_text) and their additive score."""
    q, t, ocr = F.col("question"), F.col("crop_type"), F.col("ocr_text")
    target, ref = I.target_type(q, F.col("qtype")), I.reference(q)
    score = F.col("confidence") + F.when(target == t, 1.0).otherwise(0.0)
    score += F.when((target == "figure") & t.isin("figure", "text"), 0.25).otherwise(0.0) + F.when((target == "table") & (t == "text"), 0.15).otherwise(0.0)
    score += 2.0 * similarity(q, ocr) + F.when(ref.isNotNull() & F.contains(T.collapse(F.lower(T.text_of(ocr))), ref), 2.5).otherwise(0.0)
    score += F.when(_has(q, I.LAYOUT_TABLE) & (t == "table"), 0.5).otherwise(0.0) + F.when(_has(q, I.LAYOUT_VISUAL) & (t == "figure"), 0.5).otherwise(0.0)
    return df.withColumn("score", F.round(score, 9))


def allowed(intent: Column, kind: Column) -> Column:
    """PRD15: whether a crop's type fits the intent."""
    return F.when(intent == "visual", kind == "figure").when(intent == "table", kind == "table").otherwise(kind.isin("table", "figure", "text"))


def score_v2(df: DataFrame) -> DataFrame:
    """IMG7: as score_v1 with page ranks and captions; null for rejected regions. Adds intent, caption, caption_match."""
    q, t = F.col("question"), F.col("crop_type")
    out = df.withColumns({"intent": I.crop_intent(q), "reference": I.reference(q), "caption": crop_caption(F.col("ocr_text"), t)})
    found, ref, intent = I.reference(F.col("caption")), F.col("reference"), F.col("intent")
    match = F.coalesce((F.col("caption") != "") & (found == ref), F.lit(False))
    conflict = F.coalesce(ref.isNotNull() & (F.col("caption") != "") & (found != ref), F.lit(False))
    score = F.col("confidence") + F.when(intent != "unknown", 1.5).when(I.numeric_table_heavy(q) & (t == "table"), 0.7).otherwise(0.0)
    score += -0.18 * F.greatest(F.lit(0), F.col("page_rank") - 1) + 1.5 * similarity(q, F.col("ocr_text"))
    score += F.when(match, 5.0).when(ref.isNotNull() & (F.col("caption") != ""), -2.0).when(ref.isNotNull(), -0.75).otherwise(0.0)
    score += F.when(ref.isNotNull() & (F.col("page_rank") == 1) & match, 2.0).otherwise(0.0)
    score += F.when(_has(q, I.LAYOUT_TABLE) & (t == "table"), 0.4).otherwise(0.0) + F.when(_has(q, I.LAYOUT_VISUAL) & (t == "figure"), 0.4).otherwise(0.0)
    return out.withColumns({"caption_match": match, "score": F.when(allowed(intent, t) & ~conflict, F.round(score, 9))})


def select_crop(scored: DataFrame, plain: float = 1.15, with_reference: float = 2.25) -> DataFrame:
    """IMG8, ORC13: the best region of a query if its score passes; else the query with its fallback policy."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "page_rank", "region")
    best = scored.withColumn("n", F.row_number().over(order)).where("n = 1")
    passes = F.col("score") >= F.when(F.col("reference").isNotNull(), with_reference).otherwise(plain)
    fallback = F.when((F.col("intent") == "visual") | I.visual_question(F.col("question")), "visual_main").otherwise("none")
    ok = F.coalesce(passes, F.lit(False))
    return best.select("query_id", "intent", F.when(ok, F.col("region")).alias("region"), F.when(ok, F.col("crop_type")).alias("crop_type"), F.when(ok, F.col("score")).alias("score"), F.when(~ok, fallback).alias("fallback"))
