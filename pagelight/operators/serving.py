"""Serving: two-stage search, pooled encodings, answer contexts, metadata answers, prompts, cases and crops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import top_k
from .rerank import SCORERS, truncate
from .retrieval import dense_search, small, unit

# Prompt names by question type; any other type has the last.
PROMPTS = {"multimodal-t": "DOCBENCH_MULTIMODAL_PROMPT_V2", "multimodal-f": "DOCBENCH_MULTIMODAL_PROMPT_V2", "meta-data": "DOCBENCH_METADATA_PROMPT", "unanswerable": "DOCBENCH_UNANSWERABLE_PROMPT", "una-web": "DOCBENCH_UNANSWERABLE_PROMPT"}
OTHER_PROMPT = "DOCBENCH_TEXT_ONLY_PROMPT"
# Names of runs that reports leave out.
LEFT_OUT = ("smoke", "bad", "current_full_pipeline")
# Ways to ask for the number of pages.
PAGE_COUNT = ("how many pages", "number of pages", "total pages", "pages does the document have", "pages does the report consist")
# Columns of a case, and what candidates may carry beyond their base columns.
CASE = "question type expected generated f1 latency effective_crop_policy selected_crop_type selected_crop_score selected_crop_path selected_crop_bbox selected_crop_page question_crop_intent explicit_reference selected_crop_caption crop_type_mismatch caption_match fallback_used crop_used full_page_plus_crop".split()
DYNAMIC = "text_rerank_score text_rerank_rank fusion_score fusion_rank fusion_features evidence_fields".split()


def two_stage(queries: DataFrame, vectors: DataFrame, k: int = 10, scorer: Callable[[Column, Column], Column] | None = None, widen: int = 5) -> DataFrame:
    """RET8: dense search for k * widen pages, then the scorer of (query vector, page vector) orders them and k stay.

    Without a scorer the first stage is cut at k. Vectors are over their length in both stages."""
    first = dense_search(queries, vectors, k if scorer is None else k * widen)
    if scorer is None:
        return first
    pages = vectors.select("doc_id", "page", unit("vec").alias("v"))
    out = pages.join(first.withColumnRenamed("rank", "first_rank"), ["doc_id", "page"]).join(small(queries.select("query_id", unit("vec").alias("q"))), "query_id")
    out = out.select("query_id", "doc_id", "page", "first_rank", F.round(scorer(F.col("q"), F.col("v")), 9).alias("score"))
    return top_k(out, k, ties=["first_rank"])


def mean_pooled(tokens: DataFrame) -> DataFrame:
    """RET11: (doc_id, vec): the mean of a text's token vectors under its mask (divisor at least 1e-9), over its length.

    tokens: (doc_id, mask, vec). A text without any unmasked token has a zero vector."""
    part = tokens.select("doc_id", F.col("mask").cast("double").alias("mask"), F.posexplode("vec").alias("dim", "x"))
    mean = part.groupBy("doc_id", "dim").agg((F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-9))).alias("x"))
    return mean.groupBy("doc_id").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"])).alias("vec"))


def answer_context(found: DataFrame, k: int = 3, least: float = 0.1, preview: int = 150) -> DataFrame:
    """RET14: of the first 3 k results of a query (rank, score, text) those of at least `least`, the first k of them.

    Adds position, preview (cut, with three dots), the score to three digits and total_found. A query of
    which nothing is left has no row: nothing was found."""
    seen = found.where(F.col("rank") <= 3 * k).withColumn("total_found", F.count("*").over(Window.partitionBy("query_id")))
    text = T.text_of(F.col("text"))
    kept = seen.where(F.col("score") >= least).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("position") <= k)
    return kept.withColumns({"preview": F.concat(F.substring(text, 1, preview), F.when(F.length(text) > preview, "...").otherwise("")), "score": F.round("score", 3)})


def unchanged(df: DataFrame) -> DataFrame:
    """RRK0, RRK1: a reranker is a function of candidates to candidates; this one leaves them as they are."""
    return df.withColumn("rerank_rank", F.col("rank"))


def rerank_with_evidence(df: DataFrame, evidence: DataFrame, scorer: str = "lexical", most: int = 4096) -> DataFrame:
    """RRK6: the evidence text of a candidate (EVD7), cut (EVD8), is scored with the question."""
    from .evidence import attach

    out = attach(df.drop("text"), evidence).withColumn("text", truncate(F.col("text"), most))
    out = out.withColumn("rerank_score", F.round(SCORERS[scorer](F.col("question"), F.col("text")), 9))
    return top_k(out, None, score="rerank_score", ties=["rank"], rank="rerank_rank")


def page_reference(question: Column) -> Column:
    """The page that a question names, or null."""
    return F.nullif(F.regexp_extract(T.text_of(question), r"(?i)\bpage\s+(\d+)\b", 1), F.lit("")).cast("long")


def asks_page_count(question: Column) -> Column:
    low = F.lower(T.text_of(question))
    out = F.lit(False)
    for phrase in PAGE_COUNT:
        out = out | F.contains(low, F.lit(phrase))
    return out


def mention_phrase(question: Column) -> Column:
    """What a question asks to count mentions of: the quoted phrase, or what follows the verb (eight words at most)."""
    q = T.strip(T.text_of(question))
    quoted = F.regexp_extract(q, "['\"]([^'\"]{1,120})['\"]", 1)
    after = T.strip(F.regexp_extract(q, r"(?is)\bmention(?:s|ed)?\s+(.+?)(?:\?|$)", 1))
    after = F.regexp_replace(after, r"(?i)^(the\s+)?(term|phrase|word)\s+", "")
    after = F.regexp_replace(after, "^[ \"'“”‘’.]+|[ \"'“”‘’.]+$", "")
    long = F.size(F.filter(F.split(after, r"\s+"), lambda w: w != "")) > 8
    return F.when((quoted != "") & q.rlike(r"(?i)\bmention"), T.strip(quoted)).when((after != "") & ~long, after)


def mentions(text: Column, phrase: Column) -> Column:
    """Places of a phrase, in any case, that don't overlap; the phrase is taken literally."""
    low, p = F.lower(T.text_of(text)), F.lower(phrase)
    return F.when(p != "", ((F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).cast("long")).otherwise(0)


def metadata_answers(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """PRD12: questions (query_id, question, qtype, doc_id) that a rule answers: tool, page, answer.

    A named page is found, if its document has it (page_direct); a meta-data question may ask for the
    number of pages (page_count) or of a phrase's mentions in the whole document (mention_count)."""
    q = F.col("question")
    meta = F.col("qtype") == "meta-data"
    tool = F.when(page_reference(q).isNotNull(), "page_direct").when(meta & asks_page_count(q), "page_count").when(meta & mention_phrase(q).isNotNull(), "mention_count")
    asked = questions.select("query_id", "doc_id", tool.alias("tool"), page_reference(q).alias("named"), mention_phrase(q).alias("phrase")).where("tool is not null")
    joined = pages.select("doc_id", "page", "text").join(small(asked), "doc_id")
    # mentions across the break of two pages can't be: pages are joined by line feeds, which phrases lack
    out = joined.groupBy("query_id", "tool").agg(F.max("page").alias("pages"), F.sum(mentions(F.col("text"), F.col("phrase"))).alias("n"), F.max(F.when(F.col("page") == F.col("named"), F.col("page"))).alias("page"))
    answer = F.when(F.col("tool") == "page_count", F.col("pages")).when(F.col("tool") == "mention_count", F.col("n"))
    return out.select("query_id", "tool", F.when(F.col("tool") == "page_direct", F.col("page")).cast("long").alias("page"), answer.cast("string").alias("answer"))


def prompt_name(qtype: Column) -> Column:
    """PRD17."""
    out = F.lit(OTHER_PROMPT)
    for kind, name in PROMPTS.items():
        out = F.when(T.strip(T.text_of(qtype)) == kind, name).otherwise(out)
    return out


def paper_rows(df: DataFrame, dataset: str = "multimodal_308", total: int = 308) -> DataFrame:
    """PRD14: runs that reports show."""
    low = F.lower(T.text_of(F.col("experiment")))
    odd = F.lit(False)
    for part in LEFT_OUT:
        odd = odd | F.contains(low, F.lit(part))
    return df.where(~odd & (F.col("dataset") == dataset) & (F.col("total").cast("string") == str(total)))


def config_label(mode: Column, backend: Column, model: Column, default: str = "") -> Column:
    """RPT11: what there is of the three, or the default."""
    parts = F.concat_ws(" / ", *[F.nullif(c.cast("string"), F.lit("")) for c in (mode, backend, model)])
    return F.when(parts == "", default).otherwise(parts)


def evidence_label(fields: Column, policy: Column, context: Column) -> Column:
    """RPT11: source fields, else crop policy and context mode."""
    return F.when(F.size(fields) > 0, F.array_join(fields, "+")).otherwise(config_label(policy, context, F.lit(None)))


def candidate_rows(df: DataFrame) -> DataFrame:
    """CND6: the base columns of candidates and those of the dynamic ones that they have."""
    return df.select("query_id", "doc_id", "page", "score", "rank", *[c for c in DYNAMIC if c in df.columns])


def ordered_images(paths: Column, crop_path: Column, crop_label: Column, mode: Column) -> Column:
    """CND8: images of a context in order. paths: array of (label, path) of full pages.

    Without a crop all pages; with one it alone, or, in the mode full_page_plus_crop, its page (by label,
    else the first), the crop and the other pages."""
    whole = F.transform(paths, lambda x: x["path"])
    at = F.greatest(F.array_position(F.transform(paths, lambda x: x["label"]), crop_label), F.lit(1)).cast("int")
    at = F.coalesce(at, F.lit(1))
    own = F.array(F.try_element_at(whole, at), crop_path)
    rest = F.filter(F.transform(whole, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["i"] != at - 1)
    both = F.concat(own, F.transform(rest, lambda x: x["p"]))
    return F.when(F.coalesce(crop_path, F.lit("")) == "", whole).when(mode == "full_page_plus_crop", both).otherwise(F.array(crop_path))


def crop_used(crop: str = "crop") -> Column:
    return ~F.coalesce(F.col(f"{crop}.fallback_used"), F.lit(False)) & (F.coalesce(F.col(f"{crop}.crop_path"), F.lit("")) != "")


def crop_summary(df: DataFrame, by: list[str] | None = None, crop: str = "crop") -> DataFrame:
    """AGG3: rates over the rows (f1, crop struct) of each group, and mean f1 where crops mismatch or captions match."""
    flag = lambda name: F.coalesce(F.col(f"{crop}.{name}"), F.lit(False))
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 9)
    mean = lambda c: F.round(F.avg(F.when(c, F.col("f1"))), 9)
    return df.groupBy(*(by or [])).agg(
        rate(crop_used(crop)).alias("crop_used_rate"),
        rate(flag("crop_type_mismatch")).alias("crop_type_mismatch_rate"),
        rate(flag("caption_match")).alias("caption_match_rate"),
        rate(flag("fallback_used")).alias("fallback_rate"),
        mean(flag("crop_type_mismatch")).alias("mean_f1_when_crop_type_mismatch_true"),
        mean(flag("caption_match")).alias("mean_f1_when_caption_match_true"),
    )


def cases(df: DataFrame) -> DataFrame:
    """SNK3: the columns of a case; those that a row lacks are null. crop: the selected crop's struct."""
    have = {f.name for f in df.schema["crop"].dataType.fields} if "crop" in df.columns else set()
    of = {"selected_crop_type": "crop_type", "selected_crop_score": "score", "selected_crop_path": "crop_path", "selected_crop_bbox": "bbox", "selected_crop_page": "page_label", "selected_crop_caption": "caption"}

    def value(name: str) -> Column:
        inner = of.get(name, name)
        if name == "crop_used" and "crop" in df.columns:
            return crop_used()
        if inner in have:
            return F.col(f"crop.{inner}")
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return df.select(*[value(name).alias(name) for name in CASE])
