"""What a question asks for, and the routes that follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import layout_tokens, metric_text, text_of, words

# Term lists and patterns of the reference results.
LAYOUT_TABLE = "table row column cell accuracy f1 score percentage percent revenue sales profit income cost expense expenses assets debt employees tokens ppl bleu auc wer".split()
LAYOUT_VISUAL = "figure fig chart graph diagram architecture pipeline component arrow axis legend plot photo image picture shown".split()
ROUTE_TABLE = "table tabular row column cell total amount value percentage percent".split()
ROUTE_VISUAL = "figure fig. fig chart graph plot diagram image picture visual map".split()
TABLE_HEAVY = "table row column score accuracy f1 bleu revenue income sales assets cost expenses shares employees stores percentage increase decrease difference average total".split()
QUESTION_KINDS = {
    "table": "table,row,column,cell,value,number,percentage,percent,accuracy,score,f1,bleu,perplexity,how many,how much,what is the total,calculate,sum,difference,average,maximum,minimum,highest,lowest,increase,decrease,change,growth,compared to,versus,vs,dataset,result,performance,metric,precision,recall,benchmark".split(","),
    "image": "image,picture,photo,graph,plot,chart,scatter,bar,line,pie,histogram,heatmap,visual,visualization,screenshot,drawing,sketch,figure,illustration,shown in,depicted in".split(","),
    "formula": "formula,equation,mathematical,expression,computation,parameter,coefficient,function,f(x),loss function,gradient,derivative,algorithm".split(","),
}
DOMAINS = {
    "financial": "revenue,profit,income,assets,debt,earnings,fiscal,quarter,shareholders,dividends,equity,liabilities,cash flow,operating,net income,gross,ebitda,balance sheet,annual report,10-k,consolidated,segment,capex,expenditure,sales,margin,amortization".split(","),
    "academic": "model,bert,training,dataset,corpus,nlp,accuracy,f1,bleu,perplexity,attention,transformer,embedding,classification,entity,coreference,summarization,translation,neural,layer,epoch,baseline,ablation".split(","),
    "government": "policy,regulation,government,federal,agency,department,legislation,act,section,statute,public,authority,ministry,cabinet,parliament,senate,bill".split(","),
    "legal": "contract,clause,agreement,liability,plaintiff,defendant,court,jurisdiction,legal,law,attorney,counsel,indemnification,warranty,breach".split(","),
    "news": "according to,reported,announced,statement,spokesperson,interview,journalist,newspaper,article,press release,editorial,breaking,sources said,confirmed".split(","),
}
# Limits of a context by domain and kind of question: pages, tables, images.
CONTEXT_LIMITS = {
    "financial": {"table": (3, 3, 0), "text": (4, 1, 0), "image": (2, 0, 3), "formula": (2, 0, 3)},
    "academic": {"table": (2, 2, 0), "text": (5, 0, 0), "image": (1, 0, 4), "formula": (1, 0, 4)},
    "government": {"table": (2, 2, 0), "text": (5, 0, 0), "image": (2, 0, 3), "formula": (2, 0, 3)},
    "legal": {"table": (2, 2, 0), "text": (5, 0, 0), "image": (2, 0, 2), "formula": (2, 0, 2)},
    "news": {"table": (2, 2, 0), "text": (3, 0, 0), "image": (2, 0, 3), "formula": (1, 0, 3)},
}
REFERENCE = r"(?i)\b(table|figure|fig\.?)\s*([0-9]+[a-z]?)\b"
VISUAL_WORDS = r"\b(figure|fig\.?|chart|graph|plot|diagram|architecture|component|image|picture|photo)\b"
ROUTER = {
    "clip": "picture chart diagram image photo".split(),
    "layoutlm": "excel csv table spreadsheet column row".split(),
    "e5": "code program function algorithm".split(),
}


def reference(c: Column) -> Column:
    """PRD1: the first explicit reference, such as "figure 3a"; null if there is none."""
    t = text_of(c)
    kind = F.replace(F.lower(F.regexp_extract(t, REFERENCE, 1)), F.lit("."), F.lit(""))
    kind = F.when(F.startswith(kind, F.lit("fig")), "figure").otherwise(kind)
    return F.when(t.rlike(REFERENCE), F.concat_ws(" ", kind, F.lower(F.regexp_extract(t, REFERENCE, 2))))


def crop_intent(c: Column) -> Column:
    """PRD2: table, visual or unknown."""
    t, ref = F.lower(text_of(c)), reference(c)
    table, visual = t.rlike(r"\btable\b"), t.rlike(VISUAL_WORDS)
    return F.when(ref.isNotNull(), F.when(F.startswith(ref, F.lit("table")), "table").otherwise("visual")).when(table & ~visual, "table").when(visual & ~table, "visual").otherwise("unknown")


def target_type(c: Column, qtype: Column) -> Column:
    """PRD3: table, figure or text."""
    t = layout_tokens(c)
    return F.when(F.array_contains(t, "table") | F.lower(text_of(c)).rlike(r"\btable\s*\d+\b"), "table").when(F.arrays_overlap(t, words(*LAYOUT_VISUAL)) | visual_context(qtype), "figure").when(F.arrays_overlap(t, words(*LAYOUT_TABLE)), "table").otherwise("text")


def visual_question(c: Column) -> Column:
    """PRD4: names something to look at."""
    return F.lower(text_of(c)).rlike("figure|fig\\.|chart|graph|plot|diagram|image|picture|photo|architecture|shown")


def visual_context(qtype: Column) -> Column:
    return F.coalesce(F.lower(qtype) == "multimodal-f", F.lit(False))


def table_heavy(c: Column) -> Column:
    """PRD5: holds a word that tables are asked with."""
    return metric_text(c).rlike("|".join(TABLE_HEAVY))


def numeric_table_heavy(c: Column) -> Column:
    return F.arrays_overlap(layout_tokens(c), words(*LAYOUT_TABLE)) | text_of(c).rlike(r"(?i)\b(total|difference|ratio|increase|decrease|percentage|score|accuracy|f1)\b")


def confident(top1: Column, top2: Column, t1: float | None, gap: float | None) -> Column:
    """PRD7: off without thresholds; each given one must pass; a gap needs two candidates."""
    if t1 is None and gap is None:
        return F.lit(False)
    ok = top1.isNotNull()
    if t1 is not None:
        ok = ok & (top1 >= t1)
    if gap is not None:
        ok = ok & F.coalesce(top1 - top2 >= gap, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def route(question: Column, qtype: Column, skip: Column) -> Column:
    """PRD6: high_confidence, visual, table_or_text or unknown, in that order."""
    kind = F.lower(text_of(qtype))
    tokens = F.split(F.translate(F.lower(text_of(question)), "/-", "  "), r"\s+")
    intent = crop_intent(question)
    return (
        F.when(skip, "high_confidence")
        .when((kind == "multimodal-f") | (intent == "visual") | F.arrays_overlap(tokens, words(*ROUTE_VISUAL)), "visual")
        .when((kind == "multimodal-t") | (intent == "table") | F.arrays_overlap(tokens, words(*ROUTE_TABLE)), "table_or_text")
        .otherwise("unknown")
    )


def skip_reason(top1: Column, top2: Column, t1: float | Column, gap: float | Column) -> Column:
    """PRD8: why a reranker is or isn't skipped."""
    low1, low_gap = top1 < t1, top1 - top2 < gap
    return (
        F.when(top1.isNull(), "no_candidates")
        .when(top2.isNull(), "not_enough_candidates_for_gap")
        .when(~low1 & ~low_gap, "top1_and_gap_passed")
        .when(low1 & low_gap, "top1_and_gap_below_thresholds")
        .when(low1, "top1_below_threshold")
        .otherwise("gap_below_threshold")
    )


def relative_gap(top1: Column, top2: Column) -> Column:
    return F.when(F.abs(top1) > 1e-12, (top1 - top2) / F.abs(top1))


def modules(c: Column) -> Column:
    """PRD9: search modules by keyword; e5 where no category matches."""
    t = F.lower(text_of(c))
    hits = [F.when(F.exists(words(*names), lambda k: F.contains(t, k)), module) for module, names in ROUTER.items()]
    out = F.array_distinct(F.array_compact(F.array(F.lit("bm25"), *hits)))
    return F.when(F.size(out) == 1, F.array(F.lit("bm25"), F.lit("e5"))).otherwise(out)


def context_pages(c: Column, qtype: Column) -> Column:
    """PRD10: pages to show."""
    return F.when(visual_question(c) | visual_context(qtype), 5).otherwise(3)


def pipeline_of(qtype: Column) -> Column:
    """PRD11: text, multimodal or unsupported."""
    return F.when(qtype.isin("text-only", "meta-data", "unanswerable"), "text").when(qtype.isin("multimodal-t", "multimodal-f", "multimodal"), "multimodal").otherwise("unsupported")


def _most_words(c: Column, lists: dict[str, list[str]], none: str) -> Column:
    """The first of the lists of which a text holds most entries; `none` if it holds no entry at all."""
    low = F.lower(text_of(c))
    counts = F.array(*[sum((F.contains(low, F.lit(x)).cast("int") for x in terms), F.lit(0)) for terms in lists.values()])
    most = F.array_max(counts)
    return F.when(most == 0, none).otherwise(F.element_at(F.array(*[F.lit(k) for k in lists]), F.array_position(counts, most).cast("int")))


def question_kind(c: Column) -> Column:
    """PRD16: table, image, formula or text, by the words that a question holds."""
    return _most_words(c, QUESTION_KINDS, "text")


def question_domain(c: Column) -> Column:
    """PRD16: the domain that a question's words speak of; academic if none."""
    return _most_words(c, DOMAINS, "academic")


def context_limits(kind: Column, domain: Column) -> Column:
    """PRD16: struct(max_pages, max_tables, max_images); an unknown domain has the academic limits, an unknown kind those of text."""
    names = ("max_pages", "max_tables", "max_images")
    rows = {(d, k): F.struct(*[F.lit(v).alias(n) for n, v in zip(names, limits)]) for d, kinds in CONTEXT_LIMITS.items() for k, limits in kinds.items()}
    table = F.create_map(*[x for (d, k), row in rows.items() for x in (F.lit(f"{d} {k}"), row)])
    known = F.when(domain.isin(*CONTEXT_LIMITS), domain).otherwise("academic")
    return F.element_at(table, F.concat_ws(" ", known, F.when(kind.isin("table", "image", "formula"), kind).otherwise("text")))
