"""Page evidence: corpora, evidence text, captions, table blocks; and budgeted contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import small

# Patterns of the reference results.
CAPTION = r"^(?i:table|figure|fig\.?|chart|graph)\s*[0-9]+[a-z]?\b"
CAPTION_PARTS = r"(?i)^(table|figure|fig\.?|chart|graph)\s*([0-9]+[a-z]?)\b"
SECTION = r"^\d+(\.\d+)*\.?\s+[A-Z]"
FIELDS = ("page_text", "ocr", "caption", "table_text")


def pages_of(docs: DataFrame, lines: int = 8, single: bool = False) -> DataFrame:
    """(doc_id, page, text): documents cut into pages of so many lines. single: no doc_id has two rows, so each is cut where it lies."""
    if single:
        page = lambda all: F.transform(F.sequence(F.lit(1), F.size(all), F.lit(lines)), lambda n: F.array_join(F.slice(all, n, lines), "\n"))
        cut = docs.select("doc_id", F.posexplode(F.transform(F.array(F.split("text", "\n")), page)[0]).alias("page", "text"))  # in an array, so that a text is split once
        return cut.select("doc_id", (F.col("page") + 1).alias("page"), "text")
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("page", (F.floor(F.col("n") / lines) + 1).cast("int"))
    return cut.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def evidence_text(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """EVD2, EVD3: for each field its first non-empty column as a block "[FIELD]\\ntext", joined by blank lines.

    Adds text and available_fields; pages without any evidence go."""
    first = {name: F.coalesce(*[F.nullif(T.strip(T.text_of(F.col(c))), F.lit("")) for c in columns]) for name, columns in fields.items()}
    block = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"[{name.upper()}]\n"), c))
    out = pages.withColumn("evidence", F.concat_ws("\n\n", *[block(n, c) for n, c in first.items()]))
    out = out.withColumn("available_fields", F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in first.items()])))
    return out.where("evidence <> ''")


def normalise_fields(names: list[str], known: tuple[str, ...] = FIELDS) -> list[str]:
    """EVD1: known fields in order without repeats, by alias; page_text if none is known."""
    alias = {"text": "page_text", "page": "page_text", "captions": "caption", "tables": "table_text", "table": "table_text", "ocr_text": "ocr"}
    out = list(dict.fromkeys(alias.get(n.strip().lower(), n.strip().lower()) for n in names))
    return [n for n in out if n in known] or ["page_text"]


def attach(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """EVD7: evidence (doc_id, page, text) of candidates; pages without any get an empty text. If candidates are few, no other page's text is shuffled."""
    keys = ["doc_id", "page"]
    held = evidence.select(*keys, "text").join(small(df.select(*keys).distinct()), keys, "left_semi")
    return df.join(held, keys, "left").withColumn("text", T.text_of(F.col("text")))


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.posexplode(T.clean_lines(F.col("text"))).alias("n", "line"))


def captions(pages: DataFrame, more: int = 3) -> DataFrame:
    """EVD4: (doc_id, page, pos, caption, reference): caption lines and up to `more` lines that go on,
    until another caption, a section heading or a line of two characters at most; once a page."""
    w = Window.partitionBy("doc_id", "page").orderBy("n")
    out = _lines(pages).withColumn("is_caption", F.col("line").rlike(CAPTION))
    text, going = F.col("line"), F.lit(True)
    for k in range(1, more + 1):
        following = F.lead("line", k).over(w)
        out = out.withColumn(f"next{k}", F.when(~following.rlike(CAPTION) & ~following.rlike(SECTION) & (F.length(following) > 2), following))
    for k in range(1, more + 1):
        going = going & F.col(f"next{k}").isNotNull()
        text = F.when(going, F.concat_ws(" ", text, F.col(f"next{k}"))).otherwise(text)
    out = out.where("is_caption").select("doc_id", "page", "n", T.strip(T.collapse(text)).alias("caption"), caption_reference(F.col("line")).alias("reference"))
    first = Window.partitionBy("doc_id", "page", F.lower("caption")).orderBy("n")
    return out.withColumn("k", F.row_number().over(first)).where("k = 1").select("doc_id", "page", F.col("n").alias("pos"), "caption", "reference")


def caption_reference(c: Column) -> Column:
    label = F.replace(F.lower(F.regexp_extract(c, CAPTION_PARTS, 1)), F.lit("."), F.lit(""))
    return F.when(c.rlike(CAPTION_PARTS), F.concat_ws(" ", F.when(label == "fig", "figure").otherwise(label), F.lower(F.regexp_extract(c, CAPTION_PARTS, 2))))


def table_blocks(pages: DataFrame, before: int = 28, after: int = 10) -> DataFrame:
    """EVD5: (doc_id, page, pos, block): lines around each table caption, once a page."""
    w = Window.partitionBy("doc_id", "page").orderBy("n").rowsBetween(-before, after)
    out = _lines(pages).withColumn("block", F.array_join(F.collect_list("line").over(w), "\n")).where(F.col("line").rlike(r"^(?i:table)\s*[0-9]+[a-z]?\b"))
    first = Window.partitionBy("doc_id", "page", T.collapse(F.lower("block"))).orderBy("n")
    return out.withColumn("k", F.row_number().over(first)).where("k = 1").select("doc_id", "page", F.col("n").alias("pos"), "block")


def crop_caption(text: Column, kind: Column) -> Column:
    """EVD6: the first line with a numbered label of the crop's type, else with any label, else ''."""
    lines = F.transform(F.split(T.text_of(text), "\n"), lambda x: T.strip(T.collapse(x)))
    first = lambda pattern: F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    table, figure = r"(?i)\btable\s*[0-9]+[a-z]?\b", r"(?i)\b(fig\.?|figure|chart|graph|diagram)\s*[0-9]+[a-z]?\b"
    either = r"(?i)\b(table|fig\.?|figure|chart|graph|diagram)\s*[0-9]+[a-z]?\b"
    typed = F.when(kind == "table", first(table)).when(kind == "figure", first(figure)).otherwise(first(either))
    return F.coalesce(typed, first(r"(?i)\b(table|fig\.?|figure|chart|graph|diagram)\b"), F.lit(""))


def pack_context(df: DataFrame, most: int, separator: int = 2, fields: bool = True) -> DataFrame:
    """CTX1 (separator 2, counted) and CTX2 (0, header with the score): blocks of a query in rank order
    until `most` characters are used; the last one is cut. df: (query_id, doc_id, page, rank, text[, score]).

    (query_id, context, n_blocks, truncated); empty pages give no block. A running sum over ranks decides."""
    head = F.format_string("[rank=%d doc_id=%s page=%d]\n", F.col("rank").cast("int"), F.col("doc_id").cast("string"), F.col("page").cast("int")) if fields else F.format_string("[%d] doc_id=%s page=%d score=%.4f\n", F.col("rank").cast("int"), F.col("doc_id").cast("string"), F.col("page").cast("int"), F.col("score"))
    out = df.withColumn("body", T.strip(T.text_of(F.col("text")))).where("body <> ''").withColumn("head", head)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("head") + F.length("body") + separator).over(w), F.lit(0))
    out = out.withColumn("room", most - used - F.length("head"))
    kept = out.where("room > 0").withColumn("block", F.concat("head", F.substring("body", F.lit(1), F.col("room").cast("int"))))
    cut = out.groupBy("query_id").agg(F.max((F.col("room") < F.length("body")).cast("int")).alias("cut"))
    joined = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("n_blocks"))
    return cut.join(joined, "query_id", "left").select("query_id", T.text_of(F.col("context")).alias("context"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), (F.col("cut") == 1).alias("truncated"))


def numbered_context(df: DataFrame, docs: int = 5, chars: int = 4000) -> DataFrame:
    """CTX3: the first documents longer than ten characters, each cut, numbered."""
    w = Window.partitionBy("query_id").orderBy("rank")
    out = df.where(F.length(T.strip(T.text_of(F.col("text")))) > 10).withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs)
    block = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), F.substring("text", 1, chars))
    return out.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
