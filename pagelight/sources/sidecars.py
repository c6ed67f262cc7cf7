"""Page texts and side files of document folders (SRC6, SRC7, EVD2, EVD3).

A folder `<number>/extracted` holds JSON files of page rows: a list, or an object whose pages, records or data is a
list. Files are read whole, one row a file; their shape is free, so a small helper parses them, and all else is
joins and aggregations.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import normalise_fields

# Names of files and of keys, in the order in which they are tried.
PAGE_FILES = ("pages_text.json", "page_text.json")
SIDE_FILES = {
    "ocr": ("pages_ocr.json", "page_ocr.json", "ocr_text.json", "ocr.json"),
    "caption": ("captions.json", "page_captions.json", "pages_captions.json"),
    "table_text": ("tables_text.json", "page_tables_text.json", "pages_tables_text.json"),
}
FIELD_KEYS = {
    "ocr": ("ocr", "ocr_text", "page_ocr"),
    "page_text": ("text", "page_text"),
    "caption": ("caption", "captions", "figure_caption", "table_caption"),
    "table_text": ("table_text", "tables_text", "table", "tables"),
}
TEXT_KEYS = ("text", "content", "caption", "table_text", "ocr_text")
LISTS = ("pages", "records", "data")

ROWS = "folder int, file string, ok boolean, pos int, page long, fields map<string,string>, whole string"


def as_text(value) -> str:
    """A JSON value as text: a string stripped; of a list the parts that have text, a line each; of an object those of its text
    keys if it has any, else all as "key: text"."""
    if isinstance(value, dict):
        known = [as_text(value[k]) for k in TEXT_KEYS if k in value]
        return "\n".join(x for x in (known or [f"{k}: {as_text(v)}" for k, v in value.items()]) if x)
    if isinstance(value, list):
        return "\n".join(filter(None, map(as_text, value)))
    return "" if value is None else str(value).encode("utf-8", "replace").decode().strip()  # half a surrogate pair is no text


def page_rows_of(content: bytes) -> list[dict] | None:
    """The objects among a file's page rows; None if it can't be parsed or has another shape."""
    try:
        found = json.loads(content.decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    if isinstance(found, dict):
        found = next((found[k] for k in LISTS if isinstance(found.get(k), list)), None)
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else None


def _page(row: dict) -> int | None:
    try:
        page = int(row.get("page"))
    except (TypeError, ValueError, OverflowError):
        return None
    return page if abs(page) < 1 << 63 else None


def _parse(batches):
    keys = {k for names in FIELD_KEYS.values() for k in names}
    for batch in batches:
        for folder, file, content in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            rows = page_rows_of(content)
            out = [(folder, file, rows is not None, -1, None, None, None)]
            for pos, row in enumerate(rows or []):
                page = _page(row)
                if page is not None:
                    out.append((folder, file, True, pos, page, [(k, as_text(row[k])) for k in row if k in keys], as_text(row)))
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
            names = ["folder", "file", "ok", "pos", "page", "fields", "whole"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def file_rows(spark: SparkSession, root: str, files: tuple[str, ...]) -> DataFrame:
    """(folder, file, ok, pos, page, fields, whole): rows of the named files of all folders, and one with pos -1 a file."""
    try:
        raw = spark.read.format("binaryFile").load([f"{root}/*/extracted/{f}" for f in files]).select("path", "content")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = None
    if raw is None:
        return spark.createDataFrame([], ROWS)
    named = raw.select(F.regexp_extract("path", r"/(\d+)/extracted/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content").where("folder <> ''")
    return named.select(F.col("folder").cast("int"), "file", "content").mapInArrow(_parse, ROWS)


def _first_file(rows: DataFrame, files: tuple[str, ...], parsable: bool) -> DataFrame:
    """The rows of each folder's first file, or first parsable one, in the order of `files`."""
    place = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file"))
    rows = rows.withColumn("place", place)
    first = (rows.where("ok") if parsable else rows).groupBy("folder").agg(F.min("place").alias("place"))
    return rows.join(first, ["folder", "place"]).where("ok and pos >= 0").drop("place")


def _text(field: str) -> Column:
    """The first of a field's keys that has text, else null."""
    return F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(k)), F.lit("")) for k in FIELD_KEYS[field]])


def sidecar_texts(spark: SparkSession, root: str, field: str) -> DataFrame:
    """SRC7: (folder, page, text): of each folder's first side file that exists and can be parsed, even if it gives nothing;
    a row's text is that of the field's first key that has any, else the whole row's; later rows of a page win."""
    files = SIDE_FILES.get(field, ())
    if not files:
        return spark.createDataFrame([], "folder int, page long, text string")
    rows = _first_file(file_rows(spark, root, files), files, parsable=True)
    rows = rows.withColumn("text", F.coalesce(_text(field), "whole")).where("text <> ''")
    return rows.groupBy("folder", "page").agg(F.max_by("text", "pos").alias("text"))


def page_evidence(spark: SparkSession, root: str, fields: list[str] | None = None) -> DataFrame:
    """SRC6, EVD1 to EVD3: (folder, pos, page, text, available_fields) of the rows of each folder's first page file (a folder
    whose first one can't be parsed has none): for each field the row's own text, else the side file's, under its name in brackets."""
    names = normalise_fields(list(fields or []))
    out = _first_file(file_rows(spark, root, PAGE_FILES), PAGE_FILES, parsable=False).select("folder", "pos", "page", *[_text(n).alias(f"own_{n}") for n in names])
    for n in names:
        if n in SIDE_FILES:
            out = out.join(sidecar_texts(spark, root, n).withColumnRenamed("text", f"side_{n}"), ["folder", "page"], "left")
        else:
            out = out.withColumn(f"side_{n}", F.lit(None).cast("string"))
    text = {n: F.coalesce(f"own_{n}", f"side_{n}") for n in names}
    blocks = F.concat_ws("\n\n", *[F.when(t.isNotNull(), F.concat(F.lit(f"[{n.upper()}]\n"), t)) for n, t in text.items()])
    held = F.array_compact(F.array(*[F.when(t.isNotNull(), F.lit(n)) for n, t in text.items()]))
    return out.select("folder", "pos", "page", blocks.alias("text"), held.alias("available_fields")).where("text <> ''")
