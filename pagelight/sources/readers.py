"""Sources and sinks: question files, page records, sidecars, corpora, predictions, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

QUESTION = "question string, answer string, type string, evidence string"
PAGE_IMAGE = r"/(\d+)/extracted/pages/(?:page_)?(\d+)\.png$"


def _folder(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def questions(spark: SparkSession, root: str, types: list[str] | None = None) -> DataFrame:
    """SRC3, SRC3b: <folder>/<name>_qa.jsonl of numeric folders, with evidence; blank lines are skipped."""
    out = spark.read.schema(QUESTION).json(f"{root}/*/*_qa.jsonl").select("*", _folder(r"/(\d+)/[^/]*_qa\.jsonl$").alias("folder")).where("folder <> ''")
    return out.where(F.col("type").isin(types)) if types else out


def numbered(df: DataFrame, order: list[str], start: int = 0, limit: int | None = None) -> DataFrame:
    """SRC4, TOP5: question_id 1..n before a slice is taken."""
    from ..operators.order import numbered as place

    out = place(df, order, "question_id").where(F.col("question_id") > start)
    return out if limit is None else out.where(F.col("question_id") <= start + limit)


def domains(spark: SparkSession, root: str) -> DataFrame:
    """SRC5: (folder, domain) of <folder>/doc_report.json; unknown where it says none."""
    out = spark.read.schema("domain string").option("multiLine", True).json(f"{root}/*/doc_report.json")
    return out.select(_folder(r"/(\d+)/doc_report\.json$").alias("folder"), F.coalesce("domain", F.lit("unknown")).alias("domain"))


def page_images(spark: SparkSession, root: str) -> DataFrame:
    """SRC1: page images of numeric folders, without their bytes: (folder, page, path, idx), idx running by folder and page."""
    out = spark.read.format("binaryFile").load(f"{root}/*/extracted/pages/*.png").select("path")
    out = out.select(F.regexp_extract("path", PAGE_IMAGE, 1).alias("folder"), F.regexp_extract("path", PAGE_IMAGE, 2).alias("page"), "path").where("folder <> ''")
    out = out.withColumns({"folder": F.col("folder").cast("int"), "page": F.col("page").cast("int")})
    from ..operators.order import numbered as place

    return place(out, ["folder", "page"], "idx").withColumn("idx", F.col("idx") - 1)


PAGE = "page int, text string"


def page_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC2, SRC6: pages of a JSON list, or of the first list among pages, records and data."""
    element = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in PAGE.split(', '))}>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    wrapped = F.from_json("value", f"pages {element}, records {element}, data {element}")
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", element))
    rows = F.coalesce(listed, wrapped["pages"], wrapped["records"], wrapped["data"])
    return raw.select("path", F.posexplode(rows).alias("pos", "row")).select("path", "pos", "row.*").where("page is not null")


def squad(spark: SparkSession, path: str, split: str) -> DataFrame:
    """SRC11: paragraphs of a reading-comprehension file with ids <split>_<article>_<paragraph>."""
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string>>>>"
    out = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("data").alias("a", "article"))
    out = out.select("a", F.col("article.title").alias("title"), F.posexplode("article.paragraphs").alias("p", "paragraph"))
    return out.select(F.concat_ws("_", F.lit("squad"), F.lit(split), "a", "p").alias("id"), "title", F.col("paragraph.context").alias("text"))


def texts(spark: SparkSession, path: str, kind: str, column: str = "text", most: int | None = None) -> DataFrame:
    """SRC12: lines of text files, entries of JSON lists (or their documents), a column of CSV files, or, of a folder, the
    whole texts of its .txt files, subfolders included."""
    if kind == "folder":
        out = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(T.strip(F.col("value")).alias("text")).where("text <> ''")
    elif kind == "txt":
        out = spark.read.text(path).select(T.strip(F.col("value")).alias("text")).where("text <> ''")
    elif kind == "json":
        out = spark.read.option("multiLine", True).json(path)
        out = out.select(F.explode("documents").alias("d")).select("d.*") if "documents" in out.columns else out
        out = out.select(F.col(column).alias("text"))
    else:
        out = spark.read.option("header", True).csv(path).select(F.col(column).alias("text"))
    return out if most is None else out.limit(most)


def predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC13."""
    return spark.read.schema(schema).json(path)


def metric_csv(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """SRC15: a CSV whose metric columns become doubles, null where they can't be read."""
    out = spark.read.option("header", True).csv(path)
    return out.withColumns({m: F.col(m).try_cast("double") for m in metrics})


def write_index(vectors: DataFrame, path: str) -> None:
    """SNK7: vectors with their metadata, refused unless all lengths are one and no vector is null."""
    bad = vectors.agg(F.count_distinct(F.size("vec")).alias("dims"), F.sum(F.col("vec").isNull().cast("int")).alias("nulls")).first()
    if bad["dims"] > 1 or bad["nulls"]:
        raise ValueError("vectors must have one length and none may be null")
    vectors.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, corpus: DataFrame | None = None) -> DataFrame:
    """SRC8, SRC9, SRC10: an index; an error if it has another number of rows than its corpus."""
    out = spark.read.parquet(path)
    if corpus is not None and out.count() != corpus.count():
        raise ValueError("index and corpus differ in size")
    return out


def write_pages(df: DataFrame, path: str) -> None:
    """SRC2: page records as JSON lines, a file a task; page_rows() reads a list, read_records() reads these."""
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC2: page records that write_pages() has written."""
    return spark.read.schema(schema).json(path)


def write_metrics(df: DataFrame, path: str, kind: str = "json") -> None:
    """SNK1: rows as JSON lines, CSV with a header, or Markdown; one overwrite replaces all, so a retried job leaves no
    half table (SNK5). CSV and Markdown take no nested columns; in Markdown, | and line feeds are escaped."""
    if kind == "markdown":
        cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\\s*[\r\n]+\\s*", " ")
        head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))], "n int, line string").coalesce(1).orderBy("n").select("line")
        head.write.mode("overwrite").text(f"{path}/0-head")
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`")) for c in df.columns]), F.lit(" |")).alias("line")).write.mode("overwrite").text(f"{path}/1-rows")
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str, errors: DataFrame | None = None) -> dict[str, int]:
    """SNK6: predictions as JSON lines under `rows`, those that are invalid (see row_errors) apart under `invalid` with their
    errors, and a run log: one JSON row of counts. errors: (query_id, errors array<string>).

    The log is written last: a folder without one is a run that did not end. Returns the counts."""
    out = df if errors is None else df.join(errors.select("query_id", "errors"), "query_id", "left")
    bad = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0 if errors is not None else F.lit(False)
    out.where(~bad).drop("errors").write.mode("overwrite").json(f"{path}/rows")
    if errors is not None:
        out.where(bad).write.mode("overwrite").json(f"{path}/invalid")
    spark = df.sparkSession
    count = lambda part: spark.read.text(f"{path}/{part}").count()
    counts = {"rows": count("rows"), "invalid": count("invalid") if errors is not None else 0}
    spark.createDataFrame([tuple(counts.values())], "rows long, invalid long").coalesce(1).write.mode("overwrite").json(f"{path}/log")
    return counts


def unfinished(questions: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """SNK5: what a resumed run still has to do: questions without a prediction."""
    return questions.join(done.select(key).distinct(), key, "left_anti")
