"""Inputs of the registered queries, derived from the given tables alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.evidence import pages_of
from ..operators.index import LexicalIndex
from ..operators.retrieval import query_terms, small
from ..sources.shared import hadoop_path, scratch, ship, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    """Documents as one page each."""
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")


def pages(spark, d) -> DataFrame:
    """Documents in pages of eight lines."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pages_of(docs, single=single(docs))


def single(docs: DataFrame) -> bool:
    """Whether no doc_id has two rows; ids alone are shuffled to find out."""
    return not docs.groupBy("doc_id").count().where("count > 1").limit(1).count()


def questions(spark, d) -> DataFrame:
    """The first twelve words of each benchmark passage."""
    words = F.slice(F.split("text", " "), 1, 12)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("question"), F.col("text").alias("passage"))


def lexical_index(spark, d, cut=None) -> LexicalIndex:
    """The index of documents, or of their pages; built once a session for a table as it stands, then searched by all queries."""
    cut = cut or corpus
    held = spark.sparkContext.__dict__.setdefault("_pagelight_indexes", {})
    p, store = hadoop_path(spark, f"{d}/documents.parquet")
    about = store.getContentSummary(p)
    key = cut.__name__, d, about.getLength(), about.getFileCount(), store.getFileStatus(p).getModificationTime()
    if key not in held:
        held[key] = LexicalIndex(spark, scratch(spark, "lexical")).build(cut(spark, d))
    return held[key]


def gold(spark, d) -> DataFrame:
    """(query_id, doc_id, page): documents that hold a whole passage.

    The words of a passage but its first and last stand between spaces in it, so their tokens are tokens of any
    text that holds it: candidates are the documents that the index has for the rarest of them, and are
    verified. A passage without such a token is looked for in every text."""
    index = lexical_index(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    inner = q.select("query_id", "passage", F.array_join(F.slice(F.split("passage", " "), 2, F.greatest(F.size(F.split("passage", " ")) - 2, F.lit(0))), " ").alias("text"))
    docs = corpus(spark, d)
    known = written(index.holding(index.rarest(inner, "query_id")).select("doc_id", "page", "query_id"), "known")
    found = docs.join(small(known), ["doc_id", "page"]).join(small(q), "query_id").where(F.contains(F.col("text"), F.col("passage")))
    bare = inner.where(F.size(T.bm25_tokens(F.col("text"))) == 0)
    if bare.limit(1).count():
        found = found.unionByName(docs.join(small(bare.select("query_id", "passage")), F.contains(F.col("text"), F.col("passage"))))
    return found.select("query_id", "doc_id", "page").distinct()


def bm25(spark, d) -> tuple[LexicalIndex, DataFrame]:
    return lexical_index(spark, d), query_terms(questions(spark, d))


def gold_pages(spark, d) -> DataFrame:
    """(query_id, doc_id, page): pages of eight lines that hold a whole passage; pages of documents that do are looked at."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    near = written(gold(spark, d).select("query_id", "doc_id"), "near")
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = docs.join(small(near.select("doc_id").distinct()), "doc_id", "left_semi")
    return pages_of(held, single=single(docs)).join(small(near), "doc_id").join(small(q), "query_id").where(F.contains("text", "passage")).select("query_id", "doc_id", "page")


def ranked_pages(spark, d, k: int = 10) -> DataFrame:
    """Pages of eight lines by BM25; searched once, whatever is made of them."""
    return written(lexical_index(spark, d, pages).search(query_terms(questions(spark, d)), k), "ranked")


def ranked(spark, d, k: int = 10) -> DataFrame:
    """Documents by BM25; searched once, whatever is made of them."""
    index, terms = bm25(spark, d)
    return written(index.search(terms, k), "ranked")


def vectors(spark, d) -> DataFrame:
    """Vectors as pages: doc_id = vec_id // 4, page = vec_id % 4 + 1."""
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.floor(v / 4).alias("doc_id"), (v % 4 + 1).alias("page"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark, d) -> DataFrame:
    """The vectors whose id is divisible by fifty; each is searched in all vectors, itself among them."""
    return vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec", F.col("doc_id").alias("gold_doc"))


def dense(spark, d, k: int = 10) -> DataFrame:
    from ..operators.retrieval import dense_search

    return dense_search(vector_queries(spark, d), vectors(spark, d), k)


def answers(spark, d) -> DataFrame:
    """Expected and generated answers made from orders: money, percentages, names and sentences, some perturbed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").cast("decimal(18,2)").alias("amt"), F.col("o_orderpriority").alias("prio"))
    return o.select(
        "query_id",
        F.expr("CASE query_id % 5 WHEN 0 THEN concat('$', amt, ' million') WHEN 1 THEN concat(amt, '%') WHEN 2 THEN concat('Customer ', cust, ' Holdings Ltd reported revenue') WHEN 3 THEN concat('The total was ', cust, ' stores and ', query_id, ' employees') ELSE concat('priority ', prio) END").alias("expected"),
        F.expr("CASE query_id % 7 WHEN 0 THEN 'NOT FOUND' WHEN 1 THEN concat(amt + 1, ' million USD.') WHEN 2 THEN concat('about ', amt, '%') WHEN 3 THEN concat('customer ', cust, ' revenue of ', amt) WHEN 4 THEN concat(cust, ' stores, ', query_id, ' employees in total') WHEN 5 THEN concat('Priority: ', prio) ELSE '' END").alias("generated"),
        F.expr("CASE query_id % 4 WHEN 0 THEN 'text-only' WHEN 1 THEN 'multimodal-t' WHEN 2 THEN 'multimodal-f' ELSE 'meta-data' END").alias("qtype"),
        F.expr("cast(query_id % 97 as double) / 10 + 0.5").alias("latency"),
    )


def asked(spark, d) -> DataFrame:
    """Questions about tables and figures made from orders."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("query_id"),
        F.expr("CASE o_orderkey % 8 WHEN 0 THEN concat('What is the total revenue in Table ', o_custkey, '?') WHEN 1 THEN concat('Which line in Fig. ', o_custkey % 9, 'b is highest?') WHEN 2 THEN 'Which chart shows the accuracy score' WHEN 3 THEN 'What does the table row say about the plot' WHEN 4 THEN concat('How many employees in ', 1990 + o_custkey % 30) WHEN 5 THEN 'Which function is called' WHEN 6 THEN 'What is the cost/value of assets' ELSE 'Who wrote the report' END").alias("question"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'text-only' WHEN 1 THEN 'multimodal-t' ELSE 'multimodal-f' END").alias("qtype"),
    )


def captioned(spark, d) -> DataFrame:
    """Pages with a caption's label before two of nine lines; every line is whole."""
    whole = table(spark, d, "documents").select("doc_id", "text")
    line = F.expr("CASE (doc_id + n) % 9 WHEN 0 THEN concat('Table ', doc_id % 50, ': ', line) WHEN 4 THEN concat('Figure ', n, 'a. ', line) ELSE line END")
    if single(whole):  # each is labelled where it lies
        lines = F.transform(F.split("text", "\n"), lambda line, n: F.when((F.col("doc_id") + n) % 9 == 0, F.concat(F.lit("Table "), F.col("doc_id") % 50, F.lit(": "), line)).when((F.col("doc_id") + n) % 9 == 4, F.concat(F.lit("Figure "), n, F.lit("a. "), line)).otherwise(line))
        return whole.where("text is not null").select("doc_id", F.lit(1).alias("page"), F.array_join(lines, "\n").alias("text"))
    cut = whole.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", line)
    return cut.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text")).select("doc_id", F.lit(1).alias("page"), "text")


TOKENS = r"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[a-zA-Z0-9]+(?:[._+\-][a-zA-Z0-9]+)*'), lambda x: lower(x)), lambda x: length(x) > {n})"


def tokens(c: str, n: int = 1) -> str:
    return TOKENS.replace("{c}", c).replace("{n}", str(n))


QUESTIONS = "q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS question, text AS passage FROM benchmark)"
GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id, 1::BIGINT AS page FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
POSTINGS = f"""{QUESTIONS},
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tokens('question')}) AS term FROM q) GROUP BY ALL),
pg AS (SELECT doc_id, 1::BIGINT AS page, {tokens('text')} AS tokens FROM documents),
dl AS (SELECT doc_id, page, tokens, len(tokens) AS dl FROM pg WHERE len(tokens) > 0),
tot AS (SELECT count(*) AS n, sum(dl) / greatest(count(*), 1) AS avgdl FROM dl),
po AS (SELECT doc_id, page, dl, term, count(*) AS tf FROM (SELECT doc_id, page, dl, unnest(tokens) AS term FROM dl) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term)"""
SCORES = f"""{POSTINGS},
sc AS (SELECT query_id, doc_id, page, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1e-9))) * qf), 9) AS score
  FROM qt JOIN df USING (term) JOIN po USING (term), tot GROUP BY ALL)"""


def top(k: int) -> str:
    return f"""{SCORES},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


PAGES = """li AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
pages8 AS (SELECT doc_id, n // 8 + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM li GROUP BY ALL)"""
GOLD_PAGES = "goldp AS (SELECT b.item_id AS query_id, doc_id, page FROM pages8 JOIN benchmark b ON contains(pages8.text, b.text))"


def paged(sql: str) -> str:
    """SQL over pages of eight lines in place of whole documents."""
    return f"{PAGES}, " + sql.replace(f"pg AS (SELECT doc_id, 1::BIGINT AS page, {tokens('text')} AS tokens FROM documents)", f"pg AS (SELECT doc_id, page, {tokens('text')} AS tokens FROM pages8)")


VECTORS = "v AS (SELECT vec_id, vec_id // 4 AS doc_id, vec_id % 4 + 1 AS page, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"
UNIT = "u AS (SELECT vec_id, doc_id, page, label, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y * y))), 1e-12)) AS v FROM v)"
DENSE = f"""{VECTORS}, {UNIT},
ds AS (SELECT q.vec_id AS query_id, u.doc_id, u.page, round(list_dot_product(q.v, u.v), 9) AS score FROM u JOIN u q ON q.vec_id % 50 = 0)"""


def dense_top(k: int) -> str:
    return f"{DENSE}, dt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page) AS rank FROM ds QUALIFY rank <= {k})"


ANSWERS = """a0 AS (SELECT o_orderkey AS query_id, o_custkey AS cust, o_totalprice::DECIMAL(18,2) AS amt, o_orderpriority AS prio FROM orders),
a AS (SELECT query_id,
  CASE query_id % 5 WHEN 0 THEN concat('$', amt, ' million') WHEN 1 THEN concat(amt, '%') WHEN 2 THEN concat('Customer ', cust, ' Holdings Ltd reported revenue') WHEN 3 THEN concat('The total was ', cust, ' stores and ', query_id, ' employees') ELSE concat('priority ', prio) END AS expected,
  CASE query_id % 7 WHEN 0 THEN 'NOT FOUND' WHEN 1 THEN concat(amt + 1, ' million USD.') WHEN 2 THEN concat('about ', amt, '%') WHEN 3 THEN concat('customer ', cust, ' revenue of ', amt) WHEN 4 THEN concat(cust, ' stores, ', query_id, ' employees in total') WHEN 5 THEN concat('Priority: ', prio) ELSE '' END AS generated,
  CASE query_id % 4 WHEN 0 THEN 'text-only' WHEN 1 THEN 'multimodal-t' WHEN 2 THEN 'multimodal-f' ELSE 'meta-data' END AS qtype,
  (query_id % 97)::DOUBLE / 10 + 0.5 AS latency FROM a0)"""
ASKED = """k AS (SELECT o_orderkey AS query_id,
  CASE o_orderkey % 8 WHEN 0 THEN concat('What is the total revenue in Table ', o_custkey, '?') WHEN 1 THEN concat('Which line in Fig. ', o_custkey % 9, 'b is highest?') WHEN 2 THEN 'Which chart shows the accuracy score' WHEN 3 THEN 'What does the table row say about the plot' WHEN 4 THEN concat('How many employees in ', 1990 + o_custkey % 30) WHEN 5 THEN 'Which function is called' WHEN 6 THEN 'What is the cost/value of assets' ELSE 'Who wrote the report' END AS question,
  CASE o_orderkey % 3 WHEN 0 THEN 'text-only' WHEN 1 THEN 'multimodal-t' ELSE 'multimodal-f' END AS qtype FROM orders)"""
CAPTIONED = """cl AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
cx AS (SELECT doc_id, 1::BIGINT AS page, n, CASE (doc_id + n) % 9 WHEN 0 THEN concat('Table ', doc_id % 50, ': ', line) WHEN 4 THEN concat('Figure ', n, 'a. ', line) ELSE line END AS line FROM cl),
cz AS (SELECT doc_id, page, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM cx),
ln AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, line FROM cz WHERE line <> '')"""
