"""Plans of a search by what is there to search with, and the hybrid run of questions (RET12, ORC9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intent as I
from ..sources.shared import written
from .index import LexicalIndex
from .ranking import neighbours_in_order, rrf
from .retrieval import cascade, dense_search, query_terms
from .serving import metadata_answers

FOUND = ["query_id", "doc_id", "page", "score", "rank"]


@dataclass
class Searchers:
    """What may be searched: a lexical index, and vectors of its documents with those of the questions.

    Questions are (query_id, question); vectors (doc_id, page, vec); asked (query_id, vec). Without vectors the
    encoder isn't ready. `active` names the modules that a fused search takes."""

    lexical: LexicalIndex | None = None
    vectors: DataFrame | None = None
    asked: DataFrame | None = None
    candidates: int = 100
    active: Sequence[str] = ("bm25", "encoder")

    @property
    def ready(self) -> bool:
        return self.vectors is not None and self.asked is not None and self.lexical is not None

    def bm25(self, questions: DataFrame, k: int) -> DataFrame:
        return self.lexical.search(query_terms(questions), k).select(*FOUND)

    def cascade(self, questions: DataFrame, k: int) -> DataFrame:
        """RET9: the encoder orders the lexical candidates."""
        first = self.bm25(questions, self.candidates)
        return cascade(first, self.asked, self.vectors, k).select(*FOUND)

    def semantic(self, questions: DataFrame, k: int) -> DataFrame:
        return dense_search(self.asked.join(questions.select("query_id"), "query_id", "left_semi"), self.vectors, k, "half").select(*FOUND)

    def resolve(self, strategy: str | Sequence[str]) -> str:
        """The plan that a strategy comes to: auto and cascade need an encoder that is ready, else they are bm25_only."""
        if strategy in ("auto", "cascade"):
            return "cascade" if self.ready else "bm25_only"
        return strategy if strategy in ("bm25_only", "encoder_only") else "fusion"

    def search(self, questions: DataFrame, k: int = 5, strategy: str | Sequence[str] = "auto") -> DataFrame:
        """(query_id, doc_id, page, score, rank, strategy). all, another name, or a list of modules: 3 k results of each
        module, fused by reciprocal ranks; modules that aren't there give none."""
        plan = self.resolve(strategy)
        if plan == "fusion":
            names = [n for n in self.active if isinstance(strategy, str) or n in strategy]
            made = {"bm25": self.bm25 if self.lexical is not None else None, "encoder": self.cascade if self.ready else None}
            lists = [made[n](questions, 3 * k) for n in names if made.get(n)]
            out = rrf(lists, top=k) if lists else None
        else:
            make = {"cascade": self.cascade, "bm25_only": self.bm25 if self.lexical is not None else None, "encoder_only": self.semantic if self.ready else None}[plan]
            out = make(questions, k) if make else None
        if out is None:
            kind = questions.schema["query_id"].dataType.simpleString()
            out = questions.sparkSession.createDataFrame([], f"query_id {kind}, doc_id long, page int, score double, rank int")
        return out.select(*FOUND).withColumn("strategy", F.lit(plan))


def hybrid_run(questions: DataFrame, pages: DataFrame, searchers: Searchers, text_k: int = 5, first_k: int = 10, radius: int = 1) -> DataFrame:
    """ORC9: a row a question: (query_id, pipeline_used, route_subtype, tool_used, answer, pages, doc_hit_at_1, doc_hit_at_5, error).

    questions: (query_id, question, qtype, doc_id), doc_id the expected document, read once. Text questions are answered
    by a metadata tool where one applies, from the page they name, or from BM25 inside their document; the others from pages
    near in the encoder's space, with neighbours, as many as their type takes. `pages` lists doc:page in order. What
    can't be run is a row with its reason: unsupported_type, no_document, no_pages, no_query_vector."""
    asked = written(questions.select("query_id", "question", "qtype", "doc_id", I.pipeline_of(F.col("qtype")).alias("pipe"), I.context_pages(F.col("question"), F.col("qtype")).alias("most")), "questions")
    text, other = asked.where("pipe = 'text'"), asked.where("pipe = 'multimodal'")
    tools = written(metadata_answers(text, pages), "tools")
    given = tools.where("answer is not null or page is not null")
    direct = given.where("tool = 'page_direct'").join(text.select("query_id", "doc_id"), "query_id").select("query_id", "doc_id", "page", F.lit(1).alias("rank"))
    search = text.join(given.select("query_id"), "query_id", "left_anti").where("doc_id is not null")
    scoped = searchers.lexical.search(query_terms(search.select("query_id", "question")), text_k, scope=search.select("query_id", "doc_id"))
    vectors = searchers.asked.join(other.select("query_id"), "query_id", "left_semi")
    near = neighbours_in_order(dense_search(vectors, searchers.vectors, first_k), searchers.vectors, radius)
    near = near.join(other.select("query_id", "most"), "query_id").where(F.col("rank") <= F.col("most"))
    found = direct.unionByName(scoped.select("query_id", "doc_id", "page", "rank")).unionByName(near.select("query_id", "doc_id", "page", "rank"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "page")))  # a question's few pages
    found = found.groupBy("query_id").agg(listed.alias("found"))
    out = asked.join(tools.select("query_id", "tool", "answer", F.col("page").alias("tool_page")), "query_id", "left").join(found, "query_id", "left").join(vectors.select("query_id", F.lit(True).alias("encoded")), "query_id", "left")
    held, is_text, used = F.coalesce(F.size("found"), F.lit(0)), F.col("pipe") == "text", F.col("answer").isNotNull() | F.col("tool_page").isNotNull()
    hit = lambda k: F.when(F.col("doc_id").isNotNull(), F.exists(F.slice(F.coalesce("found", F.array()), 1, k), lambda x: x["doc_id"] == F.col("doc_id")).cast("int"))
    visual = F.col("pipe") == "multimodal"
    error = F.when(~is_text & ~visual, "unsupported_type").when(is_text & F.col("doc_id").isNull(), "no_document").when(is_text & F.col("answer").isNull() & (held == 0), "no_pages").when(visual & F.col("encoded").isNull(), "no_query_vector").when(visual & (held == 0), "no_pages")
    labels = F.array_join(F.transform(F.coalesce("found", F.array()), lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["page"].cast("string"))), ",")
    return out.select("query_id", F.when(is_text, "text_bm25").when(visual, "multimodal").alias("pipeline_used"), F.when(visual, "visual").when(~is_text, None).when(F.coalesce(used, F.lit(False)), F.col("tool")).otherwise("bm25").alias("route_subtype"), F.when(F.coalesce(used, F.lit(False)), F.col("tool")).alias("tool_used"), "answer", labels.alias("pages"), hit(1).alias("doc_hit_at_1"), hit(5).alias("doc_hit_at_5"), error.alias("error"))
