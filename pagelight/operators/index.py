"""A lexical index that is kept: build, append, delete, compact, search (ORC11)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import hadoop_path, written
from .ranking import top_k
from .retrieval import few, small

MANIFEST = "segment int, base boolean, buckets int, parts int, pages long, tokens long, adds boolean, removes boolean"
PAGES_A_PART = 1_000_000
TOKENS_A_BUCKET = 3_000_000  # about; a bucket is sorted by one task
BYTES_AT_ONCE, TOKENS_A_BLOCK = 4_000_000, 3_000_000  # about; of the texts that are cut into words and counted together
TOKENS_AT_ONCE, PAGES_AT_ONCE = 2_000_000, 20_000  # about; of the pages that one task scores
SLACK = 2e-9  # scores are rounded to nine digits after the tasks, so what lies this near to a k-th best stays
POSTING = ("doc_id", "page", "dl", "tf")
KIND = np.array([1 if chr(b).isalnum() and b < 128 else 2 if chr(b) in "._+-" else 0 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class LexicalIndex:
    """An index of (doc_id, page, text) in a folder: segments, each written once, and a manifest a segment.

    A segment holds `pages` (doc_id, page, dl, words), `postings` (term, part, and arrays doc_id, page, dl, tf of pages
    that were read together), bucketed by term and part, `terms` (term, df), and `dead` (doc_id, page): pages of earlier
    segments that it removes, whose terms it counts with a minus in its own `terms`. Sums over segments so are those of
    the live pages, and a search reads postings and terms, never a text. Part is a share of such groups of pages by hash,
    one in PAGES_A_PART, so the postings of a term that all pages hold fill several buckets.

    A manifest is written after all else of its segment; what a failed job leaves behind is not seen. There may be
    one writer at a time. A page is known by doc_id and page: appending a known one replaces it. Pages without tokens
    aren't kept. Pages of null doc_id or page are kept and found, but can't be replaced or deleted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            rows = spark.read.schema(MANIFEST).json(f"{self.path}/manifest/*").collect()  # a row a segment
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        rows = sorted(rows, key=lambda r: r.segment)
        first = max((r.segment for r in rows if r.base), default=0)
        self.stale = [r for r in rows if r.segment < first]
        self.segments = [r for r in rows if r.segment >= first]

    # -- parts of a segment

    def _at(self, segment: int, what: str) -> str:
        return f"{self.path}/segment={segment:06d}/{what}"

    def _pages(self, segment: int) -> DataFrame:
        pages = self.spark.read.parquet(self._at(segment, "pages"))
        return pages.select("doc_id", "page", "dl", F.split("words", " ").alias("tokens"), F.lit(segment).alias("segment"))

    def _postings(self, row) -> DataFrame:
        """Postings as a bucketed table, so that a join on term and part shuffles the other side alone."""
        path = self._at(row.segment, "postings")
        name = f"pagelight_{hashlib.md5(path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (term, part) SORTED BY (term) INTO {row.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _alive(self, df: DataFrame, segment: int) -> DataFrame:
        """Rows of a segment whose pages no later one removes."""
        for later in self.segments:
            if later.removes and later.segment > segment:
                dead = self.spark.read.parquet(self._at(later.segment, "dead"))
                df = df.join(F.broadcast(dead) if few(dead) else dead, ["doc_id", "page"], "left_anti")
        return df

    def pages(self) -> DataFrame:
        """(doc_id, page, dl, tokens, segment) of all live pages."""
        parts = [self._alive(self._pages(r.segment), r.segment) for r in self.segments if r.adds]
        return _union(parts) if parts else self.spark.createDataFrame([], "doc_id long, page long, dl int, tokens array<string>, segment int")

    @property
    def size(self) -> int:
        return sum(r.pages for r in self.segments)

    @property
    def totals(self) -> DataFrame:
        """One row (n, avgdl)."""
        n = self.size
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(sum(r.tokens for r in self.segments) / max(n, 1)).alias("avgdl"))

    @property
    def frequencies(self) -> DataFrame:
        """(term, df) of all live pages."""
        parts = [self.spark.read.parquet(self._at(r.segment, "terms")) for r in self.segments]
        parts = parts or [self.spark.createDataFrame([], "term string, df long")]
        return _union(parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _frequencies_of(self, terms: DataFrame) -> DataFrame:
        """frequencies of the terms of a table (term, ...); if they are few, no other term is shuffled, and what is found is broadcast."""
        asked = terms.select("term").distinct()
        hint = F.broadcast if few(asked) else lambda df: df
        parts = [self.spark.read.parquet(self._at(r.segment, "terms")).join(hint(asked), "term", "left_semi") for r in self.segments]
        return hint(_union(parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if parts else self.frequencies)

    # -- changes

    def build(self, corpus: DataFrame, buckets: int | None = None) -> LexicalIndex:
        """Index a corpus (doc_id, page, text) anew; what the folder held before becomes stale."""
        return self._add(_tokenised(corpus), base=True, buckets=buckets)

    def append(self, corpus: DataFrame) -> LexicalIndex:
        """Add pages; ones that are there already are replaced."""
        return self._add(_tokenised(corpus), base=not self.segments)

    def delete(self, keys: DataFrame) -> LexicalIndex:
        """Remove pages by (doc_id, page), or all pages of documents by (doc_id)."""
        on = [c for c in ("doc_id", "page") if c in keys.columns]
        segment = self._next()
        if self.segments:
            gone = self._bury(segment, keys.select(*on), on)
            if gone.pages:
                self._commit(segment, base=False, removes=True, adds=False, pages=-gone.pages, tokens=-gone.tokens)
        return LexicalIndex(self.spark, self.path)

    def compact(self) -> LexicalIndex:
        """All live pages in one segment, the others stale."""
        return self._add(self.pages().select("doc_id", "page", "dl", F.array_join("tokens", " ").alias("words")), base=True, buckets=self.segments[-1].buckets if self.segments else None)

    def vacuum(self) -> LexicalIndex:
        """Delete stale segments' files. No search of before the compaction may be running."""
        for r in self.stale:
            for what in (f"{self.path}/manifest/{r.segment:06d}", f"{self.path}/segment={r.segment:06d}"):
                p, store = hadoop_path(self.spark, what)
                store.delete(p, True)
        return LexicalIndex(self.spark, self.path)

    def _next(self) -> int:
        return max((r.segment for r in [*self.stale, *self.segments]), default=0) + 1

    def _bury(self, segment: int, keys: DataFrame, on: list[str], to: str = "terms"):
        """Write the live pages under some keys as dead, and their terms with a minus; how many pages and tokens they are."""
        keys = keys.distinct()
        found = self.pages().join(keys, on, "left_semi").where("doc_id is not null and page is not null")
        found.select("doc_id", "page", "dl", F.array_distinct("tokens").alias("terms")).write.mode("overwrite").parquet(self._at(segment, "buried"))
        buried = self.spark.read.parquet(self._at(segment, "buried"))
        buried.select("doc_id", "page").distinct().write.mode("overwrite").parquet(self._at(segment, "dead"))
        buried.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).write.mode("overwrite").parquet(self._at(segment, to))
        return buried.agg(F.count("*").alias("pages"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()

    def _add(self, pages: DataFrame, base: bool, buckets: int | None = None) -> LexicalIndex:
        spark, segment = self.spark, self._next()
        pages.select("doc_id", "page", "dl", "words").write.mode("overwrite").parquet(self._at(segment, "pages"))
        pages = spark.read.parquet(self._at(segment, "pages"))
        new = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        old = self.segments[0] if self.segments and not base else None
        buckets = old.buckets if old else buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + new.tokens // TOKENS_A_BUCKET)
        parts = old.parts if old else 1 + new.pages // PAGES_A_PART
        gone = None if base else self._bury(segment, pages.select("doc_id", "page"), ["doc_id", "page"], "minus")
        removes = bool(gone and gone.pages)
        part = F.pmod(F.xxhash64("doc_id", "page"), F.lit(parts)).cast("int")
        kinds = dict(pages.dtypes)
        postings = pages.select(part.alias("part"), "doc_id", "page", "dl", "words").mapInArrow(_counted, f"term string, part int, doc_id array<{kinds['doc_id']}>, page array<{kinds['page']}>, dl array<int>, tf array<long>")
        if pages.groupBy("doc_id", "page", "dl").count().where("count > 1").limit(1).count():  # rows of one page
            postings = _each(postings, "term", "part").groupBy("term", "doc_id", "page", "dl").agg(F.min("part").alias("part"), F.sum("tf").alias("tf"))
            postings = postings.select("term", "part", *[F.array(c).alias(c) for c in POSTING])
        postings = postings.repartition(buckets, "term", "part")
        path = self._at(segment, "postings")
        name = f"pagelight_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        postings.write.mode("overwrite").format("parquet").bucketBy(buckets, "term", "part").sortBy("term").option("path", path).saveAsTable(name)
        counted = spark.table(name).groupBy("term").agg(F.sum(F.size("doc_id")).alias("df"))
        if removes:
            counted = counted.unionByName(spark.read.parquet(self._at(segment, "minus"))).groupBy("term").agg(F.sum("df").alias("df"))
        counted.write.mode("overwrite").parquet(self._at(segment, "terms"))
        self._commit(segment, base=base, removes=removes, adds=True, pages=new.pages - (gone.pages if gone else 0), tokens=new.tokens - (gone.tokens if gone else 0), buckets=buckets, parts=parts)
        return LexicalIndex(spark, self.path)

    def _commit(self, segment: int, buckets: int | None = None, parts: int | None = None, **row) -> None:
        first = self.segments[0] if self.segments else None
        row = (segment, row["base"], buckets or first.buckets, parts or first.parts, row["pages"], row["tokens"], row["adds"], row["removes"])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{segment:06d}")

    # -- search

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, idf: str = "plus_one", scope: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, page, score) of queries (query_id, term, qf), as Bm25.scores gives them."""
        avgdl = sum(r.tokens for r in self.segments) / max(self.size, 1)
        dl, tf = F.col("dl"), F.col("tf")
        parts = max((r.parts for r in self.segments), default=1)
        known = self._known(queries, idf)
        known = known.select("query_id", "term", "qf", "idf", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        known = F.broadcast(known) if few(queries) else known
        hits = [self._alive(_each(self._postings(r).join(known, ["term", "part"]), "query_id", "qf", "idf"), r.segment) for r in self.segments if r.adds]
        if not hits:
            return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page"), F.lit(0.0).alias("score")).limit(0)
        found = _union([h.select("query_id", "doc_id", "page", "dl", "tf", "qf", "idf") for h in hits])
        if scope is not None:
            found = found.join(scope.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        return found.groupBy("query_id", "doc_id", "page").agg(F.round(F.sum(_part(F.col("idf"), tf, dl, avgdl, k1, b) * F.col("qf")), 9).alias("score"))

    def _known(self, queries: DataFrame, idf: str) -> DataFrame:
        """(query_id, term, qf, idf) of the terms of queries that live pages hold."""
        n, df = self.size, F.col("df")
        if idf == "plus_one":
            return queries.join(self._frequencies_of(queries), "term").withColumn("idf", F.log1p((n - df + 0.5) / (df + 0.5)))
        raw = F.log((n - df + 0.5) / (df + 0.5))  # Okapi: terms that most documents hold take a quarter of the mean idf of all terms
        mean = self.frequencies.agg(F.avg(raw).alias("mean_idf"))  # one row
        return queries.join(self._frequencies_of(queries), "term").crossJoin(F.broadcast(mean)).withColumn("idf", F.when(raw < 0, 0.25 * F.col("mean_idf")).otherwise(raw))

    def _best(self, queries: DataFrame, k: int, k1: float, b: float, idf: str) -> DataFrame:
        """scores() of the k best pages of each query among pages that are scored together, for few queries.

        The postings of the queries' terms are dealt by page, so a posting moves once and not once a query, and a
        page's score is made in one place. What a task is dealt is scored together, unsorted."""
        known = self._known(queries, idf).select("query_id", "term", "qf", "idf")
        asked = known.toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")])  # at most BROADCAST_ROWS
        tokens = sum(r.tokens for r in self.segments)
        held = self.spark.sparkContext.broadcast((asked, tokens / max(self.size, 1)))
        terms = F.broadcast(known.select("term").distinct())
        hits = _union([self._alive(_each(self._postings(r).join(terms, "term", "left_semi"), "term"), r.segment) for r in self.segments if r.adds])
        parts = 1 + max(tokens // TOKENS_AT_ONCE, self.size // PAGES_AT_ONCE)
        kinds = dict([*queries.dtypes, *hits.dtypes])
        hits = hits.select("term", *POSTING).repartition(parts, "doc_id", "page")
        found = hits.mapInArrow(_scoring(held, k, k1, b), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, page {kinds['page']}, score double")
        return found.withColumn("score", F.round("score", 9))

    def holding(self, terms: DataFrame) -> DataFrame:
        """terms (term, ...) with doc_id and page of the live pages that hold each."""
        parts = max((r.parts for r in self.segments), default=1)
        known = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        known = F.broadcast(known) if few(terms) else known
        hits = [self._alive(_each(self._postings(r).join(known, ["term", "part"]), *terms.columns), r.segment).select(*terms.columns, "doc_id", "page") for r in self.segments if r.adds]
        return _union(hits) if hits else terms.select(*terms.columns, F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("page")).limit(0)

    def rarest(self, texts: DataFrame, key: str) -> DataFrame:
        """(key, term): of each text (key, text) the token that the fewest live pages hold; texts without a known one have no row."""
        terms = texts.select(key, F.explode(F.array_distinct(T.bm25_tokens(F.col("text")))).alias("term"))
        return terms.join(self._frequencies_of(terms), "term").groupBy(key).agg(F.min_by("term", F.struct("df", "term")).alias("term"))

    def search(self, queries: DataFrame, k: int | None = 30, **options) -> DataFrame:
        """The k best pages of each query; only scores above 0."""
        if k is not None and options.get("scope") is None and any(r.adds for r in self.segments) and few(queries):
            scored = self._best(queries, k, **{"k1": 1.5, "b": 0.75, "idf": "plus_one", **{o: v for o, v in options.items() if o != "scope"}})
        else:
            scored = self.scores(queries, **options)
        return top_k(scored.where("score > 0"), k)


def _each(blocks: DataFrame, *columns: str) -> DataFrame:
    """Rows of arrays to a row a posting, with some columns kept."""
    return blocks.select(*columns, F.inline(F.arrays_zip(*POSTING)))


def _worded(batches):
    """Pages (doc_id, page, text) to (doc_id, page, dl, words): their T.bm25_tokens, a space between them; pages without any go."""
    for whole in batches:
        for lo, hi in _cuts(pc.binary_length(whole.column(2)).fill_null(0).to_numpy(zero_copy_only=False), BYTES_AT_ONCE):
            batch = whole.slice(lo, hi - lo)
            dl, words = _words(batch.column(2).fill_null(""))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dl, pa.int32()), words], names=["doc_id", "page", "dl", "words"]).filter(pa.array(dl > 0))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text has, and the tokens. Tokens are ASCII, so bytes will do: a run of letters and digits, and of . _ + - between two of them."""
    start = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    data = np.frombuffer(b"\n".join([*texts.cast(pa.binary()).to_pylist(), b""]), np.uint8)
    kind = KIND[data]
    keep = kind == 1
    keep[1:-1] |= (kind[1:-1] == 2) & keep[:-2] & keep[2:]
    edge = np.diff(keep.view(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a line's end follows every text, so each run ends
    many = last - first
    keep[first[many == 1]] = False
    first, last, many = (x[many > 1] for x in (first, last, many))
    of = np.searchsorted(start, first, "right") - 1
    dl = np.bincount(of, minlength=len(texts))
    small = LOWER[data]
    gap = last[:-1][of[1:] == of[:-1]]
    small[gap], keep[gap] = 32, True
    size = np.bincount(of, many, len(texts)).astype(np.int64) + np.maximum(dl - 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return dl, pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(small[keep]))


def _cuts(sizes: np.ndarray, most: int):
    """Slices of rows that hold about `most` together, or one row."""
    lo, sums = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _counted(batches):
    """Pages (part, doc_id, page, dl, words) to postings (term, part, [doc_id], [page], [dl], [tf]): a row a term of the pages read together."""
    for whole in batches:
        for lo, hi in _cuts(whole.column(3).to_numpy(), TOKENS_A_BLOCK):
            batch = whole.slice(lo, hi - lo)
            many = batch.num_rows
            terms = pc.split_pattern(batch.column(4), " ").flatten().dictionary_encode()
            at = np.repeat(np.arange(many), batch.column(3).to_numpy())
            key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * many + at, return_counts=True)
            term, at = key // many, pa.array(key % many)
            new = np.flatnonzero(np.diff(term, prepend=-1))
            ends = pa.array(np.append(new, len(term)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in (*[batch.column(c).take(at) for c in (1, 2, 3)], pa.array(tf, pa.int64()))]
            part = batch.column(0).slice(0, 1).take(pa.array(np.zeros(len(new), np.int64)))
            yield pa.record_batch([terms.dictionary.take(pa.array(term[new])), part, *lists], names=["term", "part", *POSTING])


def _scoring(held, k: int, k1: float, b: float):
    """All postings of a task's pages to the k best of them for each query, ties included, with scores above 0."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        asked, avgdl = held.value
        term = table.column("term").combine_chunks().dictionary_encode()
        place = {t: n for n, t in enumerate(term.dictionary.to_pylist())}
        code = np.zeros(table.num_rows, np.int64)
        for c in ("doc_id", "page"):
            own = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            _, first, code = np.unique(code * (table.num_rows + 1) + own, return_index=True, return_inverse=True)
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        start = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(place) + 1))
        tf, dl = (table.column(c).to_numpy()[order].astype(np.float64) for c in ("tf", "dl"))
        over, page = tf + k1 * (1 - b + b * dl / max(avgdl, 1e-9)), code[order]
        query = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        q, t, qf, idf = query.indices.to_numpy(), asked.column("term").to_pylist(), asked.column("qf").to_numpy(), asked.column("idf").to_numpy()
        out = []
        for lo, hi in zip(cut := np.flatnonzero(np.diff(q, prepend=-1)), [*cut[1:], len(q)]):
            score = np.zeros(len(first))
            for n in range(lo, hi):
                if t[n] in place:
                    rows = slice(start[place[t[n]]], start[place[t[n]] + 1])
                    score += np.bincount(page[rows], idf[n] * tf[rows] * (k1 + 1) / over[rows] * qf[n], len(first))
            there = np.flatnonzero(score > 0)
            if len(there) > k > 0:
                there = there[score[there] >= np.partition(score[there], -k)[-k] - SLACK]
            out.append((np.full(len(there), lo), first[there], score[there]))
        at, row, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best = pa.table([asked.column("query_id").take(pa.array(at)), table.column("doc_id").take(pa.array(row)), table.column("page").take(pa.array(row)), pa.array(score)], names=["query_id", "doc_id", "page", "score"])
        yield from best.combine_chunks().to_batches()

    return run


def numbered_figures(index: LexicalIndex, pages: DataFrame, questions: DataFrame, k: int = 5, deep: int = 15) -> DataFrame:
    """RET16: (query_id, doc_id, page, score, rank): for questions (query_id, question) that name a figure or table by its number,
    those of the best `deep` pages for that name whose text holds it, the first k, with the constant score 999.

    pages: (doc_id, page, text) of the index. A named figure goes before "Fig." and that before a table."""
    q = T.text_of(F.col("question"))
    number = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))
    figure = F.coalesce(number(r"[Ff]igure\s+(\d+(?:\.\d+)?(?:\([a-z]\))?)"), number(r"[Ff]ig\.?\s+(\d+(?:\.\d+)?(?:\([a-z]\))?)"))
    name = F.coalesce(F.concat(F.lit("figure "), figure), F.concat(F.lit("table "), number(r"[Tt]able\s+(\d+(?:\.\d+)?)")))
    named = questions.select("query_id", name.alias("question")).where("question is not null")
    terms = named.select("query_id", "question", F.explode(T.bm25_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    found = index.search(terms, deep)
    texts = pages.select("doc_id", "page", "text").join(small(written(found, "found")), ["doc_id", "page"]).join(small(named), "query_id")
    holds = F.contains(F.lower("text"), F.col("question"))
    kept = texts.where(holds).select("query_id", "doc_id", "page", F.lit(999.0).alias("score"), F.col("rank").alias("at"))
    return top_k(kept, k, ties=["at"]).drop("at")


def _part(idf: Column, tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-9)))


def _tokenised(corpus: DataFrame) -> DataFrame:
    kinds = dict(corpus.dtypes)
    return corpus.select("doc_id", "page", "text").mapInArrow(_worded, f"doc_id {kinds['doc_id']}, page {kinds['page']}, dl int, words string")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
