"""One object with the library's tools: each method validates its input, builds a plan and returns rows or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import table
from .functions import text as T
from .operators import analytics, auditing, excerpts, fulltext, governance, integrity, learning, maintenance, overlap, search, services
from .operators.embedding import Embedder, HashEmbedder
from .sources import cache, export, reports
from .sources.library import NOW, Library, files_stamp
from .sources.store import Store


class InputError(ValueError):
    """An argument outside its bounds."""


def check_query(query: str) -> str:
    query = (query or "").strip()
    if not 2 <= len(query) <= 500:
        raise InputError("a query has 2 to 500 characters")
    return query


def clamp(value, low, high):
    return max(low, min(high, value))


#: Frames that a Tools object keeps persisted at most.
CACHED_FRAMES = 16


class Tools:
    """embedder: turns texts into vectors like those stored; without it, semantic methods take vectors only, and excerpts
    are chosen by hashed words. store: where reading marks, bookmarks, titles and decisions are kept; without it the
    methods that write raise InputError."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, store: Store | None = None):
        self.spark, self.lib, self.embedder, self.store = spark, Library(spark, folder), embedder, store
        self.cache = cache.frames(CACHED_FRAMES)

    # -- books and chapters

    def list_books(self) -> DataFrame:
        return self.lib.books.orderBy("title")

    def get_book_info(self, book_id: str) -> DataFrame:
        return self.lib.books.filter(F.col("id") == book_id)

    def get_table_of_contents(self, book_id: str) -> DataFrame:
        return self.lib.chapters.filter(F.col("book_id") == book_id).select("chapter_number", "title", "word_count").orderBy("chapter_number")

    def get_chapter(self, book_id: str, chapter_number: int, max_tokens: int | None = None) -> str:
        if not 1 <= chapter_number <= 1000:
            raise InputError("chapter numbers are 1 to 1000")
        text = T.truncate_tokens(F.col("content"), max_tokens) if max_tokens else F.col("content")
        one = self.lib.numbers.filter((F.col("book_id") == book_id) & (F.col("chapter_number") == chapter_number)).select("id")
        row = self.lib.chapters_at(one).select(text.alias("t")).first()
        if row is None:
            raise LookupError(f"{book_id} has no chapter {chapter_number}")
        return row.t

    def search_titles(self, query: str, limit: int = 10) -> DataFrame:
        return services.search_titles(self.lib.books, check_query(query), ("title", "author"), clamp(limit, 1, 50))

    # -- search

    def text_search(self, query: str, limit: int = 10, book_id: str | None = None) -> DataFrame:
        """Stemmed full-text search with snippets; the stored index follows the texts' files."""
        where = self.lib.numbers.filter(F.col("book_id") == book_id).select("id") if book_id else None
        index = self.lib.index(stemmed=True)
        try:
            found = index.search(check_query(query), clamp(limit, 1, 50), where)
        except ValueError as e:
            raise InputError(str(e)) from e
        found = self.spark.createDataFrame(found.collect(), found.schema)  # at most 50 rows, which both joins need
        rows = self.lib.chapters_at(found).select("id", "book_id", "chapter_number", "title", "content").join(F.broadcast(found), "id")
        terms = [t for leaf, _ in fulltext.Query(query, index.analyse).leaves for t in leaf]
        return fulltext.with_snippets(rows, terms).drop("content").orderBy(F.desc("score"), "id")

    def _vector(self, query: str | list[float]) -> list[float]:
        if isinstance(query, str):
            if self.embedder is None:
                raise InputError("no embedder is set: give a vector")
            return [float(x) for x in self.embedder([check_query(query)])[0]]
        return query

    def _named(self, found: DataFrame) -> DataFrame:
        """Search results (at most 100) with the numbers, titles and texts of their chapters."""
        found = self.spark.createDataFrame(found.collect(), found.schema)
        c = self.lib.chapters_at(found.select(F.col("chapter_id").alias("id"))).select(F.col("id").alias("chapter_id"), "chapter_number", F.col("title").alias("chapter_title"), "content")
        return c.join(F.broadcast(found), "chapter_id")

    def relevant_excerpts(self, found: DataFrame, query: str | list[float], max_chars: int = 500) -> DataFrame:
        """Search results with the paragraph of each chapter that is most like the query."""
        embedder = self.embedder or HashEmbedder()
        vector = self._vector(query) if self.embedder else embedder([query])[0] if isinstance(query, str) else query
        return excerpts.relevant_excerpts(self._named(found), vector, embedder, max_chars).drop("content")

    def semantic_context(self, query: str, vector: list[float] | None = None) -> str:
        """Numbered blocks of text for a prompt: the three best chapters of at least 0.4."""
        found = search.search_chapters(self.lib.search_rows, vector or self._vector(query), 3, 0.4)
        return excerpts.rag_context(query, self.relevant_excerpts(found, query))

    def semantic_search(self, query: str | list[float], limit: int = 5, min_similarity: float = 0.3) -> DataFrame:
        return search.search_chapters(self.lib.search_rows, self._vector(query), clamp(limit, 1, 20), clamp(min_similarity, 0.0, 1.0))

    def search_all_books(self, query: str | list[float], max_per_book: int = 5, min_similarity: float = 0.3) -> DataFrame:
        return search.per_book(self.lib.search_rows, self._vector(query), clamp(max_per_book, 1, 20), min_similarity)

    def hybrid_search(self, words: str, vector: list[float], limit: int = 10, min_similarity: float = 0.2, diverse: bool = False, weight: float = 0.7) -> tuple[DataFrame, dict[str, int]]:
        """(results with excerpts, how many came from each list). diverse: chapters that repeat better ones come later."""
        n = clamp(limit, 1, 20)
        kw = search.ranked(self.lib.index(stemmed=True).search(check_query(words), min(50, 3 * n)).withColumnRenamed("id", "chapter_id"), "score")
        best = search.best_per(search.top_chunks(self.lib.search_rows, vector, 3 * n, min_similarity), "chapter_id")
        fused = search.rrf(kw, search.ranked(best, "similarity")).orderBy(F.desc("rrf_score"), "chapter_id").limit(5 * n)
        rows = fused.collect()  # at most 100
        stats = {"fts": sum(r.fts_pos is not None for r in rows), "semantic": sum(r.semantic_pos is not None for r in rows), "both": sum(r.fts_pos is not None and r.semantic_pos is not None for r in rows)}
        kept = self.spark.createDataFrame(rows, fused.schema)
        if diverse:
            own = self.lib.search_rows.join(F.broadcast(kept.select("chapter_id", "rrf_score")), "chapter_id").filter("embedding IS NOT NULL")
            first = search.best_per(own.withColumn("similarity", F.col("rrf_score")), "chapter_id").select(F.lit(0).cast("long").alias("query_id"), F.col("chapter_id").alias("id"), "similarity", "embedding")
            kept = search.mmr(first, weight, n).select(F.col("id").alias("chapter_id"), "place").join(kept, "chapter_id")
            return self.relevant_excerpts(kept, words).orderBy("place"), stats
        return self.relevant_excerpts(kept.orderBy(F.desc("rrf_score"), "chapter_id").limit(n), words).orderBy(F.desc("rrf_score"), "chapter_id"), stats

    def find_related_content(self, chapter_id: int, limit: int = 5) -> DataFrame:
        row = self.lib.search_rows.filter((F.col("chapter_id") == chapter_id) & F.col("embedding").isNotNull()).orderBy("id").select("embedding", "book_id").first()
        if row is None:
            raise LookupError(f"chapter {chapter_id} has no vector")
        return search.search_chapters(self.lib.search_rows, list(row[0]), clamp(limit, 1, 20), 0.2, rerank=True, where=F.col("book_id") != row[1])

    def get_topic_coverage(self, query: str | list[float], min_similarity: float = 0.3, limit: int = 20) -> DataFrame:
        return search.topic_coverage(self.lib.search_rows, self._vector(query), clamp(min_similarity, 0.0, 1.0)).orderBy(F.desc("chapters"), "book_id").limit(clamp(limit, 1, 50))

    def find_duplicate_coverage(self, similarity_threshold: float = 0.7, max_results: int = 50) -> DataFrame:
        """The best pairs of chapters of different books, by topic; topics with three pairs or more are marked."""
        c = self.lib.chapters.select("id", "title")
        return overlap.duplicate_coverage(self.lib.search_rows, c, clamp(similarity_threshold, 0.5, 0.95), clamp(max_results, 1, 1000)).orderBy(F.desc("overlap_count"), "topic", "place")

    # -- analytics

    def get_cache_stats(self) -> dict:
        """Hits, misses and what is held of the frames that the analytics share."""
        return self.cache.stats()

    def clear_cache(self, name: str | None = None) -> int:
        return self.cache.clear(name)

    def _rollup(self) -> DataFrame:
        """The roll-up by book, which several tools begin with: kept until the files of its tables change."""
        version = tuple(files_stamp(self.spark, f"{self.lib.folder}/{t}.parquet") for t in ("documents", "embeddings"))
        return self.cache.get("book_rollup", version, self._made_rollup)

    def _made_rollup(self) -> DataFrame:
        return analytics.book_rollup(self.lib.chapters, self.lib.chunks.select("chapter_id").distinct())

    def get_library_statistics(self) -> DataFrame:
        return analytics.totals(self._rollup())

    def library_status(self) -> DataFrame:
        return analytics.library_status(self._rollup())

    def get_author_insights(self, author_name: str = "") -> DataFrame:
        rows = analytics.author_rollup(self._rollup(), self.lib.books)
        return rows.filter(F.col("author").ilike(f"%{T.like_escape(author_name)}%")) if author_name else rows

    def get_reading_progress(self) -> DataFrame:
        return analytics.reading_books(self.lib.chapters, self.lib.reading)

    def get_bookmarks(self) -> DataFrame:
        return self.lib.reading.filter("toxic = 1").select("chapter_id", "book_id", "chapter_number")

    def audit_chapter_quality(self, severity: str = "all") -> DataFrame:
        rows = auditing.chapter_audit(self.lib.chapters)
        wanted = {"all": ("ok", "warning", "bad"), "warning": ("warning", "bad"), "bad": ("bad",)}
        if severity not in wanted:
            raise InputError("severity: all, warning or bad")
        return rows.filter(F.col("severity").isin(*wanted[severity]))

    def library_doctor(self, book_types: DataFrame, profiles: DataFrame, valid: tuple[str, ...]) -> DataFrame:
        """category, n, fixable of the integrity checks. book_types: id, book_type. profiles: id, book_type."""
        c = self.lib.chapters
        return services.findings({
            "orphaned_chunks": (integrity.orphan_chunks(self.lib.chunks.select("id", "chapter_id"), c.select("id")), F.lit(True)),
            "null_content_hash": (integrity.null_hashes(c.select("id", "content", "content_hash")), F.col("content").isNotNull()),
            "null_book_type": (services.null_types(book_types, profiles, valid), F.col("fixable")),
        })

    def audit_report(self, kind: str, folder: str | None = None, severity: str = "all") -> str | None:
        """The chapter audit as a text table (kind "table"), or written as CSV or JSON below folder."""
        rows = self.audit_chapter_quality(severity)
        if kind == "table":
            return reports.text_table(rows)
        reports.write_report(rows, folder, kind)
        return None

    # -- marks, kept in the store

    def _kept(self) -> Store:
        if self.store is None:
            raise InputError("no store is set")
        return self.store

    def _chapter(self, book_id: str, chapter_number: int) -> DataFrame:
        if not 1 <= chapter_number <= 1000:
            raise InputError("chapter numbers are 1 to 1000")
        row = self.lib.numbers.filter((F.col("book_id") == book_id) & (F.col("chapter_number") == chapter_number)).select("book_id", "chapter_number", F.col("id").alias("chapter_id"))
        if row.isEmpty():
            raise LookupError(f"{book_id} has no chapter {chapter_number}")
        return row

    def mark(self, book_id: str, chapter_number: int, status: str, now: str = NOW) -> int:
        """Set the reading status of a chapter: unread, reading or read. The new version of the table."""
        if status not in ("unread", "reading", "read"):
            raise InputError("status: unread, reading or read")
        row = self._chapter(book_id, chapter_number).select("book_id", "chapter_number", "chapter_id", F.lit(status).alias("status"), F.to_timestamp(F.lit(now)).alias("updated_at"))
        return self._kept().upsert("reading_marks", row, "book_id", "chapter_number")

    def add_bookmark(self, book_id: str, chapter_number: int, note: str = "", now: str = NOW) -> int:
        """One bookmark a chapter: a second one replaces its note."""
        if len(note) > 1000:
            raise InputError("a note has at most 1000 characters")
        row = self._chapter(book_id, chapter_number).select("book_id", "chapter_number", "chapter_id", F.lit(note).alias("note"), F.to_timestamp(F.lit(now)).alias("created_at"))
        return self._kept().upsert("bookmarks", row, "book_id", "chapter_number")

    def remove_bookmark(self, book_id: str, chapter_number: int) -> int:
        return self._kept().delete("bookmarks", (F.col("book_id") == book_id) & (F.col("chapter_number") == chapter_number))

    def bookmarks(self, book_id: str | None = None) -> DataFrame:
        rows = self._kept().read("bookmarks")
        return (rows if book_id is None else rows.filter(F.col("book_id") == book_id)).orderBy(F.desc("created_at"), "book_id", "chapter_number")

    def reading_marks(self) -> DataFrame:
        return self._kept().read("reading_marks")

    def update_title(self, book: str, chapter_number: int, new_title: str) -> int:
        """A chapter's new title, kept apart from the texts; several books of that name are an error."""
        found, near = services.resolve_book(self.lib.books.select("id", "title"), book)
        one = found.first()
        if one is None:
            raise LookupError(f"no book {book!r}; near it: {', '.join(r.title for r in near.collect())}")
        row = self._chapter(one.id, chapter_number).select("book_id", "chapter_number", F.lit(new_title).alias("new_title"))
        return self._kept().upsert("titles", row, "book_id", "chapter_number")

    def chapters(self) -> DataFrame:
        """The chapters with the titles set by update_title."""
        c = self.lib.chapters
        return services.retitle(c, self.store.read("titles")) if self.store and self.store.exists("titles") else c

    # -- approvals, kept in the store

    def decide(self, requests: DataFrame, pipelines: DataFrame, thresholds: DataFrame, mode: str = "supervised", now: str = NOW, **policy) -> DataFrame:
        """Approve, reject, retry or roll back: the outcomes of all requests. Audit rows are stored before the new states."""
        store, decided = self._kept(), services.decisions(pipelines, requests, thresholds, mode, **policy)
        version = store.write("decisions", decided)
        decided = store.read("decisions", version)
        store.append("audit", services.audit_rows(decided, now), f"{version:09d}")
        store.write("pipelines", services.apply_decisions(pipelines, decided))
        return decided

    def audit_log(self, **conditions) -> DataFrame:
        rows = self._kept().read("audit").withColumn("id", F.xxhash64("pipeline_id", "action", "performed_at"))
        return services.audit_trail(rows, **conditions)

    # -- texts

    def get_summary(self, chapter_id: int) -> str:
        row = learning.extractive_summary(self.lib.chapters.filter(F.col("id") == chapter_id)).first()
        return row.summary if row else ""

    def summarize_book(self, book_id: str, chapters: int = 50) -> str:
        """Markdown: the summary of each of the first chapters of a book."""
        own = self.lib.chapters.filter(F.col("book_id") == book_id)
        sums = learning.extractive_summary(own.filter(F.col("chapter_number") <= clamp(chapters, 1, 1000)), 3)
        rows = own.select("id", "chapter_number", "title").join(sums, "id").orderBy("chapter_number").collect()  # at most 1000
        return "\n\n".join(f"## {r.chapter_number}. {r.title}\n\n{r.summary}" for r in rows)

    def get_chapter_sections(self, chapter_id: int, threshold: int = 5000) -> DataFrame:
        return maintenance.split_sections(self.lib.chapters.filter(F.col("id") == chapter_id).select("id", "content"), threshold)

    def language_counts(self, chapter_id: int) -> DataFrame:
        return services.language_counts(learning.code_blocks(self.lib.chapters.filter(F.col("id") == chapter_id)))

    def export_rows(self, book_id: str | None = None) -> DataFrame:
        """Chapters in order of book and number, the first of each book marked as its header; for sources.export."""
        rows = self.chapters() if book_id is None else self.chapters().filter(F.col("book_id") == book_id)
        return export.ordered(rows, self.lib.books)

    def extract_code_examples(self, chapter_id: int, language: str = "") -> DataFrame:
        """at, language, format, code, context, line_count: fenced blocks, Dockerfiles, shell lines and docker commands."""
        table.register(self.spark)
        one = self.lib.chapters_at(self.spark.createDataFrame([(chapter_id,)], "id long")).select("content")
        rows = self.spark.sql("SELECT x.* FROM {one}, LATERAL quire_code(content) x", one=one)
        return rows.filter(F.col("language") == language.lower()) if language else rows

    def create_study_guide(self, chapter_id: int) -> str:
        """Markdown: summary, concepts as questions, and the reading time at 200 words a minute. One chapter."""
        one = self.lib.chapters.filter(F.col("id") == chapter_id)
        row = one.select("title", "word_count").first()
        if row is None:
            raise LookupError(f"no chapter {chapter_id}")
        cards = [f"- {r.question}" for r in learning.flashcards(learning.bold_terms(one)).limit(20).collect()]
        return "\n".join([f"# {row.title}", "", f"Reading time: {row.word_count // 200} min", "", self.get_summary(chapter_id), "", *cards])

    # -- pipeline

    def health(self, now: str = NOW) -> DataFrame:
        return governance.health(self.lib.pipelines, now)

    def stuck(self, now: str = NOW) -> DataFrame:
        return governance.stuck(self.lib.pipelines, now)

    def queue(self, limit: int = 20) -> DataFrame:
        return governance.worker_queue(self.lib.pipelines, clamp(limit, 1, 500))

    def latest_transitions(self, each: int = 1) -> DataFrame:
        w = Window.partitionBy("pipeline_id").orderBy(F.desc("created_at"), F.desc("id"))
        return self.lib.history.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= each).drop("r")
