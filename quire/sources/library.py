"""The library's logical tables as views over Parquet; every column is derived lazily, so scans stay pruned."""

from __future__ import annotations

import hashlib
import os
import tempfile
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.fulltext import Index

NOW = "2024-01-31 00:00:00"
STATE_OF_EVENT = {"signup": "detected", "view": "hashing", "click": "processing", "purchase": "complete", "error": "needs_retry"}


#: Raised when indexes are stored in another way, so that older ones are not taken for new.
INDEX_FORMAT = 2
#: Stored indexes of this process, by application and contents.
_indexes: dict[tuple[str, str], Index] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names; a temporary one on a single machine only."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"file://{tempfile.gettempdir()}/quire-work-{os.getuid()}"  # the same for later sessions, which find what this one stores
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def files_stamp(spark: SparkSession, path: str) -> str:
    """Paths, lengths and times of the files of a table: another stamp means other contents."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else list(fs.listStatus(at))
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


class Library:
    """Books, chapters, chunks and pipeline records of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def chapters(self) -> DataFrame:
        d = self.table("documents")
        own = d.select(
            F.col("doc_id").alias("id"), F.col("source").alias("book_id"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
            F.col("text").alias("content"), T.word_count(F.col("text")).alias("word_count"), F.sha2("text", 256).alias("content_hash"), "lang",
        )
        # The number comes last: what is computed from the text is computed before rows move by book.
        number = F.row_number().over(Window.partitionBy("book_id").orderBy("id"))
        return own.select("id", "book_id", number.alias("chapter_number"), "title", "content", "word_count", "content_hash", "lang")

    @cached_property
    def numbers(self) -> DataFrame:
        """id, book_id, chapter_number: of all chapters, without reading a text."""
        own = self.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"))
        return own.withColumn("chapter_number", F.row_number().over(Window.partitionBy("book_id").orderBy("id")))

    def chapters_at(self, ids: DataFrame) -> DataFrame:
        """The chapters of a few ids (a column id; the results of a search), with their texts. No other text leaves its
        place: the ids are broadcast to the texts, and numbers are made of ids alone."""
        few = F.broadcast(ids.select("id").distinct())
        own = self.table("documents").withColumnRenamed("doc_id", "id").join(few, "id")
        own = own.select("id", F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("content"), T.word_count(F.col("text")).alias("word_count"), F.sha2("text", 256).alias("content_hash"), "lang")
        return own.join(F.broadcast(self.numbers.join(few, "id")), "id").select("id", "book_id", "chapter_number", "title", "content", "word_count", "content_hash", "lang")

    def index(self, stemmed: bool = False) -> Index:
        """The stored full-text index of the chapters; built when it is first asked for, and anew when the texts' files have
        changed. It lies in the work folder under a name of its own, where later sessions find it."""
        stamp = files_stamp(self.spark, f"{self.folder}/documents.parquet")
        key = hashlib.sha256(f"{INDEX_FORMAT}|{self.folder}|{stemmed}|{stamp}".encode()).hexdigest()[:24]
        if (held := _indexes.get((self.spark.sparkContext.applicationId, key))) is None:
            at = f"{work_folder(self.spark)}/quire-index-{key}"
            try:
                held = Index(self.spark, at, stemmed)
            except FileNotFoundError:
                d = self.table("documents")
                texts = d.select(F.col("doc_id").alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("content"))
                held = Index.build(texts, at, stemmed)
            _indexes[self.spark.sparkContext.applicationId, key] = held
        return held

    @cached_property
    def books(self) -> DataFrame:
        c = self.table("documents").select("source", T.word_count(F.col("text")).alias("w"))
        b = c.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("word_count"))
        author = F.concat(F.lit("Author "), (F.substring("id", 4, 10).cast("int") % 7).cast("string"))
        return b.select("id", F.concat(F.lit("Book "), "id").alias("title"), author.alias("author"), "word_count")

    @cached_property
    def chunks(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("chapter_id"), (F.col("vec_id") % 4).alias("chunk_index"), "embedding", "label")

    @cached_property
    def search_rows(self) -> DataFrame:
        """Chunks with their chapter and book; the text isn't among the columns."""
        c = self.table("documents").select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("book_id"))
        return self.chunks.join(c, "chapter_id").select("id", "chapter_id", "book_id", "chunk_index", "embedding", F.concat(F.lit("Book "), "book_id").alias("book_title"))

    @cached_property
    def chunks_orphaned(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 3).alias("chapter_id"), "embedding")

    @cached_property
    def history(self) -> DataFrame:
        e = self.table("events")
        state = F.element_at(F.create_map(*(F.lit(x) for kv in STATE_OF_EVENT.items() for x in kv)), F.col("event_type"))
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        row = e.select(F.col("event_id").alias("id"), "user_id", "event_id", "ts", state.alias("to_state"), "value")
        return row.select("id", F.col("user_id").alias("pipeline_id"), F.lag("to_state").over(w).alias("from_state"), "to_state", F.lag("ts").over(w).alias("since"), F.col("ts").alias("created_at"), "value")

    @cached_property
    def pipelines(self) -> DataFrame:
        e = self.table("events")
        state = F.element_at(F.create_map(*(F.lit(x) for kv in STATE_OF_EVENT.items() for x in kv)), F.col("last.event_type"))
        last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last"), F.min("ts").alias("created_at"), F.count_if(F.col("event_type") == "error").alias("retry_count"))
        return last.select(
            F.col("user_id").alias("id"), state.alias("state"), (F.col("user_id") % 10).cast("int").alias("priority"), F.round(F.col("last.value") / 500, 3).alias("confidence"),
            F.concat(F.lit("/in/b"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".epub").otherwise(".pdf")).alias("source_path"),
            "retry_count", "created_at", F.col("last.ts").alias("updated_at"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        d, la = self.table("documents").select("doc_id", "lang", "source"), self.table("labels")
        return d.join(la, "doc_id").select(
            F.col("doc_id").alias("id"), F.col("source").alias("book_id"), F.col("lang").alias("book_type"), ((F.col("doc_id") % 21 + 80) / 100.0).alias("confidence"),
            F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"), "toxic",
        )

    @cached_property
    def reading(self) -> DataFrame:
        c = self.chapters.select(F.col("id").alias("doc_id"), "book_id", "chapter_number")
        return c.join(self.table("labels"), "doc_id").select("book_id", "chapter_number", F.when(F.col("quality") == 1, "read").otherwise("reading").alias("status"), F.col("doc_id").alias("chapter_id"), "toxic")
