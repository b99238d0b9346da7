"""Integrity checks and repairs: anti joins that find, and rewrites that mend. Repairs test their condition again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphan_chunks(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks whose chapter is gone."""
    return chunks.join(chapters.select(F.col("id").alias("chapter_id")), "chapter_id", "left_anti")


def delete_orphans(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    return chunks.join(chapters.select(F.col("id").alias("chapter_id")), "chapter_id", "left_semi")


def basename(path: str) -> F.Column:
    return F.substring_index(path, "/", -1)


def lost_books(pipelines: DataFrame, books: DataFrame, book_of: str = "book_id") -> DataFrame:
    """Complete pipelines whose book is gone, and whether another pipeline with the same file still has one."""
    has = pipelines.join(books.select(F.col("id").alias(book_of)), book_of, "left_semi").select(basename("source_path").alias("base"), F.col("id").alias("other"))
    lost = pipelines.filter(F.col("state") == "complete").join(books.select(F.col("id").alias(book_of)), book_of, "left_anti").withColumn("base", basename("source_path"))
    live = lost.join(has, "base").filter("id <> other").select("id").distinct().withColumn("live_copy", F.lit(True))
    return lost.join(live, "id", "left").select("id", "source_path", F.coalesce("live_copy", F.lit(False)).alias("live_copy"))


def null_hashes(chapters: DataFrame) -> DataFrame:
    return chapters.filter(F.col("content_hash").isNull() | (F.col("content_hash") == ""))


def backfill_hashes(chapters: DataFrame) -> DataFrame:
    missing = F.col("content_hash").isNull() | (F.col("content_hash") == "")
    return chapters.withColumn("content_hash", F.when(missing, F.sha2("content", 256)).otherwise(F.col("content_hash")))


def untracked(books: DataFrame, pipelines: DataFrame, key: str = "id") -> DataFrame:
    return books.join(pipelines.select(key).distinct(), key, "left_anti")


def change_detection(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """id, change: new, no_tracking, modified, touched (same content), forced or unchanged.

    current: id, mtime, hash. stored: id, mtime, hash, either null when never tracked.
    """
    j = current.alias("c").join(stored.select("id", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.lit(True).alias("known")), "id", "left")
    change = (
        F.when(F.col("known").isNull(), "new").when(F.lit(force), "forced").when(F.col("old_hash").isNull() | F.col("old_mtime").isNull(), "no_tracking")
        .when(F.col("mtime") <= F.col("old_mtime"), "unchanged").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("modified")
    )
    return j.select("id", change.alias("change"))


def reuse_vectors(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """fresh with the vectors of stored chunks of the same chapter and hash; each stored one serves once, the last stored first."""
    key = ["chapter_id", "content_hash"]
    new = fresh.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("chunk_index")))
    old = stored.select(*key, "embedding", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id"))).alias("_k"))
    return new.join(old, [*key, "_k"], "left").drop("_k")


def embedding_cost(chunks: DataFrame, per_million: float = 0.13, tokens_a_word: float = 1.35) -> DataFrame:
    c = chunks.agg(F.count("*").alias("pending"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    return c.select("pending", "words", F.round(F.col("words") * tokens_a_word, 2).alias("tokens"), F.round(F.col("words") * tokens_a_word / 1e6 * per_million, 6).alias("dollars"))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old with rows of the same key replaced by new."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_split_chapters(parts: DataFrame) -> DataFrame:
    """chapter_id, content: numbered parts in order of name, or all parts if none is numbered; names with _ in front are left out."""
    p = parts.filter(~F.col("name").startswith("_")).withColumn("numbered", F.col("name").rlike("^[0-9]"))
    some = F.max("numbered").over(Window.partitionBy("chapter_id"))
    kept = p.withColumn("some", some).filter(F.col("numbered") | ~F.col("some"))
    return kept.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
