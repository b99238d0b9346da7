"""Library statistics, topics, authors, reading progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def book_rollup(chapters: DataFrame, embedded: DataFrame) -> DataFrame:
    """book_id, chapters, embedded, words. embedded: chapter_id of chapters with vectors, distinct."""
    c = chapters.select("id", "book_id", "word_count").join(embedded.withColumn("e", F.lit(1)), F.col("id") == F.col("chapter_id"), "left")
    return c.groupBy("book_id").agg(F.count("*").alias("chapters"), F.count("e").alias("embedded"), F.sum("word_count").alias("words"))


def totals(rollup: DataFrame) -> DataFrame:
    t = rollup.agg(F.count("*").alias("books"), F.coalesce(F.sum("chapters"), F.lit(0)).alias("chapters"), F.coalesce(F.sum("embedded"), F.lit(0)).alias("embedded"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return t.withColumn("coverage", F.when(F.col("chapters") > 0, F.round(F.col("embedded") * 100.0 / F.col("chapters"), 1)).otherwise(0.0))


def by_topic(rows: DataFrame, text: str, *aggs) -> DataFrame:
    """Roll-up under each topic of the text; a row counts under each of its topics."""
    return rows.withColumn("topic", F.explode(T.topics(F.col(text)))).groupBy("topic").agg(*aggs)


def author_rollup(rollup: DataFrame, books: DataFrame) -> DataFrame:
    b = rollup.join(books.select(F.col("id").alias("book_id"), F.coalesce("author", F.lit("Unknown")).alias("author")), "book_id")
    return b.groupBy("author").agg(F.count("*").alias("books"), F.sum("words").alias("words"), F.sum("chapters").alias("chapters"))


def author_overview(books: DataFrame, chapters: DataFrame, compat: bool) -> DataFrame:
    """compat: words are counted once for each chapter, as a plain join of books and chapters does."""
    joined = books.join(chapters.select(F.col("book_id"), F.col("id").alias("chapter_id")), books.id == F.col("book_id"), "left")
    if compat:
        return joined.groupBy("author").agg(F.count_distinct("book_id").alias("books"), F.sum("word_count").alias("words"))
    return books.groupBy("author").agg(F.count("*").alias("books"), F.sum("word_count").alias("words"))


def size_distribution(books: DataFrame) -> DataFrame:
    """Least, greatest, mean rounded down, and upper median of the book sizes; the median is exact, from counts of equal sizes."""
    return books.agg(F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.expr("sum(word_count) div count(*)").alias("mean"), F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY word_count DESC) as bigint)").alias("median"))


def size_categories(books: DataFrame, small: int, large: int) -> DataFrame:
    w = F.col("word_count")
    return books.agg(F.count_if(w < small).alias("short"), F.count_if((w >= small) & (w < large)).alias("medium"), F.count_if(w >= large).alias("long"))


def coverage_buckets(rollup: DataFrame) -> DataFrame:
    e, c = F.col("embedded"), F.col("chapters")
    return rollup.agg(F.count_if(e >= c).alias("full"), F.count_if((e > 0) & (e < c)).alias("partial"), F.count_if(e == 0).alias("none"))


def library_status(rollup: DataFrame) -> DataFrame:
    e, c = F.col("embedded"), F.col("chapters")
    status = F.when((c > 0) & (e == c), "ready").when(e > 0, "partial").otherwise("no_embeddings")
    return rollup.select("book_id", "chapters", "embedded", "words", status.alias("status"), F.when(c > 0, F.round(e * 100.0 / c, 1)).otherwise(0.0).alias("percent"))


def reading_books(chapters: DataFrame, reading: DataFrame) -> DataFrame:
    """Per book with any progress: chapters read, being read, and the percentage read."""
    total = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"))
    done = reading.groupBy("book_id").agg(F.count_if(F.col("status") == "read").alias("n_read"), F.count_if(F.col("status") == "reading").alias("n_reading"))
    return total.join(done, "book_id").select("book_id", "chapters", "n_read", "n_reading", F.round(F.col("n_read") * 100.0 / F.col("chapters"), 1).alias("percent"))


def reading_chapters(chapters: DataFrame, reading: DataFrame) -> DataFrame:
    r = reading.select("book_id", "chapter_number", "status")
    return chapters.select("book_id", "chapter_number", "title").join(r, ["book_id", "chapter_number"], "left").withColumn("status", F.coalesce("status", F.lit("unread")))


def neighbours(chapters: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("chapter_number")
    return chapters.select("book_id", "chapter_number", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


def collection(books: DataFrame, rollup: DataFrame, keywords: list[str]) -> DataFrame:
    """Books whose title holds a keyword, with hours of reading at 15,000 words an hour."""
    hit = books.filter(T.contains_any(F.lower("title"), keywords)).select(F.col("id").alias("book_id"), "title")
    return hit.join(rollup, "book_id").select("book_id", "title", "words", "chapters", F.round(F.col("words") / 15000, 1).alias("hours"))
