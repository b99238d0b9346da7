"""Export sinks: Markdown and JSON lines, in order, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters with book title, in the order of titles and numbers, and a mark where the book changes."""
    rows = chapters.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title")), "book_id")
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number")) == 1
    return rows.withColumn("header", first).orderBy("book_title", "chapter_number")


def as_markdown(rows: DataFrame) -> DataFrame:
    head = F.when(F.col("header"), F.concat(F.lit("# "), "book_title", F.lit("\n\n"))).otherwise("")
    return rows.select(F.concat(head, F.lit("## "), F.col("chapter_number").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("book_title", "chapter_number", "title", "content", "word_count")).alias("value"))


def write(rows: DataFrame, path: str, kind: str = "markdown") -> None:
    (as_markdown if kind == "markdown" else as_json)(rows).write.mode("overwrite").text(path)
