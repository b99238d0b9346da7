"""Extraction quality and chapter audits: one grouped pass over the chapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def suspicious(title: Column) -> Column:
    return reduce(Column.__or__, (title.rlike(p) for p in T.SUSPICIOUS_TITLES))


def duplicate_ratio(chapters: DataFrame) -> DataFrame:
    """book_id, ratio: rows beyond the first of each content hash, over all rows with a hash."""
    per = chapters.filter(F.coalesce("content_hash", F.lit("")) != "").groupBy("book_id", "content_hash").agg(F.count("*").alias("c"))
    return per.groupBy("book_id").agg(F.round(F.sum(F.col("c") - 1) / F.sum("c"), 6).alias("ratio"))


def extraction_quality(
    chapters: DataFrame, min_chapters: int = 3, max_words: int = 20_000, max_to_median: float = 4.0, min_words: int = 100, min_total: int = 5_000, max_duplicates: float = 0.10, source: DataFrame | None = None, min_coverage: float = 0.5
) -> DataFrame:
    """book_id, passed, reasons, short_chapters of the checks, none of which hides another. source: book_id, source_words of
    the files that the books were made of; books without, or with none, are not judged by coverage."""
    w = F.col("word_count")
    g = chapters.groupBy("book_id").agg(
        F.count("*").alias("n"), F.max(w).alias("most"), F.median(w).alias("median"), F.sum(w).alias("total"), F.count_if(w < min_words).alias("short"), F.count_if(suspicious(F.col("title"))).alias("odd")
    ).join(duplicate_ratio(chapters), "book_id", "left")
    g = g.withColumn("source_words", F.lit(None).cast("long")) if source is None else g.join(source.select("book_id", "source_words"), "book_id", "left")
    coverage = F.when(F.col("source_words") > 0, F.col("total") / F.col("source_words"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n") < min_chapters, "too_few_chapters"), F.when(F.col("most") > max_words, "chapter_too_long"), F.when((F.col("median") > 0) & (F.col("most") / F.col("median") > max_to_median), "uneven_chapters"),
        F.when(F.col("total") < min_total, "too_few_words"), F.when(F.col("ratio") > max_duplicates, "duplicates"), F.when(F.col("odd") > 0, "suspicious_titles"), F.when(coverage < min_coverage, "low_coverage"),
    ))
    return g.select("book_id", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"), F.col("short").alias("short_chapters"))


def chapter_audit(chapters: DataFrame, low: tuple[int, int] = (1500, 2000), high: tuple[int, int] = (10_000, 15_000), giant: int = 20_000, max_cv: float = 1.5, toc: DataFrame | None = None, over: float = 1.5, under: float = 0.65) -> DataFrame:
    """book_id, n, avg_words, cv, giants, severity (ok, warning, bad), issues. toc: book_id, entries of the tables of contents
    that chapters are counted against; without entries there is no ratio, and a book that isn't among them isn't judged."""
    w = F.col("word_count")
    g = chapters.groupBy("book_id").agg(
        F.count("*").alias("n"), F.round(F.avg(w), 2).alias("avg_words"), F.round(F.stddev_pop(w) / F.avg(w), 4).alias("cv"), F.count_if(w > giant).alias("giants"),
        F.count_if(F.col("title").rlike(T.GENERIC_TITLE)).alias("generic"), F.count_if(F.col("title").rlike(T.ARTIFACT_TITLE)).alias("artifacts"), F.count_if(F.col("title").rlike(T.NON_CHAPTER_TITLE)).alias("non_chapters"),
    )
    g = g.withColumn("entries", F.lit(None).cast("long")) if toc is None else g.join(toc.select("book_id", "entries"), "book_id", "left")
    a, ratio = F.col("avg_words"), F.when(F.col("entries") > 0, F.col("n") / F.col("entries")).when(F.col("entries") == 0, F.lit(0.0))
    rules = (
        (a < low[0], 2, "over_fragmented"), ((a >= low[0]) & (a < low[1]), 1, "short_chapters"), (a > high[1], 2, "under_split"), ((a <= high[1]) & (a > high[0]), 1, "long_chapters"),
        (F.col("giants") >= 2, 2, "giants"), (F.col("giants") == 1, 1, "giant"), (F.col("cv") > max_cv, 1, "uneven"), (F.col("generic") > 0, 1, "generic_titles"), (F.col("artifacts") > 0, 2, "artifact_titles"),
        (F.col("non_chapters") > 0, 1, "non_chapters"), (ratio > over, 1, "over_count"), (ratio < under, 1, "under_count"),
    )
    level = F.greatest(F.lit(0), *(F.when(c, F.lit(s)).otherwise(0) for c, s, _ in rules))
    issues = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, _, name in rules)))
    return g.select("book_id", "n", "avg_words", "cv", "giants", F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("bad")), level + 1).alias("severity"), F.array_join(issues, ",").alias("issues"))


def issue_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode(F.filter(F.split("issues", ","), lambda x: x != "")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def library_issues(rollup: DataFrame, low_words: int) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("chapters") == 0, "no_chapters"), F.when(F.col("embedded") < F.col("chapters"), "missing_embeddings"), F.when(F.col("words") < low_words, "low_word_count")))
    return rollup.select("book_id", F.explode(found).alias("issue"))


def title_hygiene(rows: DataFrame) -> DataFrame:
    """id, issue: missing, numbered or very short titles."""
    t = F.trim(F.coalesce("title", F.lit("")))
    issue = F.when((t == "") | (t == "(Title Missing)"), "missing").when(t.rlike("^[0-9]") & (F.length(t) <= 20), "numbered").when((F.length(t) <= 3) & ~t.rlike("^[0-9]"), "short")
    return rows.select("id", issue.alias("issue")).filter("issue IS NOT NULL")
