"""Paths, re-ingestion, titles, sections, samples and batch decisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.executors import map_arrow
from .integrity import basename

# The kinds of books that a classifier may name.
BOOK_TYPES = ("technical_tutorial", "technical_reference", "textbook", "narrative_nonfiction", "periodical", "research_collection", "unknown")


def resolve_path(path: Column, base: str) -> Column:
    """Below base: without a leading data/books/; absolute paths stay."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^data/books/", "")))


def rewrite_prefix(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def coerce_type(name: Column) -> Column:
    clean = F.lower(F.trim(name))
    return F.when(clean.isin(*BOOK_TYPES), clean).otherwise("unknown")


def needs_fallback(confidence: Column, method: Column, threshold: float, weak: tuple[str, ...] = ("rule", "default")) -> Column:
    """Whether a second opinion is asked for: never from .7 on, always below the threshold, and below .6 of weak methods."""
    return F.when(confidence >= 0.7, False).when(confidence < threshold, True).otherwise(method.isin(*weak) & (confidence < 0.6))


def other_model(rows: DataFrame, model: str) -> DataFrame:
    return rows.filter(~F.col("embedding_model").eqNullSafe(F.lit(model)))


def positional_titles(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """book_id, chapter_number, title: the i-th title of a book's table of contents for its i-th chapter; else its own title."""
    toc = titles.select("book_id", F.posexplode("titles").alias("i", "toc")).withColumn("i", F.col("i") + 1)
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number"))
    return chapters.select("book_id", "chapter_number", "title", n.alias("i")).join(toc, ["book_id", "i"], "left").select("book_id", "chapter_number", F.coalesce("toc", "title").alias("title"))


def resolve_sources(pipelines: DataFrame, files: DataFrame) -> DataFrame:
    """id, path: the recorded path if it is there, else a file of the same name and content; null if neither is."""
    here = files.select(F.col("path").alias("source_path"), F.lit(True).alias("here"))
    moved = files.select(basename("path").alias("base"), "content_hash", F.col("path").alias("moved")).groupBy("base", "content_hash").agg(F.min("moved").alias("moved"))
    j = pipelines.withColumn("base", basename("source_path")).join(here, "source_path", "left").join(moved, ["base", "content_hash"], "left")
    return j.select("id", F.when(F.col("here"), F.col("source_path")).otherwise(F.col("moved")).alias("path"))


def archive_names(files: DataFrame) -> DataFrame:
    """path, archived: the file's name; later files of a name get _1, _2 and so on before the ending."""
    base = F.substring_index("path", "/", -1)
    k = F.row_number().over(Window.partitionBy(base).orderBy("path")) - 1
    stem, end = F.regexp_replace(base, r"\.[^.]*$", ""), F.regexp_extract(base, r"(\.[^.]*)$", 1)
    return files.select("path", F.when(k == 0, base).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), end)).alias("archived"))


def prepare_reingest(pipelines: DataFrame, ids: DataFrame, priority: int = 3) -> DataFrame:
    """All pipelines: those named are archived under a marked hash, and each gets a new row in state detected."""
    named = pipelines.join(ids.select("id").distinct().withColumn("again", F.lit(True)), "id", "left")
    old = named.withColumn("content_hash", F.when(F.col("again"), F.concat(F.lit("archived:"), F.col("id").cast("string"), F.lit(":"), "content_hash")).otherwise(F.col("content_hash")))
    old = old.withColumn("state", F.when(F.col("again"), "archived").otherwise(F.col("state")))
    new = named.filter("again").withColumn("state", F.lit("detected")).withColumn("priority", F.lit(priority)).withColumn("id", -F.col("id"))
    return old.unionByName(new).drop("again")


def batch_decide(pipelines: DataFrame, chosen: DataFrame, action: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pipelines after, report): chosen pipelines that wait for approval take the decision; others are reported as skipped."""
    target = {"approve": "approved", "reject": "rejected"}[action]
    j = pipelines.join(chosen.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
    ok = F.coalesce("chosen", F.lit(False)) & (F.col("state") == "pending_approval")
    after = pipelines if dry_run else j.withColumn("state", F.when(ok, target).otherwise(F.col("state"))).select(pipelines.columns)
    report = j.filter("chosen").select("id", F.when(ok, action).otherwise("skipped").alias("outcome"), F.lit(dry_run).alias("dry_run"))
    return after, report


def classification_text(book: DataFrame, chapters: DataFrame, sample: int = 2000) -> DataFrame:
    """book_id, text: title, author, table of contents and an excerpt of the first chapter."""
    toc = chapters.groupBy("book_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_number", "title"))), lambda x: x["title"]), "\n").alias("toc"), F.min_by(F.substring("content", 1, sample), "chapter_number").alias("head")
    )
    j = book.select(F.col("id").alias("book_id"), "title", "author").join(toc, "book_id")
    return j.select("book_id", F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Author: "), F.coalesce("author", F.lit("Unknown"))), F.lit("Contents:"), "toc", F.lit("Excerpt:"), "head").alias("text"))


def passages(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """id, passage: a run of words at an offset that the hash of seed and id gives."""
    w = T.words(F.col("content"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    at = F.pmod(h, F.greatest(F.lit(1), F.size(w) - words + 1))
    return docs.select("id", F.array_join(F.slice(w, (at + 1).cast("int"), words), " ").alias("passage"))


def learning_hours(phases: DataFrame) -> DataFrame:
    """phase, hours: 4 and 1.5 for each chapter of learning phases, 2 and 0.75 of others."""
    n = F.col("chapters")
    return phases.select("phase", F.round(F.when(F.col("kind") == "learn", 4 + 1.5 * n).otherwise(2 + 0.75 * n), 2).alias("hours"))


def sections(text: str, threshold: int = 5000, least_intro: int = 100, part: int = 1500) -> list[tuple[str, str]]:
    """(title, text): by headers of level 2 and 3 if there are three or more and none holds 40 % of all, else parts of paragraphs.

    Lengths are estimated tokens. Texts below the threshold are one section.
    """
    size = lambda s: len(s) // 4
    body = re.sub(r"\A---\n.*?\n---\n", "", text, flags=re.S)
    if size(body) < threshold:
        return [("", body)]
    heads = list(re.finditer(r"(?m)^#{2,3} (.+)$", body))
    if len(heads) >= 3:
        edges = [h.start() for h in heads] + [len(body)]
        out = [(h[1].strip(), body[a:b].strip()) for h, a, b in zip(heads, edges, edges[1:], strict=False)]
        if size(body[: edges[0]]) > least_intro:
            out.insert(0, ("Introduction", body[: edges[0]].strip()))
        if max(size(t) for _, t in out) < 0.4 * size(body):
            return out
    packs: list[list[str]] = [[]]
    for p in (x.strip() for x in re.split(r"\n\n+", body)):
        if p and packs[-1] and sum(map(size, packs[-1])) + size(p) > part:
            packs.append([])
        if p:
            packs[-1].append(p)
    return [(f"Part {i}", "\n\n".join(p)) for i, p in enumerate(packs, 1)]


def split_sections(docs: DataFrame, threshold: int = 5000, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, section, title, tokens: the sections of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, k, t, len(s) // 4) for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, (t, s) in enumerate(sections(x.as_py() or "", threshold), 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["id", "section", "title", "tokens"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, "id long, section long, title string, tokens long")


def lost_manifest(lost: DataFrame) -> DataFrame:
    """value: the lines of a Markdown report, books that can be read again first."""
    line = F.concat(F.when(F.col("live_copy"), "- [ ] again: ").otherwise("- gone: "), "source_path")
    return lost.orderBy(F.desc("live_copy"), "source_path").select(line.alias("value"))
