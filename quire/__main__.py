"""Commands: python -m quire --data FOLDER [--store FOLDER] COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .api import Tools
from .sources.export import write
from .sources.reports import text_table, write_report
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--store", help="folder of marks, titles and decisions")
    p.add_argument("--csv", help="write the rows as CSV into this folder instead of showing them")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("books", "stats", "status", "authors", "progress", "health", "stuck", "queue", "bookmarks"):
        c.add_parser(name)
    for name, *words in (("toc", "book"), ("search", "words"), ("titles", "words"), ("study", "chapter"), ("summary", "book"), ("read", "book", "chapter"), ("export", "folder"), ("audit", "severity")):
        one = c.add_parser(name)
        for w in words:
            one.add_argument(w, type=int if w == "chapter" else str, **({"nargs": "?", "default": "all"} if w == "severity" else {}))
        one.add_argument("--limit", type=int, default=10)
    for name, last in (("mark", "status"), ("bookmark", "note"), ("retitle", "title")):
        one = c.add_parser(name)
        one.add_argument("book")
        one.add_argument("chapter", type=int)
        one.add_argument(last)
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> str:
    """What the command shows."""
    a = parser().parse_args(argv)
    t = Tools(spark, a.data, store=Store(spark, a.store) if a.store else None)
    make = {
        "books": lambda: t.list_books(), "stats": lambda: t.get_library_statistics(), "status": lambda: t.library_status(), "authors": lambda: t.get_author_insights(), "progress": lambda: t.get_reading_progress(),
        "health": lambda: t.health(), "stuck": lambda: t.stuck(), "queue": lambda: t.queue(), "bookmarks": lambda: t.bookmarks(), "toc": lambda: t.get_table_of_contents(a.book),
        "search": lambda: t.text_search(a.words, a.limit), "titles": lambda: t.search_titles(a.words, a.limit), "audit": lambda: t.audit_chapter_quality(a.severity),
        "study": lambda: t.create_study_guide(a.chapter), "summary": lambda: t.summarize_book(a.book), "read": lambda: t.get_chapter(a.book, a.chapter),
        "mark": lambda: f"version {t.mark(a.book, a.chapter, a.status)}", "bookmark": lambda: f"version {t.add_bookmark(a.book, a.chapter, a.note)}", "retitle": lambda: f"version {t.update_title(a.book, a.chapter, a.title)}",
        "export": lambda: write(t.export_rows(), a.folder) or f"written to {a.folder}",
    }
    out = make[a.command]()
    if not isinstance(out, DataFrame):
        return out
    if a.csv:
        write_report(out, a.csv, "csv")
        return f"written to {a.csv}"
    return text_table(out)


def main() -> None:
    spark = SparkSession.builder.appName("quire").getOrCreate()
    try:
        print(run(spark))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
