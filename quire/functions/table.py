"""Table functions for SQL: one text, many rows, with LATERAL.

    SELECT id, x.* FROM chapters, LATERAL quire_code(content) x
    SELECT id, x.* FROM chapters, LATERAL quire_chunks(content, 500) x
    SELECT path, x.* FROM binaryFile.`/books`, LATERAL quire_titles(content) x

`register` makes them known to a session. They run where the row lies: nothing is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import TARGET, chunk
from ..operators.codeblocks import code_examples
from ..operators.maintenance import sections
from ..sources.titles import titles
from .executors import ship


def _asked(name: str, text: AnalyzeArgument, number: AnalyzeArgument | None) -> None:
    """Arguments are checked when the query is analysed, not when it runs."""
    if text.isTable or text.dataType.typeName() not in ("string", "void"):
        raise ValueError(f"{name}: the first argument is a text")
    if number is not None and (not number.isConstantExpression or not isinstance(number.value, int) or number.value < 1):
        raise ValueError(f"{name}: the second argument is a constant of 1 or more")


class Chunks:
    """quire_chunks(text, words): chunk_index, content, of about so many words each."""

    @staticmethod
    def analyze(text: AnalyzeArgument, words: AnalyzeArgument | None = None) -> AnalyzeResult:
        _asked("quire_chunks", text, words)
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("content", StringType()))

    def eval(self, text: str | None, words: int = TARGET) -> Iterator[tuple]:
        yield from enumerate(chunk(text or "", words))


class Sections:
    """quire_sections(text, threshold): section, title, content, tokens; texts below the threshold (tokens) are one section."""

    @staticmethod
    def analyze(text: AnalyzeArgument, threshold: AnalyzeArgument | None = None) -> AnalyzeResult:
        _asked("quire_sections", text, threshold)
        return AnalyzeResult(StructType().add("section", IntegerType()).add("title", StringType()).add("content", StringType()).add("tokens", LongType()))

    def eval(self, text: str | None, threshold: int = 5000) -> Iterator[tuple]:
        for k, (title, body) in enumerate(sections(text or "", threshold), 1):
            yield k, title, body, len(body) // 4


class Code:
    """quire_code(text): at, language, format, code, context, line_count of each example."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _asked("quire_code", text, None)
        schema = StructType().add("at", IntegerType()).add("language", StringType()).add("format", StringType()).add("code", StringType()).add("context", StringType()).add("line_count", IntegerType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from map(tuple, code_examples(text))


class Titles:
    """quire_titles(content of an EPUB file): place, level, title, source, error."""

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        if content.dataType.typeName() not in ("binary", "void"):
            raise ValueError("quire_titles: the argument is the content of a file")
        schema = StructType().add("place", IntegerType()).add("level", IntegerType()).add("title", StringType()).add("source", StringType()).add("error", StringType())
        return AnalyzeResult(schema)

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        yield from map(tuple, titles(content))


TABLE_FUNCTIONS = {"quire_chunks": Chunks, "quire_sections": Sections, "quire_code": Code, "quire_titles": Titles}


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
