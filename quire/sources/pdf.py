"""PDF files: words of the pages' text and titles of the outline. The extractor can be replaced by a library's."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.executors import map_arrow

#: Words under which a file counts as scanned images: nothing is known of its text.
LEAST_WORDS = 100
#: Bytes that a stream of a page may become.
MOST_BYTES = 64 << 20
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_TITLE = re.compile(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])

    data = re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)
    return data.decode("utf-16") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("latin-1")


def simple_text(data: bytes) -> str:
    """The strings that the content streams show; streams that aren't deflated or plain are skipped. Enough for plain
    files; encrypted or scanned ones give nothing."""
    out = []
    for m in _STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body, MOST_BYTES)
        except zlib.error:
            pass
        for shown in _SHOWN.finditer(body):
            out.append(_plain(shown[1]) if shown[1] is not None else "".join(_plain(s[1]) for s in _STRING.finditer(shown[2])))
    return "\n".join(out)


def outline(data: bytes) -> list[str]:
    """Titles of the outline in the order of the file; the document's own title may be among them."""
    return [t for t in (_plain(m[1]).strip() for m in _TITLE.finditer(data)) if t]


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def words_and_titles(rows: DataFrame, extract: Callable[[bytes], str] = simple_text, least: int = LEAST_WORDS) -> DataFrame:
    """path, words (null under `least`, or where the extractor fails), titles. rows: path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, titles = [], []
            for content in batch.column(1):
                data = content.as_py() or b""
                try:
                    n = len(extract(data).split())
                except Exception:
                    n = 0
                words.append(n if n >= least else None)
                titles.append(outline(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(titles, pa.list_(pa.string()))], names=["path", "words", "titles"])

    return map_arrow(rows.select("path", "content"), run, "path string, words long, titles array<string>")
