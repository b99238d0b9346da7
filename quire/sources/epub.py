"""EPUB and text-file sources: whole files through Spark's readers, parsed on Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.executors import map_arrow

FRONT_MATTER = re.compile(r"(?i)^(cover|title page|copyright|dedication|contents|table of contents|acknowledg\w*|about the author\w*|index|colophon)$")


class _Text(HTMLParser):
    """Text without scripts and styles; anchors with the place in the text where they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.anchors: dict[str, int] = {}
        self.skip = 0
        self.heading: list[str] | None = None
        self.title = ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        for key, value in attrs:
            if key in ("id", "name") and value:
                self.anchors.setdefault(value, sum(map(len, self.parts)))
        if tag in ("h1", "h2", "title") and not self.title:
            self.heading = []
        if tag in ("p", "div", "br", "li", "h1", "h2", "h3", "tr"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in ("h1", "h2", "title") and self.heading is not None:
            found = " ".join("".join(self.heading).split())
            self.title, self.heading = (found if 0 < len(found) < 200 else ""), None

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.heading is not None:
                self.heading.append(data)


def parse_html(text: str) -> tuple[str, str, dict[str, int]]:
    """(text, title, anchors) of an HTML document."""
    p = _Text()
    p.feed(text)
    return "".join(p.parts), p.title, p.anchors


def word_count(data: bytes) -> int:
    """Words of all HTML documents in the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return sum(len(parse_html(z.read(n).decode("utf-8", "replace"))[0].split()) for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _contents(z: zipfile.ZipFile, opf: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Spine documents in order, and (title, target) of the table of contents: NAV if there is one, else NCX."""
    base = posixpath.dirname(opf)
    at = lambda href: posixpath.normpath(posixpath.join(base, href))
    root = ElementTree.fromstring(z.read(opf))
    items = {n.get("id"): n for n in root.iter() if _local(n) == "item"}
    spine = [at(items[n.get("idref")].get("href")) for n in root.iter() if _local(n) == "itemref" and n.get("idref") in items]
    toc: list[tuple[str, str]] = []
    for n in items.values():
        path = at(n.get("href", ""))
        if path not in z.namelist():
            continue
        here = posixpath.dirname(path)
        if "nav" in (n.get("properties") or "").split():
            found = re.findall(r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', z.read(path).decode("utf-8", "replace"))
            return spine, [(" ".join(re.sub("<[^>]+>", "", t).split()), posixpath.normpath(posixpath.join(here, h))) for h, t in found]
        if n.get("media-type") == "application/x-dtbncx+xml":
            for point in ElementTree.fromstring(z.read(path)).iter():
                if _local(point) == "navPoint":
                    label = next((x.text or "" for x in point.iter() if _local(x) == "text"), "")
                    target = next((x.get("src") for x in point.iter() if _local(x) == "content"), "")
                    toc.append((" ".join(label.split()), posixpath.normpath(posixpath.join(here, target))))
    return spine, toc


def chapters(data: bytes, least_words: int = 100) -> list[tuple[int, str, str]]:
    """(number, title, text): the spine cut at the files and anchors of the table of contents.

    Documents that no entry points to count as chapters if they have more than least_words words; front matter goes.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(n.get("full-path") for n in box.iter() if _local(n) == "rootfile")
        spine, toc = _contents(z, opf)
        marks: dict[str, list[tuple[str, str]]] = {}
        for title, target in toc:
            path, _, anchor = target.partition("#")
            marks.setdefault(path, []).append((anchor, title))
        out: list[tuple[str, str]] = []
        for path in spine:
            if path not in z.namelist():
                continue
            text, own, anchors = parse_html(z.read(path).decode("utf-8", "replace"))
            points = sorted({(anchors.get(a, 0) if a else 0): t for a, t in reversed(marks.get(path, []))}.items())
            if not points:
                if len(text.split()) > least_words:
                    out.append((own or posixpath.basename(path), text))
                continue
            ends = [p for p, _ in points[1:]] + [len(text)]
            out += [(title or own, text[a:b]) for (a, title), b in zip(points, ends, strict=True)]
    kept = [(t, " ".join(x.split())) for t, x in out if x.strip() and not FRONT_MATTER.match(t)]
    return [(i, t, x) for i, (t, x) in enumerate(kept, 1)]


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """path, content_hash, chapter_number, title, content, error: one row a chapter; unreadable files give one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digest, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows = [(name, digest, i, t, x, None) for i, t, x in chapters(data)]
                except Exception as e:
                    rows = [(name, digest, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "content_hash", "chapter_number", "title", "content", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return map_arrow(files.select("path", F.sha2("content", 256).alias("content_hash"), "content"), run, "path string, content_hash string, chapter_number int, title string, content string, error string")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """chapter_id (the folder), name, text of Markdown parts, for merging."""
    t = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path).withColumn("file", F.input_file_name())
    return t.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("chapter_id"), F.substring_index("file", "/", -1).alias("name"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, *paths: str) -> DataFrame:
    """Gold queries of JSON files; missing files are passed over."""
    schema = "query string, gold_chapter_id long, gold_book_id string, source string"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if (h := hadoop(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)]
    return spark.read.schema(schema).option("multiLine", True).json(there) if there else spark.createDataFrame([], schema)
