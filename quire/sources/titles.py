"""Titles of the table of contents of EPUB files, as a table that SQL reads.

    SELECT path, x.* FROM binaryFile.`/books`, LATERAL quire_titles(content) x WHERE path LIKE '%.epub'

Files come through Spark's own reader: conditions on path, size and time are pushed down to it, and its partitions are the
tasks. A file that can't be read is one row with an error.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from .epub import _local, parse_html


class Title(NamedTuple):
    place: int | None
    level: int | None
    title: str | None
    source: str | None  #: ncx, nav or headings
    error: str | None


class _Links(HTMLParser):
    """(level, text) of the links of a document's first nav element that has any, else of its lists; the level is the depth
    of lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nav: list[list[tuple[int, str]]] = []
        self.listed: list[tuple[int, str]] = []
        self.inside = self.depth = 0
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "nav":
            self.inside += 1
            self.nav.append([])
        self.depth += tag == "ol"
        if tag == "a":
            self.text = []

    def handle_endtag(self, tag):
        self.inside -= tag == "nav" and self.inside > 0
        self.depth -= tag == "ol" and self.depth > 0
        if tag == "a" and self.text is not None:
            found, self.text = " ".join("".join(self.text).split()), None
            if found and self.inside:
                self.nav[-1].append((max(1, self.depth), found))
            if found and self.depth:
                self.listed.append((self.depth, found))

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def _ncx(z: zipfile.ZipFile, names: list[str]) -> Iterator[tuple[int, str]]:
    """Points of an NCX map, those below others, too."""
    path = next((n for n in names if n.lower().endswith(".ncx")), None)

    def below(node, level: int) -> Iterator[tuple[int, str]]:
        for point in (x for x in node if _local(x) == "navPoint"):
            label = next((" ".join((t.text or "").split()) for x in point if _local(x) == "navLabel" for t in x if _local(t) == "text"), "")
            if label:
                yield level, label
            yield from below(point, level + 1)

    if path:
        for node in ElementTree.fromstring(z.read(path)):
            if _local(node) == "navMap":
                yield from below(node, 1)


def _package(z: zipfile.ZipFile, names: list[str]) -> tuple[str, list, list]:
    """(folder, items, references of the spine) of the first package document."""
    path = next((n for n in names if n.lower().endswith(".opf")), None)
    root = ElementTree.fromstring(z.read(path)) if path else []
    nodes = list(root.iter()) if path else []
    return posixpath.dirname(path or ""), [n for n in nodes if _local(n) == "item"], [n for n in nodes if _local(n) == "itemref"]


def _nav(z: zipfile.ZipFile, names: list[str]) -> Iterator[tuple[int, str]]:
    base, items, _ = _package(z, names)
    href = next((n.get("href", "") for n in items if "nav" in (n.get("properties") or "").split()), "")
    at = posixpath.normpath(posixpath.join(base, href))
    path = at if at in names else next((n for n in names if href and n.endswith(href)), None)
    if path:
        links = _Links()
        links.feed(z.read(path).decode("utf-8", "replace"))
        yield from next((x for x in links.nav if x), links.listed)


def _headings(z: zipfile.ZipFile, names: list[str]) -> Iterator[tuple[int, str]]:
    """The title of each document of the spine."""
    base, items, spine = _package(z, names)
    href = {n.get("id"): n.get("href", "") for n in items}
    for ref in spine:
        path = posixpath.normpath(posixpath.join(base, href.get(ref.get("idref"), "")))
        if path in names and (found := parse_html(z.read(path).decode("utf-8", "replace"))[1]):
            yield 1, found


def titles(data: bytes | None) -> list[Title]:
    """The titles of one file: of its NCX, else of its NAV, else the headings of its documents. An error is a row; a file
    without titles has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            names = z.namelist()
            for source, read in (("ncx", _ncx), ("nav", _nav), ("headings", _headings)):
                if found := list(read(z, names)):
                    return [Title(i, level, title, source, None) for i, (level, title) in enumerate(found, 1)]
        return []
    except Exception as e:  # whatever a broken file makes of the parsers
        return [Title(None, None, None, None, f"{type(e).__name__}: {e}")]


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """path, place, level, title, source, error of the EPUB files below a folder."""
    from ..functions import table

    table.register(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return spark.sql("SELECT path, x.* FROM {files}, LATERAL quire_titles(content) x", files=files.select("path", "content"))
