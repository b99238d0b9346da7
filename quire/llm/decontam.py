"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k = floor(rate * length) edits. Cut into k + 1 pieces, at
least one piece of it then stands in the document unchanged. One automaton finds all pieces of all items in
a single pass over each text; around each hit, Myers' bit-parallel algorithm gives the least edit distance
of the item to any stretch of the text there.

Both sides are compared in lower case with every run of white space as one space. Items that are null or
blank match nothing; items of a few characters (k = 0) match only as they are. Null texts hold nothing.
Repeated rows give one result for each id and item, and items that share an id (or have none) are one item with
several texts, of which the nearest counts. Other columns are ignored, and passed on by `clean`.
Documents are judged one by one, so nothing but the results moves between executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, small

RATE = 0.08
#: Characters of items that one automaton holds; more items are matched in several passes over the texts.
CHUNK_CHARS = 4_000_000
FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("ends_at", pa.int32())])
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def normal(text: str | None) -> str:
    return _SPACES.sub(" ", (text or "").lower()).strip(" ")


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length that make up the item."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def peq(item: str) -> dict[str, int]:
    """For each character, the bits of the places where it stands in the item."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item (length m, at least 1) to a stretch of the text, and where the stretch ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        if score < best:
            best, at = score, i
    return best, at


class Matcher:
    """The pieces of some items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(ident, text, budget(len(text), rate)) for ident, text in ((i, normal(t)) for i, t in items) if text]
        self.masks = [peq(text) for _, text, _ in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, at))
        self.machine = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.machine.add_word(piece, (len(piece), uses))
        if where:
            self.machine.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item -> (least distance, end in the normalised text) of the items within their budgets."""
        text, spans, found = normal(text), {}, {}
        if self.empty or not text:
            return found
        for last, (size, uses) in self.machine.iter(text):
            for n, at in uses:
                _, item, k = self.items[n]
                start = last + 1 - size - at
                if found.get(n, (1,))[0] == 0:
                    continue
                if start >= 0 and text.startswith(item, start):
                    found[n] = (0, start + len(item))
                    continue
                span = spans.setdefault(n, [])
                a, b = max(0, start - k), min(len(text), start + len(item) + k)
                if span and a <= span[-1][1] and b >= span[-1][0] and max(b, span[-1][1]) - min(a, span[-1][0]) <= 2 * (len(item) + 2 * k):
                    span[-1] = (min(a, span[-1][0]), max(b, span[-1][1]))
                else:
                    span.append((a, b))
        for n, each in spans.items():
            _, item, k = self.items[n]
            for a, b in each:
                if found.get(n, (1,))[0] == 0:
                    break
                distance, at = least_distance(self.masks[n], len(item), text[a:b])
                if distance <= min(k, found.get(n, (k,))[0]):
                    found[n] = (distance, a + at)
        out: dict[int, tuple[int, int]] = {}
        for n, x in found.items():  # of several texts with one item id the nearest counts
            ident = self.items[n][0]
            out[ident] = min(x, out.get(ident, x))
        return out


def _chunks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of about CHUNK_CHARS characters: a pass over the texts for each."""
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = 1 + size // CHUNK_CHARS
    for i in range(parts):
        yield [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()]


def _found(docs: DataFrame, items: DataFrame, rate: float, id_col: str, text_col: str) -> DataFrame:
    """FOUND: every item found in every row. tag: a hash of the row's text, which tells rows with equal or no ids apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    spark, out = docs.sparkSession, None
    for chunk in _chunks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        shipped = spark.sparkContext.broadcast(chunk)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for batch in batches:
                ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                got = [(i, tag, item, *x) for i, tag, text in zip(ids, tags, batch.column(2), strict=True) for item, x in matcher.find(text.as_py()).items()]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), FOUND, strict=True)], schema=FOUND)

        part = map_arrow(rows, search, "doc_id long, tag long, item_id long, distance int, ends_at int")
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, ends_at: each item found in each document, with its least distance.

    items: item_id long, text. ends_at counts characters of the normalised text.
    """
    best = _found(docs, items, rate, id_col, text_col).groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "ends_at")).alias("b"))
    return best.select("doc_id", "item_id", "b.distance", "b.ends_at")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item was found, with all their columns. Rows are judged by id and text: one that shares
    its id, or has none, stays if its own text holds nothing."""
    found = small(materialise(_found(docs, items, rate, id_col, text_col).select("doc_id", "tag").distinct(), "leaks"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    ident, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    own = ident.cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("tag"))
    return docs.toDF(*names).join(found, own, "left_anti").toDF(*docs.columns)
