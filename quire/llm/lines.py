"""Line dedup: windows of three consecutive lines that occur before are removed.

Lines are split at line feeds and compared without white space at their ends; blank lines take no part and
always stay. Each run of three lines is hashed (128 bits). A window that occurs more than once in the whole
table stays where it comes first: in the document with the smallest id, at its first place there. All other
occurrences are removed, as the union of the lines that they cover.

Documents with fewer than three lines are never changed; null texts stay null; null ids count as the largest.
Rows that share an id count as one document: they don't remove each other's lines, and equal ones are cleaned
alike. Other columns are passed on unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pinned

WINDOW = 3
_BLANK = " \t\r\x0b\x0c"
#: Bounds of what may be broadcast: documents with removed lines, and window places in them.
BROADCAST_DOCS, BROADCAST_PLACES = 50_000, 1_000_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, row, places: windows (by their first line's number among lines that aren't blank) to remove.

    docs: key long (orders documents), row long (tells rows of a key apart), text. First occurrences are
    aggregated before anything meets; the windows of a line that stands everywhere are spread by the join's
    skew handling, and only windows found twice or more reach it.
    """
    lines = docs.select("key", "row", pinned(F.filter(F.transform(_lines("text"), _trimmed), lambda x: x != "")).alias("l"))
    of = lambda i, *seed: F.xxhash64(*map(F.lit, seed), *(F.get("l", i + k) for k in range(window)))
    starts = F.sequence(F.lit(0), F.size("l") - window)
    places = F.transform(starts, lambda i: F.struct(i.alias("at"), of(i).alias("h1"), of(i, 7).alias("h2")))
    found = lines.filter(F.size("l") >= window).select("key", "row", F.explode(places).alias("w")).select("key", "row", "w.*")
    first = found.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Equal rows of one id, or of none, make equal marks: one of each goes on, so that no (key, row) outgrows a text.
    hits = found.join(first, ["h1", "h2"]).distinct().repartition("key", "row")
    own = F.min("at").over(Window.partitionBy("key", "row", "h1", "h2"))
    later = hits.withColumn("own", own).filter((F.col("key") > F.col("first")) | (F.col("at") > F.col("own")))
    return later.groupBy("key", "row").agg(F.collect_set("at").alias("places"))


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text cleaned, and the new columns n_lines, n_removed (lines, blank ones apart)."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    ident, text = (own[docs.columns.index(c)] for c in (id_col, text_col))
    key = F.coalesce(F.col(ident).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.toDF(*own).select("*", key.alias("key"), F.xxhash64(ident, text).alias("row"))
    marks = materialise(repeats(rows.select("key", "row", F.col(text).alias("text")), window), "line-marks")
    n, places = marks.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    rows = rows.join(F.broadcast(marks) if n <= BROADCAST_DOCS and places <= BROADCAST_PLACES else marks, ["key", "row"], "left")
    rows = rows.withColumn("l", pinned(_lines(text)))
    rows = rows.withColumn("shown", pinned(F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: _trimmed(F.get("l", i)) != "")))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.slice("shown", p + 1, window))))
    rows = rows.withColumn("gone", pinned(F.when(F.col("places").isNotNull(), covered)))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    cleaned = pinned(F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get("l", i)), "\n")))
    numbers = pinned(F.size("shown").cast("long")), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    out = rows.select(*(cleaned.alias(c) if c == text else F.col(c) for c in own), *numbers)
    return out.toDF(*docs.columns, "n_lines", "n_removed")
