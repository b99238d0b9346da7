"""Source divergence audit: how far the sources of a language are from each other and from it, by their terms.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps the V terms that stand in
at least min_docs of its documents. Every group (lang, source), and every language as a whole, gives a kept term that
occurs c times in it the weight p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)), N the sum of its c. The divergence of two
weights is floor((p - q)**2 / (p + q)). All numbers are integers; products that may pass 64 bits are decimals.

Sketch. A first pass over the texts adds, for each language and term, the number of documents to DEPTH cells of a
count-min sketch, one sketch a task. A cell stops at min_docs, so it takes one byte and sums of stopped cells still tell
what reached min_docs. Sketches are merged by cell; the merged one, of DEPTH * WIDTH bytes whatever the data, is broadcast.
No cell is less than the true number: a term with a cell below min_docs is impossible. The second pass counts only the
other terms, adds them up in the task, and only these sums are shuffled; the exact document numbers then decide.

Pairs. For sources g and h, with p0 the weight of an absent term and f the divergence,

    sum over kept terms = (V - |g| - |h| + |g and h|) f(p0_g, p0_h) + A(g, h) + A(h, g)
                          + sum over terms of both of f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h)

where A(g, h) is the sum of f(p, p0_h) over the terms of g, taken from the numbers of terms with each weight. So only
terms that both sources have are joined.

Null texts, languages and sources are empty strings. Groups without terms take part. Repeated rows count as often as they
come. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import kernels
from .common import map_arrow, materialise, small

SCALE, MIN_DOCS, TOP_TERMS = 1_000_000_000, 10, 10
#: Cells of a row of the sketch (a power of two), its rows, and cells that move together.
WIDTH, DEPTH, CHUNK = 1 << 20, 4, 1 << 16
#: Sums of a task up to which it goes on adding before it hands them on, in rows and in bytes.
HELD_ROWS, HELD_BYTES = 400_000, 64 << 20
#: Pieces into which the sources of a language are dealt for the list of pairs.
PIECES = 16
_BREAK = np.ones(256, bool)
_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
CELLS = pa.schema([("chunk", pa.int32()), ("cells", pa.binary())])


def _hashes(strings: pa.Array) -> np.ndarray:
    """A hash of each string."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.zeros(0, np.uint8)
    return kernels.hash_words(kernels.Words(data, offsets, offsets[:-1], offsets[1:], offsets[:0]))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For slices of the rows (lang, source, text): language, source and term of each combination that occurs there (as
    indices with their dictionaries), its occurrences, its documents, and a hash of language and term."""
    for batch in batches:
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        langs, sources = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
        salt = np.array([xxh3_64_intdigest(x.as_py().encode()) for x in lang.dictionary], np.uint64)
        for a, b, data, offsets in kernels.slices(batch.column(2)):
            w = kernels.find_words(data, offsets, lower=True, breaks=_BREAK)
            if not len(w.start):
                continue
            ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
            term = pa.StringArray.from_buffers(len(w.start), pa.py_buffer(ends), pa.py_buffer(w.data[~_BREAK[w.data]])).dictionary_encode()
            size = len(term.dictionary)
            held, times = np.unique(np.repeat(np.arange(b - a), np.diff(w.of)) * size + term.indices.to_numpy(), return_counts=True)
            of, t = a + held // size, held % size
            group, at = np.unique((langs[of] * len(source.dictionary) + sources[of]) * size + t, return_inverse=True)
            n, docs = np.bincount(at, times).astype(np.int64), np.bincount(at)
            (k, s), t = np.divmod(group // size, len(source.dictionary)), group % size
            yield lang.dictionary, source.dictionary, term.dictionary, k, s, t, n, docs, kernels.mix(_hashes(term.dictionary)[t] ^ salt[k])


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return (kernels.mix(h + np.uint64(row)) >> np.uint64(32) & np.uint64(width - 1)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, depth: int, most: int) -> Iterator[pa.RecordBatch]:
    """CELLS of this task's sketch, but for chunks in which nothing is."""
    table = np.zeros((depth, width), np.int64)
    for *_, docs, h in _tallied(batches):
        for row in range(depth):
            np.add.at(table[row], _cells(h, row, width), docs)
        np.minimum(table, most, out=table)
    yield from _chunks(dict(enumerate(table.astype(np.uint8).reshape(-1, min(width, CHUNK)))))


def _chunks(chunks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, cells in chunks.items():
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], schema=CELLS)


def _merge(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """CELLS of the merged chunks of this task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = np.frombuffer(zlib.decompress(cells.as_py()), np.uint8)
            sums[k] = np.minimum(sums[k].astype(np.uint16) + got, most).astype(np.uint8) if k in sums else got
    yield from _chunks(sums)


def sketch(rows: DataFrame, min_docs: int, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """The merged sketch of rows (lang, source, text): depth rows of width cells, of one byte each."""
    if not 1 <= min_docs <= 255 or width & (width - 1):
        raise ValueError("min_docs: 1 to 255; width: a power of two")
    parts = map_arrow(rows, lambda b: _sketch(b, width, depth, min_docs), "chunk int, cells binary")
    merged = map_arrow(parts.repartition("chunk"), lambda b: _merge(b, min_docs), "chunk int, cells binary")
    out = np.zeros((depth, width), np.uint8).reshape(-1, min(width, CHUNK))
    for k, cells in merged.collect():  # depth * width bytes at most
        out[k] = np.frombuffer(zlib.decompress(cells), np.uint8)
    return out.reshape(depth, width)


def _survivors(batches: Iterator[pa.RecordBatch], table: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of the terms that the sketch leaves possible, added up as far as memory is set aside for it."""
    tables: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTS.names)

    for langs, sources, terms, k, s, t, n, docs, h in _tallied(batches):
        possible = np.ones(len(h), bool)
        for row in range(len(table)):
            possible &= table[row][_cells(h, row, table.shape[1])] >= most
        named = [x.take(pa.array(i[possible])) for x, i in ((langs, k), (sources, s), (terms, t))]
        tables.append(pa.table([*named, pa.array(n[possible]), pa.array(docs[possible].astype(np.int64))], schema=COUNTS))
        if sum(x.num_rows for x in tables) > HELD_ROWS or sum(x.nbytes for x in tables) > HELD_BYTES:
            tables = [added()]
            if tables[0].num_rows > HELD_ROWS // 2 or tables[0].nbytes > HELD_BYTES // 2:
                yield from tables.pop().to_batches(max_chunksize=20_000)
    if tables:
        yield from added().to_batches(max_chunksize=20_000)


def weight(n: Column, total: Column, kept: Column) -> Column:
    """p of a term that occurs n times; total: N; kept: V."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * kept)).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """The divergence of two weights."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """One audit of a table of documents; intermediate tables lie in the shared folder."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, width: int = WIDTH, depth: int = DEPTH, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"):
        named = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
        self.rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in named))
        self.min_docs, spark = min_docs, docs.sparkSession
        shipped = spark.sparkContext.broadcast(sketch(self.rows, min_docs, width, depth))  # of fixed size
        found = map_arrow(self.rows, lambda b: _survivors(b, shipped.value, min_docs), "lang string, source string, term string, n long, docs long")
        #: lang, source, term, n, docs of all terms that the sketch leaves.
        self.counts = materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
        kept = self.counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= min_docs).select("lang", "term", "all")
        kept = small(materialise(kept, "kept-terms"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
        own = self.counts.join(kept, ["lang", "term"])
        sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
        every = self.rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "kept", "lang_total"])
        absent = F.when(F.col("kept") > 0, weight(F.lit(0), F.col("total"), F.col("kept")))
        #: lang, source, total (N), terms, kept (V), lang_total, p0: every group.
        self.groups = materialise(every.withColumn("p0", absent), "groups")
        of = own.join(small(self.groups), ["lang", "source"])
        p, q = weight(F.col("n"), F.col("total"), F.col("kept")), weight(F.col("all"), F.col("lang_total"), F.col("kept"))
        #: lang, source, term, p, q (the language's), p0: every kept term of every group that has it.
        self.weights = materialise(of.select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0"), "weights")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value, rank."""
        one = self.groups.select("lang", "source", "terms", "kept", "p0", F.pmod(F.xxhash64("source"), F.lit(PIECES)).alias("piece"))
        two = self.groups.select("lang", F.col("source").alias("other"), F.col("terms").alias("terms2"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))).alias("piece"))
        half = materialise(one.join(two, ["lang", "piece"]).filter("source < other").drop("piece"), "source-pairs")
        side = lambda a, b, p: half.select("lang", F.col(a).alias("source"), F.col(b).alias("other"), F.col(p).alias("q0"))
        alike = self.weights.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
        alone = side("source", "other", "q0").unionByName(side("other", "source", "p0")).join(alike, ["lang", "source"])
        alone = alone.groupBy("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other")).agg(F.sum(F.col("times") * apart(F.col("p"), F.col("q0"))).alias("alone"))
        b = self.weights.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p2"), F.col("p0").alias("q0"))
        both = self.weights.select("lang", "term", "source", "p", "p0").join(b, ["lang", "term"]).filter("source < other")
        c = F.col
        more = apart(c("p"), c("p2")) - apart(c("p"), c("q0")) - apart(c("p0"), c("p2"))
        both = both.groupBy("lang", "source", "other").agg(F.sum(more).alias("more"), F.count("*").alias("shared"))
        joined = half.join(alone, ["lang", "source", "other"], "left").join(both, ["lang", "source", "other"], "left").fillna(0, ["alone", "more", "shared"])
        absent = F.coalesce((c("kept") - c("terms") - c("terms2") + c("shared")) * apart(c("p0"), c("q0")), F.lit(0))
        value = joined.select("lang", "source", "other", (absent + c("alone") + c("more")).alias("value"))
        value = materialise(value, "pair-values")
        out = value.select("lang", "source", c("other").alias("item"), "value").unionByName(value.select("lang", c("other").alias("source"), c("source").alias("item"), "value"))
        return out.withColumn("rank", F.row_number().over(self._order()))

    def terms(self, top: int = TOP_TERMS) -> DataFrame:
        """lang, source, item (a term that the source has more of than its language), value, rank."""
        more = self.weights.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        return more.withColumn("rank", F.row_number().over(self._order())).filter(F.col("rank") <= top)

    @staticmethod
    def _order():
        return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def report(self, top: int = TOP_TERMS) -> DataFrame:
        """lang, source, part (pair or term), item, value, rank."""
        parts = (("pair", self.pairs()), ("term", self.terms(top)))
        one, two = (df.select("lang", "source", F.lit(k).alias("part"), "item", "value", "rank") for k, df in parts)
        return one.unionByName(two)
