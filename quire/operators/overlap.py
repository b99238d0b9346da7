"""Overlapping coverage: pairs of similar vectors of different books, by an exact join that is pruned with pivots.

A few vectors are pivots, chosen far apart from a bounded sample. Every vector belongs to the cell of its nearest pivot, and
each cell knows the least and the greatest angle of its members to every pivot. Angles are a metric on unit vectors: two
vectors at most tau apart have angles to any pivot that differ by at most tau. So a vector visits another cell only if its
angle to each pivot lies within tau of the cell's range, and if its angle to the cell's pivot exceeds that to its own by at
most 2 tau. Of two cells the members of the first visit the second, so every pair that can be similar meets once.

Cells and their visitors are cut into blocks of about BLOCK_ROWS vectors by their counted numbers; a task multiplies two
blocks. No cell, however large or however many equal vectors it has, is one task's. Nothing is sampled but the pivots, which
change the work and not the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.executors import map_arrow, ship

#: Rows of a block of vectors; vectors of which pivots are chosen for each pivot, and the most pivots.
BLOCK_ROWS, SAMPLED, MOST_PIVOTS = 2048, 8, 256
#: Angles are compared with this much to spare, so that rounding never rules out a pair.
SPARE = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size > 0, size, 1)


def _rows(column: pa.Array) -> np.ndarray:
    """The unit vectors of a column of lists of equal length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def far_apart(unit: np.ndarray, k: int) -> np.ndarray:
    """k of the vectors, or as many as differ, each the farthest from those before it."""
    chosen = unit[:1]
    nearest = _angles(unit, chosen)[:, 0] if len(unit) else np.zeros(0)
    while len(chosen) < k and len(unit) and nearest.max() > SPARE:
        chosen = np.vstack([chosen, unit[np.argmax(nearest)]])
        nearest = np.minimum(nearest, _angles(unit, chosen[-1:])[:, 0])
    return chosen


def _ranges(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cell, n, low, high (angles to each pivot) of this task's vectors."""
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        if not len(batch):
            continue
        angle = _angles(_rows(batch.column(0)), pivots)
        cell = angle.argmin(1)
        for c in np.unique(cell):
            own = angle[cell == c]
            n, low, high = found.get(int(c), (0, np.inf, -np.inf))
            found[int(c)] = n + len(own), np.minimum(low, own.min(0)), np.maximum(high, own.max(0))
    yield from _as_cells(found)


def _as_cells(found: dict) -> Iterator[pa.RecordBatch]:
    if found:
        rows = [(c, n, low.tolist(), high.tolist()) for c, (n, low, high) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["cell", "n", "low", "high"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for c, n, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            m, a, b = found.get(c, (0, np.inf, -np.inf))
            found[c] = m + n, np.minimum(a, low), np.maximum(b, high)
    yield from _as_cells(found)


class Cells:
    """Pivots and what is known of their cells; all that the driver holds (at most MOST_PIVOTS squared numbers). There must
    be vectors."""

    def __init__(self, vectors: DataFrame, counted: int, pivots: int | None, tau: float):
        k = pivots or max(1, min(MOST_PIVOTS, int(counted**0.5) // 2))
        some = vectors.orderBy(F.xxhash64("id"), "id").select("embedding").limit(SAMPLED * k).collect()
        self.pivots, self.tau = far_apart(_unit(np.array([r[0] for r in some], float).reshape(len(some), -1)), k), tau + SPARE
        cells = "cell int, n long, low array<double>, high array<double>"
        own = map_arrow(vectors.select("embedding"), lambda b: _ranges(b, self.pivots), cells)
        rows = map_arrow(own.repartition("cell"), _merged, cells).collect()
        size = len(self.pivots)
        self.n, self.low, self.high = np.zeros(size, np.int64), np.full((size, size), np.inf), np.full((size, size), -np.inf)
        for r in rows:
            self.n[r.cell], self.low[r.cell], self.high[r.cell] = r.n, r.low, r.high

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's cell, and the later cells where a similar vector may be."""
        angle = _angles(unit, self.pivots)
        cell, out = angle.argmin(1), []
        for a, c in zip(angle, cell):
            may = (self.n > 0) & (np.arange(len(a)) > c) & (a <= a[c] + 2 * self.tau)
            at = np.flatnonzero(may)
            out.append(at[((a >= self.low[at] - self.tau) & (a <= self.high[at] + self.tau)).all(1)])
        return cell, out


def _dealt(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vectors (id, others, embedding) with cell, and home (whether the cell is the vector's own): a row for each cell that
    it is in or visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, visited = cells.visits(_rows(batch.column(batch.num_columns - 1)))
            row = np.repeat(np.arange(len(own)), [1 + len(v) for v in visited])
            where = np.concatenate([[c, *v] for c, v in zip(own, visited)])
            home = np.diff(row, prepend=-1) > 0
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(where.astype(np.int32)), pa.array(home)], names=[*batch.schema.names, "cell", "home"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return map_arrow(vectors, deal, f"{kinds}, cell int, home boolean")


def _tasks(vectors: DataFrame, cells: Cells, block_rows: int, apart: Sequence[str]) -> DataFrame:
    """id, the columns of apart, embedding, _side, cell, i, j: each vector in all pairs of blocks (i, j) of a cell that it is
    in; _side tells in which of the two."""
    dealt = _dealt(vectors, cells)
    visitors = {r[0]: r[1] for r in dealt.filter("NOT home").groupBy("cell").count().collect()}  # a row a cell
    blocks = lambda n: max(1, -(-int(n) // block_rows))
    known = F.array(*(F.struct(F.lit(blocks(n)).alias("own"), F.lit(-(-visitors.get(c, 0) // block_rows)).alias("visiting")) for c, n in enumerate(cells.n.tolist())))
    cell = dealt.withColumn("_c", T.pinned(F.get(known, "cell")))
    place = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("_c.own")).otherwise(F.greatest(F.col("_c.visiting"), F.lit(1)))).cast("int")
    placed = cell.withColumn("_p", place)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # A task is two blocks: (i, j) of members with i <= j, or block i of members with block own + v of visitors.
    home = F.transform(upto(F.col("_c.own")), lambda o: F.struct(F.least("_p", o).alias("i"), F.greatest("_p", o).alias("j")))
    met = F.when(F.col("_c.visiting") > 0, F.transform(upto(F.greatest("_c.visiting", F.lit(1))), lambda v: F.struct(F.col("_p").alias("i"), (F.col("_c.own") + v).cast("int").alias("j")))).otherwise(F.array().cast("array<struct<i: int, j: int>>"))
    away = F.transform(upto(F.col("_c.own")), lambda o: F.struct(o.alias("i"), (F.col("_c.own") + F.col("_p")).cast("int").alias("j")))
    tasks = placed.withColumn("_t", F.explode(F.when(F.col("home"), F.concat(home, met)).otherwise(away)))
    side = F.when(~F.col("home"), F.col("_c.own") + F.col("_p")).otherwise(F.col("_p")).cast("int")
    return tasks.select("id", *apart, "embedding", side.alias("_side"), "cell", F.col("_t.i").alias("i"), F.col("_t.j").alias("j"))


def similar_pairs(rows: DataFrame, least: float, block_rows: int = BLOCK_ROWS, apart: Sequence[str] = ("book_id",), limit: int | None = None, pivots: int | None = None) -> DataFrame:
    """a, b, similarity: the pairs of vectors (id, embedding) of cosine `least` or more that differ in every column of `apart`.

    least: above 0, up to 1. limit: only the best so many, by similarity rounded to three places, then by a and b; a task
    then hands on no more than so many. Rows without vector, or with one of zeros, are in no pair.
    """
    if not 0 < least <= 1:
        raise ValueError("least: above 0, up to 1")
    ship(rows.sparkSession)
    vectors = rows.filter(F.exists("embedding", lambda x: x != 0)).select("id", *apart, F.col("embedding").cast("array<float>").alias("embedding"))
    result = "a long, b long, similarity double"
    if not (counted := vectors.count()):
        return rows.sparkSession.createDataFrame([], result)
    if pivots is None and counted <= block_rows:  # one block: nothing to rule out
        one = F.lit(0)
        tasks = vectors.select("id", *apart, "embedding", one.alias("_side"), one.alias("cell"), one.alias("i"), one.alias("j"))
    else:
        tasks = _tasks(vectors, Cells(vectors, counted, pivots, float(np.arccos(least))), block_rows, apart)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group.i.iloc[0], group.j.iloc[0]
        left, right = group[group._side == i], group[group._side == j]
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        m = _unit(np.stack(left.embedding).astype(float)) @ _unit(np.stack(right.embedding).astype(float)).T
        a, b = left.id.to_numpy(), right.id.to_numpy()
        held = m >= least
        for c in apart:
            codes = pd.factorize(pd.concat([left[c], right[c]]))[0]
            held &= codes[: len(left), None] != codes[None, len(left) :]
        if i == j:
            held &= a[:, None] < b[None, :]
        r, c = np.nonzero(held)
        out = pd.DataFrame({"a": np.minimum(a[r], b[c]), "b": np.maximum(a[r], b[c]), "similarity": m[r, c]})
        if limit is not None and len(out) > limit:
            rank = np.round(out.similarity.to_numpy(), 3)
            out = out[rank >= np.partition(rank, len(rank) - limit)[len(rank) - limit]]
            out = out.iloc[np.lexsort((out.b, out.a, -np.round(out.similarity, 3)))[:limit]]
        return out

    found = tasks.groupBy("cell", "i", "j").applyInPandas(compare, result)
    return found if limit is None else found.orderBy(F.desc(F.round("similarity", 3)), "a", "b").limit(limit)


def duplicate_coverage(rows: DataFrame, chapters: DataFrame, least: float = 0.7, most: int = 50, each: int = 10, high: int = 3, pivots: int | None = None) -> DataFrame:
    """The best pairs of chapters of different books, by topic: topic, overlap_count, high_overlap, place, similarity, a, b,
    chapter_a, chapter_b, title_a, title_b.

    rows: id, chapter_id, book_id, book_title, embedding. chapters: id, title. The `most` best pairs; a pair's topic is the
    first one of both titles; topics with `high` pairs or more are marked, and of each topic the first `each` pairs are listed.
    """
    found = similar_pairs(rows, least, apart=("book_id", "book_title"), limit=most, pivots=pivots)
    pairs = rows.sparkSession.createDataFrame(found.collect(), found.schema)  # `most` rows: the join is run once
    of = rows.select("id", "chapter_id").join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id")  # 2 * most rows
    named = chapters.select(F.col("id").alias("chapter_id"), "title").join(F.broadcast(of), "chapter_id", "right").select("id", "chapter_id", F.coalesce("title", F.lit("")).alias("title"))
    side = lambda c: named.select(F.col("id").alias(c), F.col("chapter_id").alias(f"chapter_{c}"), F.col("title").alias(f"title_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    told = both.withColumn("topic", F.get(T.topics(F.concat_ws(" ", "title_a", "title_b")), F.lit(0))).withColumn("similarity", F.round("similarity", 3))
    own = Window.partitionBy("topic")
    told = told.withColumn("overlap_count", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy(F.desc("similarity"), "a", "b")))
    return told.filter(F.col("place") <= each).select("topic", "overlap_count", (F.col("overlap_count") >= high).alias("high_overlap"), "place", "similarity", "a", "b", "chapter_a", "chapter_b", "title_a", "title_b")
