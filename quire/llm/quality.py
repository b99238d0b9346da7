"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is computed in time linear
in the number of features, as half the sum over the dimensions f of (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2.

Features: words, hashed into WORD_BINS bins, weighted by log(1 + count) and scaled to length 1 for each text;
each structure statistic and the metadata column, cut into STEPS steps of which one is 1. Statistics read the
whole text. The model is trained on the driver from at most MAX_TRAIN labelled rows, those with the smallest
hash of the id, as far as their features fit into MAX_BYTES; its size is fixed. Scoring is one pass without an exchange.

Null and empty texts have the features of no words and get the score that the model gives those. Null labels are
skipped; of several labels of a document the largest counts; null ids have no label and are not held out.
Without any label to learn from, every score is 0.5. Repeated rows get equal scores; an empty table gives no
rows. The metadata column may be absent or null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import map_arrow, materialise

WORD_BINS, STEPS, RANK = 1 << 15, 16, 8
#: Bound of the training sample, and how it is walked.
MAX_TRAIN, EPOCHS, BATCH, RATE, DECAY = 10_000, 6, 128, 0.05, 1e-5
MAX_BYTES = 256 << 20
THRESHOLD = 0.7
STATISTICS = ("words", "word_bytes", "capitals", "digits", "symbols", "points", "other_bytes", "lines", "words_a_line", "distinct_words", "repeated_runs", "repeated_lines", "short_words", "metadata")
SIZE = WORD_BINS + STEPS * len(STATISTICS)

_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@+"]] = 3
_KINDS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KINDS[128:] = 5


class Features(NamedTuple):
    """Sparse rows: those of row i are at of[i]:of[i+1]."""

    index: np.ndarray
    value: np.ndarray
    of: np.ndarray


class Model(NamedTuple):
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def _step(share: np.ndarray) -> np.ndarray:
    return np.clip((np.nan_to_num(share) * STEPS).astype(np.int64), 0, STEPS - 1)


def features(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> Features:
    """Of the texts of a slice. metadata: a length in characters, or 0."""
    w = kernels.find_words(data, offsets)
    h = kernels.hash_words(w)
    lower = kernels.hash_words(kernels.find_words(data, offsets, lower=True)) & np.uint64(WORD_BINS - 1)
    runs, of = kernels.shingles(w, h, 5)
    sizes = np.diff(offsets)
    kinds = np.zeros((6, len(w)))
    row = np.repeat(np.arange(len(w)), sizes)
    for k in range(1, 6):
        kinds[k] = np.bincount(row[_KINDS[data] == k], minlength=len(w))
    # Capitals of two bytes, such as accented ones, follow the byte C3.
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) if len(data) > 1 else np.zeros(0, np.int64)
    kinds[1] += np.bincount(row[wide], minlength=len(w))
    lines = np.bincount(row[data == 10], minlength=len(w)) + 1
    length = w.end - w.start
    n = np.diff(w.of)
    word_row = np.repeat(np.arange(len(w)), n)
    total = np.maximum(1, np.bincount(word_row, weights=length, minlength=len(w)))
    short = np.bincount(word_row[length <= 2], minlength=len(w))
    bins, values, ends, distinct, repeated, same_lines = [], [], [0], np.ones(len(w)), np.zeros(len(w)), np.zeros(len(w))
    cut = np.flatnonzero(data == 10)
    sums = np.concatenate([[0], np.cumsum(h, dtype=np.uint64)]).astype(np.uint64)
    for i in range(len(w)):
        a, b = w.of[i], w.of[i + 1]
        if b > a:
            distinct[i] = len(np.unique(h[a:b])) / (b - a)
            own = runs[of[i] : of[i + 1]]
            repeated[i] = 1 - len(np.unique(own)) / len(own)
            inner = cut[np.searchsorted(cut, offsets[i]) : np.searchsorted(cut, offsets[i + 1])]
            edge = np.concatenate([[a], np.searchsorted(w.start, inner), [b]])
            line = (sums[edge[1:]] - sums[edge[:-1]])[np.diff(edge) > 0]
            same_lines[i] = 1 - len(np.unique(line)) / len(line)
            found, count = np.unique(lower[a:b], return_counts=True)
            x = np.log1p(count)
            bins.append(found.astype(np.int64))
            values.append((x / np.sqrt((x * x).sum())).astype(np.float32))
        ends.append(ends[-1] + (len(bins[-1]) if b > a else 0))
    many = np.maximum(1, n)
    shares = [np.log1p(n) / 12, total / many / 16, 2 * kinds[1] / total, 2 * kinds[2] / total, 3 * kinds[3] / many, 2 * kinds[4] / many, kinds[5] / total, np.log1p(lines) / 8, np.log1p(n / lines) / 8, distinct, repeated, same_lines, short / many, np.log1p(np.maximum(0, metadata)) / 16]
    dense = WORD_BINS + STEPS * np.arange(len(shares))[:, None] + np.stack([_step(s) for s in shares])
    counts, ends = np.diff(ends), np.array(ends)
    start = ends[:-1] + len(shares) * np.arange(len(w))
    index = np.empty(ends[-1] + dense.size, np.int32)
    value = np.full(len(index), 1 / np.sqrt(len(shares)), np.float32)
    at = np.arange(ends[-1]) + len(shares) * np.repeat(np.arange(len(w)), counts)
    if bins:
        index[at], value[at] = np.concatenate(bins), np.concatenate(values)
    for k, column in enumerate(dense):
        index[start + counts + k] = column
    return Features(index, value, np.concatenate([start, [len(index)]]))


def margin(m: Model, x: Features) -> np.ndarray:
    """b + linear + pairwise terms, in time linear in the features."""
    part = m.factor[x.index] * x.value[:, None]
    total = np.add.reduceat(part, x.of[:-1], 0)
    square = np.add.reduceat(part * part, x.of[:-1], 0)
    return m.bias + np.add.reduceat(m.weight[x.index] * x.value, x.of[:-1]) + (total * total - square).sum(1) / 2


def scores(m: Model, x: Features) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin(m, x).astype(float), -30, 30)))


def _take(x: Features, rows: np.ndarray) -> Features:
    n = np.diff(x.of)[rows]
    of = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(of[-1]) - np.repeat(of[:-1], n) + np.repeat(x.of[:-1][rows], n)
    return Features(x.index[at], x.value[at], of)


def train(x: Features, y: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, adaptive steps per parameter, fixed order: the same model from the same rows."""
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    bias, seen_b = 0.0, 1e-6
    seen_w, seen_f = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a : a + BATCH]
            part = _take(x, pick)
            g = ((scores(Model(bias, weight, factor), part) - y[pick]) / len(pick)).astype(np.float32)
            each = np.repeat(g, np.diff(part.of)) * part.value
            v = factor[part.index]
            total = np.add.reduceat(v * part.value[:, None], part.of[:-1], 0)
            pull = np.repeat(total, np.diff(part.of), 0) - v * part.value[:, None]
            touched, where = np.unique(part.index, return_inverse=True)
            gw = np.bincount(where, weights=each, minlength=len(touched)).astype(np.float32) + DECAY * weight[touched]
            gf = np.stack([np.bincount(where, weights=each * pull[:, f], minlength=len(touched)) for f in range(RANK)], 1).astype(np.float32) + DECAY * factor[touched]
            seen_w[touched] += gw * gw
            seen_f[touched] += gf * gf
            weight[touched] -= RATE * 4 * gw / np.sqrt(seen_w[touched])
            factor[touched] -= RATE * gf / np.sqrt(seen_f[touched])
            seen_b += float(g.sum()) ** 2
            bias -= RATE * 4 * float(g.sum()) / seen_b**0.5
    return Model(bias, weight, factor)


def held_out(ident: str) -> Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 4 == 2, F.lit(False))


def _prepared(docs: DataFrame, id_col: str, text_col: str, metadata_col: str) -> DataFrame:
    extra = F.coalesce(F.col(metadata_col).cast("double"), F.lit(0.0)) if metadata_col in docs.columns else F.lit(0.0)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), extra.alias("extra"))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """index, value (binary), label, place of the rows (text, extra, label, place)."""
    for batch in batches:
        extra = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in kernels.slices(batch.column(0)):
            x = features(data, offsets, extra[a:b])
            cells = [[v[s:e].tobytes() for s, e in zip(x.of, x.of[1:])] for v in (x.index, x.value)]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary()), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)], names=["index", "value", "label", "place"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata_col: str = "n_chars") -> Model | None:
    """A model from at most max_train labelled rows that are not held out; None if there are none with both labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = _prepared(docs, id_col, text_col, metadata_col).join(F.broadcast(known), "id")  # at most max_train rows
    # Of several texts of one id that with the least hash is taken: the model depends on the rows, not on their order.
    least = F.min_by(F.struct("text", "extra"), F.struct(F.xxhash64("text"), "text", "extra"))
    one = rows.groupBy("id", "label").agg(least.alias("t")).select("t.text", "t.extra", "label", F.xxhash64("id").alias("place"))
    held = materialise(map_arrow(one.select("text", "extra", "label", "place"), _featured, "index binary, value binary, label int, place long"), "training-rows")
    sizes = sorted((r[0], r[1]) for r in held.select("place", F.octet_length("index") + F.octet_length("value")).collect())  # at most max_train pairs
    last, total = None, 0
    for place, size in sizes:
        total += size
        if total > max_bytes and last is not None:
            held = held.filter(F.col("place") <= last)
            break
        last = place
    got = held.select("index", "value", "label").toArrow()  # at most max_bytes, but for one text
    y = got.column("label").to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    index, value = (got.column(c).to_pylist() for c in ("index", "value"))
    order = sorted(range(len(y)), key=lambda i: (index[i], value[i]))
    of = np.concatenate([[0], np.cumsum([len(index[i]) // 4 for i in order])])
    x = Features(np.frombuffer(b"".join(index[i] for i in order), np.int32), np.frombuffer(b"".join(value[i] for i in order), np.float32), of)
    return train(x, y[order])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", metadata_col: str = "n_chars") -> DataFrame:
    """id, score: one row for each row of docs."""
    rows = _prepared(docs, id_col, text_col, metadata_col)
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        for batch in batches:
            extra = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in kernels.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores(m, features(data, offsets, extra[a:b])))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, score double").withColumnRenamed("id", id_col)
