"""Vectors for texts: an embedder's calls in bounded batches, only for what has changed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.executors import map_arrow
from .integrity import change_detection

#: Turns texts into vectors of one length. It runs on executors; a service's client is made inside it.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

# Limits of a call and of a text, in tokens and texts.
MAX_TOKENS, CALL_TOKENS, CALL_TEXTS = 8191, 250_000, 2048
#: Characters that count as a token.
TOKEN_CHARS = 4
_VECTORS = pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("error", pa.string())])


class HashEmbedder:
    """The default without any service: hashed words, signed and summed, of length 1. Equal texts have equal vectors,
    texts that share words are near each other."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for w in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(w.encode())
                v[h % self.dimensions] += 1 if h >> 63 else -1
            size = float(np.sqrt((v * v).sum()))
            out.append((v / size if size else v).tolist())
        return out


def calls(texts: Sequence[str], tokens: int = CALL_TOKENS, most: int = CALL_TEXTS) -> Iterator[range]:
    """Runs of texts, in order, that one call may hold."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) // TOKEN_CHARS + 1
        if i > start and (held + n > tokens or i - start == most):
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield range(start, len(texts))


def embed_texts(texts: Sequence[str], embedder: Embedder, tokens: int = CALL_TOKENS, most: int = CALL_TEXTS) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. Where a call fails its texts are tried one by one, so that one bad text costs itself only."""
    cut = [t[: MAX_TOKENS * TOKEN_CHARS] for t in texts]
    out: list[tuple[list[float] | None, str | None]] = []

    def call(part: list[str]) -> list[list[float]]:
        got = [[float(x) for x in v] for v in embedder(part)]
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        return got

    for run in calls(cut, tokens, most):
        part = [cut[i] for i in run]
        try:
            out += [(v, None) for v in call(part)]
        except Exception:
            for t in part:
                try:
                    out.append((call([t])[0], None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
    return out


def embed(rows: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, embedding, error: one row for each, in calls of bounded size. Empty and null texts have an error, not a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            full = [i for i, t in enumerate(texts) if t.strip()]
            got: list[tuple[list[float] | None, str | None]] = [(None, "empty text")] * len(texts)
            for i, x in zip(full, embed_texts([texts[i] for i in full], embedder), strict=True):
                got[i] = x
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string())], schema=_VECTORS)

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("id"), text_col), run, "id long, embedding array<float>, error string")


def incremental(chapters: DataFrame, stored: DataFrame, embedder: Embedder, force: bool = False) -> DataFrame:
    """id, change, embedding, error: vectors of the chapters that are new, changed, never tracked or forced; no others are read
    by the embedder. chapters: id, content, mtime, hash. stored: id, mtime, hash."""
    changes = change_detection(chapters.select("id", "mtime", "hash"), stored, force).filter(~F.col("change").isin("unchanged", "touched"))
    made = embed(chapters.select("id", "content").join(changes.select("id"), "id", "left_semi"), embedder)
    return changes.join(made, "id")


def sync_report(chapters: DataFrame, made: DataFrame) -> DataFrame:
    """total, updated, errors, skipped of an incremental run."""
    done = made.agg(F.count_if(F.col("error").isNull()).alias("updated"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    both = chapters.agg(F.count("*").alias("total")).join(done)  # a row each
    return both.withColumn("skipped", F.col("total") - F.col("updated") - F.col("errors"))


def store_vectors(stored: DataFrame, made: DataFrame, model: str, now: str) -> DataFrame:
    """id, embedding, embedding_model, updated_at: the stored vectors with those made now; rows with errors keep what they had."""
    fresh = made.filter(F.col("error").isNull()).select("id", "embedding", F.lit(model).alias("embedding_model"), F.to_timestamp(F.lit(now)).alias("updated_at"))
    return stored.select(fresh.columns).join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
