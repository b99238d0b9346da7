"""Chunks of texts: a sequential fold, on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.executors import map_arrow
from .excerpts import token_split, words_as_tokens

TARGET, LEAST, SINGLE, HUGE = 500, 100, 600, 1000
#: Tokens of a chunk at most.
MAX_TOKENS = 8000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def count(text: str) -> int:
    return len(text.split())


def windows(text: str, target: int = TARGET, overlap: int = 2, least: int = LEAST) -> list[str]:
    """Sentences packed to about target words; each window repeats the last sentences of the one before."""
    sentences = [s for s in _SENTENCE.split(text.strip()) if s]
    out: list[list[str]] = []
    at = 0
    while at < len(sentences):
        first = max(0, at - overlap) if out else 0
        size, end = sum(count(s) for s in sentences[first:at]), at
        while end < len(sentences) and (end == at or size + count(sentences[end]) <= target):
            size += count(sentences[end])
            end += 1
        fresh = sum(count(s) for s in sentences[at:end])
        if out and end == len(sentences) and fresh < least:
            out[-1].extend(sentences[at:end])
        else:
            out.append(sentences[first:end])
        at = end
    return [" ".join(w) for w in out]


def chunk(text: str, target: int = TARGET, least: int = LEAST) -> list[str]:
    """Paragraphs packed to about target words with one paragraph of overlap; short texts whole, huge pieces by sentences."""
    if not text.strip():
        return []
    paras = [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]
    total = sum(map(count, paras))
    packs: list[list[str]] = []
    if total <= SINGLE:
        packs = [paras]
    else:
        held: list[str] = []
        fresh = 0
        for p in paras:
            if held and fresh and sum(map(count, held)) + count(p) > target:
                packs.append(held)
                carried = held[-1:] if count(held[-1]) + count(p) <= target else []
                held, fresh = list(carried), 0
            held.append(p)
            fresh += count(p)
        if packs and fresh < least:
            packs[-1].extend(held[-1:] if len(held) == 1 else [p for p in held if p is not packs[-1][-1]])
        else:
            packs.append(held)
    out: list[str] = []
    for pack in packs:
        body = "\n\n".join(pack)
        out += windows(body, target, least=least) if count(body) > HUGE else [body]
    return out


def chunks(docs: DataFrame, target: int = TARGET, id_col: str = "id", text_col: str = "content", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """chapter_id, chunk_index, content, word_count, content_hash. A chunk of more than max_tokens tokens is split at sentences,
    a longer sentence into as many pieces as it fills: no word is lost."""

    def limited(c: str) -> list[str]:
        if len(c) <= max_tokens or len(words_as_tokens(c)) <= max_tokens:
            return [c]
        return [p for p in token_split(c, max_tokens, whole=True) if p.strip()]

    def run(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, text = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, c in enumerate(p for c in chunk(t.as_py() or "", target) for p in limited(c)):
                    ids.append(i)
                    index.append(k)
                    text.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(text, pa.string())], names=["chapter_id", "chunk_index", "content"])

    out = map_arrow(docs.select(F.col(id_col).cast("long"), text_col), partial(run, target=target), "chapter_id long, chunk_index int, content string")
    from ..functions.text import word_count

    return out.select("*", word_count(F.col("content")).alias("word_count"), F.sha2("content", 256).alias("content_hash"))
