"""Parts of texts: paragraphs for excerpts, the part that answers a query, context blocks, and splits by tokens.

Paragraphs are spans of blocks. Running sums of the blocks' lengths say where each span ends, so a text is cut by one binary
search a paragraph; the same holds for sentences that are packed by tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.executors import map_arrow, ship
from .embedding import Embedder

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BLOCKS = re.compile(r"\n\n+|^(?=#{1,6}\s)", re.M)
_TITLE = re.compile(r"#{1,6}[^\S\n]+\S[^\n]*")

# The wording of a context and of an empty text, which prompts and callers look for.
CONTEXT_HEAD = "Relevant context for '%s':\n"
CONTEXT_BLOCK = "\n[%d] From '%s' - Chapter %s: %s\n(Similarity: %.2f)\n%s\n"
CONTEXT_NONE = "No relevant context found for: %s"
NO_CONTENT = "[No content]"


def _spans(sizes: Sequence[int], first: int, last: int, given: int, least: int) -> tuple[list[tuple[int, int]], int]:
    """(spans, rest): blocks first to last in spans of at least `least` characters, one between blocks; the rest is where
    the blocks begin that fill no span. given: characters that stand before the first block."""
    ends, out = np.cumsum([0, *(n + 1 for n in sizes[first:last])]), []
    at = 0
    while (end := max(at + 1, int(np.searchsorted(ends, least + 1 + ends[at] - given)))) < len(ends):
        out.append((first + at, first + end))
        at, given = end, 0
    return out, first + at


def excerpt_paragraphs(text: str, least: int = 50) -> list[str]:
    """Paragraphs of a text: blocks between blank lines and before titles, put together until they have `least` characters.

    A title opens a section and stands on its own line before the section's first paragraph; a section of nothing but a
    title, and blocks at the end of a section that fill no paragraph, are left out. At the end of the text they join the
    last paragraph, or are the only one.
    """
    blocks = [b for b in (b.strip() for b in _BLOCKS.split(text)) if b]
    titles = [i for i, b in enumerate(blocks) if _TITLE.fullmatch(b)]
    sizes, out, tail = [len(b) for b in blocks], [], ""
    for title, end in zip([-1, *titles], [*titles, len(blocks)], strict=True):
        head = f"{blocks[title]}\n" if title >= 0 else ""
        spans, rest = _spans(sizes, title + 1, end, len(head), least)
        out += [(head if a == title + 1 else "") + " ".join(blocks[a:b]) for a, b in spans]
        tail = ((head if rest == title + 1 else "") + " ".join(blocks[rest:end])).strip()
    return out if not tail else [*out[:-1], f"{out[-1]} {tail}"] if out else [tail]


def paragraph_rows(docs: DataFrame, least: int = 50, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, para, paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, k, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, p in enumerate(excerpt_paragraphs(t.as_py() or "", least))]
            ids, at, text = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.string())], names=["id", "para", "paragraph"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, "id long, para int, paragraph string")


def shortened(text: Column, n: int) -> Column:
    """At most n characters, without white space at their ends, and three dots where something is left out."""
    cut = F.regexp_replace(F.substring(text, 1, n), r"^\s+|\s+$", "")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)


def closeness(paragraphs: Sequence[Sequence[str]], query: np.ndarray, embedder: Embedder) -> list[list[float] | None]:
    """The cosines of each text's paragraphs with the query, in one call; a text of one paragraph needs none, and where the
    call fails each text is tried alone."""
    asked = [p if len(p) > 1 else [] for p in paragraphs]
    try:
        flat = [x for p in asked for x in p]
        m = np.array([list(v) for v in embedder(flat)], float) if flat else np.zeros((0, len(query)))
    except Exception:
        return [None] if len(asked) == 1 else [closeness([p], query, embedder)[0] for p in asked]
    size = np.sqrt((m * m).sum(1) * (query * query).sum())
    near = np.where(size > 0, m @ query / np.where(size > 0, size, 1), 0.0)
    return [x.tolist() or None for x in np.split(near, np.cumsum([len(p) for p in asked])[:-1])]


def relevant_excerpts(rows: DataFrame, vector: Sequence[float], embedder: Embedder, n: int = 500, text_col: str = "content") -> DataFrame:
    """rows with a column excerpt: the paragraph of each text that is most like the query's vector, at most n characters.

    For the results of a search. Of paragraphs equally like it, and where the embedder fails, it is the first; a text
    without any has a note instead. All is done where the row lies: paragraphs and their cosines are arrays of it.
    """
    query = np.array([float(x) for x in vector])
    ship(rows.sparkSession)

    @F.pandas_udf("struct<p: array<string>, near: array<double>>")
    def split(text: pd.Series) -> pd.DataFrame:
        p = [excerpt_paragraphs(t or "") for t in text]
        return pd.DataFrame({"p": p, "near": closeness(p, query, embedder)})

    best = F.get(F.col("_x.p"), F.coalesce(F.array_position("_x.near", F.array_max("_x.near")) - 1, F.lit(0)).cast("int"))
    out = rows.withColumn("_x", split(text_col))
    return out.withColumn("excerpt", F.when(F.size("_x.p") > 0, shortened(best, n)).otherwise(NO_CONTENT)).drop("_x")


def rag_context(query: str, results: DataFrame) -> str:
    """Numbered blocks of the results (book_title, chapter_number, chapter_title, similarity, excerpt), best first. For the
    three or so results that a prompt takes."""
    found = results.orderBy(F.desc("similarity"), "chapter_id").select("book_title", "chapter_number", "chapter_title", "similarity", "excerpt").collect()
    blocks = [CONTEXT_BLOCK % (i, *r) for i, r in enumerate(found, 1)]
    return "\n".join([CONTEXT_HEAD % query, *blocks]) if blocks else CONTEXT_NONE % query


def words_as_tokens(text: str) -> list[str]:
    """A stand-in for a tokenizer: a word and the space before it is one token, longer ones one for each eight characters."""
    return [x[i : i + 8] for x in re.findall(r"\s*\S+|\s+$", text) for i in range(0, len(x), 8)]


def token_split(text: str, most: int, encode: Callable[[str], list] = words_as_tokens, decode: Callable[[list], str] = "".join, whole: bool = False) -> list[str]:
    """Sentences packed in order into pieces of at most `most` tokens.

    A longer sentence is a piece of its own: its first `most` tokens, the others being dropped, or with whole=True all of
    its tokens in as many pieces as they fill.
    """
    sentences = _SENTENCE.split(text)
    tokens = [encode(s) for s in sentences]
    ends = np.cumsum([0, *map(len, tokens)])
    out, at = [], 0
    while at < len(sentences):
        if (size := len(tokens[at])) > most:
            out += [decode(tokens[at][k : k + most]) for k in range(0, size if whole else 1, most)]
            at += 1
        else:
            upto = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
            out.append(" ".join(sentences[at:upto]))
            at = upto
    return out
