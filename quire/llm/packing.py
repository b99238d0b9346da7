"""Packing along a space-filling curve: neighbouring documents share sequences, and no padding but at the end.

A document's token ids are hashed into a vector that is at once projected onto a few dimensions, the mean over
its ids of a fixed pseudo-random direction for each. Each coordinate is ranked against a normal distribution
with the mean and deviation over all documents, and the point's place on a Hilbert curve through the unit
cube is the document's key. Documents are sorted by key (and a hash of the id, which spreads equal ones) in
ranges of nearly equal token counts. The ids along that order form one stream, cut every `capacity` ids: each
id lies in exactly one piece, and only the last sequence can be short.

Texts are tokenised once, into a table of ids in the shared folder (two bytes an id where they fit). Ranges
come from quantiles of the keys; the sums of their tokens, of which the driver holds a bounded number, give
each range its place in the stream, so ranges are cut independently.

Null texts are empty: such a document is the end id alone. Repeated rows are packed as often as they come; however
many rows share a key (one text, and one id or none), their range is dealt out by their places.
An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import map_arrow, materialise

CAPACITY, END_ID = 2048, 1
#: Dimensions of the curve and bits of each.
DIMENSIONS, BITS = 4, 8
#: Ranges for each shuffle partition, and their greatest number (the driver holds two numbers for each).
RANGES_EACH, MOST_RANGES = 8, 8192
#: Bits of the id's hash in a key; with 32 bits of the curve the key is exact as a double, in which quantiles come.
SPREAD_BITS = 21

TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("point", pa.list_(pa.float32())), ("place", pa.int64())])
PIECES = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32")] + [("ids", pa.binary())])


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}


@lru_cache(2)
def encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], int]:
    """(texts -> ids, number of ids) of a tokenizer file, without special tokens added.

    A plain byte-level BPE vocabulary is run by the faster of the two installed engines after both have agreed on
    a set of probes; any other file by its own library.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [own.encode(t, add_special_tokens=False).ids for t in texts]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    size = own.get_vocab_size()
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = _byte_of()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        probes = ["", " a", "it's  12\n\n\tnaïve café 你好\U0001f600 x  ", "a" * 40, "   .;:--__", "The1st\r\nLINE", *special, *(f"x {s}y" for s in special)]
        if [fast.encode(p, allowed_special="all") for p in probes] == plain(probes):

            def quick(texts: list[str]) -> list[list[int]]:
                out = []
                for t in texts:
                    try:
                        out.append(fast.encode(t, allowed_special="all"))
                    except ValueError:  # its regular expressions give up on runs of very many spaces
                        out.append(own.encode(t, add_special_tokens=False).ids)
                return out

            return quick, size
    return plain, size


@lru_cache(2)
def directions(size: int, dimensions: int) -> np.ndarray:
    """A pseudo-random sign vector for each id."""
    h = kernels.mix(np.arange(size, dtype=np.uint64) + np.uint64(1))
    return np.stack([((h >> np.uint64(7 * d + 5)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dimensions)], 1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits; one row a point.

    Skilling's transform: from the top bit down, undo the turns of the subcubes, then read the Gray code.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - np.uint64(1)
        for d in range(dims):
            inside = (x[d] & q) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << np.uint64(1) | (x[d] >> np.uint64(level) & np.uint64(1))
    return key.astype(np.int64)


def tokenise(docs: DataFrame, tokenizer: str, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, ids (little-endian, of the width that the vocabulary needs), point, place (a number of the row): with
    the end id appended."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = encoder(tokenizer)
        table = directions(max(size, END_ID + 1), dimensions)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                n, packed, points = [], [], []
                for ids in run([t.as_py() or "" for t in part.column(1)]):
                    got = np.array([*ids, END_ID], kind)
                    n.append(len(got))
                    packed.append(got.tobytes())
                    points.append(table[got].mean(0))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(points, pa.list_(pa.float32())), part.column(2)], schema=TOKENS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    return map_arrow(rows, encode, "doc_id long, n long, ids binary, point array<float>, place long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, dimensions: int = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids (unsigned 32-bit): one row a piece."""
    if not 1 <= dimensions * bits <= 32:
        raise ValueError("the curve's key has at most 32 bits")
    spark = docs.sparkSession
    _, size = encoder(tokenizer)
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    tokens = materialise(tokenise(docs, tokenizer, dimensions, id_col, text_col), "tokens")
    stats = tokens.agg(*(f(F.col("point")[d]) for d in range(dimensions) for f in (F.avg, F.stddev_pop))).first()
    scale = [(stats[2 * d] or 0.0, stats[2 * d + 1] or 1.0) for d in range(dimensions)]

    @F.pandas_udf("long")
    def on_curve(point):
        from numpy import clip, stack, vectorize

        xy = stack(point.to_numpy()) if len(point) else np.zeros((0, dimensions))
        share = vectorize(erf, otypes=[float])((xy - [m for m, _ in scale]) / [max(s, 1e-9) * 2**0.5 for _, s in scale]) / 2 + 0.5
        import pandas as pd

        return pd.Series(hilbert(clip((share * 2**bits).astype(np.int64), 0, 2**bits - 1), bits))

    spread = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << SPREAD_BITS) - 1))
    keyed = tokens.withColumn("key", F.shiftleft(on_curve("point"), SPREAD_BITS).bitwiseOR(spread)).select("doc_id", "n", "ids", "key", "place")
    ranges = min(MOST_RANGES, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = Counter(keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [])
    # A key of several ranges' rows (equal texts of one id, or of none) gets a range that is dealt out by the rows' places.
    hot = {k for k, times in points.items() if times > 1}
    edges = np.array(sorted({*points, *(k + 1 for k in hot)}), np.int64)
    parts = np.array([1, *(points[k] + 1 if k in hot else 1 for k in edges.tolist())], np.int64)
    before_it = np.concatenate([[0], np.cumsum(parts)])

    @F.pandas_udf("int")
    def range_of(key, place):
        import pandas as pd

        at = np.searchsorted(edges, key.to_numpy(), "right")
        return pd.Series((before_it[at] + place.to_numpy() % parts[at]).astype(np.int32))

    dealt = keyed.withColumn("range", range_of("key", "place"))
    sums = dict(map(tuple, dealt.groupBy("range").agg(F.sum("n")).collect()))  # at most 2 * MOST_RANGES rows
    before, total = {}, 0
    for r in sorted(sums):
        before[r] = total
        total += sums[r]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            out = [[] for _ in PIECES]
            for r, doc_id, n, ids in zip(*(batch.column(i) for i in range(4)), strict=True):
                if (r := r.as_py()) != last:
                    last, at = r, before[r]
                doc_id, n, ids, start = doc_id.as_py(), n.as_py(), np.frombuffer(ids.as_py(), kind), 0
                while start < n:
                    length = min(n - start, capacity - at % capacity)
                    piece = ids[start : start + length].astype("<u4").tobytes()
                    for column, value in zip(out, (doc_id, start, length, n, at // capacity, at % capacity, zlib.crc32(piece), piece), strict=True):
                        column.append(value)
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES, strict=True)], schema=PIECES)

    sorted_parts = dealt.select("range", "doc_id", "n", "ids", "key").repartition("range").sortWithinPartitions("range", "key", "doc_id", "n", "ids")
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"
    return map_arrow(sorted_parts.select("range", "doc_id", "n", "ids"), cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n, ids (binary, unsigned 32-bit little-endian): the pieces put together. A sequence has at
    most `capacity` ids, so its group is bounded."""
    of = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return of.select("sequence_id", "n", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
