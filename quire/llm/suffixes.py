"""Suffix-array dedup on sparse suffixes: passages of at least MIN_WORDS words that occur more than once.

Suffixes are retained only where content selects them: in each window of MIN_WORDS words, at the k-gram with
the least hash (the leftmost of equal ones). Two occurrences of a passage of MIN_WORDS words therefore retain
the suffix at the same place of it. The retained suffixes are sorted by their first k words and each is compared
with its neighbours; one that differs from both begins no repeat and goes. The others are sorted once more, by the
k words and then word by word by what follows them, and neighbours tell how far each matches to the right: a run of
neighbours that all share r words is all suffixes that do. In the same way classes of equal words before the suffix
tell how far it matches to the left. A passage repeats where one class to the left and one run to the right have two
suffixes in common and both lengths and k make MIN_WORDS: every pair of equal passages is found, not only
those of neighbours, since runs and classes hold all suffixes. Matches compare hashes of single words (of 32 bits,
the first k together by 64), fifty or more of them in a row.

Suffixes that begin alike lie in one task, unless more than HOT do: those are matched by hashes (of 128 bits) of
the windows around them, aggregated before they move.

Words are runs of characters other than white space, compared as they are. Texts of fewer than MIN_WORDS words
have no spans. Equal texts are treated once; each of their rows is one span from end to end. Null texts are
empty; null ids rank behind all others. Rows that repeat an id and text give equal spans. An empty table
gives no spans. Other columns are ignored by `repeats` and passed on by `remove`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import map_arrow, materialise, small

MIN_WORDS, GRAM = 50, 12
#: Suffixes with the same first words up to which they are matched in one task.
HOT = 20_000
#: Suffixes of which a task holds the words around at a time, but for those that begin alike.
HELD = 4_000
#: Suffixes, and suffixes with the words around them, of a partition, and the most partitions of a sort: tasks stay small
#: at any size of the shuffles' partitions that the session sets.
SORTED_EACH, AROUND_EACH, MOST_PARTS = 200_000, 20_000, 20_000
TEXTS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
KEPT = pa.schema([("gram", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32())])
AROUND = pa.schema([("gram", pa.int64()), ("follows", pa.binary()), ("before", pa.binary()), ("id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32())])
FOUND = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("later", pa.bool_()), ("start", pa.int32()), ("last", pa.int32()), ("source", pa.int64())])
WINDOWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())])
SPANS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("later", pa.bool_()), ("start", pa.int64()), ("n_words", pa.int64()), ("source", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    name = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {name[f.type]}" for f in schema)


def _sparse(batches: Iterator[pa.RecordBatch], min_words: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The retained suffixes of each text: the hashes of their first words, and their places."""
    for batch in batches:
        for a, b, data, offsets in kernels.slices(batch.column(2)):
            w = kernels.find_words(data, offsets)
            h = kernels.hash_words(w)
            hashed = kernels.run_hashes(h, gram)
            bits = np.uint64(max(1, len(hashed).bit_length()))
            marked = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
            least = (kernels.sliding_min(marked, min_words - gram + 1) if len(h) >= min_words else marked[:0]) & ((np.uint64(1) << bits) - np.uint64(1))
            n, grams, places = [], [], []
            for i in range(len(w)):
                first, end = int(w.of[i]), int(w.of[i + 1])
                at = np.unique(least[first : max(first, end - min_words + 1)]).astype(np.int64)
                n.append(end - first)
                places.append((at - first).astype(np.int32))
                grams.append(kernels.signed(hashed[at]))
            of = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.ListArray.from_arrays(of, pa.array(np.concatenate(grams), pa.int64())), pa.ListArray.from_arrays(of, pa.array(np.concatenate(places), pa.int32()))],
                schema=TEXTS,
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows (gram, text_hash, place) that share the gram with a neighbour.

    Rows of equal texts are skipped. The first and last rows of a range are kept unseen: their neighbours lie in
    another range, and a suffix kept in vain only costs a comparison later.
    """
    held = np.zeros((0, 3), np.int64)
    first = True
    emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], schema=KEPT)
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)])
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(1)
        rows = rows[fresh]
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.zeros(len(rows), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if first and len(rows):
            # A lone row is held, not emitted: it is still the first one in the next batch.
            keep[0], first = True, len(rows) < 2
        # The last two rows wait for what follows; the older one is there for comparison only.
        done = rows[: max(0, len(rows) - 1)][keep[: max(0, len(rows) - 1)]]
        held = rows[-2:] if len(rows) > 1 else rows
        if len(done):
            yield emit(done)
    if len(held):
        yield emit(held[-1:])


def _around(batches: Iterator[pa.RecordBatch], reach: int, gram: int) -> Iterator[pa.RecordBatch]:
    """AROUND of the rows (id, text_hash, places, text): the hashes of up to reach words after the first ones of each
    suffix, and of those before it, nearest first; four bytes a word, so that their order as bytes is one word by word."""
    for batch in batches:
        for a, b, data, offsets in kernels.slices(batch.column(3)):
            w = kernels.find_words(data, offsets)
            h = kernels.hash_words(w)
            out: list[list] = [[] for _ in AROUND]
            for i in range(len(w)):
                own = h[w.of[i] : w.of[i + 1]]
                big, hashed = (own >> np.uint64(32)).astype(">u4"), kernels.signed(kernels.run_hashes(own, gram))
                for p in sorted(batch.column(2)[a + i].as_py()):
                    row = (int(hashed[p]), big[p + gram : p + gram + reach].tobytes(), big[max(0, p - reach) : p][::-1].tobytes(), batch.column(0)[a + i].as_py(), batch.column(1)[a + i].as_py(), p)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, AROUND, strict=True)], schema=AROUND)


def _words(cells: list[bytes], reach: int) -> np.ndarray:
    """A row of numbers for each cell: equal words have equal ones, and places behind the end have one of their own."""
    n = len(cells)
    size = np.array([len(c) // 4 for c in cells])
    _, number = np.unique(np.frombuffer(b"".join(cells), ">u4"), return_inverse=True)
    out = np.repeat((np.arange(n) + len(number))[:, None], max(1, reach), 1)
    out[np.arange(max(1, reach)) < size[:, None]] = number
    return out[:, :reach]


def _matched(gram: np.ndarray, follows: list[bytes], before: list[bytes], order: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in order of gram and follows, and each number of words to the left, greatest first: whether the window
    there occurs again, the suffix of its first occurrence, and whether this is a later one. order: rank of the suffixes'
    texts and places."""
    n = len(gram)
    right, left = _words(follows, reach), _words(before, reach)
    common = np.full(n, -1)  # words shared with the suffix before, -1 if it begins otherwise
    alike = np.concatenate([right[1:] == right[:-1], np.zeros((max(0, n - 1), 1), bool)], 1)
    common[1:] = np.where(gram[1:] == gram[:-1], np.argmin(alike, 1), -1)
    _, class_of = np.unique(gram, return_inverse=True)
    hit, later, first = np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), np.int64)
    by_order = np.argsort(order)
    for words in range(reach + 1):
        if words:
            _, class_of = np.unique(class_of.astype(np.int64) * (left.max() + 1) + left[:, words - 1], return_inverse=True)
        run = np.cumsum(common < reach - words)
        _, group, times = np.unique(run.astype(np.int64) * n + class_of, return_inverse=True, return_counts=True)
        least = np.full(len(times), n)
        np.minimum.at(least, group, order)
        at = reach - words
        hit[:, at], first[:, at] = times[group] > 1, by_order[least[group]]
        later[:, at] = hit[:, at] & (order != least[group])
    return hit, first, later


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true cells in a row."""
    padded = np.pad(mask, ((0, 0), (1, 1)))
    row, start = np.nonzero(padded[:, 1:] & ~padded[:, :-1])
    _, end = np.nonzero(padded[:, :-1] & ~padded[:, 1:])
    return row, start, end - 1


def _match(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """FOUND: runs of windows that occur again, from AROUND sorted by gram and follows; suffixes that begin alike together."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        gram, text, place = (rows.column(c).to_numpy() for c in ("gram", "text_hash", "place"))
        ids = rows.column("id").to_pylist()
        least = np.array([0 if i is None else i for i in ids], np.int64)
        none = np.array([i is None for i in ids], bool)
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((place, text, least, none))] = np.arange(len(ids))
        hit, first, later = _matched(gram, rows.column("follows").to_pylist(), rows.column("before").to_pylist(), order, reach)
        out: list[list] = [[] for _ in FOUND]
        for kind, mask in ((False, hit), (True, later)):
            row, a, b = _runs(mask)
            source = first[row, a]
            out[0] += [ids[i] for i in row]
            out[1] += text[row].tolist()
            out[2] += [kind] * len(row)
            out[3] += (place[row] - reach + a).tolist()
            out[4] += (place[row] - reach + b).tolist()
            out[5] += [ids[i] for i in source]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND, strict=True)], schema=FOUND)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= HELD:
            rows = pa.Table.from_batches(held)
            gram = rows.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last ones may go on
            if cut:
                yield spans(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held and sum(map(len, held)):
        yield spans(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """WINDOWS: two hashes of each window around the suffixes of AROUND."""
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(reach, base)]).astype(np.uint64))
    for batch in batches:
        gram = batch.column(0).to_numpy().view(np.uint64)
        sums = []
        for column in (1, 2):
            size = np.array([len(c) // 4 for c in batch.column(column).to_pylist()], int)
            m = np.zeros((len(batch), reach), np.uint64)
            m[np.arange(reach) < size[:, None]] = np.frombuffer(b"".join(batch.column(column).to_pylist()), ">u4")
            sums.append((size, m))
        row, words = np.nonzero((np.arange(reach + 1) <= sums[1][0][:, None]) & (reach - np.arange(reach + 1) <= sums[0][0][:, None]))
        keys = []
        for salt in (np.uint64(1), np.uint64(2)):
            right, left = (np.concatenate([np.zeros((len(batch), 1), np.uint64), np.cumsum(kernels.mix(m + salt) * power[:reach], 1, dtype=np.uint64)], 1) for _, m in sums)
            keys.append(kernels.mix(gram[row] ^ kernels.mix(left[row, words] ^ kernels.mix(right[row, reach - words] + words.astype(np.uint64) + salt))))
        yield pa.RecordBatch.from_arrays([*(pa.array(kernels.signed(k)) for k in keys), batch.column(3).take(pa.array(row)), batch.column(4).take(pa.array(row)), pa.array((batch.column(5).to_numpy()[row] - words).astype(np.int32))], schema=WINDOWS)


def _hot_spans(around: DataFrame, reach: int) -> DataFrame:
    """FOUND of suffixes that begin like very many others: windows counted before they move, frequent ones joined by broadcast."""
    windows = materialise(map_arrow(around, partial(_windows, reach=reach), _ddl(WINDOWS)), "hot-windows")
    key = ["k1", "k2"]
    again = windows.groupBy(*key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "at")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    again = materialise(again.select(*key, F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.at").alias("first_at"), "times"), "hot-repeats")
    often = small(materialise(again.filter(F.col("times") > HOT // 10), "hot-often"))
    hits = windows.join(often, key).unionByName(windows.join(often.select(*key), key, "left_anti").join(again.filter(F.col("times") <= HOT // 10), key))
    later = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("at") == F.col("first_at")))
    kinds = F.explode(F.when(later, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    return hits.select("id", "text_hash", kinds.alias("later"), F.col("at").alias("start"), F.col("at").alias("last"), F.col("first_id").alias("source"))


def _merge(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """SPANS of the rows (id, text_hash, runs of windows of one text): windows that meet or overlap are one span. Of several
    sources of a window the least is that of all its occurrences."""
    for batch in batches:
        out = []
        for ident, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            runs = runs.as_py()
            for later in (False, True):
                own = sorted((x["start"], x["source"] is None, x["source"], x["last"]) for x in runs if x["later"] == later)
                spans: list[list] = []
                for start, _, source, last in own:
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + min_words)
                    else:
                        spans.append([start, last + min_words, source])
                out += [(ident, text, later, a, b - a, source) for a, b, source in spans]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPANS, strict=True)], schema=SPANS)


def _found(docs: DataFrame, min_words: int, gram: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(SPANS of distinct texts, one row for each row of docs, one for each distinct text that is long enough)."""
    if not 1 <= gram <= min_words:
        raise ValueError("gram: at most min_words")
    reach = min_words - gram
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
    texts = materialise(map_arrow(rows, partial(_sparse, min_words=min_words, gram=gram), "id long, text_hash long, n long, grams array<long>, places array<int>"), "suffixes")
    suffixes = texts.select("text_hash", F.explode(F.arrays_zip("grams", "places")).alias("s")).select("s.grams", "text_hash", "s.places")
    parts = lambda n, each: max(1, min(MOST_PARTS, -(-n // each)))
    n = texts.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    ordered = suffixes.repartitionByRange(parts(n, SORTED_EACH), "grams", "text_hash", "places").sortWithinPartitions("grams", "text_hash", "places")
    kept = materialise(map_arrow(ordered, _compare, _ddl(KEPT)), "kept-suffixes")
    hot = materialise(kept.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram"), "hot-grams")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("first")
    same = materialise(texts.filter(F.col("n") >= min_words).groupBy("text_hash").agg(first, F.count("*").alias("copies"), F.max("n").alias("n")), "text-classes")
    seeds = kept.groupBy("text_hash").agg(F.collect_set("place").alias("places")).join(same, "text_hash").select(F.col("first").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    seeds = materialise(seeds, "seeds")
    held = rows.join(seeds, rows.id.eqNullSafe(seeds["_id"]) & (rows.text_hash == seeds["_hash"])).select("id", "text_hash", "places", "text")
    around = map_arrow(held, partial(_around, reach=reach, gram=gram), _ddl(AROUND))
    if hot.isEmpty():
        cold, runs = around, None
    else:
        around, listed = materialise(around, "around"), small(hot)
        cold, runs = around.join(listed, "gram", "left_anti").select(around.columns), _hot_spans(around.join(listed, "gram").select(around.columns), reach)
    matched = map_arrow(cold.repartition(parts(kept.count(), AROUND_EACH), "gram").sortWithinPartitions("gram", "follows"), partial(_match, reach=reach), _ddl(FOUND))
    runs = matched if runs is None else matched.unionByName(runs)
    of = runs.distinct().groupBy("id", "text_hash").agg(F.collect_list(F.struct("later", "start", "last", "source")).alias("runs"))
    return map_arrow(of.select("id", "text_hash", "runs"), partial(_merge, min_words=min_words), _ddl(SPANS)), texts.select("id", "text_hash"), same


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, source_doc_id: the spans of each document that occur more than once.

    source_doc_id is the smallest id of a document that holds the span's first window (it can be the same one).
    """
    spans, rows, same = _found(docs, min_words, gram, id_col, text_col)
    spans = materialise(spans.filter("NOT later").drop("later"), "spans")
    alike = same.filter("copies > 1")
    # A text with copies is one span; its source is that of its first window, which may stand in yet another text.
    opening = spans.filter("start = 0").select("text_hash", F.col("source").alias("_source"))
    none_last = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.least(a, b))
    alike = materialise(alike.join(opening, "text_hash", "left").select("text_hash", F.col("n").alias("n_words"), none_last("first", "_source").alias("source")), "copies")
    own = spans.join(small(alike.select("text_hash")), "text_hash", "left_anti").select("id", "start", "n_words", "source")
    whole = rows.join(small(alike), "text_hash").select("id", F.lit(0).cast("long").alias("start"), "n_words", "source")
    return own.unionByName(whole).select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", F.col("source").alias("source_doc_id"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, n_removed of the rows (text, spans): without the words of the spans and the white space behind them."""
    for batch in batches:
        out, gone = [], []
        for text, spans in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            w = kernels.find_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            edge, kept, n = 0, [], 0
            for s in sorted(spans.as_py(), key=lambda x: x["start"]):
                a, b = s["start"], s["start"] + s["n_words"]
                kept.append(data[edge : w.start[a]])
                edge = int(w.start[b]) if b < len(w.start) else int(w.end[-1])
                n += b - a
            out.append(b"".join([*kept, data[edge:]]).decode("utf-8", "surrogatepass"))
            gone.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.string()), pa.array(gone, pa.int64())], names=["_id", "_hash", "_text", "_n"])


def remove(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without later occurrences, and with n_removed (words): of each repeated window the first one, by id and place,
    stays. Of equal long texts the one with the smallest id stays, the others become empty."""
    spans, _, same = _found(docs, min_words, gram, id_col, text_col)
    spans = materialise(spans.filter("later").groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "n_words")).alias("spans")), "later-spans")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    same = same.select(F.col("text_hash").alias("_class"), "first", F.col("n").alias("_words"), "copies")
    own = spans.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), "spans")
    cut = rows.join(own, rows.id.eqNullSafe(own["_i"]) & (rows.text_hash == own["_h"])).dropDuplicates(["id", "text_hash"])
    cut = materialise(map_arrow(cut.select("text", "spans", "id", "text_hash"), _cut, "_id long, _hash long, _text string, _n long"), "cut-texts")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    ident, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    d = docs.toDF(*names).withColumn("_i", F.col(ident).cast("long")).withColumn("_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    d = d.join(small(materialise(same.filter("copies > 1"), "copied")), F.col("_h") == F.col("_class"), "left")
    d = d.join(cut, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    copy = F.col("_class").isNotNull() & ~F.col("_i").eqNullSafe(F.col("first"))
    out = [F.when(copy, F.lit("")).when(F.col("_n").isNotNull(), F.col("_text")).otherwise(F.col(n)).alias(n) if n == text else F.col(n) for n in names]
    return d.select(*out, F.when(copy, F.col("_words")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed")).toDF(*docs.columns, "n_removed")
