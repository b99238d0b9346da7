"""Full-text search: a boolean query language over postings, ranked by BM25.

Postings are either computed (`postings`, `stemmed_postings`) or read from a stored `Index`, whose files are
dealt by a hash of the term and sorted by term, so that a query reads the row groups of its terms only.
"""

from __future__ import annotations

import re
import time
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.executors import map_arrow, ship
from ..sources.store import Store

K1, B = 1.2, 0.75
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column, parts: int = -1) -> Column:
    """parts: how many the text is cut into at most, the last one left as it is."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT, parts), lambda t: t != "")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, term, tf, places of the rows (id, words): the words of each row put together by term."""
    for batch in batches:
        words = batch.column(1)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        place = np.arange(len(row)) - np.repeat(start, size)
        coded = words.flatten().dictionary_encode()
        key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.diff(key[order], prepend=-1))
        first, of = order[head], np.append(head, len(order)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row[first])), coded.dictionary.take(coded.indices.take(pa.array(first))), pa.array(np.diff(of).astype(np.int64)), pa.ListArray.from_arrays(of, pa.array(place[order].astype(np.int32)))],
            names=["id", "term", "tf", "places"],
        )


def postings(docs: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("title", "content"), words: Callable[[Column], Column] = tokens) -> DataFrame:
    """id, term, tf, places: one row for each document and term. Documents are rows, with ids of their own: a row's words are
    put together where it lies, without an exchange."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.concat_ws(" ", *text_cols)).alias("words"))
    return map_arrow(rows, _grouped, f"id {rows.schema['id'].dataType.simpleString()}, term string, tf long, places array<int>")


def lengths(index: DataFrame) -> DataFrame:
    """id, dl: the number of tokens of each document."""
    return index.groupBy("id").agg(F.sum("tf").alias("dl"))


def escape(query: str) -> str:
    """Every term quoted; AND, OR, NOT in capitals and a trailing * kept; a query with quotes passes as it is."""
    if '"' in query:
        return query
    out = []
    for t in query.split():
        if t in ("AND", "OR", "NOT"):
            out.append(t)
        elif t.strip("*") or t not in ("*",):
            term, star = (t[:-1], "*") if t.endswith("*") else (t, "")
            if term:
                out.append(f'"{term}"{star}')
    return " ".join(out)


def plain(text: str) -> list[str]:
    """The tokens of a query's word, as `tokens` makes them."""
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]


class Query:
    """A parsed query: terms (with prefix flag), phrases, and the operators between them.

    Grammar: or := and (OR and)*; and := unit ((AND|NOT)? unit)*; NOT takes away; a quoted string of several tokens
    is a phrase. Operators without operands raise ValueError.
    """

    def __init__(self, query: str, analyse: Callable[[str], list[str]] | None = None):
        self.analyse = analyse or plain
        self.parts = re.findall(r'"([^"]*)"(\*?)|(AND|OR|NOT)\b|(\S+)', escape(query))
        self.leaves: list[tuple[tuple[str, ...], bool]] = []
        self.at = 0
        if not self.parts:
            raise ValueError("the query is empty")
        self.tree = self._or()
        if self.at != len(self.parts):
            raise ValueError("syntax error in the query")

    def _operator(self) -> str:
        return self.parts[self.at][2] if self.at < len(self.parts) else ""

    def _or(self):
        left = self._and()
        while self._operator() == "OR":
            self.at += 1
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._unit()
        while self.at < len(self.parts) and self._operator() != "OR":
            kind = "not" if self._operator() == "NOT" else "and"
            self.at += self._operator() in ("AND", "NOT")
            left = (kind, left, self._unit())
        return left

    def _unit(self):
        if self.at >= len(self.parts) or self._operator():
            raise ValueError("an operator lacks a term")
        quoted, star, _, bare = self.parts[self.at]
        self.at += 1
        word = bare or quoted
        prefix = bool(star) or bare.endswith("*")
        found = tuple(self.analyse(word))
        self.leaves.append((found, prefix))
        return ("leaf", len(self.leaves) - 1)


def _back(i: int):
    return lambda p: p - i


def _rows(index: DataFrame | Index, terms: tuple[str, ...], prefix: bool = False) -> DataFrame:
    """The postings of these terms, or of all that begin with the only one."""
    return index.filter(_named(terms, prefix)) if isinstance(index, DataFrame) else index.rows(terms, prefix)


def _named(terms: tuple[str, ...], prefix: bool) -> Column:
    return F.col("term").startswith(terms[0]) if prefix else reduce(Column.__or__, (F.col("term") == t for t in dict.fromkeys(terms)))


def _leaf(index: DataFrame | Index, leaf: tuple[tuple[str, ...], bool]) -> DataFrame:
    """id, tf: documents with the term, a term of the prefix, or the phrase."""
    terms, prefix = leaf
    if not terms:
        return _rows(index, ("",)).select("id", "tf").filter(F.lit(False))
    if len(terms) == 1:
        found = _rows(index, terms, prefix)
        return found.groupBy("id").agg(F.sum("tf").alias("tf")) if prefix else found.select("id", "tf")
    places = _rows(index, terms).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m")).filter(F.size("m") == len(set(terms)))
    starts = reduce(F.array_intersect, (F.transform(F.element_at("m", F.lit(t)), _back(i)) for i, t in enumerate(terms)))
    return places.select("id", F.size(starts).cast("long").alias("tf")).filter("tf > 0")


def _matching(q: Query, hit: Callable[[int], DataFrame]) -> DataFrame:
    """id of the documents that the query matches: semi and anti joins of the leaves' documents."""

    def of(node) -> DataFrame:
        if node[0] == "leaf":
            return hit(node[1]).select("id")
        left, right = of(node[1]), of(node[2])
        if node[0] == "or":
            return left.unionByName(right).distinct()
        return left.join(right, "id", "left_semi" if node[0] == "and" else "left_anti")

    return of(q.tree)


def match(index: DataFrame | Index, query: str, analyse: Callable[[str], list[str]] | None = None) -> DataFrame:
    """id of the documents that the query matches."""
    q = Query(query, analyse)
    return _matching(q, lambda i: _leaf(index, q.leaves[i]))


def _condition(node) -> Column:
    """Whether a document with these leaves (a column `hit` for each, true or null) matches."""
    if node[0] == "leaf":
        return F.coalesce(F.col(f"hit{node[1]}"), F.lit(False))
    left, right = _condition(node[1]), _condition(node[2])
    return left | right if node[0] == "or" else left & right if node[0] == "and" else left & ~right


def bm25(index: DataFrame | Index, query: str, limit: int | None = None, where: DataFrame | None = None, analyse: Callable[[str], list[str]] | None = None, size: DataFrame | None = None, stats: tuple[int, float] | None = None) -> DataFrame:
    """id, score of the matching documents, best first. where: ids to keep (a book's chapters).

    size (id, dl) and stats (documents, mean length) come from a stored index; else they are computed. The documents
    of all leaves meet in one aggregation, which both scores them and tells which leaves they hold.
    """
    q = Query(query, analyse)
    size = lengths(index) if size is None else size
    if stats is None:
        stats = size.agg(F.count("*"), F.avg("dl")).first()
    n, mean = F.lit(stats[0]), F.lit(float(stats[1] or 1.0))
    hits = reduce(DataFrame.unionByName, (_leaf(index, leaf).withColumn("leaf", F.lit(i)) for i, leaf in enumerate(q.leaves)))
    df = hits.groupBy("leaf").agg(F.count("*").alias("df"))  # a row a leaf
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    held = [F.bool_or(F.when(F.col("leaf") == i, True)).alias(f"hit{i}") for i in range(len(q.leaves))]
    scored = hits.join(F.broadcast(df), "leaf").join(size, "id").groupBy("id").agg(F.sum(part).alias("score"), *held).filter(_condition(q.tree)).select("id", "score")
    if where is not None:
        scored = scored.join(where, "id", "left_semi")
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


#: Documents and queries of a block in `bm25_each`, and different words of all its queries that are broadcast.
DOC_ROWS, ASKED_ROWS, BROADCAST_TERMS = 8192, 65_536, 500_000


def counts(docs: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("title", "content"), words: Callable[[Column], Column] = tokens) -> DataFrame:
    """id, term, tf: `postings` without places, and the number of tokens of each document that has any, as the term ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            yield batch.select([0, 1, 2])
            size = batch.select([0, 2]).to_pandas().groupby("id").tf.sum()
            yield pa.RecordBatch.from_arrays([pa.array(size.index, batch.schema.field(0).type), pa.array([""] * len(size), batch.schema.field(1).type), pa.array(size.to_numpy())], names=["id", "term", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), words(F.concat_ws(" ", *text_cols)).alias("words"))
    return map_arrow(rows, run, "id long, term string, tf long")


def _best_of_block(table: pa.Table, k: int) -> pa.Table:
    """asked, id, score: the k best documents of the block for each list of words asked in it."""
    coded = table["term"].combine_chunks().dictionary_encode()
    term, query, ids, n, total = coded.indices.to_numpy(), *(table[c].to_numpy() for c in ("query", "id", "n", "total"))
    made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    none = coded.dictionary.index("").as_py()
    if query.any() and not query.all():
        df = np.zeros(len(coded.dictionary))
        df[term[query]] = n[query]
        documents = df[none]
        mean = total[query & (term == none)][0] / documents
        length = ~query & (term == none)
        order = np.argsort(ids[length])
        docs, dl = ids[length][order], n[length][order]
        held = ~query & (term != none)
        of, at, tf = term[held], np.searchsorted(docs, ids[held]), n[held]
        order = np.lexsort((at, of))
        of, at, tf = of[order], at[order], tf[order]
        idf = np.maximum(1e-6, np.log((documents - df + 0.5) / (df + 0.5)))
        part = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / mean))
        ends = np.searchsorted(of, np.arange(len(df) + 1))
        size = np.diff(ends)
        asked = query & (term != none)
        order = np.lexsort((size[term[asked]], ids[asked]))
        names, words = ids[asked][order], term[asked][order]
        for first, last in zip(heads := np.flatnonzero(np.diff(names, prepend=names[:1] - 1)), np.append(heads, len(names))[1:], strict=True):
            # The rarest word's documents, and of those the ones that hold the next.
            found, score = at[ends[words[first]] : ends[words[first] + 1]], part[ends[words[first]] : ends[words[first] + 1]]
            for w in words[first + 1 : last]:
                if not len(found):
                    break
                place = ends[w] + np.searchsorted(at[ends[w] : ends[w + 1]], found)
                hit = at[np.minimum(place, ends[w + 1] - 1)] == found
                found, score = found[hit], score[hit] + part[place[hit]]
            score = np.round(score, 9)
            if len(found) > k:
                near = score >= np.partition(score, -k)[-k]
                found, score = found[near], score[near]
            best = np.lexsort((found, -score))[:k]
            for out, x in zip(made, (np.full(len(best), names[first]), docs[found[best]], score[best]), strict=True):
                out.append(x)
    return pa.table([pa.array(np.concatenate(x)) for x in made], names=["asked", "id", "score"])


def bm25_each(index: Index | DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score: the k best documents that hold all words of each query (query_id, text), in one job. Queries
    are plain words: operators and quotes are words or nothing. Scores are rounded to nine places; ties by id.

    index: a stored one, or documents (id, title, content), of which the asked words are counted without storing any. Queries of
    the same words are one. Only the postings of asked words move, once for each block of queries, to the block of their document;
    a task meets a block of documents with one of queries and hands on the k best of each query, so that no list of hits does.
    """
    spark = queries.sparkSession
    ship(spark)
    stored = isinstance(index, Index)
    analyse, documents = (index.analyse, index.stats[0]) if stored else (plain, index.count())

    @F.pandas_udf("array<string>")
    def words(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(set(analyse(t or ""))))

    wide, many = max(1, -(-documents // DOC_ROWS)), max(1, -(-queries.count() // ASKED_ROWS))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), words("text").alias("w")).filter(F.size("w") > 0)
    lists = wanted.groupBy("w").agg(F.min("query_id").alias("asked"))
    terms = lists.select(F.explode("w").alias("term")).union(spark.range(1).select(F.lit(""))).distinct()
    counted = index.postings.select("id", "term", "tf").unionByName(index.lengths.select("id", F.lit("").alias("term"), F.col("dl").alias("tf"))) if stored else counts(index)
    held = counted.join(F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms, "term", "left_semi")
    found = held.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("total"))
    each = lists.select(F.col("asked").alias("id"), F.explode("w").alias("term")).withColumn("i", number(many))
    each = each.unionByName(spark.range(many).select(F.lit(0).cast("long").alias("id"), F.lit("").alias("term"), F.col("id").cast("int").alias("i")))  # of all documents
    each = each.join(found, "term", "left").select(F.lit(True).alias("query"), "id", "term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"), "i", every(wide).alias("j"))
    dealt = held.select(F.lit(False).alias("query"), "id", "term", F.col("tf").alias("n"), F.lit(0).cast("long").alias("total"), every(many).alias("i"), number(wide).alias("j")).unionByName(each)
    best = dealt.groupBy("i", "j").applyInArrow(lambda block: _best_of_block(block, k), "asked long, id long, score double")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    best = best.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
    return wanted.join(lists, "w").select("query_id", "asked").join(best, "asked").select("query_id", "id", "score")


# -- a stored index ------------------------------------------------------------------------------------------------

LOG_NAME = "index"
#: Postings of a bucket of terms, postings that a document is expected to have, the least and most buckets, the documents
#: for each of which a bucket is split once more, and the most parts in all.
BUCKET_POSTINGS, DOC_POSTINGS, LEAST_BUCKETS, MOST_BUCKETS, SPLIT_DOCS, MOST_PARTS = 5_000_000, 200, 16, 4096, 5_000_000, 100_000


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _store(made: DataFrame, documents: int, at: str) -> dict:
    """Write postings and lengths, and tell their numbers. The counted documents tell how many buckets of terms there are,
    and into how many parts each is dealt by document, so that no term, however frequent, is one task's. Lengths lie in the
    order of ids, so that those of a few documents are found without reading all."""
    spark = made.sparkSession
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, documents * DOC_POSTINGS // BUCKET_POSTINGS))
    splits = max(1, min(MOST_PARTS // buckets, documents // SPLIT_DOCS))
    dealt = made.withColumn("bucket", bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(splits)))
    dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{at}/postings")
    lengths(spark.read.schema(POSTINGS).parquet(f"{at}/postings")).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{at}/lengths")
    n, tokens = spark.read.schema("id long, dl long").parquet(f"{at}/lengths").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"at": at, "buckets": buckets, "documents": n, "tokens": tokens, "replaced": 0}


POSTINGS = "id long, term string, tf long, places array<int>, bucket int"
#: A segment is merged with the one before it unless that is so many times larger; ids that are looked up one by one, and
#: ids of replaced documents that are broadcast.
TIERS, FEW_IDS, BROADCAST_IDS = 4, 1000, 200_000


class Index:
    """A stored index in segments, each with postings by bucket and term, lengths, and the ids that it replaces in those before.

    The first segment holds the documents that the index was built of. A sync adds a segment of the changed documents alone;
    what earlier segments hold of them no longer counts. So a sync reads and writes as much as the changed documents have, and
    of the rest only their lengths. A new segment is merged with the one before it while that is less than TIERS times its
    size: there are about log(documents) segments, and each posting is rewritten about as often. Segments are listed in a log
    (see sources.store) whose entries are published in one step: searches see the index before a sync or after it.
    """

    def __init__(self, spark: SparkSession, at: str, stemmed: bool = False):
        self.spark, self.root, self.stemmed, self.analyse = spark, at.rstrip("/"), stemmed, fold if stemmed else plain
        self.log = Store(spark, self.root)
        self.entry = self.log.entry(LOG_NAME)
        if not self.entry.get("segments"):
            raise FileNotFoundError(f"no index at {at}")

    @classmethod
    def build(cls, docs: DataFrame, at: str, stemmed: bool = False, id_col: str = "id", text_cols: tuple[str, ...] = ("title", "content")) -> Index:
        """Write the index of docs to the folder at. A frequent term is spread over several files by its documents."""
        made = (stemmed_postings if stemmed else postings)(docs, id_col, text_cols)
        log, part = Store(docs.sparkSession, at), cls._part()
        segment = _store(made, docs.count(), f"{at.rstrip('/')}/{LOG_NAME}/{part}")
        log._commit(LOG_NAME, lambda e: {**e, "appended": [part], "segments": [segment]})
        return cls(docs.sparkSession, at, stemmed)

    @staticmethod
    def _part() -> str:
        return f"d{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"

    @property
    def segments(self) -> list[dict]:
        return self.entry["segments"]

    @property
    def stats(self) -> tuple[int, float]:
        """Documents, and their mean length."""
        n = sum(s["documents"] for s in self.segments) - sum(s.get("gone", 0) for s in self.segments)
        tokens = sum(s["tokens"] for s in self.segments) - sum(s.get("gone_tokens", 0) for s in self.segments)
        return n, tokens / n if n else 1.0

    def _live(self, k: int, rows: DataFrame, segments: list[dict] | None = None) -> DataFrame:
        """The rows of segment k whose documents no later segment replaces."""
        later = [s for s in (segments or self.segments)[k + 1 :] if s["replaced"]]
        if not later:
            return rows
        dead = self.spark.read.schema("id long").parquet(*(f"{s['at']}/replaced" for s in later))
        return rows.join(F.broadcast(dead) if sum(s["replaced"] for s in later) <= BROADCAST_IDS else dead, "id", "left_anti")

    def _union(self, read: Callable[[dict], DataFrame], segments: list[dict] | None = None) -> DataFrame:
        own = segments or self.segments
        return reduce(DataFrame.unionByName, (self._live(k, read(s), own) for k, s in enumerate(own)))

    def _postings(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{segment['at']}/postings")

    def rows(self, terms: tuple[str, ...], prefix: bool = False) -> DataFrame:
        """The postings of terms, or of those that begin with the only one; of exact terms only the files of their buckets."""

        def read(s: dict) -> DataFrame:
            own = self._postings(s)
            if prefix:
                return own.filter(_named(terms, True))
            return own.filter(reduce(Column.__or__, ((F.col("term") == t) & (F.col("bucket") == bucket(F.lit(t), s["buckets"])) for t in dict.fromkeys(terms))))

        return self._union(read).drop("bucket")

    @property
    def postings(self) -> DataFrame:
        return self._union(self._postings).drop("bucket")

    @property
    def lengths(self) -> DataFrame:
        return self._union(lambda s: self.spark.read.schema("id long, dl long").parquet(f"{s['at']}/lengths"))

    def search(self, query: str, limit: int | None = None, where: DataFrame | None = None) -> DataFrame:
        return bm25(self, query, limit, where, self.analyse, self.lengths, self.stats)

    def match(self, query: str) -> DataFrame:
        return match(self, query, self.analyse)

    def fork(self, at: str) -> Index:
        """An index in another folder that begins with these segments; syncs of either leave the other alone."""
        Store(self.spark, at)._commit(LOG_NAME, lambda e: {**e, "appended": [], "segments": self.segments})
        return Index(self.spark, at, self.stemmed)

    def sync(self, docs: DataFrame | None, id_col: str = "id", text_cols: tuple[str, ...] = ("title", "content"), delete: DataFrame | None = None) -> Index:
        """The index after these documents are replaced or added, and those of delete (ids) taken out. Made anew if another
        sync is published meanwhile."""
        if docs is None:
            docs = self.spark.createDataFrame([], "id long, title string, content string")
            id_col, text_cols = "id", ("title", "content")
        part = self._part()
        at = f"{self.root}/{LOG_NAME}/{part}"
        ids = docs.select(F.col(id_col).cast("long").alias("id"))
        ids = ids if delete is None else ids.unionByName(delete.select(F.col(delete.columns[0]).cast("long").alias("id")))
        ids.distinct().write.parquet(f"{at}/replaced")
        changed = self.spark.read.schema("id long").parquet(f"{at}/replaced")
        segment = _store((stemmed_postings if self.stemmed else postings)(docs, id_col, text_cols), docs.count(), at) | {"replaced": changed.count()}
        while True:
            now = Index(self.spark, self.root, self.stemmed)
            few = [r[0] for r in changed.limit(FEW_IDS + 1).collect()]
            old = now.lengths.filter(F.col("id").isin(few)) if len(few) <= FEW_IDS else now.lengths.join(changed, "id", "left_semi")
            gone, tokens = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            entry = {**now.entry, "entry": now.entry["entry"] + 1, "appended": [*now.entry["appended"], part], "segments": [*now.segments, segment | {"gone": gone, "gone_tokens": tokens}]}
            if now.log._publish(LOG_NAME, entry):
                break
        return Index(self.spark, self.root, self.stemmed)._tidied()

    def _tidied(self) -> Index:
        """The index after its last segments are merged as far as TIERS asks; another writer's sync wins over a merge."""
        size = lambda s: s["documents"] + s["replaced"] + 1
        now = self
        while len(now.segments) > 1 and size(now.segments[-2]) < TIERS * size(now.segments[-1]):
            *before, one, two = now.segments
            part = now._part()
            at = f"{now.root}/{LOG_NAME}/{part}"
            made = now._union(now._postings, [one, two]).drop("bucket")
            merged = _store(made, one["documents"] + two["documents"], at)
            dead = [s for s in (one, two) if s["replaced"]]
            if before and dead:
                now.spark.read.schema("id long").parquet(*(f"{s['at']}/replaced" for s in dead)).distinct().write.parquet(f"{at}/replaced")
                merged["replaced"] = now.spark.read.schema("id long").parquet(f"{at}/replaced").count()
            # What the two replace in each other is no longer stored; what they replace in others still counts.
            for k in ("gone", "gone_tokens"):
                inner = one["documents" if k == "gone" else "tokens"] + two["documents" if k == "gone" else "tokens"] - merged["documents" if k == "gone" else "tokens"]
                merged[k] = one.get(k, 0) + two.get(k, 0) - inner
            lost = {s["at"].rsplit("/", 1)[-1] for s in (one, two)}
            entry = {**now.entry, "entry": now.entry["entry"] + 1, "appended": [p for p in now.entry["appended"] if p not in lost] + [part], "segments": [*before, merged]}
            if not now.log._publish(LOG_NAME, entry):
                now.log._drop(LOG_NAME, part)
                break
            now.log._forget(LOG_NAME)
            now = Index(now.spark, now.root, now.stemmed)
        return now


# -- Porter's published algorithm ----------------------------------------------------------------------------

_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """Porter (1980)."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if word.endswith(end):
                if _measure(word[: -len(end)]):
                    word = word[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(text: str) -> list[str]:
    """Tokens in lower case without diacritics, stemmed."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return [stem(t) for t in re.split(r"[^\w]+|_", plain) if t]


def stemmed_postings(docs: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("title", "content")) -> DataFrame:
    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def stems(text: pd.Series) -> pd.Series:
        known = lru_cache(100_000)(stem)
        split = re.compile(r"[^\w]+|_")
        return text.map(lambda t: [known(x) for x in split.split("".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))) if x])

    return postings(docs, id_col, text_cols, stems)


def snippet(text: str, terms: list[str], n: int = 32) -> str:
    """The window of n words with the most hits, hits between **, dots where text is left out."""
    words = text.split()
    hit = [any(w.lower().strip(".,;:!?\"'()").startswith(t) for t in terms) for w in words]
    best = max(range(max(1, len(words) - n + 1)), key=lambda i: sum(hit[i : i + n]))
    body = " ".join(f"**{w}**" if h else w for w, h in zip(words[best : best + n], hit[best : best + n], strict=True))
    return ("..." if best else "") + body + ("..." if best + n < len(words) else "")


def with_snippets(rows: DataFrame, terms: list[str], text_col: str = "content") -> DataFrame:
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t or "", terms))

    return rows.withColumn("snippet", cut(text_col))
