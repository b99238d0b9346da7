"""N-gram Jaccard join by parity sketches: near-duplicate documents and their components.

A document's set is its distinct shingles of `width` words (A-Z lower-cased); a document with fewer words has
one shingle, all of them; one without words has none and links with nothing. Two sets link if
100 * |A and B| >= threshold * |A or B|.

Sketch. In a band of set sizes every shingle is hashed to one of m blocks and to one of 2**16 bits there; the
sketch holds the parity of each bit. A shingle in only one of two sets flips one bit, so the Hamming distance
of two sketches is at most |A xor B|, and so is the number of blocks in which they differ. Sets that link
differ in at most D = floor((100 - t) (|A| + |B|) / (100 + t)) shingles: at least m - D blocks are equal.
Blocks are ordered by their number of set bits, fullest first, which is an order of the block contents
themselves; of two lists with m - D entries in common, the first D + 1 of each share one, the first D + 2
share two. So each document files itself under its first D + 2 blocks only, and nearly empty blocks, which
strangers may share, are hardly ever filed. A set joins its own band and, if a larger partner could stand
there, the next. No linked pair is lost.

Join. Equal sets are one class, whatever number of documents holds it; its first document files the blocks. A count
of the keys' low bits, which is all that moves of most keys, leaves out those of one class (the few that only these
bits have in common drop out when whole keys meet), and classes with fewer than two shared blocks link with none.
In each other block every class is compared with one pivot, the class whose blocks are the most shared: as many
pairs as members. Linked classes form components, and only blocks that still hold several components go on. There the pivot P is known to each member A by their difference A xor P, and

    A xor B = (A xor P) xor (B xor P)

so two members link only if their differences, of sizes x and y, share (x + y - D) / 2 elements, and at least one
unless both link with P. Each difference is put into one order, in which elements found in one component alone come
first and of the others the rarest: so what all members share with each other against P comes last. Of two lists
with that many elements in common the first few share one; as many as the sizes leave are the next round's blocks,
apart for each class of sizes. Near copies that only resemble each other by their common source have nothing in
common there and meet no more.

Rounds. In round r the pairs of the remaining blocks that positions leave are compared directly if they are at most 2**r
times the blocks' members; else each block is compared with a pivot again, and the pivots drop out. So the work of a
round is bounded by its members and doubles at most, and a block of n members takes about log2(n) rounds. Pairs are
verified on the texts, exactly.

Null texts are empty. Null ids rank behind all others. An empty table gives an empty result. Other columns are
ignored, and passed on by `keep_first`. Rows that repeat an id and text are one document, of which `keep_first` keeps
one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import kernels
from .common import discard, map_arrow, materialise, small
from .components import components

#: Pairs in the remaining blocks for each of their members, in the first round, up to which positions are compared.
LISTED = 8
#: Keys (of 8 bytes) of shared blocks up to which they are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Low bits of a key that are counted first. Of n keys, one in 2**40 / n is joined in vain.
COUNTED = (1 << 40) - 1
#: Blocks for each block in which linked sets may differ at most.
SPARE = 1.4
SETS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("twin", pa.int64()), ("keys", pa.list_(pa.int64()))])

COMPARED = pa.schema([("a", pa.int64()), ("pivot", pa.int64()), ("more", pa.bool_()), ("linked", pa.bool_()), ("n", pa.int64()), ("delta", pa.list_(pa.int64()))])


def differ(a: int, b: int, threshold: int) -> int:
    """In how many shingles linked sets of these sizes differ at most."""
    return (100 - threshold) * (a + b) // (100 + threshold)


def _edges() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


EDGES = _edges()


def filed(n: int, threshold: int) -> list[tuple[int, int, int]]:
    """(band, blocks of the band's sketches, entries to file) for a set of n shingles."""
    most = 100 * n // threshold
    if differ(n, most, threshold) == 0:
        return []  # every partner is an equal set
    band = int(np.searchsorted(EDGES, n, "right"))
    out = []
    for b, partner in ((band, min(most, EDGES[band] - 1)), (band + 1, most)):
        if b == band or most >= EDGES[band]:
            m = int(SPARE * (differ(EDGES[b] - 1, EDGES[b] - 1, threshold) + 2)) + 1
            out.append((b, m, min(m, differ(n, partner, threshold) + 2)))
    return out


def block_keys(shingles: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of the filed blocks of a set, given as distinct hashes."""
    out = []
    for band, m, count in filed(len(shingles), threshold):
        block = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place, times = np.unique(block << np.uint64(16) | (shingles & np.uint64(0xFFFF)), return_counts=True)
        place = place[times & 1 == 1]
        of = (place >> np.uint64(16)).astype(np.int64)
        content = np.zeros(m, np.uint64)
        np.bitwise_xor.at(content, of, kernels.mix(place + np.uint64(band << 56)))
        bits = np.bincount(of, minlength=m)
        first = np.lexsort((np.arange(m), -bits))[:count]
        out.append(kernels.mix(content[first] ^ kernels.mix(first.astype(np.uint64) + np.uint64(band << 48))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, threshold: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in kernels.slices(batch.column(2)):
            w = kernels.find_words(data, offsets, lower=True)
            h, of = kernels.shingles(w, kernels.hash_words(w, 2 * seed), width)
            other = kernels.shingles(w, kernels.hash_words(w, 2 * seed + 1), width)[0]
            n, cid, twin, keys = [], [], [], []
            for i in range(b - a):
                own, at = np.unique(h[of[i] : of[i + 1]], return_index=True)
                n.append(len(own))
                cid.append(int(kernels.mix(own).sum(dtype=np.uint64).view(np.int64)) if len(own) else None)
                twin.append(int(kernels.mix(other[of[i] + at]).sum(dtype=np.uint64).view(np.int64)))
                keys.append(kernels.signed(block_keys(own, threshold)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(twin, pa.int64()),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(np.concatenate(keys)))],
                schema=SETS,
            )


def _compared(batches: Iterator[pa.RecordBatch], width: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """a, pivot, more, linked, n (size of a's set), delta (hashes of the elements that only one of the two has; if `more`).

    The rows are (a, pivot, more, text of a, text of pivot). Sets are compared by the words themselves.
    """

    def whole(text: str) -> set[bytes]:
        w = text.encode().lower().split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    last, kept = None, set()
    for batch in batches:
        linked, n, delta = [], [], []
        for more, one, two in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            if (text := two.as_py()) != last:
                last, kept = text, whole(text)
            own = whole(one.as_py())
            both = len(own & kept)
            linked.append(both > 0 and 100 * both >= threshold * (len(own) + len(kept) - both))
            n.append(len(own))
            delta.append([xxh3_64_intdigest(e) - (1 << 63) for e in own ^ kept] if more.as_py() else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(linked, pa.bool_()), pa.array(n, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], schema=COMPARED)


class NearDuplicates:
    """The join over one table of documents; intermediate tables lie in the shared folder."""

    def __init__(self, docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        if not 0 < threshold <= 100:
            raise ValueError("threshold: a percentage")
        self.width, self.threshold = width, threshold
        self.spark: SparkSession = docs.sparkSession
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
        self.filed, self.sets, self.classes = self._sets()
        self._labels: DataFrame | None = None

    def _sets(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """One row for each document, with and without the filed keys, and one for each distinct set: its first document,
        and how many there are. A set is known by a 64-bit hash; if two sets share one, which a second hash shows (of
        the words themselves, so that 128 independent bits would have to agree), all are hashed anew."""
        for seed in range(8):
            sketch = partial(_sketch, width=self.width, threshold=self.threshold, seed=seed)
            sets = materialise(map_arrow(self.rows, sketch, "id long, text_hash long, n long, cid long, twin long, keys array<long>"), "sets")
            first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first")
            of = sets.filter("n > 0").groupBy("cid").agg(first, F.count("*").alias("docs"), F.min("twin").alias("t1"), F.max("twin").alias("t2"))
            classes = materialise(of.select("cid", F.col("first.id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "docs", "t1", "t2"), "classes")
            if classes.filter("t1 <> t2").isEmpty():
                return sets, materialise(sets.drop("twin", "keys"), "documents"), classes.drop("t1", "t2")
        raise RuntimeError("set hashes keep colliding")

    def _texts(self, classes: DataFrame) -> DataFrame:
        """cid, text of these classes: the text of the first document."""
        one = small(materialise(classes.select("cid", "rep", "rep_hash"), "reps"))
        found = self.rows.join(one, self.rows.id.eqNullSafe(one.rep) & (self.rows.text_hash == one.rep_hash))
        return materialise(found.groupBy("cid").agg(F.first("text").alias("text")), "rep-texts")

    def _compare(self, pairs: DataFrame) -> DataFrame:
        """COMPARED for the pairs (a, pivot, more) of classes, a stored table; and pair, a number of the row."""
        wanted = pairs.select(F.explode(F.array("a", "pivot")).alias("cid")).distinct()
        texts = self._texts(wanted.join(self.classes, "cid"))
        sides = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cid").alias("pivot"), F.col("text").alias("tp")), "pivot")
        check = partial(_compared, width=self.width, threshold=self.threshold)
        compared = map_arrow(sides.select("a", "pivot", "more", "ta", "tp"), check, "a long, pivot long, more boolean, linked boolean, n long, delta array<long>")
        compared = materialise(compared.withColumn("pair", F.monotonically_increasing_id()), "compared")
        discard(texts)
        return compared

    def components(self) -> DataFrame:
        """node, label: the component of every class that links with another."""
        if self._labels is None:
            self._labels = self._components()
        return self._labels

    def _blocks(self) -> DataFrame:
        """key, cid: the shared blocks, and the few that share the counted bits of a key only."""
        first = small(self.classes.filter("docs > 1").select("cid", "rep", "rep_hash"))
        once = self.filed.filter(F.size("keys") > 0).join(first, "cid", "left").filter("rep_hash IS NULL OR (id <=> rep AND text_hash = rep_hash)")
        filed = once.select("cid", F.explode("keys").alias("key")).withColumn("low", F.col("key").bitwiseAND(F.lit(COUNTED)))
        shared = materialise(filed.groupBy("low").agg(F.count("*").alias("n")).filter("n > 1").select("low"), "shared-blocks")
        return materialise(filed.join(small(shared, BROADCAST_KEYS), "low").select("key", "cid").distinct(), "blocks")

    def _components(self) -> DataFrame:
        blocks = self._blocks()
        discard(self.filed)
        links = labels = None
        for level in count(1):
            compared = self._compare(materialise(self._stars(blocks, 2 if level == 1 else 1), "pairs"))
            found = materialise(compared.filter("linked").select("a", F.col("pivot").alias("b")), "links")
            if links is None:
                links, labels = found, components(found)
            elif not self._across(found, labels).isEmpty():
                links = links.unionByName(found)
                labels = components(links)
            blocks = self._next(compared, labels)
            discard(compared)
            size = blocks.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
            rows, pairs = size.agg(F.sum("n"), F.sum(F.expr("own * n"))).first()
            if not rows:
                return labels
            if pairs <= LISTED * rows << level:
                listed = materialise(self._pairs(blocks), "listed-pairs")
                if listed.count() <= rows << level:
                    found = self._compare(listed).filter("linked").select("a", F.col("pivot").alias("b"))
                    return components(links.unionByName(found)) if not self._across(found, labels).isEmpty() else labels
            blocks = blocks.select("key", "cid").distinct()

    def _pairs(self, blocks: DataFrame) -> DataFrame:
        """a, pivot: members of a block that are in different components, one of them of the block's own class."""
        other = blocks.filter("own").select("key", F.col("cid").alias("b"), F.col("label").alias("other"), F.col("n").alias("n2"), F.col("size").alias("size2"), F.col("rank").alias("rank2"))
        d = lambda one, two: f"({100 - self.threshold} * ({one} + {two})) div {100 + self.threshold}"
        # Where two differences first meet, enough of both must follow for the overlap that a link needs.
        enough = F.expr(f"2 * (1 + least(size - rank, size2 - rank2)) >= size + size2 - {d('n', 'n2')}")
        found = blocks.join(other, "key").filter((F.col("label") != F.col("other")) & enough)
        found = found.select(F.greatest("cid", "b").alias("a"), F.least("cid", "b").alias("b"))
        return found.select("a", F.col("b").alias("pivot"), F.lit(False).alias("more")).distinct()

    @staticmethod
    def _across(links: DataFrame, labels: DataFrame) -> DataFrame:
        """The links between two components."""
        side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        return links.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))

    @staticmethod
    def _stars(blocks: DataFrame, least: int) -> DataFrame:
        """a, pivot, more: each member of a block with the one whose blocks have the most members; more if a third one is
        there. Linked sets share `least` blocks or more."""
        size = blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        weight = blocks.join(size, "key").groupBy("cid").agg(F.sum("n").alias("weight"), F.count("*").alias("k")).filter(F.col("k") >= least)
        weighed = materialise(blocks.join(weight.drop("k"), "cid"), "weighed")
        best = weighed.groupBy("key").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
        pivot = weighed.join(best, ["key", "weight"]).groupBy("key").agg(F.min("cid").alias("pivot"), F.max(F.col("n") > 2).alias("more"))
        found = weighed.select("key", "cid").join(pivot, "key").filter("cid <> pivot")
        return found.groupBy(F.col("cid").alias("a"), "pivot").agg(F.max("more").alias("more"))

    def _next(self, compared: DataFrame, labels: DataFrame) -> DataFrame:
        """key, cid, via (the pivot), own, label, n, size, rank: blocks of the next round, by the first elements of the differences.

        Elements and members move as one number each: the hash of pivot and element, the number of the pair. Only pivots whose members are in several components go on, and of their blocks those that hold several.
        """
        most = F.floor(F.lit(100 - self.threshold) * (F.col("n") + F.floor(F.lit(100) * F.col("n") / self.threshold)) / F.lit(100 + self.threshold))
        named = compared.filter("more").join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a")).withColumn("d", most)
        mixed = named.groupBy("pivot").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.max("d").alias("widest")).filter("l1 < l2").select("pivot", "widest")
        mixed = small(materialise(mixed, "mixed"))
        # Of a pair, one at least isn't linked with the pivot: members linked with it are all in one component.
        named = named.join(mixed, "pivot").select("pair", "pivot", "a", "label", "n", "d", "widest", F.size("delta").cast("long").alias("size"), "delta")
        members = small(materialise(named.drop("delta"), "members"))
        each = lambda: named.select("pair", "pivot", "label", F.explode("delta").alias("e")).select("pair", "label", F.xxhash64("pivot", "e").alias("element"))
        many = each().groupBy("element").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("times")).filter("l1 < l2").select("element", "times")
        many = small(materialise(many, "shared-elements"), BROADCAST_KEYS)
        # Elements of one component alone come first in the order, then the others, the rarest first.
        found = each().drop("label").join(many, "element").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("times", "element"))).alias("found"))
        kept = found.join(members, "pair").select("pair", "label", "d", "widest", "size", (F.col("size") - F.size("found")).alias("alone"), F.posexplode("found").alias("rank", "e"))
        kept = kept.withColumn("rank", F.col("alone") + F.col("rank") + 1).withColumn("element", F.col("e.element"))
        # The smaller of two differences, of sizes x <= y, is filed under its size class by (d + x - y) / 2 + 1 elements or
        # more, the larger by (d + y - x) / 2 + 1, under each class where a smaller one may be.
        kept = kept.withColumn("step", F.greatest(F.lit(1).cast("long"), F.expr("widest div 8"))).withColumn("low", F.expr("greatest(0, size - d) div step"))
        high = F.expr("least(size div step, (size + d - 2 * (rank - 1)) div step)")
        kept = kept.withColumn("class", F.explode(F.when(F.col("rank") <= F.col("d") + 1, F.sequence("low", F.greatest("low", high)))))
        kept = kept.select(F.xxhash64("class", "element").alias("key"), "pair", "label", F.expr("class = size div step").alias("own"), "rank")
        kept = materialise(kept, "filed-elements")
        several = kept.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.bool_or("own").alias("any_own")).filter("l1 < l2 AND any_own").select("key")
        several = small(materialise(several, "shared-keys"), BROADCAST_KEYS)
        shared = kept.select("key", "pair", "own", "rank").join(several, "key").join(members, "pair")
        blocks = materialise(shared.select("key", F.col("a").alias("cid"), F.col("pivot").alias("via"), "label", "own", "n", "size", "rank"), "blocks")
        discard(kept)
        return blocks

    def _placed(self) -> DataFrame:
        """id, text_hash, n, rep, component, first_id, first_hash (of the component's first document), copies: one row for
        each row of the documents; rep and the following are null where a document is alone."""
        labels = self.components()
        lone = self.classes.join(labels, self.classes.cid == labels.node, "left").withColumn("label", F.coalesce("label", "cid"))
        first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_hash")).alias("first")
        least = lone.groupBy("label").agg(first, F.count("*").alias("k"), F.max("docs").alias("d")).filter("k > 1 OR d > 1")
        of = lone.join(least, "label").select("cid", "rep", F.col("first.rep").alias("first_id"), F.col("first.rep_hash").alias("first_hash"), F.col("docs").alias("copies"))
        return self.sets.join(small(materialise(of, "component-of")), "cid", "left")

    def clusters(self) -> DataFrame:
        """doc_id, n_shingles, component_id, class_rep, text_hash: one row for each row of the documents. The latter ids
        are null for documents without id that are in no component with one."""
        return self._placed().select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("first_id", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_rep"), "text_hash")


def keep_first(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (of several texts with that id, or without any, the one with
    the least hash); documents without words all stay."""
    placed = NearDuplicates(docs, width, threshold, id_col, text_col)._placed()
    alike = placed.filter(F.col("first_hash").isNotNull()).select("id", "text_hash", (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("first"))
    alike = materialise(alike.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "first").agg(F.count("*").alias("n")).filter("NOT first OR n > 1"), "alike")
    of = lambda t: F.col(id_col).cast("long").eqNullSafe(t["_id"]) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == t["_hash"])
    listed = small(alike.select("_id", "_hash"))
    out = docs.join(listed, of(listed), "left_anti")
    again = alike.filter("first").select("_id", "_hash")
    if again.isEmpty():
        return out
    again = small(again)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.join(again, of(again), "left_semi").toDF(*names)
    own = [names[docs.columns.index(c)] for c in (id_col, text_col)]
    return out.unionByName(rows.dropDuplicates(own).toDF(*docs.columns))
