"""Vector search, roll-ups from chunks to chapters, rank fusion and diversity."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.executors import ship
from .overlap import similar_pairs  # noqa: F401

log = logging.getLogger(__name__)
#: Results that a reranking model may be shown.
RERANKED = 200


def top_chunks(rows: DataFrame, vector: list[float], k: int, least: float = 0.0, where: Column | None = None) -> DataFrame:
    """rows with similarity: the k most similar of at least `least`, ties by id. Filters before scoring."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = rows if where is None else rows.filter(where)
    scored = rows.filter(F.col("embedding").isNotNull()).withColumn("similarity", V.cosine_to("embedding", vector)).drop("embedding")
    return scored.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def all_chunks(rows: DataFrame, vector: list[float], least: float) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull()).withColumn("similarity", V.cosine_to("embedding", vector)).drop("embedding").filter(F.col("similarity") >= least)


def best_per(rows: DataFrame, *key: str, limit: int = 1) -> DataFrame:
    """The first `limit` rows of each key by similarity, ties by id."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("similarity"), "id"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def search_chapters(rows: DataFrame, vector: list[float], limit: int, least: float, rerank: bool = False, where: Column | None = None) -> DataFrame:
    """Best chunk of each chapter among the top chunks; can return fewer than limit chapters."""
    found = best_per(top_chunks(rows, vector, limit * 3 if rerank else limit, least, where), "chapter_id")
    return found.orderBy(F.desc("similarity"), "id").limit(limit)


def per_book(rows: DataFrame, vector: list[float], k: int, least: float) -> DataFrame:
    """The k best chapters of every book: top 3k chunks, best chunk of a chapter, first k."""
    chunks = best_per(all_chunks(rows, vector, least), "book_id", limit=3 * k)
    return best_per(best_per(chunks, "book_id", "chapter_id"), "book_id", limit=k)


def topic_coverage(rows: DataFrame, vector: list[float], least: float) -> DataFrame:
    """For each book: chapters at all similar, and the mean of their rounded similarities."""
    best = best_per(all_chunks(rows, vector, least), "book_id", "chapter_id")
    return best.groupBy("book_id", "book_title").agg(F.count("*").alias("chapters"), F.round(F.avg(F.round("similarity", 3)), 3).alias("avg_similarity"), F.round(F.max("similarity"), 3).alias("best"))


def title_boost(rows: DataFrame, query: str, boost: float = 0.15, title: str = "book_title") -> DataFrame:
    """Similarity raised, up to 1, where a word of the query stands in the title."""
    words = [w for w in dict.fromkeys(query.lower().split())]
    hit = F.arrays_overlap(F.split(F.lower(title), r"\s+"), F.array(*map(F.lit, words)))
    return rows.withColumn("similarity", F.when(hit, F.least(F.lit(1.0), F.col("similarity") + boost)).otherwise(F.col("similarity")))


def multi_term(rows: DataFrame, terms: list[tuple[str, list[float]]], k: int, least: float) -> DataFrame:
    """Each term's best chapters; a chapter found by several terms belongs to the first."""
    queries = [(i, v) for i, (_, v) in enumerate(terms)]
    near = V.nearest(rows, queries, "id", "embedding", k, own=True).filter(F.col("similarity") >= least)  # k rows a term and partition
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    kept = near.withColumn("_r", top).filter(F.col("_r") <= k).join(rows.drop("embedding"), "id")
    best = best_per(kept, "query_id", "chapter_id")
    first = F.row_number().over(Window.partitionBy("chapter_id").orderBy("query_id"))
    return best.withColumn("_f", first).filter("_f = 1").drop("_f", "_r")


def ranked(rows: DataFrame, score: str, key: str = "chapter_id") -> DataFrame:
    """key, pos: 1-based places by score. For the short lists that searches return."""
    return rows.select(key, F.row_number().over(Window.orderBy(F.desc(score), key)).alias("pos"))


def rrf(keyword: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """chapter_id, rrf_score, fts_pos, semantic_pos, sources: reciprocal ranks of two lists (chapter_id, pos) added."""
    both = keyword.withColumnRenamed("pos", "fts_pos").join(semantic.withColumnRenamed("pos", "semantic_pos"), "chapter_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    sources = F.concat_ws(",", F.when(F.col("fts_pos").isNotNull(), "fts"), F.when(F.col("semantic_pos").isNotNull(), "semantic"))
    return both.select("chapter_id", (part("fts_pos") + part("semantic_pos")).alias("rrf_score"), "fts_pos", "semantic_pos", sources.alias("sources"))


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, weight: float, limit: int) -> list[int]:
    """Greedy maximal marginal relevance; of equal candidates the first wins."""
    size = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / np.where(size == 0, 1, size)[:, None]
    chosen: list[int] = []
    nearest = np.full(len(unit), -np.inf)
    while len(chosen) < min(limit, len(unit)):
        value = weight * relevance - (1 - weight) * (nearest if chosen else 0)
        value[chosen] = -np.inf
        pick = int(np.argmax(value))
        chosen.append(pick)
        nearest = np.maximum(nearest, unit @ unit[pick])
    return chosen


def mmr(candidates: DataFrame, weight: float = 0.7, limit: int = 10) -> DataFrame:
    """query_id, id, place: each query's candidates (query_id, id, similarity, embedding) in diverse order.

    Candidates are the few tens that a search returns; those without vector are dropped.
    """

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["similarity", "id"], ascending=[False, True]).reset_index(drop=True)
        picks = mmr_order(group.similarity.to_numpy(), np.stack(group.embedding.to_numpy()).astype(float), weight, limit)
        return pd.DataFrame({"query_id": group.query_id.iloc[picks].to_numpy(), "id": group.id.iloc[picks].to_numpy(), "place": np.arange(1, len(picks) + 1)})

    ship(candidates.sparkSession)
    few = candidates.filter(F.col("embedding").isNotNull()).select("query_id", "id", "similarity", "embedding")
    return few.groupBy("query_id").applyInPandas(order, "query_id long, id long, place long")


def rerank(results: DataFrame, model: Callable[[list[dict]], list[float]] | None, limit: int, text_col: str = "content") -> DataFrame:
    """The few results that a search returns, ordered by a model's scores, cut to limit. A model that fails, or returns
    another number of scores, leaves the given order; results come to the driver, where the model is called once."""
    given = results.orderBy(F.desc("similarity"), "id")
    if model is None:
        return given.limit(limit)
    rows = given.limit(RERANKED).collect()
    try:
        scores = [float(x) for x in model([r.asDict() for r in rows])]
    except Exception as e:
        log.warning("the reranking model failed: %s", e)
        return given.limit(limit)
    if len(scores) != len(rows):
        log.warning("the reranking model returned %d scores for %d results", len(scores), len(rows))
        return given.limit(limit)
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:limit]
    return results.sparkSession.createDataFrame([rows[i] for i in order], results.schema)
