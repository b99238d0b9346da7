"""A corpus pipeline in five stages: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, lines, packing, rules
from quire.llm.common import remove, shared_dir, table, tables
from quire.llm.queries import tokenizer_path

#: The stages' intermediate tables; a stage deletes those of the one before, whose result is stored by then.
SCOPE = "pipeline"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of the strict policy go."""
    with tables(spark, SCOPE):
        return rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut from the texts; documents of which no word is left go."""
    names = [*(f"_c{i}" for i in range(len(docs.columns))), "_lines", "_removed"]
    text, size = (names[docs.columns.index(c)] for c in ("text", "n_chars"))
    with tables(spark, SCOPE):
        cleaned = lines.dedup(docs).toDF(*names)
    kept = cleaned.filter((F.col("_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn(size, F.when(F.col("_removed") == 0, F.col(size)).otherwise(F.length(text).cast("long")))
    return kept.select(*names[:-2]).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a Jaccard similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    with tables(spark, SCOPE):
        return jaccard.keep_first(docs, width=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    with tables(spark, SCOPE):
        return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids; packing.sequences() puts them together."""
    with tables(spark, SCOPE):
        return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can't express tokenising and the edit distance; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that STAGES make of all documents. The result of a stage is deleted when the next one's is stored."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/quire-pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    with tables(spark, SCOPE):
        return docs
