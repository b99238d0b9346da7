"""Reports as files and text tables, strategy files, and the tables that evaluations may read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of vectors that an evaluation may be run on.
EVALUATED = ("chunks", "chunks_staging")


def write_report(rows: DataFrame, folder: str, kind: str) -> None:
    """The report as CSV with a header or as JSON lines, in a folder."""
    if kind not in ("csv", "json"):
        raise ValueError("kind: csv or json")
    out = rows.write.mode("overwrite")
    out.option("header", True).csv(folder) if kind == "csv" else out.json(folder)


def text_table(rows: DataFrame, limit: int = 100) -> str:
    """The first rows as an aligned table, for a terminal."""
    cells = [rows.columns, *([("" if v is None else str(v)) for v in r] for r in rows.limit(limit).collect())]
    width = [max(len(c[i]) for c in cells) for i in range(len(rows.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(c, width, strict=True)).rstrip() for c in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def strategies(spark: SparkSession, folder: str) -> DataFrame:
    """name and the settings of each strategy file (*.json, one object each); the name is the file's where it has none."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.withColumn("name", F.coalesce("name", name) if "name" in rows.columns else name)


def evaluated_rows(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """id, chapter_id, embedding of one of the EVALUATED tables, without rows that have no vector."""
    if name not in EVALUATED:
        raise ValueError(f"{name}: one of {', '.join(EVALUATED)}")
    return tables[name].filter(F.col("embedding").isNotNull()).select("id", "chapter_id", "embedding")
