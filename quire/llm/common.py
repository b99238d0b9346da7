"""What the operators of this subpackage share: reading, cutting lineage, size-checked broadcasts.

Nothing here collects rows of a table to the driver; only counts and rows whose number a parameter
bounds go there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.executors import map_arrow  # noqa: F401

#: White space of the word definition: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Rows (of a few fixed-width columns) up to which a side may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: For each scope the folders of its intermediate tables, and the scope that tables now go to.
_written: dict[str | None, list[str]] = {None: []}
_scope: list[str | None] = [None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's spark.checkpoint.dir.

    Where the setting is absent (tests, a laptop) a folder of this machine is set once; a cluster must have it.
    """
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}-{name}"
    df.write.parquet(at)
    _written[_scope[-1]].append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing will read again."""
    remove(df.sparkSession, df.stored_at)
    for written in _written.values():
        if df.stored_at in written:
            written.remove(df.stored_at)


def release(spark: SparkSession, scope: str | None = None) -> None:
    """Delete the tables of one scope; for callers that have stored their results."""
    while written := _written.get(scope):
        remove(spark, written.pop())


@contextmanager
def tables(spark: SparkSession, scope: str) -> Iterator[None]:
    """Inside, materialise() writes tables of this scope; those from before, whose readers must be done, are deleted."""
    release(spark, scope)
    _written.setdefault(scope, [])
    _scope.append(scope)
    try:
        yield
    finally:
        _scope.pop()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most so many rows, else df for a shuffled join.

    df must be cheap to count: a materialised table of fixed-width columns.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text) -> F.Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def pinned(value) -> F.Column:
    """value, in a column that Catalyst neither copies into the expressions above nor filters through.

    For intermediate arrays that lambdas read again and again: inlined there, they would be computed anew for each
    element. An expression that isn't deterministic stays where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
