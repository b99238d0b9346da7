"""Python code on executors: sent along with the work, on Arrow batches of few rows."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch of texts at most: texts can be long.
ARROW_ROWS, ROWS_SETTING = 256, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: they need not have it installed."""
    if getattr(ship, "sent", None) != (app := spark.sparkContext.applicationId):
        package = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="quire-code-")) / f"{package.name}-code.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(at))
        ship.sent = app


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with the code sent along and batches of at most ARROW_ROWS rows.

    The batch size is a setting of the session that is read when the plan runs; a smaller one is left alone.
    """
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(ROWS_SETTING)) > ARROW_ROWS:
        spark.conf.set(ROWS_SETTING, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)
