"""Size of the Arrow batches that texts travel in."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df itself; its session sends at most ROWS rows at a time to Python from now on. Texts are long, and Spark's default of
    10,000 rows makes a worker hold some hundred megabytes. A smaller setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= ROWS:
        conf.set(_SETTING, ROWS)
    return df
