"""Arrow-batched functions that are made when they are used, so modules can be imported where there is no session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, SparkSession, functions as F

#: Rows and bytes of an Arrow batch; a batch with longer texts ends sooner.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def small_batches(spark: SparkSession | None) -> None:
    """Rows go to Python BATCH_ROWS or about BATCH_BYTES at a time, so that a worker's memory doesn't grow with the input; a session's lower numbers stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)) if spark else ():
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, most)


def batch_udf(returns):
    def made(f):
        @wraps(f, updated=())
        def call(*columns) -> Column:
            small_batches(SparkSession.getActiveSession())
            return F.pandas_udf(f, returns)(*columns)

        call.__wrapped__ = None
        return call

    return made
