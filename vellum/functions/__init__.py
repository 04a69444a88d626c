"""Column functions."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def vectorised(returns: str):
    """A pandas UDF that is made when it is called, so that Python workers can import its module without a session."""

    def make(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        del call.__wrapped__
        return call

    return make


def small_batches(spark, rows: int = 1000, size: int = 32 << 20) -> None:
    """Arrow batches of a bounded number of rows and bytes, as a worker holds one whole; settings of the session that are lower stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, most)
