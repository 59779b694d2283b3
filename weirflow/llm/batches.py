"""Batches of texts small enough for the Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS, BYTES = 512, 16 << 20


def small(spark: SparkSession) -> None:
    """Let the session hand at most so many rows and bytes of text to Python at once; texts are long, and the default is 10,000 rows."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        try:
            now = int(str(spark.conf.get(key, str(most + 1))).rstrip("bB"))
        except ValueError:
            now = most + 1
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
