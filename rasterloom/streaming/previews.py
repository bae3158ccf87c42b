"""Live previews as a stream: of the requests for an image only the latest one's result counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def request_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests that arrive as Parquet files below a path."""
    return spark.readStream.schema(schema).parquet(path)


def latest(requests: DataFrame, key: str, generation: str) -> DataFrame:
    """The row of the highest generation of each key, for tables and for streams (in update or complete mode).

    Late requests of a lower generation change nothing. The state is one row a key.
    """
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("__last")).select(key, "__last.*")
