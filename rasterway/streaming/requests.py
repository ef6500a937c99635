"""Route requests as a stream: what arrives is searched unless it is done, and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterway.operators.route_tables import remaining
from rasterway.sources.store import NOTHING_STORED, append


def requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Route tables as Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def serve(stream: DataFrame, search: Callable[[DataFrame], DataFrame], output: str, keys: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch without what ``output`` has is searched, and its routes are appended.

    A batch that is run again after a failure finds its routes done.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        todo = df.dropDuplicates(keys)
        try:
            todo = remaining(todo, df.sparkSession.read.parquet(output), keys)
        except AnalysisException as e:
            if e.getCondition() not in NOTHING_STORED:
                raise
        append(search(todo), output)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
