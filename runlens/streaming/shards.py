"""The ledger as a stream: shards arrive as files, and a key that comes again replaces its row. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from runlens.sources.sinks import append_attempts
from runlens.sources.tables import ATTEMPT


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ATTEMPT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(path)


def upsert(shards: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Batches of shards go to partitions of the ledger; a key that comes again replaces its row."""

    def write(batch: DataFrame, _: int) -> None:
        append_attempts(batch, path)

    return shards.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
