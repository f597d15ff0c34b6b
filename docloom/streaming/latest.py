"""The newest row of each key as a stream arrives, kept as keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.sources.published import publish_batch


def stream_latest(stream: DataFrame, keys: list[str | Column], order: list[str], checkpoint: str,
                  changes: str | None = None) -> StreamingQuery:
    """Keep the row with the greatest ``order`` columns of each key in the query's state, one row per key.

    The order decides, not the arrival: a late older row changes nothing. Each
    task reduces its own rows before the shuffle, so a hot key is no more than
    a row per task. ``changes`` names a table that gets the new row of every
    key that a micro-batch has met, published once per batch. Keys stay until
    the checkpoint is deleted. Columns are of orderable types, so no maps;
    rows equal in ``order`` are decided by their other columns.
    """
    rest = [c for c in stream.columns if c not in order]
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    newest = stream.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    writer = (newest.select("_row.*").select(*stream.columns).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if changes is None:
        return writer.format("noop").start()
    return writer.foreachBatch(lambda batch, batch_id: publish_batch(batch, changes, batch_id) and None).start()


def read_latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of ``stream_latest`` after its last batch: one row per key, nothing left to reduce."""
    state = spark.read.format("statestore").load(checkpoint)
    newest = state.schema["value"].dataType.fieldNames()[0]
    return state.select(F.col("value").getField(newest).alias("_row")).select("_row.*")
