"""Structured Streaming forms: one copy of each message, and the fast layer of the late-event views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import late_views, redelivery

#: Column that tells the micro-batches of stored first deliveries apart.
BATCH = "_ll_batch"


def start_once(stream: DataFrame, key: str, order: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the first delivery of each identifier to `path`, under the number of its micro-batch, however late a copy comes.

    Each micro-batch keeps its own first copies, by `order`, and of these what no earlier batch has stored; rows without identifier are
    all kept. A batch that is run again after a failure overwrites its own rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        kept = redelivery.rank_copies(batch, key, order)[0]
        spark, schema = batch.sparkSession, T.StructType([*batch.schema.fields, T.StructField(BATCH, T.LongType())])
        if number:
            stored = spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col(BATCH) < number).select(F.col(key).alias("_ll_stored"))
            kept = kept.join(stored, (F.col(key) == F.col("_ll_stored")) & (F.col(key).cast("string") != ""), "left_anti")
        kept.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_fast_layer(stream: DataFrame, keys: Sequence[str], amount: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the increments of each micro-batch of events (event_us, known_us) to `path`, under the number of the batch.

    A batch that is run again after a failure overwrites its own increments, so every record counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        late_views.fast_increment(None, late_views.route(batch), keys, amount).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fast_view(increments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The provisional view of all increments written so far."""
    return increments.groupBy(*keys, "period_us").agg(F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,0)").alias("amount"))
