"""Linkage of arriving records against a fixed pool: a stateless query, one batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinlink.operators import blocking
from kinlink.plans import linkage
from kinlink.profiles import PACKAGE, Profile
from kinlink.sources.entities import ENTITY


def link_arrivals(spark: SparkSession, arrivals: str, pool: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, profile: Profile = PACKAGE) -> StreamingQuery:
    """Candidates of every file of records that arrives; the pool is normalised. The sink gets each batch with its number
    and can make it idempotent by that."""

    def step(batch: DataFrame, number: int) -> None:
        sink(blocking.block_topk(linkage.normalized(batch, profile), pool, profile), number)

    stream = spark.readStream.schema(ENTITY).option("sep", "\t").option("header", True).csv(arrivals)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
