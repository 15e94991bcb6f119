"""Late events of a batch replay: those behind the watermark their arrival met.

The watermark at a message is the highest event time of earlier offsets of its
partition, less the allowed lateness. Offsets are cut into chunks: the maximum of
earlier chunks comes from one row per chunk, the rest from inside the chunk, so that
a partition of any length is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegate.functions.durations import event_us, micros

CHUNK = 100_000


def with_watermark(events: DataFrame, lateness: str = "10s", partition: tuple[str, ...] = ("topic", "partition"),
                   offset: str = "offset", chunk: int = CHUNK) -> DataFrame:
    """Add `watermark_us` (NULL before the first event) and `is_late`."""
    rows = events.withColumn("_chunk", F.call_function("div", F.col(offset), F.lit(chunk)))
    keys = [*partition]
    chunks = rows.groupBy(*keys, "_chunk").agg(F.max(event_us()).alias("_top"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "_chunk", F.max("_top").over(before).alias("_earlier"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(offset).rowsBetween(W.unboundedPreceding, -1)
    top: Column = F.greatest("_earlier", "_inside")
    joined = rows.withColumn("_inside", F.max(event_us()).over(inside)).join(chunks, [*keys, "_chunk"], "left")
    return joined.withColumn("watermark_us", top - F.lit(micros(lateness))).select(
        *[F.col(f"`{c}`") for c in events.columns], "watermark_us",
        F.coalesce(event_us() < F.col("watermark_us"), F.lit(False)).alias("is_late"),
    )
