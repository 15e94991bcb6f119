"""Event sequences: A followed by B within a time limit on equal keys, or the absence of B.

B must come strictly after A in (event_time, event_id) order and before A.time +
within; each A is judged alone. Rows are grouped by (key, time bucket) with buckets
a sixteenth of the limit, so that a hot key is spread over its buckets: the next B
is searched inside A's bucket, and in the first B of each following bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegate.functions.durations import cell, event_us

BUCKETS_PER_LIMIT = 16


@dataclass(frozen=True)
class SequenceSpec:
    """`first` and `second` are row tests; the keys give the join key on either side."""

    first: Column
    second: Column
    left_keys: tuple[Column, ...]
    right_keys: tuple[Column, ...]
    within: int


def _key(columns: tuple[Column, ...]) -> Column:
    """Key as an array of text; NULL when a part is missing, so that it joins nothing."""
    complete = columns[0].isNotNull()
    for column in columns[1:]:
        complete = complete & column.isNotNull()
    return F.when(complete, F.array(*[c.cast("string") for c in columns]))


def followed(events: DataFrame, spec: SequenceSpec, time: str = "event_time", ident: str = "event_id", payload: tuple[str, ...] = ()) -> DataFrame:
    """The A rows with a complete key, as (ident, payload..., followed)."""
    grain = max(1, spec.within // BUCKETS_PER_LIMIT)
    reach = -(-spec.within // grain)
    roles = F.filter(
        F.array(
            F.struct(F.when(spec.first, F.lit("A")).alias("role"), _key(spec.left_keys).alias("key")),
            F.struct(F.when(spec.second, F.lit("B")).alias("role"), _key(spec.right_keys).alias("key")),
        ),
        lambda c: c["role"].isNotNull() & c["key"].isNotNull(),
    )
    rows = (
        events.where(spec.first | spec.second)
        .select(ident, *payload, event_us(time).alias("_us"), F.inline(roles))
        .withColumn("_bucket", cell(F.col("_us"), grain))
    )
    b_time = F.when(F.col("role") == "B", F.col("_us"))
    later = W.partitionBy("key").orderBy("_bucket").rangeBetween(1, reach)
    buckets = (
        rows.groupBy("key", "_bucket")
        .agg(F.min(b_time).alias("_b"))
        .select("key", "_bucket", F.min("_b").over(later).alias("_next"))
        .where("_next is not null")
    )
    # Scanning backwards, the rows before A are those after it in time; a row that is
    # both A and B meets its own B copy only afterwards.
    backwards = (
        W.partitionBy("key", "_bucket")
        .orderBy(F.desc("_us"), F.desc(ident), F.asc("role"))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    in_time = F.coalesce("_inside", "_next") < F.col("_us") + F.lit(spec.within)
    return (
        rows.withColumn("_inside", F.min(b_time).over(backwards))
        .where(F.col("role") == "A")
        .join(buckets, ["key", "_bucket"], "left")
        .select(ident, *payload, F.coalesce(in_time, F.lit(False)).alias("followed"))
    )
