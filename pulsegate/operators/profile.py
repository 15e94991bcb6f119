"""Customer profile: latest value per attribute, as of now or as of every event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.durations import event_us
from pulsegate.operators.state import add_state


def latest_values(events: DataFrame, key: str, attributes: list[str], time: str = "event_time", ident: str = "event_id") -> DataFrame:
    """One row per key with the latest non-null value of each attribute; combined before the shuffle."""
    order = F.struct(event_us(time), F.col(ident))
    latest = [F.max_by(F.col(f"`{a}`"), F.when(F.col(f"`{a}`").isNotNull(), order)).alias(a) for a in attributes]
    return events.groupBy(key).agg(*latest)


def profile_as_of(timeline: DataFrame, attributes: dict[str, Column], bucket: int = 60_000_000) -> DataFrame:
    """At every event the latest non-null value of each attribute, the event itself included."""
    return add_state(timeline, attributes, {}, bucket)


def batch_rows(table: DataFrame, key: str, loaded_at: Column, source: str) -> DataFrame:
    """Rows of a batch table as events that refresh the profile.

    Their ids are negative hashes of source and key, so that they sort before stream
    events of the same instant.
    """
    ident = -1 - (F.xxhash64(F.lit(source), F.col(key)).bitwiseAND(F.lit((1 << 62) - 1)))
    return table.select(ident.alias("event_id"), loaded_at.alias("event_time"), *[F.col(f"`{c}`") for c in table.columns])
