"""Large lookup sets: messages, upsert, and membership of a field or an ordered tuple.

A tuple is compared part by part (an array of text), so ("A", "B_C") and
("A_B", "C") differ, and no hash stands in for the value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.operators.joins import small

MESSAGE = "dataset_id string, dataset_version string, fields array<string>, `values` array<array<string>>"
SMALL_LIST = 50


@dataclass(frozen=True)
class Membership:
    dataset_id: str
    version: str | None
    columns: tuple[Column, ...]


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Dataset messages (JSON text) to rows (dataset_id, dataset_version, key)."""
    parsed = messages.select(F.from_json(F.col(value).cast("string"), MESSAGE).alias("m")).where("m.dataset_id is not null")
    return parsed.select(
        "m.dataset_id", "m.dataset_version", F.size("m.fields").alias("width"), F.explode("m.values").alias("key")
    ).where(F.size("key") == F.col("width")).drop("width")


def upsert(known: DataFrame | None, arriving: DataFrame) -> DataFrame:
    """Known rows plus new ones; a tuple already present is ignored."""
    rows = arriving if known is None else known.unionByName(arriving)
    return rows.dropDuplicates(["dataset_id", "dataset_version", "key"])


def version_order(version: Column) -> Column:
    """What versions are ordered by: all their numbers from left to right (v1.10 after v1.2), then the text; NULL first."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"(\d+)")), lambda n: n.try_cast("decimal(38,0)"))
    return F.struct(version.isNotNull().alias("given"), numbers.alias("numbers"), F.coalesce(version, F.lit("")).alias("text"))


def newest(rows: DataFrame) -> DataFrame:
    """Rows of the highest version of each dataset: what a rule without a version means."""
    top = rows.groupBy("dataset_id").agg(F.max_by("dataset_version", version_order(F.col("dataset_version"))).alias("_top"))
    return rows.join(small(top), "dataset_id").where(F.col("dataset_version").eqNullSafe(F.col("_top"))).drop("_top")


def members(rows: DataFrame, dataset_id: str, version: str | None) -> DataFrame:
    """Distinct keys of one dataset; without a version, of the newest one."""
    rows = rows.where(F.col("dataset_id") == dataset_id)
    rows = newest(rows) if version is None else rows.where(F.col("dataset_version") == version)
    return rows.select("key").distinct()


def tuple_key(columns: tuple[Column, ...]) -> Column:
    """Ordered tuple of a row as text parts, NULL when a part is missing."""
    complete = columns[0].isNotNull()
    for column in columns[1:]:
        complete = complete & column.isNotNull()
    return F.when(complete, F.array(*[c.cast("string") for c in columns]))


def add_membership(events: DataFrame, name: str, spec: Membership, rows: DataFrame, ident: str = "event_id") -> DataFrame:
    """Add boolean `name`. Rows without a complete tuple get a key of their own, spread over the tasks."""
    key = F.coalesce(
        F.array_prepend(tuple_key(spec.columns), F.lit("k")), F.array(F.lit("none"), F.col(ident).cast("string"))
    )
    known = members(rows, spec.dataset_id, spec.version).select(
        F.array_prepend("key", F.lit("k")).alias("_tuple"), F.lit(True).alias(name)
    )
    joined = events.withColumn("_tuple", key).join(known, "_tuple", "left")
    return joined.select(*[F.col(f"`{c}`") for c in events.columns], F.coalesce(F.col(f"`{name}`"), F.lit(False)).alias(name))


def only_members(events: DataFrame, spec: Membership, rows: DataFrame) -> DataFrame:
    """Filter form: the events whose tuple is in the dataset."""
    known = members(rows, spec.dataset_id, spec.version).select(F.col("key").alias("_tuple"))
    keyed = events.withColumn("_tuple", tuple_key(spec.columns)).where("_tuple is not null")
    return keyed.join(known, "_tuple", "left_semi").drop("_tuple")


def sizes(rows: DataFrame) -> DataFrame:
    """Tuples per dataset version, with the advice to use IN for short lists."""
    counted = rows.groupBy("dataset_id", "dataset_version").agg(F.count("*").alias("tuples"))
    return counted.withColumn("use_in", F.col("tuples") < SMALL_LIST)
