"""Ingest of raw messages: identity, schema lookup, key, time, flattening, casts, dead letters.

One pass over the messages without a shuffle: the schemas of all (source, version)
pairs come as one small table (a row per pair, its field types as a map), and every
check is an expression over the message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.json_leaves import coerce, instant, leaves
from pulsegate.operators.joins import small

DEFAULT_VERSION = "v1.0"
PHONE_KEY = r"^\(\+84\)\d+$"
REASONS = ("missing_source", "schema_missing", "corrupted_payload")


def _blank_as_null(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def read_headers(raw: DataFrame) -> DataFrame:
    """`source` and `schema_version` from the message headers (any case, last one wins); NULL payloads dropped."""

    def header(name: str) -> Column:
        found = F.filter("headers", lambda h: F.lower(h["key"]) == name)
        return F.try_element_at(found, F.lit(-1))["value"].cast("string")

    return raw.where("value is not null").withColumns({
        "header_source": header("source"), "header_version": header("schema_version"),
        "value": F.col("value").cast("string"),
    })


def registry_rows(schemas: DataFrame) -> DataFrame:
    """One row per (source, version): key field and declared types as a map."""
    pairs = F.transform("columns", lambda c: F.struct(c["path"], c["type"]))
    return schemas.select(
        F.col("source").alias("_source"), F.col("version").alias("_version"), "key_field", F.map_from_entries(pairs).alias("types")
    )


def judge_messages(raw: DataFrame, schemas: DataFrame, on_bad_cast: str = "zero", key_format: str | None = None) -> DataFrame:
    """Every message with its parsed parts and `reject_reason` (NULL for a valid event).

    `raw` has topic, partition, offset, timestamp, headers, value. `on_bad_cast` is
    'zero' (unreadable numbers become 0, booleans false) or 'reject'. `key_format`, a
    pattern such as PHONE_KEY, rejects other keys.
    """
    if on_bad_cast not in ("zero", "reject"):
        raise ValueError(on_bad_cast)
    root = F.col("_root")
    text = lambda path: F.try_variant_get(root, path, "string")
    rows = read_headers(raw).withColumn("_root", F.try_parse_json("value")).withColumns({
        "source": F.coalesce(_blank_as_null(F.col("header_source")), _blank_as_null(text("$.metadata.source"))),
        "schema_version": F.coalesce(_blank_as_null(F.col("header_version")), text("$.metadata.schema_version"), F.lit(DEFAULT_VERSION)),
    })
    known = small(registry_rows(schemas))
    rows = rows.join(
        known, (F.col("source") == F.col("_source")) & (F.col("schema_version") == F.col("_version")), "left"
    )
    key = F.call_function("get_json_object", F.col("value"), F.concat(F.lit("$."), F.col("key_field")))
    rows = rows.withColumns({
        "customer_id": F.when(F.col("_root").isNotNull(), _blank_as_null(key)),
        "event_time": instant(text("$.metadata.event_time")),
        "payload_id": text("$.metadata.id"),
    })
    # Text, kind and declared type of a leaf are read once, then judged.
    read = F.transform(
        leaves(root, F.col("value"), skip=F.lit("metadata")),
        lambda e: F.struct(
            e["path"].alias("path"), e["value"].try_cast("string").alias("text"), F.schema_of_variant(e["value"]).alias("kind"),
            F.try_element_at(F.col("types"), e["path"]).alias("dtype"),
        ),
    )
    cast = F.transform(
        F.filter(read, lambda e: e["kind"] != "VOID"),
        lambda e: F.struct(e["path"].alias("path"), coerce(e["text"], e["kind"], e["dtype"], on_bad_cast == "zero").alias("text")),
    )
    rows = rows.withColumn("_cast", F.when(F.col("_source").isNotNull(), cast))
    bad_leaf = F.exists("_cast", lambda e: e["text"].isNull())
    corrupted = F.col("_root").isNull() | F.col("customer_id").isNull() | F.col("event_time").isNull() | F.coalesce(bad_leaf, F.lit(False))
    if key_format:
        corrupted = corrupted | ~F.col("customer_id").rlike(key_format)
    return rows.withColumns({
        "reject_reason": F.when(F.col("_root").isNull(), F.lit("corrupted_payload"))
        .when(F.col("source").isNull(), F.lit("missing_source"))
        .when(F.col("_source").isNull(), F.lit("schema_missing"))
        .when(F.coalesce(corrupted, F.lit(True)), F.lit("corrupted_payload")),
        # Payload ids may repeat between sources; the place in the log never does.
        "row_id": F.concat_ws("-", "topic", "partition", "offset"),
        "event_id": F.coalesce(F.col("payload_id"), F.concat_ws("-", "topic", "partition", "offset")),
        "_task": F.spark_partition_id(),
    })


# The filters also read the task number, which keeps the optimizer from moving them below
# the parsing and parsing every message once per mention.
ACCEPTED = "reject_reason is null and _task >= 0"
REJECTED = "reject_reason is not null and _task >= 0"


def valid_events(judged: DataFrame) -> DataFrame:
    """Accepted messages as events: envelope plus `fields`, a map of dot path to canonical text."""
    return judged.where(ACCEPTED).select(
        "event_id", "row_id", "topic", "partition", "offset", F.col("timestamp").alias("arrival_time"),
        "customer_id", "event_time", "source", "schema_version",
        F.map_from_entries(F.transform("_cast", lambda e: F.struct(e["path"], e["text"]))).alias("fields"),
    )


def dead_letters(judged: DataFrame) -> DataFrame:
    """Rejected messages with their reason and the payload as it came."""
    return judged.where(REJECTED).select(
        "topic", "partition", "offset", "timestamp", "source", "schema_version", "reject_reason", "headers", "value"
    )


def undeclared(valid: DataFrame, schemas: DataFrame) -> DataFrame:
    """Valid events with the part of `fields` their schema does not declare."""
    known = small(registry_rows(schemas))
    joined = valid.join(known, (F.col("source") == F.col("_source")) & (F.col("schema_version") == F.col("_version")), "left")
    extra = F.map_filter("fields", lambda k, v: ~F.map_contains_key(F.col("types"), k))
    return joined.select(*valid.columns, extra.alias("undeclared"))
