"""Schemas as data: messages to columns, the newest per (source, version), publication, typed views."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegate.functions.json_leaves import INSTANT, OBJECT, leaves
from pulsegate.functions.predicates import SPARK_TYPES
from pulsegate.operators.joins import kept

TYPES = tuple(SPARK_TYPES)
CATEGORIES = ("dynamic_numeric", "static_categorical", "dynamic_categorical", "static_numeric")


def parse_schemas(messages: DataFrame, value: str = "value") -> DataFrame:
    """Schema messages to one row each: source, version, key_field, total_fields, columns, valid.

    A leaf is an object with both `type` and `category`. An unknown type or category, or
    unreadable JSON, makes the message invalid.
    """
    root = F.try_parse_json(F.col(value).cast("string"))
    is_leaf = lambda node: F.map_contains_key(node, F.lit("type")) & F.map_contains_key(node, F.lit("category"))
    parsed = messages.withColumn("_root", root).withColumn(
        "_leaves",
        F.filter(leaves(F.try_variant_get("_root", "$.structure", "variant"), F.col(value).cast("string"), stop=is_leaf),
                 lambda e: e["value"].try_cast(OBJECT).isNotNull()),
    )

    def column(entry: Column) -> Column:
        return F.struct(
            entry["path"].alias("path"),
            F.upper(F.try_variant_get(entry["value"], "$.type", "string")).alias("type"),
            F.lower(F.try_variant_get(entry["value"], "$.category", "string")).alias("category"),
        )

    known = lambda c: c["type"].isin(*TYPES) & c["category"].isin(*CATEGORIES)
    keep = [c for c in messages.columns if c != value]
    return (
        parsed.withColumn("columns", F.coalesce(F.transform("_leaves", column), F.array().cast("array<struct<path:string,type:string,category:string>>")))
        .select(
            *keep,
            F.coalesce(F.try_variant_get("_root", "$.metadata.source", "string"), F.lit("")).alias("source"),
            F.coalesce(F.try_variant_get("_root", "$.metadata.schema_version", "string"), F.lit("")).alias("version"),
            F.coalesce(F.try_variant_get("_root", "$.key_field", "string"), F.lit("metadata.customer_id")).alias("key_field"),
            F.coalesce(F.try_variant_get("_root", "$.total_fields", "int"), F.lit(0)).alias("total_fields"),
            "columns",
            (F.col("_root").isNotNull() & F.forall("columns", lambda c: F.coalesce(known(c), F.lit(False)))).alias("valid"),
        )
    )


def newest_texts(messages: DataFrame, value: str = "value", order: str = "offset") -> DataFrame:
    """The newest message of each text: opening a message is work, and of messages of one text only the newest can be in force.

    What is left is spread over all cores and kept in the shared folder: the test for validity, which opens a
    message, would otherwise be pushed down to all messages, into the few tasks that read them.
    """
    newest = messages.groupBy(value).agg(F.max(order).alias(order))
    return kept(newest.repartition(messages.sparkSession.sparkContext.defaultParallelism), "schemas")


def latest_schemas(parsed: DataFrame, order: str = "offset") -> DataFrame:
    """Last valid message per (source, version); an invalid one leaves the older in force."""
    body = F.struct("key_field", "total_fields", "columns")
    newest = parsed.where("valid").groupBy("source", "version").agg(F.max_by(body, F.col(order)).alias("s"))
    return newest.select("source", "version", "s.*")


def schema_columns(schemas: DataFrame) -> DataFrame:
    """One row per declared field."""
    return schemas.select("source", "version", "key_field", "total_fields", F.inline("columns"))


def publish_schemas(columns: DataFrame, timestamp: str | None = None) -> DataFrame:
    """Schema messages (key `version:source`, JSON value) from `schema_columns` rows.

    One group is one schema, so a few hundred fields at most.
    """

    def message(fields: pd.DataFrame) -> pd.DataFrame:
        first = fields.iloc[0]
        structure: dict = {}
        for row in fields.sort_values("path").itertuples():
            *parents, name = row.path.split(".")
            node = structure
            for parent in parents:
                node = node.setdefault(parent, {})
            node[name] = {"type": row.type, "category": row.category}
        body = {
            "metadata": {"schema_version": first.version, "source": first.source, "timestamp": timestamp},
            "key_field": first.key_field, "total_fields": int(first.total_fields), "structure": structure,
        }
        text = json.dumps(body, separators=(",", ":"), ensure_ascii=False)
        return pd.DataFrame({"key": [f"{first.version}:{first.source}"], "value": [text]})

    wanted = columns.select("source", "version", "key_field", "total_fields", "path", "type", "category")
    return wanted.groupBy("source", "version").applyInPandas(message, "key string, value string")


def struct_type(columns: list[tuple[str, str]]) -> T.StructType:
    """StructType mirroring the event, from (path, type) pairs."""
    tree: dict = {}
    for path, dtype in columns:
        node = tree
        *parents, name = path.split(".")
        for parent in parents:
            node = node.setdefault(parent, {})
        node[name] = dtype

    def build(node: dict) -> T.StructType:
        fields = []
        for name, inner in node.items():
            kind = build(inner) if isinstance(inner, dict) else T.DataType.fromDDL(SPARK_TYPES[inner])
            fields.append(T.StructField(name, kind))
        return T.StructType(fields)

    return build(tree)


def _typed(path: str, dtype: str) -> Column:
    text = F.try_element_at("fields", F.lit(path))
    if dtype == "TIMESTAMP":
        return F.when(text.rlike(INSTANT), text.try_cast("timestamp"))
    return text.try_cast(SPARK_TYPES[dtype])


def wide_view(valid: DataFrame, source: str, version: str, columns: list[tuple[str, str]], qualified: bool = True) -> DataFrame:
    """Typed columns of one (source, version) from validated events with a `fields` map."""
    here = valid.where((F.col("source") == source) & (F.col("schema_version") == version))
    typed = [
        _typed(path, dtype).alias(f"{source}.{version}.{path}" if qualified else path)
        for path, dtype in columns if not path.startswith("metadata.")
    ]
    return here.select(*[c for c in valid.columns if c != "fields"], *typed)


def timeline(valid: DataFrame, schemas: dict[tuple[str, str], dict[str, tuple[str, str]]]) -> DataFrame:
    """Validated events of all sources with typed, qualified columns; NULL where the event is of another source.

    One projection over the rows, so it serves a batch and a stream alike.
    """
    typed = []
    for (source, version), fields in sorted(schemas.items()):
        here = (F.col("source") == source) & (F.col("schema_version") == version)
        typed += [
            F.when(here, _typed(path, dtype)).alias(f"{source}.{version}.{path}")
            for path, (dtype, _) in sorted(fields.items()) if not path.startswith("metadata.")
        ]
    return valid.select(*[c for c in valid.columns if c != "fields"], *typed)
