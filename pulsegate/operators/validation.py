"""Constraint checks of events: required columns, known schema, enumerations, ranges, whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.operators.joins import small

CONSTRAINT = "path:string,type:string,kind:string,allowed:array<string>,low:double,high:double"


def constraint_rows(constraints: DataFrame) -> DataFrame:
    """One row per (source, version) with its constraints as an array (a schema's fields, so bounded)."""
    item = F.struct("path", "type", "kind", "allowed", "low", "high")
    return constraints.groupBy(F.col("source").alias("_source"), F.col("version").alias("_version")).agg(
        F.array_sort(F.collect_list(item)).alias("constraints")
    )


def _errors(constraint: Column) -> Column:
    """Errors of one constraint as an array of text (two are possible for a range)."""
    path = constraint["path"]
    text = F.try_element_at(F.col("fields"), path)
    number = text.try_cast("double")
    say = lambda kind: F.concat(F.lit(kind + ":"), path)
    enum = F.when(~F.array_contains(constraint["allowed"], text), say("ENUM"))
    numeric = F.when(number.isNull(), F.array(say("TYPE"))).otherwise(
        F.array(
            F.when((number < constraint["low"]) | (number > constraint["high"]), say("RANGE")),
            F.when((constraint["type"] == "INT") & (number != F.floor(number)), say("INTEGER")),
        )
    )
    return (
        F.when(text.isNull(), F.array(say("MISSING")))
        .when(constraint["kind"] == "ENUM", F.array(enum))
        .when(constraint["kind"] == "RANGE", numeric)
        .otherwise(F.array(say("CONSTRAINT")))
    )


def validate(events: DataFrame, constraints: DataFrame, required: tuple[str, ...] = ("event_id", "event_time", "schema_version", "source")) -> DataFrame:
    """Add `errors` (sorted text array, empty when valid). Needs source, schema_version and a `fields` map."""
    rows = events.join(
        small(constraint_rows(constraints)),
        (F.col("source") == F.col("_source")) & (F.col("schema_version") == F.col("_version")), "left",
    )
    missing = F.array(*[F.when(F.col(c).isNull(), F.lit(f"REQUIRED:{c}")) for c in required])
    checked = F.when(F.col("_source").isNull(), F.array(F.concat(F.lit("SCHEMA:"), F.concat_ws(":", "schema_version", "source")))).otherwise(
        F.flatten(F.transform("constraints", _errors))
    )
    errors = F.array_sort(F.filter(F.concat(missing, checked), lambda e: e.isNotNull()))
    return rows.select(*events.columns, errors.alias("errors"))


def summary(validated: DataFrame) -> DataFrame:
    """Total, valid and invalid events."""
    bad = F.size("errors") > 0
    return validated.groupBy().agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid")
    )
