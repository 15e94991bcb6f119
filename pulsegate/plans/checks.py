"""Rule checks: a table of violations from the flattened rules and the field catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.predicates import ALLOWED, NUMERIC
from pulsegate.plans.fields import ENVELOPE

LIST_OPS = ("IN", "NOT IN", "BETWEEN")
SHORT_LIST = 50


def _operator_allowed() -> Column:
    test = F.lit(False)
    for dtype, ops in ALLOWED.items():
        test = test | ((F.col("type") == dtype) & F.col("op").isin(*ops))
    return test


def _literal_wrong() -> Column:
    """Literals that cannot be read as the field's type."""
    given = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    unread = (
        F.when(F.col("type").isin(*NUMERIC), F.exists(given, lambda v: v.try_cast("double").isNull()))
        .when(F.col("type") == "BOOLEAN", F.exists(given, lambda v: ~F.lower(v).isin("true", "false")))
        .when(F.col("type") == "TIMESTAMP", F.exists(given, lambda v: v.try_cast("timestamp").isNull()))
    )
    plain = F.col("right_field").isNull() & F.col("right_expr").isNull() & F.col("value").isNotNull() & ~F.coalesce("is_length", F.lit(False))
    return plain & F.col("op").isin("==", "!=", ">", "<", ">=", "<=", *LIST_OPS) & F.coalesce(unread, F.lit(False))


def _unknown(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Fields read anywhere in a rule - either side, expressions, keys, filters of sequences - that no schema declares."""
    envelope = columns.select("source", "version").distinct().select("source", "version", F.explode(F.array(*map(F.lit, ENVELOPE))).alias("path"))
    every = columns.select("source", "version", "path").unionByName(envelope)
    names = every.select(F.explode(F.array(F.concat_ws(".", "source", "version", "path"), F.concat_ws(".", "source", "path"))).alias("_name")).distinct()
    asked = rows.select("rule_id", "node_path", F.posexplode("reads").alias("_n", "_names")).where(
        ~F.startswith(F.get("_names", F.lit(0)), F.lit("general_schema."))
    )
    each = asked.select("*", F.explode("_names").alias("_name")).join(names.withColumn("_known", F.lit(True)), "_name", "left")
    found = each.groupBy("rule_id", "node_path", "_n").agg(F.first(F.get("_names", F.lit(0))).alias("_spelled"), F.count("_known").alias("_hits"))
    return found.where("_hits = 0").select("rule_id", "node_path", F.concat(F.lit("unknown field "), F.col("_spelled")).alias("problem")).distinct()


def violations(leaves: DataFrame, columns: DataFrame, bucket: int = 60_000_000) -> DataFrame:
    """(rule_id, node_path, problem) rows; problems starting with ``warning`` do not refuse a rule.

    `leaves` come from flatten_rules (with rule_id), `columns` are schema_columns rows.
    Paths are looked up under their qualified name; trigger paths and filter paths under
    the source and version of their trigger or metric.
    """
    named = columns.select(
        F.concat_ws(".", "source", "version", "path").alias("_qualified"), "type", "category"
    ).distinct()
    where = F.col("part") == "trigger"
    prefix = F.concat_ws(".", "source", "version")
    rows = leaves.withColumn(
        "_path",
        F.when(where & F.startswith("field", F.concat(prefix, F.lit("."))), F.col("field"))
        .when(where & F.col("field").isNotNull(), F.concat_ws(".", prefix, "field"))
        .otherwise(F.col("field")),
    )
    typed = rows.join(named, F.col("_path") == F.col("_qualified"), "left")
    is_window = F.col("kind") == "window"
    compared = (F.col("kind") == "condition") & F.col("field").isNotNull()
    numeric_ok = F.col("type").isin(*NUMERIC)
    length_ok = F.col("op").isin("==", "!=", ">", "<", ">=", "<=", "BETWEEN", "IN", "NOT IN") & (F.col("type") == "STRING")
    size = F.size(F.from_json("value", "array<string>"))
    problems = F.array(
        F.when(F.col("part") == "error", F.concat(F.lit("unreadable: "), F.col("error"))),
        F.when(compared & _literal_wrong(), F.concat(F.lit("literal is no "), F.col("type"), F.lit(": "), F.col("value"))),
        F.when(compared & F.col("type").isNotNull() & ~F.when(F.col("is_length"), length_ok).otherwise(_operator_allowed()),
               F.concat(F.lit("operator "), F.col("op"), F.lit(" not allowed for "), F.col("type"))),
        F.when(F.col("op").isin(*LIST_OPS) & (F.col("right_field").isNotNull() | F.col("right_expr").isNotNull() | F.coalesce(~F.startswith("value", F.lit("[")), F.lit(True))),
               F.concat(F.col("op"), F.lit(" needs a list of literals"))),
        F.when((F.col("op") == "BETWEEN") & (size != 2), F.lit("BETWEEN needs two values")),
        F.when(is_window & (F.col("agg") != "count") & F.col("type").isNotNull() & ~numeric_ok, F.lit("window field is not numeric")),
        F.when(is_window & ~F.col("op").isin("<=", ">=", "<", ">"), F.lit("window comparison must be <=, >=, < or >")),
        F.when(is_window & ((F.col("duration_us") % bucket != 0) | (F.col("slide_us") % bucket != 0)), F.lit("duration and slide must be whole buckets")),
        F.when(is_window & (F.col("duration_us") % F.col("slide_us") != 0), F.lit("slide must divide duration")),
        F.when(is_window & ~F.col("filter_given"), F.lit("warning: window without filter")),
        F.when(F.col("op").isin("IN", "NOT IN") & (size >= SHORT_LIST), F.lit("warning: long list, use IN_DATASET")),
    )
    own = typed.select("rule_id", "node_path", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    # Filter fields of window leaves must be dynamic_categorical fields of the metric's source.
    filters = rows.where(is_window).select(
        "rule_id", "node_path", F.explode("filter_fields").alias("_filter"), F.substring_index(F.coalesce("field", F.get("fields", F.lit(0))), ".", 2).alias("_prefix")
    ).withColumn("_path", F.when(F.startswith("_filter", F.concat("_prefix", F.lit("."))), F.col("_filter")).otherwise(F.concat_ws(".", "_prefix", "_filter")))
    # A metric of a general schema has a filter for each source that maps it; those are looked up when compiled.
    filters = filters.where(~F.startswith("_prefix", F.lit("general_schema.")))
    wrong = filters.join(named, F.col("_path") == F.col("_qualified"), "left").select(
        "rule_id", "node_path",
        F.when(F.col("category").isNull(), F.concat(F.lit("unknown filter field "), F.col("_path")))
        .when(F.col("category") != "dynamic_categorical", F.concat(F.lit("filter field is not dynamic_categorical: "), F.col("_path")))
        .alias("problem"),
    ).where("problem is not null")
    return own.unionByName(wrong).unionByName(_unknown(rows, columns))


def accepted_rules(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Rules without a refusing violation."""
    return rules.join(found.where(~F.startswith("problem", F.lit("warning"))), "rule_id", "left_anti")
