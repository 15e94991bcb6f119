"""Rule tables over time: versioned loads, change feed, rules in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegate.functions.durations import cell, event_us

ENVELOPE = "before string, after string, op string, ts_ms bigint"


def next_versions(active: DataFrame, arriving: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One load: (new active table, history rows to append, refused duplicates).

    `active` has rule_id, rule_version, is_active, updated_at, body; `arriving` has
    position (order in the file), rule_id, body. Versions stated in the body do not
    count: the next one is the current one plus one. Of a rule id given twice in a load
    the last is taken. Blank ids are skipped.
    """
    now = F.current_timestamp() if now is None else now
    usable = arriving.where(F.trim("rule_id") != "")
    newest = usable.groupBy("rule_id").agg(F.max_by("body", "position").alias("_body"), F.max("position").alias("_position"))
    refused = usable.join(newest.select("rule_id", F.col("_position")), "rule_id").where("position <> _position").select(arriving.columns)
    joined = active.join(newest.drop("_position"), "rule_id", "full_outer")
    fresh = F.col("_body").isNotNull()
    version = F.when(fresh, F.coalesce("rule_version", F.lit(0)) + 1).otherwise(F.col("rule_version")).cast("int")
    table = joined.select(
        "rule_id",
        version.alias("rule_version"),
        F.when(fresh, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("_body", "body").alias("body"),
        fresh.alias("_fresh"),
    )
    history = table.where("_fresh").select(
        F.concat(F.col("rule_id"), F.lit("_v"), F.col("rule_version")).alias("history_id"),
        "rule_id", "rule_version", "is_active", F.col("updated_at").alias("created_at"), "body",
    )
    return table.drop("_fresh"), history, refused


def parse_changes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Change-feed envelopes (JSON text) to rows (rule_id, op, ts_ms, body)."""
    root = F.from_json(F.col(value).cast("string"), ENVELOPE)
    keep = [c for c in messages.columns if c != value]
    rows = messages.select(*keep, root.alias("e")).where("e.op is not null")
    document = F.coalesce("e.after", "e.before")
    rule_id = F.coalesce(F.get_json_object(document, "$.rule_id"), F.get_json_object(document, "$._id"))
    return rows.select(*keep, rule_id.alias("rule_id"), "e.op", "e.ts_ms", F.col("e.after").alias("body")).where("rule_id is not null")


def apply_changes(changes: DataFrame, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """Rules after the feed: the newest change per rule, deleted ones gone."""
    newest = changes.groupBy("rule_id").agg(F.max_by(F.struct("op", "ts_ms", "body"), F.struct(*order)).alias("c"))
    return newest.select("rule_id", "c.*").where("op <> 'd'")


def effective_spans(history: DataFrame) -> DataFrame:
    """Half-open span in force of every rule version: until the next version of the same rule."""
    following = F.lead("created_at").over(W.partitionBy("rule_id").orderBy("rule_version"))
    return history.withColumns({"effective_from": F.col("created_at"), "effective_to": following})


def judged_counts(events: DataFrame, spans: DataFrame, arrival: str = "arrival_time", slot: int = 3_600_000_000) -> DataFrame:
    """Events each rule version has to judge: arrived while it was in force, on a source it listens to.

    `spans` has rule_id, rule_version, source, version, effective_from, effective_to. Each
    bound of a span asks how many events came before it: those of earlier slots, from running
    counts of slots, and those of its own slot, from a running count of the slot's instants and
    the bounds in it. So events and rules meet in order of time inside a slot, never in pairs,
    and what is ordered by source alone is one row for each slot.
    """
    us = event_us(arrival)
    place = ["source", "schema_version", "_slot"]
    counts = events.select("source", "schema_version", us.alias("_us")).groupBy("source", "schema_version", "_us").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_slot", cell(F.col("_us"), slot))
    kinds = dict(spans.dtypes)
    end = F.coalesce(event_us("effective_to"), F.lit(1 << 62))
    both = F.array(F.struct(event_us("effective_from").alias("_us"), F.lit(-1).alias("_sign")), F.struct(end.alias("_us"), F.lit(1).alias("_sign")))
    bounds = spans.select("rule_id", "rule_version", "source", F.col("version").alias("schema_version"), F.inline(both)).withColumn("_slot", cell(F.col("_us"), slot))
    rows = counts.select(
        F.lit(None).cast(kinds["rule_id"]).alias("rule_id"), F.lit(None).cast(kinds["rule_version"]).alias("rule_version"), *place, "_us", "_n", F.lit(0).alias("_sign")
    ).unionByName(bounds.withColumn("_n", F.lit(0).cast("bigint")))
    # Of equal instants bounds come first: an event at the bound is not before it.
    inside = W.partitionBy(*place).orderBy("_us", F.desc(F.abs("_sign"))).rowsBetween(W.unboundedPreceding, 0)
    asked = rows.withColumn("_inside", F.sum("_n").over(inside)).where("_sign <> 0")
    slots = counts.groupBy(*place).agg(F.sum("_n").alias("_n")).unionByName(bounds.select(*place).distinct().withColumn("_n", F.lit(0).cast("bigint")))
    before = W.partitionBy("source", "schema_version").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    running = slots.groupBy(*place).agg(F.sum("_n").alias("_n")).select(*place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    counted = asked.join(running, place)
    # A span that ends before it begins has judged nothing.
    each = counted.groupBy("rule_id", "rule_version", "source", "schema_version").agg(F.sum(F.col("_sign") * (F.col("_inside") + F.col("_earlier"))).alias("n"))
    return each.groupBy("rule_id", "rule_version").agg(F.sum(F.greatest("n", F.lit(0))).alias("judged"))
