"""Audit tables, segments, throughput and hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WARN_SHARE = 0.90
HOT_RATE = 500
HOT_TOP = 10


def _identity(rows: DataFrame) -> list[str]:
    """Payload ids may be shared between sources and rows; where rows have an identity of their own it goes along."""
    return ["event_id", *(["row_id"] if "row_id" in rows.columns else [])]


def evaluation_table(judged: DataFrame, processing_time: Column | None = None) -> DataFrame:
    """Second audit table: status and failed condition per event and rule."""
    now = F.current_timestamp() if processing_time is None else processing_time
    return judged.select(*_identity(judged), now.alias("processing_time"), "customer_id", "rule_id", "rule_version", "status", "failed_condition")


def event_log(events: DataFrame, processing_time: Column | None = None) -> DataFrame:
    """First audit table: the event as it came, with the processing time."""
    now = F.current_timestamp() if processing_time is None else processing_time
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))
    return events.select(*_identity(events), now.alias("processing_time"), body.alias("event"))


def flat_audit(log: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both tables in one, joined on the row where both tell rows apart, else on the event id."""
    both = "row_id" in log.columns and "row_id" in evaluation.columns
    log = log.drop("processing_time", *(["event_id"] if both else ["row_id"]))
    return evaluation.join(log, "row_id" if both else "event_id")


def segments(judged: DataFrame) -> DataFrame:
    """Members of each rule's segment: distinct customers with a PASS."""
    return judged.where("status = 'PASS'").select("rule_id", "customer_id").distinct()


def segment_sizes(judged: DataFrame) -> DataFrame:
    return segments(judged).groupBy("rule_id").agg(F.count("*").alias("customers"))


def throughput(events: DataFrame, time: str, target_per_second: float, interval_seconds: int = 5, failed: Column | None = None) -> DataFrame:
    """Rate per interval against a target: share, warning under 90 %, running average, failures.

    Only one row per interval reaches the running sums.
    """
    fail = F.lit(False) if failed is None else failed
    slots = events.groupBy(F.window(time, f"{interval_seconds} seconds").alias("w")).agg(
        F.count_if(~fail).alias("succeeded"), F.count_if(fail).alias("failed")
    ).select(F.col("w.start").alias("interval_start"), "succeeded", "failed")
    begin = slots.groupBy().agg(F.min(F.unix_seconds("interval_start"))).scalar()
    day = F.unix_seconds(F.date_trunc("day", "interval_start"))
    days = slots.groupBy(day.alias("_day")).agg(F.sum("succeeded").alias("_d"))
    earlier = days.select("_day", F.coalesce(F.sum("_d").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_past"))
    within = W.partitionBy("_day").orderBy("interval_start").rowsBetween(W.unboundedPreceding, 0)
    rows = slots.withColumn("_day", day).withColumn("_run", F.sum("succeeded").over(within)).join(earlier, "_day")
    elapsed = F.unix_seconds("interval_start") - begin + F.lit(interval_seconds)
    rate = F.col("succeeded") / F.lit(float(interval_seconds))
    return rows.select(
        "interval_start", "succeeded", "failed", rate.alias("rate"),
        (rate / F.lit(float(target_per_second))).alias("share_of_target"),
        (rate < F.lit(WARN_SHARE * target_per_second)).alias("warning"),
        ((F.col("_past") + F.col("_run")) / elapsed).alias("average_rate"),
    )


def hot_keys(events: DataFrame, key: str, time: str, rate: float = HOT_RATE, slot: str = "1 second", top: int = HOT_TOP) -> DataFrame:
    """The `top` keys by their busiest slot, among those above `rate` events per slot."""
    counts = events.groupBy(key, F.window(time, slot).alias("w")).agg(F.count("*").alias("n"))
    peaks = counts.where(F.col("n") > rate).groupBy(key).agg(
        F.max("n").alias("peak"), F.count("*").alias("hot_slots"), F.sum("n").alias("hot_events")
    )
    return peaks.orderBy(F.desc("peak"), F.desc("hot_events"), key).limit(top)
