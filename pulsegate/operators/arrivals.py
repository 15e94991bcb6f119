"""First arrival per key with a time to live, and the cooldown built on it.

The first row of a key is accepted; the next accepted one is the first row at or
after accepted time + ttl, and so on. Blocked rows do not renew the ttl.

Only one row per key and instant can be accepted, so copies are dropped before the
shuffle. Keys with few instants are folded in place. Keys above FOLD_LIMIT never
come together in one task: each of their rows gets a pointer to the row that would
be accepted after it, and the chain of accepted rows is found by doubling the
pointers (log2 of the chain length joins on unique row keys).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegate.functions.durations import cell, event_us

FOLD_LIMIT = 10_000
BUCKETS_PER_TTL = 16


@dataclass(frozen=True)
class ArrivalSpec:
    """`keys` form the composite key; `order` is the arrival time column; `keep` limits the rows."""

    keys: tuple[Column, ...]
    order: str
    ttl: int | None
    keep: Column


def _complete(columns: list[str]) -> Column:
    out = F.lit(True)
    for column in columns:
        out = out & F.col(column).isNotNull()
    return out


def accepted(rows: DataFrame, keys: list[str], us: str, ident: str, ttl: int | None, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Accepted rows as (keys, us, ident); rows with a NULL key part are never accepted."""
    rows = rows.where(_complete(keys))
    if ttl is None:
        first = rows.groupBy(*keys).agg(F.min(F.struct(us, ident)).alias("_f"))
        return first.select(*keys, F.col(f"_f.{us}").alias(us), F.col(f"_f.{ident}").alias(ident))
    instants = rows.groupBy(*keys, us).agg(F.min(ident).alias(ident))
    heavy = instants.groupBy(*keys).count().where(F.col("count") > fold_limit).drop("count")
    if heavy.isEmpty():
        return _fold(instants, keys, us, ident, ttl)
    light = _fold(instants.join(heavy, keys, "left_anti"), keys, us, ident, ttl)
    return light.unionByName(_chain(instants.join(heavy, keys, "left_semi"), keys, us, ident, ttl))


def _fold(instants: DataFrame, keys: list[str], us: str, ident: str, ttl: int) -> DataFrame:
    """Fold of each key's instants; at most FOLD_LIMIT of them."""
    kind = f"struct<{us}:bigint,{ident}:{dict(instants.dtypes)[ident]}>"
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(us).cast("bigint").alias(us), F.col(ident)))),
        F.lit(None).cast(f"array<{kind}>"),
        lambda acc, row: F.when(acc.isNull(), F.array(row))
        .when(row[us] >= F.element_at(acc, -1)[us] + F.lit(ttl), F.concat(acc, F.array(row)))
        .otherwise(acc),
    )
    return instants.groupBy(*keys).agg(taken.alias("_t")).select(*keys, F.inline("_t"))


def _chain(instants: DataFrame, keys: list[str], us: str, ident: str, ttl: int) -> DataFrame:
    """Accepted rows of heavy keys by pointer doubling. Needs a checkpoint folder."""
    rows = instants.checkpoint()
    grain = max(1, ttl // BUCKETS_PER_TTL)
    points = rows.select(*keys, F.col(us).alias("_at"), F.lit(1).alias("_row"), F.col(us).alias("_from")).unionByName(
        rows.select(*keys, (F.col(us) + F.lit(ttl)).alias("_at"), F.lit(0).alias("_row"), F.col(us).alias("_from"))
    ).withColumn("_bucket", cell(F.col("_at"), grain))
    at = F.when(F.col("_row") == 1, F.col("_at"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(F.desc("_at"), F.desc("_row")).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    buckets = points.groupBy(*keys, "_bucket").agg(F.min(at).alias("_first")).select(
        *keys, "_bucket", F.min("_first").over(after).alias("_next")
    )
    jump = (
        points.withColumn("_inside", F.min(at).over(inside))
        .where("_row = 0")
        .join(buckets, [*keys, "_bucket"])
        .select(*keys, F.col("_from"), F.coalesce("_inside", "_next").alias("_to"))
        .where("_to is not null")
        .checkpoint()
    )
    reached = rows.groupBy(*keys).agg(F.min(us).alias("_from")).checkpoint()
    size, grown = 0, reached.count()
    while grown > size:
        size = grown
        ahead = reached.join(jump, [*keys, "_from"]).select(*keys, F.col("_to").alias("_from"))
        reached = reached.unionByName(ahead).distinct().checkpoint()
        further = jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_last"))
        jump = jump.join(further, [*keys, "_to"]).select(*keys, "_from", F.col("_last").alias("_to")).checkpoint()
        grown = reached.count()
    return rows.join(reached.withColumnRenamed("_from", us), [*keys, us], "left_semi").select(*keys, us, ident)


def first_arrivals(events: DataFrame, spec: ArrivalSpec, ident: str = "event_id", fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Ids of the accepted rows among those `keep` lets through."""
    keys = [f"_k{i}" for i in range(len(spec.keys))]
    rows = events.where(spec.keep).select(
        *[k.cast("string").alias(n) for n, k in zip(keys, spec.keys)], event_us(spec.order).alias("_us"), ident
    )
    return accepted(rows, keys, "_us", ident, spec.ttl, fold_limit).select(ident)


def cooldown(signals: DataFrame, keys: list[str], time: str, ident: str, duration: int, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Signals left when, after one is sent for a key, others are held back for `duration`."""
    rows = signals.select(*keys, event_us(time).alias("_us"), ident)
    kept = accepted(rows, keys, "_us", ident, duration, fold_limit).select(*keys, ident)
    return signals.join(kept, list(dict.fromkeys([*keys, ident])), "left_semi")
