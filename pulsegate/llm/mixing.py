"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest.

A source's target over its size is the number of copies that each of its documents should have on
average. The whole part is certain. The fraction is the inclusion probability of one more copy: documents
are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first ones are taken
until their words come nearest to what is left of the target. u is a hash of id, text and seed, so reruns
agree, on any cluster.

Ranks are cut by a histogram: sums of words for each source and rank bin are combined before the shuffle,
bins are added up, and only the documents of the bin where a source's target lies are put in order. No
source is ever sorted as a whole, however large it is.

Defined results: null text has size 0. Null is a source, after all others. A source of size 0 has target 0
and takes nothing; if all sizes are 0, nothing is taken. Rows of equal id and text share their rank and
are taken or left together. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegate.llm.common import WORD, checked_broadcast, store

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BINS = 1 << 14
MIX = "_mix"


def word_count(text: Column) -> Column:
    """Words of a text: characters that are no white space and follow white space or nothing."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """source, source_size, target of each source of `sizes` (source, size).

    Targets share `share` of all sizes by weight; none passes `most` times its source's size, and the excess
    is shared anew. With sources in order of size over weight, the ones below the final level are full.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source: a table of names, ordered as a whole.
    names = Window.orderBy(F.col("source").isNull(), "source")
    picked = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights)) + 1)
    weighed = totals.withColumn("weight", picked)
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    full = F.lit(float(most)) * F.col("source_size")
    # The level if all sources before this one are full and this one and those after it are not.
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    capped = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= full)
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.least(full, F.coalesce(final * F.col("weight"), full))
    return capped.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def pareto_rank(key: Column, probability: Column) -> Column:
    """Random odds over inclusion odds, between 0 and infinity; small ranks are taken first."""
    # 52 bits of the hash, never 0 or 1.
    u = (F.shiftrightunsigned(key, 12).cast("double") + 0.5) / float(1 << 52)
    return (u / (1 - u)) / (probability / (1 - probability))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST, seed: int = 6) -> DataFrame:
    """`documents` and a column `_mix` with size, source_size, target and copies (0 up) of each row, in place of one of that name."""
    mixed = _mixed(documents, weights, share, most, seed)
    return mixed.select(*[F.col("_doc")[c].alias(c) for c in documents.columns if c.lower() != MIX], MIX)


def _mixed(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST, seed: int = 6) -> DataFrame:
    """The rows of `documents` as `_doc`, and `_mix`."""
    # The row travels as one column, so that its names cannot clash with those used here.
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    rows = documents.select(F.struct("*").alias("_doc"), F.col("source").alias("_s"), word_count(F.col("text").cast("string")).alias("size"), key.alias("key"))
    sizes = store(rows.select(F.col("_s").alias("source"), "size", "key"), "mix-sizes")
    targets = store(source_targets(sizes, weights, share, most), "mix-targets")
    cuts = store(_cuts(sizes, targets), "mix-cuts").withColumnRenamed("source", "_t")

    joined = rows.join(checked_broadcast(cuts), F.col("_s").eqNullSafe(F.col("_t")), "left")
    rank = _rank(F.col("key"))
    taken = (F.col("extra") > 0) & ((rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & F.col("at_cut")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("certain") + F.coalesce(taken, F.lit(False)).cast("int"))
    packed = F.struct("size", "source_size", "target", copies.cast("int").alias("copies"))
    return joined.select("_doc", packed.alias(MIX))


def _rank(key: Column) -> Column:
    return pareto_rank(key, F.col("extra"))


def _bin(rank: Column) -> Column:
    return F.floor(rank / (1 + rank) * BINS).cast("int")


def _cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: certain copies, probability of one more, and the rank up to which it is given."""
    rates = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A rate that rounding leaves just off a whole number is that number.
    near = F.when(F.abs(rates - F.round(rates)) < 1e-9, F.round(rates)).otherwise(rates)
    plans = targets.withColumn("rate", near).select(
        F.col("source").alias("_t"), "source_size", "target", F.floor("rate").cast("int").alias("certain"), (F.col("rate") - F.floor("rate")).alias("extra"),
    ).withColumn("left_over", F.col("target") - F.col("certain") * F.col("source_size"))
    plans = checked_broadcast(plans)
    ranked = (
        sizes.join(plans, F.col("source").eqNullSafe(F.col("_t")))
        .filter((F.col("extra") > 0) & (F.col("size") > 0))
        .withColumn("rank", _rank(F.col("key"))).withColumn("bin", _bin(F.col("rank")))
    )
    sums = ranked.groupBy("_t", "bin").agg(F.sum("size").alias("words"), F.first("left_over").alias("left_over"))
    running = F.sum("words").over(Window.partitionBy("_t").orderBy("bin"))
    hit = sums.withColumn("upto", running).filter((F.col("upto") >= F.col("left_over")) & (F.col("upto") - F.col("words") < F.col("left_over")))
    hit = hit.select(F.col("_t").alias("_h"), F.col("bin").alias("hit"), (F.col("upto") - F.col("words")).alias("below"))
    inside = ranked.join(checked_broadcast(hit), F.col("_t").eqNullSafe(F.col("_h")) & (F.col("bin") == F.col("hit")))
    # Rows of one bin: a small part of a source. The last row taken is the one that comes nearest to the target.
    order = Window.partitionBy("_t").orderBy("rank", "key")
    at = F.col("below") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    over = inside.withColumn("at", at).filter((F.col("at") >= F.col("left_over")) & (F.col("at") - F.col("size") < F.col("left_over")))
    cut = over.groupBy("_t").agg(
        F.min("rank").alias("cut_rank"), F.min(F.col("at") - F.col("left_over") <= F.col("left_over") - (F.col("at") - F.col("size"))).alias("at_cut"),
    ).withColumnRenamed("_t", "_c")
    found = plans.join(checked_broadcast(cut), F.col("_t").eqNullSafe(F.col("_c")), "left")
    # Where rounding lets the sum of all words stay below the target, all are taken.
    return found.select(
        F.col("_t").alias("source"), "source_size", "target", "certain", "extra",
        F.coalesce("cut_rank", F.lit(float("inf"))).alias("cut_rank"), F.coalesce("at_cut", F.lit(True)).alias("at_cut"),
    )


def mix_digest(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(documents.select("doc_id", "text", "source")).select(
        "doc_id", f"{MIX}.size", f"{MIX}.source_size", f"{MIX}.target", (F.col(f"{MIX}.copies") * F.col(f"{MIX}.size")).alias("taken"),
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of `documents`, each as often as the mix takes it."""
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{MIX}.copies")))
    return _mixed(documents).filter(F.col(f"{MIX}.copies") > 0).select("_doc", copies.alias("copy")).select("_doc.*")
