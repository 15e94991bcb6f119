"""Customer state at every event: windowed aggregates and latest profile values.

Per-customer running state would put all rows of one customer into one task. Here
time is cut into buckets, and only (customer, bucket) groups are ever sorted:

1. per (customer, bucket) partial aggregates, combined before the shuffle;
2. window functions over those partials (one row per customer and bucket, however
   many events the bucket has) give what happened in earlier buckets;
3. a window function inside each (customer, bucket) gives what happened earlier
   in the same bucket; the two parts are joined on (customer, bucket).

A customer with a third of all rows is thereby spread over all its buckets.

A window of `duration` and `slide` covers the cells (c - duration/slide, c] where
c is the cell of the event, restricted to rows strictly before the event in
(event_time, id) order, the id being one that no two rows share. A tumbling window has slide = duration.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegate.functions.durations import cell, event_us

KEY = "customer_id"
TIME = "event_time"
ID = "event_id"


@dataclass(frozen=True)
class Metric:
    """Aggregate of `value` over the rows where `keep` holds. Equal `series` share their partials."""

    series: str
    agg: str
    value: Column
    keep: Column
    duration: int
    slide: int


# Partials an aggregate needs: suffix -> (row expression, merge).
NEEDS = {"sum": ("sum", "n"), "avg": ("sum", "n"), "min": ("min",), "max": ("max",), "count": ("rows",)}
_MERGE = {"sum": F.sum, "n": F.sum, "rows": F.sum, "min": F.min, "max": F.max}


def partial(part: str, metric: Metric) -> Column:
    if part == "rows":
        return F.when(metric.keep, F.lit(1).cast("bigint"))
    value = F.when(metric.keep, metric.value)
    return F.when(value.isNotNull(), F.lit(1).cast("bigint")) if part == "n" else value


def _both(part: str, pieces: list[Column]) -> Column:
    """Combine partials of disjoint row sets; NULL stands for the empty set."""
    if len(pieces) == 1:
        return pieces[0]
    if part in ("min", "max"):
        return (F.least if part == "min" else F.greatest)(*pieces)
    total = F.coalesce(pieces[0], F.lit(0))
    for piece in pieces[1:]:
        total = total + F.coalesce(piece, F.lit(0))
    return F.when(F.coalesce(*pieces).isNotNull(), total)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def add_state(
    timeline: DataFrame,
    attributes: dict[str, Column],
    metrics: dict[str, Metric],
    bucket: int = 60_000_000,
    include_current: bool = False,
    ident: str = ID,
) -> DataFrame:
    """Add `attributes` (latest non-null value up to and including the event) and `metrics`.

    `timeline` needs customer_id, event_time, event_id; `bucket` (microseconds) must
    divide every slide.
    """
    for name, metric in metrics.items():
        if metric.slide % bucket or metric.duration % metric.slide:
            raise ValueError(f"{name}: duration must be whole slides, slide whole buckets of {bucket} us")
    if not attributes and not metrics:
        return timeline

    # Distinct (series, partial) columns; rules sharing a series share them.
    partials: dict[tuple[str, str], tuple[str, Column]] = {}
    for metric in metrics.values():
        for part in NEEDS[metric.agg]:
            partials.setdefault((metric.series, part), (f"_p{len(partials)}", partial(part, metric)))
    carried = {name: f"_a{i}" for i, name in enumerate(attributes)}

    rows = timeline.withColumns({
        "_bucket": cell(event_us(TIME), bucket),
        **{name: expr for name, expr in partials.values()},
    })
    order = F.struct(event_us(TIME), F.col(ident))
    buckets = rows.groupBy(KEY, "_bucket").agg(
        *[_MERGE[part](name).alias(name) for (_, part), (name, _) in partials.items()],
        *[F.max_by(attributes[a], F.when(attributes[a].isNotNull(), order)).alias(c) for a, c in carried.items()],
        *([F.lit(1).alias("_any")] if not partials and not carried else []),
    )

    buckets, earlier, open_columns = _earlier_buckets(rows, buckets, metrics, partials, carried, bucket)

    in_bucket = W.partitionBy(KEY, "_bucket").orderBy(TIME, ident)
    before = in_bucket.rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    upto = in_bucket.rowsBetween(W.unboundedPreceding, 0)
    local = {f"_here{name}": _MERGE[part](name).over(before) for (_, part), (name, _) in partials.items()}
    local |= {f"_here{c}": F.last(attributes[a], ignorenulls=True).over(upto) for a, c in carried.items()}
    rows = rows.withColumns(local).drop(*[name for name, _ in partials.values()])

    joined = rows.join(buckets, [KEY, "_bucket"], "left")
    out: dict[str, Column] = {a: F.coalesce(_quoted(f"_here{c}"), _quoted(f"_before{c}")) for a, c in carried.items()}
    for name, metric in metrics.items():
        def total(part: str, metric: Metric = metric) -> Column:
            column = partials[(metric.series, part)][0]
            pieces = [_quoted(f"_here{column}")]
            if metric.slide > bucket:
                pieces.append(_quoted(open_columns[(metric.slide, column)]))
            if metric.duration > metric.slide:
                pieces.append(_quoted(earlier[(metric.duration, metric.slide, column)]))
            return _both(part, pieces)

        if metric.agg == "count":
            out[name] = F.coalesce(total("rows"), F.lit(0).cast("bigint"))
        elif metric.agg == "avg":
            out[name] = F.try_divide(total("sum").cast("double"), total("n"))
        else:
            out[name] = total(metric.agg)
    return joined.select(*[_quoted(c) for c in timeline.columns], *[c.alias(n) for n, c in out.items()])


def _earlier_buckets(rows, buckets, metrics, partials, carried, bucket):
    """Per (customer, bucket): state left by earlier buckets, as columns on `buckets`."""
    by_slide: dict[int, set[int]] = defaultdict(set)
    used: dict[tuple[int, int], set[tuple[str, str]]] = defaultdict(set)
    for metric in metrics.values():
        by_slide[metric.slide].add(metric.duration)
        for part in NEEDS[metric.agg]:
            used[(metric.duration, metric.slide)].add((metric.series, part))

    earlier: dict[tuple[int, int, str], str] = {}
    opened: dict[tuple[int, str], str] = {}
    keep = [KEY, "_bucket"]
    if carried:
        past = W.partitionBy(KEY).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        buckets = buckets.withColumns({f"_before{c}": F.last(c, ignorenulls=True).over(past) for c in carried.values()})
        keep += [f"_before{c}" for c in carried.values()]

    for slide, durations in sorted(by_slide.items()):
        closing = {d: sorted(used[(d, slide)]) for d in durations if d > slide}
        series = sorted({p for d in durations for p in used[(d, slide)]})
        grain = f"_cell{slide}"
        buckets = buckets.withColumn(grain, cell(F.col("_bucket"), slide // bucket) if slide > bucket else F.col("_bucket"))
        if slide > bucket:
            inside = W.partitionBy(KEY, grain).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
            for s, part in series:
                column = partials[(s, part)][0]
                opened[(slide, column)] = f"_open{slide}{column}"
                buckets = buckets.withColumn(f"_open{slide}{column}", _MERGE[part](column).over(inside))
                keep.append(f"_open{slide}{column}")
        if not closing:
            continue
        wanted = sorted({p for parts in closing.values() for p in parts})
        cells = buckets
        if slide > bucket:
            # Partial sums merge: cells are sums of the buckets that are there already.
            cells = buckets.groupBy(KEY, grain).agg(*[_MERGE[part](partials[(s, part)][0]).alias(partials[(s, part)][0]) for s, part in wanted])
        added = {}
        for duration, parts in sorted(closing.items()):
            span = W.partitionBy(KEY).orderBy(grain).rangeBetween(-(duration // slide - 1), -1)
            for s, part in parts:
                column = partials[(s, part)][0]
                name = f"_closed{duration}_{slide}{column}"
                earlier[(duration, slide, column)] = name
                added[name] = _MERGE[part](column).over(span)
        if slide > bucket:
            buckets = buckets.join(cells.select(KEY, grain, *[c.alias(n) for n, c in added.items()]), [KEY, grain], "left")
        else:
            buckets = buckets.withColumns(added)
        keep += list(added)
    return buckets.select(*keep), earlier, opened


def pane_report(events: DataFrame, key: str, time: str, duration: str, slide: str | None, aggregates: list[Column],
                watermark: str | None = None) -> DataFrame:
    """Ordinary windowed table: one row per key and pane, batch or streaming."""
    source = events.withWatermark(time, watermark) if watermark else events
    pane = F.window(time, duration, slide) if slide else F.window(time, duration)
    return source.groupBy(key, pane.alias("pane")).agg(*aggregates)
