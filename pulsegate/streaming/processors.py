"""State processors of the streaming jobs.

All are keyed, get Arrow batches of one key and order its rows by (time, id). Times
cross the border as microseconds (bigint), so that nothing depends on time zones.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from pulsegate.functions.durations import cell, event_us
from pulsegate.operators.state import NEEDS, Metric, partial

MS = 1_000
# Groups for each shuffle partition, so that a stateless step is evenly dealt.
SPREAD = 4


def _collect(rows, *order: str) -> pd.DataFrame:
    """The rows one key got in this batch, in order."""
    parts = [part for part in rows if len(part)]
    return pd.concat(parts, ignore_index=True).sort_values(list(order), ignore_index=True) if parts else pd.DataFrame()


def _extended(schema: T.StructType, columns: dict[str, str]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in columns.items()]])


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return _holds_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


class LateSplit(StatefulProcessor):
    """Marks rows behind the watermark. Runs in processing time: an event-time step would drop them unseen."""

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs() * MS
        for part in rows:
            yield part.drop(columns="x_spread").assign(watermark_us=watermark, is_late=part["event_us"] < watermark)

    def close(self) -> None:
        pass


def split_late(events: DataFrame, lateness: str = "10 seconds", time: str = "event_time") -> DataFrame:
    """Streaming events with `watermark_us` and `is_late`; late ones go to their own sink.

    The step keeps no state, so rows are spread by a hash of themselves, not by customer.
    """
    rows = events.withColumn("event_us", event_us(time)).withWatermark(time, lateness)
    schema = _extended(rows.schema, {"watermark_us": "bigint", "is_late": "boolean"})
    # Rows have an identity, or at least columns that can be hashed (maps cannot).
    named = ["row_id"] if "row_id" in rows.columns else [f.name for f in rows.schema if not _holds_map(f.dataType)]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in named]), F.lit(SPREAD * parts))
    return rows.withColumn("x_spread", spread).groupBy("x_spread").transformWithStateInPandas(LateSplit(), schema, "Append", "ProcessingTime")


class FirstArrival(StatefulProcessor):
    """Accepts the first row of a key, and the next one once `ttl` has passed since the accepted one.

    Arrival time is a column, so that a replay, a stop or a lag gives the same answer: what a
    key remembers is one number. It goes a ttl and LAG_MS after it was written, by the clock of the
    cluster; rows may lag behind their arrival by as much. Without a ttl a key is accepted once.
    """

    LAG_MS = 86_400_000

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle) -> None:
        keep = None if self.ttl is None else self.ttl // MS + self.LAG_MS
        self.last = handle.getValueState("last", "us bigint", ttlDurationMs=keep)

    def handleInputRows(self, key, rows, timerValues):
        batch = _collect(rows, "arrival_us", "event_id")
        last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for position, us in enumerate(batch["arrival_us"]):
            if last is None or (self.ttl is not None and us >= last + self.ttl):
                taken.append(position)
                last = int(us)
        if taken:
            self.last.update((last,))
            yield batch.iloc[taken]

    def close(self) -> None:
        pass


def first_arrivals(events: DataFrame, keys: list[str], ttl: int | None, arrival: str = "arrival_time") -> DataFrame:
    """Streaming first arrival; with keys (customer_id, rule_id) over PASS rows it is the cooldown."""
    rows = events.withColumn("arrival_us", event_us(arrival))
    return rows.groupBy(*keys).transformWithStateInPandas(FirstArrival(ttl), rows.schema, "Append", "ProcessingTime")


class Sequence(StatefulProcessor):
    """A then B within a limit. A timer at A + limit decides each A; rows may come in any order above the watermark."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us bigint, id string", "customer_id string")
        self.seen = handle.getMapState("seen", "us bigint, id string", "one int")

    def handleInputRows(self, key, rows, timerValues):
        batch = _collect(rows, "event_us", "event_id")
        for row in batch.itertuples():
            at = (int(row.event_us), str(row.event_id))
            if row.is_first:
                self.waiting.updateValue(at, (row.customer_id,))
                # Timers fire once the watermark has passed them, so every B in time has come.
                self.handle.registerTimer(-(-(at[0] + self.within) // MS))
            if row.is_second:
                self.seen.updateValue(at, (1,))
        self._forget(timerValues.getCurrentWatermarkInMs() * MS)
        return iter(())

    def _forget(self, watermark: int) -> None:
        """Drop each B that no waiting A and no A still to come can precede."""
        needed = min([a[0] for a in self.waiting.keys()], default=watermark)
        for b in [b for b in self.seen.keys() if b[0] < min(watermark, needed)]:
            self.seen.removeKey(b)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs() * MS - self.within
        ready = [(a, value) for a, value in self.waiting.iterator() if a[0] <= due]
        if ready:
            seconds = sorted(map(_order, self.seen.keys()))
            out = []
            for a, (customer,) in sorted(ready, key=lambda item: _order(item[0])):
                following = bisect_right(seconds, _order(a))
                hit = following < len(seconds) and seconds[following][0] < a[0] + self.within
                out.append((a[1], customer, a[0], a[0] + self.within, hit))
                self.waiting.removeKey(a)
            self._forget(timerValues.getCurrentWatermarkInMs() * MS)
            yield pd.DataFrame(out, columns=["event_id", "customer_id", "event_us", "decided_us", "followed"])

    def close(self) -> None:
        pass


def _order(at):
    """(time, id), ids numerically where they are numbers."""
    us, ident = at
    return (us, int(ident) if ident.lstrip("-").isdigit() else 0, ident)


class Marks(StatefulProcessor):
    """Decides the sequence and arrival marks that rules wait for; a key is one mark and its key.

    An arrival is decided as it comes: the first of its key, and the next one a time to live
    after an accepted one. The last accepted time is removed by a timer once the clock has
    passed its time to live; without one a key is kept, since it is accepted once.

    The A of a sequence waits until the clock has passed its limit, when every B in time has come.
    Times are cut into cells of a 256th of the limit; a key has one timer for each cell that holds
    rows, and only a timer looks over what waits. It decides the A whose limit has passed, at most a
    cell after it, and drops each B that neither a waiting A nor one still to come can precede. So
    what is kept for a key are the rows of one limit and a cell.
    """

    CELLS = 256

    def __init__(self, numeric: bool):
        self.numeric = numeric

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, span bigint")
        self.waiting = handle.getMapState("waiting", "us bigint, id string", "span bigint")
        self.seen = handle.getMapState("seen", "us bigint, id string", "one int")

    def _place(self, us: int, ident: str):
        return (us, int(ident) if self.numeric else 0, ident)

    def handleInputRows(self, key, rows, timerValues):
        batch = _collect(rows, "event_us", "ident")
        if batch.empty:
            return
        if batch["role"].isin(["F", "E"]).any():
            yield self._arrivals(batch)
            return
        clock = timerValues.getCurrentWatermarkInMs() * MS
        due = set()
        for row in batch.itertuples():
            us, span = int(row.event_us), int(row.span)
            grain = max(MS, span // self.CELLS)
            if row.role == "A":
                self.waiting.updateValue((us, str(row.ident)), (span,))
                due.add((us + span) // grain * grain + grain)
            else:
                self.seen.updateValue((us, str(row.ident)), (1,))
                due.add(us // grain * grain + grain)
        for at in due:
            self.handle.registerTimer(max(-(-at // MS), clock // MS + 1))

    def _arrivals(self, batch: pd.DataFrame) -> pd.DataFrame:
        time = ["arrival_us" if r == "F" else "event_us" for r in batch["role"]]
        batch = batch.assign(at=[int(batch[c].iloc[i]) for i, c in enumerate(time)])
        order = sorted(range(len(batch)), key=lambda i: self._place(batch["at"].iloc[i], str(batch["ident"].iloc[i])))
        batch = batch.iloc[order]
        last = self.last.get()[0] if self.last.exists() else None
        before, accepted = last, []
        for at, span in zip(batch["at"], batch["span"]):
            taken = last is None or (not pd.isna(span) and at >= last + int(span))
            last = int(at) if taken else last
            accepted.append(bool(taken))
        if last != before:
            span = batch["span"].iloc[0]
            span = None if pd.isna(span) else int(span)
            self.last.update((last, span))
            if span is not None:
                self.handle.registerTimer(-(-(last + span) // MS))
        return self._out(batch["mark"].iloc[0], [(str(i), int(us), v) for i, us, v in zip(batch["ident"], batch["event_us"], accepted)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        clock = timerValues.getCurrentWatermarkInMs() * MS
        if self.last.exists():
            last, span = self.last.get()
            if span is not None and last + span <= clock:
                self.last.clear()
            return
        waiting = {k: v[0] for k, v in self.waiting.iterator()}
        ready = sorted((k for k, span in waiting.items() if k[0] + span <= clock), key=lambda k: self._place(*k))
        seconds = sorted((self._place(*k) for k in self.seen.keys()))
        decided = []
        for us, ident in ready:
            following = bisect_right(seconds, self._place(us, ident))
            decided.append((ident, us, following < len(seconds) and seconds[following][0] < us + waiting[(us, ident)]))
            self.waiting.removeKey((us, ident))
        # A row still to come lies at the clock or after it.
        needed = min([us for us, ident in waiting if us + waiting[(us, ident)] > clock], default=clock)
        for us, _, ident in seconds:
            if us < min(clock, needed):
                self.seen.removeKey((us, ident))
        later = [us for us, *_ in seconds if min(clock, needed) <= us < clock]
        if later and len(waiting) > len(ready):
            # Kept for an A that still waits; looked at again when that is decided.
            self.handle.registerTimer(-(-min(us + waiting[(us, ident)] for us, ident in waiting if us + waiting[(us, ident)] > clock) // MS))
        if decided:
            yield self._out(key[0], decided)

    @staticmethod
    def _out(mark: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(ident, mark, us, value) for ident, us, value in rows], columns=["ident", "mark", "event_us", "value"])

    def close(self) -> None:
        pass


STEP = "ident string, event_us bigint, arrival_us bigint, watermark_us bigint, mark string, role string, key string, span bigint"
MARK = "ident string, mark string, event_us bigint, value boolean"


def marks(steps: DataFrame, numeric: bool) -> DataFrame:
    """Streaming marks (ident, mark, event_us, value) of steps, which carry the watermark they were judged under as clock."""
    # Spark takes a row at the watermark itself for late, so the clock runs a second ahead of the one it waits for.
    rows = steps.withColumn("clock", F.timestamp_micros(F.col("watermark_us") + 1_000 * MS)).withWatermark("clock", "1 second")
    return rows.groupBy("mark", "key").transformWithStateInPandas(Marks(numeric), MARK, "Append", "EventTime")


DECIDED = "event_id string, customer_id string, event_us bigint, decided_us bigint, followed boolean"


def sequences(events: DataFrame, keys: list[str], first, second, within: int, lateness: str = "10 seconds", time: str = "event_time") -> DataFrame:
    """One row per A, once its limit has passed in event time: followed by a B or not."""
    rows = (
        events.withWatermark(time, lateness).where(first | second)
        .select(*keys, *[c for c in ("customer_id",) if c not in keys], time, F.col("event_id").cast("string").alias("event_id"),
                event_us(time).alias("event_us"), F.coalesce(first, F.lit(False)).alias("is_first"), F.coalesce(second, F.lit(False)).alias("is_second"))
    )
    return rows.groupBy(*keys).transformWithStateInPandas(Sequence(within), DECIDED, "Append", "EventTime")


INTEGERS = ("tinyint", "smallint", "int", "bigint")
MERGE = {"sum": lambda a, b: a + b, "n": lambda a, b: a + b, "rows": lambda a, b: a + b, "min": min, "max": max}
# State has one shape whatever the rules are: integers (and times), fractions, text.
CELL = "i bigint, d double, s string"


def _kind(dtype: str) -> str:
    return "i" if dtype in (*INTEGERS, "boolean") else "s" if dtype == "string" else "d"


def _cell(value, kind: str) -> tuple:
    return tuple(value if kind == k else None for k in "ids")


def _native(value, kind: str):
    """Python value of a pandas cell; NULL-bearing integers arrive as floats."""
    if value is None or pd.isna(value):
        return None
    return int(value) if kind == "i" else float(value) if kind == "d" else str(value)


class _Totals:
    """Running totals of one series part over windows: recomputed when a window moves on, else added to."""

    def __init__(self, merge):
        self.merge, self.held, self.order, self.open = merge, {}, [], {}

    def load(self, bucket: int, value) -> None:
        self.held[bucket] = value
        insort(self.order, bucket)

    def over(self, first: int, last: int):
        known = self.open.get((first, last))
        if known is None:
            total = None
            for bucket in self.order[bisect_left(self.order, first) : bisect_right(self.order, last)]:
                value = self.held[bucket]
                total = value if total is None else self.merge(total, value)
            self.open[(first, last)] = known = [total]
        return known[0]

    def add(self, bucket: int, value) -> None:
        if bucket in self.held:
            self.held[bucket] = self.merge(self.held[bucket], value)
        else:
            self.load(bucket, value)
        # Windows that end here take the value; others that cover it are counted anew when asked for.
        for (first, last), total in list(self.open.items()):
            if first <= bucket <= last:
                if last == bucket:
                    total[0] = value if total[0] is None else self.merge(total[0], value)
                else:
                    del self.open[(first, last)]
        if len(self.open) > 64:
            self.open.clear()


class CustomerState(StatefulProcessor):
    """Latest profile and bucketed window partials of one customer, applied event by event.

    State is a row for each (series, part, bucket) and one for each attribute, under names that
    come from what the rules read and not from their place in the rule set. So a query may go
    on from its checkpoint with rules replaced, added or put in another order; a new window
    starts empty. Buckets go once the watermark has left the longest window behind them.

    Rows behind the watermark are marked late and change nothing. `ordered` holds rows back
    until the watermark has passed them and applies them in order of (time, id), so that rows
    in any order above the watermark give the batch result; otherwise rows count in the order
    in which they come.
    """

    def __init__(self, parts, metrics, attributes, carried, bucket: int, ordered: bool, profile_ttl_ms: int | None):
        self.parts, self.metrics, self.attributes, self.carried = parts, metrics, attributes, carried
        self.bucket, self.ordered, self.profile_ttl_ms = bucket, ordered, profile_ttl_ms
        self.keep = max([m[3] for m in metrics], default=0) // bucket

    def init(self, handle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "series string, part string, bucket bigint", CELL)
        self.profile = handle.getMapState("profile", "name string", CELL, ttlDurationMs=self.profile_ttl_ms)
        self.pending = handle.getMapState("pending", "us bigint, id string", "row binary") if self.ordered else None

    def handleInputRows(self, key, rows, timerValues):
        batch = _collect(rows, "x_us", "x_id")
        if batch.empty:
            return
        watermark = timerValues.getCurrentWatermarkInMs() * MS
        taken = batch.to_dict("records")
        if not self.ordered:
            yield self._applied(taken, watermark, watermark)
            return
        for row in taken:
            named = {old: row[new] for old, new, _ in self.carried}
            named |= {(s, p): row[c] for c, s, p, _ in self.parts} | {("last", a): row[c] for _, a, c, _ in self.attributes}
            self.pending.updateValue((int(row["x_us"]), str(row["x_id"])), (pickle.dumps((named, row["customer_id"])),))
        self._wake()

    def _wake(self) -> None:
        waiting = [k[0] for k in self.pending.keys()]
        if waiting:
            self.handle.registerTimer(min(waiting) // MS + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs() * MS
        due = sorted(((k, v) for k, v in self.pending.iterator() if k[0] < watermark), key=lambda item: _order(item[0]))
        rows = []
        for (us, ident), (blob,) in due:
            named, customer = pickle.loads(blob)
            row = {new: named.get(old) for old, new, _ in self.carried} | {"x_us": us, "x_id": ident, "customer_id": customer}
            row |= {c: named.get((s, p)) for c, s, p, _ in self.parts} | {c: named.get(("last", a)) for _, a, c, _ in self.attributes}
            rows.append(row)
            self.pending.removeKey((us, ident))
        self._wake()
        if rows:
            yield self._applied(rows, None, watermark)

    def _applied(self, rows: list[dict], watermark: int | None, clock: int) -> pd.DataFrame:
        """The rows with their state; late ones (behind `watermark`) without. Buckets behind the `clock` go."""
        totals = {(s, p): _Totals(MERGE[p]) for _, s, p, _ in self.parts}
        kinds = {(s, p): "ids".index(k) for _, s, p, k in self.parts}
        stale = []
        # Ordered rows lie behind the clock, so the oldest of them still reads its own windows.
        oldest = min([clock, *(row["x_us"] for row in rows)]) if watermark is None else clock
        for (series, part, bucket), value in self.buckets.iterator():
            if bucket < oldest // self.bucket - self.keep - 1:
                stale.append((series, part, bucket))
            elif (series, part) in totals:
                totals[(series, part)].load(bucket, value[kinds[(series, part)]])
        for gone in stale:
            self.buckets.removeKey(gone)
        latest = {}
        for _, name, _, kind in self.attributes:
            held = self.profile.getValue((name,)) if self.profile.containsKey((name,)) else None
            latest[name] = held["ids".index(kind)] if held is not None else None
        touched, changed, out = set(), set(), []
        for row in rows:
            late = watermark is not None and row["x_us"] < watermark
            bucket, done = int(row["x_us"]) // self.bucket, {}
            for name, agg, series, duration, slide in self.metrics:
                per_cell, cells = slide // self.bucket, duration // slide
                first = (bucket // per_cell - cells + 1) * per_cell
                total = {p: None if late else totals[(series, p)].over(first, bucket) for p in NEEDS[agg]}
                if agg == "count":
                    done[name] = total["rows"] or 0
                elif agg == "avg":
                    done[name] = total["sum"] / total["n"] if total["n"] else None
                else:
                    done[name] = total[agg]
            for column, series, part, kind in self.parts:
                value = None if late else _native(row[column], kind)
                if value is not None:
                    totals[(series, part)].add(bucket, value)
                    touched.add((series, part, bucket))
            for short, name, column, kind in self.attributes:
                value = None if late else _native(row[column], kind)
                if value is not None:
                    latest[name] = value
                    changed.add(name)
                done[short] = None if late else latest[name]
            out.append({new: _native(row[new], kind) for _, new, kind in self.carried} | {"customer_id": row["customer_id"], "is_late": late, "watermark_us": clock} | done)
        for series, part, bucket in touched:
            kind = "ids"[kinds[(series, part)]]
            self.buckets.updateValue((series, part, bucket), _cell(totals[(series, part)].held[bucket], kind))
        for _, name, _, kind in self.attributes:
            if name in changed:
                self.profile.updateValue((name,), _cell(latest[name], kind))
        return pd.DataFrame(out, dtype=object)

    def close(self) -> None:
        pass


def _series_id(metric: Metric) -> str:
    return hashlib.sha256(metric.series.encode()).hexdigest()[:32]


def customer_state(events: DataFrame, attributes: dict, metrics: dict[str, Metric], bucket: int, profile_ttl_ms: int | None = None,
                   lateness: str = "10 seconds", ordered: bool = False, ident: str = "event_id") -> DataFrame:
    """Streaming twin of operators.state.add_state: the same columns, `is_late` and `watermark_us`, from state instead of windows.

    The watermark follows the event times, but no event time counts beyond its arrival: a row
    dated far ahead moves nothing. With `ordered`, rows behind the watermark are dropped by
    Spark; split them off before (split_late).
    """
    for name, metric in metrics.items():
        if metric.slide % bucket or metric.duration % metric.slide:
            raise ValueError(f"{name}: duration must be whole slides, slide whole buckets of {bucket} us")
    partials: dict[tuple[str, str], tuple[str, object]] = {}
    for metric in metrics.values():
        for part in NEEDS[metric.agg]:
            partials.setdefault((_series_id(metric), part), (f"x_p{len(partials)}", partial(part, metric)))
    carried = {name: f"x_a{i}" for i, name in enumerate(attributes)}
    clock = F.least("event_time", "arrival_time") if "arrival_time" in events.columns else F.least("event_time", F.current_timestamp())
    rows = events.withColumns({
        "x_us": event_us(), "x_id": F.col(f"`{ident}`").cast("string"), "x_clock": clock,
        **{n: e for n, e in partials.values()}, **{carried[a]: c for a, c in attributes.items()},
    }).withWatermark("x_clock", lateness)
    types = dict(rows.dtypes)

    def crosses(name: str):
        """Times cross the border as microseconds, so that nothing depends on time zones."""
        column = F.col(f"`{name}`")
        return F.unix_micros(column) if types[name] == "timestamp" else column.cast("boolean").cast("int") if types[name] == "boolean" else column

    def back(column, dtype: str):
        return F.timestamp_micros(column.cast("bigint")) if dtype == "timestamp" else column.cast(dtype)

    kind_of = lambda name: "i" if types[name] == "timestamp" else _kind(types[name])
    # Names with dots or brackets do not pass the border: short ones there, and back.
    plain = [c for c in events.columns if c != "customer_id"]
    short = {c: f"c{i}" for i, c in enumerate(plain)}
    named = {name: f"s{i}" for i, name in enumerate([*metrics, *attributes])}
    crossing = rows.select(
        "customer_id", "x_us", "x_id", "x_clock", *[crosses(c).alias(short[c]) for c in plain],
        *[crosses(n).alias(n) for n, _ in partials.values()], *[crosses(c).alias(c) for c in carried.values()],
    )
    processor = CustomerState(
        [(n, series, part, kind_of(n)) for (series, part), (n, _) in partials.items()],
        [(named[name], m.agg, _series_id(m), m.duration, m.slide) for name, m in metrics.items()],
        [(named[a], a, c, kind_of(c)) for a, c in carried.items()], [(c, short[c], kind_of(c)) for c in plain], bucket, ordered, profile_ttl_ms,
    )
    ddl = {"i": "bigint", "d": "double", "s": "string"}
    results = {name: ("double" if m.agg == "avg" else "bigint" if m.agg == "count" else types[partials[(_series_id(m), m.agg)][0]]) for name, m in metrics.items()}
    results |= {name: types[column] for name, column in carried.items()}
    state_kind = lambda dtype: "i" if dtype == "timestamp" else _kind(dtype)
    schema = ", ".join([
        "customer_id string", "is_late boolean", "watermark_us bigint", *[f"{short[c]} {ddl[kind_of(c)]}" for c in plain],
        *[f"{named[n]} {ddl[state_kind(dtype)]}" for n, dtype in results.items()],
    ])
    out = crossing.groupBy("customer_id").transformWithStateInPandas(processor, schema, "Append", "EventTime" if ordered else "ProcessingTime")
    columns = {c: F.col("customer_id") if c == "customer_id" else back(F.col(short[c]), types[c]) for c in events.columns}
    columns |= {n: back(F.col(named[n]), dtype) for n, dtype in results.items()}
    return out.select(*[column.alias(c) for c, column in columns.items()], "is_late", "watermark_us")
