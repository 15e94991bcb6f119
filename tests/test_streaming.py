"""Streams give what the batch operators give on the same rows."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from pulsegate.catalog import fixtures as fx
from pulsegate.functions.durations import event_us, micros
from pulsegate.operators import arrivals, ingest, schemas
from pulsegate.operators import sequences as batch_sequences
from pulsegate.plans.compile import compile_rules
from pulsegate.plans.fields import Catalogue
from pulsegate.plans.rules import parse_rule
from pulsegate.sources import events as sources
from pulsegate.sources import sinks
from pulsegate.streaming import jobs, processors

HOUR = 3_600_000_000


def _files(rows, path, column, parts):
    """`parts` files in order of `column`, read one per micro-batch in modification order."""
    edges = rows.approxQuantile(column, [i / parts for i in range(1, parts)], 0.0)
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows
        if low is not None:
            part = part.where(F.col(column) >= low)
        if high is not None:
            part = part.where(F.col(column) < high)
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _set(rows):
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.fixture(scope="module")
def ordered(spark, sf, tmp_path_factory):
    """cdp_events written in time order as four files."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = fx.cdp_events(spark, sf)
    _files(rows, path, "event_id", 4)
    return path, rows


def test_ingest_job_writes_the_batch_result_and_replays_dead_letters(spark, sf, tmp_path):
    messages = fx.raw_messages(spark, sf).withColumn("key", F.lit(None).cast("binary"))
    _files(messages, str(tmp_path / "in"), "offset", 2)
    known = fx.message_schemas(spark, sf)
    columns = schemas.schema_columns(known)
    only_a = schemas.publish_schemas(columns.where("source = 'A'")).withColumn("offset", F.lit(1))
    both = schemas.publish_schemas(columns).withColumn("offset", F.lit(1))
    stream = sources.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    args = (str(tmp_path / "valid"), str(tmp_path / "dead"), str(tmp_path / "ckpt"))
    jobs.start_ingest(stream, lambda s: only_a, *args).awaitTermination(90)
    judged = ingest.judge_messages(messages, known).persist()
    valid, dead = sinks.read_batches(spark, args[0]), sinks.read_batches(spark, args[1])
    assert valid.select("batch_id").distinct().count() == 2
    expect = ingest.valid_events(judged)
    assert _set(valid.select("event_id", "customer_id", "event_time")) == _set(expect.where("source = 'A'").select("event_id", "customer_id", "event_time"))
    # The schema of B arrives late: replaying its dead letters completes the result.
    again = sinks.replay_dead_letters(spark, args[1])
    late = ingest.valid_events(ingest.judge_messages(again, schemas.latest_schemas(schemas.parse_schemas(both))))
    assert valid.count() + late.count() == expect.count()
    judged.unpersist()


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    rows = spark.range(10)
    for _ in range(2):
        sinks.write_batch(rows, str(tmp_path / "out"), 7)
    assert sinks.read_batches(spark, str(tmp_path / "out")).count() == 10


def test_snapshots_pin_a_version(spark, tmp_path):
    path = str(tmp_path / "rules")
    for version in (1, 2, 10):
        sinks.write_snapshot(spark.range(version), path, version)
    assert sinks.read_snapshot(spark, path).count() == 10
    assert sinks.read_snapshot(spark, path, 2).count() == 2


def test_late_rows_leave_the_main_flow(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    first = [(i, "c", base + dt.timedelta(minutes=i)) for i in range(5)]
    # The watermark after the first batch is 00:03:50.
    second = [(10, "c", base), (11, "c", base + dt.timedelta(minutes=3, seconds=49)), (12, "c", base + dt.timedelta(minutes=3, seconds=50))]
    schema = "event_id bigint, customer_id string, event_time timestamp"
    path = str(tmp_path / "two")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    marked = processors.split_late(_stream(spark, path, schema))
    jobs.start_append(marked, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(90)
    out = sinks.read_batches(spark, str(tmp_path / "out"))
    assert sorted(r.event_id for r in out.where("is_late").collect()) == [10, 11]
    assert out.count() == 8


def test_late_split_takes_what_ingest_writes(spark, sf, tmp_path):
    """Validated events hold a map of fields; each row comes out once."""
    judged = ingest.judge_messages(fx.raw_messages(spark, sf), fx.message_schemas(spark, sf))
    valid = ingest.valid_events(judged)
    assert "fields" in valid.columns
    valid.coalesce(2).write.parquet(str(tmp_path / "in"))
    marked = processors.split_late(_stream(spark, str(tmp_path / "in"), valid.schema))
    jobs.start_append(marked, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(90)
    out = sinks.read_batches(spark, str(tmp_path / "out"))
    assert _set(out.select("row_id")) == _set(valid.select("row_id")) and out.where("is_late").count() > 0


def test_ordered_rules_refuse_a_late_sink(spark, tmp_path):
    with pytest.raises(ValueError, match="split"):
        jobs.start_rules(spark.createDataFrame([], EVENTS), _window_rules(("R", "a", 8)), "a", "b", ordered=True, late_path="c")


def test_first_arrival_stream_equals_batch(spark, ordered, tmp_path):
    path, rows = ordered
    rows = rows.withColumn("arrival_time", F.col("event_time"))
    stream = _stream(spark, path, rows.drop("arrival_time").schema).withColumn("arrival_time", F.col("event_time"))
    out = processors.first_arrivals(stream, ["customer_id", "event_type"], 24 * HOUR)
    jobs.start_append(out, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(90)
    spec = arrivals.ArrivalSpec((F.col("customer_id"), F.col("event_type")), "arrival_time", 24 * HOUR, F.lit(True))
    assert _set(sinks.read_batches(spark, str(tmp_path / "out")).select("event_id")) == _set(arrivals.first_arrivals(rows, spec))


def test_sequence_stream_decides_every_a_the_watermark_has_passed(spark, ordered, tmp_path):
    path, rows = ordered
    first, second, within = F.col("event_type") == "view", F.col("event_type") == "click", micros("24h")
    out = processors.sequences(_stream(spark, path, rows.schema), ["customer_id"], first, second, within)
    jobs.start_append(out, str(tmp_path / "out"), str(tmp_path / "ckpt"), timers=True).awaitTermination(90)
    got = sinks.read_batches(spark, str(tmp_path / "out")).select(F.col("event_id").cast("bigint").alias("event_id"), "followed")
    key = (F.col("customer_id"),)
    want = batch_sequences.followed(rows, batch_sequences.SequenceSpec(first, second, key, key, within), payload=("event_time",))
    final = rows.agg(F.max(event_us())).first()[0] - micros("10s")
    # Timers between the last watermark and the end of the input do not fire.
    decided = want.where(event_us() + within <= final - micros("1s")).select("event_id", "followed")
    assert decided.count() > 100
    assert set(_set(decided)) <= set(_set(got)) <= set(_set(want.select("event_id", "followed")))


def test_rule_stream_equals_batch(spark, sf, tmp_path):
    ids = {"R01", "R02", "R03", "R04", "R07", "R10", "R11"}
    rules = [parse_rule(r) for r in fx.rules_small() if r["rule_id"] in ids]
    compiled = compile_rules(rules, fx.catalogue(), bucket=HOUR)
    line = fx.timeline(spark, sf)
    _files(line, str(tmp_path / "in"), "event_id", 4)
    sets = fx.dataset_rows(spark, sf)
    stream = _stream(spark, str(tmp_path / "in"), line.schema)
    query = jobs.start_rules(stream, compiled, str(tmp_path / "audit"), str(tmp_path / "ckpt"), lambda s: sets)
    assert query.awaitTermination(90)
    columns = ["event_id", "rule_id", "status", "failed_condition"]
    got = sinks.read_batches(spark, str(tmp_path / "audit")).select(*columns)
    assert _set(got) == _set(compiled.run(line, sets).select(*columns))


def test_rules_read_validated_messages(spark, sf):
    """Messages to verdicts: ingest, typed timeline, rule."""
    known = fx.message_schemas(spark, sf)
    valid = ingest.valid_events(ingest.judge_messages(fx.raw_messages(spark, sf), known))
    catalogue = Catalogue.from_columns(schemas.schema_columns(known))
    rule = {
        "rule_id": "X", "trigger_criteria": [{"source": "B", "version": "v2", "conditions": [{"field": "risk.device_type", "op": "==", "value": "IOS"}]}],
        "condition_tree": {"type": "CONDITION", "expression": {"field": "B.v2.risk.k", "op": "<", "value": 50}},
    }
    judged = compile_rules([parse_rule(json.dumps(rule))], catalogue).run(schemas.timeline(valid, catalogue.schemas))
    direct = valid.where("source = 'B' and fields['risk.device_type'] = 'IOS' and int(fields['risk.k']) < 50")
    assert judged.where("status = 'PASS'").count() == direct.count() > 0
    assert judged.count() == valid.where("source = 'B'").count()


def test_rate_listener_reports_batches(spark, ordered, tmp_path):
    from pulsegate.streaming.monitor import RateListener

    path, rows = ordered
    lines = []
    listener = RateListener(1e9, lines.append)
    spark.streams.addListener(listener)
    try:
        jobs.start_append(_stream(spark, path, rows.schema), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(90)
        deadline = time.time() + 20
        while len(lines) < 4 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert sum(line["rows"] for line in lines) == rows.count() and all(line["warning"] for line in lines)


BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENTS = "event_id bigint, customer_id string, event_time timestamp, source string, schema_version string, `S.v1.a` bigint, `S.v1.b` bigint"
SMALL = Catalogue({("S", "v1"): {"a": ("LONG", "dynamic_numeric"), "b": ("LONG", "dynamic_numeric")}})
MINUTE = 60_000_000


def _window_rules(*given):
    """Rules of nothing but a window: (id, field, threshold)."""
    rules = []
    for rule_id, field, threshold in given:
        leaf = fx._window(f"S.v1.{field}", "sum", "1h", "1m", [], ">", threshold)
        rules.append(parse_rule({"rule_id": rule_id, "trigger_criteria": [{"source": "S", "schema_version": "v1"}], "condition_tree": leaf}))
    return compile_rules(rules, SMALL, bucket=MINUTE)


def _minutes(*rows):
    return [(i, "c", BASE + dt.timedelta(minutes=m), "S", "v1", a, b) for i, m, a, b in rows]


def _put(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)


def _verdicts(frame):
    return sorted((r.event_id, r.rule_id, r.status) for r in frame.select("event_id", "rule_id", "status").collect())


def _run_rules(spark, tmp_path, rules, name="audit", **options):
    stream = _stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema)
    assert jobs.start_rules(stream, rules, str(tmp_path / name), str(tmp_path / "ckpt"), **options).awaitTermination(120)
    return sinks.read_batches(spark, str(tmp_path / name))


def test_a_rule_of_one_window_runs_on_a_stream(spark, tmp_path):
    rows = _minutes((1, 0, 5, 0), (2, 10, 5, 0), (3, 20, 5, 0), (4, 90, 5, 0))
    _put(spark, str(tmp_path / "in"), rows)
    rules = _window_rules(("R", "a", 8))
    got = _run_rules(spark, tmp_path, rules)
    assert _verdicts(got) == _verdicts(rules.run(spark.createDataFrame(rows, EVENTS))) and (3, "R", "PASS") in _verdicts(got)


def test_ordered_stream_of_unordered_rows_equals_batch(spark, tmp_path):
    first, second = _minutes((1, 60, 5, 0), (3, 100, 5, 0)), _minutes((2, 80, 5, 0), (4, 101, 5, 0))
    end = _minutes((9, 600, 0, 0))
    for part in (first, second, end):
        _put(spark, str(tmp_path / "in"), part)
    rules = _window_rules(("R", "a", 8))
    got = _verdicts(_run_rules(spark, tmp_path, rules, ordered=True, lateness="60 minutes"))
    want = [v for v in _verdicts(rules.run(spark.createDataFrame(first + second + end, EVENTS))) if v[0] != 9]
    assert [v for v in got if v[0] != 9] == want


def test_restart_with_other_rules_keeps_what_belongs_to_each(spark, tmp_path):
    _put(spark, str(tmp_path / "in"), _minutes((1, 0, 100, 1)))
    _run_rules(spark, tmp_path, _window_rules(("RA", "a", 15)))
    _put(spark, str(tmp_path / "in"), _minutes((2, 5, 100, 1)))
    # Another rule first, a window more: no state is taken for another's.
    got = _run_rules(spark, tmp_path, _window_rules(("RB", "b", 15), ("RA", "a", 15)), "second")
    assert [v for v in _verdicts(got) if v[0] == 2] == [(2, "RA", "PASS"), (2, "RB", "FAIL")]


def test_a_row_dated_far_ahead_takes_nothing_away(spark, tmp_path):
    far = [(2, "c", dt.datetime(2100, 1, 1, tzinfo=dt.timezone.utc), "S", "v1", 0, 0)]
    for part in (_minutes((1, 0, 100, 0)), far, _minutes((3, 10, 0, 0))):
        _put(spark, str(tmp_path / "in"), part)
    got = _run_rules(spark, tmp_path, _window_rules(("R", "a", 50)), lateness="1 day")
    # Today's clock bounds the watermark, so the third row is late but the state stays as it was.
    assert (1, "R", "FAIL") in _verdicts(got) and (2, "R", "FAIL") in _verdicts(got)


def test_late_rows_and_the_event_log_of_a_rule_job(spark, tmp_path):
    for part in (_minutes((1, 0, 1, 0)), _minutes((2, 600, 1, 0)), _minutes((3, 1, 1, 0), (4, 601, 1, 0))):
        _put(spark, str(tmp_path / "in"), part)
    got = _run_rules(spark, tmp_path, _window_rules(("R", "a", 50)), late_path=str(tmp_path / "late"), log_path=str(tmp_path / "log"))
    assert [r.event_id for r in sinks.read_batches(spark, str(tmp_path / "late")).collect()] == [3]
    assert [v[0] for v in _verdicts(got)] == [1, 2, 4]
    assert sorted(r.event_id for r in sinks.read_batches(spark, str(tmp_path / "log")).collect()) == [1, 2, 4]


def test_first_arrival_of_shared_payload_ids(spark, tmp_path):
    """Four sources share an id: one PASS for each key, in batch and on a stream."""
    names = ["S1", "S2", "S3", "S4"]
    catalogue = Catalogue({(n, "v1"): {"trans_type": ("STRING", "dynamic_categorical")} for n in names})
    schema = "row_id string, event_id string, customer_id string, event_time timestamp, arrival_time timestamp, source string, schema_version string, " + ", ".join(f"`{n}.v1.trans_type` string" for n in names)
    rows = [
        (f"{n}-0-{k}", f"id{k}", "c", BASE + dt.timedelta(seconds=i), BASE + dt.timedelta(seconds=10 * k + i), n, "v1", *["pay" if m == n else None for m in names])
        for k in range(2) for i, n in enumerate(names)
    ]
    rule = {
        "rule_id": "F", "trigger_criteria": [{"source": n, "schema_version": "v1"} for n in names],
        "condition_tree": {"type": "CONDITION", "expression": {"op": "IS_FIRST_ARRIVAL", "order_by": "processing_time", "key_fields": ["metadata.id", "trans_type"], "ttl": "1h"}},
    }
    frame = spark.createDataFrame(rows, schema)
    judged = compile_rules([parse_rule(rule)], catalogue).run(frame)
    assert sorted(r.row_id for r in judged.where("status = 'PASS'").collect()) == ["S1-0-0", "S1-0-1"] and judged.count() == 8
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    keyed = _stream(spark, str(tmp_path / "in"), frame.schema).select("row_id", "event_id", "arrival_time", F.coalesce(*[f"`{n}.v1.trans_type`" for n in names]).alias("kind"))
    out = processors.first_arrivals(keyed, ["event_id", "kind"], 3600 * 1_000_000)
    jobs.start_append(out, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(90)
    assert sorted(r.row_id for r in sinks.read_batches(spark, str(tmp_path / "out")).collect()) == ["S1-0-0", "S1-0-1"]


@pytest.mark.parametrize("order", ["as they come", "shuffled in files"])
def test_rules_with_sequences_and_arrivals_on_a_stream_equal_batch(spark, sf, tmp_path, order):
    """R08 (absence) and R09 (first arrival), a tree with both, and a rule with neither: one audit, equal to batch."""
    both = {
        "rule_id": "X", "trigger_criteria": [{"source": "B", "schema_version": "v2", "conditions": [[{"field": "k", "op": "<", "value": 80}]]}],
        "condition_tree": {"type": "OR", "children": [
            {"type": "AND", "children": [
                {"type": "SEQUENCE", "pattern": "FOLLOWED_BY", "within": "36h", "first": {"source": "B", "filter": [{"field": "event_type", "op": "==", "value": "view"}]},
                 "second": {"source": "A", "version": "v2", "filter": []}},
                {"type": "CONDITION", "expression": {"op": "IS_FIRST_ARRIVAL", "key_fields": ["session_id"], "ttl": "6h"}}]},
            {"type": "CONDITION", "expression": {"field": "B.v2.amount_cents", "op": ">", "value": 8000}}]}}
    bodies = [r for r in fx.rules_small() if r["rule_id"] in {"R01", "R08", "R09"}] + [both]
    rules = compile_rules([parse_rule(r) for r in bodies], fx.catalogue(), bucket=HOUR)
    line = fx.timeline(spark, sf)
    if order == "shuffled in files":
        line = line.repartition(3)
    _files(line, str(tmp_path / "in"), "event_id", 4)
    paths = {n: str(tmp_path / n) for n in ("audit", "late audit", "waiting")}
    stream = _stream(spark, str(tmp_path / "in"), line.schema)
    assert jobs.start_rules(stream, rules, paths["audit"], str(tmp_path / "c1"), waiting_path=paths["waiting"]).awaitTermination(180)
    assert jobs.start_marks(spark, rules, paths["waiting"], paths["late audit"], str(tmp_path / "c2"), numeric_ids=True).awaitTermination(180)
    columns = ["event_id", "rule_id", "status", "failed_condition"]
    got = _set(sinks.read_batches(spark, paths["audit"]).select(*columns)) + _set(sinks.read_batches(spark, paths["late audit"]).select(*columns))
    want = rules.run(line, keep=("event_time",))
    clock = sinks.read_batches(spark, f"{paths['waiting']}/steps").agg(F.max("watermark_us")).head()[0]
    # An A is decided a cell after its limit at the latest; later ones are still open: views, in the rules with a sequence.
    views = line.where("`B.v2.event_type` = 'view'").select("event_id").withColumn("view", F.lit(True))
    limit = F.when(F.col("rule_id") == "R08", micros("24h")).when(F.col("rule_id") == "X", micros("36h"))
    open_ = want.join(views, "event_id", "left").where(F.col("view") & (event_us() + limit * (1 + 1 / processors.Marks.CELLS) > clock - 1_000_000)).select(*columns)
    still = set(_set(open_))
    assert len(got) == len(set(got)) and len(still) > 10
    assert set(_set(want.select(*columns))) - still <= set(got) <= set(_set(want.select(*columns)))
    assert {(r, s) for _, r, s, _ in got} >= {("R08", "PASS"), ("R08", "FAIL"), ("R09", "PASS"), ("R09", "FAIL"), ("X", "PASS"), ("X", "FAIL")}


class _Store(dict):
    """A map or value state in memory."""

    updateValue, removeKey, iterator = dict.__setitem__, dict.__delitem__, lambda self: iter(list(self.items()))

    def keys(self):
        return list(dict.keys(self))

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def update(self, value):
        self["v"] = value


class _Handle:
    def __init__(self):
        self.timers, self.stores = set(), {}

    def state(self, name, *_, **__):
        return self.stores.setdefault(name, _Store())

    getMapState = getValueState = state

    def registerTimer(self, at):
        self.timers.add(at)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("seed", range(6))
def test_marks_decide_as_the_definition_and_leave_no_state(seed):
    """Rows out of order above the clock: each A as by comparing all pairs; nothing is left once the clock has passed."""
    import random

    import pandas as pd

    rng = random.Random(seed)
    span = rng.choice([5_000, 60_000]) * 1_000
    rows = [(rng.randrange(0, 300_000) * 1_000, i, rng.choice("AB")) for i in range(120)]
    rows += [(us, 1_000 + i, "A") for us, i, role in rows if role == "B"][:10]
    step = processors.Marks(numeric=True)
    handle = _Handle()
    step.init(handle)
    got, clock, most = {}, 0, 0
    waves = {}
    for us, i, role in rows:
        # A row comes while the clock is behind it.
        waves.setdefault(max(0, us - rng.randrange(0, 20_000_000)) // 10_000_000, []).append((us, i, role))
    for wave in [*sorted(waves), 10_000]:
        batch = pd.DataFrame([(str(i), us, us, 0, "m", role, "k", span) for us, i, role in waves.get(wave, [])], columns=[c.split()[0] for c in processors.STEP.split(", ")])
        out = list(step.handleInputRows(("m", "k"), iter([batch]), _Clock(clock)) or ())
        clock = max(clock, wave * 10_000)
        while due := [t for t in handle.timers if t <= clock]:
            handle.timers -= set(due)
            for _ in due:
                out += list(step.handleExpiredTimer(("m", "k"), _Clock(clock), None))
        got |= {int(r.ident): r.value for part in out for r in part.itertuples()}
        most = max(most, sum(map(len, handle.stores.values())))
    want = {i: any(role == "B" and (us, i) < (t, j) and t < us + span for t, j, role in rows) for us, i, kind in rows if kind == "A"}
    assert got == want
    assert not handle.stores["waiting"] and not handle.stores["seen"] and most < len(rows)


def test_arrival_marks_forget_what_has_lived(monkeypatch):
    import pandas as pd

    step = processors.Marks(numeric=True)
    handle = _Handle()
    step.init(handle)
    columns = [c.split()[0] for c in processors.STEP.split(", ")]
    rows = [("1", 0, 5_000_000, 0, "m", "F", "k", 10_000_000), ("2", 0, 14_999_999, 0, "m", "F", "k", 10_000_000), ("3", 0, 15_000_000, 0, "m", "F", "k", 10_000_000)]
    out = list(step.handleInputRows(("m", "k"), iter([pd.DataFrame(rows, columns=columns)]), _Clock(0)))
    assert out[0]["value"].tolist() == [True, False, True]
    list(step.handleExpiredTimer(("m", "k"), _Clock(24_999), None))
    assert handle.stores["last"]
    list(step.handleExpiredTimer(("m", "k"), _Clock(25_000), None))
    assert not handle.stores["last"]
