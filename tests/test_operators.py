"""Edge rows and hot keys, against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegate.operators import arrivals, candidates, datasets, ingest, lateness, schemas, sequences
from pulsegate.operators.state import Metric, add_state
from pulsegate.plans.compile import compile_rules
from pulsegate.plans.fields import Catalogue
from pulsegate.plans.flatten import flatten_rules
from pulsegate.plans.rules import parse_rule

BASE = dt.datetime(2024, 1, 1)
EVENT = "event_id bigint, customer_id string, event_time timestamp, v bigint"


def _events(n, seed, hot=0.5, step=30):
    """Half the rows are one customer's; times tie often."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < hot else f"c{rng.randrange(5)}", BASE + dt.timedelta(minutes=step * rng.randrange(60)),
             rng.randrange(100) if rng.random() < 0.8 else None) for i in range(n)]


@pytest.mark.parametrize("include_current", [False, True])
def test_windows_with_ties_and_a_hot_customer(spark, include_current):
    rows, hour = _events(300, 1), 3_600_000_000
    keep = F.col("v") % 3 != 0
    metrics = {agg: Metric("s", agg, F.col("v"), keep, 6 * hour, 2 * hour) for agg in ("sum", "count", "avg", "min", "max")}
    got = {r.event_id: r for r in add_state(spark.createDataFrame(rows, EVENT), {"last": F.col("v")}, metrics, hour // 2, include_current).collect()}
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert len(got) == 300
    for i, c, t, v in rows:
        mine = [r for r in rows if r[1] == c and ((r[2], r[0]) < (t, i) or (include_current and r[0] == i))]
        cell = us(t) // (2 * hour)
        inside = [r[3] for r in mine if cell - 3 < us(r[2]) // (2 * hour) <= cell and r[3] is not None and r[3] % 3 != 0]
        row = got[i]
        assert row["count"] == len(inside)
        assert (row["sum"], row["min"], row["max"]) == ((sum(inside), min(inside), max(inside)) if inside else (None, None, None))
        assert row["avg"] == (pytest.approx(sum(inside) / len(inside)) if inside else None)
        earlier = [r for r in rows if r[1] == c and (r[2], r[0]) <= (t, i) and r[3] is not None]
        assert row["last"] == (max(earlier, key=lambda r: (r[2], r[0]))[3] if earlier else None)


def test_window_widths_are_checked(spark):
    metric = {"m": Metric("s", "sum", F.col("v"), F.lit(True), 100, 30)}
    with pytest.raises(ValueError):
        add_state(spark.createDataFrame([], EVENT), {}, metric, 10)


@pytest.mark.parametrize("limit", [3, 10_000])
def test_first_arrival_by_fold_and_by_pointers(spark, limit):
    rows = _events(400, 2, step=7)
    rows += [(1000 + i, "hot", BASE, 1) for i in range(50)]  # copies of one instant
    ttl = 60 * 60_000_000
    spec = arrivals.ArrivalSpec((F.col("customer_id"),), "event_time", ttl, F.lit(True))
    got = sorted(r.event_id for r in arrivals.first_arrivals(spark.createDataFrame(rows, EVENT), spec, fold_limit=limit).collect())
    want, last = [], {}
    for i, c, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if c not in last or t - last[c] >= dt.timedelta(microseconds=ttl):
            want.append(i)
            last[c] = t
    assert got == sorted(want)


def test_sequences_with_ties_and_missing_keys(spark):
    rows = _events(300, 3, step=11) + [(900, None, BASE, 1)]
    within = 37 * 60_000_000
    key = (F.col("customer_id"),)
    spec = sequences.SequenceSpec(F.col("v") % 2 == 0, F.col("v") % 3 == 0, key, key, within)
    got = {r.event_id: r.followed for r in sequences.followed(spark.createDataFrame(rows, EVENT), spec).collect()}
    want = {}
    for i, c, t, v in rows:
        if v is not None and v % 2 == 0 and c is not None:
            want[i] = any(r[1] == c and r[3] is not None and r[3] % 3 == 0 and (r[2], r[0]) > (t, i) and r[2] < t + dt.timedelta(microseconds=within) for r in rows)
    assert got == want


def test_watermark_over_chunks(spark):
    rng = random.Random(4)
    rows = [(i, "t", i % 2, BASE + dt.timedelta(seconds=i + rng.randrange(-40, 40))) for i in range(200)]
    got = lateness.with_watermark(spark.createDataFrame(rows, "offset bigint, topic string, partition int, event_time timestamp"), chunk=17)
    top, late = {}, set()
    for i, _, p, t in rows:
        if p in top and t < top[p] - dt.timedelta(seconds=10):
            late.add(i)
        top[p] = max(top.get(p, t), t)
    assert {r.offset for r in got.where("is_late").collect()} == late and late


def _message(offset, value, headers=None):
    pairs = [(k, v.encode()) for k, v in headers or []]
    return ("t", 0, offset, BASE, pairs, value if value is None else value.encode())


RAW = "topic string, partition int, offset bigint, timestamp timestamp, headers array<struct<key:string,value:binary>>, value binary"


@pytest.fixture(scope="module")
def registry(spark):
    structure = {"n": {"type": "int", "category": "DYNAMIC_NUMERIC"}, "g": {"ok": {"type": "BOOLEAN", "category": "dynamic_categorical"},
                 "at": {"type": "TIMESTAMP", "category": "dynamic_categorical"}}, "o": {"type": "OBJECT", "category": "static_categorical"},
                 "d": {"type": "DOUBLE", "category": "dynamic_numeric"}}
    good = {"metadata": {"source": "S", "schema_version": "v1.0"}, "structure": structure}
    bad = good | {"structure": {"n": {"type": "DECIMAL", "category": "dynamic_numeric"}}}
    rows = [(1, json.dumps(good)), (2, json.dumps(bad)), (3, "{broken")]
    parsed = schemas.parse_schemas(spark.createDataFrame(rows, "offset bigint, value string"))
    return schemas.latest_schemas(parsed).persist()


def test_ingest_edges(spark, registry):
    meta = {"customer_id": "c", "source": "S", "event_time": "2024-01-01T07:00:00.500+07:00"}
    body = lambda fields, **m: json.dumps({"metadata": {k: v for k, v in (meta | m).items() if v is not None}, **fields})
    rows = [
        _message(0, body({"n": "12.9", "g": {"ok": 1, "at": "2024-01-01T00:00:00Z"}, "d": "word", "extra": {"deep": {"x": 5}}, "list": [1], "o": [1, 2], "gone": None})),
        _message(1, body({"n": 3}), [("SOURCE", "old"), ("Source", "S"), ("schema_version", " ")]),
        _message(2, body({"n": 3}), [("source", "other")]),
        _message(3, body({}, customer_id=" ")),
        _message(4, body({}, event_time="2024-01-01T07:00:00")),
        _message(5, body({"g": {"at": "yesterday"}})),
        _message(6, None),
        _message(7, "{" + body({})),
        _message(8, body({}, source=None)),
        _message(9, body({"n": True, "g": {"ok": "true"}})),
    ]
    judged = ingest.judge_messages(spark.createDataFrame(rows, RAW), registry)
    valid = {r.offset: r for r in ingest.valid_events(judged).collect()}
    dead = {r.offset: r.reject_reason for r in ingest.dead_letters(judged).collect()}
    assert dead == {2: "schema_missing", 3: "corrupted_payload", 4: "corrupted_payload", 5: "corrupted_payload", 7: "corrupted_payload", 8: "missing_source"}
    assert valid[0].fields == {"n": "12", "g.ok": "true", "g.at": "2024-01-01T00:00:00.000000Z", "d": "0.0", "extra.deep.x": "5", "list": "", "o": "[1,2]"}
    assert valid[0].event_time == dt.datetime(2024, 1, 1, 0, 0, 0, 500_000)
    assert valid[0].event_id == "t-0-0" and valid[1].source == "S" and valid[1].schema_version == "v1.0"
    assert valid[9].fields == {"n": "1", "g.ok": "true"}
    strict = ingest.dead_letters(ingest.judge_messages(spark.createDataFrame(rows, RAW), registry, "reject"))
    assert 0 in {r.offset for r in strict.collect()}


def test_candidate_walk_through(spark):
    """Five rules, one event: the complex rules and the one value hit are candidates, one rule holds."""
    conds = {
        1: [("country", "==", "VN")], 2: [("amount", ">", 10_000_000)], 3: [("mcc", "==", 5411), ("user_agent", "CONTAINS", "Chrome")],
        4: [("country", "==", "VN"), ("mcc", "==", 5411)], 5: [("country", "==", "TH")],
    }
    rules = [(f"R{i}", json.dumps({"rule_id": f"R{i}", "trigger_criteria": [{"source": "S", "version": "v1", "conditions": [[
        {"field": f, "op": o, "value": v} for f, o, v in group]]}], "condition_tree": {"type": "CONDITION", "expression": {"field": "S.v1.amount", "op": ">", "value": 0}}}))
        for i, group in conds.items()]
    predicates = candidates.trigger_predicates(flatten_rules(spark.createDataFrame(rules, "rule_id string, body string"))).persist()
    columns = spark.createDataFrame([("S", "v1", f, t) for f, t in (("country", "STRING"), ("amount", "LONG"), ("mcc", "INT"), ("user_agent", "STRING"))],
                                    "source string, version string, path string, type string")
    events = spark.createDataFrame([(1, "S", "v1", {"country": "TH", "amount": "5000000", "mcc": "9999", "user_agent": "Safari"}),
                                    (2, "S", "v1", {"country": "VN", "amount": "20000000", "mcc": "5411", "user_agent": "a Chrome b"})],
                                   "event_id bigint, source string, schema_version string, fields map<string,string>")
    marked, sigs = candidates.signatures(events, candidates.read_fields(predicates))
    index = candidates.rule_index(predicates, columns)
    looked_up = candidates.tokens(sigs, index)
    found = candidates.candidates(looked_up, sigs, index, candidates.complex_rules(predicates))
    groups = candidates.rule_groups(predicates, columns)
    ids = lambda rows: sorted((r.event_id, r.rule_id) for r in candidates.pairs(marked, sigs, rows).collect())
    assert [r for e, r in ids(found) if e == 1] == ["R2", "R3", "R5"]
    holds = ids(candidates.verify(found, sigs, groups))
    assert holds == [(1, "R5"), (2, "R1"), (2, "R2"), (2, "R3"), (2, "R4")]
    assert ids(candidates.verify(candidates.rare_two(looked_up, sigs, index, predicates), sigs, groups)) == holds


def test_dataset_predicates_as_index_tokens(spark):
    rule = {"rule_id": "R", "trigger_criteria": [{"source": "S", "version": "v1", "conditions": [[
        {"fields": ["a", "b"], "op": "IN_DATASET", "dataset_id": "d"}, {"field": "a", "op": "!=", "value": "z"}]]}],
        "condition_tree": {"type": "CONDITION", "expression": {"field": "S.v1.a", "op": "IS_NOT_NULL"}}}
    predicates = candidates.trigger_predicates(flatten_rules(spark.createDataFrame([("R", json.dumps(rule))], "rule_id string, body string")))
    sets = spark.createDataFrame([("d", "v2", ["A", "B_C"]), ("d", "v1", ["A_B", "C"])], "dataset_id string, dataset_version string, key array<string>")
    events = spark.createDataFrame([(1, "S", "v1", {"a": "A", "b": "B_C"}), (2, "S", "v1", {"a": "A_B", "b": "C"}), (3, "S", "v1", {"a": "A"})],
                                   "event_id bigint, source string, schema_version string, fields map<string,string>")
    columns = spark.createDataFrame([("S", "v1", "a", "STRING")], "source string, version string, path string, type string")
    marked, sigs = candidates.signatures(events, ["a", "b"])
    index = candidates.rule_index(predicates, columns)
    looked_up = candidates.tokens(sigs, index, sets)
    found = candidates.candidates(looked_up, sigs, index, candidates.complex_rules(predicates))
    held = candidates.verify(found, sigs, candidates.rule_groups(predicates, columns), looked_up)
    assert [r.event_id for r in candidates.pairs(marked, sigs, held).collect()] == [1]


def test_ambiguous_tuples_stay_apart(spark):
    sets = spark.createDataFrame([("d", "v1", ["A", "B_C"])], "dataset_id string, dataset_version string, key array<string>")
    rows = spark.createDataFrame([(1, "A", "B_C"), (2, "A_B", "C"), (3, "A", None)], "event_id bigint, x string, y string")
    spec = datasets.Membership("d", None, (F.col("x"), F.col("y")))
    assert {r.event_id: r.m for r in datasets.add_membership(rows, "m", spec, sets).collect()} == {1: True, 2: False, 3: False}
    assert [r.event_id for r in datasets.only_members(rows, spec, sets).collect()] == [1]


def test_a_rule_judges_only_events_after_it_was_loaded(spark):
    catalogue = Catalogue({("S", "v1"): {"n": ("INT", "dynamic_numeric")}})
    rule = {"rule_id": "X", "effective_from": "2024-01-01T00:01:00Z", "trigger_criteria": [{"source": "S", "version": "v1", "conditions": []}],
            "condition_tree": {"type": "CONDITION", "expression": "S.v1.n > 10"}}
    rows = [(i, "c", BASE + dt.timedelta(seconds=30 * i), "S", "v1", None if i == 3 else 15) for i in range(5)]
    line = spark.createDataFrame(rows, "event_id bigint, customer_id string, event_time timestamp, source string, schema_version string, `S.v1.n` int")
    line = line.withColumn("arrival_time", F.col("event_time"))
    out = compile_rules([parse_rule(rule)], catalogue).run(line).orderBy("event_id").collect()
    # The event without n is judged by the profile, which still holds the last value.
    assert [(r.event_id, r.status) for r in out] == [(2, "PASS"), (3, "PASS"), (4, "PASS")]


def test_spread_join_beyond_the_broadcast_limit(spark):
    from pulsegate.operators.joins import spread_join

    rows = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("k"))
    config = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("c"))
    got = [sorted(map(tuple, spread_join(rows, config, ["k"], ["id"], limit).collect())) for limit in (100, 5)]
    assert got[0] == got[1] and len(got[0]) == 50 * 4 + 50 * 3


def _trigger_rule(rule_id, *conditions):
    return (rule_id, json.dumps({"rule_id": rule_id, "trigger_criteria": [{"source": "S", "version": "v1", "conditions": [list(conditions)]}],
                                 "condition_tree": {"type": "CONDITION", "expression": {"field": "S.v1.k", "op": "IS_NOT_NULL"}}}))


def test_matched_rules_equal_compiled_ones_for_every_type(spark):
    """Literals in other spellings than the events', arithmetic sides and right fields."""
    types = {"d": "DOUBLE", "f": "FLOAT", "k": "INT", "n": "LONG", "s": "STRING", "b": "BOOLEAN", "ts": "TIMESTAMP"}
    cond = lambda field, op, value=None, **more: {"field": field, "op": op, "value": value, **more}
    groups = [
        [cond("d", "==", 100)], [cond("ts", "==", "2024-01-01T07:00:00+07:00")], [cond("f", "<=", 0.5)], [cond("k", "IN", [1, 2])], [cond("n", "BETWEEN", [5, 9])],
        [cond("b", "==", True)], [cond("s", "STARTS_WITH", "ab"), cond("k", "!=", 3)], [cond("ts", ">", "2023-12-31T23:59:59Z")], [cond("s", "IS_NULL")],
        [{"expr": "k * 2 + n", "op": ">", "value": 9}], [{"field": "d", "op": "<", "right_expr": "S.v1.n * 20"}], [{"field": "k", "op": "<", "right_field": "n"}],
        [{"field": "s", "function": "LENGTH", "op": "==", "value": 3}], [cond("k", "==", 5.5)],
    ]
    rules = [_trigger_rule(f"R{i}", *group) for i, group in enumerate(groups)]
    rows = [
        (1, {"d": "100.0", "f": "0.5", "k": "1", "n": "8", "s": "abc", "b": "true", "ts": "2024-01-01T00:00:00.000000Z"}),
        (2, {"d": "99.5", "f": "0.75", "k": "3", "n": "4", "b": "false", "ts": "2023-01-01T00:00:00.000000Z"}), (3, {"k": "5", "s": "ab"}), (4, {}),
    ]
    fields = [(e, "c", BASE, "S", "v1", values) for e, values in rows]
    events = spark.createDataFrame(fields, "event_id bigint, customer_id string, event_time timestamp, source string, schema_version string, fields map<string,string>")
    columns = spark.createDataFrame([("S", "v1", f, t) for f, t in types.items()], "source string, version string, path string, type string")
    predicates = candidates.trigger_predicates(flatten_rules(spark.createDataFrame(rules, "rule_id string, body string"))).persist()
    marked, sigs = candidates.signatures(events, candidates.read_fields(predicates))
    index = candidates.rule_index(predicates, columns)
    looked_up = candidates.tokens(sigs, index)
    catalogue = Catalogue({("S", "v1"): {f: (t, "dynamic_categorical") for f, t in types.items()}})
    compiled = compile_rules([parse_rule(body) for _, body in rules], catalogue)
    fired = compiled.judge(compiled.prepare(schemas.timeline(events, catalogue.schemas))).where("failed_condition is null or not startswith(failed_condition, 'trigger')")
    want = sorted((r.event_id, r.rule_id) for r in fired.collect())
    for found in (candidates.candidates(looked_up, sigs, index, candidates.complex_rules(predicates)), candidates.rare_two(looked_up, sigs, index, predicates)):
        held = candidates.verify(found, sigs, candidates.rule_groups(predicates, columns), texts=candidates.expressions(predicates))
        assert sorted((r.event_id, r.rule_id) for r in candidates.pairs(marked, sigs, held).collect()) == want
    assert {r for _, r in want} == {f"R{i}" for i in range(len(groups)) if i != 13}


def test_schemas_and_events_of_any_depth(spark):
    def nested(levels, leaf):
        for level in reversed(range(levels)):
            leaf = {f"l{level}": leaf}
        return leaf

    schema = {"metadata": {"source": "S", "schema_version": "v1"}, "structure": nested(9, {"type": "INT", "category": "dynamic_numeric"})}
    parsed = schemas.parse_schemas(spark.createDataFrame([(1, json.dumps(schema))], "offset bigint, value string"))
    path = ".".join(f"l{i}" for i in range(9))
    row = parsed.collect()[0]
    assert row.valid and [c.path for c in row.columns] == [path]
    event = {"metadata": {"customer_id": "c", "source": "S", "schema_version": "v1", "event_time": "2024-01-01T00:00:00Z"}, **nested(9, "7"), "u": nested(12, {"x{": "{"})}
    raw = [("t", 0, 0, dt.datetime(2024, 1, 1), [], bytearray(json.dumps(event).encode()))]
    messages = spark.createDataFrame(raw, "topic string, partition int, offset bigint, timestamp timestamp, headers array<struct<key:string,value:binary>>, value binary")
    valid = ingest.valid_events(ingest.judge_messages(messages, schemas.latest_schemas(parsed))).collect()
    assert valid[0].fields == {path: "7", "u." + ".".join(f"l{i}" for i in range(12)) + ".x{": "{"}
    assert valid[0].row_id == "t-0-0"


def test_a_value_meets_each_range_it_lies_in_once(spark):
    """Dyadic blocks of ranges against plain comparison: bounds, gaps, open and closed ends, NaN and infinities."""
    import random

    from pulsegate.operators import access

    rng = random.Random(3)
    ranges = []
    for i in range(200):
        low, high = sorted((rng.randrange(40) / 2, rng.randrange(40) / 2))
        ranges.append((i, low if i % 5 else None, i % 3 != 0, high if i % 7 else None, i % 2 == 0))
    cuts = sorted({b for _, low, _, high, _ in ranges for b in (low, high) if b is not None})
    values = [x / 4 for x in range(-4, 90)] + [float("inf"), float("-inf"), float("nan")]
    line = spark.createDataFrame([(cuts,)], "cuts array<double>")
    stated = spark.createDataFrame(ranges, "id int, low double, low_in boolean, high double, high_in boolean").crossJoin(line)
    first = F.when(F.col("low").isNull(), 0).otherwise(access._place(F.col("cuts"), F.col("low")) + F.when(F.col("low_in"), 0).otherwise(1))
    last = F.when(F.col("high").isNull(), 2 * F.size("cuts")).otherwise(access._place(F.col("cuts"), F.col("high")) - F.when(F.col("high_in"), 0).otherwise(1))
    blocks = stated.select("id", F.explode(access._blocks(first, last, access._levels(F.col("cuts")))).alias("block"))
    asked = spark.createDataFrame([(v,) for v in values], "v double").crossJoin(line)
    above = asked.select("v", F.explode(access._above(access._place(F.col("cuts"), F.col("v")), access._levels(F.col("cuts")))).alias("block"))
    got = sorted((repr(r.v), r.id) for r in above.join(blocks, "block").select("v", "id").collect())
    key = lambda v: (1, 0) if v != v else (0, v)  # noqa: E731  NaN lies above all
    want = sorted(
        (repr(v), i) for v in values for i, low, low_in, high, high_in in ranges
        if (low is None or key(v) > key(low) or (low_in and v == low)) and (high is None or key(v) < key(high) or (high_in and v == high))
    )
    # A line without a high bound holds what is above all bounds; SQL compares NaN so, and a half line below has an end.
    assert got == [w for w in want]


def test_matches_of_every_operator_equal_compiled_rules(spark, sf):
    from pulsegate.catalog import fixtures as fx
    from pulsegate.operators import candidates
    from pulsegate.plans.flatten import flatten_rules

    bodies = fx.rules_of_all_operators(spark, sf).where("int(substring(rule_id, 2)) <= 100")
    predicates = candidates.trigger_predicates(flatten_rules(bodies)).persist()
    columns = fx.field_rows(spark, sf)
    index = candidates.rule_index(predicates, columns)
    events = fx.field_maps(spark, sf).where("source = 'B'")
    marked, sigs = candidates.signatures(events, candidates.read_fields(predicates))
    sigs = sigs.persist()
    found = candidates.matches(candidates.tokens(sigs, index), sigs, index, predicates, columns)
    got = sorted(map(tuple, candidates.pairs(marked, sigs, found).collect()))
    rules = [parse_rule(r.body) for r in bodies.collect()]
    judged = compile_rules(rules, fx.catalogue()).run(fx.timeline(spark, sf).where("source = 'B'"))
    fired = judged.where("failed_condition is null or not startswith(failed_condition, 'trigger')")
    assert got == sorted((r.event_id, r.rule_id) for r in fired.select("event_id", "rule_id").collect()) and len(got) > 200


def test_sums_over_matching_rules_equal_sums_over_pairs(spark):
    """Groups that exclude each other, joint ranges, fractions, free groups, datasets, and rules that share groups."""
    from pulsegate.operators import access

    cond = lambda field, op, value=None, **more: {"field": field, "op": op, "value": value, **more}
    bodies = {
        "R1": [[cond("n", ">", 3), cond("n", "<=", 9)], [cond("k", "<", 4)]], "R2": [[cond("n", ">", 5), cond("n", "<", 7), cond("s", "STARTS_WITH", "a")], [cond("k", "<", 4)]],
        "R3": [[cond("d", "BETWEEN", [0.5, 2.25])], [cond("d", ">", 1.5)]], "R4": [[cond("s", "CONTAINS", "b")], [cond("k", "==", 2), cond("s", "==", "ab")]],
        "R5": [[cond("s", "CONTAINS", "b")], [cond("k", "==", 2), cond("s", "==", "ab")]], "R6": [], "R7": [[cond("n", ">", 9), cond("n", "<", 3)]],
        "R8": [[{"fields": ["s", "k"], "op": "IN_DATASET", "dataset_id": "risky"}], [cond("n", ">=", 8)]], "R9": [[cond("k", "IN", [1, 2, 3]), cond("n", "!=", 5)], [cond("s", "IS_NULL")]],
    }
    rules = [(name, json.dumps({"rule_id": name, "trigger_criteria": [{"source": "S", "version": "v1", "conditions": groups}],
                                "condition_tree": {"type": "CONDITION", "expression": {"field": "S.v1.k", "op": "IS_NOT_NULL"}}})) for name, groups in bodies.items()]
    rng = random.Random(5)
    rows = []
    for e in range(60):
        values = {"n": str(rng.randrange(12)), "k": str(rng.randrange(5)), "s": rng.choice(["ab", "b", "a", "c"]), "d": str(rng.randrange(12) / 4)}
        rows.append((e, "c", BASE, "S", "v1", {f: v for f, v in values.items() if rng.random() < 0.85}))
    events = spark.createDataFrame(rows, "event_id bigint, customer_id string, event_time timestamp, source string, schema_version string, fields map<string,string>")
    columns = spark.createDataFrame([("S", "v1", f, t) for f, t in {"n": "LONG", "k": "INT", "s": "STRING", "d": "DOUBLE"}.items()], "source string, version string, path string, type string")
    sets = spark.createDataFrame([("risky", "v1", ["ab", "1"]), ("risky", "v1", ["c", "3"])], "dataset_id string, dataset_version string, key array<string>")
    predicates = candidates.trigger_predicates(flatten_rules(spark.createDataFrame(rules, "rule_id string, body string"))).persist()
    marked, sigs = candidates.signatures(events, candidates.read_fields(predicates))
    index = candidates.rule_index(predicates, columns)
    looked_up = candidates.tokens(sigs, index, sets)
    found = candidates.verify(candidates.candidates(looked_up, sigs, index, candidates.complex_rules(predicates)), sigs, candidates.rule_groups(predicates, columns), looked_up)
    number = F.substring("rule_id", 2, 9).cast("bigint")
    want = candidates.per_event(marked, sigs, found, [F.count("*").alias("n"), F.sum(number).alias("ids")]).collect()
    summed = candidates.matched_sums(sigs, predicates, columns, {"n": F.lit(1), "ids": number}, looked_up)
    got = candidates.per_event(marked, sigs, summed, [F.sum("n").alias("n"), F.sum("ids").alias("ids")]).collect()
    key = lambda rows: sorted((r.event_id, r.n, r.ids) for r in rows)
    assert key(got) == key(want) and len({r.n for r in got}) > 4
    # Both sides of a range are one key, which decides the group.
    keys, axes, _ = access.access_index(predicates.where("rule_id = 'R1'"), index.where("rule_id = 'R1'"), columns)
    assert {r.whole for r in keys.select("whole").collect()} == {True} and "cuts" not in axes.columns


def test_one_rule_of_each_trigger_is_matched(spark):
    rules = [_trigger_rule(f"R{i}", {"field": "k", "op": "==", "value": i % 2}) for i in range(6)]
    predicates = candidates.trigger_predicates(flatten_rules(spark.createDataFrame(rules, "rule_id string, body string")))
    few, stands = candidates.alike(predicates)
    assert sorted(r.rule_id for r in few.collect()) == ["R0", "R1"]
    assert sorted(map(tuple, stands.collect())) == [(f"R{i}", f"R{i % 2}") for i in range(6)]


def test_a_schema_said_again_is_opened_once_and_in_force(spark):
    said = lambda kind: json.dumps({"metadata": {"source": "S", "schema_version": "v1"}, "structure": {"a": {"type": kind, "category": "dynamic_numeric"}}})
    messages = spark.createDataFrame([(1, said("INT")), (2, said("LONG")), (3, said("INT")), (4, said("MONEY"))], "offset bigint, value string")
    texts = schemas.newest_texts(messages)
    assert sorted(r.offset for r in texts.collect()) == [2, 3, 4]
    assert [c.type for r in schemas.latest_schemas(schemas.parse_schemas(texts)).collect() for c in r.columns] == ["INT"]
