"""Rule model, expressions, checks: driver-side logic and the worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegate.catalog import fixtures as fx
from pulsegate.functions import durations
from pulsegate.functions.arithmetic import ExpressionError, arithmetic, fields_of
from pulsegate.operators import mapping
from pulsegate.plans.compile import compile_rules
from pulsegate.plans.fields import Catalogue, UnknownField
from pulsegate.plans.flatten import flatten_rules
from pulsegate.plans.rules import RuleError, WindowCondition, parse_rule, text_condition


def _rule(tree, trigger=None):
    return {"rule_id": "r", "trigger_criteria": trigger or [{"source": "A", "version": "v2", "conditions": []}], "condition_tree": tree}


def test_durations():
    assert durations.micros("20m") == 20 * 60_000_000
    assert durations.micros("120s") == durations.micros("2m")
    for bad in ("", "5", "0m", "1w"):
        with pytest.raises(ValueError):
            durations.micros(bad)


def test_cells_are_floors_before_1970_too(spark):
    rows = spark.createDataFrame([(-1,), (0,), (9,), (10,)], "us bigint").select(durations.cell(F.col("us"), 10).alias("c"))
    assert [r.c for r in rows.collect()] == [-1, 0, 0, 1]


@pytest.mark.parametrize("text", ["a ** 2", "sqrt(a)", "a // b", "a < b", "a; b", "a if b else c", "'x'", "a & b", "__import__('os')"])
def test_other_than_plain_arithmetic_is_refused(text):
    with pytest.raises(ExpressionError):
        arithmetic(text, F.col)


def test_arithmetic(spark):
    row = spark.createDataFrame([(7, 2, 0)], "a bigint, b bigint, z bigint")
    got = row.select(*[arithmetic(t, F.col).alias(f"c{i}") for i, t in enumerate(["a / b", "a / z", "a % z", "-(a + b) * 1.5", "1e1 + a"])]).first()
    assert tuple(got) == (3.5, None, None, -13.5, 17.0)
    assert fields_of("(A.v2.x * 0.65 + A.v2.y * 0.35)") == ["A.v2.x", "A.v2.y"]


def test_text_spelling():
    assert text_condition("A.v2.tier NOT IN ['GOLD', 'BASIC']") == {"field": "A.v2.tier", "op": "NOT IN", "value": ["GOLD", "BASIC"]}
    assert text_condition("A.v2.vip == true")["value"] is True
    assert text_condition("(A.v2.x * 0.65 + A.v2.y * 0.35) >= 5.5")["expr"] == "(A.v2.x * 0.65 + A.v2.y * 0.35)"
    with pytest.raises(RuleError):
        text_condition("A.v2.x == other_field")


def test_spellings_meet_in_one_form():
    leaf = {"type": "CONDITION", "expression": {"field": "A.v2.x", "op": "==", "value": 1}}
    one = parse_rule(_rule(leaf, [{"source": ["A", "B"], "schema_version": "v2", "conditions": [{"field": "x", "op": "==", "value": 1}]}]))
    two = parse_rule(_rule(leaf, [{"source": s, "version": "v2", "conditions": [[{"field": "x", "op": "==", "value": 1}]]} for s in "AB"]))
    assert [(t.source, t.version, t.groups) for t in one.triggers] == [(t.source, t.version, t.groups) for t in two.triggers]
    window = parse_rule(_rule({"type": "CONDITION", "expression": {
        "op": "WINDOW_SUM", "field_name": "general_schema.spend", "metric_mapping": {"A": "x"}, "window_size": "10m", "slide_size": "1m", "compare_op": ">=", "compare_value": 5}}))
    leaf = window.tree.leaf
    assert isinstance(leaf, WindowCondition) and (leaf.agg, leaf.duration, leaf.slide, leaf.threshold) == ("sum", 600_000_000, 60_000_000, 5)


@pytest.mark.parametrize("tree", [{"type": "XOR", "children": []}, {"type": "AND", "children": []}, {"type": "CONDITION"},
                                  {"type": "CONDITION", "expression": {"field": "x"}}])
def test_broken_rules_are_refused(tree):
    with pytest.raises(RuleError):
        parse_rule(_rule(tree))


def test_field_names():
    catalogue = Catalogue({("A", "v2"): {"x": ("INT", "dynamic_numeric"), "g.y": ("FLOAT", "dynamic_numeric")}, ("B", "v1.0"): {"x": ("INT", "dynamic_numeric")}})
    assert catalogue.qualified("A.v2.g.y").column == "A.v2.g.y"
    assert catalogue.qualified("B.v1.0.x").version == "v1.0"
    assert catalogue.qualified("A.x").column == "A.v2.x"
    assert catalogue.local("A", "v2", "metadata.event_time").column == "event_time"
    with pytest.raises(UnknownField):
        catalogue.qualified("A.v2.nope")


def test_rule_rewriting_example():
    mappers = [
        {"source": "CPM", "alias": "trans_amount", "raw_path": "request.content.amount"},
        {"source": "CPM", "alias": "service_type", "raw_path": "request.content.serviceCode"},
        {"source": "EVT", "alias": "app_version", "raw_path": "client_info.app_ver"},
        {"source": "EVT", "alias": "trans_amount", "raw_path": "event_value.trans_money"},
    ]
    body = {
        "trigger_criteria": [{"source": "CPM", "conditions": [[{"field": "CPM.service_type", "op": "==", "value": "TOPUP"}]]},
                             {"source": "EVT", "conditions": [[{"field": "EVT.app_version", "op": "==", "value": "2.0.0"}, {"field": "EVT.nope", "op": "==", "value": 1}]]}],
        "condition_tree": {"type": "CONDITION", "expression": {"op": "WINDOW_SUM", "field_name": "general_schema.trans_amount"}},
    }
    new, unknown = mapping.rewrite_body(body, mappers)
    assert new["trigger_criteria"][0]["conditions"][0][0]["field"] == "CPM.request.content.serviceCode"
    assert new["trigger_criteria"][1]["conditions"][0][0]["field"] == "EVT.client_info.app_ver"
    assert new["condition_tree"]["expression"]["metric_mapping"] == {"CPM": "request.content.amount", "EVT": "event_value.trans_money"}
    assert unknown == ["EVT.nope"]


def test_rule_files(spark, tmp_path):
    from pulsegate.sources.events import rule_file

    rules = [_rule({"type": "CONDITION", "expression": f"A.v2.x == {i}"}) | {"rule_id": f"r{i}"} for i in range(3)]
    (tmp_path / "many.json").write_text(json.dumps(rules, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(rules[0]))
    many = rule_file(spark, str(tmp_path / "many.json"))
    assert [r.rule_id for r in many.orderBy("position").collect()] == ["r0", "r1", "r2"]
    assert rule_file(spark, str(tmp_path / "one.json")).count() == 1
    leaves = flatten_rules(many.drop("position")).where("part = 'tree'").collect()
    assert sorted((r.rule_id, r.field, r.op, r.value) for r in leaves) == [(f"r{i}", "A.v2.x", "==", str(i)) for i in range(3)]


def test_unreadable_rule_is_one_error_row(spark):
    rows = flatten_rules(spark.createDataFrame([("a", "{"), ("b", "{}")], "rule_id string, body string")).collect()
    assert sorted((r.rule_id, r.part) for r in rows) == [("a", "error"), ("b", "error")]


def test_rewriting_is_one_pass_and_reads_text_conditions():
    mappers = [{"source": "S", "alias": "amount2", "raw_path": "amount"}, {"source": "S", "alias": "amount", "raw_path": "amt.total"}, {"source": "S", "alias": "tier", "raw_path": "c.tier"}]
    body = {
        "trigger_criteria": [{"source": "S", "conditions": [["S.tier == 'X'", "S.unknown == 1"]]}],
        "condition_tree": {"type": "CONDITION", "expression": {"expr": "S.amount2 + S.amount", "op": ">", "value": 1}},
    }
    new, unknown = mapping.rewrite_body(body, mappers)
    assert new["condition_tree"]["expression"]["expr"] == "S.amount + S.amt.total"
    assert new["trigger_criteria"][0]["conditions"][0][0] == {"field": "S.c.tier", "op": "==", "value": "X"} and unknown == ["S.unknown"]


def test_checks_find_each_fault_and_pass_sound_rules(spark):
    from pulsegate.plans.checks import violations

    columns = spark.createDataFrame(
        [(s, "v2", p, t, c) for s in ("A", "B") for p, (t, c) in fx.EVENT_FIELDS.items()] + [("C", "v1", p, t, c) for p, (t, c) in fx.PROFILE_FIELDS.items()],
        "source string, version string, path string, type string, category string",
    )
    sound = spark.createDataFrame([(r["rule_id"], json.dumps(r)) for r in fx.rules_small()], "rule_id string, body string")
    found = violations(flatten_rules(sound), columns).where("not startswith(problem, 'warning')").collect()
    assert found == []

    def rule(name, tree, conditions=()):
        return (name, json.dumps({"rule_id": name, "trigger_criteria": [{"source": "B", "schema_version": "v2", "conditions": list(conditions)}], "condition_tree": tree}))

    leaf = lambda **e: {"type": "CONDITION", "expression": e}
    fine = leaf(field="B.v2.k", op=">", value=1)
    step = {"source": "B", "filter": [{"field": "event_type", "op": "==", "value": "view"}]}
    faults = [
        rule("expr", leaf(expr="B.v2.k + B.v2.nope", op=">", value=1)), rule("right", leaf(field="B.v2.k", op=">", right_field="B.v2.nope")),
        rule("key", leaf(op="IS_FIRST_ARRIVAL", key_fields=["nope"])), rule("literal", leaf(field="B.v2.k", op="==", value="abc")),
        rule("trigger", fine, [{"field": "nope", "op": "==", "value": 1}]), rule("operator", leaf(field="B.v2.event_type", op=">", value="x")),
        rule("between", leaf(field="B.v2.k", op="BETWEEN", value=[1])), rule("list", leaf(field="B.v2.k", op="IN", value=["a"])),
        rule("dataset", leaf(fields=["B.v2.k", "B.v2.nope"], op="IN_DATASET", dataset_id="d")),
        rule("sequence", {"type": "SEQUENCE", "pattern": "FOLLOWED_BY", "within": "1h", "join_keys": [{"left_field": "nope", "right_field": "session_id"}], "first": step, "second": step}),
        rule("filter", {"type": "SEQUENCE", "pattern": "FOLLOWED_BY", "within": "1h", "join_keys": [], "first": step, "second": {"source": "B", "filter": [{"field": "nope", "op": "==", "value": 1}]}}),
    ]
    bad = violations(flatten_rules(spark.createDataFrame(faults, "rule_id string, body string")), columns)
    assert {r.rule_id for r in bad.where("not startswith(problem, 'warning')").collect()} == {name for name, _ in faults}


def test_a_bad_rule_is_refused_alone(spark):
    good = _rule({"type": "CONDITION", "expression": "A.v2.k == 1"}) | {"rule_id": "good"}
    bad = _rule({"type": "CONDITION", "expression": "A.v2.k == 'abc'"}) | {"rule_id": "bad"}
    compiled = compile_rules([parse_rule(good), parse_rule(bad)], fx.catalogue(), on_error="refuse")
    assert set(compiled.refused) == {"bad"} and len(compiled._plans) == 1


def test_equal_local_names_of_two_sources_are_two_metrics(spark):
    rules = [
        parse_rule({"rule_id": s, "trigger_criteria": [{"source": s, "schema_version": "v2"}], "condition_tree": fx._window("amount_cents", "sum", "1h", "1h", [], ">", 1)})
        for s in ("A", "B")
    ]
    assert len(compile_rules(rules, fx.catalogue(), bucket=3_600_000_000).metrics) == 2


def test_a_load_counts_as_a_whole(spark, tmp_path):
    from pulsegate.sources import sinks

    path = str(tmp_path / "rules")
    assert sinks.read_load(spark, path) is None
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "rule_id string")
    sinks.write_load(rows("a"), rows("a_v1"), path, 1)
    # A load that stops after its history leaves the older one in force.
    rows("b_v1").write.parquet(f"{path}/load=2/history")
    active, history, load = sinks.read_load(spark, path)
    assert (load, [r.rule_id for r in active.collect()], [r.rule_id for r in history.collect()]) == (1, ["a"], ["a_v1"])
    sinks.write_load(rows("a", "b"), rows("b_v1"), path, 2)
    active, history, load = sinks.read_load(spark, path)
    assert load == 2 and active.count() == 2 and sorted(r.rule_id for r in history.collect()) == ["a_v1", "b_v1"]
