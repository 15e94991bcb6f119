"""Rules judged as data give what they give as Columns."""

import datetime as dt
import math

import pytest

from pulsegate.catalog import fixtures as fx
from pulsegate.plans.compile import compile_rules
from pulsegate.plans.fields import Catalogue
from pulsegate.plans.rules import parse_rule

HOUR = 3_600_000_000
UTC = dt.timezone.utc


def _set(rows):
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("passed_only", [False, True])
def test_all_leaf_kinds(spark, sf, passed_only):
    rules = [parse_rule(r) for r in fx.rules_small()]
    line, sets = fx.timeline(spark, sf), fx.dataset_rows(spark, sf)
    got = [
        _set(compile_rules(rules, fx.catalogue(), bucket=HOUR, as_rows=form).run(line, sets, keep=("arrival_time",), passed_only=passed_only))
        for form in (False, True)
    ]
    assert got[0] == got[1] and len(got[0]) > 500


FIELDS = {"i": ("INT", "dynamic_numeric"), "l": ("LONG", "dynamic_numeric"), "f": ("FLOAT", "dynamic_numeric"), "d": ("DOUBLE", "dynamic_numeric"),
          "s": ("STRING", "dynamic_categorical"), "b": ("BOOLEAN", "dynamic_categorical"), "t": ("TIMESTAMP", "dynamic_categorical"), "o": ("OBJECT", "dynamic_categorical")}


def _odd(spark):
    """Missing values, NaN and infinities, signed zeros, large integers, texts beyond ASCII, equal instants."""
    base = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [
        (None,) * 8, (1, 2**53 + 1, 0.1, math.nan, "", True, base, "{}"), (-1, 2**53, -0.0, math.inf, "Straße", False, base + dt.timedelta(microseconds=1), None),
        (7, -(2**63), math.nan, -math.inf, "stra", None, None, "[]"), (0, 0, 0.0, 0.0, "\U0001f600z", True, base, "x"), (2**31 - 1, 2**63 - 1, 1.5, 1.5, "ab", False, base, "y"),
    ]
    given = [(i, "c", base, "A" if i % 3 else "B", "v1", *row) for i, row in enumerate(rows * 3)]
    line = spark.createDataFrame(given, "event_id long, customer_id string, event_time timestamp, source string, schema_version string, i int, l bigint, f float, d double, s string, b boolean, t timestamp, o string")
    return line.select("event_id", "customer_id", "event_time", line.event_time.alias("arrival_time"), "source", "schema_version", *[line[c].alias(f"A.v1.{c}") for c in FIELDS])


def _conditions():
    for field, value in (("i", 0), ("l", 2**53), ("f", 0.1), ("d", 0.0), ("d", 1), ("t", "2024-01-01T00:00:00Z")):
        yield from ({"field": field, "op": op, "value": value} for op in ("==", "!=", ">", "<", ">=", "<="))
        yield {"field": field, "op": "BETWEEN", "value": [value, value]}
    yield from ({"field": "s", "op": op, "value": "stra"} for op in ("==", "!=", "STARTS_WITH", "NOT_STARTS_WITH", "ENDS_WITH", "NOT_ENDS_WITH", "CONTAINS", "NOT_CONTAINS"))
    yield from ({"field": "s", "op": op, "value": ["ab", "", "Straße"]} for op in ("IN", "NOT IN"))
    yield from ({"field": "i", "op": op, "value": [0, 7]} for op in ("IN", "NOT IN"))
    yield from ({"field": f, "op": op} for f in FIELDS for op in ("IS_NULL", "IS_NOT_NULL"))
    yield from ({"field": "b", "op": op, "value": v} for op in ("==", "!=") for v in (True, False))
    yield from ({"field": a, "op": op, "right_field": b} for a, b in (("i", "l"), ("f", "d"), ("d", "l"), ("s", "s"), ("t", "t"), ("b", "b")) for op in ("==", "!=", "<", ">="))
    yield from ({"expr": "d / i", "op": op, "value": 0} for op in ("==", ">", "<="))
    yield from ({"expr": "l % 10", "op": op, "right_expr": "i * 2"} for op in ("==", ">", "<="))
    yield {"field": "s", "function": "LENGTH", "op": ">", "value": 2}


def test_predicates_on_odd_values(spark):
    """Each operator alone, as trigger and in the tree under AND and OR."""
    given = list(_conditions())
    leaf = lambda c: {"type": "CONDITION", "expression": c}
    bodies = []
    for n, c in enumerate(given):
        other = given[(n * 7 + 3) % len(given)]
        bodies.append({"rule_id": f"r{n}", "trigger_criteria": [{"source": "A", "schema_version": "v1", "conditions": [[c], [other, c]]}, {"source": "Z", "schema_version": "v1"}],
                       "condition_tree": {"type": "AND" if n % 2 else "OR", "children": [leaf(other), leaf(c), {"type": "OR", "children": [leaf(given[n - 1]), leaf(other)]}]}})
    catalogue = Catalogue({("A", "v1"): FIELDS, ("Z", "v1"): {}})
    rules = [parse_rule(b) for b in bodies]
    line = _odd(spark)
    columns, rows = (compile_rules(rules, catalogue, as_rows=form) for form in (False, True))
    assert compile_rules(rules, catalogue).as_rows
    assert _set(columns.run(line)) == _set(rows.run(line))
    assert _set(columns.run(line, passed_only=True)) == _set(rows.run(line, passed_only=True))


@pytest.mark.parametrize("as_rows", [False, True])
def test_rules_judge_what_arrives_while_they_are_in_force(spark, as_rows):
    at = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=UTC)
    line = spark.createDataFrame(
        [(1, "c", at(9), at(11), "A", "v1"), (2, "c", at(12), at(9), "A", "v1"), (3, "c", at(8), at(10), "A", "v1"), (4, "c", at(8), at(13), "A", "v1")],
        "event_id long, customer_id string, event_time timestamp, arrival_time timestamp, source string, schema_version string")
    line = line.selectExpr("*", "'x' AS `A.v1.s`")
    body = {"rule_id": "r", "effective_from": "2024-01-01T10:00:00Z", "effective_to": "2024-01-01T13:00:00Z", "trigger_criteria": [{"source": "A", "version": "v1"}],
            "condition_tree": {"type": "CONDITION", "expression": {"field": "A.v1.s", "op": "IS_NOT_NULL"}}}
    compiled = compile_rules([parse_rule(body)], Catalogue({("A", "v1"): FIELDS}), as_rows=as_rows)
    assert sorted(r.event_id for r in compiled.run(line).collect()) == [1, 3]
    with pytest.raises(ValueError):
        compiled.run(line.drop("arrival_time"))


def test_the_plan_does_not_grow_with_the_rules(spark, sf):
    def size(count):
        bodies = [{"rule_id": f"C{i}", "trigger_criteria": [{"source": "B", "schema_version": "v2", "conditions": [[{"field": "k", "op": ">", "value": i}]]}],
                   "condition_tree": {"type": "CONDITION", "expression": {"field": "B.v2.amount_cents", "op": ">", "value": i}}} for i in range(count)]
        judged = compile_rules([parse_rule(b) for b in bodies], fx.catalogue(), bucket=HOUR, as_rows=True).run(fx.timeline(spark, sf))
        return len(judged._jdf.queryExecution().optimizedPlan().toString())

    assert size(300) < 1.1 * size(30)
