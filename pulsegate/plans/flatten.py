"""Rule tables flattened to rows: one per trigger predicate and per tree leaf.

The tree of a rule is recursive, which a Spark schema cannot be, so the body stays
JSON text and a table function opens it, distributed over the rule table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.functions.arithmetic import fields_of
from pulsegate.plans.rules import Arrival, Condition, Node, RuleError, Sequence, Trigger, WindowCondition, parse_rule

LEAF = (
    "part string, source string, version string, node_path string, parent_op string, group_id string, pred_id int,"
    " kind string, field string, fields array<string>, expr string, is_length boolean, op string, value string,"
    " right_field string, right_expr string, agg string, duration_us bigint, slide_us bigint, filter_fields array<string>,"
    " filter_given boolean, dataset_id string, dataset_version string, error string, reads array<array<string>>"
)
NAMES = [part.split()[0] for part in LEAF.split(", ")]


def _row(**given) -> tuple:
    return tuple(given.get(name) for name in NAMES)


def _condition(cond: Condition) -> dict:
    value = None if cond.value is None else json.dumps(cond.value, ensure_ascii=False) if not isinstance(cond.value, str) else cond.value
    dataset, version = cond.dataset or (None, None)
    return {
        "kind": "condition", "field": cond.field, "fields": list(cond.fields) or None, "expr": cond.expr,
        "is_length": cond.length, "op": cond.op, "value": value, "right_field": cond.right_field,
        "right_expr": cond.right_expr, "dataset_id": dataset, "dataset_version": version,
    }


def _local(trigger: Trigger, path: str) -> list[str]:
    """Names that a path of one source and version may stand for."""
    prefix = f"{trigger.source}.{trigger.version}."
    bare = path.removeprefix(prefix).removeprefix(f"{trigger.source}.")
    return [prefix + bare]


def _tree_reads(leaf, triggers: tuple[Trigger, ...]) -> list[list[str]]:
    """For each field that a tree leaf reads, the names it may stand for: as it is, or under a trigger's source."""
    if isinstance(leaf, Arrival):
        return [_local(t, path) for path in leaf.key_fields for t in triggers]
    if isinstance(leaf, Sequence):
        out = []
        for step, side in ((leaf.first, 0), (leaf.second, 1)):
            version = step.version or next((t.version for t in triggers if t.source == step.source), None)
            paths = [pair[side] for pair in leaf.keys] + [p for c in step.filter for p in c.paths()]
            out += [_local(Trigger(step.source, version, ()), p) if version else [f"{step.source}.{p.removeprefix(step.source + '.')}"] for p in paths]
        return out
    if isinstance(leaf, WindowCondition):
        paths = [f"{source}.{path}" for source, path in leaf.mapping] or ([leaf.field] if leaf.field else fields_of(leaf.expr))
    else:
        paths = leaf.paths()
    return [[p, *_local(triggers[0], p)] for p in paths]


def _leaf(node: Node, parent: str | None, triggers: tuple[Trigger, ...]) -> tuple:
    leaf = node.leaf
    if isinstance(leaf, WindowCondition):
        given = {
            "kind": "window", "field": leaf.field, "expr": leaf.expr, "op": leaf.op, "value": json.dumps(leaf.threshold),
            "agg": leaf.agg, "duration_us": leaf.duration, "slide_us": leaf.slide,
            "filter_fields": [p for c in leaf.filter for p in c.paths()], "fields": fields_of(leaf.expr) if leaf.expr and not leaf.field else None, "filter_given": leaf.filter_given,
        }
    elif isinstance(leaf, Arrival):
        given = {"kind": "arrival", "fields": list(leaf.key_fields), "op": "IS_FIRST_ARRIVAL", "duration_us": leaf.ttl}
    elif isinstance(leaf, Sequence):
        given = {"kind": "sequence", "op": leaf.pattern, "duration_us": leaf.within, "fields": [a for a, _ in leaf.keys]}
    else:
        given = _condition(leaf)
    return _row(part="tree", node_path=node.path, parent_op=parent, reads=_tree_reads(leaf, triggers), **given)


def _walk(node: Node, parent: str | None, triggers: tuple[Trigger, ...]) -> Iterator[tuple]:
    if node.leaf is not None:
        yield _leaf(node, parent, triggers)
    for child in node.children:
        yield from _walk(child, node.kind, triggers)


class FlattenRule:
    """Table function body: rule JSON text to leaf rows, or one row with the error."""

    def eval(self, body: str):
        try:
            rule = parse_rule(body)
        except (RuleError, ValueError) as error:
            yield _row(part="error", error=str(error))
            return
        for t, trigger in enumerate(rule.triggers):
            here = {"part": "trigger", "source": trigger.source, "version": trigger.version, "parent_op": "AND"}
            if not trigger.groups:
                yield _row(**here, kind="always", node_path=trigger.path, group_id=f"{t}.0", pred_id=0)
            for g, group in enumerate(trigger.groups):
                for c, cond in enumerate(group):
                    yield _row(**here, node_path=f"{trigger.path}.{g}.{c}", group_id=f"{t}.{g}", pred_id=c, reads=[_local(trigger, p) for p in cond.paths()], **_condition(cond))
        yield from _walk(rule.tree, None, rule.triggers)


def flatten_rules(rules: DataFrame, body: str = "body") -> DataFrame:
    """Columns of `rules` except the body, plus the leaf columns.

    Rule files are few and small, but opening a body is work and what is joined with the
    leaves is large, so the rules are spread over all cores first.
    """
    spark: SparkSession = rules.sparkSession
    rules = rules.repartition(spark.sparkContext.defaultParallelism, "rule_id")
    spark.udtf.register("flatten_rule", F.udtf(FlattenRule, returnType=LEAF))
    keep = [c for c in rules.columns if c != body]
    columns = ", ".join([*(f"r.`{c}`" for c in keep), "f.*"])
    return spark.sql(f"SELECT {columns} FROM {{rules}} r, LATERAL flatten_rule(r.`{body}`) f", rules=rules)
