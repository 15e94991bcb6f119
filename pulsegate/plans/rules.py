"""The rule model: one normal form for the spellings rules come in.

A rule has a trigger (source, version, OR of AND groups) and a condition tree.
Conditions come as objects or as text, filters as a list or one object,
conditions as a two- or one-dimensional list, the version under either name, the
source as one name or a list; all are brought to the classes below.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pulsegate.functions.arithmetic import fields_of
from pulsegate.functions.durations import micros

AGGREGATES = ("sum", "count", "avg", "min", "max")
_TEXT = re.compile(r"(?P<left>.+?)\s*(?P<op>\bNOT\s+IN\b|\bIN\b|\bBETWEEN\b|==|!=|>=|<=|>|<)\s*(?P<right>.+)", re.DOTALL)
_PATH = re.compile(r"[A-Za-z_]\w*(?:\.\w+)*")


class RuleError(ValueError):
    """A rule that cannot be brought to the normal form."""


@dataclass(frozen=True)
class Condition:
    """One comparison. Exactly one of field, expr, fields is the left side."""

    op: str
    field: str | None = None
    expr: str | None = None
    fields: tuple[str, ...] = ()
    length: bool = False
    value: Any = None
    right_field: str | None = None
    right_expr: str | None = None
    dataset: tuple[str, str | None] | None = None

    def paths(self) -> list[str]:
        left = [self.field] if self.field else fields_of(self.expr) if self.expr else list(self.fields)
        right = [self.right_field] if self.right_field else fields_of(self.right_expr) if self.right_expr else []
        return left + right


@dataclass(frozen=True)
class WindowCondition:
    """Windowed aggregate compared with a constant. Widths in microseconds."""

    agg: str
    op: str
    threshold: float
    duration: int
    slide: int
    field: str | None = None
    expr: str | None = None
    filter: tuple[Condition, ...] = ()
    filter_given: bool = True
    mapping: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Arrival:
    """First arrival of a composite key; the key is held for `ttl` microseconds."""

    key_fields: tuple[str, ...]
    ttl: int | None
    order_by: str = "processing_time"


@dataclass(frozen=True)
class Step:
    source: str
    filter: tuple[Condition, ...]
    version: str | None = None


@dataclass(frozen=True)
class Sequence:
    """A then B (or no B) within a time limit, on equal join keys."""

    pattern: str
    within: int
    keys: tuple[tuple[str, str], ...]
    first: Step
    second: Step


@dataclass(frozen=True)
class Node:
    """AND/OR over children, or a leaf."""

    kind: str
    path: str
    children: tuple["Node", ...] = ()
    leaf: Condition | WindowCondition | Arrival | Sequence | None = None

    def leaves(self) -> list["Node"]:
        return [self] if self.leaf is not None else [n for child in self.children for n in child.leaves()]


@dataclass(frozen=True)
class Trigger:
    source: str
    version: str
    groups: tuple[tuple[Condition, ...], ...]
    key_field: str | None = None
    path: str = "trigger.0"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    triggers: tuple[Trigger, ...]
    tree: Node
    version: int = 0
    mapper_ids: tuple[str, ...] = ()
    effective_from: Any = None
    effective_to: Any = None
    body: dict = field(default_factory=dict, compare=False, hash=False, repr=False)


def _freeze(value: Any) -> Any:
    return tuple(_freeze(v) for v in value) if isinstance(value, list) else value


def text_condition(text: str) -> dict:
    """Object form of a text condition such as ``A.v2.tier IN ['GOLD', 'PLATINUM']``."""
    match = _TEXT.fullmatch(text.strip())
    if not match:
        raise RuleError(f"cannot read condition {text!r}")
    left, right = match["left"].strip(), match["right"].strip()
    lowered = {"true": True, "false": False, "null": None}
    try:
        value = lowered[right.lower()] if right.lower() in lowered else ast.literal_eval(right)
    except (ValueError, SyntaxError) as error:
        raise RuleError(f"right side must be a literal: {text!r}") from error
    side = {"field": left} if _PATH.fullmatch(left) else {"expr": left}
    return {**side, "op": " ".join(match["op"].upper().split()), "value": value}


def condition(raw: dict | str) -> Condition:
    raw = text_condition(raw) if isinstance(raw, str) else raw
    op = " ".join(str(raw.get("op", "")).upper().split())
    if not op:
        raise RuleError(f"condition without op: {raw!r}")
    fields = tuple(raw.get("fields") or ())
    if op == "IN_DATASET":
        fields = fields or ((raw["field"],) if raw.get("field") else ())
        if not fields or not raw.get("dataset_id"):
            raise RuleError("IN_DATASET needs fields and dataset_id")
        return Condition(op, fields=fields, dataset=(raw["dataset_id"], raw.get("dataset_version")))
    if not raw.get("field") and not raw.get("expr"):
        raise RuleError(f"condition without left side: {raw!r}")
    return Condition(
        op,
        field=raw.get("field"),
        expr=None if raw.get("field") else raw.get("expr"),
        length=str(raw.get("function", "")).upper() == "LENGTH",
        value=_freeze(raw.get("value")),
        right_field=raw.get("right_field"),
        right_expr=raw.get("right_expr"),
    )


def _filter(raw: Any) -> tuple[Condition, ...]:
    items = [] if raw is None else raw if isinstance(raw, list) else [raw]
    return tuple(condition(item) for item in items)


def _expression(raw: dict | str) -> Condition | WindowCondition | Arrival:
    if isinstance(raw, str):
        return condition(raw)
    op = str(raw.get("op", "")).upper()
    if op == "IS_FIRST_ARRIVAL":
        ttl = raw.get("ttl")
        return Arrival(tuple(raw["key_fields"]), micros(ttl) if ttl else None, raw.get("order_by", "processing_time"))
    if op.startswith("WINDOW_"):
        duration = micros(raw["window_size"])
        slide = micros(raw["slide_size"]) if raw.get("slide_size") else duration
        agg, test, threshold = op.removeprefix("WINDOW_").lower(), raw["compare_op"], raw["compare_value"]
        left = raw.get("field_name") or raw.get("field")
    elif "agg" in raw or "window" in raw:
        window = raw["window"]
        duration = micros(window["duration"])
        slide = micros(window["slide"]) if window.get("type") != "tumbling" and window.get("slide") else duration
        agg, test, threshold = str(raw["agg"]).lower(), raw["op"], raw["threshold"]
        left = raw.get("field")
    else:
        return condition(raw)
    if agg not in AGGREGATES:
        raise RuleError(f"unknown aggregate {agg!r}")
    return WindowCondition(
        agg, test, threshold, duration, slide,
        field=left,
        expr=None if left else raw.get("expr"),
        filter=_filter(raw.get("filter")),
        filter_given=raw.get("filter") is not None,
        mapping=tuple(sorted((raw.get("metric_mapping") or {}).items())),
    )


def _step(raw: dict) -> Step:
    return Step(raw["source"], _filter(raw.get("filter")), raw.get("schema_version") or raw.get("version"))


def _node(raw: dict, path: str) -> Node:
    kind = str(raw.get("type", "")).upper()
    if kind in ("AND", "OR"):
        children = tuple(_node(child, f"{path}.{i}") for i, child in enumerate(raw.get("children") or []))
        if not children:
            raise RuleError(f"{kind} node without children at {path}")
        return Node(kind, path, children)
    if kind == "CONDITION":
        return Node(kind, path, leaf=_expression(raw["expression"]))
    if kind == "SEQUENCE":
        pattern = str(raw["pattern"]).upper()
        if pattern not in ("FOLLOWED_BY", "NOT_FOLLOWED_BY"):
            raise RuleError(f"unknown pattern {pattern!r}")
        keys = tuple(
            (k["left_field"].removeprefix("first."), k["right_field"].removeprefix("second."))
            for k in raw.get("join_keys") or []
        )
        return Node(kind, path, leaf=Sequence(pattern, micros(raw["within"]), keys, _step(raw["first"]), _step(raw["second"])))
    raise RuleError(f"unknown node type {raw.get('type')!r} at {path}")


def _triggers(raw: list[dict]) -> tuple[Trigger, ...]:
    out = []
    for i, item in enumerate(raw):
        groups = item.get("conditions") or []
        if groups and not isinstance(groups[0], list):
            groups = [groups]
        sources = item["source"] if isinstance(item["source"], list) else [item["source"]]
        version = item.get("schema_version") or item.get("version") or "v1.0"
        parsed = tuple(tuple(condition(c) for c in group) for group in groups)
        out += [Trigger(s, version, parsed, item.get("key_field"), f"trigger.{i}") for s in sources]
    return tuple(out)


def parse_rule(body: dict | str) -> Rule:
    """Normal form of one rule; raises RuleError when a required part is missing or unknown."""
    raw = json.loads(body) if isinstance(body, str) else body
    missing = [k for k in ("rule_id", "trigger_criteria", "condition_tree") if not raw.get(k)]
    if missing:
        raise RuleError(f"rule lacks {', '.join(missing)}")
    try:
        return Rule(
            str(raw["rule_id"]),
            _triggers(raw["trigger_criteria"]),
            _node(raw["condition_tree"], "tree"),
            int(raw.get("rule_version") or 0),
            tuple(raw.get("mapper_ids") or ()),
            raw.get("effective_from"),
            raw.get("effective_to"),
            raw,
        )
    except (KeyError, TypeError) as error:
        raise RuleError(f"rule {raw.get('rule_id')!r}: bad or missing {error}") from error
