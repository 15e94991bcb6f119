"""Rules to Columns: one compilation per rule set version, evaluated over whole tables.

The compiler reads the normal form of the rules and gives
- predicate Columns, shared between rules that ask the same question,
- the state the rules need: latest profile attributes, window metrics (rules with
  the same field, filter and window share one), dataset membership, sequences and
  first arrivals.

`CompiledRules.prepare` adds that state to a timeline, `judge` gives one PASS or
FAIL row per event and rule with the failing conditions. There are two forms of judging, with
the same results: a few rules are Columns, their verdicts SQL text over the shared predicates;
many rules are data (plans.rule_rows), so that the plan does not grow with their number.

Rows are told apart by `row_id` where the timeline has one (ingest gives topic, partition
and offset): payload ids may repeat between sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.arithmetic import arithmetic, fields_of
from pulsegate.functions.durations import event_us
from pulsegate.functions.predicates import SPARK_TYPES, compare, moment_us, predicate, typed
from pulsegate.operators import arrivals, datasets, sequences
from pulsegate.operators.state import Metric, add_state
from pulsegate.plans import rule_rows
from pulsegate.plans.fields import Catalogue, Field
from pulsegate.plans.rules import Arrival, Condition, Node, Rule, Sequence, Trigger, WindowCondition

EVENT_COLUMNS = ("event_id", "customer_id", "event_time", "source", "schema_version")
# Columns that go with the rows where the timeline has them.
EXTRA_COLUMNS = ("row_id", "arrival_time")
# Above this many rules they are judged as data.
MANY_RULES = 8


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mark(kind: str, key: str) -> str:
    """Name of a sequence or arrival mark, from what is asked and not from its place in the rule set."""
    return f"{kind}:{hashlib.sha256(key.encode()).hexdigest()[:16]}"


def identity(rows: DataFrame) -> str:
    return "row_id" if "row_id" in rows.columns else "event_id"


@dataclass
class _Leaf:
    path: str
    column: str


@dataclass
class Test:
    """One shared predicate: `left op value`, `left op right`, or a boolean Column of its own.

    `left` and `right` name sides (Columns that predicates compare); `column` builds the whole
    predicate as a Column, which judging many rules never asks for.
    """

    build: Callable[[], Column]
    op: str | None = None
    left: str | None = None
    value: Any = None
    right: str | None = None
    _column: Column | None = field(default=None, repr=False)

    @property
    def column(self) -> Column:
        if self._column is None:
            self._column = self.build()
        return self._column


class CompiledRules:
    """A rule set compiled against a field catalogue."""

    def __init__(self, rules: list[Rule], catalogue: Catalogue, bucket: int, include_current: bool = False,
                 arrival_column: str = "arrival_time", on_error: str = "raise", as_rows: bool | None = None):
        """on_error: 'raise', or 'refuse' to leave out rules that cannot be compiled and list them in `refused`.

        as_rows: judge the rules as data or as Columns; by default as data above MANY_RULES.
        """
        self.rules = rules
        self.catalogue = catalogue
        self.bucket = bucket
        self.include_current = include_current
        self.arrival_column = arrival_column
        self.as_rows = len(rules) > MANY_RULES if as_rows is None else as_rows
        self.refused: dict[str, str] = {}
        self.metrics: dict[str, Metric] = {}
        self.attributes: dict[str, Column] = {}
        self.memberships: dict[str, datasets.Membership] = {}
        self.sequences: dict[str, sequences.SequenceSpec] = {}
        self.arrivals: dict[str, arrivals.ArrivalSpec] = {}
        self._tests: dict[str, Test] = {}
        self._sides: dict[str, Column] = {}
        self._columns_of: dict[str, Column] = {}
        self._names: dict[str, str] = {}
        self._mark_of: dict[str, str] = {}
        self._used: dict[str, Field] = {}
        self._plans = []
        for rule in rules:
            sizes = [len(x) for x in self._tables()]
            try:
                self._plans.append((rule, *self._compile(rule)))
            except ValueError as error:
                if on_error == "raise":
                    raise
                self.refused[rule.rule_id] = str(error)
                # What the rule had asked for so far goes with it; the tables only grow.
                for table, size in zip(self._tables(), sizes):
                    while len(table) > size:
                        table.popitem()

    def _tables(self) -> tuple[dict, ...]:
        return (self.metrics, self.attributes, self.memberships, self.sequences, self.arrivals, self._tests, self._sides, self._names, self._used)

    # ---- fields -----------------------------------------------------------------

    def _named(self, name: str) -> Column:
        if name not in self._columns_of:
            self._columns_of[name] = _quoted(name)
        return self._columns_of[name]

    def _current(self, field: Field) -> Column:
        if not field.envelope:
            self._used[field.column] = field
        return self._named(field.column)

    def _latest(self, field: Field) -> Column:
        if field.envelope:
            return F.when((F.col("source") == field.source) & (F.col("schema_version") == field.version), _quoted(field.column))
        self.attributes[f"last:{field.column}"] = self._current(field)
        return self._named(f"last:{field.column}")

    # ---- conditions -------------------------------------------------------------

    def _side(self, key: str, build: Callable[[], Column]) -> str:
        """Name of a Column that predicates compare; each is built once."""
        if key not in self._sides:
            self._sides[key] = build()
        return key

    def _test(self, cond: Condition, lookup, fetch) -> Test:
        """One condition; `lookup` gives the Field of a path, `fetch` its Column."""
        when = "@" if fetch == self._latest else ""
        if cond.op == "IN_DATASET":
            fields = [lookup(p) for p in cond.fields]
            spec = datasets.Membership(*cond.dataset, tuple(fetch(f) for f in fields))
            name = f"in:{cond.dataset[0]}:{cond.dataset[1] or ''}:" + ",".join(f.column + when for f in fields)
            self.memberships[name] = spec
            return Test(lambda: F.coalesce(_quoted(name), F.lit(False)))

        def number(path: str) -> Column:
            field = lookup(path)
            return fetch(field).cast("bigint" if field.dtype in ("INT", "LONG") else "double")

        def expression(text: str) -> str:
            named = ",".join(lookup(p).column for p in fields_of(text))
            return self._side(f"expr{when} {text} {named}", lambda: arithmetic(text, number))

        if cond.expr:
            left, dtype = expression(cond.expr), "DOUBLE"
        else:
            field = lookup(cond.field)
            # An envelope value counts only on events of its own source where the latest one is asked for.
            left, dtype = self._side(f"field{when} {field.source}.{field.version} {field.column}" if field.envelope else f"field{when} {field.column}", lambda: fetch(field)), field.dtype
        if cond.length:
            inner = left
            left, dtype = self._side(f"length {inner}", lambda: F.length(self._sides[inner])), "INT"
        right = None
        if cond.right_field:
            other = lookup(cond.right_field)
            right = self._side(f"field{when} {other.source}.{other.version} {other.column}" if other.envelope else f"field{when} {other.column}", lambda: fetch(other))
        elif cond.right_expr:
            right = expression(cond.right_expr)
        value = typed(cond.op, dtype, cond.value, right is not None)
        return Test(lambda: predicate(cond.op, self._sides[left], dtype, cond.value, self._sides[right] if right else None), cond.op, left, value, right)

    def _all(self, conds, source: str, version: str) -> Column:
        out = F.lit(True)
        for cond in conds:
            out = out & self._test(cond, lambda p: self.catalogue.local(source, version, p), self._current).column
        return out

    def _shared(self, key: str, build) -> str:
        """Name of a predicate; equal predicates of different rules get one."""
        if key not in self._names:
            test = build()
            self._names[key] = f"t{len(self._names)}"
            self._tests[self._names[key]] = test if isinstance(test, Test) else Test(lambda: test)
        return self._names[key]

    # ---- leaves -----------------------------------------------------------------

    def _metric(self, leaf: WindowCondition, default) -> str:
        named = [leaf.field] if leaf.field else []
        if leaf.mapping:
            parts = [(s, self._version_of(s), p) for s, p in leaf.mapping]
        else:
            first = self.catalogue.qualified((named or fields_of(leaf.expr))[0], default)
            parts = [(first.source, first.version, None)]
        # Metrics are equal if they read equal columns under equal filters, whatever the rules call them.
        if leaf.mapping:
            reads = [self.catalogue.local(*part).column for part in parts]
        elif leaf.field:
            reads = [self.catalogue.qualified(leaf.field, default).column]
        else:
            reads = [leaf.expr, *(self.catalogue.qualified(p, default).column for p in fields_of(leaf.expr))]
        kept = sorted(f"{s}.{v}:{c}" for s, v, _ in parts for c in map(repr, leaf.filter))
        key = "|".join([",".join(reads), ",".join(f"{s}.{v}" for s, v, _ in parts), "&".join(kept)])
        values, keeps = [], []
        for source, version, path in parts:
            here = (F.col("source") == source) & (F.col("schema_version") == version)
            keep = here & self._all(leaf.filter, source, version) if leaf.filter else here
            if path:
                value = self._current(self.catalogue.local(source, version, path))
            elif leaf.field:
                value = self._current(self.catalogue.qualified(leaf.field, default))
            else:
                value = arithmetic(leaf.expr, lambda p: self._current(self.catalogue.qualified(p, default)).cast("double"))
            values.append(F.when(keep, value))
            keeps.append(keep)
        keep = keeps[0]
        for other in keeps[1:]:
            keep = keep | other
        metric = Metric(key, leaf.agg, F.coalesce(*values) if len(values) > 1 else values[0], keep, leaf.duration, leaf.slide)
        name = f"{leaf.agg}({key})/{leaf.duration}/{leaf.slide}"
        self.metrics.setdefault(name, metric)
        return name

    def _version_of(self, source: str) -> str:
        versions = [v for s, v in self.catalogue.schemas if s == source]
        if len(versions) != 1:
            raise ValueError(f"source {source!r} has {len(versions)} versions; name one")
        return versions[0]

    def _leaf(self, node: Node, rule: Rule) -> _Leaf:
        trigger = rule.triggers[0]
        default = (trigger.source, trigger.version)
        leaf = node.leaf
        if isinstance(leaf, WindowCondition):
            metric = self._metric(leaf, default)
            name = self._shared(
                f"{metric}{leaf.op}{leaf.threshold}",
                lambda: self._threshold(leaf, metric),
            )
        elif isinstance(leaf, Arrival):
            key = f"arrival {leaf} {rule.triggers}"
            name = self._shared(key, lambda: self._arrival(leaf, rule, _mark("first", key)))
            self._mark_of[name] = _mark("first", key)
        elif isinstance(leaf, Sequence):
            key = f"sequence {leaf} {default} {[(t.source, t.version) for t in rule.triggers]}"
            name = self._shared(key, lambda: self._sequence(leaf, rule, _mark("seq", key)))
            self._mark_of[name] = _mark("seq", key)
        else:
            lookup = lambda p: self.catalogue.qualified(p, default)
            qualified = [lookup(p).column for p in leaf.paths()]
            name = self._shared(f"latest {leaf} {qualified}", lambda: self._test(leaf, lookup, self._latest))
        return _Leaf(node.path, name)

    def _threshold(self, leaf: WindowCondition, metric: str) -> Test:
        if leaf.op not in ("<=", ">=", "<", ">", "==", "!="):
            raise ValueError(f"unknown comparison {leaf.op!r}")
        side = self._side(f"metric {metric}", lambda: self._named(metric))
        return Test(lambda: F.coalesce(compare(leaf.op, self._sides[side], F.lit(leaf.threshold)), F.lit(False)), leaf.op, side, leaf.threshold)

    def _arrival(self, leaf: Arrival, rule: Rule, name: str) -> Column:
        keys = []
        for path in leaf.key_fields:
            per_source = []
            for trigger in rule.triggers:
                here = (F.col("source") == trigger.source) & (F.col("schema_version") == trigger.version)
                field = self.catalogue.local(trigger.source, trigger.version, path)
                per_source.append(F.when(here, self._current(field).cast("string")))
            keys.append(F.coalesce(*per_source) if len(per_source) > 1 else per_source[0])
        order = self.arrival_column if leaf.order_by == "processing_time" else "event_time"
        self.arrivals[name] = arrivals.ArrivalSpec(tuple(keys), order, leaf.ttl, self._fires(rule))
        return F.coalesce(_quoted(name), F.lit(False))

    def _sequence(self, leaf: Sequence, rule: Rule, name: str) -> Column:
        def side(step):
            version = step.version or next((t.version for t in rule.triggers if t.source == step.source), None) or self._version_of(step.source)
            here = (F.col("source") == step.source) & (F.col("schema_version") == version)
            return here & self._all(step.filter, step.source, version), version

        first, first_version = side(leaf.first)
        second, second_version = side(leaf.second)
        left = tuple(self._current(self.catalogue.local(leaf.first.source, first_version, a)).cast("string") for a, _ in leaf.keys)
        right = tuple(self._current(self.catalogue.local(leaf.second.source, second_version, b)).cast("string") for _, b in leaf.keys)
        if not leaf.keys:
            left = right = (F.col("customer_id"),)
        self.sequences[name] = sequences.SequenceSpec(first, second, left, right, leaf.within)
        complete = first
        for column in left:
            complete = complete & column.isNotNull()
        marked = F.coalesce(_quoted(name), F.lit(False))
        return complete & (marked if leaf.pattern == "FOLLOWED_BY" else ~marked)

    # ---- rules ------------------------------------------------------------------

    def _groups(self, trigger: Trigger) -> list[list[_Leaf]]:
        out = []
        for g, group in enumerate(trigger.groups):
            leaves = []
            for c, cond in enumerate(group):
                lookup = lambda p: self.catalogue.local(trigger.source, trigger.version, p)
                qualified = [lookup(p).column for p in cond.paths()]
                name = self._shared(f"current {cond} {qualified}", lambda: self._test(cond, lookup, self._current))
                leaves.append(_Leaf(f"{trigger.path}.{g}.{c}", name))
            out.append(leaves)
        return out

    @staticmethod
    def _dnf(groups: list[list[_Leaf]], columns) -> Column:
        if not groups:
            return F.lit(True)
        out = None
        for group in groups:
            every = F.lit(True)
            for leaf in group:
                every = every & columns(leaf.column)
            out = every if out is None else out | every
        return out

    @staticmethod
    def _dnf_text(groups: list[list[_Leaf]]) -> str:
        return " OR ".join("(" + (" AND ".join(leaf.column for leaf in group) or "true") + ")" for group in groups) or "true"

    def _fires(self, rule: Rule) -> Column:
        """Trigger of a rule as one Column over the timeline (before predicates have columns)."""
        out = F.lit(False)
        for trigger in rule.triggers:
            here = (F.col("source") == trigger.source) & (F.col("schema_version") == trigger.version)
            out = out | (here & self._dnf(self._groups(trigger), lambda name: self._tests[name].column))
        return out

    def _compile(self, rule: Rule):
        triggers = [(t, self._groups(t)) for t in rule.triggers]
        leaves = {node.path: self._leaf(node, rule) for node in rule.tree.leaves()}
        return triggers, leaves

    def _tree_text(self, node: Node, leaves: dict[str, _Leaf]) -> str:
        if node.leaf is not None:
            return leaves[node.path].column
        return "(" + f" {node.kind} ".join(self._tree_text(child, leaves) for child in node.children) + ")"

    # ---- evaluation -------------------------------------------------------------

    def pruned(self, timeline: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Timeline with only the columns the rules read; declared fields it lacks become NULL."""
        have = set(timeline.columns)
        extra = [c for c in (*EXTRA_COLUMNS, self.arrival_column, *keep) if c in have and c not in EVENT_COLUMNS]
        fields = [
            _quoted(name) if name in have else F.lit(None).cast(SPARK_TYPES[field.dtype]).alias(name)
            for name, field in sorted(self._used.items())
        ]
        return timeline.select(*EVENT_COLUMNS, *dict.fromkeys(extra), *fields)

    def prepare(self, timeline: DataFrame, dataset_rows: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Timeline plus every state column the rules read."""
        base = self.pruned(timeline, keep)
        row = identity(base)
        marks = [
            sequences.followed(base, spec, ident=row).where("followed").select(row, F.lit(name).alias("mark"))
            for name, spec in self.sequences.items()
        ] + [
            arrivals.first_arrivals(base, spec, ident=row).select(row, F.lit(name).alias("mark"))
            for name, spec in self.arrivals.items()
        ]
        out = add_state(base, self.attributes, self.metrics, self.bucket, self.include_current, ident=row)
        if marks:
            out = self._marked(out, marks)
        return self.with_members(out, dataset_rows)

    def with_members(self, rows: DataFrame, dataset_rows: DataFrame | None = None) -> DataFrame:
        """Add the dataset memberships the rules ask for."""
        for name, spec in self.memberships.items():
            if dataset_rows is None:
                raise ValueError("rules use IN_DATASET: pass dataset_rows")
            rows = datasets.add_membership(rows, name, spec, dataset_rows)
        return rows

    def _marked(self, rows: DataFrame, marks: list[DataFrame]) -> DataFrame:
        """Sequence and arrival marks by row: one join on a unique key, however many marks there are."""
        row = identity(rows)
        table = marks[0]
        for other in marks[1:]:
            table = table.unionByName(other)
        names = [*self.sequences, *self.arrivals]
        flags = table.groupBy(row).agg(*[F.bool_or(F.col("mark") == name).alias(name) for name in names])
        return rows.join(flags, row, "left")

    def _verdict(self, rule: Rule, triggers, leaves, passed_only: bool = False) -> str:
        """SQL text of a rule's verdict: a struct, or NULL where the rule does not listen."""
        here = [f"(source = {_text(t.source)} AND schema_version = {_text(t.version)})" for t, _ in triggers]
        routed = "(" + " OR ".join(here) + ")"
        fired = "(" + " OR ".join(f"({h} AND ({self._dnf_text(groups)}))" for h, (_, groups) in zip(here, triggers)) + ")"
        trigger_failures = [f"if({h} AND NOT {leaf.column}, {_text(leaf.path)}, NULL)" for h, (_, groups) in zip(here, triggers) for group in groups for leaf in group]
        for bound, sign in ((rule.effective_from, ">="), (rule.effective_to, "<")):
            if bound is not None:
                routed += f" AND `{self.arrival_column}` {sign} timestamp_micros({moment_us(bound)})"
        tree = self._tree_text(rule.tree, leaves)
        if passed_only:
            routed += f" AND {fired} AND {tree}"
        tree_failures = [f"if(NOT {leaf.column}, {_text(leaf.path)}, NULL)" for leaf in leaves.values()]
        unfired = f"concat_ws(',', {', '.join(trigger_failures)})" if trigger_failures else "'trigger'"
        failed = f"CASE WHEN NOT {fired} THEN {unfired} WHEN NOT {tree} THEN concat_ws(',', {', '.join(tree_failures)}) END"
        return (
            f"if({routed}, named_struct('rule_id', {_text(rule.rule_id)}, 'rule_version', {int(rule.version)}L, "
            f"'status', if({fired} AND {tree}, 'PASS', 'FAIL'), 'failed_condition', {failed}), NULL)"
        )

    def judge(self, state: DataFrame, keep: tuple[str, ...] = (), passed_only: bool = False, plans: list | None = None) -> DataFrame:
        """One row per event and rule listening to its source: status and failing conditions.

        A rule judges the events that arrive while it is in force. `plans`: of these rules only.
        """
        plans = self._plans if plans is None else plans
        base = list(dict.fromkeys([*EVENT_COLUMNS, *(["row_id"] if "row_id" in state.columns else []), *keep]))
        timed = any(rule.effective_from is not None or rule.effective_to is not None for rule, *_ in plans)
        if timed and self.arrival_column not in state.columns:
            raise ValueError(f"rules are in force by arrival: the rows need {self.arrival_column!r}")
        if self.as_rows:
            return rule_rows.judge(state, base, self._as_data(plans), self._tests, self._sides, self.arrival_column if timed else None, passed_only)
        arrival = [self.arrival_column] if timed and self.arrival_column not in base else []
        read = dict.fromkeys(leaf.column for _, triggers, leaves in plans for leaf in [*leaves.values(), *(x for _, groups in triggers for g in groups for x in g)])
        tested = state.select(*base, *arrival, *[self._tests[name].column.alias(name) for name in read])
        verdicts = F.expr("array(" + ", ".join([*(self._verdict(*plan, passed_only) for plan in plans), f"CAST(NULL AS {rule_rows.VERDICT})"]) + ")")
        # A rule that does not listen gives a NULL struct, which inline turns into a row of NULLs.
        return tested.select(*base, F.inline(verdicts)).where("rule_id is not null")

    # ---- verdicts that wait for a mark ------------------------------------------

    def marks_of(self) -> dict[str, list[str]]:
        """The marks that each rule's tree asks for."""
        return {rule.rule_id: [self._mark_of[leaf.column] for leaf in leaves.values() if leaf.column in self._mark_of] for rule, _, leaves in self._plans}

    def deferred(self, waits: bool = True) -> list:
        """Plans of the rules whose tree asks for a sequence or a first arrival, or of all others."""
        asked = self.marks_of()
        return [plan for plan in self._plans if bool(asked[plan[0].rule_id]) == waits]

    def judge_known(self, rows: DataFrame) -> DataFrame:
        """Verdicts of the deferred rules on `rows` with marks and, as arrays of marks, `needs`, `had` and `have`.

        A rule judges a row when it has every mark that the row needs and the rule asks for, and did not
        before: so each verdict is given once. `had` is NULL where nothing was asked before.
        """
        pairs = [x for rule, marks in self.marks_of().items() if marks for x in (F.lit(rule), F.array(*map(F.lit, marks)))]
        asked = F.array_intersect("needs", F.try_element_at(F.create_map(*pairs), F.col("rule_id"))) if pairs else F.col("needs")
        lacked = F.col("had").isNull() | (F.size(F.array_except(asked, F.coalesce("had", F.array().cast("array<string>")))) > 0)
        judged = self.judge(rows, keep=("needs", "had", "have"), plans=self.deferred())
        return judged.where((F.size(F.array_except(asked, "have")) == 0) & lacked).drop("needs", "had", "have")

    def mark_steps(self, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """What each row is to each sequence and arrival: A, B, or F for an arrival that counts.

        Rows (ident, event_us, arrival_us, keep..., mark, role, key, span): the key as JSON text,
        the span the limit of a sequence or the time to live of an arrival.
        """

        def step(mark: str, role: str, test: Column, keys: tuple[Column, ...], span: int | None) -> Column:
            complete = test
            for key in keys:
                complete = complete & key.isNotNull()
            key = F.to_json(F.array(*[k.cast("string") for k in keys]))
            return F.when(complete, F.struct(F.lit(mark).alias("mark"), F.lit(role).alias("role"), key.alias("key"), F.lit(span).cast("bigint").alias("span")))

        steps = []
        for mark, spec in self.sequences.items():
            steps += [step(mark, "A", spec.first, spec.left_keys, spec.within), step(mark, "B", spec.second, spec.right_keys, spec.within)]
        for mark, spec in self.arrivals.items():
            # By arrival, or by event time where the rule says so.
            steps.append(step(mark, "F" if spec.order == self.arrival_column else "E", spec.keep, spec.keys, spec.ttl))
        arrival = self.arrival_column if self.arrival_column in rows.columns else "event_time"
        return rows.select(
            F.col(identity(rows)).cast("string").alias("ident"), event_us().alias("event_us"), event_us(arrival).alias("arrival_us"), *keep,
            F.inline(F.array_compact(F.array(*steps))),
        )

    def with_marks(self, rows: DataFrame, flags: DataFrame | None = None) -> DataFrame:
        """`rows`, which have an `ident`, with a column for each mark: from `flags` (ident, mark, value), or none known."""
        names = [*self.sequences, *self.arrivals]
        if flags is None:
            return rows.select("*", *[F.lit(None).cast("boolean").alias(n) for n in names])
        wide = flags.groupBy("ident").agg(*[F.bool_or(F.when(F.col("mark") == n, F.col("value"))).alias(n) for n in names])
        return rows.join(wide, "ident")

    @staticmethod
    def _as_data(plans: list) -> list[rule_rows.RuleRow]:
        """The rules as rows of predicate names."""

        def tree(node: Node, leaves: dict[str, _Leaf]):
            return leaves[node.path].column if node.leaf is not None else (node.kind, tuple(tree(child, leaves) for child in node.children))

        return [
            rule_rows.RuleRow(
                rule.rule_id, int(rule.version),
                tuple((t.source, t.version, tuple(tuple((leaf.path, leaf.column) for leaf in group) for group in groups)) for t, groups in triggers),
                tree(rule.tree, leaves), tuple((leaf.path, leaf.column) for leaf in leaves.values()),
                *(None if bound is None else moment_us(bound) for bound in (rule.effective_from, rule.effective_to)),
            )
            for rule, triggers, leaves in plans
        ]

    def run(self, timeline: DataFrame, dataset_rows: DataFrame | None = None, **options) -> DataFrame:
        return self.judge(self.prepare(timeline, dataset_rows), **options)


def compile_rules(rules: list[Rule], catalogue: Catalogue, bucket: int = 60_000_000, **options) -> CompiledRules:
    """Compile a rule set; `bucket` (default one minute) is the time grain of the window state."""
    return CompiledRules(rules, catalogue, bucket, **options)
