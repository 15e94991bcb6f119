"""Judging many rules as data: distinct predicates give boolean vectors, rules are rows of their names.

Spark computes the sides that predicates compare, one Column for each field, length, expression or
metric that any rule reads. Rows then go in Arrow batches through one step that holds the rules:
rows of a batch are taken by source and version, each predicate that a listening rule asks for is
evaluated once over them, and triggers and trees are ANDs and ORs of those vectors. So the plan
grows with the fields that rules read and not with the rules, and a predicate that a thousand rules
share costs as much as for one.

Results are those of the predicates as Columns (functions.predicates): missing values make a test
false, numbers compare as Spark compares them, NaN above all others and equal to itself, texts by
their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT = "struct<rule_id:string,rule_version:bigint,status:string,failed_condition:string>"
# Verdicts that are put together before they leave a task.
ROWS_OUT = 20_000


@dataclass(frozen=True)
class RuleRow:
    """Triggers as (source, version, groups of (path, test)), the tree as nested (kind, children) over tests, leaves as (path, test)."""

    rule_id: str
    version: int
    triggers: tuple
    tree: tuple | str
    leaves: tuple
    begin: int | None
    end: int | None

    def tests(self):
        return [name for _, name in self.leaves] + [name for _, _, groups in self.triggers for group in groups for _, name in group]


def _ordered(op: str, left: np.ndarray, right) -> np.ndarray:
    """A comparison of numbers with NaN equal to itself and above all others."""
    with np.errstate(invalid="ignore"):
        found = {"==": np.equal, "!=": np.not_equal, ">": np.greater, "<": np.less, ">=": np.greater_equal, "<=": np.less_equal}[op](left, right)
    if getattr(left, "dtype", None) != np.float64 and getattr(right, "dtype", None) != np.float64 and not isinstance(right, float):
        return found
    a, b = np.isnan(left), np.isnan(right)
    if not (a.any() or np.any(b)):
        return found
    same, above, below = a & b, a & ~b, ~a & b
    return {"==": found | same, "!=": found & ~same, ">": found | above, "<": found | below, ">=": found | same | above, "<=": found | same | below}[op]


class Side:
    """One compared Column in a batch: values and which of them are there."""

    def __init__(self, array: pa.Array):
        self.array = array
        self.there = array.is_valid().to_numpy(zero_copy_only=False)
        self.text = pa.types.is_string(array.type) or pa.types.is_large_string(array.type)
        self._coded = None
        if self.text or pa.types.is_null(array.type):
            self.values = None
        elif pa.types.is_boolean(array.type):
            self.values = array.fill_null(False).to_numpy(zero_copy_only=False)
        else:
            kind = np.float64 if pa.types.is_floating(array.type) else np.int64
            self.values = array.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)

    def by_word(self, test) -> np.ndarray:
        """`test` of each different text, for every row."""
        if self._coded is None:
            coded = self.array.dictionary_encode()
            self._coded = coded.dictionary, coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
        words, codes = self._coded
        return test(words).to_numpy(zero_copy_only=False)[codes] if len(words) else np.zeros(len(codes), bool)


_TEXT = {"==": pc.equal, "!=": pc.not_equal, ">": pc.greater, "<": pc.less, ">=": pc.greater_equal, "<=": pc.less_equal}


def _on_text(op: str, side: Side, value) -> np.ndarray:
    kind = op.removeprefix("NOT_")
    tests = {
        "STARTS_WITH": lambda w: pc.starts_with(w, value), "ENDS_WITH": lambda w: pc.ends_with(w, value), "CONTAINS": lambda w: pc.match_substring(w, value),
        "IN": lambda w: pc.is_in(w, pa.array(value, w.type)), "NOT IN": lambda w: pc.invert(pc.is_in(w, pa.array(value, w.type))),
        "BETWEEN": lambda w: pc.and_(pc.greater_equal(w, value[0]), pc.less_equal(w, value[1])),
    }
    found = side.by_word(tests[kind] if kind in tests else lambda w: _TEXT[op](w, value))
    return ~found if op.startswith("NOT_") else found


def evaluate(op: str, left: Side, value, right: Side | None) -> np.ndarray:
    """One predicate over the rows of a batch."""
    if op == "IS_NULL":
        return ~left.there
    if op == "IS_NOT_NULL":
        return left.there
    if right is not None:
        both = left.there & right.there
        if left.text:
            return both & _TEXT[op](left.array, right.array).fill_null(False).to_numpy(zero_copy_only=False)
        return both & (_ordered(op, left.values, right.values) if left.values is not None and right.values is not None else False)
    if left.text:
        return left.there & _on_text(op, left, value)
    if left.values is None:
        return np.zeros(len(left.there), bool)
    if op == "BETWEEN":
        found = _ordered(">=", left.values, value[0]) & _ordered("<=", left.values, value[1])
    elif op in ("IN", "NOT IN"):
        found = np.zeros(len(left.values), bool)
        for v in value:
            found |= _ordered("==", left.values, v)
        found = ~found if op == "NOT IN" else found
    else:
        found = _ordered(op, left.values, value)
    return left.there & found


def _comparable(left: T.DataType, right: T.DataType | None, value) -> bool:
    """Whether `evaluate` compares as Spark would; other predicates are computed by Spark as they are."""

    def kind(t):
        return "text" if isinstance(t, T.StringType) else "flag" if isinstance(t, T.BooleanType) else "number" if isinstance(t, (T.IntegralType, T.FloatType, T.DoubleType)) else str(t)

    plain = ("text", "flag", "number", kind(T.TimestampType()))
    if kind(left) not in plain or (right is not None and kind(left) != kind(right)):
        return False
    words = [v for v in (value if isinstance(value, list) else [value]) if v is not None]
    return all((kind(left) == "text") == isinstance(v, str) and (kind(left) == "flag") == isinstance(v, bool) for v in words)


class Judge:
    """The rules and the tests they name, as a step over Arrow batches."""

    def __init__(self, rules: list[RuleRow], tests: dict, n_base: int, timed: bool, passed_only: bool):
        self.tests, self.n_base, self.timed, self.passed_only = tests, n_base, timed, passed_only
        self.by_source: dict[tuple[str, str], list[RuleRow]] = {}
        for rule in rules:
            for key in dict.fromkeys((s, v) for s, v, _ in rule.triggers):
                self.by_source.setdefault(key, []).append(rule)

    def __call__(self, batches):
        for batch in batches:
            base = pa.Table.from_batches([batch]).select(range(self.n_base))
            source = pc.binary_join_element_wise(batch["x_source"], batch["x_version"], "\x00").dictionary_encode()
            codes = source.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code, key in enumerate(source.dictionary.to_pylist()):
                rules = self.by_source.get(tuple(key.split("\x00", 1)))
                if rules:
                    yield from self._judged(batch, base, np.flatnonzero(codes == code), rules)

    def _judged(self, batch, base, rows, rules):
        held, size = [], 0
        every = len(rows) == batch.num_rows
        part = batch if every else batch.take(pa.array(rows))
        sides: dict[str, Side] = {}
        known: dict[str, np.ndarray] = {}

        def side(name):
            if name is not None and name not in sides:
                sides[name] = Side(part[name])
            return sides.get(name)

        def test(name):
            if name not in known:
                op, left, value, right = self.tests[name]
                known[name] = evaluate(op, side(left), value, side(right))
            return known[name]

        arrived = Side(part["x_arrival"]) if self.timed else None
        n = len(rows)
        key = (part["x_source"][0].as_py(), part["x_version"][0].as_py()) if n else None
        for rule in rules:
            listens = np.ones(n, bool)
            for bound, op in ((rule.begin, ">="), (rule.end, "<")):
                if bound is not None:
                    listens &= evaluate(op, arrived, bound, None)
            groups = [group for s, v, found in rule.triggers if (s, v) == key for group in (found or ((),))]
            fired = np.zeros(n, bool)
            for group in groups:
                every_one = np.ones(n, bool)
                for _, name in group:
                    every_one &= test(name)
                fired |= every_one
            if self.passed_only and not (fired & listens).any():
                continue
            holds = self._tree(rule.tree, test)
            passed = fired & holds
            at = np.flatnonzero(passed & listens if self.passed_only else listens)
            if not len(at):
                continue
            held.append((rule, at, passed[at], self._reasons(rule, groups, at, fired, passed, test)))
            size += len(at)
            if size >= ROWS_OUT:
                yield self._batch(base, rows, held)
                held, size = [], 0
        if held:
            yield self._batch(base, rows, held)

    def _tree(self, node, test) -> np.ndarray:
        if isinstance(node, str):
            return test(node)
        kind, children = node
        found = self._tree(children[0], test)
        for child in children[1:]:
            found = found & self._tree(child, test) if kind == "AND" else found | self._tree(child, test)
        return found

    @staticmethod
    def _reasons(rule, groups, at, fired, passed, test) -> pa.Array:
        """Paths of the failing conditions: of the trigger where it does not fire, else of the tree where it fails."""
        texts = np.full(len(at), None, object)
        listed = [leaf for group in groups for leaf in group]
        named = any(group for _, _, found in rule.triggers for group in found)
        for part, leaves, otherwise in ((~fired[at], listed, None if named else "trigger"), (fired[at] & ~passed[at], rule.leaves, None)):
            where = np.flatnonzero(part)
            if not len(where):
                continue
            if otherwise is not None:
                texts[where] = otherwise
                continue
            failing = np.array([~test(name)[at[where]] for _, name in leaves]).reshape(len(leaves), len(where))
            code = np.zeros(len(where), np.int64)
            for row in failing:
                code = np.unique(code * 2 + row, return_inverse=True)[1]
            _, first, of = np.unique(code, return_index=True, return_inverse=True)
            words = np.array([",".join(path for (path, _), bad in zip(leaves, failing[:, i]) if bad) for i in first], object)
            texts[where] = words[of]
        return pa.array(texts, pa.string())

    @staticmethod
    def _batch(base, rows, held) -> pa.RecordBatch:
        at = pa.array(np.concatenate([rows[found] for _, found, _, _ in held]))
        counts = [len(found) for _, found, _, _ in held]
        of = pa.array(np.repeat(np.arange(len(held)), counts))
        status = pa.array(["FAIL", "PASS"]).take(pa.array(np.concatenate([passed for _, _, passed, _ in held]).astype(np.int8)))
        columns = [
            *base.take(at).combine_chunks().columns, pa.array([rule.rule_id for rule, *_ in held]).take(of), pa.array([rule.version for rule, *_ in held], pa.int64()).take(of),
            status, pa.concat_arrays([reasons for *_, reasons in held]),
        ]
        flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(flat, names=[*base.column_names, "rule_id", "rule_version", "status", "failed_condition"])


def judge(state: DataFrame, base: list[str], rules: list[RuleRow], tests: dict, sides: dict[str, Column], arrival: str | None, passed_only: bool) -> DataFrame:
    """One row per event and rule listening to its source, as CompiledRules.judge gives it."""
    read = dict.fromkeys(name for rule in rules for name in rule.tests())
    used = dict.fromkeys(side for name in read for side in (tests[name].left, tests[name].right) if side)
    kinds = dict(zip(used, state.select(*[sides[s].alias(f"s{i}") for i, s in enumerate(used)]).schema)) if used else {}
    columns: dict[str, Column] = {}
    short: dict[str, str] = {}

    def column(name: str, build) -> str:
        if name not in short:
            short[name] = f"x{len(short)}"
            columns[short[name]] = build()
        return short[name]

    data = {}
    for name in read:
        test = tests[name]
        kind = lambda side: kinds[side].dataType
        if test.op and (test.op in ("IS_NULL", "IS_NOT_NULL") or _comparable(kind(test.left), kind(test.right) if test.right else None, test.value)):
            def compared(side):
                if test.op in ("IS_NULL", "IS_NOT_NULL") and not isinstance(kind(side), (T.StringType, T.TimestampType, T.NumericType, T.BooleanType)):
                    return column(f"there {side}", lambda: F.when(sides[side].isNotNull(), F.lit(True)))
                return column(side, lambda: F.unix_micros(sides[side]) if isinstance(kind(side), T.TimestampType) else sides[side])
            data[name] = (test.op, compared(test.left), test.value, compared(test.right) if test.right else None)
        else:
            data[name] = ("==", column(f"test {name}", lambda: test.column), True, None)
    timed = {"x_arrival": F.unix_micros(arrival)} if arrival else {}
    given = state.select(*base, F.col("source").alias("x_source"), F.col("schema_version").alias("x_version"), *[c.alias(n) for n, c in (timed | columns).items()])
    schema = T.StructType([*given.schema.fields[: len(base)], *T.StructType.fromDDL("rule_id string, rule_version bigint, status string, failed_condition string").fields])
    return given.mapInArrow(Judge(rules, data, len(base), bool(arrival), passed_only), schema)
