"""The predicate vocabulary of rules, as null-safe boolean Columns.

A missing field makes every operator false, negative ones included; only
``IS_NULL`` is true then.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("INT", "LONG", "FLOAT", "DOUBLE")
COMPARE = ("==", "!=", ">", "<", ">=", "<=")
LIST_OPS = ("IN", "NOT IN", "BETWEEN")
TEXT_OPS = (
    "STARTS_WITH", "NOT_STARTS_WITH", "ENDS_WITH", "NOT_ENDS_WITH", "CONTAINS", "NOT_CONTAINS",
)
NULL_OPS = ("IS_NULL", "IS_NOT_NULL")

# Operators allowed per declared type.
ALLOWED = {
    "INT": (*COMPARE, *LIST_OPS, *NULL_OPS),
    "LONG": (*COMPARE, *LIST_OPS, *NULL_OPS),
    "FLOAT": (*COMPARE, "BETWEEN", *NULL_OPS),
    "DOUBLE": (*COMPARE, "BETWEEN", *NULL_OPS),
    "STRING": ("==", "!=", "IN", "NOT IN", *TEXT_OPS, *NULL_OPS),
    "BOOLEAN": ("==", "!=", *NULL_OPS),
    "TIMESTAMP": (*COMPARE, "BETWEEN", *NULL_OPS),
    "OBJECT": NULL_OPS,
}
SPARK_TYPES = {
    "INT": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double",
    "STRING": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "OBJECT": "string",
}


def moment_us(value: Any) -> int:
    """Microseconds since the epoch of an ISO-8601 text with an offset, or of a datetime with one."""
    moment = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    if moment.tzinfo is None:
        raise ValueError(f"timestamp literal needs an offset: {value!r}")
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def plain(value: Any, dtype: str) -> Any:
    """A literal of a declared type as a plain value, times in microseconds; a value that is none is refused."""
    if dtype == "TIMESTAMP":
        return moment_us(value)
    if dtype == "STRING":
        return str(value)
    if dtype in NUMERIC and (isinstance(value, bool) or not isinstance(value, (int, float))):
        raise ValueError(f"not a number: {value!r}")
    if dtype == "BOOLEAN" and not isinstance(value, bool):
        raise ValueError(f"not a boolean: {value!r}")
    return value


def literal(value: Any, dtype: str) -> Column:
    """Literal of a declared type; a value that is none is refused here, not when rows are read."""
    value = plain(value, dtype)
    return F.timestamp_micros(F.lit(value).cast("bigint")) if dtype == "TIMESTAMP" else F.lit(value)


def typed(op: str, dtype: str, value: Any, has_right: bool) -> Any:
    """What an operator compares with, as plain values: one, a list, or None for a right side; refuses what `predicate` refuses."""
    if op in NULL_OPS or (op in COMPARE and has_right):
        return None
    if op in COMPARE:
        return plain(value, dtype)
    if op in LIST_OPS:
        if not isinstance(value, (list, tuple)) or (op == "BETWEEN" and len(value) != 2):
            raise ValueError(f"{op} needs a list of literals, BETWEEN of two: {value!r}")
        return [plain(v, dtype) for v in value]
    if op in TEXT_OPS:
        return str(value)
    raise ValueError(f"operator not supported: {op!r}")


def compare(op: str, left: Column, right: Column) -> Column:
    match op:
        case "==":
            return left == right
        case "!=":
            return left != right
        case ">":
            return left > right
        case "<":
            return left < right
        case ">=":
            return left >= right
        case "<=":
            return left <= right
    raise ValueError(f"unknown comparison {op!r}")


def predicate(op: str, left: Column, dtype: str, value: Any = None, right: Column | None = None) -> Column:
    """Null-safe boolean Column for ``left op (value | right)``."""
    if op == "IS_NULL":
        return left.isNull()
    if op == "IS_NOT_NULL":
        return left.isNotNull()
    if op in COMPARE:
        test = compare(op, left, right if right is not None else literal(value, dtype))
    elif op == "BETWEEN":
        low, high = value
        test = left.between(literal(low, dtype), literal(high, dtype))
    elif op in ("IN", "NOT IN"):
        test = left.isin([literal(v, dtype) for v in value])
        test = ~test if op == "NOT IN" else test
    elif op in TEXT_OPS:
        text = F.lit(str(value))
        kind = op.removeprefix("NOT_")
        test = {"STARTS_WITH": F.startswith, "ENDS_WITH": F.endswith, "CONTAINS": F.contains}[kind](left, text)
        test = ~test if op.startswith("NOT_") else test
    else:
        raise ValueError(f"operator not supported: {op!r}")
    return F.coalesce(test, F.lit(False))
