"""Arithmetic rule expressions: ``+ - * / %``, parentheses, constants and fields.

The text is read with Python's own expression grammar and only the listed node
kinds are turned into Columns; everything else (powers, calls, comparisons) is
refused. Division is real division and a zero divisor gives NULL.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"(?<![\w.])[A-Za-z_]\w*(?:\.\w+)*")
_REST = re.compile(r"[\w\s.+\-*/%()]*")
_OPS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: F.try_add,
    ast.Sub: F.try_subtract,
    ast.Mult: F.try_multiply,
    ast.Div: F.try_divide,
    ast.Mod: F.try_mod,
}


class ExpressionError(ValueError):
    """The text is not an allowed arithmetic expression."""


def _parse(text: str) -> tuple[ast.expr, list[str]]:
    names: list[str] = []

    def placeholder(match: re.Match) -> str:
        names.append(match.group(0))
        return f"f{len(names) - 1}"

    body = _FIELD.sub(placeholder, text.strip())
    if not _REST.fullmatch(body):
        raise ExpressionError(f"character not allowed in {text!r}")
    try:
        return ast.parse(body, mode="eval").body, names
    except SyntaxError as error:
        raise ExpressionError(f"cannot read {text!r}") from error


def fields_of(text: str) -> list[str]:
    """Field paths used, in order of first use."""
    return list(dict.fromkeys(_parse(text)[1]))


def rename_fields(text: str, rename: Callable[[str], str]) -> str:
    """The expression with every field path renamed, all in one pass."""
    return _FIELD.sub(lambda match: rename(match.group(0)), text)


def has_modulo(text: str) -> bool:
    return any(isinstance(node, ast.Mod) for node in ast.walk(_parse(text)[0]))


def arithmetic(text: str, resolve: Callable[[str], Column]) -> Column:
    """Column for an expression; `resolve` gives the Column of a field path."""
    tree, names = _parse(text)

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return F.try_subtract(F.lit(0).cast("bigint"), build(node.operand))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd):
            return build(node.operand)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value).cast("bigint" if type(node.value) is int else "double")
        if isinstance(node, ast.Name):
            return resolve(names[int(node.id[1:])])
        raise ExpressionError(f"{type(node).__name__} not allowed in {text!r}")

    return build(tree)
