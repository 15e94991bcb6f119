"""Leaves of nested JSON as rows of an array, and coercion of a leaf to its declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"
# ISO-8601 with an offset or Z; text without one is not an instant.
INSTANT = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d(:\d\d(\.\d{1,9})?)?([Zz]|[+-]\d\d:\d\d(:\d\d)?)$"


def _entries(node: Column, prefix: Column | None) -> Column:
    return F.transform(
        F.map_entries(node),
        lambda e: F.struct(
            (e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])).alias("path"), e["value"].alias("value")
        ),
    )


def leaves(root: Column, text: Column, skip: Column | None = None, stop=None) -> Column:
    """Array of (path, value) for the leaves of a variant object; nested objects become dot paths.

    `text` is the JSON that `root` was read from: it has at least as many opening braces as its
    objects are deep, so every object is opened, at any depth. `skip` is a top-level name to
    leave out; `stop(map)` tells which objects count as leaves.
    """
    rows = _entries(root.try_cast(OBJECT), None)
    if skip is not None:
        rows = F.filter(rows, lambda e: ~((e["path"] == skip) & e["value"].try_cast(OBJECT).isNotNull()))

    def opens(entry: Column) -> Column:
        node = entry["value"].try_cast(OBJECT)
        return node.isNotNull() if stop is None else node.isNotNull() & ~F.coalesce(stop(node), F.lit(True))

    def open_up(entry: Column) -> Column:
        return F.when(opens(entry), _entries(entry["value"].try_cast(OBJECT), entry["path"])).otherwise(F.array(entry))

    # A round opens one level; once no object is left, rounds change nothing.
    braces = F.regexp_count(text, F.lit(r"\{"))
    rounds = F.when(braces > 1, F.sequence(F.lit(2), braces)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, rows, lambda held, _: F.when(F.exists(held, opens), F.flatten(F.transform(held, open_up))).otherwise(held))


def instant(text: Column) -> Column:
    """Timestamp of ISO-8601 text with offset, NULL for anything else."""
    return F.when(text.rlike(INSTANT), text.try_cast("timestamp"))


def instant_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _number(text: Column, kind: Column, integer: bool, bits: str) -> Column:
    """Number of a leaf: true/false count as 1/0, text is parsed, fractions cut off for integers."""
    flag = F.when(text == "true", F.lit(1)).otherwise(F.lit(0))
    if integer:
        value = F.coalesce(text.try_cast(bits), text.try_cast("double").try_cast(bits))
        return F.when(kind == "BOOLEAN", flag.cast(bits)).otherwise(value)
    return F.when(kind == "BOOLEAN", flag.cast(bits)).otherwise(text.try_cast(bits))


def coerce(text: Column, kind: Column, dtype: Column, zero: bool) -> Column:
    """Canonical text of a leaf under its declared type; NULL when it cannot be read.

    `kind` is the JSON kind (schema_of_variant). With `zero`, unreadable numbers become 0
    and unreadable booleans false; unreadable timestamps are NULL either way. Undeclared
    leaves (dtype NULL) stay text, undeclared arrays become empty text.
    """

    def default(value: Column, other: str) -> Column:
        return F.coalesce(value.cast("string"), F.lit(other)) if zero else value.cast("string")

    boolean = F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", F.when(F.trim(text) == "true", F.lit(True)).when(
        F.trim(text) == "false", F.lit(False))).otherwise(text.try_cast("double") != 0)
    is_array = kind.startswith("ARRAY")
    return (
        F.when(dtype.isNull(), F.when(is_array, F.lit("")).otherwise(text))
        .when(dtype == "STRING", F.when(is_array, F.lit("")).otherwise(text))
        .when(dtype == "INT", default(_number(text, kind, True, "int"), "0"))
        .when(dtype == "LONG", default(_number(text, kind, True, "bigint"), "0"))
        .when(dtype == "FLOAT", default(_number(text, kind, False, "float"), "0.0"))
        .when(dtype == "DOUBLE", default(_number(text, kind, False, "double"), "0.0"))
        .when(dtype == "BOOLEAN", default(boolean, "false"))
        .when(dtype == "TIMESTAMP", instant_text(instant(text)))
        .otherwise(text)
    )
