"""Field catalogue: which paths a (source, version) declares, and how rules name them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Envelope paths -> timeline columns and their types.
ENVELOPE = {
    "metadata.customer_id": ("customer_id", "STRING"),
    "metadata.source": ("source", "STRING"),
    "metadata.schema_version": ("schema_version", "STRING"),
    "metadata.event_time": ("event_time", "TIMESTAMP"),
    "metadata.id": ("event_id", "STRING"),
    "event_time": ("event_time", "TIMESTAMP"),
}


class UnknownField(ValueError):
    """The path is declared by no schema the rule may use."""


@dataclass(frozen=True)
class Field:
    """A declared field: `column` is its timeline column, qualified by source and version."""

    source: str | None
    version: str | None
    path: str
    dtype: str
    category: str
    column: str
    envelope: bool = False


class Catalogue:
    """Declared fields of all (source, version) pairs, held on the driver for rule compilation."""

    def __init__(self, schemas: dict[tuple[str, str], dict[str, tuple[str, str]]]):
        self.schemas = schemas

    @classmethod
    def from_columns(cls, columns: DataFrame) -> "Catalogue":
        """From `schema_columns` rows, configuration; `of_rules` reads only what a rule set names."""
        schemas: dict[tuple[str, str], dict[str, tuple[str, str]]] = {}
        for row in columns.select("source", "version", "path", "type", "category").toLocalIterator():
            schemas.setdefault((row["source"], row["version"]), {})[row["path"]] = (row["type"], row["category"])
        return cls(schemas)

    @classmethod
    def of_rules(cls, columns: DataFrame, rules) -> "Catalogue":
        """Only the schemas of sources that some rule names, in its triggers or anywhere in its text."""
        texts = " ".join(str(rule.body or rule) for rule in rules)
        sources = [r["source"] for r in columns.select("source").distinct().toLocalIterator() if r["source"] in texts]
        return cls.from_columns(columns.where(columns.source.isin(sources)))

    def _field(self, source: str, version: str, path: str) -> Field:
        if path in ENVELOPE and (path.startswith("metadata.") or path not in self.schemas[(source, version)]):
            column, dtype = ENVELOPE[path]
            return Field(source, version, path, dtype, "static_categorical", column, envelope=True)
        dtype, category = self.schemas[(source, version)][path]
        return Field(source, version, path, dtype, category, f"{source}.{version}.{path}")

    def local(self, source: str, version: str, path: str) -> Field:
        """Field named inside one (source, version); a qualified spelling is accepted as well."""
        schema = self.schemas.get((source, version))
        if schema is None:
            raise UnknownField(f"no schema {source}/{version}")
        for name in (path, path.removeprefix(f"{source}.{version}."), path.removeprefix(f"{source}.")):
            if name in schema or name in ENVELOPE:
                return self._field(source, version, name)
        raise UnknownField(f"{path!r} not in {source}/{version}")

    def qualified(self, path: str, default: tuple[str, str] | None = None) -> Field:
        """Field named ``source.version.path``; also ``source.path`` when one version declares it."""
        parts = path.split(".")
        for cut in range(1, len(parts) - 1):
            for vcut in range(cut + 1, len(parts)):
                source, version, rest = ".".join(parts[:cut]), ".".join(parts[cut:vcut]), ".".join(parts[vcut:])
                if (source, version) in self.schemas and rest:
                    return self.local(source, version, rest)
        owners = [sv for sv, cols in self.schemas.items() if path.startswith(sv[0] + ".") and path[len(sv[0]) + 1:] in cols]
        if len(owners) == 1:
            return self.local(*owners[0], path[len(owners[0][0]) + 1:])
        if default is not None:
            return self.local(*default, path)
        raise UnknownField(f"{path!r} names no declared field")


def search(columns: DataFrame, source: str, version: str, category: str | None = None, text: str | None = None) -> DataFrame:
    """Fields of one (source, version), by category and part of the name: what a rule editor offers."""
    found = columns.where((columns.source == source) & (columns.version == version))
    if category:
        found = found.where(found.category == category.lower())
    if text:
        found = found.where(found.path.contains(text))
    return found
