"""Field mapping: business names to raw paths, in rules and in events."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.arithmetic import rename_fields
from pulsegate.plans.rules import text_condition

GENERAL = "general_schema."
SIDES = ("field", "field_name", "right_field")
CONDITIONS = ("conditions", "filter", "expression")


def spelled_out(item):
    """Conditions given as text in their object form, in lists of any depth."""
    if isinstance(item, list):
        return [spelled_out(x) for x in item]
    return text_condition(item) if isinstance(item, str) else item


def mapper_rows(messages: DataFrame, value: str = "value") -> DataFrame:
    """Mapper documents (JSON text) to rows (mapper_id, source, alias, raw_path)."""
    parsed = messages.select(F.from_json(F.col(value), "mapper_id string, source_topic string, mapping map<string,string>").alias("m"))
    return parsed.select("m.mapper_id", F.col("m.source_topic").alias("source"), F.explode("m.mapping").alias("alias", "raw_path"))


def rewrite_leaves(leaves: DataFrame, rule_mappers: DataFrame, mappers: DataFrame) -> DataFrame:
    """Rule leaves with `raw_field`; NULL where the rule's mappers do not know the alias.

    `leaves` has rule_id and field (``SOURCE.alias`` or ``general_schema.alias``),
    `rule_mappers` has (rule_id, mapper_id). A general field gives one row per source
    that maps it.
    """
    general = F.startswith("field", F.lit(GENERAL))
    parts = F.split("field", r"\.", 2)
    asked = leaves.withColumns({
        "_source": F.when(~general, F.get(parts, F.lit(0))), "alias": F.get(parts, F.lit(1)),
    })
    # The mappings of one rule and alias: as many as the rule names mappers.
    known = rule_mappers.join(mappers, "mapper_id").groupBy("rule_id", "alias").agg(
        F.collect_set(F.struct(F.col("source"), F.col("raw_path"))).alias("_known")
    )
    fitting = F.filter("_known", lambda m: F.col("_source").isNull() | (m["source"] == F.col("_source")))
    joined = asked.join(known, ["rule_id", "alias"], "left").withColumn("_m", F.explode_outer(fitting))
    return joined.select(*leaves.columns, F.concat(F.col("_m.source"), F.lit("."), F.col("_m.raw_path")).alias("raw_field"))


def rewrite_body(body: dict, mappers: list[dict]) -> tuple[dict, list[str]]:
    """A rule with raw paths in place of aliases, and the aliases no mapper knows.

    ``general_schema`` names stay and get a `metric_mapping` of source to raw path.
    """
    known = {(m["source"], m["alias"]): m["raw_path"] for m in mappers}
    sources = {s for s, _ in known}
    unknown: list[str] = []

    def path(name: str) -> str:
        source, _, alias = name.partition(".")
        if source not in sources:
            return name
        if (source, alias) in known:
            return f"{source}.{known[(source, alias)]}"
        if alias not in {raw for (s, _), raw in known.items() if s == source}:
            unknown.append(name)
        return name

    def walk(node):
        if isinstance(node, list):
            return [walk(item) for item in node]
        if not isinstance(node, dict):
            return node
        out = {}
        for key, item in node.items():
            if key in SIDES and isinstance(item, str) and item.startswith(GENERAL):
                mapping = {s: raw for (s, alias), raw in sorted(known.items()) if alias == item.removeprefix(GENERAL)}
                if not mapping:
                    unknown.append(item)
                out |= {key: item, "metric_mapping": mapping}
            elif key in SIDES and isinstance(item, str):
                out[key] = path(item)
            elif key == "fields" and isinstance(item, list):
                out[key] = [path(f) for f in item]
            elif key in ("expr", "right_expr") and isinstance(item, str):
                out[key] = rename_fields(item, path)
            elif key in CONDITIONS:
                out[key] = walk(spelled_out(item))
            else:
                out[key] = walk(item)
        return out

    rewritten = {k: walk(v) if k in ("trigger_criteria", "condition_tree") else v for k, v in body.items()}
    return rewritten, sorted(set(unknown))


def rewrite_rules(rules: DataFrame, mappers: DataFrame) -> DataFrame:
    """(rule_id, body) with aliases resolved through the body's mapper_ids; `unknown` lists the rest.

    The mappers of one rule are collected to it: a rule names a handful.
    """
    ids = F.from_json(F.get_json_object("body", "$.mapper_ids"), "array<string>")
    wanted = rules.select("rule_id", F.explode(ids).alias("mapper_id")).join(mappers, "mapper_id")
    per_rule = wanted.groupBy("rule_id").agg(F.collect_list(F.struct("source", "alias", "raw_path")).alias("mappers"))
    joined = rules.select("rule_id", "body").join(per_rule, "rule_id", "left")

    def rewrite(batches):
        for batch in batches:
            bodies, unknown = [], []
            for body, own in zip(batch["body"], batch["mappers"]):
                new, lost = rewrite_body(json.loads(body), [dict(m) for m in own] if own is not None else [])
                bodies.append(json.dumps(new, ensure_ascii=False))
                unknown.append(lost)
            yield pd.DataFrame({"rule_id": batch["rule_id"], "body": bodies, "unknown": unknown})

    return joined.mapInPandas(rewrite, "rule_id string, body string, unknown array<string>")


def project(events: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ("event_id", "customer_id", "event_time")) -> DataFrame:
    """Events under business names: a projection, so unused raw columns are never read."""
    return events.select(*keep, *[F.col(f"`{raw}`").alias(alias) for alias, raw in mapping.items()])


def unify(sources: dict[str, tuple[DataFrame, dict[str, str]]], keep: tuple[str, ...] = ("event_id", "customer_id", "event_time")) -> DataFrame:
    """Several sources in one general schema; columns a source lacks are NULL."""
    out = None
    for name, (events, mapping) in sources.items():
        part = project(events, mapping, keep).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
