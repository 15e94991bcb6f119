"""Which of many rules an event may fire: index tables, candidate join, exact verification.

Rules are rows here. Events are first reduced to signatures, the distinct combinations
of (source, version) and the values of the fields the triggers read; rules are matched
once per signature, and events join their signature at the end. A value that a third
of all events carry is thus matched once, not once per event.

Rules are reduced in the same way: rules of equal trigger are matched once (`alike`). Where sums over
the matching rules are asked for and not the rules, `matched_sums` adds up the rules under each key of the
index before events meet it, so that no pair of event and rule is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegate.functions.arithmetic import arithmetic, fields_of
from pulsegate.functions.json_leaves import instant, instant_text
from pulsegate.operators import access
from pulsegate.operators.datasets import newest
from pulsegate.operators.joins import kept, small, spread_join

EXACT = ("==", "IN", "IN_DATASET")
DATASET = "in_dataset:"
# What a predicate says, without its place in a rule.
SAID = ["kind", "field", "fields", "expr", "is_length", "op", "value", "right_field", "right_expr", "dataset_id", "dataset_version"]


def _list(value: Column) -> Column:
    """Texts of a JSON list."""
    return F.from_json(value, "array<string>")


def _is_exact() -> Column:
    plain = F.col("right_field").isNull() & F.col("right_expr").isNull() & F.col("expr").isNull() & ~F.coalesce("is_length", F.lit(False))
    return F.col("op").isin(*EXACT) & plain


def _name(said: Column) -> Column:
    """A name of 128 bits for a value, equal for equal values."""
    return F.substring(F.sha2(F.to_json(said), 256), 1, 32)


def trigger_predicates(leaves: DataFrame) -> DataFrame:
    """Trigger rows of flatten_rules: the predicates of the AND groups."""
    return leaves.where("part = 'trigger'")


def alike(predicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predicates of one rule for each different trigger, rows (rule_id, first): the rule of equal trigger that stands for each).

    What is collected to a row is one rule's own trigger.
    """
    said = F.sort_array(F.collect_list(F.struct("source", "version", "group_id", *SAID)))
    named = predicates.groupBy("rule_id").agg(said.alias("said")).select("rule_id", _name(F.struct("said")).alias("trigger"))
    named = kept(named, "triggers")
    firsts = kept(named.groupBy("trigger").agg(F.min("rule_id").alias("first")), "firsts")
    stands = named.join(small(firsts), "trigger").select("rule_id", "first")
    return kept(predicates.join(small(firsts.select(F.col("first").alias("rule_id"))), "rule_id", "left_semi"), "alike"), stands


def stood_for(stands: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(rule_id, *sums): for each rule that stands for others the `sums`, columns over rule_id, of all of them. stands: rows of `alike`."""
    valued = stands.select(F.col("first").alias("_first"), *[c.alias(n) for n, c in sums.items()])
    return kept(valued.groupBy(F.col("_first").alias("rule_id")).agg(*[F.sum(n).alias(n) for n in sums]), "stood-for")


def _canonical(word: Column, dtype: Column) -> Column:
    """The text that ingest writes for a literal of a declared type; text of no such value stays as it is."""
    number = word.try_cast("decimal(38,9)")
    whole = F.when(number == F.floor(number), number.try_cast("bigint").cast("string"))
    written = (
        F.when(dtype.isin("INT", "LONG"), whole)
        .when(dtype == "FLOAT", word.try_cast("float").cast("string"))
        .when(dtype == "DOUBLE", word.try_cast("double").cast("string"))
        .when(dtype == "BOOLEAN", F.lower(F.trim(word)))
        .when(dtype == "TIMESTAMP", instant_text(instant(word)))
    )
    return F.coalesce(written, word)


def rule_index(predicates: DataFrame, columns: DataFrame) -> DataFrame:
    """Exact predicates as (source, version, field, value, rule_id, group_id, pred_id).

    Values are the texts that events carry for the declared types, from `columns`: 100 is
    '100.0' in a DOUBLE field, and times are in UTC.

    IN lists give a row per value. A dataset predicate is indexed under its tuple of
    fields with the dataset as value.
    """
    dataset = F.concat_ws("@", "dataset_id", "dataset_version")
    values = F.when(F.col("op") == "IN", _list(F.col("value"))).when(F.col("op") == "==", F.array("value")).otherwise(F.array(dataset))
    field = F.when(F.col("op") == "IN_DATASET", F.concat(F.lit(DATASET), F.concat_ws(",", "fields"))).otherwise(F.col("field"))
    typed = columns.select("source", "version", F.col("path").alias("field"), F.col("type").alias("_type"))
    rows = predicates.where(_is_exact()).join(small(typed), ["source", "version", "field"], "left")
    written = F.transform(values, lambda v: F.when(F.col("op") == "IN_DATASET", v).otherwise(_canonical(v, F.col("_type"))))
    return rows.select(
        "source", "version", field.alias("field"), F.explode(F.array_distinct(written)).alias("value"), "rule_id", "group_id", "pred_id"
    )


def complex_rules(predicates: DataFrame) -> DataFrame:
    """Rules that are always candidates: those with another operator, or with an empty trigger."""
    return predicates.where((F.col("kind") == "always") | ~_is_exact()).select("source", "version", "rule_id").distinct()


def document_frequency(predicates: DataFrame) -> DataFrame:
    """Rules per trigger field."""
    fields = F.explode(F.coalesce("fields", F.array("field")))
    named = predicates.where("field is not null or fields is not null").select("source", "version", "rule_id", fields.alias("field"))
    return named.groupBy("source", "version", "field").agg(F.countDistinct("rule_id").alias("rules"))


def read_fields(predicates: DataFrame) -> list[str]:
    """Names of the fields the triggers read: configuration sized."""
    names = F.concat(F.coalesce("fields", F.array().cast("array<string>")), F.filter(F.array("field", "right_field"), lambda f: f.isNotNull()))
    plain = {r["f"] for r in predicates.select(F.explode(names).alias("f")).distinct().collect()}
    return sorted(plain | {_local(p, source, version) for source, version, text in expressions(predicates) for p in fields_of(text)})


def expressions(predicates: DataFrame) -> list[tuple[str, str, str]]:
    """(source, version, text) of each arithmetic side of a trigger: configuration sized."""
    texts = F.filter(F.array("expr", "right_expr"), lambda t: t.isNotNull())
    return sorted(tuple(r) for r in predicates.select("source", "version", F.explode(texts).alias("text")).distinct().collect())


def _local(path: str, source: str, version: str) -> str:
    return path.removeprefix(f"{source}.{version}.") if path.startswith(f"{source}.{version}.") else path.removeprefix(f"{source}.")


def _computed(texts: list[tuple[str, str, str]]) -> Column:
    """Map of each arithmetic text to its value over the `values` of a signature; its key names source and version too."""
    pairs = []
    for source, version, text in texts:
        number = lambda p, s=source, v=version: F.try_element_at("values", F.lit(_local(p, s, v))).try_cast("double")
        pairs += [F.lit(f"{source}|{version}|{text}"), arithmetic(text, number).cast("double")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def signatures(events: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events with `signature`, distinct signatures). Events need a `fields` map.

    A signature row has source, version, signature, the number of `events`, the `values`
    map and the short key (sig, twin): a 64-bit hash, and a number that tells apart
    signatures of equal hash.
    """
    values = F.map_filter("fields", lambda k, v: k.isin(*fields) & v.isNotNull())
    marked = events.withColumn("signature", F.to_json(F.array_sort(F.map_entries(values))))
    distinct = marked.groupBy("source", F.col("schema_version").alias("version"), "signature").agg(F.count("*").alias("events"))
    entries = F.from_json("signature", "array<struct<key:string,value:string>>")
    twin = F.row_number().over(W.partitionBy("sig").orderBy("source", "version", "signature"))
    return marked, (
        distinct.withColumn("sig", F.xxhash64("source", "version", "signature"))
        .withColumns({"twin": twin, "values": F.map_from_entries(entries)})
    )


SIG = ["sig", "twin"]
TOKEN = ["source", "version", "field", "value"]


def tokens(sigs: DataFrame, index: DataFrame, dataset_rows: DataFrame | None = None) -> DataFrame:
    """(source, version, sig, twin, field, value) pairs to look up in the index."""
    home = ["source", "version", *SIG]
    plain = sigs.select(*home, F.explode("values").alias("field", "value"))
    if dataset_rows is None:
        return plain
    asked = index.where(F.startswith("field", F.lit(DATASET))).select("source", "version", "field").distinct()
    parts = F.split(F.expr(f"substring(field, {len(DATASET) + 1})"), ",")
    wanted = sigs.join(small(asked), ["source", "version"]).withColumn("_key", F.transform(parts, lambda p: F.try_element_at("values", p)))
    complete = wanted.where(~F.exists("_key", lambda v: v.isNull()))
    named = dataset_rows.select(F.concat_ws("@", "dataset_id", "dataset_version").alias("value"), F.col("key").alias("_key"))
    unnamed = newest(dataset_rows).select(F.col("dataset_id").alias("value"), F.col("key").alias("_key"))
    hits = complete.join(named.unionByName(unnamed).distinct(), "_key")
    return plain.unionByName(hits.select(*home, "field", "value"))


def candidates(token_rows: DataFrame, sigs: DataFrame, index: DataFrame, always: DataFrame) -> DataFrame:
    """(sig, twin, rule_id): rules hit by any exact predicate, and the complex ones.

    Complex rules come in by (source, version) alone and are left out of the index first,
    so that only rules hit by several values need to be made distinct.
    """
    own = index.join(always, ["source", "version", "rule_id"], "left_anti")
    hits = spread_join(token_rows, own, TOKEN, SIG).select(*SIG, "rule_id").distinct()
    return hits.unionByName(spread_join(sigs, always, ["source", "version"], SIG).select(*SIG, "rule_id"))


def rare_two(token_rows: DataFrame, sigs: DataFrame, index: DataFrame, predicates: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Candidates by intersection: in some AND group the two exact predicates on the rarest fields hit.

    Both are one key of the index (operators.access). Groups with fewer exact predicates need all
    they have; rules with a group without any always qualify. A dataset as second predicate is left
    to the verification. `weights` (rule_id, n) tell how many rules a rule stands for.
    """
    return access.found(sigs, *access.access_index(predicates, index, weights=weights), token_rows).select(*SIG, "rule_id")


def matches(token_rows: DataFrame, sigs: DataFrame, index: DataFrame, predicates: DataFrame, columns: DataFrame) -> DataFrame:
    """Rules whose trigger holds: found under the access path of a group, verified where that does not decide it."""
    hits = kept(access.found(sigs, *access.access_index(predicates, index, columns), token_rows), "hits")
    sure = hits.where("whole").select(*SIG, "rule_id")
    open_ = hits.where("not whole").select(*SIG, "rule_id")
    return sure.unionByName(verify(open_, sigs, rule_groups(predicates, columns), token_rows, expressions(predicates)))


def _parts(predicates: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(source, version, part, own, earlier, *sums): groups that exclude each other in every rule, with `sums` over the rules of equal parts.

    A part holds where its `own` predicates do and none of the `earlier` groups of its rule. Groups that
    many rules have come first in a rule, so that what the others exclude is shared by many rules as well.
    """
    home = ["source", "version"]
    groups = predicates.groupBy(*home, "rule_id", "group_id").agg(F.sort_array(F.collect_set(F.struct(*SAID))).alias("g"))
    groups = kept(groups.withColumn("name", _name(F.struct("g"))), "groups")
    shared = groups.groupBy(*home, "name").agg(F.count("*").alias("_n")).where("_n > 1")
    ranked = groups.join(small(shared), [*home, "name"], "left").select(*home, "rule_id", F.struct(-F.coalesce("_n", F.lit(1)), "name", "g").alias("o"))
    ordered = ranked.groupBy(*home, "rule_id").agg(F.array_sort(F.collect_set("o")).alias("o"))
    opened = ordered.select(*home, *[c.alias(n) for n, c in sums.items()], F.col("o.g").alias("_gs"), F.posexplode("o.name").alias("_at", "_name"), F.col("o.name").alias("_names"))
    named = opened.select(
        *home, F.sha2(F.array_join(F.slice("_names", F.lit(1), F.col("_at") + 1), ","), 256).substr(1, 32).alias("part"),
        F.get("_gs", F.col("_at")).alias("own"), F.slice("_gs", F.lit(1), F.col("_at")).alias("earlier"), *sums,
    )
    return named.groupBy(*home, "part").agg(F.any_value("own").alias("own"), F.any_value("earlier").alias("earlier"), *[F.sum(n).alias(n) for n in sums])


def matched_sums(
    sigs: DataFrame, predicates: DataFrame, columns: DataFrame, sums: dict[str, Column], token_rows: DataFrame | None = None
) -> DataFrame:
    """(sig, twin, *sums): for each signature the `sums`, columns over rule_id, of the rules whose trigger holds.

    The same as sums over `matches`, without a row for each rule that matches. A rule counts under the one of
    its parts that holds. Parts lie in the index under the key of their group; those of equal key that leave
    the same predicates to be verified (`rest`) are added up there. Keys are looked up once for each text
    that signatures have on an axis, and a rest is verified once for a signature.
    """
    home, added = ["source", "version"], [F.sum(n).alias(n) for n in sums]
    parts = kept(_parts(predicates, sums), "parts")
    said = lambda groups, name: groups.select(*home, F.col(name).alias("rule_id"), "group_id", F.posexplode("g").alias("pred_id", "_p")).select(*home, "rule_id", "group_id", "pred_id", "_p.*")
    own = said(parts.withColumn("group_id", F.lit("0")).withColumnRenamed("own", "g"), "part")
    own = kept(own, "own")
    keys, axes, free = access.access_index(own, rule_index(own, columns), columns)

    covered = keys.select(*home, F.col("rule_id").alias("part"), "covered").distinct()
    left = parts.join(covered, [*home, "part"], "left").withColumn(
        "rest", F.when(F.col("covered").isNull(), F.col("own")).otherwise(F.filter("own", lambda p, i: ~F.array_contains("covered", i))))
    todo = F.struct(*home, "rest", "earlier")
    left = left.withColumn("todo", F.when((F.size("rest") > 0) | (F.size("earlier") > 0), _name(todo)))
    left = kept(left, "left")
    cells = keys.join(left.select(*home, F.col("part").alias("rule_id"), "todo", *sums), [*home, "rule_id"]).groupBy(*access.KEY, "todo").agg(*added)
    always = left.join(free.select(*home, F.col("rule_id").alias("part")), [*home, "part"], "left_semi").groupBy(*home, "todo").agg(*added)

    spotted = kept(access.spots(sigs, axes), "spots")
    met = access.keys_at(spotted.select(*home, "axis", "at").distinct(), axes).join(cells, access.KEY).groupBy(*home, "axis", "at", "todo").agg(*added)
    columns_of = [*SIG, "todo", *sums]
    hits = spotted.join(met, [*home, "axis", "at"]).select(*columns_of).unionByName(spread_join(sigs, kept(always, "always"), home, SIG).select(*columns_of))
    if token_rows is not None:
        hits = hits.unionByName(access.dataset_keys(token_rows).join(cells, access.KEY).select(*columns_of))
    hits = kept(hits.groupBy(*SIG, "todo").agg(*added), "hits")

    tasks = left.where("todo is not null").groupBy("todo").agg(*[F.any_value(c).alias(c) for c in (*home, "rest", "earlier")])
    tasks = kept(tasks, "tasks")
    rests = rule_groups(said(tasks.where(F.size("rest") > 0).withColumn("group_id", F.lit("0")).withColumnRenamed("rest", "g"), "todo"), columns)
    before = rule_groups(said(tasks.select(*home, "todo", F.posexplode("earlier").alias("group_id", "g")), "todo"), columns)
    named = lambda groups, name: groups.select(F.col("rule_id").alias("todo"), F.col("groups").alias(name))
    tests = tasks.select("todo").join(named(rests, "_rest"), "todo", "left").join(named(before, "_before"), "todo", "left")
    tests = kept(tests, "tests")
    valued, holds = _valued(sigs, token_rows, expressions(predicates))
    any_of = lambda name, none: F.coalesce(F.exists(name, lambda g: F.forall(g, holds)), F.lit(none))
    open_ = hits.where("todo is not null").join(small(tests), "todo").join(valued, SIG).where(any_of("_rest", True) & ~any_of("_before", False))
    return hits.where("todo is null").select(*SIG, *sums).unionByName(open_.select(*SIG, *sums)).groupBy(*SIG).agg(*added)


def rule_groups(predicates: DataFrame, columns: DataFrame) -> DataFrame:
    """(source, version, rule_id, groups): the AND groups of each rule with their literals read once.

    What is collected to a row is one rule's own trigger.
    """
    typed = columns.select("source", "version", F.col("path").alias("field"), "type")
    rows = predicates.join(small(typed), ["source", "version", "field"], "left")
    is_list = F.col("op").isin("IN", "NOT IN", "BETWEEN")
    words = F.when(is_list, _list(F.col("value"))).otherwise(F.array("value"))
    item = F.struct(
        "kind", "field", "op", F.when(F.col("expr").isNotNull(), F.lit("DOUBLE")).otherwise(F.col("type")).alias("type"), "right_field",
        F.concat_ws("|", "source", "version", F.col("expr")).alias("left_key"), F.col("expr").isNotNull().alias("has_left"),
        F.concat_ws("|", "source", "version", F.col("right_expr")).alias("right_key"), F.col("right_expr").isNotNull().alias("has_right"), F.coalesce("is_length", F.lit(False)).alias("is_length"),
        F.col("value").alias("word"), words.alias("words"),
        F.transform(words, lambda w: w.try_cast("double")).alias("numbers"),
        F.concat(F.lit(DATASET), F.concat_ws(",", "fields"), F.lit("="), F.concat_ws("@", "dataset_id", "dataset_version")).alias("dataset_key"),
    )
    groups = rows.groupBy("source", "version", "rule_id", "group_id").agg(F.collect_list(item).alias("g"))
    return groups.groupBy("source", "version", "rule_id").agg(F.collect_list("g").alias("groups"))


def _holds(p: Column) -> Column:
    """One predicate against a `values` map; missing fields are false except for IS_NULL."""
    computed = F.when(p["has_left"], F.try_element_at("_computed", p["left_key"]).cast("string"))
    op, text = p["op"], F.coalesce(computed, F.try_element_at("values", p["field"]))
    right = F.when(p["has_right"], F.try_element_at("_computed", p["right_key"]).cast("string")).otherwise(F.try_element_at("values", p["right_field"]))

    def by(left: Column, others: Column, cast) -> Column:
        """All comparisons; `others` are the literals already cast, a right field is cast here."""
        other = F.when(p["right_field"].isNotNull() | p["has_right"], cast(right)).otherwise(F.get(others, F.lit(0)))
        return (
            F.when(op == "==", left == other).when(op == "!=", left != other)
            .when(op == ">", left > other).when(op == ">=", left >= other)
            .when(op == "<", left < other).when(op == "<=", left <= other)
            .when(op == "BETWEEN", (left >= F.get(others, F.lit(0))) & (left <= F.get(others, F.lit(1))))
            .when(op == "IN", F.array_contains(others, left)).when(op == "NOT IN", ~F.array_contains(others, left))
        )

    # Fractions are compared as doubles, as compiled rules do.
    number = lambda t: t.try_cast("double")
    moment = lambda t: t.try_cast("timestamp")
    word = p["word"]
    affix = (
        F.when(op == "STARTS_WITH", F.startswith(text, word)).when(op == "NOT_STARTS_WITH", ~F.startswith(text, word))
        .when(op == "ENDS_WITH", F.endswith(text, word)).when(op == "NOT_ENDS_WITH", ~F.endswith(text, word))
        .when(op == "CONTAINS", F.contains(text, word)).when(op == "NOT_CONTAINS", ~F.contains(text, word))
    )
    test = (
        F.when(p["kind"] == "always", F.lit(True))
        .when(op == "IS_NULL", text.isNull()).when(op == "IS_NOT_NULL", text.isNotNull())
        .when(p["is_length"], by(F.length(text).cast("double"), p["numbers"], number))
        .when(p["type"].isin("INT", "LONG", "FLOAT", "DOUBLE"), by(number(text), p["numbers"], number))
        .when(p["type"] == "TIMESTAMP", by(moment(text), F.transform(p["words"], moment), moment))
        .when(op.isin("==", "!=", "IN", "NOT IN"), by(text, p["words"], lambda t: t))
        .otherwise(affix)
    )
    return F.coalesce(test, F.lit(False))


def _valued(sigs: DataFrame, token_rows: DataFrame | None, texts: list[tuple[str, str, str]]):
    """(signatures with all that predicates are decided by, the test of one predicate)."""
    valued = sigs.select("source", "version", *SIG, "values").withColumn("_computed", _computed(texts))
    if token_rows is None:
        return valued, _holds
    sets = token_rows.where(F.startswith("field", F.lit(DATASET))).groupBy(*SIG).agg(
        F.collect_set(F.concat("field", F.lit("="), "value")).alias("_sets")
    )
    holds = lambda p: F.when(p["op"] == "IN_DATASET", F.coalesce(F.array_contains("_sets", p["dataset_key"]), F.lit(False))).otherwise(_holds(p))
    return valued.join(sets, SIG, "left"), holds


def verify(found: DataFrame, sigs: DataFrame, groups: DataFrame, token_rows: DataFrame | None = None, texts: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Candidates whose trigger really holds: every predicate of at least one AND group.

    `groups` come from rule_groups. Dataset predicates are decided by the dataset tokens of
    the signature. `texts`, from `expressions`, are the arithmetic sides of the triggers; each
    is computed once for a signature.
    """
    valued, holds = _valued(sigs, token_rows, texts)
    pairs = found.join(valued, SIG).join(groups, ["source", "version", "rule_id"])
    return pairs.where(F.exists("groups", lambda g: F.forall(g, holds))).select(*SIG, "rule_id")


def only_active(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Mask deleted or inactive rules at lookup time."""
    return found.join(rules.where("is_active").select("rule_id"), "rule_id", "left_semi")


def per_event(marked: DataFrame, sigs: DataFrame, found: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Aggregates over the rules of each event's signature, joined to the events."""
    summed = found.groupBy(*SIG).agg(*aggregates)
    named = sigs.select("source", F.col("version").alias("schema_version"), *SIG, "signature").join(summed, SIG).drop(*SIG)
    return marked.join(named, ["source", "schema_version", "signature"], "left")


def pairs(marked: DataFrame, sigs: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, rule_id) of every event and matching rule."""
    named = sigs.join(found, SIG).select("source", F.col("version").alias("schema_version"), "signature", "rule_id")
    return marked.select("event_id", "source", "schema_version", "signature").join(named, ["source", "schema_version", "signature"]).select("event_id", "rule_id")


def selectivity(sigs: DataFrame, found: DataFrame, rules: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Candidates per event and the share of rules pruned, per source. `weights` (rule_id, n): how many rules a rule found stands for."""
    known = rules.groupBy().agg(F.countDistinct("rule_id")).scalar()
    counted = found.withColumn("n", F.lit(1)) if weights is None else found.join(weights, "rule_id")
    per_sig = counted.groupBy(*SIG).agg(F.sum("n").alias("_n"))
    joined = sigs.join(per_sig, SIG, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    totals = joined.groupBy("source", "version").agg(
        F.sum("events").alias("events"), F.sum(F.col("_n") * F.col("events")).alias("candidates")
    )
    return totals.withColumn("rules", known).withColumn("pruned", 1 - F.col("candidates") / (F.col("events") * F.col("rules")))
