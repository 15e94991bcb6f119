"""Views that present the test tables as the engine's inputs.

Only integer arithmetic and plain SQL, so that the oracle can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.plans.fields import Catalogue

# Fixed values of the adapter views.
DEVICES = ("IOS", "ANDROID", "DESKTOP", "TABLET")
CHANNELS = ("MOBILE_APP", "WEB", "ATM", "BRANCH", "CALL_CENTER")
EVENT_FIELDS = {
    "event_type": ("STRING", "dynamic_categorical"),
    "amount_cents": ("LONG", "dynamic_numeric"),
    "k": ("INT", "dynamic_numeric"),
    "device_type": ("STRING", "dynamic_categorical"),
    "login_channel": ("STRING", "dynamic_categorical"),
    "session_id": ("STRING", "dynamic_categorical"),
    "is_large": ("BOOLEAN", "dynamic_categorical"),
    "last_login_time": ("TIMESTAMP", "dynamic_categorical"),
}
PROFILE_FIELDS = {
    "customer_segment": ("STRING", "static_categorical"),
    "acctbal_cents": ("LONG", "static_numeric"),
    "nation": ("INT", "static_numeric"),
}
ORDER_FIELDS = {
    "status": ("STRING", "dynamic_categorical"),
    "amount_cents": ("LONG", "dynamic_numeric"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def customer_id(column: str) -> Column:
    return F.concat(F.lit("ID_"), F.col(column).cast("string"))


def cdp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as customer events of two sources."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        customer_id("user_id").alias("customer_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "A").otherwise("B").alias("source"),
        F.lit("v2").alias("schema_version"),
        F.col("ts").cast("timestamp").alias("event_time"),
        "event_type",
        cents("value").alias("amount_cents"),
        k.alias("k"),
        F.element_at(F.array(*map(F.lit, DEVICES)), (k % 4 + 1)).alias("device_type"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("event_id") % 5 + 1).cast("int")).alias("login_channel"),
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


def cdp_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as a batch table of profile attributes."""
    return table(spark, sf_dir, "customer").select(
        customer_id("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        cents("c_acctbal").alias("acctbal_cents"),
        F.col("c_nationkey").alias("nation"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a second event source."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        customer_id("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.col("o_orderstatus").alias("status"),
        cents("o_totalprice").alias("amount_cents"),
    )


def _qualified(source: str, names, values: dict[str, Column]) -> list[Column]:
    here = F.col("source") == source
    return [F.when(here, values.get(n, F.col(n))).alias(f"{source}.v2.{n}") for n in names]


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of both sources and the profile rows as one timeline with qualified columns.

    Profile rows are batch rows entering the state before the first event; their ids
    are negative.
    """
    events = cdp_events(spark, sf_dir)
    derived = {
        "is_large": F.col("amount_cents") > 5000,
        "last_login_time": F.col("event_time") - F.make_interval(hours=F.col("k")),
    }
    events = events.select(
        "event_id", "customer_id", "event_time", F.col("event_time").alias("arrival_time"), "source", "schema_version",
        *_qualified("A", EVENT_FIELDS, derived), *_qualified("B", EVENT_FIELDS, derived),
    )
    profile = cdp_profile(spark, sf_dir).select(
        (-1 - F.substring_index("customer_id", "_", -1).cast("bigint")).alias("event_id"),
        "customer_id",
        F.timestamp_seconds(F.lit(0)).alias("event_time"),
        F.timestamp_seconds(F.lit(0)).alias("arrival_time"),
        F.lit("C").alias("source"),
        F.lit("v1").alias("schema_version"),
        *[F.col(n).alias(f"C.v1.{n}") for n in PROFILE_FIELDS],
    )
    return events.unionByName(profile, allowMissingColumns=True)


def shared_ids(rows: DataFrame) -> DataFrame:
    """Payload ids shared by four rows each; `row_id` tells them apart."""
    shared = (F.col("event_id") - F.col("event_id") % 4).alias("event_id")
    return rows.select(F.col("event_id").alias("row_id"), shared, *[F.col(f"`{c}`") for c in rows.columns if c != "event_id"])


def catalogue() -> Catalogue:
    return Catalogue({("A", "v2"): EVENT_FIELDS, ("B", "v2"): EVENT_FIELDS, ("C", "v1"): PROFILE_FIELDS})


def _leaf(**expression) -> dict:
    return {"type": "CONDITION", "expression": expression}


def _window(field: str, agg: str, duration: str, slide: str | None, flt: list, op: str, threshold: float, **left) -> dict:
    window = {"type": "sliding", "duration": duration, "slide": slide} if slide else {"type": "tumbling", "duration": duration}
    side = left or {"field": field}
    return _leaf(**side, agg=agg, filter=flt, window=window, op=op, threshold=threshold)


def _on(source: str, *groups: list[dict]) -> dict:
    return {"source": source, "schema_version": "v2", "conditions": [list(g) for g in groups]}


def _is(field: str, value, op: str = "==") -> dict:
    return {"field": field, "op": op, "value": value}


NOT_ERROR = [_is("event_type", "error", "!=")]
PURCHASE = [_is("event_type", "purchase")]


def rules_small() -> list[dict]:
    """Hand-written rules covering every leaf kind and both spellings."""
    return [
        {"rule_id": "R01", "rule_version": "1", "trigger_criteria": [_on("A", [_is("event_type", "purchase")])],
         "condition_tree": {"type": "AND", "children": [
             _window("A.v2.amount_cents", "sum", "24h", "6h", NOT_ERROR, ">", 10000),
             _leaf(field="C.v1.acctbal_cents", op=">=", value=0)]}},
        {"rule_id": "R02", "rule_version": "1",
         "trigger_criteria": [_on("B", [_is("device_type", "TABLET"), _is("k", [10, 60], "BETWEEN")], [_is("login_channel", "ATM")])],
         "condition_tree": {"type": "OR", "children": [
             {"type": "CONDITION", "expression": "B.v2.event_type IN ['click', 'view']"},
             _leaf(field="B.v2.amount_cents", op=">", value=3000)]}},
        {"rule_id": "R03", "rule_version": "1", "trigger_criteria": [_on("A"), _on("B")],
         "condition_tree": _window("B.v2.amount_cents", "count", "12h", None, [_is("event_type", ["click", "view"], "IN")], ">=", 1)},
        {"rule_id": "R04", "rule_version": "1", "trigger_criteria": [_on("A", [_is("device_type", ["IOS", "ANDROID"], "IN")])],
         "condition_tree": {"type": "AND", "children": [
             {"type": "CONDITION", "expression": "(A.v2.amount_cents * 0.65 + A.v2.k * 0.35) >= 1000.0"},
             {"type": "OR", "children": [
                 {"type": "CONDITION", "expression": "C.v1.customer_segment NOT IN ['MACHINERY', 'FURNITURE']"},
                 {"type": "CONDITION", "expression": "A.v2.is_large == true"}]}]}},
        {"rule_id": "R05", "rule_version": "1", "trigger_criteria": [_on("B", [_is("login_channel", "W", "STARTS_WITH")])],
         "condition_tree": _leaf(field="B.v2.last_login_time", op="BETWEEN",
                                 value=["2024-01-05T00:00:00.000+07:00", "2024-01-20T00:00:00.000+07:00"])},
        {"rule_id": "R06", "rule_version": "1", "trigger_criteria": [_on("A"), _on("B", [_is("event_type", "error")])],
         "condition_tree": {"type": "AND", "children": [
             _leaf(expr="A.v2.k % 10", op="IN", value=[1, 3, 5, 7]),
             _leaf(expr="A.v2.amount_cents / 2", op=">", right_expr="A.v2.k * 20")]}},
        {"rule_id": "R07", "rule_version": "1", "trigger_criteria": [_on("B", [_is("k", 50, "<")])],
         "condition_tree": {"type": "OR", "children": [
             _window("B.v2.amount_cents", "avg", "48h", "12h", [_is("device_type", "TABLET", "!=")], "<=", 2500.0),
             _window("B.v2.amount_cents", "max", "24h", "6h", [_is("device_type", "TABLET", "!=")], ">", 9000)]}},
        {"rule_id": "R08", "rule_version": "1", "trigger_criteria": [_on("B", [_is("event_type", "view")])],
         "condition_tree": {"type": "SEQUENCE", "pattern": "NOT_FOLLOWED_BY", "within": "24h",
                            "join_keys": [{"left_field": "first.session_id", "right_field": "second.session_id"}],
                            "first": {"source": "B", "filter": [_is("event_type", "view")]},
                            "second": {"source": "B", "filter": [_is("event_type", "click")]}}},
        {"rule_id": "R09", "rule_version": "1", "trigger_criteria": [_on("A"), _on("B")],
         "condition_tree": _leaf(op="IS_FIRST_ARRIVAL", order_by="processing_time", key_fields=["session_id", "event_type"], ttl="12h")},
        {"rule_id": "R10", "rule_version": "1",
         "trigger_criteria": [_on("B", [{"fields": ["device_type", "login_channel", "k"], "op": "IN_DATASET", "dataset_id": "risky"}])],
         "condition_tree": _leaf(field="B.v2.event_type", op="IS_NOT_NULL")},
        {"rule_id": "R11", "rule_version": "1", "trigger_criteria": [_on("A", [_is("event_type", "signup", "!=")])],
         "condition_tree": {"type": "AND", "children": [
             _leaf(field="A.v2.device_type", op="!=", right_field="B.v2.device_type"),
             _window("", "min", "24h", "6h", [_is("login_channel", "ATM", "!=")], "<", 900.0, expr="A.v2.amount_cents * 0.5 + A.v2.k * 0.5")]}},
        {"rule_id": "R12", "rule_version": "1", "trigger_criteria": [_on("B", [{"field": "login_channel", "function": "LENGTH", "op": ">", "value": 4}])],
         "condition_tree": {"type": "AND", "children": [
             _leaf(field="B.v2.session_id", op="CONTAINS", value="_202401"),
             _leaf(field="B.v2.login_channel", op="NOT_ENDS_WITH", value="R"),
             _leaf(field="B.v2.k", op="NOT IN", value=[1, 2, 3])]}},
    ]


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset `risky`: the (device_type, login_channel, k) tuples seen with k % 7 = 0."""
    tuples = cdp_events(spark, sf_dir).where("k % 7 = 0").select(
        F.array("device_type", "login_channel", F.col("k").cast("string")).alias("key")
    )
    return tuples.distinct().select(F.lit("risky").alias("dataset_id"), F.lit("v1").alias("dataset_version"), "key")


# ---- raw messages -------------------------------------------------------------------

# How a broken message is broken, by (event_id / 50) % 6.
BREAKS = ("no key", "no time", "time without offset", "unknown version", "cut text", "word for number")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cdp_events as nested JSON messages with headers; every 50th row is broken in one of six ways.

    Messages come over many topic partitions; the test file is one, so it is spread here.
    """
    events = cdp_events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    broken = F.when(F.col("event_id") % 50 == 0, F.call_function("div", F.col("event_id"), F.lit(50)) % 6)
    is_broken = lambda n: F.coalesce(broken == n, F.lit(False))
    no_source = F.col("event_id") % 97 == 13
    in_header = (F.col("event_id") % 3 == 0) & ~no_source
    moment = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    version = F.when(is_broken(3), F.lit("v9")).otherwise(F.lit("v2"))
    payload = F.struct(
        F.struct(
            F.when(~is_broken(0), F.col("customer_id")).alias("customer_id"),
            F.when(~in_header & ~no_source, F.col("source")).alias("source"),
            F.when(~in_header, version).alias("schema_version"),
            F.when(~is_broken(1), F.concat(moment, F.when(is_broken(2), F.lit("")).otherwise(F.lit("+00:00")))).alias("event_time"),
        ).alias("metadata"),
        F.col("event_type"),
        F.when(is_broken(5), F.lit("many")).otherwise(F.col("amount_cents").cast("string")).alias("amount_cents"),
        F.struct("device_type", F.col("k").alias("k")).alias("risk"),
        F.concat(F.lit("x"), F.col("k").cast("string")).alias("note"),
    )
    text = F.to_json(payload)
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
    return events.select(
        F.lit("data").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        (F.col("event_time") + F.make_interval(secs=F.lit(5))).alias("timestamp"),
        F.when(in_header, F.array(header("Source", F.lit("old")), header("SOURCE", F.col("source")), header("schema_version", version)))
        .otherwise(F.array().cast("array<struct<key:string,value:binary>>")).alias("headers"),
        F.when(is_broken(4), F.substring(text, 1, 40)).otherwise(text).cast("binary").alias("value"),
    )


MESSAGE_FIELDS = {
    "event_type": ("STRING", "dynamic_categorical"),
    "amount_cents": ("LONG", "dynamic_numeric"),
    "risk.device_type": ("STRING", "dynamic_categorical"),
    "risk.k": ("INT", "dynamic_numeric"),
}


def message_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows for the two sources seen in the messages."""
    columns = F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(c).alias("category")) for p, (t, c) in MESSAGE_FIELDS.items()
    ])
    pairs = cdp_events(spark, sf_dir).select("source", F.col("schema_version").alias("version")).distinct()
    return pairs.select("source", "version", F.lit("metadata.customer_id").alias("key_field"), F.lit(4).alias("total_fields"), columns.alias("columns"))


def schema_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema messages from part: brand as source, type as version, one message per part.

    Sizes divisible by ten declare an unknown type, which makes the message invalid. Messages come over
    many topic partitions; the test file is one, so it is spread here.
    """
    words = F.split("p_name", " ")
    kind = F.when(F.col("p_size") % 10 == 0, F.lit("DECIMAL")).when(F.col("p_partkey") % 2 == 0, F.lit("int")).otherwise(F.lit("STRING"))
    value = F.format_string(
        '{"metadata":{"schema_version":"%s","source":"%s"},"total_fields":%d,"structure":{"%s":{"%s":{"type":"%s","category":"Dynamic_Numeric"}},'
        '"size_%d":{"type":"LONG","category":"static_numeric"}}}',
        F.col("p_type"), F.col("p_brand"), F.col("p_size"), F.element_at(words, 1), F.element_at(words, 2), kind, F.col("p_size"),
    )
    spread = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    return spread.select(F.col("p_partkey").alias("offset"), value.alias("value"))


def arrivals_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cdp_events in arrival order (offset = event_id); every 20th event time lies 30 minutes back."""
    late = F.when(F.col("event_id") % 20 == 0, F.col("event_time") - F.make_interval(mins=F.lit(30))).otherwise(F.col("event_time"))
    return cdp_events(spark, sf_dir).select(
        "event_id", "customer_id", F.lit("data").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), late.alias("event_time"),
    )


def field_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cdp_events with the long shape: a map of field texts."""
    names = ("event_type", "device_type", "login_channel", "k", "amount_cents")
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return cdp_events(spark, sf_dir).select(
        "event_id", "customer_id", "event_time", "source", "schema_version", F.create_map(*pairs).alias("fields")
    )


# ---- many rules ---------------------------------------------------------------------

def rules_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per part, with triggers derived from its key and size (JSON text in `body`)."""
    key, size = F.col("p_partkey"), F.col("p_size")
    device = F.element_at(F.array(*map(F.lit, DEVICES)), (key % 4 + 1).cast("int"))
    channel = lambda shift: F.element_at(F.array(*map(F.lit, CHANNELS)), ((key + shift) % 5 + 1).cast("int"))
    first = F.concat(
        F.format_string('{"field":"device_type","op":"==","value":"%s"},{"field":"login_channel","op":"IN","value":["%s","%s"]}', device, channel(0), channel(2)),
        F.when(key % 2 == 1, F.format_string(',{"field":"k","op":"BETWEEN","value":[%d,%d]}', size, size + 20)).otherwise(F.lit("")),
    )
    second = F.when(key % 3 == 0, F.format_string(',[{"field":"k","op":"==","value":%d},{"field":"event_type","op":"==","value":"view"}]', key % 100)).otherwise(F.lit(""))
    conditions = F.when(key % 50 == 0, F.lit("[]")).otherwise(F.concat(F.lit("[["), first, F.lit("]"), second, F.lit("]")))
    body = F.concat(
        F.format_string('{"rule_id":"P%d","trigger_criteria":[{"source":"B","schema_version":"v2","conditions":', key), conditions,
        F.lit('}],"condition_tree":{"type":"CONDITION","expression":{"field":"B.v2.amount_cents","op":">","value":0}}}'),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("rule_id"), (key % 7 != 0).alias("is_active"), body.alias("body")
    )


def rules_of_all_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per part whose trigger is of one of ten shapes, by its key."""
    key, size = F.col("p_partkey"), F.col("p_size")
    one = lambda text, *args: F.format_string(text, *args)
    device = F.element_at(F.array(*map(F.lit, DEVICES)), (key % 4 + 1).cast("int"))
    shapes = [
        one('[[{"field":"k","op":"BETWEEN","value":[%d,%d]}]]', size, size + 3),
        one('[[{"field":"amount_cents","op":">","value":%d},{"field":"amount_cents","op":"<=","value":%d}]]', key * 3, key * 3 + 200),
        one('[[{"field":"k","op":"<","value":%d}],[{"field":"amount_cents","op":">=","value":%d}]]', size % 5, 20000 + key),
        one('[[{"field":"device_type","op":"STARTS_WITH","value":"%s"},{"field":"k","op":"==","value":%d}]]', F.substring(device, 1, 2), key % 100),
        one('[[{"field":"device_type","op":"STARTS_WITH","value":"%s"},{"field":"k","op":"!=","value":%d}]]', F.substring(device, 1, 3), key % 100),
        one('[[{"field":"login_channel","op":"ENDS_WITH","value":"%s"},{"field":"amount_cents","op":"<","value":%d}]]', F.element_at(F.array(*map(F.lit, ("EB", "TM", "NCH"))), (key % 3 + 1).cast("int")), key % 700),
        one('[[{"field":"event_type","op":"CONTAINS","value":"ie"},{"field":"k","op":">","value":%d}]]', 97 - size % 3),
        one('[[{"field":"login_channel","op":"NOT IN","value":["ATM","WEB"]},{"field":"amount_cents","op":"BETWEEN","value":[%d,%d]}],[{"field":"device_type","op":"IN","value":["IOS","%s"]},{"field":"login_channel","op":"==","value":"ATM"},{"field":"k","op":">=","value":%d}]]', key * 5, key * 5 + 90, device, 90 + size % 9),
        one('[[{"field":"device_type","op":"NOT_ENDS_WITH","value":"T"},{"field":"login_channel","function":"LENGTH","op":">","value":%d}]]', 6 + size % 6),
        one('[[{"field":"amount_cents","op":"<","right_field":"k"}],[{"field":"device_type","op":"ENDS_WITH","value":"%s"},{"field":"k","op":"BETWEEN","value":[%d,%d]}]]', F.substring(device, -2, 2), size, size),
    ]
    conditions = F.element_at(F.array(*shapes), (key % 10 + 1).cast("int"))
    body = F.concat(
        F.format_string('{"rule_id":"P%d","trigger_criteria":[{"source":"B","schema_version":"v2","conditions":', key), conditions,
        F.lit('}],"condition_tree":{"type":"CONDITION","expression":{"field":"B.v2.amount_cents","op":">","value":0}}}'),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), key.cast("string")).alias("rule_id"), F.lit(True).alias("is_active"), body.alias("body"))


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema_columns rows of the event sources, for the pairs present in events."""
    items = F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(c).alias("category")) for p, (t, c) in EVENT_FIELDS.items()
    ])
    pairs = cdp_events(spark, sf_dir).select("source", F.col("schema_version").alias("version")).distinct()
    return pairs.select("source", "version", F.inline(items))
