"""The streaming jobs: ingest with dead letters, and rules over validated events.

Configuration is read again at the start of every micro-batch and one version is used
for the whole batch, so a change of schemas or rules takes effect with the next batch,
without a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pulsegate.operators import ingest
from pulsegate.operators.audit import evaluation_table, event_log
from pulsegate.operators.schemas import latest_schemas, parse_schemas
from pulsegate.plans.compile import CompiledRules, compile_rules, identity
from pulsegate.plans.fields import Catalogue
from pulsegate.plans.rules import parse_rule
from pulsegate.functions.durations import event_us
from pulsegate.sources.sinks import read_batches, write_batch, write_once
from pulsegate.streaming.processors import STEP, customer_state, marks

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _start(writer: DataStreamWriter, spark: SparkSession, trigger: dict | None, timers: bool = False) -> StreamingQuery:
    """Start a query; batches without data are run only where event-time timers need them.

    A processing-time state step would otherwise ask for such batches without end. The query
    keeps the setting it was started under.
    """
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, str(timers).lower())
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(NO_DATA, before)


def ingest_batch(batch: DataFrame, batch_id: int, schemas: DataFrame, valid_path: str, dead_path: str, **options) -> None:
    """Judge one micro-batch once, write valid events and dead letters."""
    judged = ingest.judge_messages(batch, schemas, **options).persist()
    try:
        write_batch(ingest.valid_events(judged), valid_path, batch_id)
        write_batch(ingest.dead_letters(judged), dead_path, batch_id)
    finally:
        judged.unpersist()


def start_ingest(messages: DataFrame, schema_messages: Callable[[SparkSession], DataFrame], valid_path: str, dead_path: str,
                 checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Ingest job. `schema_messages` reads the schema topic; it is called for every batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        schemas = latest_schemas(parse_schemas(schema_messages(batch.sparkSession)))
        ingest_batch(batch, batch_id, schemas, valid_path, dead_path, **options)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _start(writer, messages.sparkSession, trigger)


def compile_table(rules: DataFrame, columns: DataFrame, bucket: int, **options) -> CompiledRules:
    """Compile the active rules of a rule table; rules that cannot be compiled are listed in `refused`.

    Bodies come to the driver, as Catalyst's plan of them does; only the schemas that rules
    name are read.
    """
    bodies = rules.where("is_active").select("body", "rule_version", "effective_from").toLocalIterator()
    parsed = [parse_rule({**json.loads(r["body"]), "rule_version": r["rule_version"], "effective_from": r["effective_from"]}) for r in bodies]
    return compile_rules(parsed, Catalogue.of_rules(columns, parsed), bucket, **{"on_error": "refuse", **options})


def start_rules(valid: DataFrame, rules: CompiledRules, audit_path: str, checkpoint: str, dataset_rows: Callable[[SparkSession], DataFrame] | None = None,
                reload: Callable[[SparkSession], CompiledRules] | None = None, trigger: dict | None = None, late_path: str | None = None,
                log_path: str | None = None, lateness: str = "10 seconds", ordered: bool = False, waiting_path: str | None = None) -> StreamingQuery:
    """Rule job over a timeline stream: customer state, then verdicts per micro-batch.

    Late rows are not judged; they go to `late_path`. The events themselves go to `log_path`,
    the first audit table. With `ordered` rows are judged in order of time once the watermark
    has passed them. Spark drops late rows before such a step sees them, so `late_path` is refused
    then: split them off first, by a query of its own (split_late).

    `reload` may give a newer rule set per batch; with it all columns are carried, so that new
    rules may read any field. New windows and profile attributes need a restart from the same
    checkpoint, with the rules that have them; what other rules have gathered stays.

    Rules with a sequence or first arrival in their tree need `waiting_path`. Rows whose verdict
    waits for a mark are kept there with the state they met, and the steps that decide the marks
    beside them; `start_marks` closes them. Rows that no mark can change are judged at once.
    """
    if ordered and late_path:
        raise ValueError("with ordered=True late rows never reach the job: split them off before (split_late)")
    if (rules.sequences or rules.arrivals) and not waiting_path:
        raise ValueError("rules with sequences or first arrivals need waiting_path, where their rows wait (see start_marks)")
    base = valid if reload else rules.pruned(valid)
    state = customer_state(base, rules.attributes, rules.metrics, rules.bucket, lateness=lateness, ordered=ordered, ident=identity(base))

    def run(batch: DataFrame, batch_id: int) -> None:
        current = reload(batch.sparkSession) if reload else rules
        unknown = (set(current.metrics) - set(rules.metrics)) | (set(current.attributes) - set(rules.attributes))
        if unknown:
            raise ValueError(f"restart needed, new state: {sorted(unknown)}")
        batch = batch.persist()
        try:
            if late_path:
                write_batch(batch.where("is_late").select(*[f"`{c}`" for c in base.columns]), late_path, batch_id)
            on_time = batch.where("not is_late").drop("is_late")
            if (current.sequences or current.arrivals) and not waiting_path:
                raise ValueError("restart needed: the rules now have sequences or first arrivals, give waiting_path")
            if log_path:
                write_batch(event_log(on_time.select(*[f"`{c}`" for c in base.columns])), log_path, batch_id)
            rows = current.with_members(on_time, dataset_rows(batch.sparkSession) if dataset_rows else None)
            verdicts = current.judge(rows, plans=current.deferred(False))
            if waiting_path:
                verdicts = verdicts.unionByName(_set_aside(current, rows, waiting_path, batch_id))
            write_batch(evaluation_table(verdicts), audit_path, batch_id)
        finally:
            batch.unpersist()

    writer = state.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _start(writer, valid.sparkSession, trigger, timers=ordered)


def _set_aside(rules: CompiledRules, rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Writes the rows that wait for a mark and then the steps that decide it; the verdicts that wait for none."""
    steps = rules.mark_steps(rows, keep=("watermark_us",)).persist()
    try:
        needs = steps.where("role <> 'B'").groupBy("ident").agg(F.collect_set("mark").alias("needs"))
        named = rows.withColumns({"ident": F.col(identity(rows)).cast("string"), "event_us": event_us()})
        every = named.join(needs, "ident", "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
        # Columns are named by what rules read; files get plain names.
        names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
        plain = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
        write_once(every.where(F.size("needs") > 0).select("ident", "event_us", "needs", F.lit(json.dumps(names)).alias("names"), *plain), f"{path}/rows", batch_id)
        write_once(steps, f"{path}/steps", batch_id)
        none = F.array().cast("array<string>")
        return rules.judge_known(rules.with_marks(every).withColumns({"had": F.lit(None).cast("array<string>"), "have": none}))
    finally:
        steps.unpersist()


def start_marks(spark: SparkSession, rules: CompiledRules, waiting_path: str, audit_path: str, checkpoint: str, trigger: dict | None = None,
                numeric_ids: bool = False) -> StreamingQuery:
    """Closes what `start_rules` has set aside: decides the marks and gives each verdict that has all it waited for.

    A verdict is written in the batch that brings its last mark, to `audit_path`, a folder of its
    own beside that of the rule job. Waiting rows and earlier marks are looked up by the event
    times of the rows that the batch decides. `numeric_ids`: row ids are whole numbers and ordered
    as such. A mark counts under the rules given here; with other rules, restart both queries.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_once(batch, f"{waiting_path}/marks", batch_id)
            first, last = batch.agg(F.min("event_us"), F.max("event_us")).head()
            if first is None:
                return
            span = F.col("event_us").between(first, last)
            known = read_batches(spark, f"{waiting_path}/marks").where(span & (F.col("batch_id") <= batch_id))
            flags = known.join(batch.select("ident").distinct(), "ident", "left_semi")
            had = F.collect_set(F.when(F.col("batch_id") < batch_id, F.col("mark")))
            marked = flags.groupBy("ident").agg(F.collect_set("mark").alias("have"), had.alias("had"))
            given = read_batches(spark, f"{waiting_path}/rows").where(span)
            names = json.loads(given.select("names").head()[0])
            rows = given.join(marked, "ident").select("ident", "needs", "had", "have", *[F.col(n).alias(c) for c, n in names.items()])
            write_batch(evaluation_table(rules.judge_known(rules.with_marks(rows, flags))), audit_path, batch_id)
        finally:
            batch.unpersist()

    steps = spark.readStream.schema(STEP).parquet(f"{waiting_path}/steps")
    writer = marks(steps, numeric_ids).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _start(writer, spark, trigger, timers=True)


def start_append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, timers: bool = False) -> StreamingQuery:
    """Plain sink for late events, first arrivals and, with `timers`, sequences."""
    writer = rows.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id)).option("checkpointLocation", checkpoint)
    return _start(writer, rows.sparkSession, trigger, timers)
