"""Event and configuration sources: Kafka topics, or files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the Kafka source with headers.
MESSAGE = (
    "topic string, partition int, offset bigint, timestamp timestamp,"
    " headers array<struct<key:string,value:binary>>, key binary, value binary"
)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest", **options: str) -> DataFrame:
    """Event messages as a stream, from the latest offsets on. Needs the Kafka connector on the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    return reader.option("includeHeaders", "true").option("startingOffsets", starting).options(**options).load()


def kafka_table(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A whole configuration topic from the earliest offset, read as a table."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("includeHeaders", "true").option("startingOffsets", "earliest").load()


def file_stream(spark: SparkSession, path: str, form: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Messages of the same shape arriving as files."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def file_table(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(MESSAGE).format(form).load(path)


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """Rule files, each a JSON array of rules or a single rule: (position, rule_id, body).

    Nested parts stay JSON text; position follows the order inside a file.
    """
    rows = spark.read.option("multiLine", "true").option("singleVariantColumn", "rule").json(path)
    body = F.to_json("rule")
    listed = rows.withColumn("rule", F.explode(F.coalesce(F.col("rule").try_cast("array<variant>"), F.array("rule"))))
    return listed.select(
        F.monotonically_increasing_id().alias("position"),
        F.coalesce(F.try_variant_get("rule", "$.rule_id", "string"), F.lit("")).alias("rule_id"), body.alias("body"),
    )
