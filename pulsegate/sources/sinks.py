"""Sinks that may see a batch twice: each micro-batch owns one partition and replaces it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch; writing it again after a failure leaves the same files' content."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch for a stream that reads it: a batch that is there whole is left as it is."""
    spark = rows.sparkSession
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        write_batch(rows, path, batch_id)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches written so far, with `batch_id`."""
    return spark.read.option("basePath", path).parquet(path).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def write_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Immutable configuration snapshot: rules, schemas, datasets, mappers."""
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One snapshot, by default the newest, pinned for the whole batch that reads it."""
    folder = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = folder.agg(F.max(F.col("version").cast("int"))).first()[0]
    return spark.read.parquet(f"{path}/version={version}")


def write_load(active: DataFrame, history: DataFrame, path: str, load: int) -> None:
    """A rule load: history and active table, both or neither.

    A load counts once its mark is there, and the mark is written last. A load that failed half
    way is written again under its number.
    """
    history.write.mode("overwrite").parquet(f"{path}/load={load}/history")
    active.write.mode("overwrite").parquet(f"{path}/load={load}/active")
    active.sparkSession.range(1).select(F.lit(load).alias("load")).coalesce(1).write.mode("overwrite").parquet(f"{path}/done/load={load}")


def read_load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int] | None:
    """(active table, history of all complete loads, number of the newest one), or None before the first."""
    from pyspark.errors import AnalysisException

    try:
        marks = sorted(r["load"] for r in spark.read.option("basePath", f"{path}/done").parquet(f"{path}/done").select(F.col("load").cast("int").alias("load")).collect())
    except AnalysisException:
        return None
    history = spark.read.parquet(*[f"{path}/load={load}/history" for load in marks])
    return spark.read.parquet(f"{path}/load={marks[-1]}/active"), history, marks[-1]


def replay_dead_letters(spark: SparkSession, path: str, reasons: tuple[str, ...] = ("schema_missing",)) -> DataFrame:
    """Dead letters as messages again, for instance after their schema has arrived."""
    rows = read_batches(spark, path).where(F.col("reject_reason").isin(*reasons))
    return rows.select("topic", "partition", "offset", "timestamp", "headers", F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
