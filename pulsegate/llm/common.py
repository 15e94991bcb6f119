"""What several text operators share: words, shared folders, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.session import checkpoint_dir

# White space of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
# A document without an id is judged as if its id were larger than all others.
NO_ID = 2**63 - 1

__all__ = ["BLANKS", "NO_ID", "WORD", "checked_broadcast", "discard", "let", "lower_ascii", "order_id", "shared_folder", "store", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir)."""
    base = checkpoint_dir(spark, "/tmp/checkpoints")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what `store` wrote for `df`, which nothing may read any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def order_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def checked_broadcast(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Hints a broadcast when `df`, a table of few narrow columns, has at most `rows` rows; else leaves the join to Spark."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df
