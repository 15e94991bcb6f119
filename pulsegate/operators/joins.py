"""Joining a table with configuration: broadcast only below a measured size; steps kept in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.session import checkpoint_dir

BROADCAST_ROWS = 50_000


def small(config: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`config` with a broadcast hint if it has at most `limit` rows.

    Above the limit the frame is returned as it is, and the join is a shuffle whose skewed
    partitions adaptive execution splits.
    """
    return F.broadcast(config) if config.limit(limit + 1).count() <= limit else config


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written to the folder that all executors share and read back.

    Plans that read a step several times, one upon the other, grow with every reading when they are only
    persisted: planning them took longer than the work. Statistics of the files also tell which side is small.
    """
    path = f"{checkpoint_dir(df.sparkSession, '/tmp/checkpoints').rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, config: DataFrame, keys: list[str], spread: list[str], limit: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Inner join of many `rows` with `config` on keys of few values, such as (source, version).

    A small config is broadcast. Otherwise each key is split into `salts` parts by a hash of
    the `spread` columns and the config repeated per part, so that a key with a third of all
    rows is shared by many tasks.
    """
    if config.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(config), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = config.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")
