"""Line dedup: lines found in many documents go, but for the last document that has them.

Lines are exploded, their keys hashed, documents counted for each hash, and the kept lines put
together again by position. Only DataFrame functions are used.

The text travels once, by document. What travels by line is two hashes and an id; counts are combined
before the shuffle, and the few repeated keys are written to the shared folder, so that the join back
reads two plain shuffles and adaptive execution can split a line that a third of all documents have.

Defined results: a null or empty text has one empty line. A null id counts as larger than all others.
Rows of equal id are documents of their own, and where they have the largest id of a line, all of them
keep it. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import BLANKS, lower_ascii, order_id, store, text_or_empty

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _keys(lines: Column, min_chars: int) -> Column:
    """Of each line that is long enough: its position and two hashes of its key."""
    keyed = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long_ones = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    return F.transform(long_ones, lambda x: F.struct(x["pos"], F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("2"), x["key"]).alias("h2")))


def repeated_keys(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, last: hashes of the keys that at least `min_docs` documents have, and the largest id with each."""
    lines = documents.select(order_id().alias("id"), F.split(text_or_empty(), "\n", -1).alias("lines"))
    own = lines.select("id", F.explode(F.array_distinct(F.transform(_keys(F.col("lines"), min_chars), lambda x: F.struct(x["h1"], x["h2"])))).alias("k"))
    return own.groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs).select("h1", "h2", "last")


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, lines, kept (both arrays of strings, in order): a row for each row of `documents`."""
    repeated = store(repeated_keys(documents, min_chars, min_docs), "repeated-lines")
    docs = documents.select("doc_id", order_id().alias("id"), text_or_empty().alias("text")).withColumn("row", F.xxhash64("text"))
    lines = docs.select("id", "row", F.explode(_keys(F.split("text", "\n", -1), min_chars)).alias("k")).select("id", "row", "k.*")
    drops = (
        lines.join(repeated, ["h1", "h2"]).filter(F.col("id") != F.col("last"))
        .groupBy("id", "row").agg(F.collect_set("pos").alias("drops"))
    )
    whole = docs.select("doc_id", "id", "row", F.split("text", "\n", -1).alias("lines"))
    joined = whole.join(drops, ["id", "row"], "left")
    # array_except hashes, so that a document of very many lines takes time in proportion to them.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.transform(places, lambda i: F.element_at(F.col("lines"), i + 1))
    return joined.select("doc_id", "lines", F.when(F.col("drops").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def line_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(documents).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, id, row, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.id <> r.last AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY row
"""
