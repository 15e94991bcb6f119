"""Quality rules with adaptive thresholds: quantile sketches for each language and source replace fixed cutoffs.

Every document is measured whole. Measures of documents that pass the base rules go into sketches:
counts of integer bins, exact below 64 and within 1/32 of the value above. Sketches merge by adding
counts, so a group of any size is combined before the shuffle, and the sketches of a language, or of all
documents, are sums of those of its sources. Fences around the quartiles of a group are its thresholds;
a source with too few documents takes those of its language, and a small language those of all.

Only DataFrame functions are used. Nothing but a few numbers of each document is shuffled.

Defined results: null text has no words. Null languages and sources are groups of their own. Rows of equal
id are judged alone. Windows of a text are compared by 64-bit hashes. An empty table gives no rows. Other
columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegate.llm.common import BLANKS, checked_broadcast, let, store, text_or_empty

SPAN = 8
LEAST_WORDS = 20
MOST_REPEATS = 30
SYMBOLS = "#*$%&|<>"
# A group with fewer documents borrows the thresholds of the level above.
LEAST_GROUP = 50


@dataclass(frozen=True)
class Measure:
    """A whole number of each document, and how far beyond the quartiles it may be: `reach` quartile distances and `margin` more."""

    name: str
    sql: str
    low: bool
    high: bool
    reach: int
    margin: int

    def value(self) -> Column:
        return F.expr(self.sql).cast("long")


# Shares in thousandths, lengths in hundredths of a character. Richness compares the logarithms of different
# words and words, so that long texts are not taken for repetitive ones.
MEASURES = (
    Measure("symbols", "floor(1000 * n_symbols / greatest(word_chars, 1))", False, True, 3, 50),
    Measure("dup_lines", "floor(1000 * n_dup_lines / greatest(n_lines, 1))", False, True, 3, 500),
    Measure("word_length", "floor(100 * word_chars / greatest(n_words, 1))", True, True, 4, 100),
    Measure("richness", "floor(1000 * CASE WHEN n_words > 1 AND n_distinct > 0 THEN ln(n_distinct) / ln(n_words) ELSE 1.0 END)", True, False, 3, 50),
)


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words in windows of `span` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(ranked: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(ranked, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

        def total(places: Column) -> Column:
            steps = F.transform(places, lambda p, j: F.least(F.lit(span), F.coalesce(F.get(places, j + 1) - p, F.lit(span))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

        return let(F.sort_array(let(in_order, twice)), total)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (span - 1)), lambda i: F.xxhash64(F.slice(words, i, span)))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) > span, some).otherwise(F.lit(0).cast("long"))


def measured(documents: DataFrame) -> DataFrame:
    """`doc` (the row of `documents`), lang, source and the base numbers of each document."""
    text = text_or_empty()
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    by_word = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w).alias("n_repeat_words"),
    ))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    stripped = F.translate(text, BLANKS, "")
    rows = documents.select(
        F.struct("*").alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        by_word.alias("w"), by_line.alias("l"), F.char_length(stripped).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    return rows.select("doc", "lang", "source", "w.*", "l.*", "word_chars", "n_symbols").withColumn("base_failed", failed)


def bin_of(value: Column) -> Column:
    """The sketch's bin of an integer of 0 or more, by its smallest member: exact below 64, then the highest six bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(numbers: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the counts of each group, from documents that pass the base rules."""
    values = F.array(*(F.struct(F.lit(m.name).alias("measure"), bin_of(m.value()).alias("bin")) for m in MEASURES))
    rows = numbers.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, and low and high of each measure for each group that has documents."""
    levels = None
    for level, (lang, source) in enumerate([("lang", "source"), ("lang", None), (None, None)]):
        group = lambda name: F.col(name) if name else F.lit(None).cast("string")
        merged = sketch.groupBy(F.lit(level).alias("level"), group(lang).alias("lang"), group(source).alias("source"), "measure", "bin").agg(F.sum("n").alias("n"))
        levels = merged if levels is None else levels.union(merged)
    keys = ["level", "lang", "source", "measure"]
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    size = F.sum("n").over(Window.partitionBy(*keys))
    ranked = levels.withColumn("upto", upto).withColumn("size", size)
    quartile = lambda q: F.min(F.when(F.col("upto") * 100 >= q * F.col("size"), F.col("bin")))
    quartiles = ranked.groupBy(*keys).agg(F.max("size").alias("size"), quartile(25).alias("q1"), quartile(75).alias("q3"))
    bounds = []
    for m in MEASURES:
        here = F.col("measure") == m.name
        spread = m.reach * (F.col("q3") - F.col("q1")) + m.margin
        bounds.append(F.max(F.when(here, F.col("q1") - spread)).alias(f"{m.name}_low"))
        bounds.append(F.max(F.when(here, F.col("q3") + spread)).alias(f"{m.name}_high"))
    table = store(quartiles.groupBy("level", "lang", "source").agg(F.max("size").alias("size"), F.struct(*bounds).alias("fence")), "quality-levels")
    own = table.filter("level = 0").select("lang", "source", "size", "fence")
    of_lang = table.filter("level = 1").select(F.col("lang").alias("_lang"), F.col("size").alias("lang_size"), F.col("fence").alias("lang_fence"))
    overall = table.filter("level = 2").select("fence.*").head() or dict.fromkeys(table.schema["fence"].dataType.names)  # one row at most
    all_fence = F.struct(*(F.lit(overall[name]).cast("long").alias(name) for name in table.schema["fence"].dataType.names))
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    chosen = F.when(F.col("size") >= LEAST_GROUP, F.col("fence")).when(F.col("lang_size") >= LEAST_GROUP, F.col("lang_fence")).otherwise(all_fence)
    # Documents of a source where none passes the base rules fail them too, so they need no thresholds.
    return joined.select("lang", "source", chosen.alias("fence")).select("lang", "source", "fence.*")


def judge(numbers: DataFrame, thresholds: DataFrame) -> DataFrame:
    """`numbers` and `kept`: whether a document passes the base rules and lies within the fences of its group."""
    limits = thresholds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = numbers.join(checked_broadcast(limits), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for m in MEASURES:
        value = m.value()
        if m.low:
            within &= value >= F.col(f"{m.name}_low")
        if m.high:
            within &= value <= F.col(f"{m.name}_high")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_digest(documents: DataFrame) -> DataFrame:
    """doc_id, the base numbers, base_failed, kept."""
    numbers = store(measured(documents.select("doc_id", "text", "lang", "source")).withColumn("doc_id", F.col("doc.doc_id")).drop("doc"), "quality-numbers")
    thresholds = store(fences(store(sketches(numbers), "quality-sketches")), "quality-fences")
    return judge(numbers, thresholds).select("doc_id", *NUMBERS, "kept")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of `documents` that the rules keep."""
    # The measures are costly and both the thresholds and the verdicts read them, so they are written once, beside the row.
    numbers = store(measured(documents), "quality-numbers")
    thresholds = store(fences(store(sketches(numbers.drop("doc")), "quality-sketches")), "quality-fences")
    return judge(numbers, thresholds).filter("kept").select("doc.*")


def _sql() -> str:
    """DuckDB SQL for quality_digest, its fences listed from the same measures."""
    long_rows = " UNION ALL ".join(f"SELECT row, lang, source, base_failed, '{m.name}' AS measure, ({m.sql})::BIGINT AS v FROM numbers" for m in MEASURES)
    spec = ", ".join(f"('{m.name}', {m.low}, {m.high}, {m.reach}, {m.margin})" for m in MEASURES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT row, i, array_to_string(list_slice(words, i, i + {SPAN - 1}), ' ') AS w FROM (SELECT row, words, unnest(range(1, len(words) - {SPAN - 2})) AS i FROM docs)),
found AS (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows),
repeats AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + {SPAN})) AS p FROM found WHERE n > 1) GROUP BY row),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
counted AS (SELECT d.row, doc_id, lang, source, len(words) AS n_words, len(list_distinct(words)) AS n_distinct, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM docs d LEFT JOIN repeats r ON d.row = r.row LEFT JOIN lines l ON d.row = l.row),
numbers AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATS} * n_words AS base_failed FROM counted),
vals AS ({long_rows}),
bins AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin FROM vals WHERE NOT base_failed),
leveled AS (SELECT 0 AS level, lang, source, measure, bin FROM bins UNION ALL SELECT 1, lang, NULL, measure, bin FROM bins UNION ALL SELECT 2, NULL, NULL, measure, bin FROM bins),
ranked AS (SELECT *, count(*) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, count(*) OVER (PARTITION BY level, lang, source, measure) AS size FROM leveled),
quartiles AS (SELECT level, lang, source, measure, max(size) AS size, min(bin) FILTER (upto * 100 >= 25 * size) AS q1, min(bin) FILTER (upto * 100 >= 75 * size) AS q3 FROM ranked GROUP BY ALL),
spec(measure, low, high, reach, margin) AS (VALUES {spec}),
fences AS (SELECT q.*, q1 - reach * (q3 - q1) - margin AS least, q3 + reach * (q3 - q1) + margin AS most, low, high FROM quartiles q JOIN spec USING (measure)),
judged AS (SELECT v.row, bool_and((NOT a.low OR v >= CASE WHEN o.size >= {LEAST_GROUP} THEN o.least WHEN l.size >= {LEAST_GROUP} THEN l.least ELSE a.least END)
      AND (NOT a.high OR v <= CASE WHEN o.size >= {LEAST_GROUP} THEN o.most WHEN l.size >= {LEAST_GROUP} THEN l.most ELSE a.most END)) AS within
    FROM vals v LEFT JOIN fences o ON o.level = 0 AND o.measure = v.measure AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
    LEFT JOIN fences l ON l.level = 1 AND l.measure = v.measure AND l.lang IS NOT DISTINCT FROM v.lang
    LEFT JOIN fences a ON a.level = 2 AND a.measure = v.measure GROUP BY v.row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(within, true) AS kept
FROM numbers n JOIN judged j ON n.row = j.row
"""


ORACLE = _sql()
