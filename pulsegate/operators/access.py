"""Access paths: the index key under which an event finds each AND group of the rules' triggers.

Every group is found under one key, made of the predicates that narrow it most:

- two exact predicates (==, IN) on the rarest fields give one key of both (field, value) pairs;
- one exact predicate, or a dataset, gives a key of one;
- the ranges (<, <=, >, >=, BETWEEN on numbers and times) of a field, taken together, give dyadic
  intervals. Between the least and the greatest bound that rules state for the field, whole numbers and
  the gaps between them are the places of its line; a range covers a run of them and is stored as
  the at most 2 log n blocks of that run, while a value has the log n blocks that hold it. A value
  shares exactly one block with each range that it lies in, so the join is by equality and decides
  the predicates. A line with a bound that is no whole number is cut into equal parts; there the
  predicates are verified as well;
- STARTS_WITH and ENDS_WITH give the cut text under its length; a value is cut at the lengths in use.

Groups with none of these, and empty triggers, are candidates always. A group without other predicates than
those of its key needs no verification.

Axes (kind and fields of the keys in use, with the ends of a line or lengths) are configuration: one short row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.operators.joins import kept, small, spread_join

DATASET = "in_dataset:"
# Values of both lists of a pair at most; longer ones are found under the first field alone.
PAIR_VALUES = 256
NUMBERS = ("INT", "LONG", "FLOAT", "DOUBLE")
HOME = ["source", "version"]
KEY = [*HOME, "axis", "value"]
SIG = ["sig", "twin"]
GROUP = [*HOME, "rule_id", "group_id"]
# Parts of a line whose bounds are not all whole numbers, and the size up to which whole numbers have places.
PARTS = 2**30
WHOLE = 2.0**51


def as_number(text: Column, dtype: Column) -> Column:
    """Position of a value on its line: numbers as doubles, times in microseconds."""
    return F.when(dtype == "TIMESTAMP", F.unix_micros(text.try_cast("timestamp")).cast("double")).otherwise(text.try_cast("double"))


def _range_of(op: Column, bounds: Column) -> Column:
    """Low and high bound of a range and whether each counts itself; NULL where the operator is none."""
    first, second = F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1))
    none = F.lit(None).cast("double")
    made = lambda low, low_in, high, high_in: F.struct(low.alias("low"), F.lit(low_in).alias("low_in"), high.alias("high"), F.lit(high_in).alias("high_in"))
    return (
        F.when(op == "BETWEEN", made(first, True, second, True)).when(op == ">", made(first, False, none, True)).when(op == ">=", made(first, True, none, True))
        .when(op == "<", made(none, True, first, False)).when(op == "<=", made(none, True, first, True))
    )


def _axis(kind: str, field: Column, second: Column | None = None) -> Column:
    return F.to_json(F.array(F.lit(kind), field, *([second] if second is not None else [])))


def _place(cuts: Column, value: Column) -> Column:
    """Where a value lies among sorted cuts: 2 i + 1 on the i-th of them, else twice the number of cuts below it."""
    bits = F.sequence(F.lit(30), F.lit(0), F.lit(-1))

    def step(below: Column, bit: Column) -> Column:
        further = below + F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
        return F.when((further <= F.size(cuts)) & (F.get(cuts, (further - 1).cast("int")) < value), further).otherwise(below)

    below = F.aggregate(bits, F.lit(0).cast("long"), lambda n, b: step(n, b).cast("long"))
    return F.when(value.isNotNull(), 2 * below + F.when(F.get(cuts, below.cast("int")) == value, 1).otherwise(0))


def _levels(cuts: Column) -> Column:
    """Blocks above a place: as many levels as the places 0 .. 2 n need."""
    return F.length(F.bin((2 * F.size(cuts)).cast("long")))


def _blocks(first: Column, last: Column, levels: Column) -> Column:
    """The dyadic blocks (level:number) that cover the places first .. last."""
    start = F.struct(first.cast("long").alias("a"), (last + 1).cast("long").alias("b"), F.array().cast("array<string>").alias("out"))
    name = lambda level, at: F.concat_ws(":", level.cast("string"), at.cast("string"))

    def step(s: Column, level: Column) -> Column:
        left = (s["a"] < s["b"]) & (s["a"] % 2 == 1)
        a = F.when(left, s["a"] + 1).otherwise(s["a"])
        right = (a < s["b"]) & (s["b"] % 2 == 1)
        b = F.when(right, s["b"] - 1).otherwise(s["b"])
        none = F.array().cast("array<string>")
        out = F.concat(s["out"], F.when(left, F.array(name(level, s["a"]))).otherwise(none), F.when(right, F.array(name(level, b))).otherwise(none))
        half = lambda x: F.call_function("shiftright", x, F.lit(1))
        return F.struct(F.when(a < b, half(a)).otherwise(F.lit(0)).cast("long").alias("a"), F.when(a < b, half(b)).otherwise(F.lit(0)).cast("long").alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), levels), start, step, lambda s: s["out"])


def _above(place: Column, levels: Column) -> Column:
    """The blocks that hold a place."""
    return F.transform(F.sequence(F.lit(0), levels), lambda n: F.concat_ws(":", n.cast("string"), F.call_function("shiftright", place.cast("long"), n.cast("int")).cast("string")))


def _spot(value: Column, least: Column, most: Column, fine: Column) -> Column:
    """Place of a value on the line between the least and the greatest bound stated, which never falls as values rise.

    fine (all bounds are whole): a place for each whole number and each gap, one for all values below and one for all above.
    """
    held = F.least(F.greatest(value, least - 1), most + 1)
    under = F.floor(held)
    exact = 2 * (under - least.cast("long")) + 2 + F.when(held > under, 1).otherwise(0)
    share = F.coalesce(F.floor(F.try_divide(value - least, most - least) * PARTS), F.lit(0).cast("long"))
    part = F.when(value < least, 0).when(value > most, PARTS + 2).otherwise(share + 1)
    return F.when(value.isNotNull(), F.when(fine, exact).otherwise(part))


def _end(least: Column, most: Column, fine: Column) -> Column:
    """The last place of a line."""
    return F.when(fine, (2 * (most - least) + 4).cast("long")).otherwise(F.lit(PARTS + 2).cast("long"))


def _line_levels(least: Column, most: Column, fine: Column) -> Column:
    return F.length(F.bin(_end(least, most, fine)))


def access_index(
    predicates: DataFrame, index: DataFrame, columns: DataFrame | None = None, weights: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, axes, free): keys as (source, version, axis, value, rule_id, group_id, covered, whole, several), axes in use, and rules that are always candidates.

    `index` are the exact predicates (rule_index). covered: the pred_ids that the key decides; whole: it
    decides the group; several: the rule has more than one group. Without `columns`, the declared fields,
    only exact predicates give keys. `weights` (rule_id, n) tell how many rules a rule stands for.
    """
    # Configuration: each table is kept, or every join below would plan and compute it anew.
    index = kept(index, "index")
    named = index.select(*HOME, "field", "rule_id").distinct()
    counted = named.withColumn("n", F.lit(1)) if weights is None else named.join(weights.select("rule_id", "n"), "rule_id")
    rarity = counted.groupBy(*HOME, "field").agg(F.sum("n").alias("df"))
    listed = index.groupBy(*GROUP, "pred_id", "field").agg(F.collect_set("value").alias("values"))
    item = F.struct("df", "field", "pred_id", "values")
    exact = listed.join(rarity, [*HOME, "field"]).groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias("exact"))
    sizes = predicates.groupBy(*GROUP).agg(F.count("*").alias("size"), F.bool_or(F.col("kind") == "always").alias("always"))
    several = sizes.groupBy(*HOME, "rule_id").agg((F.count("*") > 1).alias("several"))
    groups = sizes.join(exact, GROUP, "left")
    untyped = "source string, version string, field string, type string"
    typed = predicates.sparkSession.createDataFrame([], untyped) if columns is None else columns.select(*HOME, F.col("path").alias("field"), "type")
    plain = predicates.where(F.col("right_field").isNull() & F.col("right_expr").isNull() & F.col("expr").isNull() & ~F.coalesce("is_length", F.lit(False)) & F.col("field").isNotNull())
    others = plain.join(typed, [*HOME, "field"], "left")
    words = F.when(F.col("op") == "BETWEEN", F.from_json("value", "array<string>")).otherwise(F.array("value"))
    bounds = F.transform(words, lambda w: as_number(w, F.col("type")))
    span = F.when(F.col("type").isin(*NUMBERS, "TIMESTAMP") & ~F.exists(bounds, lambda b: b.isNull()), _range_of(F.col("op"), bounds))
    affix = F.when((F.col("type") == "STRING") & (F.length("value") > 0), F.when(F.col("op") == "STARTS_WITH", "prefix").when(F.col("op") == "ENDS_WITH", "suffix"))
    stated = others.select(*GROUP, "pred_id", "field", "type", "value", span.alias("span"), affix.alias("affix"))
    # The ranges of a group on one field are one range: of equal bounds the open one holds.
    low, high = F.col("span.low"), F.col("span.high")
    joint = stated.where("span is not null").groupBy(*GROUP, "field", "type").agg(
        F.max(F.when(low.isNotNull(), F.struct(low.alias("at"), (~F.col("span.low_in")).alias("open")))).alias("_low"),
        F.min(F.when(high.isNotNull(), F.struct(high.alias("at"), F.col("span.high_in").alias("closed")))).alias("_high"),
        F.sort_array(F.collect_list("pred_id")).alias("covered"),
    )
    one_span = F.struct(
        F.col("_low.at").alias("low"), F.coalesce(~F.col("_low.open"), F.lit(True)).alias("low_in"),
        F.col("_high.at").alias("high"), F.coalesce("_high.closed", F.lit(True)).alias("high_in"),
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    held = [*GROUP, "field", "type", "value", "span", "affix", "covered"]
    texts = stated.where("affix is not null").withColumn("covered", F.array("pred_id")).select(*held)
    other = texts.unionByName(joint.withColumns({"span": one_span, "value": nothing("string"), "affix": nothing("string")}).select(*held))
    # Two-sided ranges narrow most, then texts, longer ones first, then half lines.
    closed = F.col("span.low").isNotNull() & F.col("span.high").isNotNull()
    order = F.when(closed, 0).when(F.col("affix").isNotNull(), 1).otherwise(2)
    best = other.groupBy(*GROUP).agg(F.min_by(F.struct("field", "type", "value", "span", "affix", "covered"), F.struct(order, -F.length("value"), "covered")).alias("other"))
    groups = kept(groups.join(best, GROUP, "left").join(several, [*HOME, "rule_id"]), "groups")
    free = kept(groups.where("exact is null and (other is null or always)").select(*HOME, "rule_id").distinct(), "free")
    # A rule that is always a candidate needs no keys.
    groups = groups.join(free, [*HOME, "rule_id"], "left_anti")

    one, two = F.get("exact", F.lit(0)), F.get("exact", F.lit(1))
    paired = F.col("exact").isNotNull() & two.isNotNull() & ~F.startswith(one["field"], F.lit(DATASET)) & ~F.startswith(two["field"], F.lit(DATASET)) & (one["field"] != two["field"])
    paired = F.coalesce(paired & (F.size(one["values"]) * F.size(two["values"]) <= PAIR_VALUES), F.lit(False))
    about = [*GROUP, "several", "covered"]
    decided = F.size("covered") == F.col("size")
    pair_values = F.flatten(F.transform(one["values"], lambda a: F.transform(two["values"], lambda b: F.to_json(F.array(a, b)))))
    pairs = groups.where(paired).withColumn("covered", F.array(one["pred_id"], two["pred_id"])).select(
        *about, decided.alias("whole"), _axis("pair", one["field"], two["field"]).alias("axis"), F.explode(pair_values).alias("value"))
    singles = groups.where(F.col("exact").isNotNull() & ~paired).withColumn("covered", F.array(one["pred_id"])).select(
        *about, decided.alias("whole"), _axis("one", one["field"]).alias("axis"), F.explode(one["values"]).alias("value"))
    groups = groups.withColumn("covered", F.col("other.covered"))
    text = groups.where(F.col("exact").isNull() & F.col("other.affix").isNotNull()).select(
        *about, decided.alias("whole"), _axis("text", F.col("other.affix"), F.col("other.field")).alias("axis"),
        F.concat_ws(":", F.length("other.value").cast("string"), "other.value").alias("value"), F.length("other.value").alias("length"),
    )
    ranges = groups.where(F.col("exact").isNull() & F.col("other.span").isNotNull()).select(*about, decided.alias("whole"), F.col("other.field").alias("field"), F.col("other.type").alias("type"), "other.span.*")
    cut, fine = F.col("cut"), F.col("fine")
    marks = ranges.select(*HOME, "field", "type", F.explode(F.array_compact(F.array("low", "high"))).alias("cut"))
    lines = marks.groupBy(*HOME, "field", "type").agg(
        F.min(cut).alias("least"), F.max(cut).alias("most"), F.bool_and((cut == F.floor(cut)) & (F.abs(cut) <= WHOLE)).alias("fine"))
    lines = kept(lines, "lines")
    line = (F.col("least"), F.col("most"), fine)
    placed = ranges.join(small(lines), [*HOME, "field", "type"])
    first = F.when(F.col("low").isNull(), 0).otherwise(_spot(F.col("low"), *line) + F.when(fine & ~F.col("low_in"), 1).otherwise(0))
    last = F.when(F.col("high").isNull(), _end(*line)).otherwise(_spot(F.col("high"), *line) - F.when(fine & ~F.col("high_in"), 1).otherwise(0))
    spans = placed.select(
        *about, (F.col("whole") & fine).alias("whole"), F.when(fine, F.col("covered")).otherwise(F.array().cast("array<int>")).alias("_covered"),
        _axis("line", F.col("field")).alias("axis"), F.explode(_blocks(first, last, _line_levels(*line))).alias("value"),
    ).drop("covered").withColumnRenamed("_covered", "covered")
    keys = pairs.unionByName(singles).unionByName(text.drop("length")).unionByName(spans)
    keys = kept(keys, "keys")
    ends = lambda: [nothing("string").alias("type"), nothing("double").alias("least"), nothing("double").alias("most"), nothing("boolean").alias("fine")]
    axes = (
        pairs.unionByName(singles).select(*HOME, "axis").distinct().select(*HOME, "axis", *ends(), nothing("array<int>").alias("lengths"))
        .unionByName(text.groupBy(*HOME, "axis").agg(F.collect_set("length").alias("lengths")).select(*HOME, "axis", *ends(), "lengths"))
        .unionByName(lines.select(*HOME, _axis("line", F.col("field")).alias("axis"), "type", "least", "most", "fine", nothing("array<int>").alias("lengths")))
    )
    return keys, kept(axes, "axes"), free


def spots(sigs: DataFrame, axes: DataFrame) -> DataFrame:
    """(source, version, sig, twin, axis, at): the text by which each signature stands on each axis, both of a pair as a JSON list."""
    part = F.from_json("axis", "array<string>")
    rows = sigs.select(*HOME, *SIG, "values").join(small(axes.select(*HOME, "axis")), HOME).withColumn("_part", part)
    kind, field, second = (F.get("_part", F.lit(i)) for i in range(3))
    of = lambda name: F.try_element_at("values", name)
    both = F.when(of(field).isNotNull() & of(second).isNotNull(), F.to_json(F.array(of(field), of(second))))
    at = F.when(kind == "pair", both).when(kind == "text", of(second)).otherwise(of(field))
    return rows.select(*HOME, *SIG, "axis", at.alias("at")).where("at is not null")


def keys_at(spotted: DataFrame, axes: DataFrame) -> DataFrame:
    """`spotted`, rows with source, version, axis and at, with each key (`value`) that holds them."""
    rows = spotted.join(small(axes), [*HOME, "axis"]).withColumn("_part", F.from_json("axis", "array<string>"))
    kind, side, there = F.get("_part", F.lit(0)), F.get("_part", F.lit(1)), F.col("at")
    cut = lambda n: F.when(side == "prefix", F.substring(there, F.lit(1), n)).otherwise(F.substring(there, -n, n))
    texts = F.transform(F.filter("lengths", lambda n: n <= F.length(there)), lambda n: F.concat_ws(":", n.cast("string"), cut(n)))
    line = (F.col("least"), F.col("most"), F.col("fine"))
    place = _spot(as_number(there, F.col("type")), *line)
    blocks = F.when(place.isNotNull(), _above(place, _line_levels(*line)))
    found = F.when(kind.isin("pair", "one"), F.array(there)).when(kind == "text", texts).when(kind == "line", blocks)
    return rows.select(*spotted.columns, F.explode(found).alias("value"))


def dataset_keys(token_rows: DataFrame) -> DataFrame:
    return token_rows.where(F.startswith("field", F.lit(DATASET))).select(*HOME, *SIG, _axis("one", F.col("field")).alias("axis"), "value")


def keys_of(sigs: DataFrame, axes: DataFrame, token_rows: DataFrame | None = None) -> DataFrame:
    """(source, version, sig, twin, axis, value): the keys of each signature on the axes in use; datasets come from the tokens."""
    keyed = keys_at(spots(sigs, axes), axes).drop("at")
    return keyed if token_rows is None else keyed.unionByName(dataset_keys(token_rows))


def found(sigs: DataFrame, keys: DataFrame, axes: DataFrame, free: DataFrame, token_rows: DataFrame | None = None) -> DataFrame:
    """(sig, twin, rule_id, whole): rules of which some group's key is met, and the free ones; whole where a met key decides a group."""
    hits = spread_join(keys_of(sigs, axes, token_rows), keys, KEY, SIG)
    # A key is met once for a group, so only rules of several groups can be found twice.
    once = hits.where("not several").select(*SIG, "rule_id", "whole")
    more = hits.where("several").groupBy(*SIG, "rule_id").agg(F.bool_or("whole").alias("whole"))
    rest = spread_join(sigs, free, HOME, SIG).select(*SIG, "rule_id", F.lit(False).alias("whole"))
    return once.unionByName(more).unionByName(rest)
