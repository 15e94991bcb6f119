"""Benchmark decontamination: CGK walks and bit sampling propose the passages, the edit distance verifies them.

Items and documents are walked by the same rules (`walks`), items from several starting words, documents from every
word where an item may stand. Sampled keys are tables: the keys of the items are joined to those of the texts, and
a shared key says where the item would begin. Candidates are verified exactly: the edit distance in words between
the item and the best passage near that place must be at most `RATE` of the item's words. The repetitions are
fitted for each size class of items, so that `RECALL` of the items with all allowed edits are proposed wherever the
edits are; an item with none is always found. `Index` is the exact search for all passages within the limit: the
tests hold the walks against it, and `exact_leaks` gives its result.

Which words of a text are walked from is an exact test that loses nothing: an item of n words with e edits keeps
n + 1 - q (e + 1) of its runs of q words, so a word is passed over when no stretch of an item's length around it has
that many runs known from any item. Known runs and known keys are bitmaps of 2^`BITS` bits, whatever the number of
items: a fuller bitmap lets more words and keys through to the join, and changes no result. Words are walked and
verified in blocks of a text, so a long text is spread over many rows; equal texts are verified once.

What travels: items' keys, texts' keys that some item may have, and the words of the blocks in which they stand.
Documents are joined to the hits by the hash of their text.

Defined results: words are lower-cased, without punctuation. Null and empty texts and items match nothing. Items
without an id are looked for too. Repeated rows are judged alone; a repeated item, of one id and text, counts once.
Each document has one hit for each item at most: the one with the fewest edits, the first of equal ones. Other
columns stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm import walks
from pulsegate.llm.common import discard, store, text_or_empty
from pulsegate.llm.pretokens import at_work, lent
from pulsegate.llm.substring_dedup import Words, mixed
from pulsegate.llm.token_counts import in_batches

RATE = walks.RATE
GRAM = 4
# Bits of the maps of known runs and keys: 8 MB each at most.
BITS = 26
# Words of a text in whose block a walk begins.
BLOCK_WORDS = 1024
# Cells of edit matrices filled at once.
CELLS = 1 << 20
BLOCK_ITEMS = 20_000
# Texts searched at once, so that an executor's workers stay small.
BATCH_CHARS = 1_000_000
# Shared runs held at once; one text is never split.
RUNS = 1 << 21
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HITS = "array<struct<item_id: long, edits: int, begin: int, end: int>>"
U = np.uint64
TOP_BITS = 22


def normal(texts: list[str]) -> Words:
    return Words([x.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION) for x in texts])


def longer(keys: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of `size` words from those of one word less."""
    return mixed(keys[: max(0, len(words) - size + 1)] * U(3) ^ words[size - 1 :])


class Index:
    """Items of a block, ready to be looked for in documents."""

    def __init__(self, ids: list[int | None], texts: list[str], rate: float = RATE):
        self.ids, self.words = list(ids), normal(texts)
        self.size = self.words.last - self.words.first
        self.edits = np.floor(self.size * rate + 1e-9).astype(np.int64)
        gram = np.minimum(GRAM, self.size // (self.edits + 1))
        # Runs that are left whatever the edits.
        self.least = self.size + 1 - gram * (self.edits + 1)
        self.tables, keys = {}, np.zeros(len(self.words.hash), U)
        for size in range(1, GRAM + 1):
            keys = longer(keys, self.words.hash, size)
            items = np.flatnonzero(gram == size)
            if len(items):
                self.tables[size] = self._table(keys, size, items)

    def _table(self, keys: np.ndarray, size: int, items: np.ndarray):
        """Which first bits the keys of the items' runs have, and the sorted keys with item and place in it."""
        count = self.size[items] - size + 1
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = np.repeat(items, count)
        own = keys[self.words.first[item] + place]
        known = np.zeros(1 << TOP_BITS, bool)
        known[own >> U(64 - TOP_BITS)] = True
        order = np.argsort(own, kind="stable")
        return known, own[order], item[order], place[order]

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents and items: an item may begin up to its edits behind the place, or before or behind that."""
        found, keys = [np.empty((3, 0), np.int64)], np.zeros(len(words.hash), U)
        for size in range(1, max(self.tables, default=0) + 1):
            keys = longer(keys, words.hash, size)
            if size not in self.tables:
                continue
            known, own, items, places = self.tables[size]
            at = np.flatnonzero(known[keys >> U(64 - TOP_BITS)])
            at = at[words.doc[at] == words.doc[at + size - 1]]
            low = np.searchsorted(own, keys[at], "left")
            many = np.searchsorted(own, keys[at], "right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            docs, upto = words.doc[at], np.cumsum(many)
            begin = 0
            while begin < len(at):
                end = max(begin, int(np.searchsorted(upto, upto[begin] - many[begin] + RUNS, "right")) - 1)
                end = int(np.searchsorted(docs, docs[end], "right"))
                part = many[begin:end]
                row = np.arange(part.sum()) + np.repeat(low[begin:end] - np.cumsum(part) + part, part)
                found.append(self._agreeing(np.repeat(at[begin:end], part) - places[row], np.repeat(docs[begin:end], part), items[row]))
                begin = end
        return tuple(np.concatenate(found, axis=1))

    def _agreeing(self, place, doc, item) -> np.ndarray:
        """Where as many runs as must be left agree on an item's beginning, give or take its edits."""
        order = np.lexsort((place, item, doc))
        place, doc, item = place[order], doc[order], item[order]
        here = np.arange(len(place))
        there = np.minimum(here + self.least[item] - 1, len(place) - 1)
        enough = (here + self.least[item] <= len(place)) & (doc[there] == doc) & (item[there] == item) & (place[there] - place <= self.edits[item])
        place, doc, item = place[enough], doc[enough], item[enough]
        # Places next to each other are verified as one.
        step = self.edits[item] + 1
        found = np.stack([place // step * step, doc, item])
        new = np.ones(len(place), bool)
        new[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
        return found[:, new]

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item_id, edits, begin, end) of each item found, begin and end in words."""
        words = normal(texts)
        out: list[dict] = [{} for _ in texts]
        places, docs, items = self.candidates(words)
        order = np.argsort(self.size[items], kind="stable")  # alike sizes together
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            for doc, item, edits, begin, end in self._verified(words, places[part], docs[part], items[part]):
                found = (edits, begin, end)
                known = out[doc].get(item)
                if known is None or found < known:
                    out[doc][item] = found
        return [[(self.ids[i], e, b, z) for i, (e, b, z) in sorted(x.items())] for x in out]

    def _verified(self, words: Words, place, doc, item):
        n, e = self.size[item], self.edits[item]
        low = np.maximum(place - e, words.first[doc])
        high = np.minimum(place + n + 3 * e, words.last[doc])
        ok = high > low
        low, high, n, e, doc, item = (x[ok] for x in (low, high, n, e, doc, item))
        if not len(low):
            return
        hit, edits, begin, end = passages(words.hash, low, high, self.words.hash, self.words.first[item], self.words.last[item], e)
        start = words.first[doc[hit]]
        yield from zip(doc[hit].tolist(), item[hit].tolist(), edits.tolist(), (begin - start).tolist(), (end - start).tolist())


def passages(text, low, high, pattern, first, last, most):
    """Pairs of which pattern[first:last] is at most `most` edits from a piece of text[low:high]: which, edits, begin, end."""
    sizes = last - first
    best = edit_rows(gathered(text, low, high, 0), gathered(pattern, first, last, 1), sizes, free=True)
    best[np.arange(best.shape[1])[None, :] > (high - low)[:, None]] = 1 << 20
    ends = best.argmin(axis=1)
    hit = np.flatnonzero(best[np.arange(len(ends)), ends] <= most)
    if not len(hit):
        return (np.empty(0, np.int64),) * 4
    # Backwards from the end, to see where the passage begins.
    end = low[hit] + ends[hit]
    back = edit_rows(gathered(text, low[hit], end, 0, back=True), gathered(pattern, first[hit], last[hit], 1, back=True), sizes[hit], free=False)
    back[np.arange(back.shape[1])[None, :] > ends[hit][:, None]] = 1 << 20
    return hit, best[hit, ends[hit]], end - back.argmin(axis=1), end


def gathered(values: np.ndarray, begin, end, fill: int, back: bool = False) -> np.ndarray:
    """A matrix with a row values[begin:end] for each range, or the range backwards, filled up with `fill`."""
    size = end - begin
    steps = np.arange(max(1, int(size.max())))[None, :]
    inside = steps < size[:, None]
    where = end[:, None] - 1 - steps if back else begin[:, None] + steps
    return np.where(inside, values[np.where(inside, where, 0)], U(fill))


def edit_rows(text: np.ndarray, pattern: np.ndarray, sizes: np.ndarray, free: bool) -> np.ndarray:
    """Edit distance of each whole pattern to text[:j] for every j; free: to the best piece of text that ends at j."""
    steps = np.arange(text.shape[1] + 1)
    row = np.tile(np.zeros_like(steps) if free else steps, (len(text), 1))
    for i in range(int(sizes.max())):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (text != pattern[:, i : i + 1]), out=new[:, 1:])
        # A word left out of the text costs one for each step to the right.
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        row = np.where((i < sizes)[:, None], new, row)
    return row


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS):
    """The items in blocks: ids (null ones too) and texts. Items are the query set and are read once."""
    ids, texts = [], []
    for row in benchmark.select(F.col("item_id").cast("long"), text_or_empty()).toLocalIterator():
        ids.append(row[0]), texts.append(row[1])
        if len(ids) >= size:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def hits_of(ids: list[int], texts: list[str]):
    """A column function: the hits of a block of items in each text."""
    key = hashlib.sha256(repr((ids, texts)).encode("utf-8", "surrogatepass")).hexdigest()
    names = ("item_id", "edits", "begin", "end")

    @F.pandas_udf(HITS)
    def hits(column: pd.Series) -> pd.Series:
        rows = column.tolist()
        with at_work() as state:
            if ("items", key) not in state:
                state["items", key] = Index(ids, texts)
            out = [own for part in in_batches(rows, BATCH_CHARS) for own in state["items", key].hits(rows[part])]
        return pd.Series([[dict(zip(names, x)) for x in own] for own in out], dtype=object)

    return hits


def with_hits(documents: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "_hits") -> DataFrame:
    """`documents` and an array of the benchmark items that each text holds: item_id, edits, begin and end in words."""
    found = [hits_of(ids, texts)(text_or_empty(text)) for ids, texts in item_blocks(benchmark)]
    return documents.withColumn(column, F.flatten(F.array(*found)) if found else F.array().cast(HITS))


def exact_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `leaks` by the exact search, which holds blocks of items in every task."""
    rows = with_hits(documents.select("doc_id", "text"), benchmark).select("doc_id", F.explode("_hits").alias("h"))
    return rows.select("doc_id", "h.item_id", "h.edits", F.col("h.begin").alias("begin_word"), F.col("h.end").alias("end_word"))


def runs(size):
    """For items of these sizes: the length of their runs, and how many of those are left whatever the edits."""
    edits = walks.allowed_edits(size)
    gram = np.minimum(GRAM, size // (edits + 1))
    return gram, size + 1 - gram * (edits + 1)


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def item_words(benchmark: DataFrame) -> DataFrame:
    """uid, item_id, words (hashes) and n of each different item that has words."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        with at_work():
            words = normal(texts.tolist())
            return pd.Series([signed(words.hash[a:b]) for a, b in zip(words.first, words.last)], dtype=object)

    items = benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).distinct()
    items = items.select("item_id", hashes("text").alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    return store(items.withColumn("uid", F.monotonically_increasing_id()), "items")


def flat_items(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some items, where each item begins, and its size."""
    size = part["n"].to_numpy(np.int64)
    return np.concatenate([np.asarray(x, np.int64) for x in part["words"]]).view(U), np.cumsum(size) - size, size


def item_runs(items: DataFrame) -> DataFrame:
    """key: the runs of the items, of the lengths that are looked for."""

    @lent
    def each(parts):
        for part in parts:
            if len(part):
                flat, first, size = flat_items(part)
                gram, keys = runs(size)[0], np.zeros(len(flat), U)
                for q in range(1, GRAM + 1):
                    keys = longer(keys, flat, q)
                    own = [keys[f : f + n - q + 1] for f, n in zip(first[gram == q], size[gram == q])]
                    if own:
                        yield pd.DataFrame({"key": signed(np.concatenate(own))})

    return items.select("words", "n").mapInPandas(each, "key long")


def item_keys(items: DataFrame, counts: dict[int, int]) -> DataFrame:
    """key, uid, start: the sampled keys of the items' walks and the word of the item from which each was walked."""

    @lent
    def each(parts):
        for part in parts:
            if len(part):
                flat, first, size = flat_items(part)
                uid = part["uid"].to_numpy(np.int64)
                for window, r, own, start in walks.walks_of(size, counts):
                    yield pd.DataFrame({"key": signed(walks.walk(window, r).keys(flat, first[own] + start)), "uid": uid[own], "start": start.astype(np.int32)})

    return items.select("uid", "words", "n").mapInPandas(each, "key long, uid long, start int")


def bitmap(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words other than 0 of the map of first bits of `key`, at most 2^(BITS - 6) rows: which, and their bits."""
    place = F.shiftrightunsigned("key", 64 - BITS)
    rows = keys.select(F.shiftright(place, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITS}) & 63 AS int))").alias("bit"))
    found = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    return found["slot"].to_numpy(np.int64), found["bits"].to_numpy(np.int64)


class Known:
    """A bitmap as `bitmap` gives it, ready to be asked."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray):
        self.bits = np.zeros(1 << (BITS - 6), U)
        self.bits[slots] = bits.view(U)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> U(64 - BITS)
        return (self.bits[place >> U(6)] >> (place & U(63)) & U(1)).astype(bool)


def stretches_of(sizes: np.ndarray) -> dict[int, dict[int, int]]:
    """By length of runs: how many known runs stand in how many words at least where an item of these sizes stands.

    Sizes of a class are looked for together, by the longest stretch and the fewest runs of them.
    """
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for size, gram, least in zip(sizes.tolist(), *(x.tolist() for x in runs(sizes))):
        groups.setdefault((gram, walks.size_class(size)), []).append((size + int(walks.allowed_edits(size)), least))
    out: dict[int, dict[int, int]] = {}
    for (gram, _), own in groups.items():
        out.setdefault(gram, {})[max(span for span, _ in own)] = min(least for _, least in own)
    return out


def live_words(words: Words, known: Known, stretches: dict[int, dict[int, int]]) -> np.ndarray:
    """The words around which an item may stand; stretches: by length of runs, how many are left in how many words."""
    total = len(words.hash)
    change, keys = np.zeros(total + 1, np.int64), np.zeros(total, U)
    for q in range(1, max(stretches, default=0) + 1):
        keys = longer(keys, words.hash, q)
        if q not in stretches or not len(keys):
            continue
        seen = known.has(keys)
        seen &= words.doc[: len(keys)] == words.doc[q - 1 :]
        if not seen.any():
            continue
        upto = np.concatenate([[0], np.cumsum(seen)])
        for span, least in stretches[q].items():
            begin = np.arange(len(keys))
            end = np.minimum(begin + span, len(keys))
            full = begin[upto[end] - upto[begin] >= least]
            change[full] += 1
            change -= np.bincount(np.minimum(full + span + q, total), minlength=total + 1)
    return np.flatnonzero(np.cumsum(change[:total]) > 0)


def text_blocks(documents: DataFrame, runs_map, keys_map, windows: list[tuple[int, int]], stretches, margin: int) -> DataFrame:
    """text_key, block, low, words, keys, at: blocks of texts that share keys with items.

    `words` begin at word `low` of the text, `margin` words before the first of `at`, the words whose walks have `keys`.
    """

    @lent
    def each(parts):
        known, wanted = Known(*runs_map), Known(*keys_map)
        pad = np.zeros(max((w for w, _ in windows), default=0) + 1, U)
        for part in parts:
            texts, names = part["text"].tolist(), part["text_key"].to_numpy()
            for rows in in_batches(texts, BATCH_CHARS):
                words = normal(texts[rows])
                live = live_words(words, known, stretches)
                if not len(live):
                    continue
                flat, found = np.concatenate([words.hash, pad]), []
                for window, r in windows:
                    keys = walks.walk(window, r).keys(flat, live)
                    hit = wanted.has(keys)
                    found.append((live[hit], keys[hit]))
                at, keys = (np.concatenate(x) for x in zip(*found))
                doc = words.doc[at]
                place = at - words.first[doc]
                order = np.lexsort((place, doc))
                at, keys, doc, place = at[order], keys[order], doc[order], place[order]
                block = place // BLOCK_WORDS
                edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])) if len(at) else np.empty(0, np.int64)
                out = []
                for a, b in zip(edges, np.append(edges[1:], len(at))):
                    first, last = words.first[doc[a]], words.last[doc[a]]
                    low, high = max(first, first + place[a] - margin), min(last, first + place[b - 1] + margin)
                    out.append((names[rows][doc[a]], block[a], low - first, signed(words.hash[low:high]), signed(keys[a:b]), place[a:b]))
                if out:
                    yield pd.DataFrame(out, columns=["text_key", "block", "low", "words", "keys", "at"])

    texts = documents.select(text_or_empty().alias("text")).withColumn("text_key", F.sha2("text", 256))
    found = texts.mapInPandas(each, "text_key string, block long, low long, words array<long>, keys array<long>, at array<long>")
    # Equal texts have equal blocks.
    return found.dropDuplicates(["text_key", "block"])


def verified(pairs: DataFrame) -> DataFrame:
    """text_key, uid, edits, begin, end of the pairs (low, words, n, pattern) within the limit."""

    @lent
    def each(parts):
        for part in parts:
            sizes, spans = part["n"].to_numpy(np.int64), part["words"].map(len).to_numpy(np.int64)
            order, at = np.argsort(sizes, kind="stable"), 0
            while at < len(order):
                # Alike sizes together, as many as fit: a long item among short ones would cost each of them its length.
                upto = min(at + 1024, int(np.searchsorted(sizes[order], 2 * sizes[order[at]], "right")))
                upto = min(upto, at + max(1, CELLS // int(max(1, spans[order[at:upto]].max()))))
                own = order[at:upto]
                at = upto
                text, pattern = (np.concatenate([np.asarray(x, np.int64) for x in part[c].iloc[own]]).view(U) for c in ("words", "pattern"))
                span, size = spans[own], sizes[own]
                high, last = np.cumsum(span), np.cumsum(size)
                hit, edits, begin, end = passages(text, high - span, high, pattern, last - size, last, walks.allowed_edits(size))
                if len(hit):
                    rows = part.iloc[own[hit]]
                    shift = rows["low"].to_numpy(np.int64) - (high - span)[hit]
                    yield pd.DataFrame({
                        "text_key": rows["text_key"].to_numpy(), "uid": rows["uid"].to_numpy(),
                        "edits": edits.astype(np.int32), "begin": begin + shift, "end": end + shift,
                    })

    return pairs.mapInPandas(each, "text_key string, uid long, edits int, begin long, end long")


def text_hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """text_key (SHA-256), item_id, edits, begin, end: the items that each different text holds. Written before it is read."""
    items = item_words(benchmark)
    sizes = np.array(sorted(r.n for r in items.select("n").distinct().collect()), np.int64)
    counts = walks.plan(int(sizes.max(initial=0)))
    keys = store(item_keys(items, counts), "item-keys")
    stretches = stretches_of(sizes)
    windows = sorted({(w, r) for w, r, _, _ in walks.walks_of(sizes, counts)})
    margin = 2 * int(sizes.max(initial=0)) + 1
    blocks = store(text_blocks(documents, bitmap(item_runs(items)), bitmap(keys.select("key")), windows, stretches, margin), "blocks")

    shared = blocks.select("text_key", "block", "low", F.explode(F.arrays_zip("keys", "at")).alias("k"))
    shared = shared.select("text_key", "block", "low", F.col("k.keys").alias("key"), F.col("k.at").alias("at"))
    edits = F.floor(F.col("n") * RATE + 1e-9).cast("long")
    places = shared.join(keys, "key").join(items.select("uid", "n"), "uid")
    # Places next to each other are verified as one.
    place = F.floor((F.col("at") - F.col("start")) / (edits + 1)) * (edits + 1)
    places = places.select("text_key", "block", "uid", "n", place.alias("place")).distinct()
    begin = F.greatest(F.col("place") - edits - F.col("low"), F.lit(0))
    end = F.least(F.col("place") + F.col("n") + 3 * edits - F.col("low"), F.size("whole").cast("long"))
    # Words around the place are cut out before anything else meets a block, whose size follows the longest item.
    spans = (
        places.join(blocks.select("text_key", "block", "low", F.col("words").alias("whole")), ["text_key", "block"])
        .withColumn("from", begin.cast("int")).withColumn("size", (end - begin).cast("int")).filter("size > 0")
        .select("text_key", "uid", "n", (F.col("low") + F.col("from")).alias("low"), F.expr("slice(whole, from + 1, size)").alias("words"))
    )
    pairs = spans.join(items.select("uid", F.col("words").alias("pattern")), "uid")
    best = verified(pairs).groupBy("text_key", "uid").agg(F.min(F.struct("edits", "begin", "end")).alias("h"))
    hits = store(best.join(items.select("uid", "item_id"), "uid").select("text_key", "item_id", "h.*"), "hits")
    for written in (items, keys, blocks):
        discard(written)
    return hits


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, begin_word, end_word: each item in each document that holds it."""
    found = text_hits(documents, benchmark).select("text_key", "item_id", "edits", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"))
    return documents.select("doc_id", F.sha2(text_or_empty(), 256).alias("text_key")).join(found, "text_key").drop("text_key")


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that hold no item."""
    found = text_hits(documents, benchmark).select("text_key").distinct()
    packed = documents.select(F.struct("*").alias("_doc"), F.sha2(text_or_empty(), 256).alias("text_key"))
    return packed.join(found, "text_key", "left_anti").select("_doc.*")
