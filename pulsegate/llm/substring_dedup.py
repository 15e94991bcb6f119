"""Substring dedup: seed documents on winnowed anchors, extend the matches, drop repeats of the threshold length or more.

Every window of `WINDOW` words has one anchor: the k-word piece in it with the smallest hash (the last of
equal ones). Equal windows have equal anchors, so documents are joined on anchors, about one for five
words. The windows that share an anchor overlap in one stretch; its hash says at once whether the match
extends both ways over all of them:

1. Stretches are joined on their anchor. Where all stretches of an anchor are equal, the match extends to
   both ends of each: all their windows first start in the smallest document with the anchor.
2. Where stretches of one anchor differ, their windows are joined on anchor and window hash, and each finds
   its own smallest document.
3. In each document the windows found earlier are laid together into maximal runs, and their words go.

Texts are packed in blocks of some hundred documents, compressed. What is joined is combined for each block
first, so an anchor that a third of all documents hold travels once for each block, not once for each
document, and no pairs of documents are ever made. Decisions go back by block, never by the hot key.

Documents are compared by 64-bit hashes under an anchor of 64 bits, so two texts are taken for equal by
chance at odds of about 2^-128 a pair.

Defined results: null and empty texts have no words. A null id counts as larger than all others. Rows of
equal id never precede each other; each is judged against the smaller ids. Other columns are ignored.
"""

from __future__ import annotations

import functools
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegate.llm.common import NO_ID, order_id, store, text_or_empty

WINDOW = 13
PIECE = 4
BLOCK_BYTES = 2_000_000
# Bytes hashed at once; tables of powers of this size stay in each worker.
PART = (1 << 20) - 1
U = np.uint64
# Odd multipliers of the hashes; any others would do.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits."""
    x = x ^ (x >> U(33))
    x = x * MIX_1
    x = x ^ (x >> U(29))
    x = x * MIX_2
    return x ^ (x >> U(32))


@functools.lru_cache(maxsize=8)
def powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to 2^bits."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full((1 << bits) + 1, U(b))
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return tuple(both)


class Ranges:
    """Hashes of any ranges of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        size = max(1, int(len(values)).bit_length())
        self.up, self.down = powers(base, size)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of many texts: where each begins and ends in `raw`, its document and its hash."""

    def __init__(self, texts: list[str] | list[bytes]):
        encoded = [x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass") for x in texts]
        self.raw = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        edges = np.cumsum(lengths)
        blank = _BLANK[self.raw]
        self.begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        self.end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        self.first = np.searchsorted(self.begin, edges - lengths)  # of each document; its last word is before the next first
        self.last = np.searchsorted(self.begin, edges)
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        letters = mixed(np.arange(1, 257).astype(U))
        found, at = [], 0
        while at < len(self.begin):
            # Long texts in parts, so that what is held stays small beside the text.
            upto = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + PART, side="right")))
            base = self.begin[at]
            part = Ranges(letters[self.raw[base : self.end[upto - 1]]], BYTE_BASE)
            found.append(part.of(self.begin[at:upto] - base, self.end[at:upto] - base))
            at = upto
        return np.concatenate(found) if found else np.empty(0, U)


class Stretches:
    """Windows of the words, their anchors, and the stretches of windows with one anchor."""

    def __init__(self, words: Words, window: int, piece: int):
        self.words, self.window = words, window
        n = len(words.hash) - window + 1
        none = np.empty(0, np.int64)
        if n <= 0:
            self.start, self.anchor, self.run, self.hash, self.first_run = none, np.empty(0, U), none, np.empty(0, U), none
            return
        ranges = self.ranges = Ranges(words.hash, WORD_BASE)
        at = np.arange(len(words.hash) - piece + 1)
        pieces = ranges.of(at, at + piece)
        best, place = pieces[:n].copy(), np.zeros(n, np.int8)
        for j in range(1, window - piece + 1):
            lower = pieces[j : j + n] <= best
            np.copyto(best, pieces[j : j + n], where=lower)
            place[lower] = j
        whole = np.flatnonzero(words.last[words.doc[:n]] - np.arange(n) >= window)  # within one document
        self.start, self.anchor = whole, best[whole]
        spot = whole + place[whole]
        new = np.ones(len(whole), bool)
        new[1:] = spot[1:] != spot[:-1]
        self.first_run = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        last = np.append(self.first_run[1:], len(whole)) - 1 if len(whole) else none
        begin, end = whole[self.first_run], whole[last] + window
        shape = mixed(((end - begin) * 256 + (spot[self.first_run] - begin)).astype(U))
        self.hash = mixed(ranges.of(begin, end) ^ shape)

    def window_hash(self, which: np.ndarray) -> np.ndarray:
        return self.ranges.of(self.start[which], self.start[which] + self.window)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def combined(keys: np.ndarray, docs: np.ndarray, more: np.ndarray | None = None):
    """For each different key: the key, smallest and largest document, smallest and largest of `more`."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    found = [keys[at]]
    for values in (docs, more):
        if values is not None:
            values = values[order]
            found += [np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)] if len(at) else [values, values]
    return found


def packed(ids, texts: list[str]) -> bytes:
    out = io.BytesIO()
    frame = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
    with pa.ipc.new_file(out, frame.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(frame)
    return out.getvalue()


def unpacked(payload: bytes) -> tuple[np.ndarray, list[str]]:
    frame = pa.ipc.open_file(payload).read_all()
    return frame["id"].to_numpy(), frame["text"].to_pylist()


def pack_blocks(documents: DataFrame) -> DataFrame:
    """block, payload: the documents in compressed blocks, stored in the shared folder."""

    def blocks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist()):
                ids.append(doc), texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield pd.DataFrame({"block": [number], "payload": [packed(ids, texts)]})
                    number, held = number + 1, 0
                    ids.clear(), texts.clear()
        if ids:
            yield pd.DataFrame({"block": [number], "payload": [packed(ids, texts)]})

    rows = documents.select(order_id().alias("id"), text_or_empty().alias("text"))
    return store(rows.mapInPandas(blocks, "block long, payload binary"), "text-blocks")


def remove_repeats(documents: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, removed (array of begin and end of each maximal run of words that goes), kept (the text that stays)."""

    def stretches(payload) -> tuple[np.ndarray, Stretches]:
        ids, texts = unpacked(payload)
        words = Words(texts)
        return ids, Stretches(words, window, piece)

    def seeds(batches):
        for batch in batches:
            for block, payload in zip(batch["block"], batch["payload"]):
                ids, found = stretches(payload)
                at = found.first_run
                docs = ids[found.words.doc[found.start[at]]] if len(at) else np.empty(0, np.int64)
                anchors, least, most, low, high = combined(signed(found.anchor[at]), docs, signed(found.hash))
                yield pd.DataFrame({"anchor": anchors, "block": block, "least": least, "most": most, "low": low, "high": high})

    blocks = pack_blocks(documents)
    by_block = blocks.repartition("block")
    group = Window.partitionBy("anchor")
    seeded = blocks.mapInPandas(seeds, "anchor long, block long, least long, most long, low long, high long")
    judged = seeded.select(
        "block", "anchor", "most", F.min("least").over(group).alias("first"), F.max("most").over(group).alias("final"),
        (F.min("low").over(group) != F.max("high").over(group)).alias("differ"),
    )
    shared = store(judged.filter((F.col("final") > F.col("first")) & (F.col("differ") | (F.col("most") > F.col("first")))).select("block", "anchor", "first", "differ"), "repeat-anchors")

    def windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = right["block"].iloc[0] if len(right) else 0
        rows = [pd.DataFrame({"anchor": [], "window": [], "least": [], "most": []}, dtype=np.int64)]
        for payload in left["payload"]:
            ids, found = stretches(payload)
            wanted = np.flatnonzero(_member(signed(found.anchor), np.sort(right["anchor"].to_numpy())))
            if len(wanted):
                anchors, own, docs = signed(found.anchor[wanted]), signed(found.window_hash(wanted)), ids[found.words.doc[found.start[wanted]]]
                order = np.lexsort((own, anchors))
                anchors, own, docs = anchors[order], own[order], docs[order]
                at = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])]))
                rows.append(pd.DataFrame({"anchor": anchors[at], "window": own[at], "least": np.minimum.reduceat(docs, at), "most": np.maximum.reduceat(docs, at)}))
        return pd.concat(rows).assign(block=block)[["anchor", "window", "block", "least", "most"]]

    differing = shared.filter("differ").select("block", "anchor")
    listed = by_block.groupBy("block").cogroup(differing.groupBy("block")).applyInPandas(windows, "anchor long, window long, block long, least long, most long")
    firsts = listed.withColumn("first", F.min("least").over(Window.partitionBy("anchor", "window"))).filter(F.col("most") > F.col("first"))
    decided = shared.filter("NOT differ").select("block", "anchor", F.lit(0).cast("long").alias("window"), F.lit(True).alias("whole"), "first").union(firsts.select("block", "anchor", "window", F.lit(False), "first"))

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = [_kept(*stretches(payload), right) for payload in left["payload"]]
        return pd.concat(frames) if frames else _kept(np.empty(0, np.int64), Stretches(Words([]), window, piece), right)

    done = by_block.groupBy("block").cogroup(decided.groupBy("block")).applyInPandas(cut, "doc_id long, n_words long, begins array<long>, ends array<long>, kept string")
    return done.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.transform(F.arrays_zip("begins", "ends"), lambda x: F.struct(x["begins"].alias("begin"), x["ends"].alias("end"))).alias("removed"), "kept",
    )


def _member(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def _looked_up(values: np.ndarray, keys: np.ndarray, results: np.ndarray) -> np.ndarray:
    """The result of each value, the largest number for values that are no key."""
    found = np.full(len(values), np.iinfo(np.int64).max)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys, results = keys[order], results[order]
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        found = np.where(keys[at] == values, results[at], found)
    return found


def _kept(ids: np.ndarray, found: Stretches, decided: pd.DataFrame) -> pd.DataFrame:
    words = found.words
    removed = np.zeros(len(words.hash), bool)
    if len(found.start) and len(decided):
        docs, alone = ids[words.doc[found.start]], decided["whole"].to_numpy(bool)
        anchors, firsts = decided["anchor"].to_numpy(np.int64), decided["first"].to_numpy(np.int64)
        early = _looked_up(signed(found.anchor), anchors[alone], firsts[alone]) < docs
        if not alone.all():
            which = np.flatnonzero(_member(signed(found.anchor), np.unique(anchors[~alone])))
            own = signed(mixed(found.anchor[which] * U(3) ^ found.window_hash(which)))
            keys = signed(mixed(anchors[~alone].view(U) * U(3) ^ decided["window"].to_numpy(np.int64)[~alone].view(U)))
            early[which] |= _looked_up(own, keys, firsts[~alone]) < docs[which]
        depth = np.zeros(len(removed) + 1, np.int64)
        hits = found.start[early]
        np.add.at(depth, hits, 1)
        np.add.at(depth, hits + found.window, -1)
        removed = np.cumsum(depth[:-1]) > 0
    keep = np.flatnonzero(~removed)
    # The byte behind each kept word becomes a blank, but for the last of a document.
    raw, take = words.raw.copy(), np.zeros(len(words.raw) + 1, np.int8)
    np.add.at(take, words.begin[keep], 1)
    np.add.at(take, words.end[keep], -1)
    mask = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
    inner = keep[:-1][words.doc[keep[:-1]] == words.doc[keep[1:]]] if len(keep) else keep
    raw[words.end[inner]] = 0x20
    mask[words.end[inner]] = True
    text = raw[mask].tobytes()
    sizes = np.bincount(words.doc[keep], weights=words.end[keep] - words.begin[keep], minlength=len(ids)).astype(np.int64)
    sizes += np.bincount(words.doc[inner], minlength=len(ids))
    edges = np.cumsum(sizes)
    # Maximal runs of removed words, in each document.
    first = np.zeros(len(removed) + 1, bool)
    first[words.first[words.first < len(removed)]] = True
    first[-1] = True
    opens = np.flatnonzero(removed & (first[:-1] | ~np.concatenate([[False], removed[:-1]])))
    closes = np.flatnonzero(removed & (first[1:] | ~np.concatenate([removed[1:], [False]])))
    cuts = np.searchsorted(words.doc[opens], np.arange(1, len(ids))) if len(ids) else []
    base = words.first[words.doc[opens]]
    return pd.DataFrame({
        "doc_id": ids, "n_words": words.last - words.first,
        "begins": np.split(opens - base, cuts) if len(ids) else [], "ends": np.split(closes + 1 - base, cuts) if len(ids) else [],
        "kept": [text[b - n : b].decode("utf-8", "replace") for b, n in zip(edges.tolist(), sizes.tolist())],
    })


def repeat_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["begin"])
    return remove_repeats(documents).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
