"""Token counts by merging ragged arrays, rank by rank and all sequences at once.

A batch of texts is split into pre-tokens; the different ones become rows of one ragged array of byte
symbols. In each round every sequence merges all places of its own lowest-ranked pair; the symbols that
survive are counted. A pair made by a merge always ranks behind that merge, so the rounds give what
merging one pair after another gives.

No shuffle: each scan task counts its own texts. Memory per task is bounded by a batch of texts and by a
limited table of known pre-tokens.

Defined results: null text counts as empty (0 bytes, 0 tokens). A special string inside a text, such as
<|endoftext|>, is one token, as the library's default has it. Rows of equal id stay separate. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.pretokens import Interner, at_work, split_texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BATCH_CHARS = 4_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merger:
    """Merge rules of one vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        self.base = len(ids) + 1
        self.of_byte = np.array([ids[x] for x in byte_letters()], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left, right, made = (np.array([ids[x] for x in column], np.int64) for column in zip(*((a, b, a + b) for a, b in pairs)))
        order = np.argsort(left * self.base + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.base + right)[order], order, made[order]
        specials = [x["content"] for x in spec.get("added_tokens", []) if x["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def rules(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the largest number if there is no rule) and the symbol that it makes."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = self.keys[at] == pair
        return np.where(known, self.ranks[at], np.iinfo(np.int64).max), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all words, one word after another, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        alive = np.arange(len(raw))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        done_symbols, done_of = [], []
        none = np.iinfo(np.int64).max
        while len(alive):
            of = np.repeat(np.arange(len(alive)), sizes)
            starts = np.cumsum(sizes) - sizes
            rank, made = np.full(len(symbols), none), np.zeros(len(symbols), np.int64)
            inner = np.flatnonzero(of[1:] == of[:-1])
            rank[inner], made[inner] = self.rules(symbols[inner], symbols[inner + 1])
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < none
            if not open_.all():
                closed = ~open_[of]
                done_symbols.append(symbols[closed])
                done_of.append(alive[of[closed]])
            hit = (rank == lowest[of]) & open_[of]
            hit = _every_other(hit)
            symbols = np.where(hit, made, symbols)
            stays = open_[of]
            stays[1:] &= ~hit[:-1]
            symbols = symbols[stays]
            sizes = np.bincount(of[stays], minlength=len(alive))[open_]
            alive = alive[open_]
        if not done_of:
            return np.empty(0, np.int64), np.zeros(len(raw), np.int64)
        of, symbols = np.concatenate(done_of), np.concatenate(done_symbols)
        return symbols[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(raw))


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of hits that follow each other directly (aaa), the first, third and so on: pairs must not overlap."""
    where = np.flatnonzero(hit)
    if len(where) < 2:
        return hit
    new_run = np.ones(len(where), bool)
    new_run[1:] = np.diff(where) > 1
    begin = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
    kept = np.zeros_like(hit)
    kept[where[(np.arange(len(where)) - begin) % 2 == 0]] = True
    return kept


class Counter:
    """Counts tokens of batches of texts; known pre-tokens are kept between batches."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.interner = Interner()
        self.tokens = np.empty(0, np.int32)

    def count(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        owners, parts = range(len(texts)), texts
        special = self.merger.special
        if special and any(special.search(x) for x in texts):
            owners, parts = [], []
            for i, text in enumerate(texts):
                pieces = special.split(text)
                extra[i] = len(pieces) - 1
                owners += [i] * len(pieces)
                parts += pieces
        words, sizes = split_texts(parts)
        numbers, fresh, cleared = self.interner.numbers(words)
        known = self.tokens[:0] if cleared else self.tokens
        if fresh:
            known = np.concatenate([known, self.merger.merge(fresh)[1].astype(np.int32)])
        self.tokens = known
        of = np.repeat(np.asarray(owners, np.int64), sizes)
        return extra + np.bincount(of, weights=known[numbers], minlength=len(texts)).astype(np.int64)


def in_batches(texts: list[str], limit: int = BATCH_CHARS):
    """Slices of `texts` of about `limit` characters each."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def count_tokens(documents: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """`documents` without its text, with n_bytes and n_tokens; vocabulary: a byte-level BPE file of the tokenizers library."""
    path = vocabulary or vocabulary_path()

    @F.pandas_udf("n_bytes long, n_tokens long")
    def counts(column: pd.Series) -> pd.DataFrame:
        texts = column.tolist()
        with at_work() as state:
            counter = state.setdefault(("counter", path), None) or Counter(path)
            state["counter", path] = counter
            found = [counter.count(texts[part]) for part in in_batches(texts)]
        return pd.DataFrame({
            "n_bytes": np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in texts), np.int64, len(texts)),
            "n_tokens": np.concatenate(found) if found else np.empty(0, np.int64),
        })

    # Names of the input may be those of the counts, so they come under one name first.
    others = [c for c in documents.columns if c not in (text, "n_bytes", "n_tokens")]
    counted = documents.select(*others, counts(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("counts"))
    return counted.select(*others, "counts.n_bytes", "counts.n_tokens")


def token_digest(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(documents.select("doc_id", "text"), vocabulary).withColumn("over_limit", F.col("n_tokens") > LIMIT)
