"""Byte-level BPE pre-tokens of whole batches of texts, as numpy arrays.

The vocabulary file splits texts by the pattern below before it merges bytes:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Here the pattern is evaluated over an array of code points: runs of a class start a pre-token, a blank
before a run belongs to it, and the last of several white space characters stands alone.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import sys
import threading

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
# Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Where a Python worker keeps what its tasks share.
_STATE, _TIMER = "_pulsegate_worker_state", "_pulsegate_worker_timer"
IDLE_SECONDS = 2.0


def worker_state() -> dict:
    """A dict of the Python process, so that its tasks need not load a vocabulary anew."""
    return sys.__dict__.setdefault(_STATE, {})


@contextlib.contextmanager
def at_work():
    """The state of the worker, kept while a batch is worked on and IDLE_SECONDS longer.

    Spark keeps workers for later stages; so what a stage has kept goes when no batch follows, and its
    memory back to the system. Arrow's own pool would keep what its batches took, so they take it from the C library.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    before = sys.__dict__.pop(_TIMER, None)
    if before is not None:
        before.cancel()
    try:
        yield worker_state()
    finally:
        timer = sys.__dict__[_TIMER] = threading.Timer(IDLE_SECONDS, _release)
        timer.daemon = True
        timer.start()


def lent(each):
    """`each`, a function of batches, as one that runs `at_work`."""

    @functools.wraps(each)
    def run(batches):
        with at_work():
            yield from each(batches)

    return run


def _release() -> None:
    if sys.__dict__.get(_TIMER) is not threading.current_thread():
        return  # a batch has come in between
    sys.__dict__.pop(_STATE, None)
    _powers.cache_clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def classes() -> np.ndarray:
    """The class of each code point."""
    state = worker_state()
    if "classes" not in state:
        every = np.arange(0x110000, dtype=np.uint32).view("<U1")
        found = np.full(len(every), OTHER, np.uint8)
        # What has a numeric value is of class N, but for ideographs, which are letters.
        found[np.strings.isnumeric(every)] = NUMBER
        found[np.strings.isalpha(every)] = LETTER
        found[WHITE_SPACE] = SPACE
        state["classes"] = found
    return state["classes"]


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in `codes`, the code points of texts one after another.

    starts: where each text begins; texts must not be empty.
    """
    if not len(codes):
        return np.empty(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True
    first[-1] = True
    run = first.copy()
    run[1:-1] |= kind[1:] != kind[:-1]
    begin = run.copy()
    begin[-1] = False
    spaces = kind == SPACE
    # The last white space character before other text stands alone, or joins the text if it is a blank.
    last = np.flatnonzero(spaces & run[1:] & ~first[1:])
    begin[last] = True
    begin[last[codes[last] == 0x20] + 1] = False
    _contractions(codes, kind, first, run, begin)
    return np.flatnonzero(begin[:-1])


def _contractions(codes, kind, first, run, begin) -> None:
    """A lone apostrophe at the start of a pre-token takes s, t, m, d or re, ve, ll with it."""
    size = len(codes)
    at = np.flatnonzero((codes == 0x27) & begin[:-1])
    at = at[at + 1 < size]
    # The run of the apostrophe must be the apostrophe alone, with letters of the same text behind it.
    at = at[run[at] & run[at + 1] & ~first[at + 1] & (kind[at + 1] == LETTER)]
    if not len(at):
        return
    one = np.isin(codes[at + 1], [ord(c) for c in "stmd"])
    after = np.minimum(at + 2, size - 1)
    pair = (at + 2 < size) & ~first[np.minimum(at + 2, size)]
    two = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        two |= pair & (codes[at + 1] == ord(a)) & (codes[after] == ord(b))
    for hits, length in ((one, 1), (two & ~one, 2)):
        where = at[hits]
        begin[where + 1] = False
        rest = where + 1 + length
        inside = rest[rest < size]
        begin[inside[(kind[inside] == LETTER) & ~first[inside]]] = True


def split_texts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of all texts, and how many each text has."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = boundaries(codes, (ends - lengths)[lengths > 0])
    edges = [*cuts.tolist(), len(codes)]
    words = [joined[a:b] for a, b in zip(edges, edges[1:])] if len(codes) else []
    counts = np.diff(np.searchsorted(cuts, np.concatenate([[0], ends])))
    return words, counts


def codes_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, their code points, where pre-tokens start, and how many each text has."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = boundaries(codes, (ends - lengths)[lengths > 0])
    return joined, codes, cuts, np.diff(np.searchsorted(cuts, np.concatenate([[0], ends])))


class Lexicon:
    """Numbers for pre-tokens, looked up for whole batches by a hash of their code points.

    The code points of a found pre-token are compared with those stored for its number, so nothing rests
    on a hash; what is not found that way is looked up by its text. Holds bounded memory: a table of
    `SLOTS` hashes, at most `MOST_WORDS` pre-tokens and `MOST_CODES` code points, beyond which it starts anew.
    """

    SLOTS = 1 << 21
    MOST_WORDS = 1_000_000
    MOST_CODES = 12_000_000
    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.hashes, self.slots = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.index: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    @property
    def full(self) -> bool:
        return self.used > self.MOST_CODES or len(self.index) > self.MOST_WORDS

    def _hash(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _powers(self.BASE, max(1, len(codes).bit_length()))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint32(1)) * up[: len(codes)], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))

    def numbers(self, joined: str, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """The number of each pre-token, and the texts of those that are new, in order of their numbers."""
        if not len(begin):
            return np.empty(0, np.int64), []
        end = np.append(begin[1:], len(codes))
        h = self._hash(codes, begin, end)
        known = len(self.index)
        found = self._look(codes, begin, end, h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            # One of each hash by its text, then the others by the table again, then what is left by its text.
            one = missing[np.unique(h[missing], return_index=True)[1]]
            found[one] = self._by_text(joined, codes, begin[one], end[one], h[one])
            rest = np.flatnonzero(found < 0)
            found[rest] = self._look(codes, begin[rest], end[rest], h[rest])
            rest = np.flatnonzero(found < 0)
            found[rest] = self._by_text(joined, codes, begin[rest], end[rest], h[rest])
        return found, list(itertools.islice(self.index, known, None))

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.SLOTS - 1)
        return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)

    def _look(self, codes, begin, end, h) -> np.ndarray:
        """Numbers by the table, where the stored code points are those of the pre-token; -1 for the others."""
        first, second = self._slots(h)
        found = np.where(self.hashes[first] == h, self.slots[first], np.where(self.hashes[second] == h, self.slots[second], -1)).astype(np.int64)
        found[(found >= 0) & (self.length[np.maximum(found, 0)] != end - begin)] = -1
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            sizes = (end - begin)[hit]
            starts = np.cumsum(sizes) - sizes
            within = np.arange(int(sizes.sum()))
            same = self.pool[np.repeat(self.at[found[hit]] - starts, sizes) + within] == codes[np.repeat(begin[hit] - starts, sizes) + within]
            found[hit[~np.logical_and.reduceat(same, starts)]] = -1
        return found

    def _by_text(self, joined, codes, begin, end, h) -> np.ndarray:
        """Numbers by the texts themselves; new ones are kept."""
        index, known = self.index, len(self.index)
        found = np.fromiter((index.setdefault(joined[a:b], len(index)) for a, b in zip(begin.tolist(), end.tolist())), np.int64, len(begin))
        new, at = np.unique(found, return_index=True)
        at = at[new >= known]
        if len(at):
            sizes = (end - begin)[at]
            starts = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            self.pool = room(self.pool, self.used + total)
            self.pool[self.used : self.used + total] = codes[np.repeat(begin[at] - starts, sizes) + np.arange(total)]
            upto = known + len(at)
            self.at, self.length = room(self.at, upto), room(self.length, upto)
            self.at[known:upto], self.length[known:upto] = self.used + starts, sizes
            self.used += total
            for way in (0, 1):
                # Of several that want a slot the last one gets it; each takes one slot at most.
                slot = self._slots(h[at])[way]
                free = self.slots[slot] < 0
                self.slots[slot[free]], self.hashes[slot[free]] = found[at][free], h[at][free]
                at = at[self.slots[slot] != found[at]]
        return found


@functools.lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to 2^bits."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full((1 << bits) + 1, np.uint64(b))
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return tuple(both)


def room(array: np.ndarray, size: int) -> np.ndarray:
    """`array` with room for `size` values at least."""
    if size <= len(array):
        return array
    grown = np.empty(max(size, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown


class Interner:
    """Numbers for pre-tokens, and for each number what a tokenizer makes of it.

    Holds at most `limit` pre-tokens between batches; the results do not depend on it.
    """

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self.index: dict[str, int] = {}

    def numbers(self, words: list[str]) -> tuple[np.ndarray, list[str], bool]:
        """The number of each word; the words that are new; whether all earlier numbers were given up."""
        cleared = len(self.index) > self.limit
        if cleared:
            self.index = {}
        index = self.index
        known = len(index)
        for word in set(words).difference(index):
            index[word] = len(index)
        fresh = list(index)[known:] if len(index) > known else []
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words)), fresh, cleared
