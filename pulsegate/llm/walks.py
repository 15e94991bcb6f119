"""CGK walks over words and bit sampling: sequences a few edits apart share sampled keys.

A walk reads words with a random rule for each step: it writes the word it stands on, then stays or goes on, as the
rule says for that word. After an edit two walks fall into step again before long, so a small edit distance
becomes a small Hamming distance. A repetition samples `PLACES` places of the whole walk over a window of a size
class; sequences that agree in all of them share its key. Edits that stand close together may throw a walk off for
good, so an item is walked from several starting words. The number of repetitions is fitted for each size of items:
as many as find the target recall of made-up items with all edits that are allowed, at their beginning,
middle, end, anywhere, or evenly spread from the first word on.
"""

from __future__ import annotations

import functools

import numpy as np

from pulsegate.llm.substring_dedup import mixed

RATE = 0.2
RECALL = 0.98
PLACES = 3
# A walk covers windows of a size class up to this; longer items have more starting words instead.
WIDEST = 48
STARTS, APART = 5, 12
MOST_REPETITIONS = 64
TRIAL_WORDS = 4_000
PLACES_OF_EDITS = ("begin", "middle", "end", "spread", "even")
U = np.uint64


def size_class(size: int) -> int:
    """The largest of 1, 2, 3, 5, 8, 12, 18, ... that is at most `size`."""
    found = 1
    while found < WIDEST and (found * 3 + 1) // 2 <= size:
        found = (found * 3 + 1) // 2
    return found


def starting_words(size: int) -> list[int]:
    """Where the walks of an item of `size` words begin: each has two words at least, where there are two."""
    return [s for s in range(0, size, max(1, min(size // STARTS, APART))) if size - s >= min(size, 2)]


def allowed_edits(size):
    return np.floor(np.asarray(size) * RATE + 1e-9).astype(np.int64)


class Walk:
    """The rules of a repetition for windows of `size` words, and the places that it samples."""

    def __init__(self, size: int, repetition: int):
        dice = np.random.default_rng([size, repetition])
        self.places = np.sort(dice.choice(size, min(PLACES, size), replace=False)).tolist()
        self.rules = dice.integers(0, 2**63, size).astype(U) * U(2) + U(1)
        self.seed = dice.integers(0, 2**63, dtype=np.uint64)

    def keys(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The key of the walk from each of `at`; `words` goes on for a window's size behind the last of them."""
        key, step = np.full(len(at), self.seed, U), 0
        for place in self.places:
            for j in range(step, place):
                at = at + ((words[at] * self.rules[j]) >> U(63)).astype(np.int64)
            key, step = mixed(key * U(3) ^ words[at]), place
        return key


@functools.lru_cache(maxsize=4096)
def walk(size: int, repetition: int) -> Walk:
    return Walk(size, repetition)


def edited(item: np.ndarray, edits: int, where: str, dice) -> np.ndarray:
    """`item` with words changed, left out and put in, in one stretch or spread."""
    size = len(item)
    if where == "even":  # so that starting words are among the edited ones
        places = np.arange(edits) * size // edits
    elif where == "spread":
        places = np.sort(dice.choice(size, edits, replace=False))
    else:
        places = {"begin": 0, "middle": (size - edits) // 2, "end": size - edits}[where] + np.arange(edits)
    out = item.tolist()
    for place in places[::-1].tolist():
        kind = dice.integers(3)
        out[place : place + (kind != 1)] = [] if kind == 2 else [int(dice.integers(2**63))]
    return np.array(out, U)


@functools.lru_cache(maxsize=None)
def repetitions(size: int, recall: float = RECALL) -> int:
    """How many repetitions find items of `size` words at `recall`, the worst place of edits deciding."""
    edits = int(allowed_edits(size))
    if not edits:
        return 1
    dice, trials = np.random.default_rng(size), max(40, TRIAL_WORDS // size)
    items = [dice.integers(0, 2**63, size).astype(U) for _ in range(trials)]
    around = lambda: dice.integers(0, 2**63, edits + 2).astype(U)
    flat = np.concatenate(items)
    worst = 1
    for where in PLACES_OF_EDITS:
        texts = [np.concatenate([around(), edited(x, edits, where, dice), around()]) for x in items]
        owner = np.repeat(np.arange(trials), [len(x) for x in texts])
        text = np.concatenate([*texts, np.zeros(size, U)])
        found = np.zeros(trials, bool)
        for count in range(1, MOST_REPETITIONS + 1):
            for start in starting_words(size):
                rules = walk(size_class(size - start), count - 1)
                left = ~found[owner]
                own = rules.keys(flat, np.arange(trials) * size + start)
                at = np.flatnonzero(left)
                found[owner[at[rules.keys(text, at) == own[owner[at]]]]] = True
            if found.mean() >= recall:
                break
        worst = max(worst, count)
    return worst


def fitted(size: int) -> int:
    """The repetitions for items of a size class: those of its least, middle and largest sizes, and one more."""
    next_class = (size * 3 + 1) // 2
    return 1 + max(repetitions(n) for n in {size, (size + next_class) // 2, next_class - 1})


def plan(largest: int) -> dict[int, int]:
    """Size classes up to that of the largest item and their repetitions; longer items belong to the last class."""
    classes = sorted({size_class(n) for n in range(1, min(largest, 2 * WIDEST) + 1)})
    return {c: fitted(c) for c in classes}


def walks_of(sizes: np.ndarray, counts: dict[int, int]):
    """(size class, repetition, items, starting words) of every walk that items of these sizes take."""
    groups: dict[tuple[int, int], list] = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        items = np.flatnonzero(sizes == size)
        for start in starting_words(size):
            for r in range(counts[size_class(size)]):
                groups.setdefault((size_class(size - start), r), []).append((items, start))
    for (window, r), parts in sorted(groups.items()):
        yield window, r, np.concatenate([i for i, _ in parts]), np.concatenate([np.full(len(i), s) for i, s in parts])
