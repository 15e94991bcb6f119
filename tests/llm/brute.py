"""Plain Python versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, size=13):
    first = {}
    for doc, text, *_ in rows:
        w, key = words(text), LAST if doc is None else doc
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            first[window] = min(first.get(window, LAST), key)
    out = []
    for doc, text, *_ in rows:
        w, key = words(text), LAST if doc is None else doc
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def token_rows(rows, tokenizer):
    return sorted(
        ((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows), key=str,
    )


def token_store(rows, tokenizer):
    start, out = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (LAST if r[0] is None else r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return sorted(out, key=str)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= most * sizes[s]}
        if not above:
            return share | {s: most * sizes[s] for s in full}
        full |= above


def chats(rows, trained="assistant"):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == trained)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def line_dedup(rows, chars=40, docs=5):
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    lines = [(LAST if d is None else d, d, (t or "").split("\n")) for d, t, *_ in rows]
    count, last = Counter(), {}
    for order, _, own in lines:
        for k in {key(x) for x in own}:
            if len(k) >= chars:
                count[k] += 1
                last[k] = max(last.get(k, order), order)
    out = []
    for order, doc, own in lines:
        kept = [x for x in own if count[key(x)] < docs or last[key(x)] == order]
        out.append((doc, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def quality_base(rows):
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        w = words(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                repeat.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if words(x)]
        out.append((
            doc, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat),
            len(w) < 20 or 100 * len(repeat) > 30 * len(w),
        ))
    return sorted(out, key=str)


def labels(size, pairs):
    """The smallest member of each one's component."""
    parent = list(range(size))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(size)]


def simhash(rows, shingle=4, distance=4):
    import xxhash

    lower = {c: c + 32 for c in range(65, 91)}
    prints = []
    for _, text, *_ in rows:
        w = words((text or "").translate(lower))
        pieces = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    found = labels(len(rows), pairs)
    least = defaultdict(lambda: LAST)
    for i, r in enumerate(rows):
        least[found[i]] = min(least[found[i]], LAST if r[0] is None else r[0])
    return sorted(((r[0], f"{prints[i]:016x}", None if least[found[i]] == LAST else least[found[i]]) for i, r in enumerate(rows)), key=str)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]
