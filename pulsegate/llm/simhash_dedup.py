"""SimHash near-dedup: fingerprints are split into blocks, joined on blocks, and verified by Hamming distance.

Exact search (`pigeonhole`): of b blocks, two fingerprints that differ in at most d bits share b - d at
least, so they meet under one of the choices of b - d blocks. b is the smallest number at which blocks are
seldom shared by chance; whatever b is, no link is lost.

Search for looser likeness (`shared_blocks`): where d is too large for that, a longer fingerprint is split
several times over into short blocks, and a pair meets if any block is equal. The recall follows from the
block length and is stated with the parameters.

Links are needed for components only, so equal fingerprints are one node, and under each block a spanning
forest of the close pairs is kept instead of all pairs: a fingerprint takes all it is linked to out of the
rest, so that a group of thousands of near copies costs little more than its size.

Search for similar shingle sets (`near_roots`): blocks and Hamming distance only propose pairs there; a link is
a pair whose sets have a Jaccard similarity of `NEAR_SIMILARITY` or more, counted exactly. A forest built on
proposals holds only if all its edges are links, so groups with an edge that is none are searched again with
closer edges, at last pair by pair; what links have connected by then is not proposed again, and no pair is compared twice.
The sets of all documents are larger than the documents and are never written, only those that pairs ask for.

Defined results: null and empty texts and texts without words have fingerprint zero and are linked like any
other. A null id counts as larger than all others, and as a component id only for components without ids.
Rows of equal id and different text are nodes of their own. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import NO_ID, discard, order_id, store, text_or_empty
from pulsegate.llm.components import components
from pulsegate.llm.pretokens import at_work, lent
from pulsegate.llm.substring_dedup import mixed

SEED = 42
SHINGLE, DISTANCE = 4, 4
# The pipeline's likeness: five words, similarity 0.8. Fingerprints of such pairs differ in 39 of 256 bits, give
# or take 6; 46 lets nine tenths of them pass to the exact test, nearly all of those at 0.85 and more. Each of the 64 blocks of
# 16 bits is equal at odds of 0.07 at 39 bits (recall 0.99) and of 0.04 at 46 (0.94).
NEAR_SHINGLE, NEAR_WORDS, NEAR_DISTANCE, NEAR_SPLITS, NEAR_BITS = 5, 4, 46, 4, 16
NEAR_SIMILARITY = (4, 5)
# Distances up to which a forest's edges are taken for links, search by search.
NEAR_TRUST = (NEAR_DISTANCE, 30, -1)
# Rows of three numbers, broadcast so that the texts of all other documents need not be shuffled.
NEAR_ENDS = 200_000
PART_ROWS = 512
SMALL_GROUP = 8
SLICE = 1 << 15


def shingles(text: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles in their order; a text of fewer words is one shingle."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, "<u8")
    joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    size = min(shingle, len(parts))
    starts = (np.concatenate([[0], ends[:-1]]))[: len(parts) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())], "<u8")


def fingerprint(text: str, shingle: int, words: int = 1) -> np.ndarray:
    """64 bits for each of `words`: a bit is set if it is in over half of the shingles' hashes."""
    return majority(shingles(text, shingle), words)


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, "<u8")
    if not len(hashes):
        return out
    for k in range(words):
        own = hashes if not k else mixed(hashes + np.uint64(k))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(own), SLICE):
            counts += np.unpackbits(own[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(own), bitorder="little").view("<u8")[0]
    return out


def with_fingerprints(documents: DataFrame, shingle: int = SHINGLE, words: int = 1, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns, `id`, `text_key` and the bytes of the fingerprint of each row."""

    @F.pandas_udf("binary")
    def prints(texts: pd.Series) -> pd.Series:
        with at_work():
            return texts.map(lambda x: fingerprint(x, shingle, words).tobytes())

    text = text_or_empty()
    return documents.select(*columns, order_id().alias("id"), F.xxhash64(text).alias("text_key"), prints(text).alias("fingerprint"))


def pigeonhole(nodes: int, bits: int = 64, distance: int = DISTANCE) -> list[np.ndarray]:
    """Masks under which every pair within `distance` is equal at least once."""
    blocks = distance + 1
    while nodes > 4 * 2 ** (bits * (blocks - distance) / blocks) and blocks < bits:
        blocks += 1
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [_mask([p for i in chosen for p in range(cuts[i], cuts[i + 1])], bits) for chosen in combinations(range(blocks), blocks - distance)]


def shared_blocks(bits: int, length: int, splits: int, seed: int = 3) -> list[np.ndarray]:
    """Masks of blocks of `length` bits: `splits` ways to deal the bits into blocks."""
    masks, dice = [], np.random.default_rng(seed)
    for _ in range(splits):
        order = dice.permutation(bits)
        masks += [_mask(order[i : i + length], bits) for i in range(0, bits, length)]
    return masks


def _mask(places, bits: int) -> np.ndarray:
    flags = np.zeros(bits, bool)
    flags[list(places)] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def node_ids(prints: np.ndarray) -> np.ndarray:
    """A number for each fingerprint: itself where it has 64 bits, else a hash."""
    found = prints[:, 0].copy()
    for k in range(1, prints.shape[1]):
        found = mixed(found) ^ mixed(prints[:, k] + np.uint64(k))
    return found.view(np.int64)


def distances(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int64)


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between close fingerprints of one group that connect all that close pairs connect."""
    if len(prints) <= SMALL_GROUP:
        a, b = np.triu_indices(len(prints), 1)
        near = distances(prints[a], prints[b]) <= distance
        return a[near], b[near]
    rest, ends = np.arange(len(prints)), ([], [])
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = distances(prints[at], prints[rest]) <= distance
            if near.any():
                found = rest[near]
                ends[0].append(np.full(len(found), at)), ends[1].append(found)
                queue += found.tolist()
                rest = rest[~near]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in ends)


def links(nodes: DataFrame, masks: list[np.ndarray], distance: int, column: str = "fingerprint") -> DataFrame:
    """a, b: numbers of linked fingerprints, enough of them to connect all that are linked. nodes: different fingerprints."""
    table = np.array(masks)

    @lent
    def keyed(batches):
        for batch in batches:
            raw = batch[column]
            prints = np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)
            for at in range(0, len(raw), 2048):
                part = prints[at : at + 2048]
                masked = part[:, None, :] & table[None, :, :]
                keys = np.tile(np.arange(len(table), dtype=np.uint64), (len(part), 1))
                for k in range(part.shape[1]):
                    keys = mixed(keys + np.uint64(1)) ^ mixed(masked[:, :, k] + np.uint64(k))
                yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), column: np.repeat(raw.to_numpy()[at : at + 2048], len(table))})

    @lent
    def verified(batches):
        held_keys, held = np.empty(0, np.int64), None
        for batch in batches:
            raw = batch[column]
            if not len(raw):
                continue
            keys, prints = batch["key"].to_numpy(), np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)
            if held is not None:
                keys, prints = np.concatenate([held_keys, keys]), np.concatenate([held, prints])
            # The last group may go on in the next batch.
            last = int(np.searchsorted(keys, keys[-1]))
            held_keys, held = keys[last:].copy(), prints[last:].copy()
            yield _edges(keys[:last], prints[:last], distance)
        if held is not None:
            yield _edges(held_keys, held, distance)

    by_key = nodes.select(column).mapInPandas(keyed, f"key long, {column} binary").repartition("key").sortWithinPartitions("key")
    return by_key.mapInPandas(verified, "a long, b long").distinct()


def _edges(keys: np.ndarray, prints: np.ndarray, distance: int) -> pd.DataFrame:
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(keys):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(keys)))
        group = np.cumsum(new) - 1
        small = sizes[group] <= SMALL_GROUP
        # Groups of few: neighbours at distance 1, 2, ... in the sorted rows, all groups at once.
        for step in range(1, SMALL_GROUP):
            left = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if step < len(keys) else []
            if len(left):
                near = left[distances(prints[left], prints[left + step]) <= distance]
                a.append(near), b.append(near + step)
        for start, size in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
            x, y = forest(prints[start : start + size], distance)
            a.append(x + start), b.append(y + start)
    ids = node_ids(prints) if len(prints) else np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": ids[a], "b": ids[b]}).drop_duplicates()


def grouped(prints: DataFrame, distance: int, masks=None) -> DataFrame:
    """fingerprint, first: a row for each different fingerprint; first: the smallest (id, text_key) of its component.

    prints: id, text_key, fingerprint; stored.
    """

    @F.pandas_udf("long")
    def number(raw: pd.Series) -> pd.Series:
        with at_work():
            return pd.Series(node_ids(np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)) if len(raw) else np.empty(0, np.int64))

    least = F.min(F.struct("id", "text_key")).alias("least")
    nodes = store(prints.groupBy("fingerprint").agg(least).withColumn("node", number("fingerprint")), "fingerprints")
    masks = masks if masks is not None else pigeonhole(nodes.count(), distance=distance)
    roots = store(components(links(nodes, masks, distance)), "roots")
    rooted = store(nodes.join(roots, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = store(rooted.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    return store(rooted.join(firsts, "root").select("fingerprint", "first"), "grouped")


def simhash_digest(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    prints = store(with_fingerprints(documents), "simhashes")
    joined = prints.join(grouped(prints, DISTANCE), "fingerprint")
    first = F.col("first.id")
    # Bytes are stored with the lowest first; the digits start with the highest.
    digits = F.lower(F.concat(*(F.substring(F.hex("fingerprint"), 2 * i + 1, 2) for i in reversed(range(8)))))
    return joined.select("doc_id", digits.alias("fingerprint"), F.when(first != NO_ID, first).alias("component_id"))


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingles(text, NEAR_SHINGLE))


def keyed_texts(documents: DataFrame) -> DataFrame:
    """id, text_key, text."""
    text = text_or_empty().alias("text")
    return documents.select(order_id().alias("id"), F.xxhash64(text).alias("text_key"), text)


def with_shingle_sets(documents: DataFrame) -> DataFrame:
    """id, text_key, node, fingerprint and pieces of each row: the fingerprint is that of the set, the node its hash."""

    @lent
    def sets(batches):
        for batch in batches:
            # Sets are larger than their texts; few are held at a time.
            for at in range(0, len(batch), PART_ROWS):
                part = batch.iloc[at : at + PART_ROWS]
                own = [shingle_set(x) for x in part["text"]]
                prints = [majority(x, NEAR_WORDS).tobytes() for x in own]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "text_key": part["text_key"].to_numpy(), "fingerprint": prints, "pieces": pd.Series([x.view(np.int64) for x in own], dtype=object)})

    return keyed_texts(documents).mapInPandas(sets, "id long, text_key long, fingerprint binary, pieces array<bigint>").withColumn("node", F.xxhash64("pieces"))


def proposals(prints: np.ndarray, roots: np.ndarray, distance: int, trust: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Close pairs of one group and whether each was trusted: if the trusted ones are links, so many that no link is lost.

    Members of equal root are connected already.
    """
    rest, found = np.arange(len(prints)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            apart, known = distances(prints[at], prints[rest]), roots[rest] == roots[at]
            near, taken = (apart <= distance) & ~known, (apart <= trust) | known
            found.append((np.full(near.sum(), at), rest[near], apart[near] <= trust))
            queue += rest[taken].tolist()
            rest = rest[~taken]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def near_pairs(nodes: DataFrame, masks: list[np.ndarray], distance: int, trust: int, keys: DataFrame | None = None) -> DataFrame:
    """key, a, b, trusted: proposed pairs of the groups of all keys, or of the given ones. nodes: node, root, fingerprint."""
    table = np.array(masks)

    @lent
    def keyed(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                prints = np.frombuffer(b"".join(part["fingerprint"]), "<u8").reshape(len(part), -1)
                masked = prints[:, None, :] & table[None, :, :]
                own = np.tile(np.arange(len(table), dtype=np.uint64), (len(part), 1))
                for k in range(prints.shape[1]):
                    own = mixed(own + np.uint64(1)) ^ mixed(masked[:, :, k] + np.uint64(k))
                again = {name: np.repeat(part[name].to_numpy(), len(table)) for name in ("node", "root", "fingerprint")}
                yield pd.DataFrame({"key": own.reshape(-1).view(np.int64), **again})

    @lent
    def proposed(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last group may go on in the next batch.
            last = int(np.searchsorted(held["key"].to_numpy(), held["key"].iloc[-1]))
            yield _proposed(held.iloc[:last], distance, trust)
            held = held.iloc[last:]
        if held is not None:
            yield _proposed(held, distance, trust)

    by_key = nodes.select("node", "root", "fingerprint").mapInPandas(keyed, "key long, node long, root long, fingerprint binary")
    if keys is not None:
        by_key = by_key.join(keys, "key", "left_semi").select("key", "node", "root", "fingerprint")
    by_key = by_key.repartition("key").sortWithinPartitions("key")
    return by_key.mapInPandas(proposed, "key long, a long, b long, trusted boolean").distinct()


def _proposed(rows: pd.DataFrame, distance: int, trust: int) -> pd.DataFrame:
    keys, ids, roots = (rows[name].to_numpy() for name in ("key", "node", "root"))
    out = [pd.DataFrame({"key": np.empty(0, np.int64), "a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "trusted": np.empty(0, bool)})]
    if len(rows):
        prints = np.frombuffer(b"".join(rows["fingerprint"]), "<u8").reshape(len(rows), -1)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(keys)))
        group = np.cumsum(new) - 1
        small = sizes[group] <= SMALL_GROUP
        # Groups of few give all close pairs, whose key does not matter.
        for step in range(1, SMALL_GROUP):
            left = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if step < len(keys) else np.empty(0, np.int64)
            near = left[(distances(prints[left], prints[left + step]) <= distance) & (roots[left] != roots[left + step])]
            out.append(pd.DataFrame({"key": 0, "a": ids[near], "b": ids[near + step], "trusted": False}))
        for start, size in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
            a, b, trusted = proposals(prints[start : start + size], roots[start : start + size], distance, trust)
            out.append(pd.DataFrame({"key": keys[start], "a": ids[a + start], "b": ids[b + start], "trusted": trusted}))
    found = pd.concat(out, ignore_index=True)
    least, most = np.minimum(found["a"], found["b"]), np.maximum(found["a"], found["b"])
    return found.assign(a=least, b=most).drop_duplicates()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as `NEAR_SIMILARITY`. sets: node, pieces."""
    one, two = (sets.select(F.col("node").alias(x), F.col("pieces").alias(f"pieces_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    sizes, common = F.size("pieces_a") + F.size("pieces_b"), F.size(F.array_intersect("pieces_a", "pieces_b"))
    part, whole = NEAR_SIMILARITY
    # common / (sizes - common) >= part / whole
    return both.filter(common * (part + whole) >= sizes * part).select("a", "b")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, pieces of each wanted node, stored. wanted: node and its id and text_key, a row for each node.

    rows: id, text_key and pieces, or text, of which only the wanted sets are made.
    """

    @lent
    def sets(batches):
        for batch in batches:
            for at in range(0, len(batch), PART_ROWS):
                part = batch.iloc[at : at + PART_ROWS]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "pieces": pd.Series([shingle_set(x).view(np.int64) for x in part["text"]], dtype=object)})

    known = wanted.count()
    given = "pieces" if "pieces" in rows.columns else "text"
    found = rows.select("id", "text_key", given).join(F.broadcast(wanted) if known <= NEAR_ENDS else wanted, ["id", "text_key"]).select("node", given)
    found = store(found if given == "pieces" else found.mapInPandas(sets, "node long, pieces array<bigint>"), "near-sets")
    # Only rows of equal id and text give a node twice; where there are none the sets are not shuffled.
    if found.count() == known:
        return found
    once = store(found.dropDuplicates(["node"]), "near-sets")
    discard(found)
    return once


def near_roots(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of the nodes that are linked to another. nodes: node, fingerprint, least; stored."""
    masks = shared_blocks(64 * NEAR_WORDS, NEAR_BITS, NEAR_SPLITS)
    own = nodes.select("node", "fingerprint", F.col("node").alias("root"))
    links, judged, keys, roots, rooted = None, None, None, None, None
    for trust in NEAR_TRUST:
        found = store(near_pairs(own, masks, NEAR_DISTANCE, trust, keys), "near-proposals")
        pairs = found.select("a", "b").distinct()
        # Links are of one root by now, so a pair that was compared before is none and is not compared again.
        pairs = store(pairs if judged is None else pairs.join(judged, ["a", "b"], "left_anti"), "near-pairs")
        judged = pairs if judged is None else judged.union(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = store(nodes.join(ends, "node", "left_semi").select("node", "least.id", "least.text_key"), "near-ends")
        sets = sets_of(keyed_texts(documents), wanted)
        true = store(similar(pairs, sets).distinct(), "near-links")
        links = true if links is None else links.union(true)
        # What an earlier search has left is not read any more once the next steps are written.
        done = [x for x in (wanted, sets, rooted, roots, keys) if x is not None]
        roots = store(components(links), "roots")
        keys = store(found.filter("trusted").join(true, ["a", "b"], "left_anti").select("key").distinct(), "near-keys")
        for written in [*done, found]:
            discard(written)
        if keys.isEmpty():
            break
        own = rooted = store(nodes.select("node", "fingerprint").join(roots, "node", "left").select("node", "fingerprint", F.coalesce("root", "node").alias("root")), "near-rooted")
    for written in (links, judged, keys, rooted):
        if written is not None:
            discard(written)
    return roots


def near_representatives(documents: DataFrame) -> DataFrame:
    """The rows of `documents` without near copies: of each component the row of the smallest id stays.

    Rows of equal id and text are one document; they stay or go together.
    """
    # The sets of all documents would take twice their room, so they are not written; `sets_of` makes the few that pairs need again.
    least = F.min(F.struct("id", "text_key")).alias("least")
    nodes = store(with_shingle_sets(documents).groupBy("node").agg(least, F.min("fingerprint").alias("fingerprint")), "near-nodes")
    roots = near_roots(documents, nodes)
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first")).select("first.*")
    kept = store(firsts.select(F.col("id").alias("_id"), F.col("text_key").alias("_key")), "near-firsts")
    for written in (nodes, roots):
        discard(written)
    rows = documents.select(F.struct("*").alias("_doc"), order_id().alias("_id"), F.xxhash64(text_or_empty()).alias("_key"))
    return rows.join(kept, ["_id", "_key"], "left_semi").select("_doc.*")
