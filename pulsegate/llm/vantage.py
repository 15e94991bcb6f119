"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are dealt into shards of bounded size. A shard is a complete binary tree: each inner node has a
vantage point far from the rest, and its vectors are halved by their distance from it; the least and largest
distance of each half are kept. Shards are written to the shared folder, with points in order of leaves, in
single precision where that holds them exactly.

The queries of a block go through a tree together. A query without a radius first goes down to one leaf, which
gives it one: the distance of its k-th best so far. Then a half is left out where the triangle inequality puts
it beyond `factor` times that radius: the distance d of the query from the vantage point is below the least, or
above the largest, distance of the half by more. At a factor of one nothing nearer can be left out, ties
included, so the search is exact; below one it leaves out more and may miss neighbours. Leaves are read in
order of their bounds, each for all queries that still want it. A leaf is screened by a product of matrices in
single precision: a point stays if it lies within the radius by that product and its largest possible error.
Only for those the distances of the result are taken: squares summed in order of components, in double precision.

The queries are a given set, in blocks. A task has one block and a group of shards, read from the shared folder
by a Cartesian product; a query's radius is carried from shard to shard, and the best k of each query and group
are then cut to the best k of the query, before and after the shuffle. No vectors pass through the driver. A
task holds one shard and one block. The work is the number of queries times that of vectors where trees prune
nothing, so with a set share of queries it grows with the square of the table.

Defined results: vectors that are null, empty, zero, of another length than most (the longer of equally
frequent lengths), or that hold a null or non-finite component, take no part, neither as query nor as
candidate. Rows are told apart by their place, so rows of equal id find each other, and a query row given
twice is answered twice. Ties go to the smaller id, null ids last. A query finds all candidates where there
are fewer than k. An empty table gives no rows. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegate.llm.common import discard, store
from pulsegate.llm.vectors import ROWS, doubles, in_blocks, sound, usual_width

NEIGHBOURS = 10
EVERY = 100
# Of the pruning radius: one is exact.
FACTOR = 1.0
LEAF = 512
SHARD_BYTES = 8_000_000
QUERY_BYTES = 16_000_000
# Shards of a group: enough groups for so many tasks a core, and not more shards than this in one.
TASKS_A_CORE = 4
MOST_SHARDS = 256
# Distances are rounded; a half is left out only if it lies beyond the radius by more.
MARGIN = 1e-9
NO_ROW = -1
# Pairs of a query and a point whose distances are taken at once.
PAIRS = 1 << 14
# Queries that go through a tree at once, and pairs of a query and a leaf.
TOGETHER = 1024
CELLS = 1 << 18
# Where this share of the pairs of a query and a leaf cannot be left out, no leaf is, and so many points are read at once.
WANTED = 0.75
WIDE = 512
# Largest relative errors of a number in single and double precision.
SINGLE, DOUBLE = 2.0**-24, 2.0**-53
# Squares of numbers below this may vanish, so nearer points may seem equally far.
VANISHING = 1e-150
# Squared lengths beyond this do not go through single precision.
WILD = 1e30


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of each row of `points` to each row of `others`, squares summed in order of components."""
    total = np.zeros((len(points), len(others)))
    for a, b in zip(points.T, others.T):
        away = a[:, None] - b[None, :]
        total += away * away
    return np.sqrt(total)


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin, with n at the end; halves differ by one row at most."""
    found = [np.array([0, n])]
    while (sizes := np.diff(found[-1])).max() > leaf:
        begin = found[-1][:-1]
        found.append(np.append(np.column_stack([begin, begin + (sizes + 1) // 2]).ravel(), n))
    return found


def lengths(rows: np.ndarray) -> np.ndarray:
    """Of each row, squares summed in order of components."""
    return np.sqrt(np.add.accumulate(rows * rows, axis=1)[:, -1])


@dataclass
class Best:
    """The k best of each query so far, by distance (inf: none), then key, then label, which is what a row is called."""

    score: np.ndarray
    key: np.ndarray
    label: np.ndarray

    @classmethod
    def none(cls, m: int, k: int) -> Best:
        return cls(np.full((m, k), np.inf), np.full((m, k), np.iinfo(np.int64).max), np.full((m, k), NO_ROW))

    @property
    def radius(self) -> np.ndarray:
        """What a row's distance may not exceed to be among them."""
        return np.maximum(self.score[:, -1], VANISHING)

    def part(self, rows: slice) -> Best:
        """Those of some queries; what they take in is taken in here."""
        return Best(self.score[rows], self.key[rows], self.label[rows])

    def merge(self, who: np.ndarray, score: np.ndarray, key: np.ndarray, label: np.ndarray) -> None:
        """Takes in rows, each for the query `who`. Infinite distances count as none."""
        near = np.flatnonzero((score <= self.score[who, -1]) & np.isfinite(score))
        touched, at = np.unique(who[near], return_inverse=True)
        k = self.score.shape[1]
        of = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        every = [np.concatenate([held[touched].ravel(), new[near]]) for held, new in ((self.score, score), (self.key, key), (self.label, label))]
        order = np.lexsort((every[2], every[1], every[0], of))
        pick = order[np.searchsorted(of[order], np.arange(len(touched)))[:, None] + np.arange(k)]
        for held, both in zip((self.score, self.key, self.label), every):
            held[touched] = both[pick]


class Screen:
    """Points in single precision, moved to their middle and scaled to about one.

    For a query at x and a point at y in these terms, a product of their rows is xy - yy / 2, off by less than
    the query's slack: half of the factor there covers width + 1 products and their sum, roundings to single
    precision included. So points within a radius have a product that is not below the query's threshold.
    """

    def __init__(self, points: np.ndarray):
        with np.errstate(all="ignore"):
            self.middle = (points / len(points)).sum(0)
            y = points - self.middle
            largest = np.abs(y).max()
            self.scale = float(np.ldexp(1.0, -max(int(np.frexp(largest)[1]), -1000))) if 0 < largest < np.inf else 1.0
            y *= self.scale
        self.usable = bool(np.isfinite(y).all())
        if not self.usable:
            y[:] = 0
        square = np.einsum("ij,ij->i", y, y)
        self.reach = float(np.sqrt(square.max()))
        self.rows = np.column_stack([y, -square / 2]).astype(np.float32)

    def moved(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Others in these terms, and their squared lengths."""
        with np.errstate(all="ignore"):
            x = (others - self.middle) * self.scale
            return x, np.einsum("ij,ij->i", x, x)


class Screened:
    """Queries against the points of a screen. Those that are wild have all points stay."""

    def __init__(self, screen: Screen, queries: np.ndarray):
        self.scale = screen.scale
        x, self.square = screen.moved(queries)
        self.wild = ~(self.square < WILD) | (not screen.usable)
        x[self.wild], self.square[self.wild] = 0, 0
        self.x = x
        self.rows = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
        self.size = (np.sqrt(self.square) + screen.reach) ** 2
        self.slack = np.where(self.wild, np.inf, (x.shape[1] + 16) * SINGLE * self.size)

    def threshold(self, radius: np.ndarray) -> np.ndarray:
        """What the product of a point that may lie within the radius is not below."""
        with np.errstate(over="ignore"):
            return ((self.square - (radius * self.scale * (1 + MARGIN)) ** 2) / 2 - self.slack).astype(np.float32)


@dataclass
class Tree:
    """points: in order of leaves; vantage, bounds: of the inner nodes, level by level."""

    points: np.ndarray
    vantage: np.ndarray
    bounds: np.ndarray  # least and largest distance of the first half, then of the second
    leaf: int = LEAF

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree and the order that it puts the points in."""
        order, shape = np.arange(len(points)), levels(len(points), leaf)
        rng = np.random.default_rng(len(points))
        vantage, bounds = [], []
        for edges, below in zip(shape, shape[1:]):
            for node, (a, b) in enumerate(zip(edges, edges[1:])):
                rows, half = order[a:b], below[2 * node + 1] - a
                some = points[rows[rng.integers(len(rows))]]
                far = points[rows[distances(some[None], points[rows])[0].argmax()]]
                d = distances(far[None], points[rows])[0]
                split = np.argpartition(d, half - 1)
                order[a:b], d = rows[split], d[split]
                vantage.append(far)
                bounds.append([d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max()])
        width = points.shape[1]
        return cls(points[order], np.array(vantage).reshape(-1, width), np.array(bounds).reshape(-1, 4), leaf), order

    @cached_property
    def screen(self) -> Screen:
        return Screen(self.points)

    def search(self, queries: np.ndarray, k: int, factor: float, key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in `points` (NO_ROW: none) and distances of the k best of each query, and how many distances were taken or screened.

        key: decides between equal distances, smaller first; own: the place of each query itself, or NO_ROW.
        """
        best = Best.none(len(queries), k)
        taken = self.update(best, queries, factor, key, own, np.arange(len(self.points)))
        return best.label, best.score, taken

    def update(self, best: Best, queries: np.ndarray, factor: float, key: np.ndarray, own: np.ndarray, label: np.ndarray) -> int:
        """Takes the points into the best of each query, under their labels."""
        shape, taken = levels(len(self.points), self.leaf), 0
        spare = self._spare(key, label, best.score.shape[1])
        together = max(64, min(TOGETHER, CELLS // len(shape[-1])))
        for a in range(0, len(queries), together):
            some = slice(a, a + together)
            taken += self._update(shape, best.part(some), queries[some], factor, key, own[some], label, spare)
        return taken

    def _spare(self, key: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
        """Points of which more than k equal ones come before: they are among no query's k best, itself left out."""
        n, spare = len(self.points), np.zeros(len(self.points), bool)
        with np.errstate(all="ignore"):
            mark = (self.points * np.random.default_rng(0).normal(size=self.points.shape[1])).sum(1)
        order = np.lexsort((label, key, mark))
        again = np.append(False, mark[order[1:]] == mark[order[:-1]])
        at = np.flatnonzero(again)
        again[at] = (self.points[order[at]] == self.points[order[at - 1]]).all(1)
        place = np.arange(n)
        spare[order[place - np.maximum.accumulate(np.where(again, 0, place)) > k]] = True
        return spare

    def _update(self, shape: list[np.ndarray], best: Best, queries: np.ndarray, factor: float, key: np.ndarray, own: np.ndarray, label: np.ndarray, spare: np.ndarray) -> int:
        m, k = best.score.shape
        asked, points = Screened(self.screen, queries), self.screen.rows
        if spare.any():
            points = points.copy()
            points[spare, -1] = np.finfo(np.float32).min
        least, home = self._bounds(shape, asked)
        threshold = asked.threshold(best.radius)
        nearest, everyone, selves = asked.threshold(np.full(m, VANISHING)), np.arange(m), bool((own != NO_ROW).any())
        taken, waiting, edges = self.vantage.shape[0] * m, [], shape[-1]

        def read(a: int, b: int, who: np.ndarray | None = None) -> None:
            """Points from a to b, for some queries or for all."""
            nonlocal taken
            if who is None:
                who, product, limit = everyone, asked.rows @ points[a:b].T, threshold
            else:
                product, limit = asked.rows[who] @ points[a:b].T, threshold[who]
            taken += product.size
            if selves:
                mine = np.flatnonzero((own[who] >= a) & (own[who] < b))
                product[mine, own[who[mine]] - a] = -np.inf
            some = np.flatnonzero(product.max(1) >= limit)
            if not len(some):
                return
            product, limit, who = product[some], limit[some], who[some]
            i, j = np.divmod(np.flatnonzero(product >= limit[:, None]), b - a)
            # Where many stay, those that are surely not among the k best of the leaf go.
            many = np.flatnonzero(np.bincount(i, minlength=len(who)) > 2 * k)
            if len(many):
                kth = np.partition(product[many], b - a - k, axis=1)[:, b - a - k]
                limit[many] = np.maximum(limit[many], np.minimum(kth - 3 * asked.slack[who[many]], nearest[who[many]]))
                i, j = np.divmod(np.flatnonzero(product >= limit[:, None]), b - a)
            other = (own[who[i]] != a + j) & ~spare[a + j]
            waiting.append((who[i[other]], a + j[other]))

        def settle() -> None:
            nonlocal threshold
            if waiting:
                who, at = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                with np.errstate(over="ignore"):
                    score = np.concatenate([lengths(queries[who[a : a + PAIRS]] - self.points[at[a : a + PAIRS]]) for a in range(0, max(1, len(who)), PAIRS)])
                best.merge(who, score, key[at], label[at])
                threshold = asked.threshold(best.radius)

        radius = best.radius
        fresh = np.flatnonzero(np.isinf(radius))
        if not len(fresh) and self._reachable(least, radius * asked.scale, factor).mean() > WANTED:
            for a in range(0, len(self.points), WIDE):
                read(a, min(a + WIDE, len(self.points)))
                if sum(len(x) for x, _ in waiting) > m:
                    settle()
            settle()
            return taken
        # Those without a radius go down to one leaf.
        done = np.full(m, NO_ROW)
        done[fresh] = home[fresh]
        for leaf in np.unique(home[fresh]):
            read(edges[leaf], edges[leaf + 1], np.flatnonzero(done == leaf))
        settle()
        # All others that may hold a nearer one.
        for leaf in np.argsort(least.mean(1), kind="stable"):
            who = np.flatnonzero(self._reachable(least[leaf], best.radius * asked.scale, factor) & (done != leaf))
            if len(who):
                read(edges[leaf], edges[leaf + 1], who)
                if sum(len(x) for x, _ in waiting) > m:
                    settle()
        settle()
        return taken

    def _bounds(self, shape: list[np.ndarray], asked: Screened) -> tuple[np.ndarray, np.ndarray]:
        """The least distance of each leaf from each query, in the screen's terms; the leaf that each query goes down to, by the nearer half."""
        m = len(asked.x)
        least, home, first = np.zeros((1, m)), np.zeros(m, np.int64), 0
        v, square = self.screen.moved(self.vantage)
        if not self.screen.usable:
            v, square = np.zeros_like(v), np.zeros_like(square)
        off = 16 * (v.shape[1] + 16) * DOUBLE * asked.size
        away = square[:, None] + asked.square - 2 * (v @ asked.x.T)
        near, far = np.sqrt(np.maximum(away - off, 0)), np.sqrt(np.maximum(away, 0) + off)
        # Distances that are too large to be taken bound nothing.
        bounds = np.where(np.isfinite(self.bounds), self.bounds, [0, np.inf, 0, np.inf]) * self.screen.scale
        for level in range(len(shape) - 1):
            nodes = slice(first, first + len(shape[level]) - 1)
            bound, first = bounds[nodes], nodes.stop
            halves = [np.maximum(least, np.maximum(bound[:, 2 * h, None] - far[nodes], near[nodes] - bound[:, 2 * h + 1, None])) for h in (0, 1)]
            d, own = near[nodes][home, np.arange(m)], bound[home]
            home = 2 * home + (np.abs(d - own[:, :2].mean(1)) > np.abs(d - own[:, 2:].mean(1)))
            least = np.stack(halves, 1).reshape(-1, m)
        least[:, asked.wild] = 0
        return least, home

    @staticmethod
    def _reachable(least: np.ndarray, radius: np.ndarray, factor: float) -> np.ndarray:
        return least * (1 - MARGIN) - MARGIN * np.where(np.isinf(radius), 0, radius) <= factor * radius


SHARD = "shard long, ids array<long>, asked binary, kind string, points binary, vantage binary, bounds binary"
QUERY = "block long, at array<long>, q_ids array<long>, q_kind string, queries binary"
FOUND = "at long, query_id long, vec_id long, score double"
# Each file is a partition of its own, and its rows, which are large, are read one by one.
ONE_BY_ONE = {"spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.openCostInBytes": "1g", "spark.sql.parquet.columnarReaderBatchSize": "1", ROWS: "1"}


@contextlib.contextmanager
def one_by_one(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in ONE_BY_ONE}
    try:
        for name, value in ONE_BY_ONE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def packed(vectors: np.ndarray) -> tuple[str, bytes]:
    """Vectors in single precision if that holds them exactly, else in double."""
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    found = short if np.array_equal(short, vectors) else vectors
    return found.dtype.str, np.ascontiguousarray(found).tobytes()


def unpacked(kind, raw, width: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.dtype(kind.as_py())).reshape(-1, width).astype(np.float64)


def sound_rows(embeddings: DataFrame, vector: str = "embedding", id: str = "vec_id") -> tuple[DataFrame, int]:
    """id and v of the vectors that take part, and their width (0 without any)."""
    rows = embeddings.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
    rows = rows.filter(sound(F.col("v")) & F.exists("v", lambda c: c != 0))
    width = usual_width(rows, "v") or 0
    return rows.filter(F.size("v") == width), width


def index(rows: DataFrame, width: int, asked: Column, leaf: int = LEAF, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A tree for each shard of `rows` (id, v), on the shared folder. A row's place is its shard and its place there.

    asked: whether a row is a query too.
    """

    def build(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, ((ids, asks), points) in enumerate(in_blocks(batches, width, shard_bytes)):
            tree, order = Tree.build(points, leaf)
            kind, raw = packed(tree.points)
            yield pa.RecordBatch.from_pydict({
                "shard": [(task << 24) + number], "ids": pa.ListArray.from_arrays([0, len(order)], ids.take(pa.array(order))),
                "asked": [asks.to_numpy(zero_copy_only=False)[order].tobytes()], "kind": [kind],
                "points": [raw], "vantage": [tree.vantage.tobytes()], "bounds": [tree.bounds.tobytes()],
            })

    given = rows.select("id", F.coalesce(asked, F.lit(False)).alias("asked"), "v")
    return store(given.mapInArrow(build, SHARD), "vantage-index")


def place_of(shard, at):
    return (shard << 20) + at


def query_blocks(shards: DataFrame, width: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The rows of the index that are asked for, in blocks, a file for each, on the shared folder."""

    def open_(batches):
        for batch in batches:
            for shard, ids, asked, kind, points in zip(*(batch[x] for x in ("shard", "ids", "asked", "kind", "points"))):
                rows = np.flatnonzero(np.frombuffer(asked.as_buffer(), bool))
                if len(rows):
                    vectors = pa.FixedSizeListArray.from_arrays(pa.array(unpacked(kind, points, width)[rows].ravel()), width).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(place_of(shard.as_py(), rows)), ids.values.take(pa.array(rows)), vectors], names=["at", "id", "v"])

    def pack(batches):
        from pyspark import TaskContext

        for (at, ids), v in in_blocks(batches, width, 1 << 62):
            kind, raw = packed(v)
            yield pa.RecordBatch.from_pydict({
                "block": [TaskContext.get().partitionId()], "at": pa.ListArray.from_arrays([0, len(at)], at),
                "q_ids": pa.ListArray.from_arrays([0, len(ids)], ids), "q_kind": [kind], "queries": [raw],
            })

    with one_by_one(shards.sparkSession):
        rows = store(shards.select("shard", "ids", "asked", "kind", "points").mapInArrow(open_, "at long, id long, v array<double>"), "vantage-asked")
    # Few rows of each shard are asked for, so they are brought together before they are packed.
    blocks = -(-rows.count() // max(1, query_bytes // (8 * width)))
    found = store(rows.repartition(max(1, blocks)).mapInArrow(pack, QUERY), "vantage-queries")
    discard(rows)
    return found


def nearest(shards: DataFrame, queries: DataFrame, width: int, k: int = NEIGHBOURS, factor: float = FACTOR, leaf: int = LEAF) -> DataFrame:
    """at, query_id, rank, vec_id and score of the k nearest of each query, by the shards' trees."""
    spark = shards.sparkSession

    def search(batches):
        held = {}
        for batch in batches:
            names = ("shard", "ids", "kind", "points", "vantage", "bounds", "block", "at", "q_ids", "q_kind", "queries")
            for shard, ids, kind, points, vantage, bounds, block, at, q_ids, q_kind, asked in zip(*(batch[x] for x in names)):
                if block.as_py() not in held:
                    places = at.values.to_numpy().copy()
                    held[block.as_py()] = places, q_ids.values.to_pylist(), unpacked(q_kind, asked, width), Best.none(len(places), k)
                places, _, vectors, best = held[block.as_py()]
                tree = Tree(unpacked(kind, points, width), *(np.frombuffer(b.as_buffer()).reshape(-1, w) for b, w in ((vantage, width), (bounds, 4))), leaf)
                missing = ids.values.is_null().to_numpy(zero_copy_only=False)
                key = np.where(missing, np.iinfo(np.int64).max, ids.values.fill_null(0).to_numpy(zero_copy_only=False))
                own = places - place_of(shard.as_py(), 0)
                own = np.where((own >= 0) & (own < len(key)), own, NO_ROW)
                tree.update(best, vectors, factor, key, own, missing.astype(np.int64))
        for places, q_ids, _, best in held.values():
            who, rank = np.nonzero(best.label != NO_ROW)
            q_ids = pa.array(q_ids, pa.int64()).take(pa.array(who))
            found = pa.array(best.key[who, rank], mask=best.label[who, rank] == 1)
            yield pa.RecordBatch.from_arrays([pa.array(places[who]), q_ids, found, pa.array(best.score[who, rank])], names=["at", "query_id", "vec_id", "score"])

    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    groups = max(-(-tasks // max(1, queries.count())), -(-shards.count() // MOST_SHARDS))
    with one_by_one(spark):
        pairs = shards.drop("asked").coalesce(groups).hint("shuffle_replicate_nl").crossJoin(queries)
        found = store(pairs.mapInArrow(search, FOUND), "vantage-found")
    order = Window.partitionBy("at").orderBy("score", F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("at", "query_id", "rank", "vec_id", "score")


def neighbours_digest(embeddings: DataFrame, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each row whose id is divisible by 100."""
    rows, width = sound_rows(embeddings)
    if not width:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = index(rows, width, F.col("id") % EVERY == 0)
    queries = query_blocks(shards, width)
    found = nearest(shards, queries, width, factor=factor)
    discard(shards)
    discard(queries)
    return found.select("query_id", "rank", "vec_id", "score")


# All pairs of the queries and all rows; components are taken in order.
ORACLE = f"""
WITH given AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
rows AS (SELECT * FROM given WHERE len(v) = (SELECT len(v) FROM given GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)),
pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
    FROM rows q JOIN rows c ON c.row <> q.row WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY row ORDER BY score, vec_id NULLS LAST) <= {NEIGHBOURS}
"""
