"""Centroid clustering by Shallot search over integer vectors.

Each vector carries its centroid, the second-nearest one, an upper bound of the distance to the first and a
lower bound of the distance to all others. When centroids move the bounds are widened by the moves. A vector
whose upper bound stays below its lower bound, or below half the way from its centroid to the next, keeps its
centroid without a distance being computed. For the others

1. the exact distance to the own centroid tightens the upper bound, and often settles it;
2. else the remembered second centroid is measured too, and the search starts from the closer of the two: its
   neighbours are scanned in order of their distance from it;
3. a neighbour further from the start than (distance to the start + distance to the second best so far) can
   be neither best nor second; so the ball shrinks with every better second, and the scan ends at its edge;
4. survivors are compared by exact integer squares, ties to the smaller number.

Bounds are floats with a margin above their rounding error, so the result is that of comparing all distances
as integers. Vectors travel with their bounds as blocks of binary matrices; a round reads the blocks of the
round before, writes its own and drops the others. Sums and counts of clusters are added up inside a block,
then by Spark; the driver and each task hold the centroids (k x width numbers, limited by MOST_CELLS) and
the k x k distances between them.

Defined results: rows whose vector is null, has not exactly `width` components, or holds a null, a non-finite
entry or one beyond 2^20 in magnitude, are left out. With fewer vectors than k there are as many centroids
as vectors; an empty table gives no rows. Equal vectors share a cluster; equal first centroids leave the
larger number empty, and an empty centroid stays where it is. Null ids are kept and hashed as an empty text;
of equal hashes the smaller vector comes first. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import discard, store
from pulsegate.llm.vectors import LARGEST, column_sums, doubles, few_rows, in_blocks, narrow, sound, wide

SCALE = 64
WIDTH = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
# Centroids x width, and centroids x centroids: what every task holds.
MOST_CELLS = 1 << 24
# Relative margin of the bounds, far above the rounding of a distance and of a few thousand moves.
MARGIN = 1e-9

BLOCK = "ids array<long>, kind string, x binary, near binary, second binary, upper binary, lower binary, counts array<long>, sums array<long>, inertia array<long>"
_LISTS = pa.list_(pa.int64())


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to their centroids (or to one)."""
    away = x - centroids
    return np.einsum("ij,ij->i", away, away)


@dataclass(frozen=True)
class Centroids:
    """Centroids in integers, how far they lie apart, and how far each has moved in the round before."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        away = np.stack([np.sqrt(squares(self.at, c).astype(float)) for c in self.at])
        object.__setattr__(self, "away", away)
        object.__setattr__(self, "order", np.argsort(away, axis=1, kind="stable"))
        others = away + np.where(np.eye(len(away), dtype=bool), np.inf, 0)
        object.__setattr__(self, "half", others.min(1) / 2)

    def widen(self, near, upper, lower):
        """Bounds after the moves: the own centroid's, and the largest of any other's."""
        if not self.moved.any():
            return upper.copy(), lower.copy()
        first = int(self.moved.argmax())
        rest = np.delete(self.moved, first).max(initial=0.0)
        return upper + self.moved[near], lower - np.where(near == first, rest, self.moved[first])

    def search(self, x, near, second, upper, lower):
        """near, second, upper, lower of each row of x, from those of the round before."""
        near, second = near.copy(), second.copy()
        upper, lower = self.widen(near, upper, lower)
        if len(self.at) == 1:
            return near, second, np.sqrt(squares(x, self.at[0]).astype(float)), np.full(len(x), np.inf)
        settled = lambda rows: upper[rows] * (1 + MARGIN) < np.maximum(lower[rows], self.half[near[rows]]) * (1 - MARGIN)
        rows = np.flatnonzero(~settled(np.arange(len(x))))
        own = squares(x[rows], self.at[near[rows]])
        upper[rows] = np.sqrt(own.astype(float))
        open_ = ~settled(rows)
        rows, best = rows[open_], own[open_]
        other = squares(x[rows], self.at[second[rows]])
        swap = (other < best) | ((other == best) & (second[rows] < near[rows]))
        i1, i2 = np.where(swap, second[rows], near[rows]), np.where(swap, near[rows], second[rows])
        d1, d2 = np.where(swap, other, best), np.where(swap, best, other)
        known = i2.copy()
        for start in np.unique(i1):
            here = np.flatnonzero(i1 == start)
            reach = np.sqrt(d1[here].astype(float))
            for j in self.order[start]:
                if j == start:
                    continue
                inside = self.away[start, j] * (1 - MARGIN) <= (reach + np.sqrt(d2[here].astype(float))) * (1 + MARGIN)
                here, reach = here[inside], reach[inside]
                if not len(here):
                    break
                fresh = here[known[here] != j]
                d = squares(x[rows[fresh]], self.at[j])
                first = (d < d1[fresh]) | ((d == d1[fresh]) & (j < i1[fresh]))
                then = ~first & ((d < d2[fresh]) | ((d == d2[fresh]) & (j < i2[fresh])))
                a, b = fresh[first], fresh[then]
                d2[a], i2[a] = d1[a], i1[a]
                d1[a], i1[a] = d[first], j
                d2[b], i2[b] = d[then], j
        near[rows], second[rows] = i1, i2
        upper[rows], lower[rows] = np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))
        return near, second, upper, lower


def integer_rows(embeddings: DataFrame, vector: str = "embedding", id: str = "vec_id", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """id and x, the vector in integers floor(scale * c), of the sound rows of the right width."""
    rows = embeddings.select(F.col(id).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
    rows = rows.filter((F.size("v") == width) & sound(F.col("v"), LARGEST))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of `seed:id`, in order of hash."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    return np.array([r["x"] for r in hashed.orderBy("h", "x").limit(k).collect()], np.int64)


def _block(ids, x, near, second, upper, lower, k: int, exact: np.ndarray) -> pa.RecordBatch:
    """One row; exact: squared distances to the centroid that `near` names."""
    sums = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(sums, near, x)
    inertia = np.zeros(k, np.int64)
    np.add.at(inertia, near, exact)
    small = narrow(x)
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([ids], _LISTS), "kind": [small.dtype.str], "x": pa.array([small.tobytes()], pa.binary()),
        "near": pa.array([near.astype(np.int32).tobytes()], pa.binary()), "second": pa.array([second.astype(np.int32).tobytes()], pa.binary()),
        "upper": pa.array([upper.tobytes()], pa.binary()), "lower": pa.array([lower.tobytes()], pa.binary()),
        "counts": pa.array([np.bincount(near, minlength=k)], _LISTS), "sums": pa.array([sums.ravel()], _LISTS), "inertia": pa.array([inertia], _LISTS),
    })


def _unpacked(batch, width: int):
    for row in zip(*(batch[name] for name in ("ids", "kind", "x", "near", "second", "upper", "lower"))):
        ids, kind, x, near, second, upper, lower = row
        yield ids.values, wide(x.as_buffer(), kind.as_py(), width), *(np.frombuffer(b.as_buffer(), np.int32).astype(np.int64) for b in (near, second)), *(np.frombuffer(b.as_buffer()) for b in (upper, lower))


def assigned(source: DataFrame, centroids: Centroids, width: int, first: bool) -> DataFrame:
    """Blocks with the vectors of `source` (rows id and x if `first`, else blocks) searched anew, on the shared folder."""
    k = len(centroids.at)

    def pack(batches):
        for (ids,), x in in_blocks(batches, width):
            found = centroids.search(x, np.zeros(len(x), np.int64), np.full(len(x), min(1, k - 1)), np.full(len(x), np.inf), np.zeros(len(x)))
            yield _block(ids, x, *found, k, squares(x, centroids.at[found[0]]))

    def search(batches):
        for batch in batches:
            for ids, x, *state in _unpacked(batch, width):
                found = centroids.search(x, *state)
                yield _block(ids, x, *found, k, squares(x, centroids.at[found[0]]))

    if first:
        return store(source.mapInArrow(pack, BLOCK), "shallot")
    with few_rows(source.sparkSession):
        return store(source.mapInArrow(search, BLOCK), "shallot")


def cluster(rows: DataFrame, width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """id, cluster, second and distance of each row (id, x); the final centroids; the inertia of each cluster."""
    if k < 1 or k * max(k, width) > MOST_CELLS:
        raise ValueError(f"{k} centroids of {width} components: every task would hold more than {MOST_CELLS} numbers")
    at = first_centroids(rows, k, seed)
    if not len(at):
        return rows.sparkSession.createDataFrame([], "id long, cluster int, second int, distance long"), at, np.empty(0, np.int64)
    centroids = Centroids(at, np.zeros(len(at)))
    blocks = assigned(rows, centroids, width, True)
    for _ in range(rounds):
        counts, sums = column_sums(blocks, "counts"), column_sums(blocks, "sums")
        new = centroids.at.copy()
        for c, n in counts.items():
            if n:
                new[c] = [sums[c * width + i] // n for i in range(width)]
        # A margin on the moves, since bounds add them up.
        moved = np.sqrt(squares(new, centroids.at).astype(float)) * (1 + MARGIN)
        centroids, before = Centroids(new, moved), blocks
        blocks = assigned(before, centroids, width, False)
        discard(before)
    inertia = column_sums(blocks, "inertia")
    final = centroids.at

    def explode(batches):
        for batch in batches:
            for ids, x, near, second, _, _ in _unpacked(batch, width):
                other = pa.array(second, pa.int32()) if len(final) > 1 else pa.nulls(len(x), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), other, pa.array(squares(x, final[near]))], names=["id", "cluster", "second", "distance"])

    state = ["ids", "kind", "x", "near", "second", "upper", "lower"]
    return blocks.select(*state).mapInArrow(explode, "id long, cluster int, second int, distance long"), final, np.array([inertia[c] for c in range(len(final))], np.int64)


def clusters_digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids, inertia = cluster(integer_rows(embeddings))
    of = F.create_map(*(F.lit(x) for c, n in enumerate(inertia.tolist()) for x in (c, n))) if len(inertia) else F.lit(None).cast("map<int,long>")
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.try_element_at(of, F.col("cluster")).alias("cluster_inertia"),
        F.lit(int(inertia.sum())).cast("long").alias("inertia"),
        F.get(F.array(*(F.lit(h) for h in hashes)).cast("array<string>"), F.col("cluster")).alias("centroid_sha256"),
    )


def _sql() -> str:
    """DuckDB SQL for clusters_digest: all distances to all centroids in each round."""
    square = f"list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    steps = [f"""
c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS c, x FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {CENTROIDS}))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT row, any_value(x) AS x, min((d, c)) AS near FROM (SELECT v.row, v.x, c.c, {square} AS d FROM kept v, c{r} c) v GROUP BY row)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT near[2] AS c, p, sum(v)::HUGEINT AS s, count(*) AS n FROM (SELECT near, unnest(range(1, {WIDTH + 1})) AS p, unnest(x) AS v FROM a{r}) GROUP BY ALL)")
            # Floor division of integers: DuckDB's // cuts towards zero.
            steps.append(f"m{r} AS (SELECT c, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY p) AS x FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e) OR abs(e) > {LARGEST})) = 0),
{','.join(steps)},
judged AS (SELECT row, near[1] AS distance, near[2] AS cluster FROM a{ROUNDS})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM judged j JOIN kept k ON k.row = j.row JOIN c{ROUNDS} c ON c.c = j.cluster
"""


ORACLE = _sql()
