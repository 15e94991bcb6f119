"""Whitening, clustering and nearest neighbours against plain versions, on edge cases and on generated vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate.llm import shallot, vantage, whitening
from pulsegate.llm.vectors import in_blocks, narrow, wide

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x long, v string, shard long, cluster string, rank string"


def made(seed: int, n: int, width: int = 64) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, width)).astype(np.float32)
    rows[n // 2 :] = rows[: n - n // 2] + rng.normal(scale=0.05, size=(n - n // 2, width)).astype(np.float32)
    return rows.tolist()


def edges() -> list[tuple]:
    """Nulls, odd entries, other widths, equal rows, ties, zero vectors, null and repeated ids."""
    good = made(3, 60)
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(100, good[7]), (200, good[7]), (200, good[7]), (None, good[8]), (None, good[8]), (300, [0.0] * 64), (301, [0.0] * 64)]
    rows += [(400, None), (401, []), (402, [None, *good[0][1:]]), (403, [math.nan, *good[0][1:]]), (404, [math.inf, *good[0][1:]]), (500, good[0][:63]), (600, [1e30, *good[0][1:]])]
    rows += [(700, (np.array(good[1]) * -1).tolist()), (800, [-0.0, *good[2][1:]]), (-100, good[9])]
    return rows


@pytest.fixture(scope="module", params=["edges", "generated", "equal", "one", "empty"])
def vectors(request, spark, sf):
    if request.param == "generated":
        frame = spark.read.parquet(f"{sf}/embeddings.parquet")
        return frame, [(r.vec_id, r.embedding) for r in frame.collect()]
    rows = {"edges": edges(), "equal": [(i, [1.0, 2.0] * 32) for i in range(250)], "one": [(100, [0.5] * 64)], "empty": []}[request.param]
    frame = spark.createDataFrame([(i, v, 1, "a", 2, "b", 3, "c", "d") for i, v in rows], SCHEMA)
    # Floats as Spark keeps them.
    return frame.repartition(3), [(r.vec_id, r.embedding) for r in frame.collect()]


def sound(vector, largest=1 << 20):
    return vector is not None and all(c is not None and math.isfinite(c) and abs(c) <= largest for c in vector)


def of_usual_width(rows):
    sizes = [len(v) for _, v in rows]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    return [(i, v) for i, v in rows if len(v) == width], width


def test_whitening(vectors):
    frame, rows = vectors
    rows, width = of_usual_width([(i, v) for i, v in rows if sound(v)])
    found = whitening.whitening_digest(frame).collect()
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], np.int64).reshape(len(rows), width)
    fit = np.unique(x, axis=0)
    n = len(fit)
    if n < 2:
        assert found == []
        return
    sums = fit.sum(0)
    centred = (n * fit - sums) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:4], components[:, ::-1][:, :4]
    white = ((n * x - sums) / n) @ components / np.sqrt(values)
    assert len(found) == 4 * len(rows)
    assert all(r.n == n and r.identity_error < 1e-10 for r in found)
    for c in range(4):
        mine = [r for r in found if r.component == c + 1]
        assert mine[0].explained == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-10)
        want = sorted(((-1 if i is None else i, int(d)) for (i, _), d in zip(rows, ((n * x - sums) ** 2).sum(1))))
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in mine) == want
        by_id = {}
        for (i, _), w in zip(rows, white[:, c]):
            by_id.setdefault(i, []).append(w)
        sign = np.sign(sum(r.whitened * by_id[r.vec_id][0] for r in mine if len(by_id[r.vec_id]) == 1))
        for r in mine:
            assert min(abs(sign * r.whitened - w) for w in by_id[r.vec_id]) < 1e-9


def test_equal_eigenvalues(spark):
    """A direction for each dimension, all of one variance, is found whole."""
    rows = [(i, [float(i // 2 == j) * (1 if i % 2 else -1) for j in range(6)]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, width = whitening.integer_rows(frame)
    model, error = whitening.fit_whitening(vectors, width, 6)
    assert width == 6 and len(model.eigenvalues) == 6 and error < 1e-12
    assert np.allclose(model.eigenvalues, model.eigenvalues[0]) and np.allclose(model.explained, 1 / 6)


def test_components_without_variance_are_left_out(spark):
    frame = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    found = whitening.whitening_digest(frame).collect()
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)


def test_deviation_beyond_64_bits(spark):
    model = whitening.Whitening(1 << 33, np.zeros(2, np.int64), np.eye(2), np.ones(2), 1.0)
    assert whitening.deviations_of(np.array([[1 << 5, 0], [0, 0]]), model) == [None, 0]


def lloyd(rows, k=16, rounds=3):
    rows = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and sound(v)]
    rows.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in rows], np.int64).reshape(-1, 64)
    c = x[:k].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        near = d.argmin(1) if len(x) else np.empty(0, int)
        for j in range(len(c) if r < rounds else 0):
            if (near == j).any():
                c[j] = x[near == j].sum(0) // (near == j).sum()
    least = d.min(1) if len(x) else np.empty(0, int)
    digest = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((i, int(j), int(e), int(least[near == j].sum()), int(least.sum()), digest[j]) for (i, _), j, e in zip(rows, near, least)), key=str)


def test_clusters(vectors):
    frame, rows = vectors
    assert sorted(map(tuple, shallot.clusters_digest(frame).collect()), key=str) == lloyd(rows)


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_search_from_any_state(k):
    """Bounds of the round before, moved centroids, ties: always the nearest and the second-nearest."""
    rng = np.random.default_rng(k)
    x = rng.integers(-3, 4, (400, 3))
    centroids = shallot.Centroids(rng.integers(-3, 4, (k, 3)), np.zeros(k))
    state = np.zeros(400, np.int64), np.full(400, min(1, k - 1)), np.full(400, np.inf), np.zeros(400)
    for _ in range(6):
        state = centroids.search(x, *state)
        d = ((x[:, None] - centroids.at[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        if k > 1:
            assert (state[2] ** 2 >= d.min(1) - 1e-6).all()
            others = np.where(np.arange(k) == state[0][:, None], 1 << 40, d).min(1)
            assert (np.maximum(state[3], 0) ** 2 <= others + 1e-6).all()
        new = centroids.at + rng.integers(-1, 2, (k, 3))
        centroids = shallot.Centroids(new, np.sqrt(((new - centroids.at) ** 2).sum(1)) * (1 + shallot.MARGIN))


def test_bounds_settle_rows():
    """Where nothing moves, no distance is taken again."""
    x = np.random.default_rng(1).integers(-100, 100, (500, 8))
    centroids = shallot.Centroids(x[:20], np.zeros(20))
    state = centroids.search(x, np.zeros(500, np.int64), np.ones(500, np.int64), np.full(500, np.inf), np.zeros(500))
    ties = (state[2] * (1 + shallot.MARGIN) >= np.maximum(state[3], centroids.half[state[0]]) * (1 - shallot.MARGIN)).sum()
    taken = []
    real, shallot.squares = shallot.squares, lambda a, b: taken.append(len(a)) or real(a, b)
    try:
        centroids.search(x, *state)
    finally:
        shallot.squares = real
    assert ties < 50 and sum(taken) <= ties * 20


def test_too_many_centroids(spark):
    with pytest.raises(ValueError):
        shallot.cluster(spark.createDataFrame([(1, [1])], "id long, x array<long>"), 1, k=5000)


def brute_neighbours(rows, k=10):
    rows, _ = of_usual_width([(i, v) for i, v in rows if sound(v, 1e308) and any(c != 0 for c in v)])
    found = []
    for a, (i, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = []
        for b, (j, w) in enumerate(rows):
            if a != b:
                total = 0.0
                for p, q in zip(v, w):
                    total += (p - q) * (p - q)
                scored.append((math.sqrt(total), j is None, j or 0))
        scored.sort()
        found += [(i, r + 1, None if none else j, d) for r, (d, none, j) in enumerate(scored[:k])]
    return sorted(found, key=str)


def test_neighbours(vectors, monkeypatch):
    frame, rows = vectors
    monkeypatch.setattr(vantage, "SHARD_BYTES", 60_000)
    assert sorted(map(tuple, vantage.neighbours_digest(frame).collect()), key=str) == brute_neighbours(rows)


@pytest.mark.parametrize("width", [1, 2, 8])
def test_pruning_is_exact_at_one_and_saves_work(width):
    rng = np.random.default_rng(width)
    points = rng.integers(0, 5000, (3000, width)).astype(float)
    points[1500:1600] = points[:100]
    tree, order = vantage.Tree.build(points, 16)
    queries = points[:50]
    own = np.argsort(order)[:50]
    taken = []
    for factor in (1.0, 0.3):
        place, score, n = tree.search(queries, 5, factor, order, own)
        taken.append(n)
        d = vantage.distances(queries, points)
        d[np.arange(50), np.arange(50)] = np.inf
        want = np.lexsort((np.broadcast_to(np.arange(3000), d.shape), d))[:, :5]
        recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(order[place], want)])
        assert recall == 1 if factor == 1.0 else recall > 0.3, recall
    assert taken[1] < taken[0] and (width > 2 or taken[0] < 50 * 3000 / 3)


def test_few_exact_distances_where_trees_prune_nothing(monkeypatch):
    """A table takes as many pairs as queries times rows; only those that may be near are taken in double precision."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(6000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree, order = vantage.Tree.build(points)
    taken = []
    for name in ("distances", "lengths"):
        real = getattr(vantage, name, None)
        monkeypatch.setattr(vantage, name, lambda *a, real=real: taken.append((found := real(*a)).size) or found, raising=False)
    place, score, _ = tree.search(points[:300], 10, 1.0, order, np.argsort(order)[:300])
    monkeypatch.undo()
    assert sum(taken) < 0.1 * 300 * 6000
    d = vantage.distances(points[:300], points)
    d[np.arange(300), np.arange(300)] = np.inf
    want = np.lexsort((np.broadcast_to(np.arange(6000), d.shape), d))[:, :10]
    assert (order[place] == want).all() and (score == np.take_along_axis(d, want, 1)).all()


def test_few_exact_distances_among_equal_rows(monkeypatch):
    points, taken, real = np.ones((2000, 8)), [], vantage.lengths
    tree, order = vantage.Tree.build(points)
    monkeypatch.setattr(vantage, "lengths", lambda rows: taken.append(len(rows)) or real(rows))
    place, score, _ = tree.search(points[:50], 10, 1.0, order, np.argsort(order)[:50])
    assert sum(taken) <= 50 * 11 and not score.any()
    assert order[place].tolist() == [[i for i in range(11) if i != q][:10] for q in range(50)]


KINDS = {
    "far from zero": lambda rng, x: x * 1e-3 + 1e4,
    "near copies": lambda rng, x: x[rng.integers(20, size=len(x))] + 1e-6 * x,
    "copies": lambda rng, x: x[rng.integers(20, size=len(x))],
    "all equal": lambda rng, x: np.zeros_like(x) + x[0],
    "huge": lambda rng, x: x * 1e120,
    "squares vanish": lambda rng, x: x * 1e-200,
    "of all sizes": lambda rng, x: x * 10.0 ** rng.integers(-140, 140, size=(len(x), 1)),
    "squares overflow": lambda rng, x: x * 10.0 ** rng.integers(100, 300, size=(len(x), 1)),
    "on a line": lambda rng, x: np.arange(len(x))[:, None] + 0 * x,
}


@pytest.mark.parametrize("width", [1, 64])
@pytest.mark.parametrize("kind", KINDS)
def test_best_over_several_trees(kind, width):
    """The best that are carried from tree to tree are those of all pairs, whatever single precision makes of them."""
    rng = np.random.default_rng(width)
    points = KINDS[kind](rng, rng.normal(size=(400, width)))
    key = rng.integers(0, 50, 400)
    best = vantage.Best.none(80, 7)
    with np.errstate(over="ignore"):
        for a, b in ((0, 5), (5, 180), (180, 400)):
            tree, order = vantage.Tree.build(points[a:b], 16)
            own = np.where((np.arange(80) >= a) & (np.arange(80) < b), np.argsort(order)[np.clip(np.arange(80) - a, 0, b - a - 1)], vantage.NO_ROW)
            tree.update(best, points[:80], 1.0, key[a:b][order], own, np.arange(a, b)[order])
        d = vantage.distances(points[:80], points)
    d[np.arange(80), np.arange(80)] = np.inf
    keys = np.broadcast_to(key, d.shape)
    want = np.lexsort((keys, d))[:, :7]
    score = np.take_along_axis(d, want, 1)
    there = np.isfinite(score)
    assert (best.score == score).all() and ((best.label != vantage.NO_ROW) == there).all()
    assert (best.key[there] == np.take_along_axis(keys, want, 1)[there]).all()
    assert (np.take_along_axis(d, best.label, 1)[there] == score[there]).all()


def test_neighbours_by_several_shards_and_blocks(spark):
    """Shards and query blocks of a few rows, vectors that need double precision, null ids among equal rows."""
    rows = [(None if i % 9 == 1 else i * 20, [float(c) / 3 for c in v]) for i, v in enumerate(made(8, 120, 5))]
    rows += [(100, rows[5][1]), (100, rows[5][1]), (None, rows[5][1]), (2**63 - 1, rows[5][1])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    shards = vantage.index(frame, 5, F.col("id") % 100 == 0, shard_bytes=40 * 13)
    queries = vantage.query_blocks(shards, 5, 40 * 6)
    assert shards.count() >= 9 and queries.count() >= 4
    found = vantage.nearest(shards, queries, 5).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, found.collect()), key=str) == brute_neighbours(rows)


def test_blocks_are_bounded_and_whole():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 7)), "x": [[i, -i] for i in range(a, a + 7)]}) for a in (0, 7, 14)]
    found = list(in_blocks(iter(batches), 2, 16 * 5))
    assert [len(x) for _, x in found] == [5, 5, 5, 5, 1]
    assert np.concatenate([x for _, x in found])[:, 0].tolist() == list(range(21))
    small = narrow(np.array([[1, -300], [0, 5]]))
    assert small.dtype == np.int16 and (wide(small.tobytes(), small.dtype.str, 2) == small).all()
