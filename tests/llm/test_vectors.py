"""Centroid clustering and vector codes against full searches."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoptrace.llm import centroid_clustering as cc
from shoptrace.llm import vector_codes as vc
from shoptrace.llm.shared import ship

VECTORS = "vec_id long, embedding array<double>, label int, v string, code string, cluster string, distance int"
BAD = [[0.1] * 63, [0.1] * 65, [], None, [None] + [0.1] * 63, [math.nan] + [0.1] * 63, [0.1] * 63 + [math.inf], [-math.inf] + [0.0] * 63]


@pytest.fixture
def make_vectors(spark):
    ship(spark)

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "x", "y", "z", 7) for r in rows]
        return spark.createDataFrame(full, VECTORS).repartition(3, F.rand(1))

    return build


def around(seed, n, centres=5, spread=0.02):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(middle)], r.choice([1, 1, 2, None])) for i in range(n)]


def clustered(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, n in found if n == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, inertia[n], sum(inertia), sha[n]) for (i, _), (d, n) in zip(kept, found))


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_a_full_search(make_vectors, seed):
    rows = around(seed, 150) + [(3, [0.5] * 64), (3, [0.25] * 64), (None, [0.1] * 64), (None, [0.2] * 64), (900, [0.5] * 64), (901, [0.5] * 64)]
    wrong = [(1000 + i, v) for i, v in enumerate(BAD)]
    got = [tuple(map(lambda x: x, r)) for r in cc.cluster_report(make_vectors(rows + wrong)).collect()]
    assert sorted((str(r[0]), *r[1:]) for r in got) == clustered(rows)


def test_search_finds_ties_and_computes_less_than_everything():
    r = np.random.default_rng(5)
    middle = r.integers(-50, 50, (40, 8))
    middle = np.concatenate([middle, middle[:5]])  # equal centroids
    v = middle[r.integers(0, 40, 600)] + r.integers(-2, 3, (600, 8))
    every = ((v[:, None] - middle[None]) ** 2).sum(axis=2)
    for start in (np.zeros(600, np.int64), r.integers(0, 45, 600)):
        found, distance, computed = cc.nearest(v, middle, start)
        assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert computed < every.size / 2
    grid = np.array([[0, 0], [2, 0], [0, 2], [2, 2]])
    found, distance, _ = cc.nearest(np.array([[1, 1], [2, 1]]), grid, np.array([3, 3]))
    assert found.tolist() == [0, 1] and distance.tolist() == [2, 1]


def test_few_vectors_no_vectors_and_large_components(make_vectors):
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert sorted((str(r[0]), *r[1:]) for r in cc.cluster_report(make_vectors(rows)).collect()) == clustered(rows)
    for none in ([], [(1, v) for v in BAD]):
        assert cc.cluster_report(make_vectors(none)).count() == 0
        assert vc.code_report(make_vectors(none)).count() == 0
    far = make_vectors([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)])
    assert sorted((r.cluster, r.distance) for r in cc.cluster_report(far).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert {r.error for r in vc.code_report(far).collect()} == {0}


def coded(rows, entries=16, rounds=6):
    kept = sorted(((i is None, i or 0, [math.floor(4096 * x) for x in v], v, label) for i, v, label in rows), key=lambda r: (r[0], r[1], r[2]))
    part = lambda v, p: v[8 * p : 8 * p + 8]
    books = [[part(r[2], p) for r in kept[:entries]] for p in range(8)]

    def best(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            own = [best(part(r[2], p), p)[1] for r in kept]
            books[p] = [
                [sum(x) // len(m) for x in zip(*m)] if (m := [part(r[2], p) for r, o in zip(kept, own) if o == n]) else e for n, e in enumerate(books[p])
            ]
    found = [[best(part(r[2], p), p) for p in range(8)] for r in kept]
    error = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, error):
        sums[r[4]] = sums.get(r[4], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(None if r[0] else r[1]), "".join(f"{n:02x}" for _, n in f), e, sums[r[4]], sha) for r, f, e in zip(kept, found, error)), books


def test_codes_equal_full_rounds(make_vectors):
    rows = around(3, 120, spread=0.2) + [(5, [0.5] * 64, None), (5, [0.5] * 64, 1), (None, [0.3] * 64, 2), (-4, [0.3] * 64, 2)]
    want, books = coded(rows)
    wrong = [(-9 - i, v) for i, v in enumerate(BAD)]
    got = vc.code_report(make_vectors(rows + wrong)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    trained = vc.train(make_vectors(rows))[1]
    assert trained.tolist() == books
    back = vc.decode(vc.code_report(make_vectors(rows)), trained).select("vec_id", "error", "approximation").collect()
    exact = {}
    for i, v, _ in rows:
        exact.setdefault(i, []).append([math.floor(4096 * x) for x in v])
    for r in back:
        approximation = [round(4096 * x) for x in r.approximation]
        assert r.error in {sum((a - b) ** 2 for a, b in zip(v, approximation)) for v in exact[r.vec_id]}


def test_active_entries_save_distances_and_keep_ties():
    r = np.random.default_rng(9)
    x, entries = r.integers(0, 6, (400, 3)), r.integers(0, 6, (12, 3))
    code, best = np.zeros(400, np.int64), np.zeros(400, np.int64)
    vc.recode(x, entries, np.ones(12, bool), best, code)
    for moves in ([3], [0, 11], [], [5, 6, 7]):
        moved = entries.copy()
        moved[moves] = r.integers(0, 6, (len(moves), 3))
        active = np.zeros(12, bool)
        active[moves] = True
        computed = vc.recode(x, moved, active, best, code)
        every = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        assert computed < every.size * (0.7 if moves else 0.01)
        entries = moved


def test_parameters_are_checked(make_vectors):
    with pytest.raises(ValueError):
        vc.train(make_vectors([]), parts=7)
    with pytest.raises(ValueError):
        vc.train(make_vectors([]), entries=300)
