import numpy as np
import pytest

from kolonnade.llm.neighbours import curve_keys, hilbert_index, nearest_pairs

SHAPE = "vec_id long, embedding array<double>, gid long, h string"


def brute(rows, k=5, floor=0.8, dim=96):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    ids = np.array(sorted(best))
    if not len(ids):
        return set()
    m = np.array([best[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for n in range(len(ids)):
        s = np.round(m @ m[n], 6)
        s[n] = -2
        for j in np.lexsort((ids, -s))[:k]:
            if s[j] >= floor and j != n:
                out.add((min(ids[n], ids[j]), max(ids[n], ids[j])))
    return {(int(a), int(b)) for a, b in out}


def clusters(n, seed, dim=96):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12, dim))
    return [(i, (centres[i % len(centres)] + rng.standard_normal(dim) * rng.choice([0.2, 0.4, 0.5])).astype(np.float32).astype(float).tolist()) for i in range(n)]


def run(spark, rows, **more):
    return set(map(tuple, nearest_pairs(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SHAPE), **more).collect()))


def test_hilbert_index_is_a_walk():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert_index(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark, monkeypatch):
    import kolonnade.llm.neighbours as nb

    monkeypatch.setattr(nb, "RANGE_ROWS", 400)
    rows = clusters(3000, 3)
    want, got = brute(rows), run(spark, rows, window=64)
    assert got <= want | got and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_recall_where_vectors_are_many_windows(spark, monkeypatch):
    # As many windows of vectors as in a table of 750,000; the neighbours of a vector are no more than in a small one.
    import kolonnade.llm.neighbours as nb

    monkeypatch.setattr(nb, "RANGE_ROWS", 400)
    rows = clusters(12_000, 8)
    want, got = brute(rows), run(spark, rows, window=4)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(got)


def test_copies_ties_and_dirt(spark):
    rng = np.random.default_rng(1)
    one, two = (rng.standard_normal(96).tolist() for _ in range(2))
    rows = [(i, one) for i in range(40)] + [(100 + i, [2 * x for x in one]) for i in range(3)] + [(200, two), (201, two), (201, two), (202, None), (203, [0.0] * 96), (204, [1.0] * 48), (205, [float("nan")] + [1.0] * 95), (206, [None] + [1.0] * 95), (None, one)]
    got = run(spark, rows)
    assert got == brute(rows)
    # copies do not pair all with all
    assert len(got) <= 5 * 46


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, [1.0] * 96)]) == set()


def test_same_curves_everywhere():
    u = np.eye(96)[:5]
    assert (curve_keys(u, 3, 7) == curve_keys(u[:2], 3, 7)[[0, 1, 0, 0, 0]])[:2].all()


@pytest.mark.parametrize("jitter,recall", [(2e-5, 0.99), (2e-4, 0.99), (3e-2, 0.95)])
def test_cluster_of_near_copies(spark, jitter, recall):
    # Cosines within the cluster: all 1.000000; few values; all different. Ids stand in no order along the curves.
    rng = np.random.default_rng(5)
    centre, ids = rng.standard_normal(96), rng.permutation(4000)
    rows = [(int(i), (centre + jitter * rng.standard_normal(96)).tolist()) for i in ids] + [(10_000 + i, v) for i, v in clusters(600, 6)]
    want, got = brute(rows), run(spark, rows)
    assert len(got & want) >= recall * len(want) and len(got - want) <= (1 - recall) * len(got)
