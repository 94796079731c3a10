from fractions import Fraction

import numpy as np
import pytest

from veilscan.llm.jacobi_whitening import integers, jacobi_davidson, minres, whitened

DDL = "vec_id long, embedding array<float>, n long, component int"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], -1, -2) for i, v in enumerate(vectors)], DDL)


def brute(vectors, most=32):
    """Exact sums, covariance from exact fractions, dense eigenvectors."""
    kept = {i: v for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in kept.items()}
    n = len(x)
    sums = [sum(col) for col in zip(*x.values(), strict=True)]
    gap = {i: [n * a - s for a, s in zip(v, sums, strict=True)] for i, v in x.items()}
    centred = np.array([[float(Fraction(g, n)) for g in v] for v in gap.values()])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    real = values > 1e-12 * values[0]
    white = centred @ (axes[:, real] / np.sqrt(values[real]))
    return list(x), n, [sum(g * g for g in v) for v in gap.values()], values[real], white, (centred**2).sum() / n


def check(spark, vectors, most=32):
    rows = whitened(table(spark, vectors), most).collect()
    ids, n, deviation, values, white, trace = brute(vectors, most)
    assert len(rows) == len(ids) * len(values)
    near = 1e-8 + 1e-14 * values[0] / values[-1]  # what doubles allow
    got = np.empty((len(ids), len(values)))
    for r in rows:
        i = ids.index(r["vec_id"])
        got[i, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == (deviation[i] if deviation[i] < 1 << 63 else None)
        assert abs(r["explained"] - values[r["component"] - 1] / trace) < near * r["explained"] and r["identity_error"] < min(near, 1e-4)
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 10 * near


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = list((r.standard_normal((300, 64)) * np.linspace(3, 0.2, 64)).astype(np.float32))
    check(spark, [*vectors, None, [None, *[0] * 63], [float("nan"), *[0] * 63], [float("inf"), *[0] * 63]])


def test_subspace_smaller_than_the_space(spark):
    r = np.random.default_rng(2)
    check(spark, list((r.standard_normal((400, 90)) * np.geomspace(20, 1, 90)).astype(np.float32)), most=4)


def test_low_rank_huge_entries_and_repeats(spark):
    r = np.random.default_rng(3)
    check(spark, list((r.standard_normal((40, 3)) @ r.standard_normal((3, 10)) * 10).astype(np.float32)))
    check(spark, [[1e9, 2.0], [-1e9, 3.0], [5e8, -7.0]] * 4)
    check(spark, [[1.0], [2.0], [2.0]])
    check(spark, [[1.0, 2.0]] * 90 + [[2.0, 1.0]])


def test_tables_without_components(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3):
        assert whitened(table(spark, vectors)).count() == 0
    clipped = integers(table(spark, [[3e38, -3e38]])).first()["x"]
    assert clipped == [(1 << 52) + 1_000_000, -(1 << 52) + 1_000_000]


def test_odd_lengths_null_and_repeated_ids(spark):
    r = np.random.default_rng(4)
    rows = table(spark, [[1.0] * 3, *r.standard_normal((20, 4)).tolist(), [0.0]])
    twice = rows.unionAll(rows.selectExpr("CAST(NULL AS long) AS vec_id", "embedding", "n", "component"))
    out = whitened(twice).collect()
    assert len(out) == 40 * 4 and sum(x["vec_id"] is None for x in out) == 80 and {x["n"] for x in out} == {40}


@pytest.mark.parametrize("d,k", [(200, 5), (300, 12), (64, 32)])
def test_solver_locks_all_pairs_with_few_passes(d, k):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    values = np.sort(r.uniform(1, 50, d))[::-1]
    values[: k : 2] += 20
    values = np.sort(values)[::-1]
    a = (q * values) @ q.T
    passes = []

    def apply(block):
        passes.append(block.shape[1])
        return a @ block

    got, vectors = jacobi_davidson(apply, d, k)
    assert np.abs(got - values[:k]).max() < 1e-11
    assert np.abs(a @ vectors - vectors * got).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert len(passes) < 250 and max(passes) <= k + 8


def test_minres_solves_indefinite_systems():
    r = np.random.default_rng(5)
    a = r.standard_normal((30, 30))
    a = a + a.T
    b = r.standard_normal((30, 3))
    assert np.abs(a @ minres(lambda v: a @ v, b, 200, 1e-12) - b).max() < 1e-8
