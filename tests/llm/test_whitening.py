import math

import numpy as np
import pytest

from panelspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component int, sums double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "x", 3, 0.5) for i, v in rows], SCHEMA)


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    return kept, n, deviation, centred, cov


SPECTRA = {"plain": lambda d: np.linspace(3, 1, d), "pairs": lambda d: np.repeat(np.linspace(3, 1, d // 2), 2), "steep": lambda d: 30.0 * 2.0 ** -np.arange(d) + 0.3}


@pytest.mark.parametrize("spectrum", SPECTRA)
def test_equals_the_eigenvectors_of_the_covariance(spark, spectrum):
    rng = np.random.default_rng(5)
    d = 40
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    rows = [(i, (rng.standard_normal(d) * SPECTRA[spectrum](d)) @ turn + 5) for i in range(300)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (900, None), (901, [None] * d), (902, [math.nan] * d), (903, [math.inf] + [0.0] * (d - 1))]
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    kept, n, deviation, centred, cov = plain(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    assert len(got) == 32 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    want = centred @ vectors / np.sqrt(values)
    own = np.array([[by[i, dev][c + 1][0] for c in range(32)] for (i, _), dev in zip(kept, deviation, strict=True)])
    if spectrum == "pairs":  # any pair of axes of a plane will do: lengths agree
        assert np.allclose(own @ own.T, want @ want.T, atol=1e-6)
    else:
        assert np.allclose(own * np.sign((own * want).sum(axis=0)), want, atol=1e-7)
    assert np.abs(own.T @ own / n - np.eye(32)).max() < 1e-9


def test_edges(spark):
    whiten = lambda rows: whitening.whiten(table(spark, rows)).collect()
    assert whiten([]) == [] and whiten([(1, None), (2, [])]) == [] and whiten([(1, [1.0, 2.0])]) == [] and whiten([(i, [1.0, 2.0]) for i in range(5)]) == []
    # Other lengths take no part; one direction only has variance; an entry too large for a long.
    got = whiten([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 2.0, 3.0]), (None, [0.0, 0.0]), (4, [1e30, 0.0])])
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"]) for r in got) == [(0, 1, 4, (64 * 5) ** 2), (1, 1, 4, 64**2), (2, 1, 4, (64 * 3) ** 2), (2, 1, 4, (64 * 3) ** 2)]
    assert all(r["explained"] == 1.0 for r in got) and sum(r["whitened"] ** 2 for r in got) / 4 == pytest.approx(1)


def test_deviations_beyond_long_are_null_and_others_exact(spark):
    got = whitening.whiten(table(spark, [(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])).collect()
    want = {1: (4 * 64 * 10**9) ** 2, 3: (4 * 64) ** 2}
    assert {r["vec_id"]: r["deviation"] for r in got}[3] == want[3] and {r["vec_id"]: r["deviation"] for r in got}[1] is None


def test_a_large_mean_costs_no_digits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4) + np.array([4000, -9000, 7000, 100])) for i in range(200)]
    got = whitening.whiten(table(spark, rows)).collect()
    _, _, _, _, cov = plain(rows)
    values = np.linalg.eigvalsh(cov)[::-1]
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-12)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "equal", "two", "falling", "near", "zero"])
def test_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"random": rng.random(d), "equal": np.ones(d), "two": np.repeat([3.0, 1.0], d)[::2][:d], "falling": 10.0 ** -np.arange(d), "near": 5 + 1e-13 * np.arange(d), "zero": np.zeros(d)}[kind]
    m = (turn * values) @ turn.T
    m = (m + m.T) / 2
    k = min(32, d)
    found, vectors = whitening.principal(m, k)
    assert np.abs(found - np.linalg.eigvalsh(m)[::-1][:k]).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and np.abs(m @ vectors - vectors * found).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diagonal, beside = rng.standard_normal(20), rng.standard_normal(19)
    full = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    x = np.linspace(-4, 4, 33)
    assert whitening.smaller(diagonal, beside, x).tolist() == [(np.linalg.eigvalsh(full) < v).sum() for v in x]
