import numpy as np
import pytest

from nearlabel.operators import cca
from nearlabel.operators.graph import Scratch


def made(seed, n, terms, labels):
    rng = np.random.default_rng(seed)
    y = (rng.random((n, labels)) < 0.3).astype(float)
    x = np.maximum(0, rng.normal(size=(n, terms)) - 1) + (y @ rng.random((labels, terms))) * (rng.random((n, terms)) < 0.4)
    x[3], y[3], x[5], y[7] = 0, 0, 0, 0  # documents without terms, labels or either
    return x, y


def frame(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "doc_id long, pos long, w double")


def dense(x, y, ridge):
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    root = lambda g: (lambda v, u: u / np.sqrt(v) @ u.T)(*np.linalg.eigh(g))
    return np.linalg.svd(root(x.T @ x + ridge * np.eye(x.shape[1])) @ (x.T @ y) @ root(y.T @ y + ridge * np.eye(y.shape[1])))[1]


@pytest.mark.parametrize(("components", "labels", "rounds", "close"), [(100, 4, 1, 1e-6), (1, 3, 3, 2e-2)])
def test_correlations_equal_dense_ones(spark, monkeypatch, components, labels, rounds, close):
    """A block of all labels is exact at once; a narrow one nears the largest correlations round by round."""
    monkeypatch.setattr(cca, "EXTRA", 1)
    x, y = made(1, 40, 12, labels)
    scratch = Scratch(spark, "cca")
    a, b, rho = cca.canonical(frame(spark, x), frame(spark, y), len(x), labels, scratch, components, ridge=0.5, tol=1e-7, rounds=rounds)
    want = dense(x, y, 0.5)[: len(rho)]
    assert len(rho) == min(components, labels) and np.abs(rho - want).max() < close
    # the vectors reach these correlations
    k = len(rho)
    va, vb = np.zeros((x.shape[1], k)), np.zeros((y.shape[1], k))
    for m, rows in ((va, a), (vb, b)):
        for r in rows.collect():
            m[r.pos] = r[1:]
    cx, cy = x - x.mean(axis=0), y - y.mean(axis=0)
    assert np.allclose(np.diag((cx @ va).T @ (cy @ vb)), rho, atol=1e-5)


def single(z, sign, penalty, rounds=4000):
    """One machine alone, by plain gradient steps."""
    w = np.zeros(z.shape[1])
    curve = 2 * np.linalg.eigvalsh(z.T @ z).max() + penalty
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9 * curve
    for _ in range(rounds):
        w -= (-2 * (np.maximum(0, 1 - sign * (z @ w)) * sign) @ z + ridge * w) / curve
    return w


def test_machines_equal_single_fits(spark, monkeypatch):
    monkeypatch.setattr(cca, "LABELS", 2)
    rng = np.random.default_rng(4)
    z = np.hstack([rng.normal(size=(60, 3)), np.ones((60, 1))])
    y = np.stack([z[:, 0] > 0.2, z[:, 1] + z[:, 2] > 0, rng.random(60) < 0.1], axis=1)
    rows = spark.createDataFrame([(z[i].tolist(), [int(j) for j in np.nonzero(y[i])[0]]) for i in range(60)], "z array<double>, own array<long>").repartition(3)
    got = np.concatenate([w for _, w in cca.machines(rows, 4, 3, rounds=90)])
    for j in range(3):
        want = single(z, np.where(y[:, j], 1.0, -1.0), 1.0)
        assert np.allclose(got[j], want, atol=5e-2) and ((z @ got[j] > 0) == (z @ want > 0)).mean() > 0.98


@pytest.mark.parametrize("cells", [1 << 23, 30, 0])
def test_rounds_without_joins(spark, monkeypatch, cells):
    """Columns sent whole, two at a time, or, beyond what may be sent, joined: the dense solution, and joins in each round
    only in the last case."""
    x, y = made(2, 40, 12, 4)
    left = cca.Centred(frame(spark, x), len(x), Scratch(spark, "cca"), 0.5)
    right = left.back(frame(spark, y).groupBy("doc_id").pivot("pos", [0, 1, 2, 3]).sum("w").na.fill(0.0).withColumnsRenamed({str(i): f"c{i}" for i in range(4)}), y.mean(axis=0), 4)
    joined, times = [], cca.times
    monkeypatch.setattr(cca, "times", lambda *a: joined.append(1) or times(*a))
    monkeypatch.setattr(cca, "CELLS", cells)
    got = {r.pos: r[1:] for r in left.solve(right, 4, 1e-7, 60).collect()}
    cx = x - x.mean(axis=0)
    want = np.linalg.solve(cx.T @ cx + 0.5 * np.eye(12), cx.T @ (y - y.mean(axis=0)))
    assert np.allclose([got[i] for i in range(12)], want, atol=1e-5)
    assert bool(joined) == (not cells)
