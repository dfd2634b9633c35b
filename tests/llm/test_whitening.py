import numpy as np
import pytest

from intelweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component string, id int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 7, "x", "c", 7) for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, count):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [sum(c) for c in fit.T.tolist()]
    centre = fit.mean(0, dtype=np.longdouble)
    c = np.asarray(fit - centre, np.float64)
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return n, deviation, np.asarray(x - centre, np.float64) @ axes / np.sqrt(values), values / np.trace(v)


def skewed(n, dim, seed, decay=0.9):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return ((rng.standard_normal((n, dim)) * decay ** np.arange(dim)) @ turn + rng.standard_normal(dim)).astype(np.float32)


@pytest.mark.parametrize("n,dim,count,decay", [(400, 24, 5, 0.9), (600, 80, 6, 0.97), (300, 12, 16, 0.9), (300, 60, 4, 0.6)])
def test_rows_equal_a_dense_eigensolver(spark, n, dim, count, decay):
    vectors = skewed(n, dim, dim, decay)
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 50, 0)])
    rows = whitening.whiten(table(spark, vectors.tolist()), count).collect()
    fits, deviation, whitened, explained = brute(vectors, count)
    k = min(count, dim)
    assert len(rows) == len(vectors) * k
    got = np.full((len(vectors), k), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == fits and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * whitened[:, :k]).sum(0))
    assert np.abs(got * sign - whitened[:, :k]).max() < 1e-6


def test_the_filter_needs_few_passes_and_is_certified(spark):
    vectors = skewed(500, 96, 3, 0.95)
    rows = table(spark, vectors.tolist()).select(whitening.scaled("embedding").alias("x"))
    blocks = whitening.fit_blocks(rows, 96)
    found = whitening.leading(blocks, whitening.moments(blocks, 96), 4)
    assert found.residual <= 1e-11 and found.passes <= 40


def test_a_wrong_lower_bound_does_not_mislead(spark):
    # most unwanted eigenvalues are equal, a few are almost zero: far outside of what mean and spread suggest
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((4000, 60)) * np.r_[np.linspace(9, 6, 6), np.full(52, 5.0), 0.05, 0.05]
    rows = table(spark, vectors.astype(np.float32).tolist()).select(whitening.scaled("embedding").alias("x"))
    blocks = whitening.fit_blocks(rows, 60)
    found = whitening.leading(blocks, whitening.moments(blocks, 60), 5)
    x = np.floor(64 * vectors.astype(np.float32).astype(float))
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:5]
    assert np.abs(found.values / want - 1).max() < 1e-10


def test_odd_rows_have_defined_results(spark):
    vectors = [[1, 2], [2, 1], [1, 2], None, [], [1, None], [float("nan"), 1], [float("inf"), 1], [1e20, 0], [1, 2, 3], [0, 5]]
    rows = whitening.whiten(table(spark, vectors, [0, 1, None, 3, 4, 5, 6, 7, 8, 9, None])).collect()
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted((i, c) for i in ("0", "1", "None", "None") for c in (1, 2))
    assert {r.n for r in rows} == {3}


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(table(spark, [[1, 2]] * 5)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    flat = whitening.whiten(table(spark, [[i, 2 * i, 0] for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and {round(r.explained, 6) for r in flat} == {1.0}


def test_large_entries_stay_exact():
    m = whitening.Moments(3, [1 << 40, -7])
    x = np.array([[1 << 40, 0], [5, 1]], np.int64)
    assert whitening.deviations(x, m) == [None, None]
    m = whitening.Moments(3, [1 << 29, -7])
    x = np.array([[1 << 29, 0], [5, 1]], np.int64)
    assert whitening.deviations(x, m) == [(3 * a - (1 << 29)) ** 2 + (3 * b + 7) ** 2 for a, b in x.tolist()]
