import math

import numpy as np
import pytest

from vacantia.llm import whitening
from vacantia.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component int"


def frame(spark, vectors, parts=5):
    return spark.createDataFrame([(k, [None if x is None else float(x) for x in v] if v is not None else None, 1, "x", None) for k, v in enumerate(vectors)], SCHEMA).repartition(parts)


def grid(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], dtype=object)


def check(spark, vectors, keep=None, parts=5):
    """All columns against a dense eigendecomposition of the exactly centred rows."""
    df = frame(spark, vectors, parts)
    model = whitening.fit(df)
    got = {}
    for r in whitening.components_of(whitening.whiten(df, model), model).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    ids = [k for k, v in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v) and (keep is None or keep(v))]
    x = grid([vectors[k] for k in ids])
    n, s = len(x), x.sum(axis=0)
    exact = n * x - s
    y = exact.astype(np.float64) / n
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w.T[::-1]
    assert sorted(got) == ids
    k = min(8, x.shape[1])
    for i, key in enumerate(ids):
        rows = got[key]
        assert sorted(rows) == list(range(1, len(rows) + 1)) and len(rows) <= k
        for c, r in rows.items():
            assert r.n == n and r.deviation == sum(int(v) ** 2 for v in exact[i])
            assert r.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-6) and r.identity_error < 1e-9
    for c in range(1, len(got[ids[0]]) + 1):
        mine = np.array([got[key][c].whitened for key in ids])
        theirs = y @ w[c - 1] / np.sqrt(e[c - 1])
        theirs *= np.sign(mine @ theirs)
        assert np.abs(mine - theirs).max() < 1e-6 * max(1, np.abs(theirs).max())
    return model


def random_vectors(n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.geomspace(1, 0.05, d)).tolist()


def test_against_eigendecomposition(spark):
    model = check(spark, random_vectors())
    assert model.passes >= 2


def test_nulls_and_odd_lengths_are_left_out(spark):
    odd = [None, [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [], [1.0], [3e38] * 12]
    vectors = odd + random_vectors(100) + odd
    check(spark, vectors, keep=lambda v: len(v) == 12 and max(v) < 1e30)


def test_a_hot_vector_and_fewer_dimensions_than_components(spark):
    check(spark, random_vectors(60, 3) + [[0.5, 0.25, -1.0]] * 300)


def test_ill_conditioned_rows_need_more_passes(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 5)) * 1000
    wide = np.hstack([base, base[:, :3] + rng.integers(0, 2, (300, 3)) / 1024])
    model = whitening.fit(frame(spark, wide.tolist()))
    assert model.identity_error < 1e-6 and model.passes >= 2


def test_directions_of_no_variance_have_no_component(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-4000, 4000, (200, 3)) / 1024
    vectors = np.hstack([base, base[:, :1] * 2, np.full((200, 1), 0.5)]).tolist()
    df = frame(spark, vectors)
    model = whitening.fit(df)
    assert len(model.components) == 3 and model.identity_error < 1e-9
    assert whitening.components_of(whitening.whiten(df, model), model).count() == 600


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []]])
def test_without_variance_no_rows(spark, vectors):
    df = frame(spark, vectors, 1)
    model = whitening.fit(df)
    assert whitening.components_of(whitening.whiten(df, model), model).collect() == []


def test_deviations_are_exact_at_every_size():
    rng = np.random.default_rng(1)
    for n, spread in ((10, 50), (10**7, 1000), (10**11, 10**5), (10**9, 10**12)):
        x = rng.integers(100_000 - spread, 100_000 + spread, (20, 9))
        sums = [int(n * v + k) for k, v in enumerate(x[0].tolist())]
        model = whitening.Whitening(n, sums, np.empty((0, 9)), np.empty(0), np.empty(0), 0)
        assert model.deviations(x) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def test_triangular_solve_and_shift():
    rng = np.random.default_rng(2)
    r = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    rows = rng.normal(size=(40, 70))
    assert np.allclose(whitening.solved(rows, r) @ r, rows)
    x = np.ones((50, 4))
    f = whitening.shifted_cholesky(x.T @ x, 50, shifted=True)
    assert np.allclose(f.T @ f, x.T @ x) and np.allclose(f, np.triu(f))


def test_query_agrees_with_numpy(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = QUERIES["op12_whitening"](spark, sf).collect()
    y = grid(vectors)
    y = (len(y) * y - y.sum(axis=0)).astype(np.float64) / len(y)
    e = np.linalg.eigvalsh(y.T @ y / len(y))[::-1]
    assert len(rows) == 8 * len(vectors)
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-6) for r in rows)
