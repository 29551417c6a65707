"""Whitening against numpy's eigenvalues and plain integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import whitening
from crestline.llm.whitening import above, brackets, leading, op12_embedding_whitening, slices, tridiagonal, whiten

SF = "/root/testdata/sf0.001"


def plain(vectors):
    """Distinct integer vectors, n, S, falling eigenvalues and vectors, trace."""
    fit = sorted({tuple(int(np.floor(256.0 * np.float64(c))) for c in v) for v in vectors})
    n, x = len(fit), np.array(fit, object)
    sums = x.sum(axis=0)
    c = ((n * x - sums) / n).astype(float)
    v = c.T @ c / n
    values, own = np.linalg.eigh(v)
    return n, sums, values[::-1], own[:, ::-1], np.trace(v)


def test_every_row_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, values, own, trace = plain([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in op12_embedding_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in rows:
        x = np.array([int(np.floor(256.0 * c)) for c in r.embedding], object)
        for k in range(4):
            g = got[r.vec_id, k + 1]
            want = float(((n * x - sums) / n).astype(float) @ own[:, k] / np.sqrt(values[k]))
            signs.setdefault(k, np.sign(want * g.whitened))
            assert g.whitened == pytest.approx(signs[k] * want, abs=1e-11)
            assert g.deviation == sum(int(v) ** 2 for v in n * x - sums) and g.n == n
            assert g.explained == pytest.approx(values[k] / trace, rel=1e-12) and 0 <= g.identity_error < 1e-12


def test_odd_rows(spark):
    """Null and broken vectors, other lengths, huge entries, repeated rows, clashing columns, no rows."""
    nan, inf = float("nan"), float("inf")
    fine = [[0.0, 1.0, 2.5], [1.0, -1.0, 0.0], [3.0, 1.0, -0.001], [0.0, 1.0, 2.5], [-2.0, 0.5, 1.0]]
    rows = [(n, v, 1, "x") for n, v in enumerate(fine)] + [(None, fine[1], 2, "y"), (0, fine[0], 1, "x")]
    bad = [(50, None, 1, "x"), (51, [], 1, "x"), (52, [1.0, None, 2.0], 1, "x"), (53, [nan, 1.0, 1.0], 1, "x"), (54, [1.0, -inf, 1.0], 1, "x"), (55, [1.0, 2.0], 1, "x")]
    got = whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, d int, x string")).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(r[0]), k) for r in rows for k in (1, 2, 3))
    n, sums, values, own, trace = plain(fine)
    assert {r.n for r in got} == {4}
    for r in got:
        x = np.floor(256.0 * np.array(next(v for i, v, *_ in rows if i == r.vec_id), np.float32).astype(float)).astype(int)
        assert abs(r.whitened) == pytest.approx(abs(float((x - np.array(sums, float) / n) @ own[:, r.component - 1] / np.sqrt(values[r.component - 1]))), abs=1e-9)
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    huge = whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e15, 1.0])], schema)).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in huge)
    x = [[int(whitening.LARGEST), 0], [-int(whitening.LARGEST), 256], [int(5e15) * 256, 256]]
    want = {k + 1: sum((3 * x[k][i] - sum(r[i] for r in x)) ** 2 for i in range(2)) for k in range(3)}
    assert {r.vec_id: None if r.deviation is None else int(r.deviation) for r in huge} == {k: v if v < 10**38 else None for k, v in want.items()}


def matrix(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


SPECTRA = {
    "falling": np.geomspace(100, 1e-3, 40), "flat": np.full(12, 3.0), "tied leaders": np.r_[5.0, 5.0, 5.0, 5.0, 5.0, np.linspace(1, 0.1, 20)],
    "one giant": np.r_[1e8, 1.0, 0.9, 0.8, 0.7, np.linspace(0.69, 0.5, 60)], "tie at the cut": np.r_[9.0, 4.0, 3.0, 2.0, 2.0, 2.0, 1.0, np.zeros(30)],
    "close": np.r_[1.0, 1 - 1e-6, 1 - 2e-6, 1 - 1e-5, 1 - 3e-5, np.linspace(0.9, 0.1, 30)], "low rank": np.r_[2.0, 1.0, np.zeros(20)], "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_of_known_spectra(spark, name):
    values = SPECTRA[name]
    v = matrix(values, len(values))
    v = (v + v.T) / 2
    want = np.sort(values)[::-1][:4]
    want = want[want > 0]
    got, own = leading(spark, v, 4)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12 * values.max())
    assert np.abs(own.T @ own - np.eye(len(got))).max() < 1e-12
    assert np.linalg.norm(v @ own - own * got, axis=0).max() < 1e-12 * values.max()


def test_inertia_counts():
    values = np.r_[np.linspace(0, 3, 30), 3.0, 7.5]
    tri = tridiagonal(matrix(values, 3))
    shifts = np.array([-1.0, 0.05, 1.5001, 2.99, 3.01, 7.4, 7.6])
    assert above(tri, shifts).tolist() == [(values > s).sum() for s in shifts]
    low, high = brackets(tri, 8.0)
    falling = np.sort(values)[::-1]
    assert ((low - 1e-9 <= falling) & (falling <= high + 1e-9)).all()
    found = slices(low, high, 3, 8.0)
    assert [(s.first, s.last) for s in found] == [(0, 0), (1, 2)]


def test_a_vector_that_a_third_of_rows_have_counts_once(spark):
    base = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    hot = base.limit(1).crossJoin(spark.range(100)).select((F.col("id") + 10**6).alias("vec_id"), "embedding")
    one = {r.vec_id: r.whitened for r in whiten(base).filter("component = 1").collect()}
    two = {r.vec_id: r.whitened for r in whiten(base.unionByName(hot)).filter("component = 1").collect()}
    assert all(two[k] == pytest.approx(w, abs=1e-9) for k, w in one.items()) and len(two) == len(one) + 100
