"""op11: covariances by polarisation, against sums over exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import whiten

VEC = "vec_id long, embedding array<double>"


def brute(rows, components=32, scale=64, shift=1_000_000):
    """(n, deviations, components by falling eigenvalue with their whitened values)."""
    x = [[math.floor(scale * c) + shift for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = np.array([[float(Fraction(v, n)) for v in r] for r in y]) @ vectors[:, :components] / np.sqrt(values[:components])
    return n, [sum(v * v for v in r) for r in y], values, z


def held_to(got, rows, components=32):
    n, deviations, values, z = brute(rows, components)
    k = min(components, len(rows[0][1]))
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == len(rows) * k
    own = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i, _ in rows])
    assert np.allclose(own * np.sign((own * z).sum(axis=0)), z, atol=1e-6)
    for (i, _), d in zip(rows, deviations):
        assert {(r["n"], int(r["deviation"])) for r in (by[i, c + 1] for c in range(k))} == {(n, d)}
    assert all(math.isclose(by[rows[0][0], c + 1]["explained"], values[c] / values.sum(), rel_tol=1e-9) for c in range(k))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("size", [1.0, 1e6, 1e11])
def test_equals_sums_of_fractions(spark, size):
    """Also where squares pass 64 bits, and where centred values do."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=9) * size * np.arange(1, 10)).tolist()) for i in range(120)]
    held_to(whiten.whitened(spark.createDataFrame(rows, VEC).repartition(3)).collect(), rows)
    held_to(whiten.whitened(spark.createDataFrame(rows, VEC), components=4).collect(), rows, 4)


def test_query_equals_sums_of_fractions(spark, small):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = whiten.op11_whitening(spark, small)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held_to(got.collect(), rows)


def test_squares_of_sums_are_exact():
    rng = np.random.default_rng(1)
    for bits in (8, 30, 40, 55, 61):
        z = rng.integers(-(2**bits), 2**bits, (50, 4))
        want = [sum(int(v) ** 2 for v in c) for c in z.T]
        assert whiten._squares(z) == want == whiten._squares(z.astype(object))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [0.0, 5.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VEC + ", n int, i int, dim string")
    got = whiten.whitened(df).collect()
    two = [r for r in got if r["vec_id"] != 8]
    assert sorted((str(r["vec_id"]), r["component"]) for r in two) == sorted((i, c) for i in ("1", "1", "None", "9") for c in (1, 2))
    assert {r["n"] for r in two} == {4} and all(r["identity_error"] < 1e-9 for r in two)
    alone = [r for r in got if r["vec_id"] == 8]  # the only one of its length: nothing varies
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)] * 3


def test_component_without_variance(spark):
    rows = [(i, [float(i), 3.0, float(i % 5)]) for i in range(40)]
    got = whiten.whitened(spark.createDataFrame(rows, VEC)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got) and got[0]["identity_error"] < 1e-9
    assert math.isclose(sum(r["explained"] for r in got if r["vec_id"] == 0), 1.0, rel_tol=1e-9)


def test_no_vectors_and_huge_ones(spark):
    assert whiten.whitened(spark.createDataFrame([], VEC)).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        whiten.whitened(spark.createDataFrame([(1, [1e300]), (2, [0.0])], VEC)).collect()
