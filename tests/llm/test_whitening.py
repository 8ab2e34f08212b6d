"""Embedding whitening against plain eigenvectors and Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from docspark.llm.whitening import fit_whitening, leading_components, polar_factor, whitening_report

ROWS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("n", T.StringType()), T.StructField("whitened", T.StringType())])


def brute(rows, wanted=4):
    """Exact sums in Python, eigenvectors from numpy."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in distinct])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    out = {}
    for i, x in kept:
        exact = [n * a - b for a, b in zip(x, s, strict=True)]
        out.setdefault(i, []).append((sum(d * d for d in exact), np.array(exact) / n @ q / np.sqrt(e)))
    return n, e / np.trace(v), out


def check(rows, got, wanted=4):
    n, explained, expected = brute(rows, wanted)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(by_id) == set(expected)
    signs = {}
    for i, copies in expected.items():
        for k in range(wanted):
            found = by_id[i][k + 1]
            assert len(found) == len(copies)
            for r in found:
                assert r["n"] == n and r["deviation"] == copies[0][0]
                assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
                assert r["identity_error"] < 1e-9
                want = copies[0][1][k]
                if abs(want) > 1e-6:
                    signs.setdefault(k, set()).add(round(r["whitened"] / want, 5))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == wanted


def test_against_brute_force(spark):
    random = np.random.Generator(np.random.PCG64(5))
    base = random.normal(0, 1, (300, 12)) * np.linspace(3, .2, 12) + np.linspace(-5, 5, 12)
    rows = [(i, [float(c) for c in v.astype(np.float32)], "x", None) for i, v in enumerate(base)]
    # Repeated vectors, repeated rows, null ids; nulls, non-finite entries, another width.
    rows += [(1000 + i, rows[0][1], None, "y") for i in range(500)] + [rows[3], (None, rows[4][1], "n", "w")]
    bad = [(9000, None, "x", "x"), (9001, [1.0] * 11 + [None], "x", "x"), (9002, [1.0] * 11 + [math.nan], "x", "x"),
           (9003, [math.inf] + [1.0] * 11, "x", "x")]
    frame = spark.createDataFrame([*rows, *bad, (9004, [1.0, 2.0], "x", "x")], ROWS).repartition(5)
    check([*rows, *bad], whitening_report(frame).collect())


def test_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    check(rows, whitening_report(frame).collect())


def test_huge_entries_stay_exact(spark):
    rows = [(i, [1e9 * i, 3e8 - i * 7e7, float(i % 3)], "x", "x") for i in range(40)]
    rows = [(i, [float(np.float32(c)) for c in v], a, b) for i, v, a, b in rows]
    got = whitening_report(spark.createDataFrame(rows, ROWS), 2).collect()
    n, explained, expected = brute(rows, 2)
    for r in got:
        exact = expected[r["vec_id"]][0][0]
        assert r["deviation"] == (exact if exact < 2 ** 63 else None)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-4, abs=1e-9)


def test_beyond_a_long(spark):
    rows = [(0, [1e30, 1.0], "x", "x"), (1, [-1e30, 2.0], "x", "x"), (2, [0.0, 3.0], "x", "x")]
    got = whitening_report(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 0} == {None}


def test_defined_results_without_variance(spark):
    assert whitening_report(spark.createDataFrame([], ROWS)).collect() == []
    assert whitening_report(spark.createDataFrame([(1, None, "", ""), (2, [], "", "")], ROWS)).collect() == []
    one = whitening_report(spark.createDataFrame([(1, [1.0, 2.0], "", "")] * 3, ROWS)).collect()
    assert len(one) == 6 and {r["n"] for r in one} == {1}
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one} == {(None, None, None, 0)}
    flat = whitening_report(spark.createDataFrame([(i, [float(i), 7.0], "", "") for i in range(9)], ROWS)).collect()
    assert all(r["whitened"] is not None for r in flat if r["component"] == 1)
    assert {r["whitened"] for r in flat if r["component"] == 2} == {None}


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [9, 9, 9, 1, 1, 0], [1e6, 1, 1e-3, 0, 0], [2, 0, -2], [7],
    list(np.linspace(1, 2, 40)), [3, 3 + 1e-9, 3 - 1e-9, 0]])
def test_spectrum(values):
    random = np.random.Generator(np.random.PCG64(len(values)))
    q = np.linalg.qr(random.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    a = (a + a.T) / 2
    e, v = leading_components(a, len(values))
    scale = np.abs(values).max()
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-12 * scale)
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(a @ v - v * e) < 1e-11 * scale * len(values)


def test_polar_factor_is_orthogonal():
    a = np.array([[0., 1., 0.], [1., 0., 2.], [0., 2., -3.]])
    u = polar_factor(a)
    assert np.allclose(u @ u, np.eye(3), atol=1e-13) and np.linalg.eigvalsh(u @ a).min() > 0


def test_all_components_by_default(spark):
    frame = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.5 * (i % 4)], "", "") for i in range(30)], ROWS)
    model = fit_whitening(frame)
    assert model.vectors.shape == (3, 3) and sum(model.values) == pytest.approx(model.trace)
