"""Whitening against numpy and whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from segline.llm import queries, whitening

SF = "/root/testdata/sf0.01"
VECS = "vec_id long, embedding array<double>, x binary, n long, deviation string"


def plain(vectors):
    """Of (id, vector) rows: n, {id: deviation}, covariance, mean, integers."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in vectors}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    z = np.array(fit, float) - np.array([s / n for s in sums])
    return n, far, z.T @ z / n, sums, x


def check(rows, vectors, k=4):
    n, far, v, sums, x = plain(vectors)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, len(sums))
    assert len(rows) == k * len(vectors)
    by = {}
    for r in rows:
        assert (r["n"], int(r["deviation"])) == (n, far[r["vec_id"]])
        assert r["identity_error"] <= 1e-4
        by[r["vec_id"], r["component"]] = r
    for c in range(k):
        if e[c] <= e[0] * len(e) * 2.3e-16:
            assert all(by[i, c + 1]["whitened"] == by[i, c + 1]["explained"] == 0.0 for i in x)
            continue
        want = {i: float((np.array(a) - np.array([s / n for s in sums])) @ u[:, c]) / math.sqrt(e[c]) for i, a in x.items()}
        sign = 1 if max(want.items(), key=lambda p: abs(p[1]))[1] * by[max(want, key=lambda i: abs(want[i])), c + 1]["whitened"] > 0 else -1
        for i, y in want.items():
            assert by[i, c + 1]["whitened"] == pytest.approx(sign * y, abs=1e-7)
            assert by[i, c + 1]["explained"] == pytest.approx(e[c] / np.trace(v), rel=1e-6)


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for n, width, top in ((1, 1, 1), (63, 3, 2), (64, 5, 400), (131, 4, 1 << 20), (70, 3, 1 << 41)):
        x = rng.integers(0, top, (n, width), endpoint=True)
        got = whitening.cross_products(whitening.bit_planes(x, int(top).bit_length()))
        rows = x.tolist()
        assert got == [[sum(r[i] * r[j] for r in rows) for j in range(i, width)] for i in range(width)]


def test_query_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 100)
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op13_whitening(spark, SF).collect(), vectors)


def test_odd_vectors(spark):
    good = [(1, [0.5, -1.0, 3.0]), (2, [0.5, -1.0, 3.0]), (3, [-0.001, 1e6, 0.25]), (4, [7.0, 2.0, -0.0]), (5, [1.0, 1.0, 1.0])]
    bad = [(6, None), (7, [None, 1.0, 2.0]), (8, [float("nan"), 1.0, 2.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0, 2.0]), (11, [])]
    df = spark.createDataFrame([(*r, b"1", 3, "d") for r in good + bad], VECS)
    check(whitening.whiten(df).collect(), good)
    again = spark.createDataFrame([(*r, b"1", 3, "d") for r in [*good, good[0], (None, good[0][1])]], VECS)
    rows = whitening.whiten(again, 2).collect()
    assert len(rows) == 14 and sum(r["vec_id"] is None for r in rows) == 2 and {r["n"] for r in rows} == {4}
    assert whitening.whiten(df.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert {(r["whitened"], r["explained"], int(r["deviation"]), r["identity_error"]) for r in whitening.whiten(flat).collect()} == {(0.0, 0.0, 0, 0.0)}
    line = [(i, [float(i), 2.0 * i]) for i in range(9)]
    check(whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")).collect(), line)
