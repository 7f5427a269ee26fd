"""Whitening against a covariance over all vectors at once."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>"


def distinct_of(vectors):
    found = {tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors}
    return np.array(sorted(found), np.int64)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    fit = distinct_of([r.embedding for r in rows])
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = queries.op13_svd_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    of = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for r in rows:
        x = np.array([math.floor(64 * c) + 1_000_000 for c in r.embedding])
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x, sums, strict=True))
        for k in range(16):
            one = of[r.vec_id, k + 1]
            want = (x - sums / n) @ vectors[:, k] / np.sqrt(values[k])
            signs.setdefault(k, np.sign(want * one.whitened))
            assert one.whitened == pytest.approx(want * signs[k], abs=1e-6)
            assert one.deviation == deviation
            assert one.explained == pytest.approx(values[k] / values.sum(), rel=1e-8)
            assert one.identity_error < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(1, 30), min_size=1, max_size=5), st.integers(0, 2**31), st.booleans())
def test_merges_lose_nothing(d, sizes, seed, far):
    """States of parts merge to that of the whole, whatever the parts' sizes and means."""
    rng = np.random.default_rng(seed)
    parts = [rng.integers(-50, 50, (k, d)) + (rng.integers(0, 1 << 30) if far else 0) for k in sizes]
    state = whitening.State.of(parts[0])
    for part in parts[1:]:
        state = state.merged(whitening.State.of(part))
    x = np.concatenate(parts)
    assert (state.n, state.sums) == (len(x), x.sum(0).tolist())
    exact = [[sum((Fraction(int(a)) - Fraction(int(m), len(x))) * (int(b) - Fraction(int(k), len(x))) for a, b in zip(x[:, i], x[:, j], strict=True)) for j, k in enumerate(state.sums)] for i, m in enumerate(state.sums)]
    exact = np.array([[float(v) for v in row] for row in exact])
    made = state.vectors.T @ np.diag(state.values**2) @ state.vectors
    assert np.abs(made - exact).max() <= 1e-9 * max(1.0, np.abs(exact).max())


def test_levels_of_merging(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = whitening.whole_numbers(rows, "embedding").select("__x").distinct().withColumnRenamed("__x", "x").repartition(13)
    states = x.mapInArrow(whitening._states, whitening.STATE)
    few, many = whitening.merged_states(states, 2), whitening.merged_states(states, 64)
    assert few.n == many.n and few.sums == many.sums
    assert np.allclose(few.values, many.values, rtol=1e-10)


def hard(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [0.0, nan]), (None, [1.5, -1.0]), (6, [1.0]), (7, []), (8, [-2.0, 0.25])]
    return spark.createDataFrame(rows, KIND).selectExpr("*", "'w' as whitened", "'n' as n")


def test_hard_rows(spark):
    docs = hard(spark)
    model = whitening.fit(docs)
    assert model.n == 3 and len(model.components) == 2
    rows = whitening.whiten(docs, model).collect()
    assert sorted(r.vec_id or 0 for r in rows) == [0, 1, 1, 8]
    assert {r.n for r in rows} == {"n"}
    one, two = (r for r in rows if r.vec_id == 1)
    assert one == two
    got = np.array([r.whitened for r in rows if r is not two])
    assert np.abs(got.T @ got / 3 - np.eye(2)).max() < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_varies(spark, tmp_path, rows):
    """Without two different vectors there is no component, and so no row."""
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_svd_whitening(spark, str(tmp_path)).collect() == []


def test_fewer_directions(spark):
    """Vectors on a line far from zero have one component."""
    rows = [(i, [float(i), 2.0 * i, 7.0, 4096.0 + i]) for i in range(40)]
    model = whitening.fit(spark.createDataFrame(rows, KIND))
    assert len(model.components) == 1 and model.error < 1e-12


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40], [5]])
    assert whitening.deviations(x, 1 << 20, [0]) == [None, (5 << 20) ** 2]
    assert whitening.deviations(np.array([[3, 4], [0, 1]]), 3, [1, 2]) == [8 * 8 + 10 * 10, 1 + 1]
