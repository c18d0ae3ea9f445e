"""Whitening by polarisation against fractions and numpy."""

from fractions import Fraction
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from spanloom.llm import whitening


def brute(rows, components=4):
    """{(vec_id, place, component): (n, deviation, whitened, explained)} from (vec_id, vector), by fractions."""
    use = [(k, i, [floor(256 * float(c)) for c in v]) for k, (i, v) in enumerate(rows) if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, _, x in use})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    c = [[Fraction(n * x[d] - sums[d], n) for d in range(dims)] for x in fit]
    cov = np.array([[float(sum(r[a] * r[b] for r in c) / n) for b in range(dims)] for a in range(dims)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w.T[::-1]
    out = {}
    for k, i, x in use:
        v = np.array([float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)])
        for j in range(min(components, dims)):
            out[i, k, j + 1] = (n, sum((n * x[d] - sums[d]) ** 2 for d in range(dims)), v @ w[j] / np.sqrt(e[j]) if e[j] > 1e-9 else None, e[j] / e.sum())
    return out


def check(spark, rows, parts=3):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)).collect()
    want = brute(rows)
    assert len(found) == len(want)
    key = lambda r: (r[0], r[1], r[2])
    have = sorted(((r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.n) for r in found), key=key)
    should = sorted(((i, j, d, w, x, n) for (i, _, j), (n, d, w, x) in want.items()), key=key)
    signs = {}
    for h, s in zip(have, should, strict=True):
        assert h[:3] == s[:3] and h[5] == s[5] and h[4] == pytest.approx(s[4], rel=1e-9)
        if s[3] is None:
            assert h[3] is None
        else:
            assert abs(h[3]) == pytest.approx(abs(s[3]), rel=1e-6, abs=1e-9)
            if abs(s[3]) > 1e-6:
                signs.setdefault(h[1], set()).add(h[3] * s[3] > 0)
    assert all(len(x) == 1 for x in signs.values())
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_against_fractions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 7)) @ rng.normal(size=(7, 7)) + 3
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    # a third of all rows are one vector; others differ by less than a step
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(2000, [c + 1e-9 for c in rows[1][1]])]
    rows += [(3000, None), (3001, []), (3002, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (3003, [nan] * 7), (3004, [inf] + [0.0] * 6), (5, rows[2][1])]
    check(spark, rows)


@pytest.mark.parametrize("far", [2.0**17, 2.0**30, 2.0**45])
def test_large_values_stay_exact(spark, far):
    """Sums of squares beyond 64 bits, and far from the origin; deviations beyond 63 bits are null."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(c) for c in far * rng.normal(size=3)]) for k in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(i, j): w for (i, _, j), w in brute(rows).items()}
    for r in found:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert r.deviation == (deviation if deviation < 1 << 63 else None)
        assert r.explained == pytest.approx(explained, rel=1e-9) and abs(r.whitened) == pytest.approx(abs(white), rel=1e-6)


@pytest.mark.parametrize("size", [1 << 20, 1 << 40, 1 << 51, 1 << 60])
def test_sums_of_squares_of_any_size(size):
    v = np.random.default_rng(7).integers(-size, size, (whitening.BLOCK, 5))
    assert whitening.squares(v) == [sum(int(c) ** 2 for c in v[:, d]) for d in range(5)]
    pairs = whitening.pair_squares(v.astype(object) if size > 1 << 59 else v)
    assert pairs == [sum(int(a if i == j else a + b) ** 2 for a, b in zip(v[:, i].tolist(), v[:, j].tolist(), strict=True)) for i in range(5) for j in range(i, 5)]


def test_without_variance_and_without_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 1.0), (2, [0.5, 0.25], 2.0), (3, [0.5], 3.0)], "vec_id long, embedding array<float>, whitened double")
    rows = whitening.whiten(one).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows)] == [(i, j, 1, 0, None, None, None) for i in (1, 2) for j in (1, 2)]
    assert whitening.whiten(one.limit(0)).collect() == [] and whitening.whiten(one.selectExpr("vec_id", "cast(null as array<float>) as embedding")).collect() == []
    # two dimensions that say the same: the second component has no variance
    flat = spark.createDataFrame([(k, [k / 8, k / 8]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {(r.component, r.whitened is None) for r in whitening.whiten(flat).collect()} == {(1, False), (2, True)}


def test_query_on_the_given_table(spark):
    import os

    from spanloom.llm.queries import op12_embedding_whitening

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("the test tables aren't here")
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.floor(256 * np.array([v for _, v in rows], float))
    u = np.unique(x, axis=0)
    e, w = np.linalg.eigh(np.cov(u.T, bias=True))
    found = op12_embedding_whitening(spark, sf).collect()
    assert len(found) == 4 * len(rows) and found[0].identity_error < 1e-9
    white = {(r.vec_id, r.component): r.whitened for r in found}
    for j in range(4):
        should = (x - u.mean(axis=0)) @ w[:, -1 - j] / np.sqrt(e[-1 - j])
        have = np.array([white[i, j + 1] for i, _ in rows])
        assert np.allclose(have, should, atol=1e-8) or np.allclose(have, -should, atol=1e-8)
