"""Whitening against exact fractions, limbs against Python's integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from parley.llm import queries, whitening

KIND = "vec_id long, embedding array<double>, n string, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], KIND)


def exact(vectors):
    """n, sums, and the covariance of the distinct ones as fractions."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    return n, sums, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def check(spark, rows, scale=256.0):
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    n, sums, cov = exact([x for _, x in good])
    v = np.array([[float(c) for c in r] for r in cov])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:4]
    found = whitening.whiten(spark, frame(spark, rows), scale=scale).collect()
    assert len(found) == len(rows) * min(4, len(sums))
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, x in good:
        for c, at in enumerate(order, 1):
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            r = next(r for r in by[i, c] if r["deviation"] == (deviation if deviation < 10**38 else None))  # ids repeat
            by[i, c].remove(r)
            assert r["n"] == n
            centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
            assert abs(abs(r["whitened"]) - abs(centred @ u[:, at]) / math.sqrt(e[at])) < 1e-6
            assert math.isclose(r["explained"], e[at] / np.trace(v), rel_tol=1e-9)
            assert 0 <= r["identity_error"] < 1e-6
    return found


def test_whitening_equals_exact_fractions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.2]).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a hot vector, once in the model
    rows += [(5, rows[9][1]), (None, rows[3][1])]
    found = check(spark, rows)
    signs = {}  # one sign for all rows
    for r in found:
        if r["vec_id"] in range(300, 420):
            signs.setdefault(r["component"], set()).add(r["whitened"])
    assert all(len(s) == 1 for s in signs.values())


def test_large_integers_stay_exact(spark):
    rng = np.random.default_rng(5)
    check(spark, [(i, (rng.normal(size=3) * 1e15).tolist()) for i in range(50)])
    check(spark, [(i, (rng.normal(size=2) * 1e16).tolist()) for i in range(30)])


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i), float(i * i % 7)]) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, None]), (53, [math.nan, 1.0]), (54, [math.inf, 1.0]), (55, [1.0] * 3), (56, [1e300, 1.0])]
    found = whitening.whiten(spark, frame(spark, good + bad)).collect()
    assert sorted({r["vec_id"] for r in found}) == list(range(20)) and len(found) == 40
    assert whitening.whiten(spark, frame(spark, bad[:5])).collect() == []
    assert whitening.whiten(spark, frame(spark, [])).collect() == []


def test_components_without_variance(spark):
    found = whitening.whiten(spark, frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found] == [(1, 0, None, 0.0, 0.0)] * 4
    found = whitening.whiten(spark, frame(spark, [(i, [float(i), 2.0]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in found)


@pytest.mark.parametrize("most", [3, 1 << 21, 1 << 45, 1 << 62])
def test_gram_by_limbs(most):
    rng = np.random.default_rng(most % 97)
    total, expected = whitening._Places(), np.zeros((3, 3), object)
    for rows in (1, 4096, 700):
        y = rng.integers(-most, most, size=(rows, 3), endpoint=True)
        total.gram(y)
        expected += y.astype(object).T @ y.astype(object)
    whole = sum(p.astype(object) << (whitening.LIMB * i) for i, p in enumerate(total.sums))
    assert (whole == expected).all()
    back = whitening.limbs(y)
    assert (sum(a.astype(np.int64).astype(object) << (whitening.LIMB * i) for i, a in enumerate(back)) == y).all()


def test_query_over_the_table(spark):
    rows = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] <= 1e-4
    assert len(rows) == 4 * len({r["vec_id"] for r in rows}) and all(isinstance(r["deviation"], int) for r in rows)
