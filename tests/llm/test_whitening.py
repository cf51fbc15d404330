import math

import numpy as np
import pytest

from chalkline.llm import whitening


def brute(rows, width, components=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v) == width]
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > 1e-12 * np.trace(cov)
    return n, sums, xs, values[real], vectors[:, real], np.trace(cov)


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    made = rng.standard_normal((n, width)) * np.linspace(3, 0.5, width)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(made)]
    rows += [(1000 + i, rows[3][1]) for i in range(n)]  # half of all are copies
    rows += [(None, rows[4][1]), (5, None), (6, [None] * width), (7, [math.nan] * width), (8, [math.inf] + [0.0] * (width - 1)), (9, []), (10, [1.0])]
    return rows + [(11, [2.0, None] + [1.0] * (width - 2)), (12, [1000.0] + [0.0] * (width - 1)), (13, [1e6] + [0.0] * (width - 1))]


@pytest.mark.parametrize("seed, n, width", [(1, 400, 24), (2, 60, 8), (3, 5, 20)])
def test_equals_brute_force(spark, seed, n, width):
    rows = vectors(seed, n, width)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS component", "3 AS id", "4 AS v", "5 AS at").repartition(4)
    got = whitening.whiten(df).collect()
    count, sums, xs, values, basis, trace = brute(rows, width)
    k = len(values)
    assert len(got) == len(xs) * k and {r["n"] for r in got} == {count}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    want = {}
    for i, x in xs:
        w = np.array([c - s / count for c, s in zip(x, sums)]) @ basis / np.sqrt(values)
        deviation = sum((count * c - s) ** 2 for c, s in zip(x, sums))
        want.setdefault(i, []).append((deviation if deviation < 2**63 else None, w))
    sign = {}
    for r in got:
        c = r["component"] - 1
        assert abs(r["explained"] - values[c] / trace) <= 1e-9 * r["explained"]
        deviation, w = next(d for d in want[r["vec_id"]] if d[0] == r["deviation"])
        if c not in sign and abs(w[c]) > 1e-3:
            sign[c] = math.copysign(1, w[c]) * math.copysign(1, r["whitened"])
        assert abs(r["whitened"] * sign.get(c, 1) - w[c]) < 1e-6 * max(1, abs(w[c]))


def test_whitened_fit_list_has_unit_covariance(spark):
    rows = vectors(7, 300, 12)[:-1]  # without the one whose deviation is null
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=4).toPandas()
    once = got.drop_duplicates(["deviation", "component", "whitened"]).pivot_table(index="deviation", columns="component", values="whitened")
    w = once.to_numpy() - once.to_numpy().mean(axis=0)
    assert w.shape == (got["n"][0], 4) and np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-6


def test_no_component_without_spread(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0


@pytest.mark.parametrize("kind", ["plain", "clustered", "equal", "split", "flat", "tiny", "diagonal"])
def test_eigenpairs_equal_numpy(kind):
    rng = np.random.default_rng(11)
    n = 40
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    spectra = {
        "plain": np.arange(n) + 1.0, "clustered": np.where(np.arange(n) > 30, 5 + 1e-9 * np.arange(n), 1.0 + np.arange(n) / n), "equal": np.where(np.arange(n) > 35, 3.0, 1.0),
        "split": np.arange(n) + 1.0, "flat": np.ones(n), "tiny": 10.0 ** -np.arange(n), "diagonal": np.arange(n) + 1.0,
    }
    a = q @ np.diag(spectra[kind]) @ q.T
    if kind == "split":  # two blocks that share their spectrum
        a = np.kron(np.eye(2), a[:20, :20])
    if kind == "diagonal":
        a = np.diag(spectra[kind])
    a = (a + a.T) / 2
    values, basis = whitening.leading(a, 12)
    top = np.linalg.eigvalsh(a)[::-1][:12]
    assert np.abs(values - top).max() < 1e-13 * max(1, top[0]) * n
    assert np.abs(basis.T @ basis - np.eye(12)).max() < 1e-12
    assert np.abs(a @ basis - basis * values).max() < 1e-12 * top[0] * n


def test_deviation_beyond_63_bits_is_null():
    x = np.array([[3, 4], [2**40, -(2**40)]], np.int64)
    assert whitening.deviations(x, 10, [1, 2]) == [29**2 + 38**2, None]
    assert whitening.deviations(np.array([[2**31, 0]]), 1, [0, 0]) == [2**62]
