"""The mixture by sums against the fit of each window by itself."""

import numpy as np
import pytest

from duosig.operators import em, mixture


@pytest.mark.parametrize(("d", "options"), [(3, mixture.FitOptions(factor=3.0)), (2, mixture.FitOptions(outliers=None)), (2, mixture.FitOptions(factor=3.0, covariance="diag"))])
def test_sums_give_the_fit_of_each_window(spark, d, options):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for gene, shift in (("a", 9.0), ("b", -6.0), ("c", 3.0)):
        for centre in (3, 4):
            sizes = [(c, r, int(rng.integers(30, 70))) for c in (0, 1) for r in (1, 2, 1001)]
            x, sample, keys = [], [], []
            for s, (c, r, n) in enumerate(sizes):
                moved = rng.random((n, 1)) < (0.7 if c else 0.2)
                part = rng.normal(65, 1.5, (n, d)) + np.where(moved, shift, 0.0)
                part[:3] = rng.uniform(40, 90, (min(3, n), d))
                x.append(part)
                sample += [s] * n
                keys += [(c, r, 3 * n)] * n
            x = np.concatenate(x)
            model = mixture.fit(x, np.array(sample), options)
            nearer, label = mixture._two_means(x, options)
            want[gene, centre] = (model, sizes)
            rows += [(gene, centre, c, r, v.tolist(), depth, int(k), int(o)) for (c, r, depth), v, k, o in zip(keys, x, label, nearer, strict=True)]
    df = spark.createDataFrame(rows, "gene string, centre long, cond long, rep long, vec array<double>, depth long, label int, nearer int")
    fitted = em.fit_by_sums(df, d, options)
    assert "Python" not in fitted._jdf.queryExecution().toString()
    got = {(r["gene"], r["centre"]): r for r in fitted.collect()}
    assert set(got) == set(want)
    for key, (model, sizes) in want.items():
        r = got[key]
        for k in (0, 1):
            assert np.allclose(r[f"mu{k + 1}"], model["mu"][k], rtol=1e-6) and np.allclose(r[f"cov{k + 1}"], model["cov"][k].ravel(), rtol=1e-6, atol=1e-7)
        used = np.array([n for *_, n in sizes])
        w = np.array([model["weights"][s] for s in range(len(sizes))])
        assert np.allclose(r["w"], (w * used[:, None]).sum(0) / used.sum(), rtol=1e-6)
        assert [(c["cond"], c["rep"]) for c in r["counts"]] == [(c, k) for c, k, _ in sizes]
        assert np.abs(np.array([c["n"] for c in r["counts"]]) - np.rint(w * 3 * used[:, None])).max() <= 1
        assert r["low"] is None if options.outliers is None else np.allclose(r["low"], model["low"])


def test_windows_that_cannot_be_fitted(spark):
    rng = np.random.default_rng(1)
    flat = [("flat", 1, i % 2, 1, [1.0, 1.0], 9, i % 2, i % 2) for i in range(20)]
    alone = [("alone", 1, i % 2, 1, rng.normal(0, 1, 2).tolist(), 9, 0, 0) for i in range(20)]
    df = spark.createDataFrame(flat + alone, "gene string, centre long, cond long, rep long, vec array<double>, depth long, label int, nearer int")
    assert em.fit_by_sums(df, 2, steps=2).count() == 0 and em.fit_by_sums(df.limit(0), 2).count() == 0
