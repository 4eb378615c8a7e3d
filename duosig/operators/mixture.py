"""Mixtures of two Gaussians and a uniform box over several samples with shared components.

A window's reads come to one group only after the gate and subsampling, which bounds the group by the
depth; each group is fitted apart, so Spark spreads windows over the cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dbscan

FIT = "mu1 array<double>, mu2 array<double>, cov1 array<double>, cov2 array<double>, low array<double>, high array<double>, w array<double>, counts array<struct<cond:int,rep:int,n:array<double>>>"


#: Seedings of the two means, of which the best stays.
RESTARTS = 3


@dataclass(frozen=True)
class FitOptions:
    """How a window is fitted.

    covariance: full or diag. outliers: mad (rows further from their mean than factor times the MAD of all distances), dbscan (rows
    of no dense region: fewer than share of all rows within eps) or None for two Gaussians without a box.
    """

    covariance: str = "full"
    outliers: str | None = "mad"
    factor: float = 0.5
    eps: float = 5.0
    share: float = 0.25
    steps: int = 1000
    tolerance: float = 0.1

    @property
    def components(self) -> int:
        return 2 if self.outliers is None else 3


def normal_pdf(x: Column, mu: float | Column, sd: float | Column) -> Column:
    mu, sd = (c if isinstance(c, Column) else F.lit(float(c)) for c in (mu, sd))
    z = (x - mu) / sd
    return F.exp(-z * z / 2) / (sd * 2.5066282746310002)


def posteriors(x: Column, comps: list[tuple], box: tuple | None = None) -> list[Column]:
    """Posterior of each Gaussian (weight, mean, deviation), and of a box (weight, low, high), at x."""
    dens = [F.lit(float(w)) * normal_pdf(x, m, s) for w, m, s in comps]
    if box is not None:
        w, low, high = box
        dens.append(F.when(x.between(low, high), F.lit(float(w) / (high - low))).otherwise(0.0))
    total = sum(dens[1:], dens[0])
    return [F.try_divide(d, total) for d in dens]


def em_1d(rows: DataFrame, by: list[str], value: str, steps: int, start: dict) -> DataFrame:
    """Weights, means and variances of two 1-D Gaussians per group after so many EM steps.

    Every step is one aggregation over all rows with partial sums, joined back by group: nothing of a group has to fit one task.
    """
    init = rows.groupBy(*by).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    sd = F.sqrt("_v")
    par = init.select(*by, F.lit(0.5).alias("w1"), (F.col("_m") - start["shift"] * sd).alias("mu1"), (F.col("_m") + start["shift"] * sd).alias("mu2"), F.col("_v").alias("v1"), F.col("_v").alias("v2"))
    x = F.col(value)
    for _ in range(steps):
        d1 = F.col("w1") * normal_pdf(x, F.col("mu1"), F.sqrt("v1"))
        d2 = (1 - F.col("w1")) * normal_pdf(x, F.col("mu2"), F.sqrt("v2"))
        r = rows.join(par, by).select(*by, x.alias("_x"), F.coalesce(F.try_divide(d1, d1 + d2), F.lit(0.5)).alias("_r"))
        s = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_r").alias("s1"), F.sum(F.col("_r") * F.col("_x")).alias("x1"), F.sum(F.col("_r") * F.col("_x") * F.col("_x")).alias("q1"), F.sum("_x").alias("x"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
        s2, x2, q2 = F.col("n") - F.col("s1"), F.col("x") - F.col("x1"), F.col("q") - F.col("q1")
        m1, m2 = F.col("x1") / F.col("s1"), x2 / s2
        par = s.select(*by, (F.col("s1") / F.col("n")).alias("w1"), m1.alias("mu1"), m2.alias("mu2"), F.greatest(F.col("q1") / F.col("s1") - m1 * m1, F.lit(1e-6)).alias("v1"), F.greatest(q2 / s2 - m2 * m2, F.lit(1e-6)).alias("v2"))
    return par


def initial_components(labelled: DataFrame, by: list[str], slots: int) -> DataFrame:
    """Count, means and population covariances of each label's vectors, and the box around outliers (label 2)."""
    x = [F.col("vec")[i] for i in range(slots)]
    return labelled.groupBy(*by, "label").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(slots) for j in range(i, slots)],
        *[F.min(c).alias(f"low{i}") for i, c in enumerate(x)], *[F.max(c).alias(f"high{i}") for i, c in enumerate(x)],
    )


def cluster_weights(labelled: DataFrame, by: list[str], labels: int = 3, pseudo: float = 0.5) -> DataFrame:
    """Share of each label in every sample, with a pseudo-count per label."""
    n = F.count("*")
    shares = [((F.sum((F.col("label") == k).cast("double")) + pseudo) / (n + pseudo * labels)).alias(f"w{k}") for k in range(labels)]
    return labelled.groupBy(*by).agg(n.alias("n"), *shares)


def combined_weights(weights: DataFrame, by: list[str], labels: int = 3) -> DataFrame:
    """Weights of samples averaged by their sizes."""
    return weights.groupBy(*by).agg(*[(F.sum(F.col(f"w{k}") * F.col("n")) / F.sum("n")).alias(f"w{k}") for k in range(labels)])


def noise(rows: DataFrame, by: list[str], x: str, y: str, eps: float, share: float) -> DataFrame:
    """rows with noise: DBSCAN's outliers. Core rows have share of their group within eps; noise is neither core nor within eps of a core row. ids tell rows of a group apart."""
    return dbscan.noise(rows, by, [x, y], eps, share=share)


def _far_from_dense(x: np.ndarray, eps: float, least: float) -> np.ndarray:
    """DBSCAN's noise among the rows of x, which subsampling bounds; distances are taken for some rows at a time."""
    blocks = [x[i : i + 512] for i in range(0, len(x), 512)]
    near = lambda block, to: ((block[:, None] - to[None]) ** 2).sum(2) <= eps * eps
    core = np.concatenate([near(b, x).sum(1) >= least for b in blocks])
    return ~np.concatenate([near(b, x[core]).any(1) for b in blocks])


def _drawn(x: np.ndarray, restart: int, draw: int) -> float:
    """A number in [0, 1) for the rows, a restart and a draw of it: the same wherever and however often the window is fitted."""
    return zlib.crc32(f"{restart}:{draw}".encode(), zlib.crc32(np.ascontiguousarray(x, float).tobytes())) / 2**32


def _seeds(x: np.ndarray, restart: int) -> np.ndarray:
    """Two rows to start from: one drawn evenly, the other in proportion to its squared distance from that."""
    first = x[int(_drawn(x, restart, 0) * len(x))]
    far = np.cumsum(((x - first) ** 2).sum(1))
    second = x[min(int(np.searchsorted(far, _drawn(x, restart, 1) * far[-1], "right")), len(x) - 1)]
    return np.array([first, second])


def _lloyd(x: np.ndarray, means: np.ndarray) -> tuple[float, np.ndarray]:
    """Inertia and means once they stand still, after at most 100 steps."""
    for _ in range(100):
        label = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == k].mean(0) if (label == k).any() else means[k] for k in (0, 1)])
        moved = np.abs(new - means).max()
        means = new
        if moved < 1e-6:
            break
    return float(((x[:, None] - means[None]) ** 2).sum(2).min(1).sum()), means


def _two_means(x: np.ndarray, options: FitOptions = FitOptions()) -> tuple[np.ndarray, np.ndarray]:
    """The nearer of two means, and labels: 0 and 1 of two means, the best of RESTARTS by inertia, ties to the first; 2 for outliers."""
    far = _far_from_dense(x, options.eps, options.share * len(x)) if options.outliers == "dbscan" else np.zeros(len(x), bool)
    if far.all():
        return np.zeros(len(x), int), np.full(len(x), 2)
    used = x[~far]
    means = min((_lloyd(used, _seeds(used, r)) for r in range(RESTARTS)), key=lambda found: found[0])[1]
    dist = np.linalg.norm(x[:, None] - means[None], axis=2)
    label, near = dist.argmin(1), dist.min(1)
    if options.outliers == "mad":
        far = near > options.factor * np.median(np.abs(near - np.median(near)))
    return label, np.where(far, 2, label)


def _log_density(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of a Gaussian; a covariance that isn't positive definite is an error."""
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mu).T)
    return -0.5 * ((z * z).sum(0) + len(mu) * np.log(2 * np.pi)) - np.log(np.diagonal(low)).sum()


def fit(x: np.ndarray, sample: np.ndarray, options: FitOptions = FitOptions()) -> dict | None:
    """EM of two Gaussians and a box shared by all samples, with weights of each sample's own; None where a covariance becomes singular.

    Where a mean keeps no more rows than slots beside the outliers, its covariance starts from all rows nearest to it.
    """
    nearer, label = _two_means(x, options)
    d, samples, parts = x.shape[1], np.unique(sample), options.components
    spread = (lambda c: c) if options.covariance == "full" else (lambda c: np.diag(np.diagonal(c)))
    mu, cov = [], []
    for k in (0, 1):
        own = x[label == k] if (label == k).sum() > d else x[nearer == k]
        if not len(own):
            return None
        mu.append(own.mean(0))
        cov.append(spread(np.atleast_2d(np.cov(own.T, bias=True))))
    low = high = None
    if parts == 3:
        far = x[label == 2] if (label == 2).any() else x
        low, high = far.min(0), far.max(0)
        box = np.where(((x >= low) & (x <= high)).all(1), -np.log(np.maximum(high - low, 1e-6)).sum(), -np.inf)
    weights = {s: (np.bincount(label[sample == s], minlength=parts) + 0.5) / ((sample == s).sum() + 0.5 * parts) for s in samples}
    last = -np.inf
    for step in range(options.steps):
        try:
            dens = np.stack([_log_density(x, mu[0], cov[0]), _log_density(x, mu[1], cov[1]), *([box] if parts == 3 else [])], 1)
        except np.linalg.LinAlgError:
            return None
        joint = dens + np.log(np.array([weights[s] for s in samples]))[np.searchsorted(samples, sample)]
        top = joint.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        if total.sum() - last <= options.tolerance and step:
            break
        last = total.sum()
        resp = np.exp(joint - total[:, None])
        keep = 1 - 0.99 * (3.0 + step) ** -0.001  # the first update is that of iteration 1
        for k in (0, 1):
            n = resp[:, k].sum()
            if n > 1e-9:
                m = resp[:, k] @ x / n
                c = spread((resp[:, k, None] * (x - m)).T @ (x - m) / n)
                mu[k], cov[k] = keep * mu[k] + (1 - keep) * m, keep * cov[k] + (1 - keep) * c
        for s in samples:
            r = resp[sample == s].sum(0) + 0.5
            weights[s] = r / r.sum()
    return {"mu": mu, "cov": cov, "low": low, "high": high, "weights": weights, "label": label}


def _fit_group(options: FitOptions) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cond", "rep", "read"], ignore_index=True)
        pairs = rows.groupby(["cond", "rep"])
        sample = pairs.ngroup().to_numpy()  # samples in order of (cond, rep), as the groups below
        model = fit(np.array(rows["vec"].tolist()), sample, options)
        if model is None:
            return pd.DataFrame(columns=["gene", "centre", "mu1", "mu2", "cov1", "cov2", "low", "high", "w", "counts"])
        sizes, used = pairs["depth"].first(), pairs.size()
        counts = [{"cond": int(c), "rep": int(r), "n": np.rint(model["weights"][i] * sizes[c, r]).tolist()} for i, (c, r) in enumerate(sizes.index)]
        w = sum(model["weights"][i] * n for i, n in enumerate(used)) / used.sum()
        flat = lambda a: None if a is None else np.asarray(a).ravel().tolist()
        out = {"mu1": flat(model["mu"][0]), "mu2": flat(model["mu"][1]), "cov1": flat(model["cov"][0]), "cov2": flat(model["cov"][1]), "low": flat(model["low"]), "high": flat(model["high"]), "w": flat(w), "counts": counts}
        return pd.DataFrame([{"gene": rows["gene"][0], "centre": int(rows["centre"][0]), **out}])

    return run


def _type_of(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def fit_windows(vectors: DataFrame, options: FitOptions = FitOptions()) -> DataFrame:
    """A model per (gene, centre) of vectors (cond, rep, read, vec, depth: reads of the replicate before subsampling).

    counts has each replicate's expected reads by component, rounded half to even. Windows whose fit fails have no row.
    """
    return vectors.groupBy("gene", "centre").applyInPandas(_fit_group(options), f"gene {_type_of(vectors, 'gene')}, centre long, {FIT}")


def _label_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["cond", "rep", "read"], ignore_index=True)
    return rows.assign(label=_two_means(np.array(rows["vec"].tolist()))[1])[["gene", "centre", "cond", "rep", "read", "label"]]


def label_windows(vectors: DataFrame) -> DataFrame:
    """Two-means labels with MAD outliers (2) of each window's reads."""
    return vectors.groupBy("gene", "centre").applyInPandas(_label_group, f"gene {_type_of(vectors, 'gene')}, centre long, cond long, rep long, read {_type_of(vectors, 'read')}, label long")


def _log_densities(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """As _log_density, with a mean and a covariance of each row's own."""
    off = x - mu
    solve = np.linalg.solve(cov, off[:, :, None])[:, :, 0]
    return -0.5 * ((off * solve).sum(1) + np.linalg.slogdet(cov)[1] + x.shape[1] * np.log(2 * np.pi))


def _posteriors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if not len(rows):
            continue
        boxed = rows["low"].notna().all()
        m = {c: np.array(rows[c].tolist()) for c in ("vec", "mu1", "mu2", "cov1", "cov2", "w", *(("low", "high") if boxed else ()))}
        x = m["vec"]
        square = (len(x), x.shape[1], x.shape[1])
        dens = [_log_densities(x, m[f"mu{k}"], m[f"cov{k}"].reshape(square)) for k in (1, 2)]
        if boxed:
            inside = ((x >= m["low"]) & (x <= m["high"])).all(1)
            dens.append(np.where(inside, -np.log(np.maximum(m["high"] - m["low"], 1e-6)).sum(1), -np.inf))
        dens = np.stack(dens, 1) + np.log(m["w"])
        post = np.exp(dens - dens.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        yield rows.assign(pred=post[:, 1], outlier=post[:, 2] if boxed else 0.0)[["gene", "centre", "cond", "rep", "read", "vec", "pred", "outlier"]]


def predict_reads(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Per read of vectors, with vec, the posterior of the second component and of the box (0 without one), for windows with a model.

    Models are joined to the reads, which are then taken batch by batch: no task holds a window.
    """
    schema = f"gene {_type_of(vectors, 'gene')}, centre long, cond long, rep long, read {_type_of(vectors, 'read')}, vec array<double>, pred double, outlier double"
    model = models.select("gene", "centre", "mu1", "mu2", "cov1", "cov2", "low", "high", "w")
    return vectors.select("gene", "centre", "cond", "rep", "read", "vec").join(model, ["gene", "centre"]).mapInPandas(_posteriors, schema)
