"""The mixture of all windows at once, by sums: each step is one aggregation over all reads, and no read comes to a Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .mixture import FitOptions

WINDOW, SAMPLE = ["gene", "centre"], ["gene", "centre", "cond", "rep"]


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def cholesky(d: int, k: int) -> dict[str, Column]:
    """Columns of the lower triangle of component k's covariance (columns c<k>_<i><j>), one after the other; null where it isn't positive definite."""
    out: dict[str, Column] = {}
    for j in range(d):
        for i in range(j, d):
            rest = F.col(f"c{k}_{i}{j}")
            for m in range(j):
                rest = rest - F.col(f"l{k}_{i}{m}") * F.col(f"l{k}_{j}{m}")
            out[f"l{k}_{i}{j}"] = F.when(rest > 0, F.sqrt(rest)) if i == j else rest / F.col(f"l{k}_{j}{j}")
    return out


def log_density(d: int, k: int) -> Column:
    """Log density of component k at x0 to x<d-1>, from its triangle."""
    solved: list[Column] = []
    for i in range(d):
        rest = F.col(f"x{i}") - F.col(f"m{k}_{i}")
        for j in range(i):
            rest = rest - F.col(f"l{k}_{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{k}_{i}{i}"))
    size = sum((F.log(F.col(f"l{k}_{i}{i}")) for i in range(d)), F.lit(0.0))
    return -0.5 * (sum((z * z for z in solved), F.lit(0.0)) + d * math.log(2 * math.pi)) - size


def initial(rows: DataFrame, d: int, options: FitOptions) -> DataFrame:
    """Parameters of each window, on rows of its samples: means and covariances of labels 0 and 1, the box around label 2, weights by labels.

    A component that keeps no more rows than positions starts from all rows nearer to it; without outliers the box is around all rows.
    """
    x = [F.col(f"x{i}") for i in range(d)]
    made = []
    count = lambda k: F.sum((F.col("label") == k).cast("double"))
    for k in (1, 2):
        for name, held in ((f"a{k}", F.col("label") == k - 1), (f"b{k}", F.col("nearer") == k - 1)):
            one = lambda c, held=held: F.when(held, c)
            made += [F.count(one(x[0])).alias(f"{name}_n"), *[F.avg(one(c)).alias(f"{name}_{i}") for i, c in enumerate(x)]]
            made += [F.covar_pop(one(x[i]), one(x[j])).alias(f"{name}_{i}{j}") for i, j in _pairs(d)]
    far = F.col("label") == 2
    made += [f(F.when(far, c)).alias(f"{n}_{i}") for n, f in (("fl", F.min), ("fh", F.max)) for i, c in enumerate(x)] + [f(c).alias(f"{n}_{i}") for n, f in (("al", F.min), ("ah", F.max)) for i, c in enumerate(x)]
    of = rows.groupBy(*WINDOW).agg(*made)
    pick = lambda k, what: F.when(F.col(f"a{k}_n") > d, F.col(f"a{k}_{what}")).otherwise(F.col(f"b{k}_{what}"))
    spread = lambda i, j, c: c if i == j or options.covariance == "full" else F.lit(0.0)
    start = of.where("b1_n > 0 and b2_n > 0").select(
        *WINDOW, *[pick(k, i).alias(f"m{k}_{i}") for k in (1, 2) for i in range(d)], *[spread(i, j, pick(k, f"{i}{j}")).alias(f"c{k}_{i}{j}") for k in (1, 2) for i, j in _pairs(d)],
        *[F.coalesce(f"fl_{i}", f"al_{i}").alias(f"low_{i}") for i in range(d)], *[F.coalesce(f"fh_{i}", f"ah_{i}").alias(f"high_{i}") for i in range(d)],
    )
    parts = options.components
    shares = rows.groupBy(*SAMPLE).agg(F.count("*").alias("used"), F.max("depth").alias("depth"), *[((count(k) + 0.5) / (F.count("*") + 0.5 * parts)).alias(f"w{k}") for k in range(parts)])
    return shares.join(start, WINDOW).withColumn("last", F.lit(None).cast("double"))


def _triangles(params: DataFrame, d: int) -> DataFrame:
    """params with the triangles of both covariances, a column at a time, as each needs those before."""
    for k in (1, 2):
        for name, column in cholesky(d, k).items():
            params = params.withColumn(name, column)
    return params


def step(rows: DataFrame, params: DataFrame, d: int, options: FitOptions, iteration: int) -> DataFrame:
    """Parameters after the update of this iteration, with total, the log likelihood before it; windows of singular covariances go.

    Sums of a sample's reads are taken in partial sums; those of a window are sums of its samples' rows.
    """
    parts = options.components
    with_triangles = _triangles(params, d)
    for k in (1, 2):
        with_triangles = with_triangles.where(F.col(f"l{k}_{d - 1}{d - 1}").isNotNull())
    known = [c for c in with_triangles.columns if c not in SAMPLE]
    x = [F.col(f"x{i}") for i in range(d)]
    each = rows.select(*SAMPLE, *[f"x{i}" for i in range(d)]).join(with_triangles.select(*SAMPLE, *known), SAMPLE)
    dens = {f"g{k}": log_density(d, k + 1) + F.log(f"w{k}") for k in (0, 1)}
    if parts == 3:
        inside, width = F.lit(True), F.lit(0.0)
        for i in range(d):
            inside = inside & x[i].between(F.col(f"low_{i}"), F.col(f"high_{i}"))
            width = width + F.log(F.greatest(F.col(f"high_{i}") - F.col(f"low_{i}"), F.lit(1e-6)))
        dens["g2"] = F.when(inside, F.log("w2") - width).otherwise(-1e300)
    g = list(dens)
    each = each.withColumns(dens).withColumn("top", F.greatest(*g)).withColumns({f"e{k}": F.exp(F.col(c) - F.col("top")) for k, c in enumerate(g)})
    each = each.withColumn("sum", sum((F.col(f"e{k}") for k in range(parts)), F.lit(0.0))).withColumns({f"r{k}": F.col(f"e{k}") / F.col("sum") for k in range(parts)})
    sums = [F.sum(F.col("top") + F.log("sum")).alias("ll"), *[F.sum(f"r{k}").alias(f"s{k}") for k in range(parts)]]
    sums += [F.sum(F.col(f"r{k - 1}") * x[i]).alias(f"t{k}_{i}") for k in (1, 2) for i in range(d)] + [F.sum(F.col(f"r{k - 1}") * x[i] * x[j]).alias(f"q{k}_{i}{j}") for k in (1, 2) for i, j in _pairs(d)]
    by_sample = each.groupBy(*SAMPLE).agg(*sums)
    whole = [F.sum("ll").alias("total"), *[F.sum(f"s{k - 1}").alias(f"n{k}") for k in (1, 2)]]
    whole += [F.sum(f"t{k}_{i}").alias(f"T{k}_{i}") for k in (1, 2) for i in range(d)] + [F.sum(f"q{k}_{i}{j}").alias(f"Q{k}_{i}{j}") for k in (1, 2) for i, j in _pairs(d)]
    by_window = by_sample.groupBy(*WINDOW).agg(*whole)
    keep = 1 - 0.99 * (2.0 + iteration) ** -0.001
    new: dict[str, Column] = {}
    for k in (1, 2):
        n, some = F.col(f"n{k}"), F.col(f"n{k}") > 1e-9
        mean = [F.col(f"T{k}_{i}") / n for i in range(d)]
        for i in range(d):
            new[f"m{k}_{i}"] = F.when(some, keep * F.col(f"m{k}_{i}") + (1 - keep) * mean[i]).otherwise(F.col(f"m{k}_{i}"))
        for i, j in _pairs(d):
            if i == j or options.covariance == "full":
                new[f"c{k}_{i}{j}"] = F.when(some, keep * F.col(f"c{k}_{i}{j}") + (1 - keep) * (F.col(f"Q{k}_{i}{j}") / n - mean[i] * mean[j])).otherwise(F.col(f"c{k}_{i}{j}"))
    shares = {f"w{k}": (F.col(f"s{k}") + 0.5) / (F.col("used") + 0.5 * parts) for k in range(parts)}
    old = params.join(by_sample.select(*SAMPLE, *[f"s{k}" for k in range(parts)]), SAMPLE).join(by_window, WINDOW)
    moved = old.select(*SAMPLE, "used", "depth", "last", "total", *[f"{n}_{i}" for n in ("low", "high") for i in range(d)], *[c.alias(n) for n, c in {**new, **shares}.items()], *[F.col(c).alias(f"was_{c}") for c in (*new, *shares)])
    fixed = [f"c{k}_{i}{j}" for k in (1, 2) for i, j in _pairs(d) if f"c{k}_{i}{j}" not in new]
    return moved.withColumns({c: F.lit(0.0) for c in fixed} | {f"was_{c}": F.lit(0.0) for c in fixed})


def fit_by_sums(labelled: DataFrame, d: int, options: FitOptions = FitOptions(), steps: int | None = None) -> DataFrame:
    """Models of all windows, as mixture.fit_windows() gives them, from rows with gene, centre, cond, rep, vec, depth, label and nearer.

    labelled: label is 0 or 1 by component and 2 for outliers, nearer the component of all rows. vec has d values. Where steps are given, all windows make so many;
    else a window leaves once its log likelihood rises by no more than the tolerance, and only the others go on. A window may have any number of
    reads: no task holds one. Windows without rows for a component, or whose covariance becomes singular, have no row.
    """
    middle = labelled.groupBy(*WINDOW).agg(*[F.avg(F.col("vec")[i]).alias(f"a{i}") for i in range(d)])
    # Values are counted from the window's mean, so that sums of squares lose no digits.
    rows = stored(labelled.join(middle, WINDOW).select(*SAMPLE, "depth", "label", "nearer", *[(F.col("vec")[i] - F.col(f"a{i}")).alias(f"x{i}") for i in range(d)]))
    params = stored(initial(rows, d, options))
    names = [c for c in params.columns if c != "last"]
    done: list[DataFrame] = []
    for iteration in range(1, 1 + (options.steps if steps is None else steps)):
        moved = stored(step(rows, params, d, options, iteration))
        ended = F.coalesce(F.col("total") - F.col("last") <= options.tolerance, F.lit(False)) if steps is None else F.lit(False)
        back = [F.col(f"was_{c}").alias(c) if f"was_{c}" in moved.columns else F.col(c) for c in names]
        done.append(moved.where(ended).select(*back))
        params = moved.where(~ended).select(*names, F.col("total").alias("last"))
        if steps is None and not params.take(1):
            break
    every = params.select(*names)
    for part in done:
        every = every.unionByName(part)
    parts = options.components
    at = lambda n, k: F.array(*[F.col(f"{n}{k}_{i}") + F.col(f"a{i}") for i in range(d)])
    full = lambda k: F.array(*[F.col(f"c{k}_{max(i, j)}{min(i, j)}") for i in range(d) for j in range(d)])
    w = F.array(*[F.col(f"w{k}") for k in range(parts)])
    counts = F.array_sort(F.collect_list(F.struct(F.col("cond").cast("int").alias("cond"), F.col("rep").cast("int").alias("rep"), F.transform(w, lambda v: F.rint(v * F.col("depth"))).alias("n"))))
    first = [c for c in names if c.rpartition("_")[0] in ("m1", "m2", "c1", "c2", "low", "high")]
    windows = every.groupBy(*WINDOW).agg(*[F.first(c).alias(c) for c in first], F.array(*[F.sum(F.col(f"w{k}") * F.col("used")) / F.sum("used") for k in range(parts)]).alias("w"), counts.alias("counts"))
    box = [F.array(*[F.col(f"{n}_{i}") + F.col(f"a{i}") for i in range(d)]) if parts == 3 else F.lit(None).cast("array<double>") for n in ("low", "high")]
    return windows.join(middle, WINDOW).select(*WINDOW, at("m", 1).alias("mu1"), at("m", 2).alias("mu2"), full(1).alias("cov1"), full(2).alias("cov2"), box[0].alias("low"), box[1].alias("high"), "w", "counts")
