"""Tests over windows and counts: KS, principal component, G-test, odds, FDR, orientation. Columns and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import Z975, chi2_sf1, kolmogorov_sf
from . import ranges


def ks_2samp(rows: DataFrame, by: list[str], value: str = "value", sample: str = "cond") -> DataFrame:
    """d, p, n0, n1 of the two-sample Kolmogorov-Smirnov test (samples 0 and 1) in each group, asymptotic p.

    Values are summed first, so that the running counts go over distinct values, and these are spread by range: a group may be of any size.
    """
    each = rows.groupBy(*by, value).agg(F.sum((F.col(sample) == 0).cast("long")).alias("a"), F.sum((F.col(sample) == 1).cast("long")).alias("b"))
    order = [F.col(value)]
    n = ranges.running(ranges.spread(each, by, order), by, order, {"ca": F.col("a"), "cb": F.col("b")})
    n = n.withColumnsRenamed({"ca_all": "n0", "cb_all": "n1"}).where("n0 > 0 and n1 > 0")
    d = n.groupBy(*by, "n0", "n1").agg(F.max(F.abs(F.col("ca") / F.col("n0") - F.col("cb") / F.col("n1"))).alias("d"))
    en = F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    return d.withColumn("p", kolmogorov_sf((en + 0.12 + 0.11 / en) * F.col("d")))


def pca_comp1(vectors: DataFrame, by: list[str], slots: int = 3, doublings: int = 12) -> DataFrame:
    """vectors (so many slots in vec) with comp: the first principal component of each group's standardised vectors.

    Only means, deviations and covariances are aggregated; the leading eigenvector comes from power iteration on the correlation
    matrix, of a row for each group, of which so many squarings make 2^doublings steps. A group with a constant slot has no component.
    """
    x = [F.col("vec")[i] for i in range(slots)]
    pairs = [(i, j) for i in range(slots) for j in range(i + 1, slots)]
    stats = vectors.groupBy(*by).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).where(" and ".join(f"s{i} > 0" for i in range(slots)))
    r = {(i, j): F.col(f"c{i}_{j}") / (F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs}
    matrix = F.array(*[F.array(*[F.lit(1.0) if i == j else r[min(i, j), max(i, j)] for j in range(slots)]) for i in range(slots)])
    stats = stats.withColumn("r", matrix)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, z: t + z)
    trace = lambda m: F.aggregate(F.transform(m, lambda a: dot(a, a)), F.lit(0.0), lambda t, z: t + z)  # noqa: E731  (of the square)
    square = lambda m, _: F.transform(m, lambda a: F.transform(m, lambda b: dot(a, b) / trace(m)))
    stats = stats.withColumn("r", F.aggregate(F.sequence(F.lit(1), F.lit(doublings)), F.col("r"), square))
    start = F.array(*[F.lit(1.0 - 0.1 * i / max(1, slots - 2)) for i in range(slots)])
    stats = stats.withColumn("e", F.transform("r", lambda row: dot(row, start)))
    stats = stats.withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    parts = [F.col("e")[i] / F.col("norm") / F.col(f"s{i}") for i in range(slots)]
    # Weights and means alone meet the vectors.
    stats = stats.select(*[F.col(c).alias(f"_{c}") for c in by], F.array(*parts).alias("_w"), F.array(*[F.col(f"m{i}") for i in range(slots)]).alias("_m"))
    joined = vectors.join(stats, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    comp = sum(((F.col("vec")[i] - F.col("_m")[i]) * F.col("_w")[i] for i in range(slots)), F.lit(0.0))
    return joined.select(*vectors.columns, comp.alias("comp"))


def mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation from it."""
    centre = ranges.median(rows, by, value)
    off = rows.join(centre, by).withColumn("_off", F.abs(F.col(value) - F.col("med")))
    return centre.join(ranges.median(off, by, "_off", "mad"), by)


def g_statistic(table: list[list[Column]], yates: bool) -> Column:
    """G of a table of counts; 0 if a row or a column is empty. With yates, counts move towards their expectation by up to a half."""
    rows = [sum(r[1:], r[0]) for r in table]
    cols = [sum((r[j] for r in table[1:]), table[0][j]) for j in range(len(table[0]))]
    total = sum(rows[1:], rows[0])
    g = F.lit(0.0)
    empty = F.lit(False)
    for x in (*rows, *cols):
        empty = empty | (x <= 0)
    for i, r in enumerate(table):
        for j, o in enumerate(r):
            e = F.try_divide(rows[i] * cols[j], total)
            o2 = o + F.signum(e - o) * F.least(F.lit(0.5), F.abs(e - o)) if yates else o
            g = g + F.when(o2 > 0, 2 * o2 * F.ln(F.try_divide(o2, e))).otherwise(0.0)
    return F.when(empty, 0.0).otherwise(F.greatest(g, F.lit(0.0)))


def g_test_2x2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """G and p of a 2 x 2 table with Yates' correction; an empty row or column gives (0, 1)."""
    g = g_statistic([[a, b], [c, d]], yates=True)
    return g, F.when(g == 0, 1.0).otherwise(chi2_sf1(g))


def homogeneity(reps: list[list[Column]]) -> Column:
    """G between the replicates of one condition over all components; a single replicate has none."""
    if len(reps) < 2:
        return F.lit(0.0)
    return g_statistic(reps, yates=len(reps) == 2 and len(reps[0]) == 2)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def pooled_counts(reps: Column, k: int) -> Column:
    """The count of component k over however many replicates an array holds the counts of."""
    return _sum(F.transform(reps, lambda r: r[k]))


def homogeneity_of(reps: Column, components: int = 3) -> Column:
    """homogeneity for an array of the counts of however many replicates; as there, two of two components are corrected."""
    part = lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)
    rows, cols = F.transform(reps, _sum), F.array(*[pooled_counts(reps, k) for k in range(components)])
    cells = _sum(F.transform(reps, lambda r: _sum(F.transform(r, part))))
    g = 2 * (cells - _sum(F.transform(rows, part)) - _sum(F.transform(cols, part)) + part(_sum(rows)))
    empty = (F.size(reps) < 2) | F.exists(rows, lambda x: x <= 0) | F.exists(cols, lambda x: x <= 0)
    whole = F.when(empty, 0.0).otherwise(F.greatest(g, F.lit(0.0)))
    if components != 2:
        return whole
    cell = lambda r, k: F.coalesce(F.try_element_at(reps, F.lit(r + 1))[k], F.lit(0.0))
    return F.when(F.size(reps) == 2, g_statistic([[cell(r, k) for k in (0, 1)] for r in (0, 1)], yates=True)).otherwise(whole)


def with_tests(rows: DataFrame, cells: list[str], hom: Column, p_threshold: float) -> DataFrame:
    """rows with g, hom and p: heterogeneity of conditions over the first two components, and homogeneity of replicates.

    cells names the pooled counts of control 0 and 1 and treatment 0 and 1; hom is the sum of both conditions' G between replicates.
    Where heterogeneity is significant, differences between replicates at least as large take it back (p = 1). Each step is a
    column of its own, as the next ones repeat it many times.
    """
    a, b, c, d = (F.col(x) for x in cells)
    rows = rows.withColumn("_g", g_statistic([[a, b], [c, d]], yates=True)).withColumn("_hom", hom)
    rows = rows.withColumn("_p", F.when(F.col("_g") == 0, 1.0).otherwise(chi2_sf1(F.col("_g"))))
    outliers = a + b + c + d <= 0
    rows = rows.withColumns({"_outliers": outliers, "_tested": ~outliers & (F.col("_p") < p_threshold)})
    p = F.when(F.col("_outliers") | (F.col("_tested") & (F.col("_hom") >= F.col("_g"))), 1.0).otherwise(F.col("_p"))
    made = {"g": F.when(~F.col("_outliers"), F.col("_g")), "hom": F.when(F.col("_tested"), F.col("_hom")), "p": p}
    return rows.withColumns(made).drop("_g", "_hom", "_p", "_outliers", "_tested")


def log_odds(c0: Column, c1: Column, t0: Column, t1: Column) -> dict[str, Column]:
    """Fractions modified and the log odds ratio with its 95 % interval; a zero cell adds a half to all cells."""
    shift = F.when((c0 == 0) | (c1 == 0) | (t0 == 0) | (t1 == 0), 0.5).otherwise(0.0)
    a, b, c, d = c0 + shift, c1 + shift, t0 + shift, t1 + shift
    odds, half = F.ln(a * d / (b * c)), Z975 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {"cntrl_frac": F.try_divide(c1, c0 + c1), "treat_frac": F.try_divide(t1, t0 + t1), "log_odds": odds, "lower": odds - half, "upper": odds + half}


def bh_fdr(rows: DataFrame, p: str = "p") -> DataFrame:
    """rows with a p-value, with fdr by Benjamini and Hochberg.

    Distinct p-values are spread by range and ranked by running counts; their least adjusted values from each on come the same way.
    """
    tested = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    each = tested.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    at = ranges.running(ranges.spread(each, [], [F.col("_p")]), [], [F.col("_p")], {"_rank": F.col("_n")})
    at = at.withColumn("fdr", F.least(F.col("_p") * F.col("_rank_all") / F.col("_rank"), F.lit(1.0)))
    adjusted = ranges.least_after(at, "fdr", F.col("_p")).select("_p", "fdr")
    return tested.join(adjusted, F.col(p) == F.col("_p")).drop("_p")


def kmer_shifts(results: DataFrame, model: DataFrame) -> DataFrame:
    """(kmer, up): whether the higher of two component means is the one further from the model, by medians over all windows."""
    each = results.select(F.explode(F.arrays_zip("kmers", "mu1", "mu2")).alias("x")).select("x.kmers", "x.mu1", "x.mu2")
    each = each.join(model, F.col("kmers") == F.col("kmer"))
    off = lambda pick: F.abs(pick("mu1", "mu2") - F.col("level_mean"))
    sides = F.array(F.struct(F.lit(False).alias("high"), off(F.least).alias("off")), F.struct(F.lit(True).alias("high"), off(F.greatest).alias("off")))
    med = ranges.median(each.select("kmer", F.explode(sides).alias("s")).select("kmer", "s.*"), ["kmer", "high"], "off")
    side = lambda high: F.max(F.when(F.col("high") == high, F.col("med")))
    return med.groupBy("kmer").agg((side(True) > side(False)).cast("int").alias("up"))


def orient(results: DataFrame, shifts: DataFrame) -> DataFrame:
    """results with flip: whether the first component is the modified one, by the kmers' directions weighted by distance; ties stay."""
    each = results.select("id", F.explode(F.arrays_zip("kmers", "mu1", "mu2")).alias("x")).select("id", F.col("x.kmers").alias("kmer"), (F.col("x.mu1") - F.col("x.mu2")).alias("d"))
    first = (F.col("up") == 1) != (F.col("d") < 0)
    score = each.join(shifts, "kmer").groupBy("id").agg((F.sum(F.when(first, F.abs("d")).otherwise(0.0)) > F.sum(F.when(first, 0.0).otherwise(F.abs("d")))).alias("flip"))
    return results.join(score, "id", "left").withColumn("flip", F.coalesce("flip", F.lit(False)))


def flip(results: DataFrame) -> DataFrame:
    """Swaps the components where flip holds: fractions, odds with both ends of their interval, means and deviations."""
    x = F.col("flip")
    swap = lambda a, b: F.when(x, F.col(b)).otherwise(F.col(a))
    new = {
        "cntrl_frac": F.when(x, 1 - F.col("cntrl_frac")).otherwise(F.col("cntrl_frac")), "treat_frac": F.when(x, 1 - F.col("treat_frac")).otherwise(F.col("treat_frac")),
        "log_odds": F.when(x, -F.col("log_odds")).otherwise(F.col("log_odds")),
        "lower": F.when(x, -F.col("upper")).otherwise(F.col("lower")), "upper": F.when(x, -F.col("lower")).otherwise(F.col("upper")),
        "mu1": swap("mu1", "mu2"), "mu2": swap("mu2", "mu1"), "sd1": swap("sd1", "sd2"), "sd2": swap("sd2", "sd1"),
    }
    return results.select(*[new[c].alias(c) if c in new else F.col(c) for c in results.columns])


def flip_models(models: DataFrame) -> DataFrame:
    """Swaps means and covariances of the components where flip holds; weights stay in the order of the fit."""
    swap = lambda a, b: F.when(F.col("flip"), F.col(b)).otherwise(F.col(a))
    new = {"mu1": swap("mu1", "mu2"), "mu2": swap("mu2", "mu1"), "cov1": swap("cov1", "cov2"), "cov2": swap("cov2", "cov1")}
    return models.select(*[new[c].alias(c) if c in new else F.col(c) for c in models.columns])


def flip_predictions(predictions: DataFrame) -> DataFrame:
    """Where flip holds, pred becomes the posterior of the first component."""
    return predictions.withColumn("pred", F.when(F.col("flip"), 1 - (F.col("pred") + F.col("outlier"))).otherwise(F.col("pred")))
