"""Numbers and edges of the operators on hand-made rows."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duosig.functions import numeric
from duosig.operators import events as ev
from duosig.operators import mixture, report
from duosig.operators import statistics as st
from duosig.plans import catalogue
from duosig.sources import readers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_half_precision(spark):
    values = [100.03, 132.07, 0.0, 65519.0, 65520.0, -3.14159, 1e-6, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(numeric.half_precision(F.col("x"))).collect()]
    want = [None if v is None else float(np.float16(v)) for v in values]
    assert got == want


def test_survival_functions(spark):
    got = one(spark, k=numeric.kolmogorov_sf(F.lit(1.0)), e=numeric.erfc(F.lit(1.0)), s=numeric.erfc(F.lit(0.3)))
    assert math.isclose(got["k"], 0.269999671677, abs_tol=1e-10)
    assert math.isclose(got["e"], math.erfc(1), abs_tol=1e-12) and math.isclose(got["s"], math.erfc(0.3), abs_tol=1e-12)


@pytest.mark.parametrize("x", [0.5, 1.0, 0.05, 1e-5, 0.00012345, 7.6e-12, 12.0, 123.0, 0.0, 0.31])
def test_general_format(spark, x):
    assert one(spark, g=numeric.general(F.lit(x)))["g"] == f"{x:.2g}"


def test_pooled_and_runs(spark):
    rows = spark.createDataFrame([("a", 1, 100.0, 2.0, 10), ("a", 2, 104.0, 3.0, 5), ("a", 3, 98.0, 1.0, 20)], "k string, n long, mean double, std double, points long")
    got = rows.groupBy("k").agg(*ev.pooled()).first()
    assert math.isclose(got["std"] ** 2, 7.244897959, abs_tol=1e-8)
    runs = spark.createDataFrame([("s", i, k) for i, k in enumerate("AABA")], "src string, i long, k string")
    assert sorted(r["n"] for r in ev.collapse_runs(runs, ["k"], ["src"], "i", [F.count("*").alias("n")]).collect()) == [1, 1, 2]


def test_windows(spark):
    at = spark.createDataFrame([(0, p) for p in (1, 2, 3, 5, 6, 7, 8)], "gene long, pos long")
    assert sorted(r["centre"] for r in ev.valid_windows(at, 3).collect()) == [2, 6, 7] == sorted(r["centre"] for r in ev.valid_windows(at, 2).collect())


def test_fdr(spark):
    rows = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,), (0.2,), (None,), (float("nan"),)], "p double")
    got = {r["p"]: round(r["fdr"], 9) for r in st.bh_fdr(rows).collect()}
    assert got == {0.01: 0.025, 0.04: 0.05, 0.03: 0.05, 0.005: 0.025, 0.2: 0.2}


def test_liftover(spark):
    f = spark.createDataFrame([("p", "g", "c", "+", 100, 110, 0), ("p", "g", "c", "+", 200, 205, 1), ("m", "g", "c", "-", 100, 110, 2), ("m", "g", "c", "-", 200, 205, 3)], "transcript_id string, gene_id string, chrom string, strand string, start long, end long, row_no long")
    at = spark.createDataFrame([("p", 0), ("p", 9), ("p", 10), ("m", 0), ("m", 14)], "transcript_id string, pos long")
    got = {(r["transcript_id"], r["pos"]): r["gpos"] for r in ev.liftover(at, readers.exons(f)).collect()}
    assert got == {("p", 0): 100, ("p", 9): 109, ("p", 10): 200, ("m", 0): 204, ("m", 14): 100}
    outside = spark.createDataFrame([("p", 15)], "transcript_id string, pos long")
    with pytest.raises(Exception, match="no exon"):
        ev.liftover(outside, readers.exons(f)).collect()
    assert ev.liftover(outside, readers.exons(f), strict=False).count() == 0


def test_g_test_and_orientation(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    g, p = st.g_test_2x2(*lit(0, 0, 5, 5))
    assert tuple(one(spark, g=g, p=p)) == (0.0, 1.0)
    assert one(spark, h=st.homogeneity([lit(1, 2, 3)]))["h"] == 0.0
    rows = spark.createDataFrame([(0, ["K"], [60.0], [70.0]), (1, ["K"], [70.0], [60.0]), (2, ["K"], [65.0], [65.0])], "id long, kmers array<string>, mu1 array<double>, mu2 array<double>")
    up = spark.createDataFrame([("K", 1)], "kmer string, up int")
    assert {r["id"]: r["flip"] for r in st.orient(rows, up).collect()} == {0: False, 1: True, 2: False}


def test_mixture_finds_two_components():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(60, 1, (300, 3)), rng.normal(68, 1, (100, 3))])
    sample = np.arange(400) % 2
    model = mixture.fit(x, sample)
    assert sorted(round(float(m[0])) for m in model["mu"]) == [60, 68]


@pytest.mark.parametrize("options", [mixture.FitOptions(factor=3.0), mixture.FitOptions(outliers=None), mixture.FitOptions(factor=3.0, covariance="diag")])
def test_fit_by_its_definition(options):
    """Two means, then EM by loops over rows and components: densities from determinants and inverses, updates with inertia."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(60, 1.2, (70, 2)), rng.normal(64, 1.5, (50, 2)), rng.uniform(40, 80, (10, 2))])
    sample = np.arange(len(x)) % 3
    got = mixture.fit(x, sample, options)

    best = None
    for restart in range(3):
        draw = [zlib.crc32(f"{restart}:{d}".encode(), zlib.crc32(x.tobytes())) / 2**32 for d in (0, 1)]
        first = x[int(draw[0] * len(x))]
        squares = [float(((r - first) ** 2).sum()) for r in x]
        upto, means = 0.0, None
        for r, d in zip(x, squares, strict=True):
            upto += d
            if means is None and upto > draw[1] * sum(squares):
                means = [first, r]
        for _ in range(100):
            near = [int(((r - means[1]) ** 2).sum() < ((r - means[0]) ** 2).sum()) for r in x]
            means = [np.mean([r for r, k in zip(x, near, strict=True) if k == j], axis=0) for j in (0, 1)]
        inertia = sum(min(((r - m) ** 2).sum() for m in means) for r in x)
        if best is None or inertia < best[0] - 1e-9:
            best, label = (inertia, means), near
    means = best[1]
    if options.outliers == "mad":
        off = [min(math.dist(r, m) for m in means) for r in x]
        middle = float(np.median(off))
        limit = 3.0 * float(np.median([abs(o - middle) for o in off]))
        label = [2 if o > limit else k for o, k in zip(off, label, strict=True)]
    swap = np.allclose([np.mean(x[np.array(got["label"]) == 0], 0)], [np.mean(x[np.array(label) == 1], 0)])
    label = [{0: 1, 1: 0}.get(k, k) for k in label] if swap else label
    assert list(got["label"]) == label

    parts = options.components
    rows = [[r for r, k in zip(x, label, strict=True) if k == j] for j in range(3)]
    cut = (lambda c: np.diag(np.diag(c))) if options.covariance == "diag" else (lambda c: c)
    mu, cov = [np.mean(r, 0) for r in rows[:2]], [cut(np.cov(np.array(r).T, bias=True)) for r in rows[:2]]
    low, high = (np.min(rows[2], 0), np.max(rows[2], 0)) if parts == 3 else (None, None)
    weight = {s: [(sum(1 for k, q in zip(label, sample, strict=True) if q == s and k == j) + 0.5) / ((sample == s).sum() + 0.5 * parts) for j in range(parts)] for s in range(3)}

    def density(r, j):
        if j == 2:
            return 1 / np.prod(high - low) if (r >= low).all() and (r <= high).all() else 0.0
        d = r - mu[j]
        return math.exp(-0.5 * d @ np.linalg.inv(cov[j]) @ d) / math.sqrt((2 * math.pi) ** 2 * np.linalg.det(cov[j]))

    # The step at iteration t moves parameters by 1 - 0.99 * (2 + t) ** -0.001, and the first update is made at t = 1.
    moves = (1 - 0.99 * (2 + t) ** -0.001 for t in range(1, 1001))
    assert round(1 - 0.99 * 3**-0.001, 4) == 0.0111
    last, step = None, 0
    while True:
        joint = [[weight[s][j] * density(r, j) for j in range(parts)] for r, s in zip(x, sample, strict=True)]
        total = sum(math.log(sum(p)) for p in joint)
        if last is not None and total - last <= 0.1:
            break
        last = total
        resp = np.array([[v / sum(p) for v in p] for p in joint])
        keep = next(moves)
        for j in (0, 1):
            n = resp[:, j].sum()
            m = sum(w * r for w, r in zip(resp[:, j], x, strict=True)) / n
            c = cut(sum(w * np.outer(r - m, r - m) for w, r in zip(resp[:, j], x, strict=True)) / n)
            mu[j], cov[j] = keep * mu[j] + (1 - keep) * m, keep * cov[j] + (1 - keep) * c
        for s in range(3):
            n = resp[sample == s].sum(0) + 0.5
            weight[s] = list(n / n.sum())
        step += 1
    for j in (0, 1):
        assert np.allclose(got["mu"][j], mu[j], rtol=1e-7) and np.allclose(got["cov"][j], cov[j], rtol=1e-6)
    assert all(np.allclose(got["weights"][s], weight[s], rtol=1e-6) for s in range(3)) and step > 2


def test_reading_alignments(spark):
    with pytest.raises(KeyError):
        readers.eventalign(spark.createDataFrame([("t", 1)], "contig string, position long"))
    raw = spark.createDataFrame([("a", "1")], "c_name string, read_index string")
    names = spark.createDataFrame([("1", "x", 0), ("1", "y", 1)], "read_index string, read_name string, row_no long")
    assert readers.lookup_read_names(raw, names).first()["read_name"] == "y"


def shifted_vectors(spark, sizes, shifts):
    """Vectors of three positions: sizes are reads by (cond, rep), shifts of most treated reads by (gene, centre)."""
    rng = np.random.default_rng(4)
    rows = []
    for (gene, centre), shift in shifts.items():
        for (cond, rep), n in sizes.items():
            x = rng.normal(66, 1, (n, 3)) + np.where(rng.random((n, 1)) < (0.8 if cond else 0.1), shift, 0.0)
            rows += [(gene, centre, cond, rep, 10_000 * (2 * cond + rep) + i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "gene long, centre long, cond long, rep long, read long, vec array<double>")


def level_at_64(spark, monkeypatch, rows):
    """rows as the vectors, with a kmer of its own at each position, all of level 64."""
    model = spark.createDataFrame([(f"K{i}", 64.0) for i in range(20)], "kmer string, level_mean double")
    at = F.sequence(F.col("centre") - 1, F.col("centre") + 1)
    kmers = lambda windows: windows.withColumn("kmers", F.transform(at, lambda i: F.concat(F.lit("K"), i.cast("string"))))
    monkeypatch.setattr(catalogue.views, "vectors", lambda spark, sf: rows)
    monkeypatch.setattr(catalogue.views, "levels", lambda spark, sf: model)
    monkeypatch.setattr(catalogue, "_window_kmers", lambda spark, sf: kmers)


def test_predictions_of_all_reads(spark, monkeypatch):
    sizes = {(0, 1): 1200, (0, 2): 60, (1, 1): 1100, (1, 2): 60}
    rows = shifted_vectors(spark, sizes, {(1, 3): 10.0, (1, 10): -20.0, (2, 3): 0.0})
    level_at_64(spark, monkeypatch, rows)
    got = {(r["gene"], r["centre"]): json.loads(r["json"]) for r in catalogue.sm_json(spark, "").collect()}
    assert sorted(got) == [(1, 3), (1, 10)]  # significant windows only
    truth = {(r["centre"], r["cond"], r["rep"], r["read"]): r["vec"] for r in rows.where("gene = 1").collect()}
    for (_, centre), doc in got.items():
        unmod, mod = (np.array(doc["model"][k]["mu"]) for k in ("unmod", "mod"))
        assert abs(mod.mean() - 64) > abs(unmod.mean() - 64)  # components are turned by the model's level
        for c, cond in enumerate(("cntrl", "treat")):
            for rep in (1, 2):
                each = doc[cond][str(rep)]
                assert len(each["read_ids"]) == sizes[c, rep] == len(each["preds"])
                assert all(truth[centre, c, rep, r] == v for r, v in zip(each["read_ids"], each["events"], strict=True))
                near = np.linalg.norm(np.array(each["events"]) - mod, axis=1) < np.linalg.norm(np.array(each["events"]) - unmod, axis=1)
                p, o = np.array(each["preds"]), np.array(each["outlier_preds"])
                assert (((p > 1 - p - o) == near) | (o > 0.5)).mean() > 0.98


def test_deep_windows_in_parts(spark):
    rows = [(1, 3, i % 2, 1 + i % 3, i, [float(i)] * 3, 0.5, 0.1) for i in range(95)]
    made = spark.createDataFrame(rows, "gene long, centre long, cond long, rep long, read long, vec array<double>, pred double, outlier double")
    models = spark.createDataFrame([(1, 3, ["K"], *[[1.0] * 3] * 2, *[[1.0] * 9] * 2, *[[1.0] * 3] * 3)], "gene long, centre long, kmers array<string>, mu1 array<double>, mu2 array<double>, cov1 array<double>, cov2 array<double>, low array<double>, high array<double>, w array<double>")
    got = [(r["part"], json.loads(r["json"])) for r in report.predictions_json(made, models, part_reads=20).collect()]
    assert len({p for p, _ in got}) == len(got) == 5
    back = sorted((r, c, int(k)) for _, d in got for c, cond in enumerate(("cntrl", "treat")) for k, rep in d[cond].items() for r in rep["read_ids"])
    assert back == [(i, i % 2, 1 + i % 3) for i in range(95)]


def g_of(table):
    """G of a table of counts without a correction, by its definition; 0 if a row or a column is empty."""
    o = np.array(table, float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    if not (o.sum(0).all() and o.sum(1).all()):
        return 0.0
    return 2 * sum(x * math.log(x / y) for x, y in zip(o.ravel(), e.ravel(), strict=True) if x)


def test_all_replicates_and_genes_are_tested(spark, monkeypatch):
    three = {(0, 1): 60, (0, 2): 60, (0, 3): 90, (1, 1): 60, (1, 2): 60, (1, 3): 90, (1, 4): 40}
    rows = shifted_vectors(spark, three, {(1, 3): 10.0, (2, 3): -20.0, (3, 3): 0.0})
    level_at_64(spark, monkeypatch, rows)
    got = {r["gene"]: r for r in catalogue.flagship(spark, "").collect()}
    assert sorted(got) == [1, 2]  # genes aren't pooled
    fits = {r["gene"]: r["counts"] for r in mixture.fit_windows(catalogue._fit_input(spark, "", rows)).collect()}
    for gene, r in got.items():
        reps = {k: [c["n"] for c in fits[gene] if c["cond"] == k] for k in (0, 1)}
        assert len(reps[0]) == 3 and len(reps[1]) == 4
        assert math.isclose(r["hom"], g_of(reps[0]) + g_of(reps[1]), abs_tol=1e-6)
        n = [[sum(x[k] for x in reps[c]) for k in (0, 1)] for c in (0, 1)]
        odds = abs(math.log(n[0][0] * n[1][1] / (n[0][1] * n[1][0]))) if all(map(all, n)) else None
        assert odds is None or math.isclose(abs(r["log_odds"]), odds, rel_tol=1e-9)


def test_homogeneity_of_an_array_is_that_of_columns(spark):
    for table in ([[3, 5, 1], [2, 9, 4]], [[3, 0, 1], [2, 9, 4]], [[3, 0, 1], [2, 0, 4]], [[1, 2, 3]], [[0, 0, 0], [1, 2, 3]]):
        columns = [[F.lit(float(x)) for x in r] for r in table]
        r = one(spark, a=st.homogeneity(columns), b=st.homogeneity_of(F.array(*[F.array(*x) for x in columns])))
        assert math.isclose(r["a"], r["b"], abs_tol=1e-9)


def test_attributes(spark):
    cases = {
        'gene_id "g"; level 2; transcript_id "t";': {"gene_id": "g", "transcript_id": "t"},
        'gene_id "g;1"; note "a b"; gene_id "h"': {"gene_id": "h", "note": "a b"},
        'gene_id "g" x; transcript_id "t"': {"transcript_id": "t"},
        'empty ""; open "x': {}, "": {}, 'tag first_name "q";': {"first_name": "q"},
    }
    got = {r["a"]: r["m"] for r in spark.createDataFrame([(a,) for a in cases], "a string").select("a", readers.gtf_attrs(F.col("a")).alias("m")).collect()}
    assert got == cases
