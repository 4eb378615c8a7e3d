"""The whole way from alignment files to reports, against brute force in numpy."""

import collections
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duosig.operators import events as ev
from duosig.operators import mixture, ranges
from duosig.operators import statistics as st
from duosig.plans import workflow
from duosig.sources import readers
from duosig.storage import stored

GENE = "".join(np.random.default_rng(3).choice(list("ACGT"), 40))
SHIFTED = {"g1": (12, 13, 14), "g2": (20, 21, 22)}  # transcript positions whose treated reads are shifted
HEAD = "contig position reference_kmer read_index read_name event_level_mean event_stdv event_length start_idx end_idx".split()


def kmer_at(pos):
    return GENE[pos : pos + 5]


def lines_of(rng, cond, rep, transcripts):
    """Lines of an alignment: each read of a transcript (gene) has one or two adjacent lines at each of 26 positions."""
    out, at = [], 0
    for t, gene in transcripts.items():
        for read in range(50):
            shifted = rng.random() < (0.75 if cond else 0.05)
            for pos in range(6, 32):
                if rng.random() < 0.01:
                    continue
                mean = 70 + 5 * math.sin(pos) + rng.normal(0, 1) + (10 if shifted and pos in SHIFTED[gene] else 0)
                for part in range(1 + (rng.random() < 0.3)):
                    size = int(rng.integers(5, 30))
                    out.append((t, pos - 2, kmer_at(pos), at, f"{cond}{rep}-{t}-{read}", round(mean + 0.2 * part, 3), 1.5, 2.0 if rng.random() < 0.005 else 0.01, at, at + size))
                    at += size
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("run"), np.random.default_rng(9)
    transcripts = {"t1": "g1", "t2": "g2", "t3": "g2"}
    raw = {}
    for cond in (0, 1):
        for rep in (1, 2, 3):
            raw[cond, rep] = lines_of(rng, cond, rep, transcripts)
            text = "\n".join("\t".join(map(str, x)) for x in [HEAD, *raw[cond, rep]])
            (root / f"{cond}{rep}.tsv").write_text(text + "\n")
    exon = lambda chrom, a, b, strand, g, t: f'{chrom}\tx\texon\t{a}\t{b}\t.\t{strand}\t.\tgene_id "{g}"; transcript_id "{t}";'
    gtf = ["# made", exon("chr1", 101, 120, "+", "g1", "t1"), exon("chr1", 201, 240, "+", "g1", "t1"), exon("chr2", 501, 560, "-", "g2", "t2"), exon("chr2", 501, 560, "-", "g2", "t3"), "chr2\tx\tCDS\t1\t2\t.\t-\t.\t"]
    (root / "a.gtf").write_text("\n".join(gtf) + "\n")
    kmers = sorted({kmer_at(p) for p in range(6, 32)})
    (root / "model.tsv").write_text("# levels\nkmer\tlevel_mean\tlevel_stdv\n" + "".join(f"{k}\t68.0\t2.0\n" for k in kmers))
    return root, raw, transcripts


@pytest.fixture(scope="module")
def prepared(spark, files):
    root = files[0]
    lines = spark.read.text(f"{root}/a.gtf").withColumn("row_no", F.monotonically_increasing_id())
    features = workflow.features_of(lines)
    samples, conds = [], []
    for cond in (0, 1):
        for rep in (1, 2, 3):
            raw = readers.tsv(spark, f"{root}/{cond}{rep}.tsv").withColumn("row_no", F.monotonically_increasing_id())
            samples.append(stored(workflow.prepare(raw, features)))
            conds.append(cond)
    return samples, conds


def genomic(t, pos):
    if t == "t1":
        return 100 + pos if pos < 20 else 200 + pos - 20
    return 500 + 60 - pos - 1


def half(x):
    return float(np.float16(x))


def brute_vectors(raw, transcripts, size, level):
    """{(locus, centre): {(cond, rep): {read: vector}}} by loops over reads and positions."""
    half_size, depth = size // 2, max(2 * size, 5)
    value = collections.defaultdict(dict)
    for (cond, rep), lines in raw.items():
        seen = set()
        runs = []
        for line in lines:
            key = (line[0], line[1] + 2, line[2], line[4])
            if runs and runs[-1][0] == key:
                runs[-1][1].append(line)
            else:
                runs.append((key, [line]))
        for (t, pos, _, read), part in runs:
            n = np.array([x[9] - x[8] for x in part], float)
            m = np.array([x[5] for x in part])
            mean = m[0] if len(part) == 1 else (n * m).sum() / n.sum()
            at = genomic(t, pos)
            if (transcripts[t], read, at) in seen:
                continue
            seen.add((transcripts[t], read, at))
            if half(sum(x[7] for x in part)) <= 1:
                value[transcripts[t] if level == "gene" else t].setdefault((cond, rep), {}).setdefault(read, {})[at] = half(mean)
    out = {}
    for locus, by_rep in value.items():
        reads = {k: len([r for r in v]) for k, v in by_rep.items()}
        assert len(reads) == 6
        places = {p for v in by_rep.values() for r in v.values() for p in r}
        deep = {p for p in places if all(sum(p in r for r in v.values()) >= depth for v in by_rep.values())}
        for centre in deep:
            win = list(range(centre - half_size, centre + half_size + 1))
            if not deep.issuperset(win):
                continue
            win = win[::-1] if locus in ("g2", "t2", "t3") else win
            held = {k: {name: [r[p] for p in win] for name, r in v.items() if all(p in r for p in win)} for k, v in by_rep.items()}
            if all(len(v) >= depth for v in held.values()):
                out[locus, centre] = held
    return out


@pytest.mark.parametrize(("size", "level"), [(3, "gene"), (5, "transcript")])
def test_vectors_and_kmers_of_both_strands(files, prepared, size, level):
    _, raw, transcripts = files
    samples, conds = prepared
    options = workflow.Options(window=size, level=level)
    events, kmers, genes = workflow.load_events(samples, conds, level)
    v = workflow.window_vectors(events, options)
    got = collections.defaultdict(lambda: collections.defaultdict(dict))
    for r in v.collect():
        got[r["gene"], r["centre"]][r["cond"], r["rep"]][r["read"]] = r["vec"]
    assert got == brute_vectors(raw, transcripts, size, level)
    locus = events.select("gene", "gene_id").distinct()
    named = {(r["gene"], r["centre"]): r["kmers"] for r in workflow._kmers_of(v.select("gene", "centre").distinct(), kmers, genes, locus, options).collect()}
    assert set(named) == set(got)
    for (g, centre), names in named.items():  # in transcript order, kmers overlap by four letters; but not over the exons' border
        assert len(names) == size and (g in ("g1", "t1") and 118 < centre < 202 or all(a[1:] == b[:-1] for a, b in zip(names, names[1:], strict=False)))


def ks(a, b):
    every = np.concatenate([a, b])
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in every)
    en = math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    x = (en + 0.12 + 0.11 / en) * d
    return d, min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def adjusted(p):
    order = sorted(range(len(p)), key=lambda i: p[i], reverse=True)
    least, out = 1.0, [0.0] * len(p)
    for k, i in enumerate(order):
        least = min(least, p[i] * len(p) / (len(p) - k))
        out[i] = least
    return out


def g_of(table, yates=False):
    o = np.array(table, float)
    if not (o.sum(0).all() and o.sum(1).all()):
        return 0.0
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    if yates:
        o = o + np.sign(e - o) * np.minimum(0.5, abs(e - o))
    return 2 * sum(x * math.log(x / y) for x, y in zip(o.ravel(), e.ravel(), strict=True) if x > 0)


@pytest.mark.parametrize(("size", "fit"), [(3, mixture.FitOptions()), (5, mixture.FitOptions(covariance="diag", outliers=None)), (3, mixture.FitOptions(outliers="dbscan"))])
def test_tests_of_windows(spark, files, prepared, size, fit):
    root, raw, transcripts = files
    samples, conds = prepared
    options = workflow.Options(window=size, fit=fit)
    model = readers.kmer_model(spark, f"{root}/model.tsv")
    lines, predicted = workflow.run(samples, conds, model, options)
    rows = {}
    for key, reps in brute_vectors(raw, transcripts, size, "gene").items():
        every = {c: np.array([x for (k, _), v in sorted(reps.items()) if k == c for x in v.values()]) for c in (0, 1)}
        x = np.concatenate([every[0], every[1]])
        z = (x - x.mean(0)) / x.std(0)
        comp = np.round(z @ np.linalg.svd(z, full_matrices=False)[2][0], 9)
        d, p = ks(comp[: len(every[0])], comp[len(every[0]) :])
        if d < 0.2 or p >= 0.05:
            continue
        ordered = [(c * 1000 + r, v) for (c, r), reads in sorted(reps.items()) for _, v in sorted(reads.items())]
        m = mixture.fit(np.array([v for _, v in ordered]), np.array([s for s, _ in ordered]), fit)
        if m is None:
            continue
        n = {k: np.rint(m["weights"][k[0] * 1000 + k[1]] * len(reps[k])) for k in reps}
        c, t = ([n[k] for k in sorted(n) if k[0] == cond] for cond in (0, 1))
        cells = [sum(c)[:2], sum(t)[:2]]
        g = g_of(cells, True)
        pv = math.erfc(math.sqrt(g / 2)) if g else 1.0
        hom = g_of(c) + g_of(t) if pv < 0.05 else None
        rows[key] = {"p": 1.0 if hom is not None and hom >= g else pv, "g": g, "ks": d, "mu": m["mu"]}
    for key, f in zip(rows, adjusted([r["p"] for r in rows.values()]), strict=True):
        rows[key]["fdr"] = f
    want = {k: r for k, r in rows.items() if r["fdr"] < 0.05}
    places = {(g, genomic("t1" if g == "g1" else "t2", p)) for g, ps in SHIFTED.items() for p in ps}
    assert places <= set(want)  # what was shifted is found
    got = [x["line"].split("\t") for x in lines.collect()]
    assert {(x[3].split(":")[0], int(x[1]) + 2) for x in got} == set(want) and [(x[0], int(x[1])) for x in got] == sorted((x[0], int(x[1])) for x in got)
    for x in got:
        r = want[x[3].split(":")[0], int(x[1]) + 2]
        assert x[11] == f"{r['g']:.2f}" and abs(float(x[17]) - r["ks"]) < 0.0051 and math.isclose(float(x[8]), r["fdr"], rel_tol=0.06, abs_tol=1e-300)
        middle = sorted(float(m[size // 2]) for m in r["mu"])
        assert sorted((float(x[13]), float(x[15]))) == pytest.approx(middle, abs=0.006)
        if (x[3].split(":")[0], int(x[1]) + 2) in places:  # the modified component is the one further from the model, as most treated reads are
            assert float(x[15]) > float(x[13]) and float(x[10]) > float(x[9])
    docs = {(r["gene"], r["centre"]): json.loads(r["json"]) for r in predicted.collect()}
    assert set(docs) == set(want)
    one = docs[next(iter(docs))]
    assert np.array(one["model"]["mod"]["cov"]).shape == (size, size) and len(one["model"]["weights"]) == fit.components and ("outlier" in one["model"]) == (fit.outliers is not None)
    assert sum(len(r["preds"]) for r in one["treat"].values()) == sum(len(r["events"]) for r in one["treat"].values()) > 0


def test_without_a_mixture_and_writers(spark, files, prepared, tmp_path):
    root, _, _ = files
    samples, conds = prepared
    model = readers.kmer_model(spark, f"{root}/model.tsv")
    kept = []
    for i, s in enumerate(samples):
        readers.write_store(s.withColumn("sample", F.lit(i)), f"{tmp_path}/{i}")
        kept.append(readers.read_store(spark, f"{tmp_path}/{i}").drop("sample"))
    lines, predicted = workflow.run(kept, conds, model, workflow.Options(gmm=False))
    got = [x["line"].split("\t") for x in lines.collect()]
    assert predicted is None and len(got) >= 6 and all(x[6] == "nan[nan,nan]" and x[13] == "nan" for x in got)
    docs = spark.createDataFrame([('a"b', 3, 0, '{"kmers":["K"]}')], "gene string, centre long, part long, json string")
    workflow.report.write_predictions(docs, {"cntrl": ["a.h5"], "treat": ["b.h5", "c.h5"]}, f"{tmp_path}/json")
    assert json.loads(spark.read.text(f"{tmp_path}/json/parts").first()[0]) == {"gene_id": 'a"b', "pos": 3, "part": 0, "kmers": ["K"]}
    assert json.loads(spark.read.text(f"{tmp_path}/json/inputs").first()[0])["input_fns"]["treat"] == {"0": "b.h5", "1": "c.h5"}
    kept = spark.createDataFrame([("chr1", 5, "x"), ("chr1", 2, "y")], "reference_name string, reference_start long, read string")
    readers.write_alignments(kept, f"{tmp_path}/alignments")
    assert readers.alignments(spark, f"{tmp_path}/alignments").count() == 2


def test_ranges_of_large_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in zip(rng.choice([1, 1, 1, 2, 3], 3000), rng.integers(0, 200, 3000) / 4, strict=True)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    got = {r["k"]: (r["med"], r["mad"]) for r in st.mad(df, ["k"], "v").collect()}
    for k in (1, 2, 3):
        x = np.array([v for q, v in rows if q == k])
        assert got[k] == (np.median(x), np.median(abs(x - np.median(x))))
    p = [float(x) for x in np.round(rng.random(500) ** 3, 3)]
    fdr = {r["p"]: r["fdr"] for r in st.bh_fdr(spark.createDataFrame([(x,) for x in p], "p double")).collect()}
    assert all(math.isclose(fdr[x], f, rel_tol=1e-12, abs_tol=1e-15) for x, f in zip(p, adjusted(p), strict=True))
    first = spark.createDataFrame([(k, f"r{v}", i) for i, (k, v) in enumerate(rows)], "k long, name string, i long")
    codes = {(r["k"], r["name"]): r["idx"] for r in ev.encode(first, ["k"], "name", ["i"]).collect()}
    seen = collections.defaultdict(dict)
    for k, v in rows:
        seen[k].setdefault(f"r{v}", len(seen[k]))
    assert codes == {(k, n): i for k, names in seen.items() for n, i in names.items()}
    assert ranges.median(df.limit(0), ["k"], "v").count() == 0


def test_noise_of_dense_and_open_cells(spark):
    rng = np.random.default_rng(6)
    points = [(g, i, float(x), float(y)) for g in (0, 1) for i, (x, y) in enumerate([*rng.normal(0, 1, (120, 2)), *rng.uniform(-40, 40, (60, 2)), *rng.normal(20, 4, (60, 2))])]
    df = spark.createDataFrame(points, "g long, id long, x double, y double")
    for eps, share in ((2.0, 0.1), (5.0, 0.25), (3.0, 0.03)):
        got = {(r["g"], r["id"]): r["noise"] for r in mixture.noise(df, ["g"], "x", "y", eps, share).collect()}
        for g in (0, 1):
            own = [(i, np.array([x, y])) for h, i, x, y in points if h == g]
            near = {i: [j for j, q in own if ((p - q) ** 2).sum() <= eps * eps] for i, p in own}
            core = {i for i, js in near.items() if len(js) >= share * len(own)}
            assert {i: got[g, i] for i, _ in own} == {i: not (core & set(near[i])) for i, _ in own}
            assert mixture._far_from_dense(np.array([p for _, p in own]), eps, share * len(own)).tolist() == [got[g, i] for i, _ in own]


def test_stream_collapse(spark, tmp_path):
    from duosig.streaming import ingest

    rows = [("r", 1, "A", 60.0, 0.1, "2024-01-01 00:00:01"), ("r", 1, "A", 62.0, 0.2, "2024-01-01 00:00:02"), ("r", 2, "C", 70.0, 0.1, "2024-01-01 00:00:03"), ("s", 1, "A", 1.0, 1.0, "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "r_id string, pos long, kmer string, mean double, duration double, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("r_id string, pos long, kmer string, mean double, duration double, ts timestamp").parquet(f"{tmp_path}/in")
    query = ingest.collapse_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["r_id"], r["pos"]): (r["n"], r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("r", 1): (2, 61.0), ("r", 2): (1, 70.0)}  # what the watermark has passed
