"""Collapses that keep file order, liftover by pieces and windows from reads, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duosig.operators import events as ev
from duosig.operators import splits
from duosig.plans import workflow
from duosig.sources import readers
from duosig.streaming import ingest

HEAD = "contig position reference_kmer read_name event_level_mean event_stdv event_length start_idx end_idx".split()


def lines_of(rng, n):
    """Lines in which runs have one to forty lines and reads come again."""
    out, at = [], 0
    while len(out) < n:
        t, pos, kmer, read = f"t{rng.randrange(3)}", rng.randrange(9), rng.choice(["AC", "GT"]), f"r{rng.randrange(6)}"
        for _ in range(rng.choice([1, 1, 2, 3, 40])):
            size = rng.randrange(1, 9)
            out.append((t, pos, kmer, read, round(rng.uniform(60, 90), 2), round(rng.uniform(1, 3), 2), round(rng.uniform(0, 0.1), 4), at, at + size))
            at += size
    return out[:n]


def brute_runs(lines):
    """(key, mean, std, duration, n) of adjacent lines with one key."""
    out = []
    for key, part in itertools.groupby(lines, lambda x: (x[0], x[1] + 2, x[2], x[3])):
        part = list(part)
        k, m, s = (np.array(v, float) for v in ([x[8] - x[7] for x in part], [x[4] for x in part], [x[5] for x in part]))
        mean = m[0] if len(part) == 1 else (k * m).sum() / k.sum()
        std = s[0] if len(part) == 1 else math.sqrt(((k * s * s).sum() + (k * (m - mean) ** 2).sum()) / k.sum())
        out.append((key, round(mean, 6), round(std, 6), round(sum(x[6] for x in part), 6), len(part)))
    return out


@pytest.mark.parametrize("size", [700, 3000, 1_000_000])
def test_collapse_inside_splits(spark, tmp_path, size):
    rng = random.Random(size)
    files = {f"f{i}.tsv": lines_of(rng, n) for i, n in enumerate((400, 1, 0, 150))}
    files["f4.tsv"] = [files["f0.tsv"][0]] * 300  # one run over many splits
    paths = []
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join("\t".join(map(str, x)) for x in [HEAD, *lines]) + "\n")
        paths.append(str(tmp_path / name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        raw = splits.in_file_order(spark, paths, lambda p: readers.tsv(spark, p))
        lines = readers.eventalign(raw)
        got = splits.collapse_splits(lines, ["t_id", "pos", "kmer", "r_id"]).orderBy("row_no").collect()
        ends = splits.split_runs(lines, ["t_id", "pos", "kmer", "r_id"]).where("end").groupBy("_file", "_block").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [x for lines in files.values() for x in brute_runs(lines)]
    assert [((r["t_id"], r["pos"], r["kmer"], r["r_id"]), round(r["mean"], 6), round(r["std"], 6), round(r["duration"], 6), r["n"]) for r in got] == want
    assert all(r["count"] <= 2 for r in ends) and (size > 5000 or len(ends) > 8)  # what is shuffled
    assert len({r["row_no"] for r in got}) == len(got)


def test_preparation_in_file_order(spark, tmp_path):
    rng = random.Random(4)
    reads = [sorted(((f"t{i % 2}", p, "ACGTA", f"r{i}") for p in rng.sample(range(30), 12)), key=lambda x: x[1]) for i in range(40)]
    lines, at = [], 0
    for key in itertools.chain(*reads):
        for _ in range(rng.randrange(1, 4)):
            lines.append((*key, round(rng.uniform(60, 90), 2), 1.0, 0.01, at, at + 3))
            at += 3
    (tmp_path / "a.tsv").write_text("\n".join("\t".join(map(str, x)) for x in [HEAD, *lines]) + "\n")
    f = spark.createDataFrame([("t0", "g", "c", "+", 100, 120, 0), ("t0", "g", "c", "+", 200, 220, 1), ("t1", "h", "c", "-", 300, 340, 2)], "transcript_id string, gene_id string, chrom string, strand string, start long, end long, row_no long")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        whole = workflow.prepare(readers.tsv(spark, str(tmp_path / "a.tsv")).coalesce(1).withColumn("row_no", F.monotonically_increasing_id()), f)
        cut = workflow.prepare_files(spark, [str(tmp_path / "a.tsv")], f)
        key = ["gene_id", "transcript_id", "read_id", "pos", "kmer"]
        rows = lambda df: [(*[r[c] for c in key], round(r["mean"], 4), round(r["std"], 2), round(r["duration"], 4)) for r in df.orderBy("row_no").collect()]
        assert rows(cut) == rows(whole) and len(rows(cut)) == 40 * 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    lines = lines_of(rng, 300)
    schema = "ts timestamp, r_id string, t_id string, pos long, kmer string, mean double, std double, duration double, points long, row_no long"
    rows = [(i + 1, x[3], x[0], x[1] + 2, x[2], x[4], x[5], x[6], x[8] - x[7], i) for i, x in enumerate(lines)]
    last = (10_000_000, "end", "t", 0, "A", 1.0, 1.0, 0.0, 1, 10_000_000)  # time goes on, so that open runs end
    cuts = [0, *sorted(rng.sample(range(1, 300), 5)), 300]
    parts = [rows[a:b] for a, b in itertools.pairwise(cuts)] + [[last], [(*last[:1], "end2", *last[2:])]]
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.PROVIDER)
    try:
        for i, part in enumerate(parts):  # each micro-batch is a query of its own that starts from the checkpoint
            made = spark.createDataFrame(part, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
            made.coalesce(1).write.mode("append").parquet(source)
            stream = ingest.collapse_stream(spark.readStream.schema(schema).parquet(source), late_ms=1000)
            stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = ev.collapse_runs(spark.createDataFrame([r[1:] for r in rows], schema.split(", ", 1)[1]), ["t_id", "pos", "kmer"], ["r_id"], "row_no", [*ev.pooled(), F.sum("duration").alias("duration"), F.count("*").alias("n"), F.min("row_no").alias("row_no")])
    values = lambda df: sorted((r["r_id"], r["row_no"], r["t_id"], r["pos"], r["kmer"], r["n"], round(r["mean"], 6), round(r["std"], 6), round(r["duration"], 6)) for r in df.where("r_id not like 'end%'").collect())
    assert values(spark.read.parquet(sink)) == values(batch)


def test_liftover_by_pieces(spark):
    rng = random.Random(6)
    features, want, asked = [], {}, []
    for t in range(30):
        strand, at, exons = rng.choice("+-"), 1000 * t, []
        for _ in range(5000 if t == 0 else rng.randrange(1, 9)):
            width = rng.randrange(1, 4) if t == 0 else rng.randrange(1, 700)
            exons.append((at, at + width))
            at += width + rng.randrange(1, 50)
        places = [p for a, b in exons for p in range(a, b)]
        want[f"t{t}"] = places[::-1] if strand == "-" else places
        features += [(f"t{t}", "g", "c", strand, a, b, i) for i, (a, b) in enumerate(exons)]
        asked += [(f"t{t}", p) for p in (range(0, len(places), 7) if t else range(len(places)))]
    asked += [("t1", p) for _ in range(200) for p in range(20) if p < len(want["t1"])]  # a transcript with many events
    f = spark.createDataFrame(features, "transcript_id string, gene_id string, chrom string, strand string, start long, end long, row_no long")
    at = spark.createDataFrame(asked, "transcript_id string, pos long")
    lifted = ev.liftover(at, readers.exons(f), size=64)
    got = lifted.collect()
    assert len(got) == len(asked) and all(want[r["transcript_id"]][r["pos"]] == r["gpos"] for r in got)
    plan = lifted._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 1 and "<" not in joins[0]  # an equi-join without a range
    wrong = spark.createDataFrame([("t1", -1), ("t1", 10**6), ("x", 0), (None, 0)], "transcript_id string, pos long")
    assert ev.liftover(wrong, readers.exons(f), strict=False).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 9])
def test_windows_from_reads(spark, size):
    rng, half = random.Random(size), size // 2
    events = [(g, c, r, f"{c}{r}-{i}", p, float(g * 1000 + p + i / 100), "-" if g == 2 else "+") for g in (1, 2) for c in (0, 1) for r in (1, 2) for i in range(12) for p in range(40) if rng.random() < 0.95]
    rng.shuffle(events)
    df = spark.createDataFrame(events, "gene long, cond long, rep long, read string, pos long, mean double, strand string")
    valid = [(g, p) for g in (1, 2) for p in range(40) if p % 11 != 5]
    got = ev.window_vectors(df, spark.createDataFrame(valid, "gene long, centre long"), size)
    mean = {(e[:4], e[4]): e[5] for e in events}
    want = []
    for key in {e[:4] for e in events}:
        for g, c in valid:
            v = [mean.get((key, p)) for p in range(c - half, c + half + 1)]
            if g == key[0] and None not in v:
                want.append((g, c, *key[1:], v[::-1] if g == 2 else v))
    assert sorted((r["gene"], r["centre"], r["cond"], r["rep"], r["read"], r["vec"]) for r in got.collect()) == sorted(want)
    names = got._jdf.queryExecution().optimizedPlan().toString()
    assert names.index("explode") < names.index("collect_list")  # windows are cut after events are gathered
    assert ev.window_vectors(df.limit(0), spark.createDataFrame(valid, "gene long, centre long"), size).count() == 0


def test_liftover_of_more_rows_is_more_tasks(spark, monkeypatch):
    """Tasks were as many for tables of any size, and each sorted more rows of larger ones."""
    from duosig.plans import catalogue

    sf = "/root/testdata/sf0.001"
    want = sorted(tuple(r) for r in catalogue.liftover(spark, sf).collect())
    monkeypatch.setattr(catalogue, "LIFTED_ROWS", 500)
    got = catalogue.liftover(spark, sf)
    assert got.rdd.getNumPartitions() >= 12 and sorted(tuple(r) for r in got.collect()) == want
