"""BAM files and the encoded store: what is written is read again, however it is cut."""

import glob
import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duosig.functions import numeric
from duosig.operators import events as ev
from duosig.plans import workflow
from duosig.sources import bam, blocked, readers, store

REFERENCES = [("chr1", 100_000), ("chr2", 5_000)]


def record(rng, i, long=False):
    """A record by the format, and what its row has."""
    ref = rng.choice([0, 0, 1, -1])
    start = rng.randrange(5_000) if ref >= 0 else -1
    cigar = [(rng.choice([0, 1, 2, 3, 4, 7, 8]), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))] if ref >= 0 else []
    letters = rng.randrange(150_000, 200_000) if long else rng.choice([0, rng.randrange(1, 400)])
    de = rng.choice([None, round(rng.random() / 4, 3)])
    tags = b"NMi" + struct.pack("<i", i) + b"MDZ10A5\0" + b"xbBc" + struct.pack("<i3b", 3, 1, 2, 3) + b"xsBI" + struct.pack("<iI", 1, 7)
    if de is not None:
        tags += b"def" + struct.pack("<f", de)
    name = f"read-{i}".encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, start, len(name), rng.randrange(60), 4680, len(cigar), 16 * (i % 2), letters, -1, -1, 0) + name
    body += b"".join(struct.pack("<I", n << 4 | op) for op, n in cigar) + rng.randbytes((letters + 1) // 2) + rng.randbytes(letters) + tags
    size = lambda kinds: sum(n for op, n in cigar if op in kinds)
    row = (f"chr{ref + 1}" if ref >= 0 else None, start, f"read-{i}", 16 * (i % 2), body[9], cigar, letters, size((0, 1, 7, 8)), size((0, 1, 4, 7, 8)), None if de is None else round(de, 3), ref)
    return struct.pack("<i", len(body)) + body, row


def block(content):
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    extra = b"XX\x01\x00z" + b"BC\x02\x00" + struct.pack("<H", len(body) + 30)  # another field before the block's size
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(content), len(content))


@pytest.fixture(scope="module")
def bam_file(tmp_path_factory):
    rng = random.Random(8)
    header = bam.Header(b"@HD\tVN:1.6\n", REFERENCES)
    made = [record(rng, i, long=i == 150) for i in range(400)]
    data, out, at = header.bytes() + b"".join(r for r, _ in made), b"", 0
    while at < len(data):
        n = rng.randrange(1, 3_000) if rng.random() < 0.9 else rng.randrange(1, 60_000)
        out, at = out + block(data[at : at + n]), at + n
    path = tmp_path_factory.mktemp("bam") / "a.bam"
    path.write_bytes(out + bam.END_BLOCK)
    return str(path), header, [row for _, row in made], [r for r, _ in made]


def plain(row):
    return (*[row[c] for c in ("reference_name", "reference_start", "read_name", "flag", "mapping_quality")], [(c["op"], c["len"]) for c in row["cigar"]], *[row[c] for c in ("query_length", "query_alignment_length", "inferred_length")], None if row["de"] is None else round(row["de"], 3), row["reference_id"])


@pytest.mark.parametrize("split", [997, 5_000, 40_000, 1 << 30])
def test_any_split_gives_the_same_records(bam_file, split):
    path, header, rows, raw = bam_file
    reader = bam.BamReader({"paths": json.dumps([path]), "split": str(split)})
    got = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [plain(r) for r in got] == rows and [r["record"] for r in got] == raw
    assert bam.read_header(path)[0] == header


def test_filter_and_write_back(spark, bam_file, tmp_path):
    path, header, rows, _ = bam_file
    read = bam.read_bam(spark, path, split=20_000)
    assert read.rdd.getNumPartitions() > 3 and read.count() == 400
    kept = ev.filter_alignments(read, min_length=20, min_fraction=0.3, min_quality=10, max_indel_size=60)

    def good(r):
        gaps = [n for op, n in r[5] if op in (1, 2, 3)]
        return r[7] >= 20 and r[7] / (r[6] or r[8]) >= 0.3 and r[9] is not None and r[9] <= 0.15 and r[4] >= 10 and max(gaps, default=0) <= 60

    want = [r for r in rows if good(r)]
    assert 3 < len(want) < 200
    bam.write_bam(kept, str(tmp_path / "out"), header)
    parts = sorted(glob.glob(f"{tmp_path}/out/*.bam"))
    back = [plain(r) for p in parts for r in bam.read_bam(spark, p).collect()]
    assert sorted(back, key=str) == sorted(want, key=str)
    assert [(r[10] < 0, r[10], r[1]) for r in back] == sorted((r[10] < 0, r[10], r[1]) for r in back)
    index = [json.loads(x) for x in open(f"{tmp_path}/out/references.json")]
    assert sum(x["records"] for x in index) == len(want) and {x["reference_id"] for x in index} == {r[10] for r in want}
    for x in index:  # a virtual offset leads to its reference's first record
        data = open(f"{tmp_path}/out/{x['file']}", "rb").read()
        content = zlib.decompressobj(31).decompress(data[x["offset"] >> 16 :])[x["offset"] & 0xFFFF :]
        assert struct.unpack_from("<i", content, 4)[0] == x["reference_id"] and struct.unpack_from("<i", content, 8)[0] == x["first"]
    bam.write_bam(kept.limit(0), str(tmp_path / "none"), header)
    assert all(bam.read_bam(spark, p).count() == 0 for p in glob.glob(f"{tmp_path}/none/*.bam"))


@pytest.mark.parametrize("split", [300, 4_000, 1 << 30])
def test_lines_of_blocked_gzip(spark, tmp_path, split):
    rng = random.Random(split)
    lines = ["contig\tposition"] + ["\t".join(("x" * rng.choice([0, 3, 3, 2_000]), str(i))) for i in range(900)]
    data, out, at = "\n".join(lines).encode() + b"\n" * (split > 300), b"", 0
    while at < len(data):
        n = rng.randrange(1, 400) if rng.random() < 0.9 else len(lines[0]) + 1
        out, at = out + block(data[at : at + n]), at + n
    path = tmp_path / "a.tsv.gz"
    path.write_bytes(out + bam.END_BLOCK)
    reader = blocked.LineReader({"paths": json.dumps([str(path)]), "split": str(split)})
    got = [r["value"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert got == lines
    rows = blocked.blocked_tsv(spark, [str(path)], split)
    assert [(r["contig"], r["position"]) for r in rows.orderBy(F.col("position").cast("int")).collect()] == [tuple(x.split("\t")) for x in lines[1:]]
    assert split > 300 or rows.rdd.getNumPartitions() > 1


def test_half_bits(spark):
    every = [float(x) for x in np.arange(65536, dtype=np.uint16).view(np.float16) if x == x and not (x == 0 and np.signbit(x))]
    values = [*every, 1e-9, -1e6, 0.1, None, float("nan")]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").select("i", numeric.half_bits(F.col("x")).alias("b")).select("i", "b", numeric.half_of_bits(F.col("b")).alias("y")).orderBy("i").collect()
    for v, r in zip(values, got, strict=True):
        if v is None or v != v:
            assert r["y"] is None if v is None else r["y"] != r["y"]
            continue
        half = np.float64(v).astype(np.float16)
        assert r["y"] == float(half) and (half == 0 or r["b"] == int(half.view(np.int16)))


def sample_of(spark, rng, genes, reads, rows):
    out = []
    for i in range(rows):
        g, t, r = rng.choice(genes), rng.randrange(3), rng.randrange(reads)
        out.append((f"gene{g}", f"g{g}-t{t}", "chr1", "+" if g % 2 else "-", rng.randrange(3000), rng.choice(["AACGT", "TTGCA"]), f"00000000-1111-2222-3333-{r:012d}", *[float(np.float16(rng.uniform(0, 100))) for _ in range(3)], i))
    return spark.createDataFrame(out, "gene_id string, transcript_id string, chrom string, strand string, pos long, kmer string, read_id string, mean double, std double, duration double, row_no long")


def test_encoded_store(spark, tmp_path):
    rng = random.Random(3)
    samples = {"c1": sample_of(spark, rng, [1, 2, 3], 40, 9000), "t1": sample_of(spark, rng, [3, 2, 4], 40, 9000), "t2": sample_of(spark, rng, [5, 1], 10, 500)}
    path = str(tmp_path / "store")
    made = store.Store(spark, path, buckets=4)
    made.add(samples["c1"], "c1")
    numbers = {r["gene_id"]: r["gene_no"] for r in made.genes.collect()}
    made.add(samples["t1"], "t1")
    again = store.Store(spark, path, buckets=99)  # opened anew; the number of buckets is the store's own
    again.add(samples["t2"], "t2")
    assert again.buckets == 4 and again.samples() == ["c1", "t1", "t2"]
    genes = {r["gene_id"]: r["gene_no"] for r in again.genes.collect()}
    assert numbers.items() <= genes.items() and sorted(genes.values()) == list(range(5))
    by_gene = again.transcripts.groupBy("gene_no").agg(F.sort_array(F.collect_list("transcript_no")).alias("n")).collect()
    assert all(r["n"] == list(range(len(r["n"]))) for r in by_gene)
    with pytest.raises(ValueError, match="in the store"):
        again.add(samples["c1"], "c1")

    for name, rows in samples.items():
        first = ev.dedupe_first(rows, ["gene_id", "read_id", "pos"], ["row_no"])
        key = ["gene_id", "transcript_id", "chrom", "strand", "pos", "read_id", "mean", "std", "duration"]
        assert sorted(map(str, again.events(name).select(*key).collect())) == sorted(map(str, first.select(*key).collect()))
    both = [samples["c1"], samples["t1"]]
    for a, b in zip(workflow.load_events(both, [0, 1]), workflow.load_events([again.events("c1"), again.events("t1")], [0, 1]), strict=True):
        assert sorted(map(str, b.select(*a.columns).collect())) == sorted(map(str, a.collect()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = again.pairs("c1", "t1")
        n = pairs.count()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n > 100 and "Exchange" not in plan and "Join" in plan


def test_bytes_of_an_event(spark, tmp_path):
    """Reads of 500 positions in turn: the encoded store takes less than the plain one, dictionaries included."""
    n, at, read = 120_000, F.col("row_no") % 500, F.floor(F.col("row_no") / 500)
    rows = spark.range(0, n, 1, 4).withColumnRenamed("id", "row_no").withColumn("pos", at + read % 300)
    md5 = F.md5(read.cast("string"))
    name = F.concat_ws("-", *[F.substring(md5, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    halves = [numeric.half_precision(c).alias(x) for c, x in ((80 + 10 * F.randn(1), "mean"), (2 + F.rand(2), "std"), (F.rand(3) / 50, "duration"))]
    gene = lambda x, k: F.concat(F.lit(x), (read % k + 100_000).cast("string"))
    events = rows.select(gene("ENSG", 7).alias("gene_id"), gene("ENST", 21).alias("transcript_id"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), "pos", F.substring(F.md5(F.col("pos").cast("string")), 1, 5).alias("kmer"), name.alias("read_id"), *halves, "row_no")
    made = store.Store(spark, str(tmp_path / "store"), buckets=4)
    made.add(events, "a")
    readers.write_store(events.withColumn("sample", F.lit("a")), str(tmp_path / "plain"))
    size = lambda p: sum(os.path.getsize(f) for f in glob.glob(f"{p}/**/*.parquet", recursive=True))
    assert made.events("a").count() == n and size(tmp_path / "store") < 0.85 * size(tmp_path / "plain")


def rows_scanned(df):
    """Rows that the scans of the run plan of df gave out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name.endswith("QueryStage"):
            todo.append(node.plan())
    return found


def test_few_genes_of_many(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 1000}", f"t{i % 1000}", "c", "+", int(rng.integers(900)), "AAAAA", f"r{i // 1000}", float(np.float16(rng.random())), 1.0, 0.0, i) for i in range(120_000)]
    events = spark.createDataFrame(rows, "gene_id string, transcript_id string, chrom string, strand string, pos long, kmer string, read_id string, mean double, std double, duration double, row_no long")
    made = store.Store(spark, str(tmp_path / "store"), buckets=2)
    made.add(events, "a")
    asked = ["g3", "g4", "g5", "g500", "nowhere"]
    few = made.numbers("a", asked)
    assert few.count() == made.events("a", asked).count() == events.where(F.col("gene_id").isin(asked)).dropDuplicates(["gene_id", "read_id", "pos"]).count()
    assert "PushedFilters: [In(gene_no" in few._jdf.queryExecution().executedPlan().toString() or "In(gene_no" in few._jdf.queryExecution().toString()
    assert rows_scanned(few.select("pos")) < 0.6 * rows_scanned(made.numbers("a").select("pos"))


def test_few_genes_of_many_reads_are_many_files(spark, tmp_path, monkeypatch):
    """One gene's events were written by one task, whatever their number."""
    monkeypatch.setattr(store, "READS", 100)
    rows = [("g", "t", "c", "+", pos, "AAAAA", f"r{read:04d}", float(read % 50), 0.0, 0.5, read * 3 + pos) for read in range(2_000) for pos in range(3)]
    df = spark.createDataFrame(rows, "gene_id string, transcript_id string, chrom string, strand string, pos long, kmer string, read_id string, mean double, std double, duration double, row_no long")
    made = store.Store(spark, str(tmp_path / "store"), buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        made.add(df, "one")
        made.add(df, "two")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    each = made.numbers("one").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in each) == 6_000 and max(r["n"] for r in each) <= 3_000
    got = {(r["read_id"], r["pos"]): r["mean"] for r in made.events("two").collect()}
    assert got == {(r[6], r[4]): r[7] for r in rows}
    assert [tuple(r) for r in made.pairs("one", "two").orderBy("pos").select("pos", "n_one", "n_two").collect()] == [(p, 2_000, 2_000) for p in range(3)]
