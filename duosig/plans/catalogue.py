"""Queries over the given tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import events as ev
from ..operators import dbscan, em, mixture, report, splits
from ..operators import statistics as st
from ..sources import readers, store
from . import sql, views, workflow
from .views import table

R = lambda c, n=6: F.round(c, n)
MIN_KS, FDR = 0.2, 0.05


def scan_project_cast(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("contig"), F.col("l_linenumber").cast("string").alias("position"), F.concat("l_returnflag", "l_linestatus").alias("reference_kmer"),
        F.col("l_orderkey").alias("read_name"), F.col("l_extendedprice").cast("string").alias("event_level_mean"), F.col("l_discount").alias("event_stdv"), F.col("l_tax").alias("event_length"),
        F.col("l_partkey").alias("start_idx"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end_idx"),
    )
    return readers.eventalign(raw)


def lookup_read_names(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("read_index"), "c_name")
    summary = table(spark, sf, "orders").select(F.col("o_custkey").alias("read_index"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("read_name"), F.col("o_orderkey").alias("row_no"))
    return readers.lookup_read_names(raw, summary, strict=False)


def gtf_attrs(spark, sf):
    a = readers.gtf_attrs(F.col("attrs"))
    return views.annotation_lines(spark, sf).withColumn("m", a).select("s_suppkey", F.col("m")["gene_id"].alias("gene_id"), F.col("m")["transcript_id"].alias("transcript_id"), F.size("m").cast("long").alias("n_keys"))


def gtf_parse(spark, sf):
    return readers.gtf(views.annotation_lines(spark, sf)).select("chrom", "start", "end", "strand", F.col("attrs")["transcript_id"].alias("transcript_id"))


def exon_cumsum(spark, sf):
    return readers.exons(views.exon_features(spark, sf)).select("transcript_id", "gene_id", "start", "cs", "ln")


#: Rows that a task of the liftover sorts or counts, about: tables of any size are as many more tasks.
LIFTED_ROWS = 500_000


def liftover(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // LIFTED_ROWS))
    exons = readers.exons(views.exon_features(spark, sf).repartition(parts, "transcript_id"))
    size = exons.groupBy(F.col("transcript_id").alias("_t")).agg(F.first("ln").alias("_ln"))
    reads = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").cast("string").alias("transcript_id"), "l_partkey").repartition(parts, "transcript_id")
    # A table between the steps: sorts and counts of both at once were in one task.
    at = views.stored(reads.join(size, F.col("transcript_id") == F.col("_t")).select("transcript_id", (F.col("l_partkey") % F.col("_ln")).alias("pos")))
    by = ["transcript_id", "strand", "pos", "gpos"]
    return ev.liftover(at, exons, parts=parts).repartition(parts, *by).groupBy(*by).agg(F.count("*").alias("n"))


def run_collapse(spark, sf):
    e = table(spark, sf, "events")
    return ev.collapse_runs(e, ["event_type"], ["user_id"], "event_id", [F.count("*").alias("n"), R(F.sum("value")).alias("duration")])


def run_collapse_splits(spark, sf):
    """Runs of equal event types in the order of the file, collapsed inside its splits."""
    e = splits.in_file_order(spark, [f"{sf}/events.parquet"], spark.read.parquet)
    lines = e.select("event_type", F.col("value").alias("mean"), (F.abs("value") / 10).alias("std"), F.col("value").alias("duration"), (F.col("event_id") % 20 + 1).alias("points"), "_file", "_block")
    runs = splits.collapse_splits(lines, ["event_type"])
    return runs.select("event_type", "n", R("mean", 4).alias("mean"), R("std", 4).alias("std"), R("duration", 4).alias("duration"))


def pooled_stats(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("mean"), (F.abs("value") / 10).alias("std"), (F.col("event_id") % 20 + 1).alias("points"))
    return e.groupBy("user_id", "event_type").agg(*ev.pooled()).select("user_id", "event_type", R("mean", 4).alias("mean"), R("std", 4).alias("std"))


def f16_quantise(spark, sf):
    half = numeric.half_precision
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", half(F.col("l_extendedprice") / 7).alias("price"), half(F.col("l_quantity") * 1.37).alias("quantity"), half(F.col("l_tax")).alias("tax"))


def dedupe_first(spark, sf):
    return views.deduped(spark, sf).select("gene", "read", "pos", R("mean").alias("mean"), "duration")


def stall_filter(spark, sf):
    return views.events(spark, sf).select("gene", "read", "pos", R("mean").alias("mean"))


def dict_encode(spark, sf):
    return ev.encode(views.raw_events(spark, sf), ["gene"], "read", views.ORDER)


def kmer_last_wins(spark, sf):
    return ev.last_kmers(views.kmers(spark, sf))


def window_kmers(spark, sf):
    k = ev.last_kmers(views.kmers(spark, sf))
    got = ev.window_kmers(k, ev.valid_windows(k.select("gene", "pos"), 3), 3)
    return got.select("gene", "centre", *[F.col("kmers")[i].alias(f"k{i}") for i in range(3)])


def shared_genes(spark, sf):
    e = views.events(spark, sf).withColumn("sample", F.col("cond") * 10 + F.col("rep"))
    return ev.shared_by_all(e, "gene", "sample", 4)


def shared_transcripts(spark, sf):
    e = views.events(spark, sf)
    return e.where("cond = 0").select("gene", "l_suppkey").intersect(e.where("cond = 1").select("gene", "l_suppkey"))


def valid_positions(spark, sf):
    return ev.valid_positions(views.events(spark, sf), 6)


def valid_windows(spark, sf):
    return ev.valid_windows(valid_positions(spark, sf), 3)


def window_depth(spark, sf):
    e = views.events(spark, sf)
    return ev.deep_windows(ev.window_vectors(e, ev.valid_windows(ev.valid_positions(e, 6), 3), 3), 6)


def window_vectors(spark, sf):
    return views.vectors(spark, sf).select("gene", "centre", "cond", "rep", "read", *[R(F.col("vec")[i]).alias(f"v{i}") for i in range(3)])


def pivot_matrix(spark, sf):
    wide = views.events(spark, sf).groupBy("gene", "cond", "rep", "read").pivot("pos", list(range(1, 8))).agg(R(F.max("mean")))
    return wide.select("gene", "cond", "rep", "read", *[F.col(str(i)).alias(f"pos_{i}") for i in range(1, 8)])


def pooled_union(spark, sf):
    e = views.events(spark, sf)
    both = e.where("cond = 0").select("gene", "pos", "mean").unionByName(e.where("cond = 1").select("gene", "pos", "mean"))
    return both.groupBy("gene", "pos").agg(F.count("*").alias("n"), R(F.avg("mean"), 5).alias("mean"))


def topk_subsample(spark, sf):
    reads = views.events(spark, sf).select("gene", "cond", "rep", "read").distinct()
    return ev.subsample(reads, ["gene", "cond", "rep"], F.expr("(read * 2654435761) % 1000000007"), 20)


def ks_by_position(spark, sf):
    return st.ks_2samp(views.events(spark, sf), ["gene", "pos"], "mean")


def ks_2samp(spark, sf):
    return ks_by_position(spark, sf).select("gene", "pos", "n0", "n1", R("d").alias("d"), R("p").alias("p"))


def pca_comp1(spark, sf):
    c = st.pca_comp1(views.vectors(spark, sf), ["gene", "centre"]).withColumn("comp", F.round("comp", 6))
    return c.groupBy("gene", "centre", "cond").agg(F.count("*").alias("n"), R(F.avg("comp"), 4).alias("mean"), R(F.max("comp"), 4).alias("most"))


def tested_windows(spark, sf, vectors=None):
    """KS tests of first components over all reads, without the subsample that a test of deep windows draws, so that SQL can state them."""
    v = views.vectors(spark, sf) if vectors is None else vectors
    comp = st.pca_comp1(v, ["gene", "centre"]).withColumn("comp", F.round("comp", 6))  # values that differ by rounding errors alone are ties
    return st.ks_2samp(comp, ["gene", "centre"], "comp")


def pca_kstest(spark, sf):
    return tested_windows(spark, sf).select("gene", "centre", "n0", "n1", R("d", 4).alias("d"), R("p", 4).alias("p"))


def gated(tests: DataFrame) -> DataFrame:
    """Windows worth a model; the gate is a stage of its own, as no filter passes through a grouped function."""
    return tests.where((F.col("d") >= MIN_KS) & (F.col("p") < FDR))


def ks_gate(spark, sf):
    return gated(tested_windows(spark, sf)).select("gene", "centre", R("d", 4).alias("d"))


def mad(spark, sf):
    return st.mad(table(spark, sf, "events"), ["event_type"], "value").select("event_type", R("med").alias("med"), R("mad").alias("mad"))


OPTIONS = workflow.Options(min_ks=MIN_KS, fdr=FDR)


def _fit_input(spark, sf, vectors=None):
    """Reads of gated windows, at most 1,000 of a replicate, with the replicate's depth."""
    v = views.stored(views.vectors(spark, sf) if vectors is None else vectors)
    return workflow.fit_input(v, tested_windows(spark, sf, v), OPTIONS)


def kmeans_init(spark, sf):
    return mixture.label_windows(_fit_input(spark, sf)).groupBy("gene", "centre", "cond", "rep", "label").agg(F.count("*").alias("n"))


def dbscan_noise(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return mixture.noise(rows, ["event_type"], "x", "y", 5.0, 0.004).select("event_type", "id", "noise")


def dbscan_core(spark, sf):
    """Core rows and noise of density clusters in two dimensions; which cluster a row is in has no short form in SQL and is held by tests."""
    rows = table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    found = dbscan.dbscan(rows, ["event_type"], ["x", "y"], 5.0, share=0.004)
    return found.select("event_type", "id", "core", F.col("label").isNull().alias("noise"))


def labelled(spark, sf):
    label = F.when(F.col("mean") < 66, 0).when(F.col("mean") < 72, 1).otherwise(2)
    return views.events(spark, sf).withColumn("label", label)


def cluster_weights(spark, sf):
    w = mixture.cluster_weights(labelled(spark, sf), ["gene", "pos", "cond", "rep"])
    return w.select("gene", "pos", "cond", "rep", "n", *[R(f"w{k}").alias(f"w{k}") for k in range(3)])


def combined_weights(spark, sf):
    w = mixture.combined_weights(mixture.cluster_weights(labelled(spark, sf), ["gene", "pos", "cond", "rep"]), ["gene", "pos"])
    return w.select("gene", "pos", *[R(f"w{k}").alias(f"w{k}") for k in range(3)])


def gmm_init(spark, sf):
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / 3
    rows = views.vectors(spark, sf).withColumn("label", F.when(mean < 65, 0).when(mean < 75, 1).otherwise(2))
    c = mixture.initial_components(rows, ["gene", "centre"], 3)
    return c.select("gene", "centre", "label", "n", *[R(n, 4).alias(n) for n in c.columns[4:]])


EM_STEPS = 5


def em_1d(spark, sf):
    p = mixture.em_1d(table(spark, sf, "events"), ["event_type"], "value", EM_STEPS, {"shift": 1.0})
    return p.select("event_type", *[R(n, 4).alias(n) for n in ("w1", "mu1", "mu2", "v1", "v2")])


SUM_STEPS = 3


def em_windows(spark, sf):
    """The mixture of every window by sums, after a fixed number of steps from labels by the mean."""
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / 3
    v = views.stored(views.vectors(spark, sf))
    depth = v.groupBy(*em.SAMPLE).agg(F.count("*").alias("depth"))
    rows = v.join(depth, em.SAMPLE).withColumns({"label": F.when(mean < 65, 0).when(mean < 75, 1).otherwise(2), "nearer": F.when(mean < 70, 0).otherwise(1)})
    m = em.fit_by_sums(rows, 3, steps=SUM_STEPS)
    return m.select("gene", "centre", *[R(F.col(f"mu{k}")[i], 4).alias(f"mu{k}_{i}") for k in (1, 2) for i in range(3)], *[R(F.col(f"cov{k}")[3 * i + j], 4).alias(f"c{k}_{i}{j}") for k in (1, 2) for i in range(3) for j in range(i + 1)], *[R(F.col("w")[k], 4).alias(f"w{k}") for k in range(3)])


def gmm_fit(spark, sf):
    return mixture.fit_windows(_fit_input(spark, sf)).drop("counts")


def gmm_counts(spark, sf):
    m = mixture.fit_windows(_fit_input(spark, sf)).select("gene", "centre", F.explode("counts").alias("c"))
    return m.select("gene", "centre", "c.cond", "c.rep", *[F.col("c.n")[k].alias(f"n{k}") for k in range(3)])


POSTERIOR = ([(0.5, 20.0, 15.0), (0.3, 60.0, 25.0)], (0.2, 0.0, 200.0))


def posterior_1d(spark, sf):
    p = mixture.posteriors(F.col("value"), *POSTERIOR)
    return table(spark, sf, "events").select("event_id", *[R(c).alias(n) for c, n in zip(p, ("unmod", "mod", "outlier"), strict=True)])


def _counts(spark, sf):
    cond, rep = F.col("o_custkey") % 2, F.expr("o_custkey div 2") % 2
    pick = lambda c, r, s: F.sum(((cond == c) & (rep == r) & (F.col("o_orderstatus") == s)).cast("double")).alias(f"{'ct'[c]}{r}{s}")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(*[pick(c, r, s) for c in (0, 1) for r in (0, 1) for s in "FOP"])


def _cells():
    return [F.col(f"{c}0{s}") + F.col(f"{c}1{s}") for c in "ct" for s in "FO"]


def g_test_2x2(spark, sf):
    g, p = st.g_test_2x2(*_cells())
    return _counts(spark, sf).select("o_orderpriority", R(g).alias("g"), R(p).alias("p"))


def g_test_hom(spark, sf):
    reps = lambda c: [[F.col(f"{c}{r}{s}") for s in "FOP"] for r in (0, 1)]
    cells = dict(zip(("c0", "c1", "t0", "t1"), _cells(), strict=True))
    tested = st.with_tests(_counts(spark, sf).withColumns(cells), list(cells), st.homogeneity(reps("c")) + st.homogeneity(reps("t")), 0.9)
    return tested.select("o_orderpriority", R("g").alias("g"), R("hom").alias("hom"), R("p").alias("p"))


def log_odds(spark, sf):
    return _counts(spark, sf).select("o_orderpriority", *[R(c).alias(n) for n, c in st.log_odds(*_cells()).items()])


def bh_fdr(spark, sf):
    return st.bh_fdr(ks_by_position(spark, sf)).select("gene", "pos", R("p").alias("p"), R("fdr").alias("fdr"))


def sig_filter(spark, sf):
    return st.bh_fdr(ks_by_position(spark, sf)).where(F.col("fdr") < FDR).select("gene", "pos")


def sm_semi_join(spark, sf):
    kept = sig_filter(spark, sf)
    return views.events(spark, sf).join(kept, ["gene", "pos"], "left_semi").select("gene", "pos", "cond", "rep", "read", R("mean").alias("mean"))


def kmer_prior_join(spark, sf):
    return ev.last_kmers(views.kmers(spark, sf)).join(views.model(spark, sf), "kmer").select("gene", "pos", "kmer", "level_mean")


def kmer_shift(spark, sf):
    return st.kmer_shifts(views.results(spark, sf), views.model(spark, sf))


def orient_components(spark, sf):
    r = views.results(spark, sf)
    return st.orient(r, st.kmer_shifts(r, views.model(spark, sf))).select("id", "flip")


def flip_results(spark, sf):
    r = views.results(spark, sf)
    o = st.orient(r, st.kmer_shifts(r, views.model(spark, sf)))
    x = F.col("id").cast("double")
    made = o.select("id", "flip", (x % 7 / 7).alias("cntrl_frac"), (x % 11 / 11).alias("treat_frac"), (x % 13 - 6).alias("log_odds"), (x % 13 - 7).alias("lower"), (x % 13 - 4).alias("upper"), F.col("mu1")[0].alias("mu1"), F.col("mu2")[0].alias("mu2"), (x % 3).alias("sd1"), (x % 5).alias("sd2"))
    f = st.flip(made)
    return f.select("id", "flip", *[R(c).alias(c) for c in f.columns[2:]])


def bed_format(spark, sf):
    k = st.bh_fdr(ks_by_position(spark, sf).withColumn("p", F.round("p", 8)))
    num = lambda m: ((F.col("gene") * 31 + F.col("pos") * 17) % m).cast("double")
    made = k.select(
        F.concat(F.lit("chr"), F.col("gene").cast("string")).alias("chrom"), "pos", F.col("gene").alias("gene_id"), F.lit("ACGTA").alias("kmer"), F.when(F.col("gene") % 2 == 0, "+").otherwise("-").alias("strand"),
        (num(13) / 4).alias("log_odds"), (num(13) / 4 - 1).alias("lower"), (num(13) / 4 + 1).alias("upper"), "p", "fdr", (num(7) / 7).alias("cntrl_frac"), (num(5) / 5).alias("treat_frac"), num(19).alias("g"), F.when(num(2) == 0, num(3)).alias("hom"),
        (num(40) + 60).alias("mu1"), (num(9) / 4).alias("sd1"), (num(40) + 70).alias("mu2"), (num(11) / 4).alias("sd2"), (F.floor(F.col("d") * 4) / 4).alias("ks"),
    )
    return report.bed_lines(made)


def _window_kmers(spark, sf):
    """Kmers of given windows from the parts."""
    return lambda windows: ev.window_kmers(ev.last_kmers(views.kmers(spark, sf)), windows, OPTIONS.window)


def _found(spark, sf, vectors=None) -> workflow.Found:
    v = views.stored(views.vectors(spark, sf) if vectors is None else vectors)
    return workflow.find(v, _window_kmers(spark, sf), views.levels(spark, sf), OPTIONS, tested_windows(spark, sf, v))


def sm_json(spark, sf):
    """Predictions for all reads of significant windows; only the fit is over a subsample."""
    return workflow.predictions(_found(spark, sf))


def cigar_max_indel(spark, sf):
    return views.alignments(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", ev.max_indel().alias("max_indel"), ev.max_indel(skips=False).alias("without_skips"))


def aln_filter(spark, sf):
    return ev.filter_alignments(views.alignments(spark, sf)).select("l_orderkey", "l_partkey", "l_linenumber")


def gene_dim_join(spark, sf):
    genes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("gene"), F.col("r_name").alias("chrom"))
    first = views.events(spark, sf).where("cond = 0 and rep = 1").groupBy("gene").agg(F.count("*").alias("n"))
    return first.join(genes, "gene")


def gene_subset(spark, sf):
    return views.events(spark, sf).where(F.col("gene").isin(1, 3)).groupBy("gene", "pos").agg(F.count("*").alias("n"))


def store_roundtrip(spark, sf):
    e = views.events(spark, sf).select(F.concat_ws("-", F.col("cond").cast("string"), F.col("rep").cast("string")).alias("sample"), F.col("gene").alias("gene_id"), "pos", numeric.half_precision(F.col("mean")).alias("mean"))
    path = views.scratch(spark)
    readers.write_store(e, path)
    return readers.read_store(spark, path).groupBy(F.col("sample").cast("string").alias("sample"), "gene_id", "pos").agg(F.count("*").alias("n"), R(F.avg("mean"), 4).alias("mean"))


def store_encoded(spark, sf):
    """Both conditions added to an encoded store one after the other, and what it gives back."""
    raw = views.raw_events(spark, sf)
    text = lambda c: F.col(c).cast("string")
    e = raw.select("cond", text("gene").alias("gene_id"), text("l_suppkey").alias("transcript_id"), F.lit("c").alias("chrom"), F.lit("+").alias("strand"), "pos", F.lit("AAAAA").alias("kmer"), text("read").alias("read_id"), "mean", F.lit(0.0).alias("std"), "duration", F.struct(*views.ORDER).alias("row_no"))
    made = store.Store(spark, views.scratch(spark), buckets=8)
    for cond in (0, 1):
        made.add(e.where(F.col("cond") == cond).drop("cond"), f"c{cond}")
    back = made.events("c0").withColumn("sample", F.lit("c0")).unionByName(made.events("c1").withColumn("sample", F.lit("c1")))
    return back.groupBy("sample", "gene_id", "pos").agg(F.count("*").alias("n"), R(F.avg("mean"), 4).alias("mean"), R(F.avg("duration"), 4).alias("duration"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Significant windows of every gene of the whole table."""
    return st.flip(_found(spark, sf).rows)


def significant_bed(spark: SparkSession, sf: str) -> DataFrame:
    """BED lines of the significant windows of the whole table, oriented by the parts' kmers."""
    genes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("gene_id"), F.col("r_name").alias("chrom"), F.when(F.col("r_regionkey") % 2 == 1, "-").otherwise("+").alias("strand"))
    return workflow.bed(_found(spark, sf), genes)


def pooled_smoke(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    """The position test with genes pooled into one locus, so that the smallest tables have the depth; not a result for genes."""
    e = views.events(spark, sf).withColumn("gene", F.lit(0).cast("long"))
    v = ev.window_vectors(e, ev.valid_windows(ev.valid_positions(e, depth), 3), 3)
    return st.flip(_found(spark, sf, v).rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        scan_project_cast, lookup_read_names, gtf_attrs, gtf_parse, exon_cumsum, liftover, run_collapse, run_collapse_splits, pooled_stats, f16_quantise, dedupe_first, stall_filter, dict_encode, kmer_last_wins, window_kmers,
        shared_genes, shared_transcripts, valid_positions, valid_windows, window_depth, window_vectors, pivot_matrix, pooled_union, topk_subsample, ks_2samp, pca_comp1, pca_kstest, ks_gate, mad, kmeans_init,
        dbscan_noise, dbscan_core, cluster_weights, combined_weights, gmm_init, em_1d, em_windows, gmm_fit, gmm_counts, posterior_1d, g_test_2x2, g_test_hom, log_odds, bh_fdr, sig_filter, sm_semi_join, kmer_prior_join, kmer_shift,
        orient_components, flip_results, bed_format, sm_json, cigar_max_indel, aln_filter, gene_dim_join, gene_subset, store_roundtrip, store_encoded, flagship, significant_bed,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return sql.statements()
