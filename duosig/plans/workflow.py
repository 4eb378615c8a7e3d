"""From alignments of signals to differences between two conditions: preparation, tests of windows, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_precision
from ..operators import events as ev
from ..operators import mixture, report, splits
from ..operators import statistics as st
from ..sources import blocked, readers
from ..storage import stored


@dataclass(frozen=True)
class Options:
    """What a test of windows can be told; min_depth is by default what the window needs."""

    window: int = 3
    min_depth: int | None = None
    level: str = "gene"
    gmm: bool = True
    max_fit_depth: int = 1000
    min_ks: float = 0.2
    fdr: float = 0.05
    fit: mixture.FitOptions = mixture.FitOptions()

    @property
    def depth(self) -> int:
        return self.min_depth if self.min_depth is not None else ev.default_depth(self.window)

    @property
    def slots(self) -> int:
        return 2 * (self.window // 2) + 1


KEY = ["t_id", "pos", "kmer", "r_id"]


def prepare(raw: DataFrame, features: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Events of one sample, to be stored: gene_id, transcript_id, chrom, strand, pos, kmer, read_id, mean, std, duration, row_no.

    raw: an alignment of signals with row_no, the order of its lines. Adjacent lines of a read, position and kmer become one event with
    pooled mean and deviation and summed duration. With exons' features, positions are lifted onto the genome and events belong to
    genes; without, transcripts are their own genes on the plus strand. Means, deviations and durations are in half precision.
    """
    lines = readers.eventalign(raw, summary)
    first = F.min("row_no").alias("row_no")
    return _events_of(ev.collapse_runs(lines, ["t_id", "pos", "kmer"], ["r_id"], "row_no", [*ev.pooled(), F.sum("duration").alias("duration"), first]), features)


def prepare_files(spark: SparkSession, paths: list[str], features: DataFrame | None = None, summary: DataFrame | None = None, in_blocks: bool = False) -> DataFrame:
    """As prepare(), from the alignment files of one sample, in their order: lines are collapsed by the tasks that read them, in file order.

    Files are text, also gzip, of which one task reads a file, or, in_blocks, gzip files in members that state their size, which many tasks read. Names of reads are looked up, where there is a summary, once lines are collapsed: indices that share a name stay apart.
    """
    raw = blocked.blocked_tsv(spark, paths) if in_blocks else splits.in_file_order(spark, paths, lambda path: readers.tsv(spark, path))
    named = "read_name" in raw.columns or summary is None
    lines = readers.eventalign(raw if named else raw.withColumn("read_name", F.col("read_index").cast("string")))
    runs = splits.collapse_splits(lines, KEY)
    if not named:
        runs = readers.lookup_read_names(runs.withColumnRenamed("r_id", "read_index"), summary).withColumnRenamed("read_name", "r_id")
    return _events_of(runs, features)


def _events_of(runs: DataFrame, features: DataFrame | None) -> DataFrame:
    rows = runs.select(F.col("t_id").alias("transcript_id"), "pos", "kmer", F.col("r_id").alias("read_id"), *[half_precision(F.col(c)).alias(c) for c in ("mean", "std", "duration")], "row_no")
    if features is None:
        return rows.withColumns({"gene_id": F.col("transcript_id"), "chrom": F.col("transcript_id"), "strand": F.lit("+")})
    lifted = ev.liftover(rows, readers.exons(features))
    return lifted.withColumn("pos", F.col("gpos")).drop("gpos")


def features_of(lines: DataFrame) -> DataFrame:
    """Exon features of GTF lines (columns value and row_no), as readers.exons() needs them."""
    part = readers.gtf(lines, keep=("row_no",))
    return part.select(F.col("attrs")["transcript_id"].alias("transcript_id"), F.col("attrs")["gene_id"].alias("gene_id"), "chrom", "strand", "start", "end", "row_no")


def load_events(samples: list[DataFrame], conds: list[int], level: str = "gene") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, kmers, genes) of stored samples and their conditions (0 control, 1 treatment); replicates count from 1 in each condition.

    Of a read's events at a position the first stays, and stalls go. Only genes that all samples have take part. At transcript level
    a window's reads are those of one transcript, named in the place of the gene.
    """
    parts = []
    for i, (sample, cond) in enumerate(zip(samples, conds, strict=True)):
        rep = 1 + conds[:i].count(cond)
        parts.append(sample.withColumns({"cond": F.lit(cond).cast("long"), "rep": F.lit(rep).cast("long"), "sample": F.lit(i)}))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    shared = ev.shared_by_all(every.withColumnRenamed("gene_id", "gene"), "gene", "sample", len(samples)).withColumnRenamed("gene", "gene_id")
    every = every.join(shared, "gene_id", "left_semi")
    kmers = ev.last_kmers(every.select(F.col("gene_id").alias("gene"), "pos", "kmer", "sample", "row_no"))
    control = conds.index(0)  # the first control file names chromosome and strand
    named = every.where(F.col("sample") == control)
    genes = named.groupBy("gene_id").agg(F.max_by("chrom", "row_no").alias("chrom"), F.max_by("strand", "row_no").alias("strand"))
    kept = ev.drop_stalls(ev.dedupe_first(every, ["sample", "gene_id", "read_id", "pos"], ["row_no"]))
    locus = "gene_id" if level == "gene" else "transcript_id"
    events = kept.select(F.col(locus).alias("gene"), "gene_id", F.col("read_id").alias("read"), "pos", "cond", "rep", "mean", "strand")
    return events, kmers, genes


def window_vectors(events: DataFrame, options: Options) -> DataFrame:
    """Vectors of the windows in which every replicate is deep enough, stored."""
    windows = ev.valid_windows(ev.valid_positions(events, options.depth), options.window)
    v = stored(ev.window_vectors(events, windows, options.window))
    return v.join(ev.deep_windows(v, options.depth).select("gene", "centre"), ["gene", "centre"], "left_semi")


def ks_tests(vectors: DataFrame, options: Options) -> DataFrame:
    """The KS test of each window over its first principal component, on at most max_fit_depth reads of a condition."""
    used = ev.subsample(vectors, ["gene", "centre", "cond"], F.xxhash64("read"), options.max_fit_depth)
    return st.ks_2samp(st.pca_comp1(used, ["gene", "centre"], options.slots), ["gene", "centre"], "comp")


def fit_input(vectors: DataFrame, tests: DataFrame, options: Options) -> DataFrame:
    """Reads of windows worth a model, at most max_fit_depth of a replicate, with the replicate's depth. The gate is a stage of its own."""
    key = ["gene", "centre", "cond", "rep"]
    gate = tests.where((F.col("d") >= options.min_ks) & (F.col("p") < options.fdr)).select("gene", "centre")
    kept = vectors.join(gate, ["gene", "centre"], "left_semi")
    depth = kept.groupBy(*key).agg(F.count("*").alias("depth"))
    return ev.subsample(kept, key, F.xxhash64("read"), options.max_fit_depth).join(depth, key)


def results_of(models: DataFrame, tests: DataFrame, options: Options) -> DataFrame:
    """A row for each fitted window: G-test with homogeneity of replicates, fractions, log odds, component means and deviations, KS statistic."""
    reps = lambda k: F.transform(F.filter("counts", lambda c: c["cond"] == k), lambda c: c["n"])
    # Counts, then their test, as a table of their own: expressions over them repeat their arguments many times.
    cells = models.select("gene", "centre", reps(0).alias("c"), reps(1).alias("t"))
    cells = stored(cells.withColumns({f"{c}{k}": st.pooled_counts(F.col(c), k) for c in "ct" for k in (0, 1)}))
    pooled = [f"{c}{k}" for c in "ct" for k in (0, 1)]
    parts = options.fit.components
    cells = st.with_tests(cells, pooled, st.homogeneity_of(F.col("c"), parts) + st.homogeneity_of(F.col("t"), parts), options.fdr)
    tested = cells.select("gene", "centre", "g", "hom", "p", *[c.alias(n) for n, c in st.log_odds(*[F.col(x) for x in pooled]).items()])
    n = options.slots
    sd = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sqrt(F.col(c)[i * (n + 1)]))
    rows = models.select("gene", "centre", "mu1", "mu2", sd("cov1").alias("sd1"), sd("cov2").alias("sd2")).join(tested, ["gene", "centre"])
    return rows.join(tests.select("gene", "centre", F.col("d").alias("ks")), ["gene", "centre"])


def orient(rows: DataFrame, kmers: DataFrame, model: DataFrame, fdr: float) -> DataFrame:
    """Significant rows with kmers and flip, stored; components aren't swapped yet. kmers: gene, centre, kmers in window order."""
    found = stored(st.bh_fdr(rows).where(F.col("fdr") < fdr).join(kmers, ["gene", "centre"], "left").withColumn("id", F.concat_ws(":", "gene", "centre")))
    return st.orient(found, st.kmer_shifts(found, model))


@dataclass(frozen=True)
class Found:
    """vectors of all windows, models of gated ones, and significant windows with flip; models is None without a mixture."""

    vectors: DataFrame
    models: DataFrame | None
    rows: DataFrame


def find(vectors: DataFrame, kmers_of, model: DataFrame, options: Options = Options(), tests: DataFrame | None = None) -> Found:
    """All stages for windows: KS gate, mixture, G-test, odds, FDR, orientation. kmers_of: (gene, centre) to (gene, centre, kmers).

    vectors are a stored table, as they are read several times. Without a mixture the KS test's p-values of all windows are adjusted, and nothing is oriented.
    """
    tests = stored(ks_tests(vectors, options) if tests is None else tests)
    if not options.gmm:
        rows = st.bh_fdr(tests).where(F.col("fdr") < options.fdr).withColumnRenamed("d", "ks")
        missing = {c: F.lit(None).cast("double") for c in ("g", "hom", "cntrl_frac", "treat_frac", "log_odds", "lower", "upper")}
        missing |= {c: F.lit(None).cast("array<double>") for c in ("mu1", "mu2", "sd1", "sd2")}
        rows = rows.drop("n0", "n1").withColumns(missing | {"id": F.concat_ws(":", "gene", "centre"), "flip": F.lit(False)})
        return Found(vectors, None, rows.join(kmers_of(rows.select("gene", "centre")), ["gene", "centre"], "left"))
    models = stored(mixture.fit_windows(fit_input(vectors, tests, options), options.fit))
    rows = results_of(models, tests, options)
    return Found(vectors, models, orient(rows, kmers_of(rows.select("gene", "centre")), model, options.fdr))


def predictions(found: Found) -> DataFrame:
    """(gene, centre, part, json): for all reads of significant windows, with components turned as in the results."""
    turned = stored(found.models.join(found.rows.select("gene", "centre", "kmers", "flip"), ["gene", "centre"]))
    preds = mixture.predict_reads(found.vectors, turned).join(turned.select("gene", "centre", "flip"), ["gene", "centre"])
    return report.predictions_json(st.flip_predictions(preds), st.flip_models(turned))


def bed(found: Found, genes: DataFrame, locus: DataFrame | None = None, window: int = 3) -> DataFrame:
    """Lines of a BED file for significant windows. genes: gene_id, chrom, strand; locus: gene (as tested) and gene_id where they differ."""
    rows = st.flip(found.rows)
    rows = rows.join(locus, "gene") if locus is not None else rows.withColumn("gene_id", F.col("gene"))
    middle = window // 2
    at = {c: F.col(c)[middle] for c in ("mu1", "mu2", "sd1", "sd2")}
    rows = rows.join(genes.select("gene_id", "chrom", "strand"), "gene_id").withColumns({**at, "kmer": F.coalesce(F.col("kmers")[middle], F.lit("")), "pos": F.col("centre")})
    return report.bed_lines(rows.withColumn("gene_id", F.col("gene")))


def run(samples: list[DataFrame], conds: list[int], model: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame | None]:
    """(BED lines, predictions) of stored samples (see prepare()); predictions are None without a mixture."""
    events, kmers, genes = load_events(samples, conds, options.level)
    events = stored(events)
    locus = events.select("gene", "gene_id").distinct()
    found = find(stored(window_vectors(events, options)), lambda windows: _kmers_of(windows, kmers, genes, locus, options), model, options)
    return bed(found, genes, locus, options.window), predictions(found) if options.gmm else None


def _kmers_of(windows: DataFrame, kmers: DataFrame, genes: DataFrame, locus: DataFrame, options: Options) -> DataFrame:
    """Kmers of windows in the direction of the strand; kmers belong to genes, also for windows of transcripts."""
    named = windows.join(locus, "gene").join(genes.select("gene_id", "strand"), "gene_id")
    wide = named.select(F.col("gene_id").alias("gene"), "centre", "strand").distinct()
    got = ev.window_kmers(kmers, wide, options.window).withColumnRenamed("gene", "gene_id")
    return named.select("gene", "gene_id", "centre").join(got, ["gene_id", "centre"]).select("gene", "centre", "kmers")
