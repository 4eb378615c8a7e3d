"""Results as BED lines and as nested JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import general


def bed_lines(results: DataFrame) -> DataFrame:
    """Eighteen tab-separated columns per result, in order of chromosome, position and gene.

    results: chrom, pos, gene_id, kmer, strand, log_odds, lower, upper, p, fdr, cntrl_frac, treat_frac, g,
    hom, mu1, sd1, mu2, sd2, ks (means and deviations of the middle kmer). Missing numbers are nan.
    """
    def two(name):
        x = F.col(name)
        return F.when(x.isNull() | F.isnan(x), "nan").otherwise(F.format_string("%.2f", x))

    score = F.rint(F.least(F.when(F.col("fdr") > 0, -F.log10(F.when(F.col("fdr") > 0, F.col("fdr")))).otherwise(100.0), F.lit(100.0))).cast("int")
    fields = [
        F.col("chrom"), (F.col("pos") - 2).cast("string"), (F.col("pos") + 3).cast("string"), F.concat_ws(":", F.col("gene_id").cast("string"), "kmer"), score.cast("string"), F.col("strand"),
        F.concat(two("log_odds"), F.lit("["), two("lower"), F.lit(","), two("upper"), F.lit("]")), general(F.col("p")), general(F.col("fdr")),
        *[two(c) for c in ("cntrl_frac", "treat_frac", "g", "hom", "mu1", "sd1", "mu2", "sd2", "ks")],
    ]
    return results.orderBy("chrom", "pos", "gene_id").select(F.concat_ws("\t", *fields).alias("line"))


def write_bed(results: DataFrame, path: str) -> None:
    """Lines in order over the files of a folder; the sort is a range partition, not one task."""
    bed_lines(results).write.text(path)


def predictions_json(predictions: DataFrame, models: DataFrame, part_reads: int = 10_000) -> DataFrame:
    """(gene, centre, part, json): kmers, model, and per condition and replicate parallel lists by read.

    predictions: gene, centre, cond, rep, read, vec, pred, outlier. Replicates are numbered from 1. A window of up to part_reads reads is
    one document; the reads of a deeper one are dealt by hash into parts of about that many, each with kmers and model.
    """
    parts = predictions.groupBy("gene", "centre").agg(F.ceil(F.count("*") / part_reads).alias("_parts"))
    predictions = predictions.join(parts, ["gene", "centre"]).withColumn("part", F.pmod(F.xxhash64("read"), F.col("_parts")))
    reads = F.array_sort(F.collect_list(F.struct("read", "vec", "pred", "outlier")))
    by_rep = predictions.groupBy("gene", "centre", "part", "cond", "rep").agg(reads.alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    by_rep = by_rep.select("gene", "centre", "part", "cond", F.struct(F.col("rep").alias("rep"), pick("read").alias("read_ids"), pick("vec").alias("events"), pick("pred").alias("preds"), pick("outlier").alias("outlier_preds")).alias("s"))
    reps = lambda k: F.array_sort(F.filter(F.collect_list(F.when(F.col("cond") == k, F.col("s"))), lambda x: x.isNotNull()))
    both = by_rep.groupBy("gene", "centre", "part").agg(reps(0).alias("cntrl"), reps(1).alias("treat"))
    keyed = lambda c: F.map_from_entries(F.transform(c, lambda s: F.struct(s["rep"].cast("string"), s)))
    size = F.size("mu1")
    square = lambda c: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice(F.col(c), i * size + 1, size))
    bounds = F.when(F.col("low").isNotNull(), F.struct(F.zip_with("low", "high", lambda a, b: F.array(a, b)).alias("bounds")))  # none without a box
    model = F.struct(
        F.struct(F.col("mu1").alias("mu"), square("cov1").alias("cov")).alias("unmod"), F.struct(F.col("mu2").alias("mu"), square("cov2").alias("cov")).alias("mod"),
        bounds.alias("outlier"), F.col("w").alias("weights"),
    )
    joined = both.join(models, ["gene", "centre"])
    return joined.select("gene", "centre", "part", F.to_json(F.struct("kmers", model.alias("model"), keyed("cntrl").alias("cntrl"), keyed("treat").alias("treat"))).alias("json"))


def write_predictions(documents: DataFrame, inputs: dict[str, list[str]], path: str) -> None:
    """Predictions as lines of JSON, one for each part of a window, in parts/; what they were made from, as input_fns, in inputs/.

    documents: gene, centre, part, json. inputs: the names of the tables of each condition, by replicate. Lines are written where they are
    made, as all predictions together need not fit one task.
    """
    head = F.to_json(F.struct(F.col("gene").cast("string").alias("gene_id"), F.col("centre").alias("pos"), "part"))
    line = F.concat(F.left(head, F.length(head) - 1), F.lit(","), F.expr("substr(json, 2)"))
    documents.select(line.alias("line")).write.text(f"{path}/parts")
    named = {cond: dict(enumerate(names)) for cond, names in inputs.items()}
    documents.sparkSession.createDataFrame([(json.dumps({"input_fns": named}),)], "line string").write.text(f"{path}/inputs")
