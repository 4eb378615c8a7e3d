"""Scans of event alignments, annotations, kmer models and stores. Gzip is read by extension; standard input has to be spooled to a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column names of a GTF file, in order: fixed values.
GTF_COLUMNS = ["chrom", "source", "ftype", "start", "end", "score", "strand", "frame", "attrs"]


def tsv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", **{"header": True, **options})


def eventalign(raw: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Event rows from a raw alignment table: t_id, pos (the middle of the kmer), kmer, r_id, mean, std, duration, points.

    Without a read_name column, names come from the summary by read_index; an index that it lacks is an error.
    """
    have = set(raw.columns)
    if not {"start_idx", "end_idx"} <= have:
        raise KeyError("start_idx and end_idx are needed: run the aligner with signal indices")
    if "read_name" not in have:
        if summary is None or "read_index" not in have:
            raise KeyError("either read_name or a summary for read_index is needed")
        raw = lookup_read_names(raw, summary)
    kept = [c for c in ("row_no", "_file", "_block") if c in have]
    return raw.select(
        F.col("contig").cast("string").alias("t_id"),
        (F.col("position").cast("long") + 2).alias("pos"),
        F.col("reference_kmer").cast("string").alias("kmer"),
        F.col("read_name").cast("string").alias("r_id"),
        F.col("event_level_mean").cast("double").alias("mean"),
        F.col("event_stdv").cast("double").alias("std"),
        F.col("event_length").cast("double").alias("duration"),
        (F.col("end_idx").cast("long") - F.col("start_idx").cast("long")).alias("points"),
        *kept,
    )


def lookup_read_names(raw: DataFrame, summary: DataFrame, strict: bool = True) -> DataFrame:
    """raw with read_name by read_index; of repeated indices the last row of the summary (by row_no) counts."""
    names = summary.groupBy(F.col("read_index").cast("string").alias("_index")).agg(F.max_by("read_name", "row_no").alias("read_name"))
    joined = raw.join(names, F.col("read_index").cast("string") == F.col("_index"), "left").drop("_index")
    if not strict:
        return joined.where("read_name is not null")
    missing = F.raise_error(F.concat(F.lit("no read name for index "), F.col("read_index").cast("string"))).cast("string")
    return joined.withColumn("read_name", F.coalesce("read_name", missing))


def gtf_attrs(attrs: Column) -> Column:
    """Quoted attributes as a map: a name, a space, and a value in double quotes, which a semicolon or the line's end follows.

    The last of repeated keys wins; attributes without quotes, with an empty value or with something else behind it are left out. Semicolons within quotes
    belong to the value. Every second piece between quotes is a value; its name is the last word before it.
    """
    parts = F.split(attrs, '"')

    def told(p: Column) -> Column:
        ends = lambda i: F.get(p, i + 1).startswith(";") | ((F.get(p, i + 1) == "") & (i + 2 == F.size(p)))
        values = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i % 2 == 1) & (F.get(p, i) != "") & F.coalesce(ends(i), F.lit(False)))
        name = lambda i: F.element_at(F.split(F.trim(F.substring_index(F.get(p, i - 1), ";", -1)), " "), -1)
        return F.filter(F.transform(values, lambda i: F.struct(name(i).alias("k"), F.get(p, i).alias("v"))), lambda x: x["k"] != "")

    # What is used more than once is bound once, as the only element of an array.
    last = lambda q: F.filter(q, lambda x, i: ~F.exists(F.slice(q, i + 2, F.size(q)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.transform(F.transform(F.array(parts), told), last)[0])


def gtf(lines: DataFrame, ftype: str = "exon", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of one type from lines (a column value, and those to keep): comments are dropped, start becomes 0-based."""
    part = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(*[part[i].alias(c) for i, c in enumerate(GTF_COLUMNS)], *keep)
    rows = rows.where(F.col("ftype") == ftype)
    return rows.select("chrom", (F.col("start").cast("long") - 1).alias("start"), F.col("end").cast("long").alias("end"), "ftype", "strand", gtf_attrs(F.col("attrs")).alias("attrs"), *keep)


def kmer_model(spark: SparkSession, path: str) -> DataFrame:
    """kmer, level_mean, level_stdv of a model table with # comments."""
    return tsv(spark, path, comment="#").select("kmer", F.col("level_mean").cast("double").alias("level_mean"), F.col("level_stdv").cast("double").alias("level_stdv"))


def exons(features: DataFrame) -> DataFrame:
    """Transcript exons in order with cs, the length of the exons before, and ln, the transcript's length.

    features: transcript_id, gene_id, chrom, strand, start, end, row_no. Gene, chromosome and strand are the first row's.
    """
    by = Window.partitionBy("transcript_id")
    before = by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("end") - F.col("start")
    first = lambda c: F.min_by(c, "row_no").over(by).alias(c)
    return features.select("transcript_id", first("gene_id"), first("chrom"), first("strand"), "start", "end", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("cs"), F.sum(size).over(by).alias("ln"))


def write_store(events: DataFrame, path: str) -> None:
    """Writes events by sample in ranges of genes and positions, so that a sample is spread over many files and a gene's rows are in few of them."""
    place = [c for c in ("sample", "gene_id", "pos") if c in events.columns]
    events.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("sample").parquet(path)


def read_store(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments with the columns that the alignment filter reads: cigar (op, len), lengths, de and mapping_quality."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def write_alignments(kept: DataFrame, path: str) -> None:
    """Kept alignments with all their columns, by reference name and position where they have these."""
    place = [c for c in ("reference_name", "reference_start") if c in kept.columns]
    (kept.repartitionByRange(*place).sortWithinPartitions(*place) if place else kept).write.parquet(path)
