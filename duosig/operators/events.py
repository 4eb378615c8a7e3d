"""From event rows to windows: collapsing, liftover, depth, windows and their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_precision
from . import ranges


def collapse_runs(events: DataFrame, keys: list[str], source: list[str], order: str, aggregates: list) -> DataFrame:
    """Groups adjacent rows with equal keys: a run ends where a key changes in the order of each source.

    The running number of a run is per source (a read or a file), so that the window has a key to partition by.
    """
    w = Window.partitionBy(*source).orderBy(order)
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    runs = events.withColumn("_new", (changed | F.lag(order).over(w).isNull()).cast("long")).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(*dict.fromkeys([*source, "run", *keys])).agg(*aggregates)


def pooled(mean: str = "mean", std: str = "std", n: str = "points") -> list:
    """Pooled mean and deviation of events with n points each; a single event's own values stay as they are, no points give null."""
    m, s, k = (F.col(c).cast("double") for c in (mean, std, n))
    total, some = F.sum(k), F.count("*")
    average = F.try_divide(F.sum(k * m), total)
    variance = F.try_divide(F.sum(k * s * s), total) + F.try_divide(F.sum(k * m * m), total) - average * average
    return [F.when(some == 1, F.first(m)).otherwise(average).alias("mean"), F.when(some == 1, F.first(s)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std")]


#: Positions of a transcript that share one row of its exons.
PIECE_POSITIONS = 256


def exon_pieces(exons: DataFrame, size: int = PIECE_POSITIONS) -> DataFrame:
    """A row for every piece of so many positions of a transcript, with the exons that reach into it, by their starts.

    Exons lie at positions of the transcript in its own direction: on the minus strand the last one on the genome comes first, and the
    genome runs backwards. origin plus or minus a position is its place on the genome.
    """
    width = F.col("end") - F.col("start")
    back = F.col("strand") == "-"
    first = F.when(back, F.col("ln") - F.col("cs") - width).otherwise(F.col("cs"))
    placed = exons.where(width > 0).withColumn("_first", first)
    origin = F.when(back, F.col("end") - 1 + F.col("_first")).otherwise(F.col("start") - F.col("_first"))
    exon = F.struct(F.col("_first").alias("first"), (F.col("_first") + width).alias("stop"), origin.alias("origin"))
    reach = F.sequence(F.floor(F.col("_first") / size), F.floor((F.col("_first") + width - 1) / size))
    each = placed.select(F.col("transcript_id").alias("_t"), "gene_id", "chrom", "strand", exon.alias("_exon"), F.explode(reach).alias("_piece"))
    return each.groupBy("_t", "_piece", "gene_id", "chrom", "strand").agg(F.array_sort(F.collect_list("_exon")).alias("_exons"))


def liftover(events: DataFrame, exons: DataFrame, strict: bool = True, size: int = PIECE_POSITIONS, parts: int | None = None) -> DataFrame:
    """events (transcript_id, pos) with gene_id, chrom, strand and gpos.

    Every event meets one row, its piece of the transcript, by an equi-join, and takes the last exon of it that starts at or before its
    position: rows into the join are the events and the pieces, however many exons a transcript has, and Spark splits the events of a hot one.
    strict raises on unknown transcripts and positions outside; else these rows go. Of more rows than Spark's number of shuffle partitions
    is good for, events meet their pieces in so many parts.
    """
    pieces = exon_pieces(exons, size)
    placed = events.withColumn("_p", F.floor(F.col("pos") / size))
    if parts is not None:
        placed = placed.repartition(parts, "transcript_id", "_p")
    joined = placed.join(pieces, (F.col("transcript_id") == F.col("_t")) & (F.col("_p") == F.col("_piece")), "left" if strict else "inner")
    before = F.filter("_exons", lambda e: e["first"] <= F.col("pos"))
    found = joined.withColumn("_exon", F.get(before, F.size(before) - 1)).withColumn("_exon", F.when(F.col("pos") < F.col("_exon.stop"), F.col("_exon")))
    gpos = F.col("_exon.origin") + F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos"))
    if strict:
        wrong = F.raise_error(F.concat_ws(" ", F.lit("no exon for"), "transcript_id", F.col("pos").cast("string"))).cast("long")
        gpos = F.coalesce(gpos, wrong)
    else:
        found = found.where("_exon is not null")
    return found.withColumn("gpos", gpos).select(*events.columns, "gene_id", "chrom", "strand", "gpos")


def dedupe_first(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def drop_stalls(events: DataFrame) -> DataFrame:
    """Keeps events of at most one second in half precision; a zero duration stays, a missing one goes."""
    return events.where(half_precision(F.col("duration")) <= 1.0)


def encode(rows: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Distinct values of each group with their ordinal by first appearance, from 0. Values are ranked by range, so a group may be of any size."""
    first = rows.groupBy(*group, value).agg(F.min(F.struct(*order)).alias("_first"))
    return ranges.ranked(first, group, [F.col("_first"), F.col(value)], "idx").withColumn("idx", F.col("idx").cast("long")).drop("_first")


def shared_by_all(rows: DataFrame, key: str, sample: str, samples: int) -> DataFrame:
    """Keys that every one of so many samples has."""
    return rows.groupBy(key).agg(F.count_distinct(sample).alias("_n")).where(F.col("_n") == samples).select(key)


def valid_positions(events: DataFrame, min_depth: int) -> DataFrame:
    """(gene, pos) whose depth is at least min_depth in every replicate that the gene has in each of the conditions."""
    depth = events.groupBy("gene", "cond", "rep", "pos").agg(F.count("mean").alias("n"))
    reps = events.groupBy("gene", "cond").agg(F.count_distinct("rep").alias("reps"))
    good = depth.where(F.col("n") >= min_depth).groupBy("gene", "cond", "pos").agg(F.count("*").alias("good")).join(reps, ["gene", "cond"]).where("good = reps")
    return good.groupBy("gene", "pos").agg(F.count("*").alias("conds")).where("conds = 2").select("gene", "pos")


def valid_windows(positions: DataFrame, size: int) -> DataFrame:
    """Centres whose size // 2 neighbours on either side are valid too; an even size acts as the next odd one."""
    half = size // 2
    w = Window.partitionBy("gene").orderBy("pos").rangeBetween(-half, half)
    return positions.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == 2 * half + 1).select("gene", F.col("pos").alias("centre"))


def default_depth(size: int) -> int:
    """Least reads of a replicate for a window of so many positions: at least as many as there are features, twice over."""
    return max(2 * size, 5)


def _in_order(values: Column, strand: Column | None) -> Column:
    """Values by position in the direction of the transcript: reversed on the minus strand."""
    return values if strand is None else F.when(strand == "-", F.reverse(values)).otherwise(values)


def stretches(windows: DataFrame) -> DataFrame:
    """(gene, stretches): the centres of a gene's windows as sorted stretches (low, high) without gaps."""
    by = Window.partitionBy("gene").orderBy("centre")
    gap = F.coalesce(F.col("centre") - F.lag("centre").over(by) > 1, F.lit(True))
    islands = windows.select("gene", "centre", gap.cast("long").alias("_gap")).withColumn("_island", F.sum("_gap").over(by))
    each = islands.groupBy("gene", "_island").agg(F.struct(F.min("centre").alias("low"), F.max("centre").alias("high")).alias("_s"))
    return each.groupBy("gene").agg(F.array_sort(F.collect_list("_s")).alias("stretches"))


def window_vectors(events: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Per window and read the means at all positions, in order of position; reads that lack one are left out.

    Where events have a column strand, windows on the minus strand run backwards. A read has one event at a position. Its events are
    one sorted array, shuffled once, and windows are slices of it where positions follow each other and the gene has a window: no
    event is copied before the shuffle, and a gene's windows are a few stretches.
    """
    half, stranded = size // 2, ["strand"] if "strand" in events.columns else []
    more = [F.min("strand").alias("strand")] if stranded else []
    reads = events.where("mean is not null").groupBy("gene", "cond", "rep", "read").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("v"), *more)
    held = reads.where(F.size("v") > 2 * half).join(stretches(windows), "gene")
    whole = f"v[i + {half}].pos - v[i - {half}].pos = {2 * half} and exists(stretches, s -> v[i].pos between s.low and s.high)"
    cut = f"transform(filter(sequence({half}, size(v) - 1 - {half}), i -> {whole}), i -> struct(v[i].pos as centre, slice(v.mean, i - {half} + 1, {2 * half + 1}) as vec))"
    each = held.select("gene", "cond", "rep", "read", *stranded, F.explode(F.expr(cut)).alias("_w"))
    return each.select("gene", "_w.centre", "cond", "rep", "read", _in_order(F.col("_w.vec"), F.col("strand") if stranded else None).alias("vec"))


def deep_windows(vectors: DataFrame, min_depth: int) -> DataFrame:
    """Windows in which every replicate of both conditions has min_depth complete reads; all replicates of the gene have to be there."""
    depth = vectors.groupBy("gene", "centre", "cond", "rep").agg(F.count("*").alias("n"))
    reps = vectors.groupBy("gene").agg(F.count_distinct("cond", "rep").alias("reps"))
    deep = depth.groupBy("gene", "centre").agg(F.min("n").alias("depth"), F.count("*").alias("have"))
    return deep.join(reps, "gene").where((F.col("depth") >= min_depth) & (F.col("have") == F.col("reps"))).select("gene", "centre", "depth")


def last_kmers(kmers: DataFrame) -> DataFrame:
    """One kmer per (gene, pos): that of the last sample, and its last row."""
    return kmers.groupBy("gene", "pos").agg(F.max_by("kmer", F.struct("sample", "row_no")).alias("kmer"))


def window_kmers(kmers: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """The kmers of each window in order of position; where windows have a column strand, backwards on the minus strand."""
    half, stranded = size // 2, ["strand"] if "strand" in windows.columns else []
    wide = windows.select("gene", "centre", *stranded, F.explode(F.sequence(F.col("centre") - half, F.col("centre") + half)).alias("pos"))
    got = wide.join(kmers, ["gene", "pos"]).groupBy("gene", "centre", *stranded).agg(F.array_sort(F.collect_list(F.struct("pos", "kmer"))).alias("k"))
    kmer = _in_order(F.transform("k", lambda x: x["kmer"]), F.col("strand") if stranded else None)
    return got.withColumn("kmers", kmer).drop("k", *stranded)


def subsample(rows: DataFrame, group: list[str], key, most: int) -> DataFrame:
    """At most so many rows of each group, drawn by a hash key, which doesn't depend on partitions."""
    w = Window.partitionBy(*group).orderBy(key, "read")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def max_indel(cigar: str = "cigar", skips: bool = True):
    """Longest insertion, deletion or (with skips) skip of an array of (op, len); 0 without any."""
    ops = [1, 2, 3] if skips else [1, 2]
    return F.coalesce(F.array_max(F.transform(F.filter(cigar, lambda c: c["op"].isin(ops)), lambda c: c["len"])), F.lit(0))


def filter_alignments(alignments: DataFrame, min_length: int = 100, min_fraction: float = 0.85, max_divergence: float = 0.15, min_quality: int = 1, max_indel_size: int = 15) -> DataFrame:
    """Alignments that are long, cover their read, agree with the reference, are placed well and have no long indel."""
    length = F.coalesce(F.nullif(F.col("query_length"), F.lit(0)), F.col("inferred_length"))
    aligned = F.col("query_alignment_length")
    return alignments.where(
        (aligned >= min_length) & (F.try_divide(aligned, length) >= min_fraction) & (F.col("de") <= max_divergence)
        & (F.col("mapping_quality") >= min_quality) & (max_indel() <= max_indel_size)
    )
