"""The given tables seen as events, annotations, kmers and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..storage import scratch, stored  # noqa: F401

ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene (region), read (order), pos (line), cond (0 control, 1 treatment), rep, mean, duration; two lines carry a shift in treated reads."""
    line, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    # The dimensions are reduced to the keys first; Spark broadcasts them only while they are small.
    region = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.col("n_regionkey").cast("long").alias("gene"))
    reads = orders.join(region, orders["o_custkey"] == region["c_custkey"]).select("o_orderkey", "gene", "o_totalprice")
    joined = line.join(reads, line["l_orderkey"] == reads["o_orderkey"])
    shifted = (F.col("l_orderkey") % 2 == 1) & F.col("l_linenumber").isin(3, 4) & (F.col("l_orderkey") % 3 > 0)
    mean = 60 + F.col("o_totalprice") / 50000 + 0.02 * F.col("l_quantity") + F.when(shifted, 8.0).otherwise(0.0)
    return joined.select(
        "gene", F.col("l_orderkey").alias("read"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_orderkey") % 2).alias("cond"),
        (F.expr("l_orderkey div 2") % 2 + 1).alias("rep"), mean.alias("mean"), (F.col("l_tax") * 16).alias("duration"), *ORDER,
    )


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dedupe_first(raw_events(spark, sf_dir), ["cond", "rep", "gene", "read", "pos"], ORDER)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.drop_stalls(deduped(spark, sf_dir)).select("gene", "read", "pos", "cond", "rep", "mean", "l_suppkey")


def vectors(spark: SparkSession, sf_dir: str, depth: int = 6, size: int = 3) -> DataFrame:
    e = stored(events(spark, sf_dir).select("gene", "read", "pos", "cond", "rep", "mean"))
    windows = ev.valid_windows(ev.valid_positions(e, depth), size)
    v = stored(ev.window_vectors(e, windows, size))
    return v.join(ev.deep_windows(v, depth).select("gene", "centre"), ["gene", "centre"], "left_semi")


def exon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") * 100
    strand = F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("transcript_id"), F.col("o_orderpriority").alias("gene_id"), F.col("o_orderstatus").alias("chrom"), strand.alias("strand"),
        start.alias("start"), (start + 50 + F.col("o_orderkey") % 50).alias("end"), F.col("o_orderkey").alias("row_no"),
    )


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    attrs = F.format_string('gene_id "%s"; level %d; transcript_id "%s"; gene_id "G%d";', "n_name", "s_nationkey", "s_name", "s_suppkey")
    feature = F.when(F.col("s_suppkey") % 3 == 0, "CDS").otherwise("exon")
    mark = F.when(F.col("s_suppkey") % 10 == 0, "#").otherwise("")
    line = F.concat(mark, F.concat_ws("\t", F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")), F.lit("x"), feature, (F.col("s_suppkey") * 10).cast("string"), (F.col("s_suppkey") * 10 + 99).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", attrs.alias("attrs"), line.alias("value"))


def kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("gene"), F.col("p_size").cast("long").alias("pos"), F.col("p_brand").alias("kmer"), (F.col("p_partkey") % 4).alias("sample"), F.col("p_partkey").alias("row_no"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted windows as far as their orientation needs them: id, kmers, mu1, mu2, from parts."""
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("kmers"), F.array(price, size * 30).alias("mu1"), F.array(size * 40, price / 2).alias("mu2"),
    )


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = part.select(F.col("p_brand").alias("kmer"), "p_retailprice").unionByName(part.select(F.col("p_type").alias("kmer"), "p_retailprice"))
    return both.groupBy("kmer").agg(F.round(F.avg("p_retailprice"), 4).alias("level_mean"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kmer model on the scale of the events: kmer, level_mean."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kmer")).agg((50 + F.avg("p_retailprice") / 100).alias("level_mean"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    q = F.col("l_quantity").cast("int")
    cigar = F.array(op(0, q * 10), op(1, F.col("l_linenumber")), op(0, q * 5), op(2, F.col("l_partkey") % 20), op(3, F.col("l_suppkey") % 9))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", cigar.alias("cigar"), (q * 15).alias("query_alignment_length"),
        F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(q * 15 + F.col("l_partkey") % 60).cast("int").alias("query_length"), (q * 16).alias("inferred_length"),
        (F.col("l_discount") * 2).alias("de"), (F.col("l_suppkey") % 4).alias("mapping_quality"),
    )
