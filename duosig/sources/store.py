"""A store of events that samples are added to: names once, in dictionaries, and events in small numbers, dealt into buckets by place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_bits, half_of_bits
from ..operators import events as ev
from ..operators import ranges
from ..storage import stored

#: Positions of a gene that share a bucket, so that a gene with many events is in several.
REGION = 1024
#: Reads of a gene that one task writes: of more, a bucket is several files, so that few genes are still many tasks.
READS = 1 << 16
#: Events of a page, the least that is read of a file: a few genes' events are few pages.
PAGE_ROWS = 4096
HALVES = ("mean", "std", "duration")
EVENTS = "gene_no INT, region INT, pos INT, transcript_no INT, read_no INT, mean SMALLINT, std SMALLINT, duration SMALLINT, sample STRING"


class Store:
    """Tables under a path: genes, transcripts (by gene), reads (by sample and gene), kmers (by sample and place) and events (by sample).

    Numbers are ordinals by first appearance, from 0: genes in the store, transcripts in their gene, reads in their sample and gene. A number once given stays, whatever is
    added. Means, deviations and durations are the 16 bits of half precision. Events are sorted in buckets by gene and region of REGION positions, as many
    for each sample as the store was made with: samples meet at their places without a shuffle.

    Buckets are part of the table's definition, which a session that opens the store states again from what the store says of itself. Places are keys of their own within a bucket's
    keys, so the session is told that some of a join's keys are enough to have sides dealt alike.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.name = spark, path.rstrip("/"), f"store_{uuid.uuid4().hex}"
        known = self._table("meta", "buckets INT")
        if (row := known.first()) is not None:
            buckets = row["buckets"]
        else:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self.buckets = buckets
        filesystem, events = self._place("events")
        filesystem.mkdirs(events)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.sql(f"CREATE TABLE {self.name} ({EVENTS}) USING parquet OPTIONS ('parquet.page.row.count.limit' = '{PAGE_ROWS}') PARTITIONED BY (sample) CLUSTERED BY (gene_no, region) SORTED BY (gene_no, region, pos) INTO {buckets} BUCKETS LOCATION '{self.path}/events'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _place(self, part: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _table(self, part: str, schema: str) -> DataFrame:
        """A part of the store; no rows while nothing was added to it."""
        filesystem, path = self._place(part)
        if not filesystem.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    @property
    def genes(self) -> DataFrame:
        return self._table("genes", "gene_id string, gene_no int, chrom string, strand string")

    @property
    def transcripts(self) -> DataFrame:
        return self._table("transcripts", "gene_no int, transcript_id string, transcript_no int")

    @property
    def reads(self) -> DataFrame:
        return self._table("reads", "gene_no int, read_id string, read_no int, sample string")

    @property
    def kmers(self) -> DataFrame:
        return self._table("kmers", "gene_no int, pos int, kmer string, sample string")

    def samples(self) -> list[str]:
        return sorted(r["partition"].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def add(self, events: DataFrame, sample: str) -> None:
        """Adds a sample: gene_id, transcript_id, chrom, strand, pos, kmer, read_id, mean, std, duration, row_no, as workflow.prepare() gives them.

        Of a read's events at a position the first stays, as all readers keep that; of a position's kmers the last. A sample that is there
        is an error. Dictionaries grow first and events come last: what a failed call leaves is not a sample, and its numbers stay good.
        """
        if sample in self.samples():
            raise ValueError(f"{sample} is in the store")
        events = stored(events)
        self._grow_genes(events)
        placed = events.join(self.genes.select("gene_id", "gene_no"), "gene_id").withColumn("pos", F.col("pos").cast("int"))
        self._grow_transcripts(placed)
        reads = ev.encode(placed, ["gene_no"], "read_id", ["row_no"])
        reads.select("gene_no", "read_id", F.col("idx").cast("int").alias("read_no")).write.mode("overwrite").parquet(f"{self.path}/reads/sample={sample}")
        placed.groupBy("gene_no", "pos").agg(F.max_by("kmer", "row_no").alias("kmer")).write.mode("overwrite").parquet(f"{self.path}/kmers/sample={sample}")
        first = ev.dedupe_first(placed, ["gene_no", "read_id", "pos"], ["row_no"])
        numbered = first.join(self.transcripts, ["gene_no", "transcript_id"]).join(self.reads.where(F.col("sample") == sample).drop("sample"), ["gene_no", "read_id"])
        rows = numbered.select("gene_no", F.floor(F.col("pos") / REGION).cast("int").alias("region"), "pos", "transcript_no", "read_no", *[half_bits(F.col(c)).alias(c) for c in HALVES], F.lit(sample).alias("sample"))
        bucket = F.pmod(F.hash("gene_no", "region"), F.lit(self.buckets))
        dealt = rows.repartition(bucket, F.floor(F.col("read_no") / READS))
        dealt.write.mode("append").format("parquet").partitionBy("sample").bucketBy(self.buckets, "gene_no", "region").sortBy("gene_no", "region", "pos").saveAsTable(self.name)

    def _grow_genes(self, events: DataFrame) -> None:
        known = self.genes
        new = events.groupBy("gene_id").agg(F.min("row_no").alias("_first"), F.max_by("chrom", "row_no").alias("chrom"), F.max_by("strand", "row_no").alias("strand")).join(known.select("gene_id"), "gene_id", "left_anti")
        after = known.agg(F.coalesce(F.max("gene_no") + 1, F.lit(0))).first()[0]
        ranked = ranges.ranked(new, [], [F.col("_first"), F.col("gene_id")], "_n")
        ranked.select("gene_id", (F.col("_n") + after).cast("int").alias("gene_no"), "chrom", "strand").write.mode("append").parquet(f"{self.path}/genes")

    def _grow_transcripts(self, placed: DataFrame) -> None:
        known = self.transcripts
        new = placed.groupBy("gene_no", "transcript_id").agg(F.min("row_no").alias("_first")).join(known.select("gene_no", "transcript_id"), ["gene_no", "transcript_id"], "left_anti")
        after = known.groupBy("gene_no").agg((F.max("transcript_no") + 1).alias("_after"))
        ranked = ranges.ranked(new, ["gene_no"], [F.col("_first"), F.col("transcript_id")], "_n").join(after, "gene_no", "left")
        ranked.select("gene_no", "transcript_id", (F.col("_n") + F.coalesce("_after", F.lit(0))).cast("int").alias("transcript_no")).write.mode("append").parquet(f"{self.path}/transcripts")

    def numbers(self, sample: str, genes: list[str] | None = None) -> DataFrame:
        """A sample's events as they are stored, but for their halves, which are numbers again. Of other genes than those asked for no pages are read, as files are sorted by gene."""
        rows = self.spark.table(self.name).where(F.col("sample") == sample)
        if genes is not None:
            rows = rows.where(F.col("gene_no").isin([r["gene_no"] for r in self.genes.where(F.col("gene_id").isin(genes)).collect()]))
        return rows.withColumns({c: half_of_bits(F.col(c)) for c in HALVES})

    def events(self, sample: str, genes: list[str] | None = None) -> DataFrame:
        """A sample's events with their names, of all genes or those asked for, as workflow.load_events() takes them; row_no is 0, as a read has one event at a position."""
        rows = self.numbers(sample, genes).join(self.genes, "gene_no").join(self.transcripts, ["gene_no", "transcript_no"])
        rows = rows.join(self.reads.where(F.col("sample") == sample).drop("sample"), ["gene_no", "read_no"]).join(self.kmers.where(F.col("sample") == sample).drop("sample"), ["gene_no", "pos"], "left")
        return rows.select("gene_id", "transcript_id", "chrom", "strand", F.col("pos").cast("long").alias("pos"), "kmer", "read_id", *HALVES, F.lit(0).cast("long").alias("row_no"))

    def pairs(self, one: str, two: str) -> DataFrame:
        """Positions that two samples have, with the number of events of either: both sides are dealt alike already."""
        keys = ["gene_no", "region", "pos"]
        depth = lambda sample, name: self.numbers(sample).groupBy(*keys).agg(F.count("*").alias(name))
        return depth(one, "n_one").join(depth(two, "n_two"), keys)
