"""What several operators need: tables in the cluster's shared folder, distributed ranks and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark then removes a query's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scope:
    """The tables that operators wrote while it was open. release() removes them and no others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def release(self) -> None:
        """For callers who have stored the results that read these tables."""
        while self.paths:
            filesystem, jpath = _filesystem(self.spark, self.paths.pop())
            filesystem.delete(jpath, True)


_open: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Gathers the tables that operators write inside the block; it doesn't remove them by itself, as results are lazy."""
    own = Scope(spark)
    before = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and all runs on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the session's JVM ends or by the open scope's release()."""
    path = f"{shared_dir(spark)}/duosig-{uuid.uuid4().hex}"
    filesystem, jpath = _filesystem(spark, path)
    filesystem.deleteOnExit(jpath)
    if (own := _open.get()) is not None:
        own.paths.append(path)
    return path


def _filesystem(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside the block leave no shuffle files behind, as each may shuffle as much as its input."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, *totals: Column) -> tuple[DataFrame, dict]:
    """materialise(), with totals over all rows of the table, by name."""
    table = materialise(df)
    return table, table.agg(*totals).first().asDict()


def with_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds each row's 0-based rank within keys by (bucket, order), without putting a key's rows into one task.

    bucket: a column that rises with the order and splits each key into small pieces. A piece is ranked
    in its own window and shifted by the summed counts of the key's earlier pieces.
    """
    cut = df.withColumn("_piece", bucket)
    by = [*keys, "_piece"]
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    shift = shift.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_shift")
    ranked = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    joined = ranked.join(shift, same)
    return joined.select(*df.columns, (F.col("_shift") + F.col("_row") - 1).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds each row's 0-based rank within keys by order, whatever the order is, without putting a key's rows into one task.

    Rows are dealt by range of (keys, order), so that a key's rows lie in one partition or in adjacent ones; they are
    ranked within each partition and shifted by the counts of the key's earlier partitions. The order has to tell rows apart.
    """
    spread = materialise(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_piece", F.spark_partition_id()))
    by = [*keys, "_piece"]
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = spread.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    shift = shift.where("_shift > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_shift")
    within = spread.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # A row for each partition that a key goes on into: no more rows than partitions.
    joined = within.join(shift, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], "left")
    return joined.select(*df.columns, (F.coalesce("_shift", F.lit(0)) + F.col("_row") - 1).alias(name))


#: Edges of a component search that one task contracts; of more, each step is dealt over the cluster.
FEW_EDGES = 50_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """No more than FEW_EDGES edges as ones from each node to the smallest that it reaches."""
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array([*up], kind), pa.array([top(x) for x in [*up]], kind)], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60, size: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that its links reach.

    Large-star and small-star steps alternate until every edge points from a node to its root. Each
    step is an aggregation with partial sums and a join on a node; the edges of a round are a table in
    the shared folder, so that lineage stays short and lost executors cost one step. A step's edges go once the next ones are stored. Once no more than FEW_EDGES edges
    are left, one task contracts them to the end, as each step's queries take longer and leave more in the driver; size is their number at first, where it is known.
    """
    spark = edges.sparkSession
    told = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("hash")]

    def step(found: DataFrame) -> tuple[DataFrame, dict, Scope]:
        with scope(spark) as own:
            table, seen = observed(found.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *told)
        return table, seen, own

    at, before, own = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None, Scope(spark)
    n = size
    for _ in range(rounds):
        if n is not None and n <= FEW_EDGES:
            with scope(spark) as last:
                at = materialise(at.coalesce(1).mapInArrow(_contract, at.schema))
            own.release()
            own = last
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        at, after, new = step(small)
        n = after["n"]
        own.release()
        own = new
        if after == before or not after["n"]:
            break
        before = after
    else:
        raise RuntimeError(f"no end of the component search after {rounds} rounds")
    if (open_ := _open.get()) is not None:
        open_.paths += own.paths
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
